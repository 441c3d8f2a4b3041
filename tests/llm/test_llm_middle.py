"""Fill-in-the-middle: unit index against plain code points, cuts and round trip against plain slicing."""

import hashlib
import random
from collections import Counter

import numpy as np
from cases import awkward, empty, prose
from conftest import SF_SMALL

from tiergate.llm import fill_in_middle as M


def test_unit_index():
    r = random.Random(1)
    for t in range(1500):
        s = "".join(r.choice(["a", "é", "漢", "😀", "\x00", "b"]) for _ in range(r.randint(0, 40)))
        ends = np.cumsum([0, *(len(c.encode()) for c in s)]).tolist()
        index = M.UnitIndex(np.frombuffer(s.encode(), np.uint8))
        assert index.select(np.arange(len(s) + 1)).tolist() == ends
        places = np.arange(ends[-1] + 1)
        assert index.rank(places).tolist() == [sum(e <= at for e in ends[1:]) for at in places.tolist()]


def brute(doc_id, text):
    t = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(t)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, digest(t), digest(t)
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, lo, hi - lo, digest(out), digest(t)


def check(docs):
    want = Counter(brute(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in M.report(docs).collect()) == want
    return want


def test_awkward_rows(spark):
    check(awkward(spark))
    assert M.report(empty(spark)).count() == 0


def test_sentinels_and_near_sentinels(spark):
    parts = ["<", ">", "<P", "P>", "<S", "S>", "<M", "M>", "<P>", "<S>", "<M>", "é", "x"]
    r = random.Random(4)
    rows = [(i, "".join(r.choice(parts[: 8 if i % 3 else 13]) for _ in range(r.randint(1, 30)))) for i in range(1500)]
    seen = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {k[2] for k in seen} == {"plain", "psm", "spm"}


def test_long_texts_and_shares(spark):
    rows = [(i, prose(i, 30)) for i in range(3000)] + [(5000, "漢😀é" * 400_000), (5001, "a" * 2_000_000), (5002, "\n" * 1_000_000)]
    seen = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    forms = Counter(k[2] for k in seen)
    assert abs(forms["plain"] / 3000 - 0.10) < 0.02 and abs(forms["spm"] / 3000 - 0.18) < 0.03


def test_parameters(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(200)], "doc_id long, text string")
    assert {r.form for r in M.transform(docs, fim_percent=100, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in M.transform(docs, fim_percent=0).collect()} == {"plain"}
    assert [r.output for r in M.transform(docs, seed=2).collect()] != [r.output for r in M.transform(docs, seed=1).collect()]


def test_table(spark):
    check(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
