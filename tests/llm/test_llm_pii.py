"""PII: base rules against plain expressions, label model, span classifier, awkward rows."""

import hashlib
import re
import time

import numpy as np
from cases import awkward, empty
from conftest import SF_SMALL

from tiergate.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(s):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in s])):
        if i % 2:
            d = d * 2 - 9 * (d * 2 > 9)
        total += d
    return total % 10 == 0


def accepted(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and plain_luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    order = list(PLAIN)
    found = [(m.start(), order.index(k), m.end()) for k, e in PLAIN.items() for m in re.finditer(e, text or "") if accepted(k, m[0])]
    return [(order[k], a, b) for a, k, b in sorted(found)]


TEXTS = [
    "a@b@c.d@e.f.g", "x@@y.z a@b. c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "+1 2", "a.b@c-d.e_f@g.h", "é@a.b 😀 joe@mail.example.com +49 (30) 1234-5678.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 1.2.3.4", "+1 (555) 123-4567 10.0.0.1", "@" * 50, "a@" * 200, "1" * 400, "1.1." * 200, "+1" * 100, "٣٣٣٣ ٤٤٤٤",
    "4 2 4 2 4 2 4 2 4 2 4 2 4 2 4 2",
]


def test_base_spans():
    for t in TEXTS:
        got = sorted((a, P.KINDS.index(k), b) for k, a, b, ok in P.base_matches(t) if ok)
        assert [(P.KINDS[k], a, b) for a, k, b in got] == brute(t), t


def test_base_spans_of_random_texts():
    r = np.random.default_rng(5)
    for alphabet in ("1.a@", "12 -", "a.b-@_ ", "+1(). -", "1.@+ -a"):
        for _ in range(1500):
            t = "".join(r.choice(list(alphabet), r.integers(1, 40)))
            got = sorted((a, P.KINDS.index(k), b) for k, a, b, ok in P.base_matches(t) if ok)
            assert [(P.KINDS[k], a, b) for a, k, b in got] == brute(t), t


def test_long_runs_take_linear_time():
    n = 2_000_000
    for t in ("7" * n, "a" * n + "@ ", "a" * n, " " * n, "\n" * n, "1." * (n // 2), "a@" * (n // 2), "+1" + "(" * n, "A1" * (n // 2), "a." * (n // 2) + "@", "1 " * (n // 2), "1-" * (n // 2)):
        start = time.perf_counter()
        list(P.candidates(t))
        assert time.perf_counter() - start < 20, t[:10]


def test_written_out_addresses_in_any_case():
    for t in ("john [at] example [dot] com", "JOHN [AT] EXAMPLE [DOT] COM", "John (At) Example.Com"):
        assert [(k, t[a:b]) for k, a, b, *_ in P.candidates(t)] == [("email", t)]


def test_label_model_recovers_reliabilities():
    """Three good labelers, one bad, with abstentions: posteriors beat the majority."""
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.4
    acc = [0.95, 0.9, 0.85, 0.4]
    votes = np.stack([np.where(r.random(4000) < 0.2, -1, np.where(r.random(4000) < a, truth, ~truth)) for a in acc], 1).astype(int)
    post, right = P.fit_reliabilities(votes, np.array(["card"] * 4000), np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.93
    assert np.allclose(right.mean(0), acc, atol=0.06)
    # patterns with counts give the same as single rows
    keys, counts = np.unique(votes, axis=0, return_counts=True)
    _, again = P.fit_reliabilities(keys, np.array(["card"] * len(keys)), counts.astype(float))
    assert np.allclose(right, again, atol=1e-6)


def test_span_classifier_fits():
    r = np.random.default_rng(1)
    x = np.c_[np.ones(500), r.integers(0, 2, (500, 3))].astype(float)
    y = (x[:, 1] * x[:, 2] > 0).astype(float)
    w = P.fit_span_classifier(x, y, np.ones(500), ridge=0.1)
    assert (((x @ w) > 0) == (y > 0)).mean() > 0.95


def test_loose_spans_are_found_and_clean_text_is_not(spark):
    loose = [
        (f"write to jane{i} [at] example [dot] com now", "email") if i % 4 == 0 else (f"call 555-{100 + i}-4567 today", "phone") if i % 4 == 1
        else (f"ssn 12{i % 10}-45-6789 given", "ssn") if i % 4 == 2 else ("IBAN DE89 3704 0044 0532 0130 00 please", "iban")
        for i in range(40)
    ]
    clean = ["version 1.2.3 of chapter 12 cost 300 on 2024-01-02", "the order 123 456 was 10 of 20", "isbn 978-3-16-148410-0 page 3", "look at it (at once) dot"]
    rows = [(i, t) for i, (t, _) in enumerate(loose)] + [(100 + i, t) for i, t in enumerate(clean)]
    got = {r.doc_id: r for r in P.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (t, kind) in enumerate(loose):
        assert got[i].spans.split(":")[0] == kind and got[i].n_email + got[i].n_phone == 0, t
    assert all(got[100 + i].spans == "" for i in range(len(clean)))


def test_resolve_keeps_base_spans():
    c = lambda k, a, b, base, key="y": {"kind": k, "start": a, "end": b, "base": base, "key": key}
    cands = [c("ip", 10, 20, True), c("card", 10, 20, True), c("phone", 5, 12, False), c("phone", 30, 40, False), c("ssn", 30, 41, False), c("ssn", 50, 60, False, "n")]
    assert P.resolve(cands, {"y"}) == [("ip", 10, 20), ("card", 10, 20), ("ssn", 30, 41)]


def check(spark, docs):
    got = P.find_pii(docs)
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got.collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        spans = brute(r.text)
        n = [sum(k == s[0] for s in spans) for k in PLAIN]
        want.append((r.doc_id is None, r.doc_id or 0, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert rows == sorted(want)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in got.collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= set(brute(texts[r.doc_id])) if r.doc_id is not None else True


def test_awkward_rows(spark):
    check(spark, awkward(spark))
    check(spark, spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert P.find_pii(empty(spark)).count() == 0


def test_table(spark):
    check(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
