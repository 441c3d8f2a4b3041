"""Numbers of whole columns of texts equal plain Python per pair: words, overlaps, LCS, embedding match, and bounded slices."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from conftest import SF_SMALL
from tiergate import fixtures as FX
from tiergate.operators import embed_match as EM
from tiergate.operators import rouge as RG
from tiergate.operators import token_columns as TC
from tiergate.plans import epochs as EP
from tiergate.plans import scorer as SC

WORDS = ["a", "b", "cat", "x1", "0", "zz"]


def plain(text):
    return re.sub("[^a-z0-9]+", " ", text or "").split()


def texts(r, n):
    return [None if r.random() < 0.1 else "".join(r.choice([*WORDS, " ", "  ", "-", "é", "日", "\n", "\x00"]) + r.choice(["", " "]) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_pair_numbers_are_those_of_plain_python(monkeypatch):
    r = random.Random(7)
    known = np.array([0, 2, 3, 5, 6])
    u = np.random.default_rng(1).normal(size=(5, 4))
    u[1] = 0
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    vector = dict(zip(known.tolist(), u))
    for trial in range(60):
        n = r.randint(0, 9)
        p, q = texts(r, n), texts(r, n)
        if n:
            q[0] = p[0]
        a, b = pa.array([None, *p], pa.string()).slice(1), pa.array(q, pa.string())
        words, (left, right) = TC.word_codes(a, b)
        assert [[words[c] for c in left[0][left[1][i] : left[1][i + 1]]] for i in range(n)] == [plain(x) for x in p]
        got = RG.overlaps(len(words), left, right) | {"lcs": RG.lcs_lengths(len(words), left, right)} | EM.matches(words, left, right, (known, u), 7)
        for i, (x, y) in enumerate(zip(map(plain, p), map(plain, q))):
            for k in (1, 2):
                assert (got[f"np{k}"][i], got[f"nr{k}"][i], got[f"ov{k}"][i]) == RG._overlap_counts(x, y, k)
            assert got["lcs"][i] == RG.lcs_length(x, y)
            ids = [[TC.hash32(w) % 7 for w in side] for side in (x, y)]
            held = [[k for k in side if k in vector] for side in ids]
            assert got["no_vector"][i] == sum(map(len, ids)) - sum(map(len, held))
            for name, s, t in (("p", *held), ("r", *held[::-1])):
                best = [max(vector[k] @ vector[m] for m in t) for k in s] if s and t else [0.0]
                assert abs(got[name][i] - np.mean(best)) < 1e-12


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(TC, "SLICE_BYTES", 100)
    monkeypatch.setattr(TC, "SLICE_ROWS", 7)
    column = pa.array(["x" * random.Random(i).randint(0, 60) for i in range(200)] + ["y" * 500, None, ""])
    parts = [c.to_pylist() for (c,) in TC.slices(column)]
    assert sum(parts, []) == column.to_pylist() and all(len(c) <= 7 and (len(c) == 1 or sum(len(x or "") for x in c) <= 100) for c in parts)


def test_features_are_counts_of_buckets(spark, monkeypatch):
    rows = [("m", i, 1, "train", 1.0, t, t) for i, t in enumerate(["A b a", None, "", "--", "x1 É x1 B", "a " * 300])]
    rows = spark.createDataFrame(rows, "model string, prompt_id long, tier int, split string, label double, scorer_text string, response string")
    for kind in ("stripped/words", "original/pairs"):
        for x in EP.examples(rows, [kind], 16).join(rows.select("prompt_id", "response"), "prompt_id").collect():
            w = plain((x.response or "").lower().replace("é", "-"))
            want = Counter(EP._bucket(t, 16) for t in w + ([f"{a} {b}" for a, b in zip(w, w[1:])] if kind.endswith("pairs") else []))
            idx, n = (np.frombuffer(bytes(c), "<i4").tolist() for c in (x.idx, x.n))
            assert list(zip(idx, n)) == sorted(want.items())


def test_training_takes_answers_without_scores(spark, tmp_path):
    """Scorers are trained on answers: no table of scores is made for them."""
    import shutil

    sf = shutil.copytree(SF_SMALL, tmp_path / "sf")
    SC.training_rows(*FX.stored_answers(spark, str(sf)))
    assert [k[2] for k in FX._STORED if k[1] == str(sf)] == ["boolq"]
