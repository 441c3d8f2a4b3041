"""Metrics against plain-Python brute force (the definitions the reference gets from its metric library)."""

import math
import random

from tiergate.operators import metrics as M


def _macro(gold, pred):
    labels = sorted(set(gold) | set(pred))
    ps, rs, fs = [], [], []
    for lab in labels:
        tp = sum(1 for g, p in zip(gold, pred) if g == lab and p == lab)
        npred = sum(1 for p in pred if p == lab)
        ngold = sum(1 for g in gold if g == lab)
        ps.append(tp / npred if npred else 0.0)
        rs.append(tp / ngold if ngold else 0.0)
        fs.append(2 * tp / (ngold + npred) if ngold + npred else 0.0)
    return sum(ps) / len(ps), sum(rs) / len(rs), sum(fs) / len(fs)


def test_macro_prf_random_groups(spark):
    rnd = random.Random(7)
    rows = [(g, rnd.randint(0, 2), rnd.choice([0, 1, 2, 2])) for g in ("a", "b", "c") for _ in range(200)]
    rows += [("d", 1, 1), ("e", 0, 1)]  # one class only; label only in pred
    df = spark.createDataFrame(rows, "k string, gold int, pred int")
    got = {r.k: (r.m_pre, r.m_rec, r.m_f1) for r in M.macro_prf(df, ["k"]).collect()}
    for k in "abcde":
        g = [r[1] for r in rows if r[0] == k]
        p = [r[2] for r in rows if r[0] == k]
        for x, y in zip(got[k], _macro(g, p)):
            assert abs(x - y) < 1e-8


def test_macro_prf_empty(spark):
    df = spark.createDataFrame([], "k string, gold int, pred int")
    assert M.macro_prf(df, ["k"]).count() == 0


def test_multilabel_mean_over_all_positions(spark):
    gold = [[1, 0, 0], [0, 1, 0], [0, 0, 0]]
    pred = [[1, 0, 0], [1, 0, 0], [0, 0, 0]]
    df = spark.createDataFrame([(g, p) for g, p in zip(gold, pred)], "gold array<int>, pred array<int>")
    r = M.macro_prf_multilabel(df).first()
    # position 0: tp 1, np 2, ng 1 -> P .5 R 1 F 2/3; position 1: tp 0 -> zeros; position 2: nothing -> zeros
    assert abs(r.m_pre - 0.5 / 3) < 1e-9 and abs(r.m_rec - 1 / 3) < 1e-9 and abs(r.m_f1 - (2 / 3) / 3) < 1e-9


def test_regression_metrics(spark):
    g = [1.0, 2.0, 3.0, 4.0, 5.0]
    p = [1.5, 2.0, 2.0, 4.5, None]
    df = spark.createDataFrame(list(zip(g, p)), "gold double, pred double")
    r = M.regression_metrics(df).first()
    gg, pp = g[:4], p[:4]
    mse = sum((a - b) ** 2 for a, b in zip(gg, pp)) / 4
    mean = sum(gg) / 4
    r2 = 1 - sum((a - b) ** 2 for a, b in zip(gg, pp)) / sum((a - mean) ** 2 for a in gg)
    assert r.n == 4 and r.unparsed == 1
    assert abs(r.rmse - math.sqrt(mse)) < 1e-6 and abs(r.mae - sum(abs(a - b) for a, b in zip(gg, pp)) / 4) < 1e-6
    assert abs(r.r2 - r2) < 1e-6


def test_constant_gold_gives_null_r2(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "gold double, pred double")
    assert M.regression_metrics(df).first().r2 is None


def test_null_labels_are_counted(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 1), ("a", 0, None), ("b", 1, None)], "k string, gold int, pred int")
    got = {r.k: (r.n, r.unlabelled, r.m_f1) for r in M.macro_prf(df, ["k"]).collect()}
    assert got == {"a": (1, 2, 1.0), "b": (0, 1, None)}


def test_r2_of_large_offsets(spark):
    """A sum of squares less a squared sum would cancel here."""
    g = [1e9 + i for i in range(10)]
    r = M.regression_metrics(spark.createDataFrame([(x, x + 0.5) for x in g], "gold double, pred double")).first()
    assert abs(r.r2 - (1 - 10 * 0.25 / 82.5)) < 1e-6
