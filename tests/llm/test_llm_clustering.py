"""Clustering with norm-of-sum bounds against plain Lloyd rounds in integers."""

import hashlib
import math
from collections import Counter

import numpy as np
from conftest import SF_SMALL

from tiergate.llm import centroid_clustering as C


def brute(rows, k=8, rounds=10, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < C.LIMIT / 1024 for x in v):
            kept.append((i, tuple(math.floor(1024 * x) for x in v)))
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in starts]
    if not centroids:
        return Counter()
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        own = [min((dist(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                members = [v for (_, v), (_, a) in zip(kept, own) if a == j]
                if members:
                    centroids[j] = tuple(sum(x) // len(members) for x in zip(*members))
    per = Counter()
    for d, j in own:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, per[j], sum(per.values()), digest[j]) for (i, _), (d, j) in zip(kept, own))


def f32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_bounds_never_change_a_result():
    r = np.random.default_rng(1)
    for trial in range(40):
        n, d, k = int(r.integers(5, 400)), int(r.integers(1, 6)), int(r.integers(1, 9))
        x = r.integers(-9, 9, (n, d)) if trial % 2 else np.concatenate([r.integers(-30, 30, (n, d)) + 400 * c for c in r.integers(-5, 5, (4, d))])
        history = x[r.choice(len(x), k, replace=len(x) < k)].astype(np.int64)[None]
        state, skipped = None, 0
        for _ in range(8):
            bounds = C.Bounds(history)
            if state is None:
                state = bounds.first(x)
            else:
                *state, computed = bounds.again(x, *state)
                skipped += len(x) * k - computed
            squared = ((x[:, None] - history[-1][None]) ** 2).sum(2)
            assert (state[0] == squared.argmin(1)).all()  # argmin: ties to the smaller number
            exact = np.sqrt(((x[:, None] - history[state[2], np.arange(k)]) ** 2).sum(2))
            assert np.array_equal(state[1], exact)  # each stored distance is that of its round
            moved = history[-1].copy()
            for j in range(k):
                if (state[0] == j).any():
                    moved[j] = x[state[0] == j].sum(0) // (state[0] == j).sum()
            history = np.concatenate((history, moved[None]))
        assert skipped > 0


def test_norm_of_the_sum_is_tighter_than_the_sum_of_norms():
    there = np.array([[[0, 0]], [[30, 40]], [[0, 0]]], np.int64)  # a centroid that goes and comes back
    assert C.Bounds(there).moved[:, 0].tolist() == [0.0, 50.0, 0.0]


def awkward_rows():
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(64) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 64) for i in range(150)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]  # one vector on a third of all rows
    return rows + [(i, v) for i, v in enumerate([None, [], [1.0] * 63, [1.0] * 65, [math.nan] + [0.0] * 63, [math.inf] + [0.0] * 63, [None] + [0.0] * 63, [1e30] + [0.0] * 63], 2000)]


def test_operator_on_awkward_rows(spark):
    rows = awkward_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS distance", "'x' AS v", "3 AS met", "4 AS seen").repartition(5)
    assert Counter(tuple(r) for r in C.report(df).collect()) == brute(f32(rows))
    assert C.report(df.limit(0)).count() == 0
    few = [(1, [0.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64)]
    assert Counter(tuple(r) for r in C.report(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect()) == brute(few)
    assert C.report(spark.createDataFrame([(None, [0.0] * 64)], "vec_id long, embedding array<float>")).count() == 0


def test_operator_on_a_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    assert Counter(tuple(r) for r in C.report(df).collect()) == brute([(r.vec_id, r.embedding) for r in df.collect()])
