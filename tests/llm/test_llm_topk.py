"""Exact top-k search against brute force."""

import math
from collections import Counter

import numpy as np
from conftest import SF_SMALL

from tiergate.llm import topk_search as K


def test_index_on_random_integers():
    r = np.random.default_rng(0)
    for trial in range(80):
        n, d = int(r.integers(1, 300)), int(r.integers(1, 9))
        rows = r.integers(-300, 300, (n, d)) if trial % 2 else r.integers(-2, 2, (n, d))
        ids = r.permutation(1000)[:n].astype(np.int64)
        index = K.SlicedIndex(ids, rows, int(r.integers(1, 10)))
        for weights in (rows[0], r.integers(-5000, 5000, d), np.zeros(d, np.int64)):
            want = sorted((-int(s), int(i)) for s, i in zip(rows @ weights, ids))[:5]
            places, got = index.search(weights)
            assert [(-int(s), int(i)) for s, i in zip(got, index.ids[places])] == want


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, a) in enumerate(ok):
        if q % 50 == 0:
            others = [(i, b) for other, (i, b) in enumerate(ok) if other != at and len(a) == len(b)]
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in others)[:k]
            out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    return out


def as_set(df):
    return Counter((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_operator_on_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + j * 11) % 64 - 32) / 32.0 for j in range(6)]) for i in range(260)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, -1.0, 1.0]) for i in range(150)]  # one very common vector
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [nan] * 6), (450, [inf] + [0.0] * 5), (None, [1.0] * 6), (500, [1.0, 2.0]), (550, []), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS score", "1 AS rank", "2 AS stripe", "3 AS id", "4 AS v")
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for stripe in (K.STRIPE_BYTES, 40 * 8 * 6):
        assert as_set(K.top_k(df, df.filter("vec_id % 50 = 0"), stripe_bytes=stripe)) == brute(f32)
    assert K.top_k(df.limit(0), df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_candidates_each(spark):
    rows = [(50, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [2.0, 2.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])]
    twice = rows + [(50, [1.0, 1.0]), (50, [0.0, 2.0]), (100, [1.0, 1.0])]
    for table in (rows, twice):
        df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
        for stripe in (K.STRIPE_BYTES, 32):
            got = K.top_k(df, df.filter("vec_id % 50 = 0"), stripe_bytes=stripe)
            assert as_set(got) == brute(table)
        import duckdb

        from tiergate.llm.queries import TOP_K_SQL

        with duckdb.connect() as db:
            db.register("embeddings", df.toPandas())
            assert Counter(db.execute(TOP_K_SQL).fetchall()) == brute(table)


def test_operator_on_a_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    assert as_set(K.top_k(df, df.filter("vec_id % 50 = 0"))) == brute([(r.vec_id, r.embedding) for r in df.collect()])
