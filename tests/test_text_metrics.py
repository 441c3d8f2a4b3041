"""ROUGE and embedding match on tiny hand cases; ROUGE-L against a plain dynamic-programming LCS."""

import random

from conftest import SF_SMALL
from pyspark.sql import functions as F
from tiergate.operators import rouge as RG
from tiergate.operators.embed_match import embed_match_pairs
from tiergate.plans import text_eval as TE


def _pairs(spark, items):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(items)], "pair_id long, pred string, ref string")


def test_rouge_hand_cases(spark):
    items = [("the cat sat", "the cat sat"), ("a b", "c d"), ("the the the", "the cat"), ("", "some words")]
    per = {r.pair_id: r.f for r in RG.rouge_n_pairs(_pairs(spark, items), 1).collect()}
    assert per[0] == 1.0 and per[1] == 0.0 and per[3] == 0.0
    # clipped: overlap 1 (one 'the' in ref); P = 1/3, R = 1/2
    assert abs(per[2] - 2 * (1 / 3) * (1 / 2) / (1 / 3 + 1 / 2)) < 1e-12
    per2 = {r.pair_id: r.f for r in RG.rouge_n_pairs(_pairs(spark, items), 2).collect()}
    assert per2[0] == 1.0 and per2[1] == 0.0


def _lcs_dp(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_lcs_bit_parallel_matches_dp():
    rnd = random.Random(3)
    for _ in range(500):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        assert RG.lcs_length(a, b) == _lcs_dp(a, b)


def test_rouge_l_query_matches_brute_force(spark):
    """Against a brute-force run on the small fixture."""
    pairs = TE.conversation_pairs(spark, SF_SMALL)
    got = RG.rouge_l(pairs).first().rougeL
    import re

    def toks(s):
        return [t for t in re.sub("[^a-z0-9]+", " ", s.lower()).strip().split(" ") if t]

    fs = []
    for r in pairs.collect():
        p, q = toks(r.pred), toks(r.ref)
        lcs = _lcs_dp(p, q)
        pp = lcs / len(p) if p else 0.0
        rr = lcs / len(q) if q else 0.0
        fs.append(2 * pp * rr / (pp + rr) if pp + rr > 0 else 0.0)
    assert abs(got - sum(fs) / len(fs)) < 1e-8


def test_embed_match_identical_texts(spark):
    from tiergate.operators.embed_match import embed_match
    from tiergate.sources.tables import scan

    emb = scan(spark, SF_SMALL, "embeddings", "vec_id", "embedding")
    r = embed_match(_pairs(spark, [("alpha beta gamma", "gamma beta alpha"), ("", "x")]), emb).first()
    # pair 0 matches itself exactly (P = R = 1); pair 1 has an empty side (0)
    assert abs(r.emb_p - 0.5) < 1e-9 and abs(r.emb_r - 0.5) < 1e-9


def test_rouge_in_row_equals_exploded(spark):
    """The shuffle-free counting path and the relational explode/aggregate path agree on every pair."""
    pairs = TE.conversation_pairs(spark, SF_SMALL)
    for n in (1, 2):
        a = {r.pair_id: (r.overlap, r.n_pred, r.n_ref) for r in RG.rouge_n_pairs(pairs, n).collect()}
        b = {r.pair_id: (r.overlap, r.n_pred, r.n_ref) for r in RG.rouge_n_exploded(pairs, n).collect()}
        assert a == b


def test_embed_broadcast_equals_join_path(spark):
    from tiergate.operators.embed_match import embed_match
    from tiergate.sources.tables import scan

    pairs = TE.conversation_pairs(spark, SF_SMALL)
    emb = scan(spark, SF_SMALL, "embeddings", "vec_id", "embedding")
    sparse = emb.where("vec_id % 7 = 3")  # ids with gaps: tokens without a vector take no part, on either path
    for vectors in (emb, sparse):
        a = embed_match(pairs, vectors).first()
        b = embed_match(pairs, vectors, allow_broadcast=False).first()
        assert tuple(a) == tuple(b)
    assert a.no_vector > 0 and embed_match(pairs, emb).first().no_vector == 0
    # stripes of any size: pairs meet their vectors in many cells
    whole = {r.pair_id: (round(r.p, 9), round(r.r, 9), r.no_vector) for r in embed_match_pairs(pairs, sparse).collect()}
    for size in (512 * 3, 512 * 20):
        cut = embed_match_pairs(pairs, sparse, allow_broadcast=False, stripe_bytes=size)
        assert {r.pair_id: (round(r.p, 9), round(r.r, 9), r.no_vector) for r in cut.collect()} == whole


def test_token_embedder_plugin(spark):
    """A caller-supplied (token, embedding) table: identical texts match fully, orthogonal words score 0."""
    from tiergate.operators.embed_match import embed_match_pairs

    vecs = spark.createDataFrame(
        [("alpha", [1.0, 0.0]), ("beta", [0.0, 1.0]), ("gamma", [1.0, 1.0])], "token string, embedding array<float>"
    )
    pairs = _pairs(spark, [("alpha beta", "beta alpha"), ("alpha", "beta"), ("alpha alpha", "gamma")])
    got = {r.pair_id: (round(r.p, 9), round(r.r, 9)) for r in embed_match_pairs(pairs, None, token_vectors=vecs).collect()}
    assert got[0] == (1.0, 1.0)
    assert got[1] == (0.0, 0.0)
    assert got[2] == (round(2 ** -0.5, 9), round(2 ** -0.5, 9))


def test_unusable_vectors_on_both_plans(spark):
    """Null, ragged, empty, NaN and infinite vectors are as if absent, whichever plan runs; so is a table without any."""
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    bad = [(3, [9.0, 9.0, 9.0]), (40, None), (41, [1.0, 2.0]), (42, []), (43, [1.0, None, 2.0]), (44, [nan, 1.0, 1.0]), (45, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (46, [1.0, 2.0, 3.0, 4.0])]
    pairs = spark.createDataFrame([(1, "a b c d e f g h", "h g x y z a"), (2, "", "x"), (3, "one two three", "one two three")], "pair_id long, pred string, ref string")
    for table in (rows + bad, bad[1:8], []):
        vectors = spark.createDataFrame(table, "vec_id long, embedding array<float>")
        got = [{r.pair_id: (round(r.p, 9), round(r.r, 9), r.no_vector) for r in embed_match_pairs(pairs, vectors, allow_broadcast=wide).collect()} for wide in (True, False)]
        assert got[0] == got[1], table
    tokens = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("x", [1.0]), ("h", [0.0, 1.0])], "token string, embedding array<float>")
    found = {r.pair_id: r.no_vector for r in embed_match_pairs(pairs, None, token_vectors=tokens).collect()}
    assert found[1] == 6 + 4  # only a and h have a vector of the usual width


def test_large_vector_tables_shuffle_no_words(spark, monkeypatch):
    """Over the broadcast limit every number of a pair still comes from one pass over its texts: keys, counts and vectors are not
    dealt out by pair, and a slice whose words name more vectors than a task may hold is cut."""
    from tiergate.operators import embed_match as E

    rows = [(i, [float(i % 5 - 2), 1.0, float(i % 3), 0.5 * (i % 2)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    text = lambda k, n: " ".join(f"w{(k * 7 + j * j) % 200}" for j in range(n))
    pairs = _pairs(spark, [(text(i, 20 + i % 9), text(i + 1, 15)) for i in range(40)] + [(None, "a"), ("", "")]).withColumn("model", F.lit("m"))
    want = {r.pair_id: tuple(r) for r in TE.pair_scores(pairs, vectors, ["model"]).collect()}
    monkeypatch.setattr(E, "BROADCAST_LIMIT_BYTES", 0)
    got = TE.pair_scores(pairs, vectors, ["model"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.pair_id: tuple(r) for r in got.collect()} == want


def test_vectors_of_a_slice(spark, monkeypatch):
    """Vectors come from the files that hold them, in whatever order and size; a slice is cut to what may be held; pairs of many
    words are multiplied in parts."""
    import numpy as np
    import pyarrow as pa
    from tiergate.operators import embed_match as E

    table = np.random.default_rng(1).normal(size=(500, 8))
    rows = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(table)], "key long, embedding array<double>").repartition(7, "key")
    whole, cut = E.vector_files(rows, 8, 1500), E.vector_files(rows, 8, 1500, 64 * 10)
    assert len(cut.files) > len(whole.files) and sum(n for _, n in cut.files) == 500
    unit = table / np.linalg.norm(table, axis=1)[:, None]
    for keys in (np.arange(1500), np.array([1497, 4, 0, 0, 3]), np.array([7]), np.arange(0, 1500, 300)):
        for files in (whole, cut):
            known, u = files.of(keys)
            assert known.tolist() == sorted({k for k in keys.tolist() if k % 3 == 0})
            assert len(known) == 0 or np.allclose(u, unit[known // 3])
    texts = [pa.array([" ".join(f"w{j}" for j in range(k, k + 30)) for k in range(s, s + 16)]) for s in (0, 5)]
    parts = list(E._in_reach(tuple(texts), cut))
    assert len(parts) == 1
    numbers = lambda words, sides: E.matches_of(cut.keys_of(words), *sides, cut.of(cut.keys_of(words)))
    want = numbers(*parts[0])
    monkeypatch.setattr(E, "FETCH_BYTES", 40 * 8 * 8)
    monkeypatch.setattr(E, "COSINES", 50)
    parts = [numbers(words, sides) for words, sides in E._in_reach(tuple(texts), cut)]
    assert len(parts) == 4
    for name, values in want.items():
        assert np.allclose(np.concatenate([p[name] for p in parts]), values)


def test_text_cascade_over_the_broadcast_limit(spark, monkeypatch):
    """A table of vectors in files gives the numbers of a broadcast one; texts of prompts are not sent to their answers."""
    from tiergate import fixtures as FX
    from tiergate.operators import embed_match as E
    from tiergate.sources.tables import scan

    run = FX.stored_text_run(spark, SF_SMALL, "strategy-9")
    emb = scan(spark, SF_SMALL, "embeddings", "vec_id", "embedding")
    want = sorted(map(tuple, TE.cascade_text(*run, emb).collect()))
    monkeypatch.setattr(E, "BROADCAST_LIMIT_BYTES", 0)
    assert sorted(map(tuple, TE.cascade_text(*run, emb).collect())) == want
    prompts = spark.createDataFrame([(1, "say b", "b"), (2, None, "c")], "prompt_id long, prompt_text string, gold_text string")
    answers = spark.createDataFrame([(1, 1, "Phi", "say bB"), (1, 2, "flan", "B"), (2, 1, "Phi", "c"), (2, 2, "flan", "c")], "prompt_id long, tier int, model string, response string")
    pairs = TE.answer_pairs(prompts, answers)
    assert {(r.prompt_id, r.tier): (r.pred, r.ref) for r in pairs.collect()} == {(1, 1): ("b", "b"), (1, 2): ("b", "b"), (2, 1): (None, "c"), (2, 2): ("c", "c")}
    assert "length(prompt_text" in pairs._jdf.queryExecution().optimizedPlan().toString().partition("Join")[2]
