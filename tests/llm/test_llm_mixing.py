"""Source mixing: targets, permutations, draws, counts and the mixed documents."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import awkward, empty
from conftest import SF_MID, SF_SMALL
from pyspark.sql import functions as F

from tiergate.llm import source_mixing as X


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes):
    """Share by weight, stop at three times the size, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, capped = dict.fromkeys(order, 0.0), set()
    excess = float(sum(sizes.values()))
    while excess > 1e-9 and len(capped) < len(order):
        free = [s for s in order if s not in capped]
        total, more = sum(weight[s] for s in free), 0.0
        for s in free:
            target[s] += excess * weight[s] / total
        for s in free:
            if target[s] > 3 * sizes[s]:
                more += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                capped.add(s)
        excess = more
    return target


def test_targets():
    r = np.random.default_rng(0)
    for _ in range(200):
        sizes = {f"s{i}": int(x) for i, x in enumerate(r.integers(0, 1000, r.integers(1, 12)) ** 2 // 50)}
        sizes[None] = int(r.integers(0, 50))
        got = X.target_sizes(sizes, X.cyclic_weights(list(sizes)))
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in sizes)
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert X.cyclic_weights(["b", None, "a", "é", "Z"]) == {"Z": 1, "a": 2, "b": 3, "é": 1, None: 2}


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        p = X.BlockPermutation(n, 5)(np.arange(n))
        assert sorted(p.tolist()) == list(range(n))
    a, b = (X.BlockPermutation(1000, k)(np.arange(1000)) for k in (1, 2))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.2


def test_draws_meet_quotas(spark):
    sources = [{"num": i, "quota": q, "blocks": max(1, q // 2)} for i, q in enumerate([0, 5, 900, 40_000, 1])]
    draws = X.shard_draws(spark, sources)
    slots = defaultdict(list)
    for r in draws.collect():
        slots[r.num] += range(r.first, r.first + r.slots)
    assert {n: sorted(k) for n, k in slots.items()} == {s["num"]: list(range(s["quota"])) for s in sources if s["quota"]}
    taken = Counter((r.num, r.block) for r in X.slot_blocks(draws, sources).collect())
    for s in sources:
        own = [taken[s["num"], b] for b in range(s["blocks"])]
        assert sum(own) == s["quota"] and max(own) - min(own) <= 1


def test_word_counts(spark):
    texts = ["", " ", "a", " a  b\n", "\x0b a\x0c\r", "é😀 x", None, "\x85\xa0 a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(X.n_words(df.text)).collect()] == [len(words(t)) for t in texts]


def check(docs, block_words=X.BLOCK_WORDS):
    got = X.mix_counts(docs, block_words=block_words).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = plain_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(words(r.text))) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by_source = defaultdict(int)
    source_of = {(r.doc_id, len(words(r.text))): r.source for r in rows}
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        by_source[s] += r.taken
    for s in sizes:
        assert abs(by_source[s] - want[s]) <= 2.5 * block_words, (s, by_source[s], want[s])
    return sorted(map(tuple, got), key=repr)


def test_counts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert check(docs) == check(docs.repartition(5)) != check(docs, 16)
    check(awkward(spark))
    assert X.mix_counts(empty(spark)).count() == 0


def test_mixed_documents(spark):
    docs = awkward(spark).unionByName(spark.read.parquet(f"{SF_MID}/documents.parquet").limit(200).selectExpr("*", *(f"'x' AS {c}" for c in awkward(spark).columns[5:])))
    mix = X.mix_documents(docs, block_words=16)
    assert mix.columns == docs.columns
    counts = X.mix_counts(docs, block_words=16)
    per = lambda df, n: {r[0]: r[1] for r in df.groupBy("doc_id").agg(F.sum(n)).collect() if r[1]}
    assert per(mix.withColumn("n", X.n_words(F.col("text"))), "n") == per(counts, "taken")
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    whole = 0
    for r in mix.collect():
        if r.text in texts[r.doc_id]:
            whole += 1
        else:  # runs of words of the document, in order
            own = next(words(t) for t in texts[r.doc_id] if set(words(r.text)) <= set(words(t)))
            it = iter(own)
            assert all(w in it for w in words(r.text))
    assert whole > 20
    assert X.mix_documents(empty(spark)).count() == 0


def test_blocks_are_never_broadcast(spark):
    """A few rows of draws unfold to every slot of the mix; Spark's estimate of them is far too small to broadcast by."""
    docs = spark.createDataFrame([(i, "word " * 50, "en", f"src{i % 3}", 250) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    for mix in (X.mix_counts(docs), X.mix_documents(docs)):
        mix.collect()
        joins = re.findall(r"\w+Join \[num#\d+L?, block#.*", mix._jdf.queryExecution().executedPlan().toString())
        assert joins and all(j.startswith("SortMergeJoin") for j in joins), joins
