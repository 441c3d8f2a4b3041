"""Seeded sampling and splits (P3-P5): repeatable, sized, and a function of (key, seed) only."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tiergate.operators import sampling as SM
from tiergate.sources import prompts as P


def test_sample_is_repeatable_and_seeded(spark):
    p = P.prompts(spark, SF_SMALL, "cnn_dm").select("prompt_id")
    a = sorted(r.prompt_id for r in SM.sample_n(p, 50).collect())
    b = sorted(r.prompt_id for r in SM.sample_n(p.repartition(5), 50).collect())
    c = sorted(r.prompt_id for r in SM.sample_n(p, 50, seed=7).collect())
    assert len(a) == 50 and a == b and a != c


def test_positional_split_counts(spark):
    p = P.prompts(spark, SF_SMALL, "cnn_dm").select("prompt_id")
    s = SM.split_positional(p, 60, 40)
    got = {r.split: r.n for r in s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"train": 40, "test": 20}
    assert sorted(r.sample_pos for r in s.collect()) == list(range(1, 61))


def test_hash_split_is_stable(spark):
    p = P.prompts(spark, SF_SMALL, "boolq").select("prompt_id")
    a = {r.prompt_id: r.split for r in SM.split_hash(p, 20).collect()}
    b = {r.prompt_id: r.split for r in SM.split_hash(p.repartition(3), 20).collect()}
    assert a == b and 0 < sum(v == "validation" for v in a.values()) < len(a)
