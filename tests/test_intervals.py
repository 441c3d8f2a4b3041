"""Sums and rows of step functions over threshold grids, against every row at every threshold."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tiergate.fixtures import stored_run
from tiergate.operators import intervals as I
from tiergate.plans import cascade


def holds(low, high, t):
    return (low is None or t >= low) and (high is None or t < high)


def rows(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b = sorted((r.choice([0.0, 0.1, 0.25, 0.5, 0.500001, 1.0, r.random()]) for _ in range(2)))
        out.append((r.choice("ab") if i % 9 else None, i, None if i % 5 == 0 else a, None if i % 7 == 0 else b, r.randint(-5, 9)))
    return out


@pytest.mark.parametrize("block", [2, I.BLOCK])
def test_sums_and_rows(spark, block):
    data = rows(block)
    df = spark.createDataFrame(data, "k string, id long, low double, high double, v long")
    grid = [0.5, 0.0, 0.1, 0.1, 0.25, 0.7, 1.0, 2.0, -1.0]
    for thresholds in (grid, I.thresholds_table(spark, grid + [0.5]).unionByName(spark.createDataFrame([(None,)], "threshold double"))):
        got = {(r.k, r.threshold): (r.n, r.v) for r in I.sums_on_grid(df, ["k"], {"n": F.lit(1).cast("long"), "v": F.col("v")}, thresholds, block).collect()}
        want = defaultdict(lambda: [0, 0])
        for k, _, low, high, v in data:
            for t in set(grid):
                if holds(low, high, t):
                    want[k, t][0] += 1
                    want[k, t][1] += v
        assert got == {k: tuple(v) for k, v in want.items()}
        listed = Counter((r.id, r.threshold) for r in I.rows_on_grid(df, thresholds, block).collect())
        assert listed == Counter((i, t) for _, i, low, high, _ in data for t in set(grid) if holds(low, high, t))
    assert I.sums_on_grid(df, ["k"], {"v": F.col("v")}, []).count() == 0
    assert I.sums_on_grid(df.limit(0), ["k"], {"v": F.col("v")}, grid).count() == 0


def test_accept_intervals_are_the_loop(spark):
    """Scores that are missing, equal, falling or NaN; answers that are missing; thresholds on the scores themselves."""
    from tiergate import config as C

    r = random.Random(2)
    models = [t.model for t in C.CHAINS["flan"]]
    prompts = spark.createDataFrame([(i, f"p{i}", i % 2) for i in range(150)], "prompt_id long, prompt_text string, gold_class int")
    answered = {(i, t): r.random() < 0.85 for i in range(150) for t in (1, 2, 3)}
    score = {(i, t): r.choice([None, 0.2, 0.5, 0.5, 0.8, float("nan"), round(r.random(), 2)]) for i in range(150) for t in (1, 2, 3)}
    answers = spark.createDataFrame([(i, t, models[t - 1], "yes") for (i, t), said in answered.items() if said], "prompt_id long, tier int, model string, response string")
    scores = spark.createDataFrame([("strategy-1", i, t, s) for (i, t), s in score.items()], "strategy string, prompt_id long, tier int, score double")
    grid = [0.0, 0.2, 0.35, 0.5, 0.79, 0.8, 1.0]
    got = {(x.threshold, x.prompt_id): x.tier for x in cascade.sweep_final(prompts, answers, scores, "boolq", ("strategy-1",), grid).collect()}
    for t in grid:
        for i in range(150):
            above = [k for k in (1, 2) if answered[i, k] and score[i, k] is not None and (score[i, k] > t or score[i, k] != score[i, k])]
            assert got[t, i] == (above[0] if above else 3), (t, i)
    assert len(got) == len(grid) * 150


def test_rows_do_not_follow_the_grid(spark):
    run = stored_run(spark, SF_SMALL)
    n = run[0].count()
    steps = cascade.accept_intervals(*run)
    assert steps.count() <= 3 * 3 * n and steps.select("strategy", "prompt_id").distinct().count() == 3 * n
    fine = [i / 1000 for i in range(1000)]
    few = {(r.strategy, r.threshold): r for r in cascade.threshold_sweep(*run, thresholds=(0.6, 0.85)).collect()}
    many = {(r.strategy, r.threshold): r for r in cascade.threshold_sweep(*run, thresholds=fine).collect()}
    assert len(many) == 3000 and all(many[k] == r for k, r in few.items())
