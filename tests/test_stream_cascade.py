"""The streamed cascade equals the batch cascade: any order, repeats, late and missing rows, and a restart."""

import datetime as dt
import random

import pytest

from tiergate import config as C
from tiergate.plans import cascade
from tiergate.streaming import cascade as SC

N, T0 = 60, dt.datetime(2024, 1, 1)
MODELS = [t.model for t in C.CHAINS["flan"]]


def run(spark, seed=3):
    r = random.Random(seed)
    prompts = spark.createDataFrame([(i, f"p{i}", i % 2) for i in range(N)], "prompt_id long, prompt_text string, gold_class int")
    answers = [(i, t, MODELS[t - 1], r.choice(["yes", "no"])) for i in range(N) for t in (1, 2, 3) if r.random() < 0.8]
    scores = [("strategy-1", i, t, r.choice([None, 0.5, 0.8, 0.81, r.random()])) for i in range(N) for t in (1, 2, 3) if r.random() < 0.85]
    a = spark.createDataFrame(answers, "prompt_id long, tier int, model string, response string")
    s = spark.createDataFrame(scores, "strategy string, prompt_id long, tier int, score double")
    want = {x.prompt_id: (x.tier, x.pred, None if x.tier == 3 else x.score) for x in cascade.sweep_final(prompts, a, s, "boolq", ("strategy-1",), (0.8,)).collect()}
    when = lambda: T0 + dt.timedelta(minutes=r.randint(0, 50))
    a_rows = [(i, m, f"p{i}", text, when()) for i, _, m, text in answers]
    s_rows = [(*x, when()) for x in scores]
    # copies that say something else, later than the first
    a_rows += [(i, m, p, "no" if text == "yes" else "yes", T0 + dt.timedelta(minutes=55)) for i, m, p, text, _ in a_rows if i % 4 == 0]
    s_rows += [(st, i, t, 0.99, T0 + dt.timedelta(minutes=55)) for st, i, t, _, _ in s_rows if i % 5 == 0]
    return a_rows, s_rows, want


def arrive(spark, folder, name, a_rows, s_rows):
    spark.createDataFrame(a_rows, SC.ANSWERS).coalesce(1).write.mode("append").parquet(f"{folder}/answers/{name}")
    spark.createDataFrame(s_rows, SC.SCORES).coalesce(1).write.mode("append").parquet(f"{folder}/scores/{name}")


def tick(hours):
    """A heartbeat: a row of no prompt and model that moves the watermark."""
    return [(None, None, None, None, T0 + dt.timedelta(hours=hours))], [("strategy-1", None, None, None, T0 + dt.timedelta(hours=hours))]


@pytest.mark.parametrize("restart", [False, True])
def test_stream_equals_batch(spark, tmp_path, restart):
    a_rows, s_rows, want = run(spark)
    first = lambda rows, k: [x for x in rows if x[-1] < T0 + dt.timedelta(minutes=51) and hash((x[0], x[1], x[2])) % 2 == k]
    rest = lambda rows: [x for x in rows if x[-1] >= T0 + dt.timedelta(minutes=51)]
    out, ckpt, src = str(tmp_path / "out"), str(tmp_path / "ckpt"), str(tmp_path)
    drain = lambda: SC.stream_cascade(spark, f"{src}/answers/*", f"{src}/scores/*", out, ckpt, 0.8, "boolq", ("strategy-1",), "2 hours", 3, 1)
    steps = [(first(a_rows, 1), first(s_rows, 0)), (first(a_rows, 0), first(s_rows, 1)), (rest(a_rows), rest(s_rows)), tick(8), tick(16), tick(24)]
    for i, (a, s) in enumerate(steps):
        arrive(spark, src, f"{i}", a, s)
        if restart:
            drain()
    got = drain().collect()
    assert len(got) == len({r.prompt_id for r in got}) == N
    assert {r.prompt_id: (r.tier, r.pred, r.score) for r in got} == want
    assert any(r.waited for r in got)


def test_rows_behind_the_watermark_and_forgotten_prompts(spark, tmp_path):
    out, ckpt, src = str(tmp_path / "out"), str(tmp_path / "ckpt"), str(tmp_path)
    drain = lambda: {r.prompt_id: r.tier for r in SC.stream_cascade(spark, f"{src}/answers/*", f"{src}/scores/*", out, ckpt, 0.8, "boolq", ("strategy-1",), "1 hour", 2).collect()}
    at = lambda h: T0 + dt.timedelta(hours=h)
    arrive(spark, src, "0", [(1, MODELS[0], "p", "yes", at(0)), (2, MODELS[0], "p", "yes", at(0))], [("strategy-1", 1, 1, 0.9, at(0))])
    assert drain() == {1: 1}  # prompt 2 waits for its score
    arrive(spark, src, "1", *tick(6))
    drain()
    arrive(spark, src, "2", [(2, MODELS[1], "p", "yes", at(6))], [("strategy-1", 2, 1, 0.9, at(0)), ("strategy-1", 2, 2, 0.95, at(6))])
    assert drain() == {1: 1, 2: 2}  # the late score of tier 1 no longer counts


def test_prompts_share_their_state(spark, tmp_path, monkeypatch):
    """Any number of buckets gives the same rows, and a bucket with many prompts is one call, not one a prompt."""
    a_rows, s_rows, want = run(spark, 5)
    arrive(spark, str(tmp_path), "0", [x for x in a_rows if x[-1] < T0 + dt.timedelta(minutes=51)], [x for x in s_rows if x[-1] < T0 + dt.timedelta(minutes=51)])
    got = {}
    for n in (1, 7):
        out, ckpt = str(tmp_path / f"out{n}"), str(tmp_path / f"ckpt{n}")
        rows = SC.stream_cascade(spark, f"{tmp_path}/answers/*", f"{tmp_path}/scores/*", out, ckpt, 0.8, "boolq", ("strategy-1",), "2 hours", 3, buckets=n).collect()
        got[n] = {(r.prompt_id, r.tier, r.pred, r.score) for r in rows}
        assert len(rows) == len(got[n])
    assert got[1] == got[7] and got[1] <= {(k, *v) for k, v in want.items()} and len(got[1]) > N / 4
