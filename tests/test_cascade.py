"""Cascade properties: C1 = C2, gate partitions the rows, threshold 1 sends all to the last tier,
results do not depend on the number of partitions, and a model is asked once for each row."""

import random

from conftest import SF_MID, SF_SMALL
from pyspark.sql import functions as F

from tiergate import config as C
from tiergate.fixtures import stored_run, stub_pandas_model
from tiergate.operators import gate as G
from tiergate.plans import cascade


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _sequential(run, strategy, threshold, answer_fn=None):
    prompts, answers, scores = run
    return cascade.sequential_final(prompts, strategy, threshold, answer_fn or cascade.from_answers(answers), cascade.from_scores(scores, strategy))


def test_sequential_equals_one_pass(spark):
    run = stored_run(spark, SF_MID)
    for strategy in ("strategy-1", "strategy-9"):
        seq = _sequential(run, strategy, 0.8).drop("n_tiers")
        one = cascade.sweep_final(*run, "boolq", (strategy,), (0.8,)).drop("n_tiers", "chars")
        assert _rows(seq) == _rows(one)


def test_grids_by_hand():
    """The published grids, stated here a second time: the oracle shares the constants of the code."""
    assert C.THRESHOLDS_BOOLQ == (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
    assert C.THRESHOLDS_SAMSUM == (0.6, 0.65, 0.7, 0.75, 0.8, 0.85)
    assert C.THRESHOLDS_MNLI == (0.9, 0.95)
    rates = {name: (lr, epochs) for name, lr, epochs, *_ in C.STRATEGY_GRID}
    assert rates["strategy-1"] == (1e-5, 10) and rates["strategy-4"] == (4e-4, 10) and rates["single-scorer-strategy-4"] == (4e-5, 10)
    assert [(r[1], r[2], r[5]) for r in C.STRATEGY_GRID_SAMSUM] == [
        (4e-5, 8, "bigbird-roberta-base"), (8e-5, 8, "bigbird-roberta-base"), (4e-5, 8, "longformer-base-4096"), (8e-5, 8, "longformer-base-4096"),
    ]
    assert [r[1] for r in C.STRATEGY_GRID_MNLI] == [1e-5, 2e-5, 5e-5, 1e-4]
    assert C.VALIDATION_PCT == {"boolq": 20, "samsum": 20, "mnli": 60}


def test_model_that_does_not_repeat_itself(spark):
    """Every prompt comes out once, with the answer of one call per row and tier; unanswered prompts escalate."""
    prompts, _, scores = stored_run(spark, SF_SMALL)
    prompts = prompts.where("prompt_id is not null")
    calls = spark.sparkContext.accumulator(0)

    def answer_fn(remaining, tier):
        def ask(batches):
            pick = random.Random()
            for rows in batches:
                calls.add(len(rows))
                rows = rows[rows["prompt_id"] % 7 != 0] if tier.tier == 1 else rows
                yield rows.assign(response=[p * tier.echoes + pick.choice(["True", "False"]) for p in rows["prompt_text"]])[["prompt_id", "response"]]

        return remaining.select("prompt_id", "prompt_text").mapInPandas(ask, "prompt_id long, response string")

    final = cascade.sequential_final(prompts, "strategy-9", 0.5, answer_fn, cascade.from_scores(scores, "strategy-9"))
    got = final.collect()
    assert final.collect() is not got and sorted(map(tuple, final.collect())) == sorted(map(tuple, got))
    ids = [r.prompt_id for r in prompts.collect()]
    assert sorted(r.prompt_id for r in got) == sorted(ids)
    assert all(r.tier > 1 for r in got if r.prompt_id % 7 == 0)
    asked = sum(r.tier for r in got)  # a prompt accepted at tier k was put to k models
    assert calls.value == asked


def test_missing_answers_and_scores(spark):
    prompts = spark.createDataFrame([(i, f"p{i}", 1) for i in range(4)], "prompt_id long, prompt_text string, gold_class int")
    models = [t.model for t in C.CHAINS["flan"]]
    answers = spark.createDataFrame(
        [(0, 1, models[0], "yes"), (1, 2, models[1], "yes"), (2, 1, models[0], "no"), (2, 3, models[2], "yes")], "prompt_id long, tier int, model string, response string"
    )
    scores = spark.createDataFrame([("strategy-1", i, t, 0.9) for i in (0, 1) for t in (1, 2)], "strategy string, prompt_id long, tier int, score double")
    one = cascade.sweep_final(prompts, answers, scores, "boolq", ("strategy-1",), (0.8,))
    assert {r.prompt_id: (r.tier, r.pred) for r in one.collect()} == {0: (1, 1), 1: (2, 1), 2: (3, 1), 3: (3, None)}
    assert _rows(_sequential((prompts, answers, scores), "strategy-1", 0.8).drop("n_tiers")) == _rows(one.drop("n_tiers", "chars"))
    r = cascade.threshold_sweep(prompts, answers, scores, "boolq", ("strategy-1",), (0.8,)).first()
    assert (r.n, r.unlabelled) == (3, 1)


def test_cost_of_longer_chains():
    rates = [cascade.model_rate(t) for t in range(1, 7)]
    assert rates[:3] == [0.010, 0.030, 0.080] and all(a < b for a, b in zip(rates, rates[1:]))


def test_fitted_scorer_drives_the_gate(spark):
    """Scores of a trained pipeline gate both forms of the cascade alike."""
    from tiergate.plans import scorer as SC

    prompts, answers, _ = stored_run(spark, SF_SMALL)
    rows = SC.training_rows(prompts, answers, chains=("flan",))
    model, _ = SC.fit_best(rows, [(0.01, 5)])
    labelled = cascade.labelled_answers(prompts, answers, "boolq", cascade.chain_models("flan"))
    scores = SC.scores_table(model, labelled, "strategy-1")
    one = cascade.sweep_final(prompts, answers, scores, "boolq", ("strategy-1",), (0.5, 0.85))
    assert one.count() == 2 * prompts.count()
    for t in (0.5, 0.85):
        seq = cascade.sequential_final(prompts, "strategy-1", t, cascade.from_answers(answers), SC.as_score_fn(model))
        a, b = ({r.prompt_id: (r.tier, r.pred) for r in df.collect()} for df in (seq, one.where(F.col("threshold") == t)))
        assert a == b and len(set(x[0] for x in a.values())) >= 1


def test_gate_split_is_a_partition(spark):
    s = cascade.scored_long(*stored_run(spark, SF_SMALL), "boolq", ("strategy-1",))
    s = s.unionByName(s.limit(1).withColumn("score", F.lit(None).cast("double")).withColumn("prompt_id", F.lit(-1).cast("bigint")))
    acc, esc = G.gate_split(s, 0.75)
    assert acc.count() + esc.count() == s.count()
    assert acc.join(esc, ["strategy", "prompt_id", "tier"]).count() == 0
    assert esc.where(F.col("prompt_id") == -1).count() == 1  # null score escalates


def test_exact_threshold_escalates(spark):
    df = spark.createDataFrame([(1, 0.8), (2, 0.8000001), (3, None)], "prompt_id long, score double")
    acc, esc = G.gate_split(df, 0.8)
    assert [r.prompt_id for r in acc.collect()] == [2]
    assert sorted(r.prompt_id for r in esc.collect()) == [1, 3]


def test_threshold_one_sends_everything_to_last_tier(spark):
    final = cascade.sweep_final(*stored_run(spark, SF_SMALL), "boolq", ("strategy-1",), (1.0,))
    tiers = {r.tier for r in final.select("tier").distinct().collect()}
    assert tiers == {3}
    n = stored_run(spark, SF_SMALL)[0].count()
    assert final.count() == n


def test_sweep_independent_of_partitions(spark):
    a = _rows(cascade.threshold_sweep(*stored_run(spark, SF_SMALL)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = _rows(cascade.threshold_sweep(*stored_run(spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_sweep_matches_python_loop(spark):
    """The reference's loop, in plain Python, over the same stub answers and scores."""
    s = cascade.scored_long(*stored_run(spark, SF_SMALL), "boolq", ("strategy-2",)).collect()
    by_prompt = {}
    for r in s:
        by_prompt.setdefault(r.prompt_id, {})[r.tier] = r
    for t in C.THRESHOLDS_BOOLQ:
        gold, pred = [], []
        for tiers in by_prompt.values():
            for k in sorted(tiers):
                r = tiers[k]
                if k == 3 or (r.score is not None and r.score > t):
                    gold.append(r.gold)
                    pred.append(r.pred)
                    break
        labels = sorted(set(gold) | set(pred))
        f1 = sum(
            2 * sum(1 for g, p in zip(gold, pred) if g == p == lab) / (gold.count(lab) + pred.count(lab)) for lab in labels
        ) / len(labels)
        got = cascade.threshold_sweep(*stored_run(spark, SF_SMALL), "boolq", ("strategy-2",), (t,)).first().m_f1
        assert abs(got - f1) < 1e-8


def test_tier_accounting_adds_up(spark):
    acc = cascade.tier_accounting(cascade.sweep_cells(*stored_run(spark, SF_SMALL))).collect()
    n = stored_run(spark, SF_SMALL)[0].count()
    for r in acc:
        assert r.completed + r.remaining == n


def test_pandas_responder_in_the_cascade(spark):
    """C1 through the mapInPandas plug-in (model built once per task), with the model's batches per data set."""
    from tiergate.operators.batching import batch_plan
    from tiergate.plans import responders as RS

    prompts, _, scores = stored_run(spark, SF_SMALL)

    def answer_fn(remaining, tier):
        plan = batch_plan(remaining.withColumn("dataset", F.lit("boolq")), 4, keep=("prompt_text",))
        return RS.pandas_responder(plan, tier, lambda: stub_pandas_model("boolq", tier), ("dataset",)).select("prompt_id", "response")

    got = cascade.sequential_final(prompts, "strategy-9", 0.7, answer_fn, cascade.from_scores(scores, "strategy-9"))
    assert sorted(r.prompt_id for r in got.collect()) == sorted(r.prompt_id for r in prompts.collect())


def test_responder_keeps_data_sets_apart(spark):
    """Equal batch ids of two data sets are two batches, and a model sees neither gold nor other columns."""
    from tiergate.operators.batching import batch_plan
    from tiergate.plans import responders as RS

    rows = [(i, ds, f"prompt {i}", 1) for ds in ("a", "b") for i in range(10)]
    df = spark.createDataFrame(rows, "prompt_id long, dataset string, prompt_text string, gold_class int")
    plan = batch_plan(df, 4, keep=("prompt_text", "gold_class"))

    def model():
        def generate(batch):
            return batch["prompt_id"].map(lambda _: f"{len(batch)}|{','.join(sorted(batch.columns))}")

        return generate

    out = RS.pandas_responder(plan, C.CHAINS["flan"][0], model, ("dataset",)).collect()
    assert len(out) == 20 and {r.response for r in out} == {f"{n}|batch_id,dataset,prompt_id,prompt_text" for n in (4, 2)}
