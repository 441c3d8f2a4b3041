"""Cascade jobs.

A cascade runs over tables:

* ``prompts(prompt_id, prompt_text, gold_class)``,
* ``answers(prompt_id, tier, model, response)``: what each model of a chain said,
* ``scores(strategy, prompt_id, tier, score)``: what each strategy's scorer thought of it.

Two ways to run it:

* One pass (C2): answers and scores of a prompt meet once, in one row with a step per tier of every strategy's chain.
  The accepting tier - the first whose score is strictly above the threshold, else the last - is a step function of the
  threshold: tier i accepts from the largest score before it up to its own. ``accept_intervals`` gives these steps, at
  most one per tier and prompt; ``sweep_cells`` sums them over a table of thresholds of any size (``operators.intervals``),
  and ``sweep_final`` lists the accepted rows per threshold where rows are wanted. Texts are shuffled once, to meet their
  prompt; from there on rows are narrow. This is the default for threshold grids.
* ``sequential_final`` (C1): the studied loop over the (at most a handful of) tiers; each tier answers only what is
  still left. Every tier's labels and scores are written once, and both sides of its gate read that table: a model
  is asked once for each row. Use it for one threshold with costly models.

Both give the same accepted rows (tests check C1 = C2). A prompt that a model did not answer, or without a score,
escalates; at the last tier it is accepted without a label, and the metrics count such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.rules import CASCADE_RULES as RULES
from ..functions.text import strip_echo
from ..operators.gate import accepted_condition
from ..operators.intervals import rows_on_grid, sums_on_grid
from ..operators.metrics import macro_prf, macro_prf_from_cells
from ..session import staged

# Our cost model (C7): Wh per 1,000 prompt characters for one model call, by tier, and for one scorer call. Each tier
# past the listed ones costs ``MODEL_WH_GROWTH`` times the one before it.
MODEL_WH_PER_KCHAR = {1: 0.010, 2: 0.030, 3: 0.080}
MODEL_WH_GROWTH = 3.0
SCORER_WH_PER_KCHAR = 0.002


def model_rate(tier: int) -> float:
    """Wh per 1,000 characters of a call of tier ``tier``."""
    last = max(MODEL_WH_PER_KCHAR)
    return MODEL_WH_PER_KCHAR[tier] if tier <= last else MODEL_WH_PER_KCHAR[last] * MODEL_WH_GROWTH ** (tier - last)


def strategies_array(strategies: Sequence[str]) -> Column:
    """array<struct<strategy, tiers array<struct<tier, model>>>>, a handful of entries."""
    items = []
    for s in strategies:
        tiers = F.array(*[F.struct(F.lit(t.tier).alias("tier"), F.lit(t.model).alias("model")) for t in C.CHAINS[C.STRATEGIES[s]]])
        items.append(F.struct(F.lit(s).alias("strategy"), tiers.alias("tiers")))
    return F.array(*items)


def _longest(strategies: Sequence[str]) -> int:
    return max(len(C.CHAINS[C.STRATEGIES[s]]) for s in strategies)


def labelled_answers(prompts: DataFrame, answers: DataFrame, dataset: str = "boolq", models: Sequence[str] | None = None) -> DataFrame:
    """J1 + J2: (prompt_id, tier, model, gold, prompt_text, response, answer, pred) - answers meet their prompts on ``prompt_id``;
    echo stripped, rule applied. ``models``: only these models' answers."""
    wanted = answers if models is None else answers.where(F.col("model").isin(list(models)))
    rows = wanted.select("prompt_id", "tier", "model", "response").join(prompts.select("prompt_id", "gold_class", "prompt_text"), "prompt_id")
    answer = strip_echo("response", "prompt_text", "model")
    rows = rows.select("prompt_id", "tier", "model", F.col("gold_class").alias("gold"), "prompt_text", "response", answer.alias("answer"))
    return rows.withColumn("pred", RULES[dataset](F.col("answer"), F.col("model")))


def chain_models(*chains: str) -> list[str]:
    return [t.model for ch in chains for t in C.CHAINS[ch]]


def scored_steps(prompts: DataFrame, answers: DataFrame, scores: DataFrame, dataset: str, strategies: Sequence[str]) -> DataFrame:
    """(strategy, prompt_id, gold, chars, steps): one row per strategy and prompt; ``steps`` holds tier, model, pred,
    score and whether there is an answer, in chain order. All sides meet on ``prompt_id``."""
    models = sorted({t.model for s in strategies for t in C.CHAINS[C.STRATEGIES[s]]})
    labels = labelled_answers(prompts, answers, dataset, models).select("prompt_id", "model", "pred")
    per_model = labels.groupBy("prompt_id").agg(F.collect_list(F.struct("model", "pred")).alias("preds"))
    wanted = scores.where(F.col("strategy").isin(list(strategies)))
    per_score = wanted.groupBy("prompt_id").agg(F.collect_list(F.struct("strategy", "tier", "score")).alias("scores"))
    base = prompts.select("prompt_id", F.col("gold_class").alias("gold"), F.length("prompt_text").cast("long").alias("chars"))
    rows = base.join(per_model, "prompt_id", "left").join(per_score, "prompt_id", "left")
    rows = rows.select("*", F.explode(strategies_array(strategies)).alias("s"))

    def step(t: Column) -> Column:
        said = F.filter("preds", lambda p: p["model"] == t["model"])
        score = F.filter("scores", lambda x: (x["strategy"] == F.col("s.strategy")) & (x["tier"] == t["tier"]))
        return F.struct(
            t["tier"].alias("tier"), t["model"].alias("model"), F.get(said, F.lit(0))["pred"].alias("pred"),
            F.get(score, F.lit(0))["score"].alias("score"), F.coalesce(F.size(said) > 0, F.lit(False)).alias("answered"),
        )

    return rows.select(F.col("s.strategy").alias("strategy"), "prompt_id", "gold", "chars", F.transform("s.tiers", step).alias("steps"))


Thresholds = Sequence[float] | DataFrame


def accept_intervals(
    prompts: DataFrame, answers: DataFrame, scores: DataFrame, dataset: str = "boolq", strategies: Sequence[str] = tuple(C.STRATEGIES),
) -> DataFrame:
    """(strategy, prompt_id, gold, chars, n_tiers, tier, model, pred, score, low, high): the tier accepts the prompt at the
    thresholds low <= t < high; null is an open end. The intervals of a prompt do not overlap and cover every threshold.

    Only answered steps with a score can accept before the last tier; the last one accepts what is left.
    """
    rows = scored_steps(prompts, answers, scores, dataset, strategies)
    steps = accept_steps("steps", ("tier", "model", "pred", "score"))
    rows = rows.select("strategy", "prompt_id", "gold", "chars", F.size("steps").alias("n_tiers"), F.explode(steps).alias("a"))
    return rows.select("strategy", "prompt_id", "gold", "chars", "n_tiers", *(F.col(f"a.{c}").alias(c) for c in ("tier", "model", "pred", "score", "low", "high")))


def accept_steps(steps: str, fields: Sequence[str]) -> Column:
    """The steps of a chain (array column of structs with ``score``, ``answered`` and ``fields``) that accept at some
    threshold: array<struct<fields..., low, high>>."""
    n = F.size(steps)
    offered = lambda x: F.when(x["answered"], x["score"])

    def interval(x: Column, i: Column) -> Column:
        last = i == n - 1
        low = F.array_max(F.transform(F.slice(F.col(steps), 1, i), offered))
        high = F.when(~last, offered(x))
        holds = F.when(last, ~F.coalesce(F.isnan(low), F.lit(False))).otherwise(high.isNotNull() & (low.isNull() | (high > low)))
        end = F.when(~F.isnan(high), high)  # NaN is above every threshold, as in a comparison
        return F.struct(*(x[c].alias(c) for c in fields), low.alias("low"), end.alias("high"), holds.alias("holds"))

    return F.filter(F.transform(steps, interval), lambda x: x["holds"])


def sweep_final(
    prompts: DataFrame, answers: DataFrame, scores: DataFrame, dataset: str = "boolq",
    strategies: Sequence[str] = tuple(C.STRATEGIES), thresholds: Thresholds = C.THRESHOLDS_BOOLQ,
) -> DataFrame:
    """Accepted row per (strategy, threshold, prompt): tier, model, gold, pred, score (C2 + W3 + J6)."""
    rows = rows_on_grid(accept_intervals(prompts, answers, scores, dataset, strategies), thresholds)
    return rows.select("strategy", "threshold", "prompt_id", "tier", "model", "gold", "pred", "score", "n_tiers", "chars")


def sweep_cells(
    prompts: DataFrame, answers: DataFrame, scores: DataFrame, dataset: str = "boolq",
    strategies: Sequence[str] = tuple(C.STRATEGIES), thresholds: Thresholds = C.THRESHOLDS_BOOLQ,
) -> DataFrame:
    """(strategy, threshold, n_tiers, tier, _g, _p, _n, _chars): accepted prompts and their characters by tier, gold and
    predicted label, for a table of thresholds. Neither rows nor time follow the number of thresholds, only the result."""
    intervals = accept_intervals(prompts, answers, scores, dataset, strategies).withColumnsRenamed({"gold": "_g", "pred": "_p"})
    keys = ["strategy", "n_tiers", "tier", "_g", "_p"]
    return sums_on_grid(intervals, keys, {"_n": F.lit(1).cast("long"), "_chars": F.col("chars")}, thresholds)


def cells_of(final: DataFrame) -> DataFrame:
    """The cells of ``sweep_cells`` from accepted rows (those of a sequential cascade, with ``chars``)."""
    keys = ["strategy", "threshold", "n_tiers", "tier", F.col("gold").alias("_g"), F.col("pred").alias("_p")]
    return final.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("chars").alias("_chars"))


def prompt_cost(tier: Column, n_tiers: Column, kchar: Column, longest: int) -> Column:
    """C7 for one accepted row: model calls on tiers 1..tier, scorer calls on tiers below the last, x prompt size."""
    total = F.lit(0.0)
    for t in range(1, longest + 1):
        scorer = F.when(F.lit(t) < n_tiers, F.lit(SCORER_WH_PER_KCHAR)).otherwise(F.lit(0.0))
        total = total + F.when(tier >= F.lit(t), F.lit(model_rate(t)) + scorer).otherwise(F.lit(0.0))
    return kchar * total


LONGEST_CHAIN = max(len(chain) for chain in C.CHAINS.values())


def quality_from_cells(cells: DataFrame) -> DataFrame:
    return macro_prf_from_cells(cells, ["strategy", "threshold"])


def cost_from_cells(cells: DataFrame, longest: int = LONGEST_CHAIN) -> DataFrame:
    """A prompt pays for every tier up to the accepting one (model call), plus the scorer on non-last tiers."""
    wh = prompt_cost(F.col("tier"), F.col("n_tiers"), F.col("_chars") / F.lit(1000.0), longest)
    return cells.groupBy("strategy", "threshold").agg(F.sum(F.col("tier") * F.col("_n")).alias("model_calls"), F.round(F.sum(wh), 6).alias("energy_wh"))


def threshold_sweep(
    prompts: DataFrame, answers: DataFrame, scores: DataFrame, dataset: str = "boolq", strategies=tuple(C.STRATEGIES), thresholds: Thresholds = C.THRESHOLDS_BOOLQ
) -> DataFrame:
    return quality_from_cells(sweep_cells(prompts, answers, scores, dataset, strategies, thresholds))


def tier_accounting(cells: DataFrame) -> DataFrame:
    """Accepted rows per tier, and completed / remaining after each tier, per (strategy, threshold)."""
    per_tier = cells.groupBy("strategy", "threshold", "tier").agg(F.sum("_n").alias("accepted"))
    w = Window.partitionBy("strategy", "threshold").orderBy("tier")
    total = F.sum("accepted").over(Window.partitionBy("strategy", "threshold"))
    completed = F.sum("accepted").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per_tier.select(
        "strategy", "threshold", "tier", "accepted", completed.alias("completed"), (total - completed).alias("remaining")
    )


# ---------------------------------------------------------------------------------------------------------------
# Sequential cascade, one threshold, tiers answered only for remaining rows
# ---------------------------------------------------------------------------------------------------------------

#: (remaining prompts, tier) -> (prompt_id, response)
AnswerFn = Callable[[DataFrame, C.Tier], DataFrame]
#: (rows with prompt_id, prompt_text, answer, pred; tier) -> the same rows with a column ``score``
ScoreFn = Callable[[DataFrame, C.Tier], DataFrame]


def from_answers(answers: DataFrame) -> AnswerFn:
    """Responder that looks answers up in a stored table."""
    return lambda remaining, tier: answers.where(F.col("model") == tier.model).join(remaining.select("prompt_id"), "prompt_id", "left_semi")


def from_scores(scores: DataFrame, strategy: str) -> ScoreFn:
    """Scorer that looks scores up in a stored table."""

    def score(rows: DataFrame, tier: C.Tier) -> DataFrame:
        own = scores.where((F.col("strategy") == strategy) & (F.col("tier") == tier.tier)).select("prompt_id", "score")
        return rows.join(own, "prompt_id", "left")

    return score


def sequential_final(
    prompts: DataFrame, strategy: str, threshold: float, answer_fn: AnswerFn, score_fn: ScoreFn, dataset: str = "boolq",
    chain: Sequence[C.Tier] | None = None,
) -> DataFrame:
    """Run tier after tier on what is left; return the union of accepted rows (U1) in tier order.

    Each tier's narrow table (prompt_id, pred, score) is written once to the shared folder; the accepted rows and the
    next tier's remainder (an anti-join on ids) are both read from it.
    """
    chain = list(C.CHAINS[C.STRATEGIES[strategy]] if chain is None else chain)
    base = prompts.select("prompt_id", "gold_class", "prompt_text")
    remaining, parts = base, []
    for tier in chain:
        last = tier is chain[-1]
        said = answer_fn(remaining, tier).select("prompt_id", "response", F.lit(True).alias("answered"))
        rows = remaining.join(said, "prompt_id", "left")
        model = F.lit(tier.model)
        rows = rows.withColumn("answer", strip_echo("response", "prompt_text", model))
        rows = rows.withColumn("pred", F.when(F.col("answered"), RULES[dataset](F.col("answer"), model)))
        scored = score_fn(rows, tier)
        score = F.when(F.col("answered"), F.col("score"))
        table = staged(scored.select("prompt_id", F.col("gold_class").alias("gold"), "pred", score.alias("score")), f"tier-{tier.tier}")
        passed = F.lit(True) if last else accepted_condition(F.col("score"), F.lit(float(threshold)))
        parts.append(
            table.where(passed).select(
                F.lit(strategy).alias("strategy"), F.lit(float(threshold)).alias("threshold"), "prompt_id", F.lit(tier.tier).alias("tier"),
                model.alias("model"), "gold", "pred", "score", F.lit(len(chain)).alias("n_tiers"),
            )
        )
        if last:
            break
        left = table.where(~passed).select("prompt_id")
        if left.isEmpty():  # C4: nothing left, stop early
            break
        remaining = base.join(left, "prompt_id", "left_semi")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cascade_sequential(prompts: DataFrame, answers: DataFrame, scores: DataFrame, strategies=tuple(C.STRATEGIES), threshold: float = 0.8) -> DataFrame:
    """C1 for several strategies; their tier loops are independent, so they run concurrently (one driver thread
    each, Spark schedules the jobs side by side)."""
    from concurrent.futures import ThreadPoolExecutor

    run = lambda s: sequential_final(prompts, s, threshold, from_answers(answers), from_scores(scores, s))
    with ThreadPoolExecutor(max_workers=max(1, len(strategies))) as pool:
        parts = list(pool.map(run, strategies))
    final = parts[0]
    for p in parts[1:]:
        final = final.unionByName(p)
    return macro_prf(final, ["strategy", "threshold"])


def cascade_cost(final: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """C7 of accepted rows; those of a sequential cascade get the size of their prompt from ``prompts``."""
    if "chars" not in final.columns:
        final = final.join(prompts.select("prompt_id", F.length("prompt_text").cast("long").alias("chars")), "prompt_id")
    return cost_from_cells(cells_of(final))


def scored_long(prompts: DataFrame, answers: DataFrame, scores: DataFrame, dataset: str, strategies: Sequence[str]) -> DataFrame:
    """(strategy, prompt_id, tier, n_tiers, model, gold, pred, score): one row per step."""
    rows = scored_steps(prompts, answers, scores, dataset, strategies)
    long = rows.select("strategy", "prompt_id", F.size("steps").alias("n_tiers"), "gold", F.explode("steps").alias("x"))
    return long.select("strategy", "prompt_id", "x.tier", "n_tiers", "x.model", "gold", "x.pred", "x.score")
