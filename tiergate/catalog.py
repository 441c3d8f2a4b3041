"""Every registered query with its DuckDB oracle.

Conventions, so a Spark result and its oracle compare equal:
* integer outputs are ``bigint``, non-integers ``double`` (``normalize``); oracle SQL casts the same way;
* metric fractions are rounded to 9 decimals, money-like sums to 6; energy is rounded through a decimal;
* every computed column has the same alias on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import config as C
from . import fixtures as FX
from . import oracle as O

from .fixtures import stored_run, stub_pandas_model
from .functions import rules as RL
from .plans import cascade
from .plans import scorer as SC
from .registry import register
from .session import scratch_path, staged
from .sources import prompts as P
from .sources.tables import scan as _scan


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _prompt_cols_sql(dataset: str) -> str:
    return (
        "SELECT CAST(prompt_id AS BIGINT) AS prompt_id, dataset, prompt_text, CAST(gold_class AS BIGINT) AS gold_class, gold_text "
        f"FROM ({O.prompts_sql(dataset)}) p"
    )


# ---------------------------------------------------------------------------------------------------------------
# The flagship sweep
# ---------------------------------------------------------------------------------------------------------------


@register("threshold_sweep", sql=lambda: O.threshold_sweep_sql())
def q_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return normalize(cascade.threshold_sweep(*stored_run(spark, sf)))


def _fine_grid(spark: SparkSession) -> DataFrame:
    """A table of 1,000 thresholds, 0 .. 0.999."""
    return spark.range(1000).select((F.col("id") / F.lit(1000.0)).alias("threshold"))


@register("threshold_sweep_fine", sql=lambda: O.threshold_sweep_fine_sql())
def q_threshold_sweep_fine(spark: SparkSession, sf: str) -> DataFrame:
    """C2 / J6 with the grid as a table: quality and modelled cost at 1,000 thresholds, from the same few intervals a prompt."""
    cells = staged(cascade.sweep_cells(*stored_run(spark, sf), thresholds=_fine_grid(spark)), "fine-cells")
    return normalize(cascade.quality_from_cells(cells).join(cascade.cost_from_cells(cells), ["strategy", "threshold"]))


@register("strategy_sweep", sql=lambda: O.threshold_sweep_sql("mnli", ("strategy-1", "strategy-9"), C.THRESHOLDS_MNLI))
def q_strategy_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """C3 on the 3-class task: names x chains x thresholds in one pass."""
    return normalize(cascade.threshold_sweep(*stored_run(spark, sf, "mnli"), "mnli", ("strategy-1", "strategy-9"), C.THRESHOLDS_MNLI))


# ---------------------------------------------------------------------------------------------------------------
# Prompt tables
# ---------------------------------------------------------------------------------------------------------------


def _prompt_query(dataset: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return normalize(P.prompts(spark, sf, dataset))

    return run


for _ds, _key in (("boolq", "prompt_build_boolq"), ("mnli", "prompt_build_mnli"), ("cnn_dm", "prompt_build_cnn"), ("samsum", "prompt_build_samsum")):
    register(_key, sql=_prompt_cols_sql(_ds))(_prompt_query(_ds))


# ---------------------------------------------------------------------------------------------------------------
# Evaluation tasks
# ---------------------------------------------------------------------------------------------------------------

from .operators import metrics as M  # noqa: E402
from .plans import evaluate as EV  # noqa: E402
from .sources import run_folder as RF  # noqa: E402


def _labelled(spark, sf, *tasks: str) -> DataFrame:
    return EV.labelled(*FX.eval_run(spark, sf, tasks))


def _eval_query(task: str, evaluate):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return normalize(evaluate(_labelled(spark, sf, task)))

    return run


for _t in RL.CLASS_TASKS:
    register(f"eval_{_t}", sql=O.eval_class_sql([_t]))(_eval_query(_t, EV.eval_class))
for _t in RL.MULTILABEL_TASKS:
    register(f"eval_{_t}", sql=O.eval_multilabel_sql([_t]))(_eval_query(_t, EV.eval_multilabel))
register("eval_stsb", sql=lambda: O.eval_stsb_sql())(_eval_query("stsb", EV.eval_number))


@register("eval_all", sql=lambda: O.eval_all_sql(RL.CLASS_TASKS, RL.MULTILABEL_TASKS, RL.TEXT_TASKS))
def q_eval_all(spark, sf):
    """All 15 tasks, one row per (task, model, metric)."""
    return normalize(EV.eval_all(*FX.eval_run(spark, sf, RL.ALL_TASKS), _scan(spark, sf, "embeddings", "vec_id", "embedding")))


@register(
    "eval_run_folder",
    sql=lambda: O.eval_run_folder_sql(RL.CLASS_TASKS, RL.MULTILABEL_TASKS, RL.TEXT_TASKS, FX.MISSING_RUN, FX.SHORT_RUN),
)
def q_eval_run_folder(spark, sf):
    """S2 + L16: run folders in the runner's layout, read in byte ranges, joined to their prompts by batch-plan position, and
    evaluated; one run is missing and one was cut off."""
    answers, references = FX.eval_run(spark, sf, RL.ALL_TASKS)
    base = scratch_path(spark, "run_folders", _uuid.uuid4().hex)
    RF.write_run_folders(*FX.run_folder_rows(answers, references, C.BATCH_SIZE_DEFAULT), base)
    models = [t.model for t in C.EVAL_MODELS]
    return normalize(EV.eval_run_folders(spark, base, references, _scan(spark, sf, "embeddings", "vec_id", "embedding"), models, C.BATCH_SIZE_DEFAULT))


@register("macro_prf", sql=lambda: O.macro_prf_sql(O.class_labelled_sql(RL.CLASS_TASKS), ["task"]))
def q_macro_prf(spark, sf):
    """A1 pooled over models: one row per task."""
    return normalize(EV.eval_class(_labelled(spark, sf, *RL.CLASS_TASKS), ["task"]))


@register("macro_prf_multilabel", sql=lambda: O.macro_prf_multilabel_sql(O.multilabel_labelled_sql(RL.MULTILABEL_TASKS), ["task"]))
def q_macro_prf_multilabel(spark, sf):
    return normalize(EV.eval_multilabel(_labelled(spark, sf, *RL.MULTILABEL_TASKS), ["task"]))


@register(
    "accuracy",
    sql=lambda: f"SELECT task, model, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy "
    f"FROM ({O.class_labelled_sql(RL.CLASS_TASKS)}) x GROUP BY task, model",
)
def q_accuracy(spark, sf):
    return normalize(M.accuracy(_labelled(spark, sf, *RL.CLASS_TASKS), ["task", "model"], "gold_class", "pred_class"))


@register("regression_metrics", sql=lambda: O.regression_sql(O.stsb_labelled_sql(), ["task"]))
def q_regression_metrics(spark, sf):
    return normalize(EV.eval_number(_labelled(spark, sf, "stsb"), ["task"]))


# ---------------------------------------------------------------------------------------------------------------
# Answers, scorer input, gate and the joins around it
# ---------------------------------------------------------------------------------------------------------------

from .functions.text import strip_echo  # noqa: E402
from .operators import gate as G  # noqa: E402


@register(
    "echo_strip",
    sql=lambda: f"SELECT a.prompt_id, CAST(a.tier AS BIGINT) AS tier, a.model, {O.sql_strip_echo('a.response', 'a.prompt_text', 'a.model')} AS answer "
    f"FROM ({O.answers_sql('boolq', C.CHAINS['phi'])}) a",
)
def q_echo_strip(spark, sf):
    p, answers, _ = stored_run(spark, sf)
    a = answers.where(F.col("model").isin(cascade.chain_models("phi"))).join(p.select("prompt_id", "prompt_text"), "prompt_id")
    return normalize(a.select("prompt_id", "tier", "model", strip_echo("response", "prompt_text", "model").alias("answer")))


@register(
    "join_gold",
    sql=lambda: f"SELECT prompt_id, CAST(tier AS BIGINT) AS tier, model, CAST(gold AS BIGINT) AS gold, CAST(pred AS BIGINT) AS pred "
    f"FROM ({O.labelled_answers_sql('boolq', 'phi')}) x",
)
def q_join_gold(spark, sf):
    p, answers, _ = stored_run(spark, sf)
    return normalize(cascade.labelled_answers(p, answers, "boolq", cascade.chain_models("phi")).select("prompt_id", "tier", "model", "gold", "pred"))


def _scorer_input_sql() -> str:
    boolq = O.labelled_answers_sql("boolq", "phi")
    mnli = O.labelled_answers_sql("mnli", "flan")
    pb = O.prompts_sql("boolq")
    pm = O.prompts_sql("mnli")
    return (
        f"SELECT 'boolq' AS dataset, x.prompt_id, x.model, p.prompt_text || x.answer AS scorer_text "
        f"FROM ({boolq}) x JOIN ({pb}) p ON x.prompt_id = p.prompt_id "
        f"UNION ALL SELECT 'mnli' AS dataset, x.prompt_id, x.model, p.prompt_text || CAST(x.pred AS VARCHAR) AS scorer_text "
        f"FROM ({mnli}) x JOIN ({pm}) p ON x.prompt_id = p.prompt_id"
    )


@register("scorer_input", sql=_scorer_input_sql)
def q_scorer_input(spark, sf):
    """Boolq scorer reads prompt + answer text; mnli reads prompt + predicted class digit. The prompt text that the
    answers met for the echo strip is the one the scorer reads: no second join."""
    out = []
    for ds, chain in (("boolq", "phi"), ("mnli", "flan")):
        p, answers, _ = stored_run(spark, sf, ds)
        x = cascade.labelled_answers(p, answers, ds, cascade.chain_models(chain))
        out.append(x.select(F.lit(ds).alias("dataset"), "prompt_id", "model", SC.scorer_text(ds).alias("scorer_text")))
    return normalize(out[0].unionByName(out[1]))


def _gated_sql() -> str:
    """Steps of every strategy and tier that have a gate (the last tier has none)."""
    return f"SELECT strategy, prompt_id, CAST(tier AS BIGINT) AS tier, score FROM ({O.scored_long_sql('boolq', tuple(C.STRATEGIES))}) s WHERE tier < n_tiers"


def _route_sql() -> str:
    return f"SELECT strategy, prompt_id, tier, score, CASE WHEN COALESCE(score > {O.sql_dbl(0.8)}, false) THEN 'accept' ELSE 'escalate' END AS route FROM ({_gated_sql()}) t"


def _gated(spark, sf) -> DataFrame:
    steps = cascade.scored_long(*stored_run(spark, sf), "boolq", tuple(C.STRATEGIES)).where(F.col("tier") < F.col("n_tiers"))
    return steps.select("strategy", "prompt_id", "tier", "score")


@register("gate_split", sql=_route_sql)
def q_gate_split(spark, sf):
    """P8 at every tier that has a gate, for every strategy."""
    return normalize(G.route(_gated(spark, sf), 0.8))


@register(
    "join_scores",
    sql=lambda: f"SELECT s.strategy, a.prompt_id, CAST(a.tier AS BIGINT) AS tier, CAST(a.pred AS BIGINT) AS pred, CAST(a.gold AS BIGINT) AS gold, s.score "
    f"FROM ({O.labelled_answers_sql('boolq', 'flan')}) a JOIN ({O.scored_long_sql('boolq', ('strategy-1', 'strategy-2'))}) s "
    f"ON a.prompt_id = s.prompt_id AND a.tier = s.tier",
)
def q_join_scores(spark, sf):
    """Answers and scores meet on (prompt_id, tier)."""
    p, answers, scores = stored_run(spark, sf)
    a = cascade.labelled_answers(p, answers, "boolq", cascade.chain_models("flan")).select("prompt_id", "tier", "pred", "gold")
    s = scores.where(F.col("strategy").isin("strategy-1", "strategy-2"))
    return normalize(a.join(s, ["prompt_id", "tier"]).select("strategy", "prompt_id", "tier", "pred", "gold", "score"))


def _gates() -> list[tuple[str, int]]:
    return [(s, t.tier) for s in C.STRATEGIES for t in C.CHAINS[C.STRATEGIES[s]][:-1]]


def _everyone_sql() -> str:
    gates = ", ".join(f"({O.q(s)}, {t})" for s, t in _gates())
    return f"SELECT x.strategy, CAST(x.tier AS BIGINT) AS tier, p.prompt_id, CAST(p.gold_class AS BIGINT) AS gold_class FROM ({O.prompts_sql('boolq')}) p CROSS JOIN (VALUES {gates}) x(strategy, tier)"


def _everyone(spark, sf) -> DataFrame:
    """Every prompt at every gate of every strategy."""
    gates = F.array(*(F.struct(F.lit(s).alias("strategy"), F.lit(t).alias("tier")) for s, t in _gates()))
    return P.prompts(spark, sf, "boolq").select("prompt_id", "gold_class", F.inline(gates))


@register(
    "remaining_anti",
    sql=lambda: f"SELECT strategy, tier, prompt_id FROM ({_everyone_sql()}) e WHERE NOT EXISTS ("
    f"SELECT 1 FROM ({_gated_sql()}) a WHERE a.score > {O.sql_dbl(0.8)} AND a.prompt_id = e.prompt_id AND a.strategy = e.strategy AND a.tier <= e.tier)",
)
def q_remaining_anti(spark, sf):
    """What is left after each tier at 0.8 = all prompts minus those that a tier up to it accepted."""
    accepted, _ = G.gate_split(_gated(spark, sf), 0.8)
    longest = max(len(C.CHAINS[c]) for c in C.STRATEGIES.values())
    gone = accepted.select("strategy", "prompt_id", F.explode(F.sequence("tier", F.lit(longest))).alias("tier"))
    return normalize(G.remaining_anti(_everyone(spark, sf), gone, ["strategy", "prompt_id", "tier"]).select("strategy", "tier", "prompt_id"))


@register(
    "accepted_semi",
    sql=lambda: f"SELECT e.strategy, e.tier, e.prompt_id, e.gold_class FROM ({_everyone_sql()}) e JOIN ("
    f"SELECT strategy, prompt_id, min(tier) AS tier FROM ({_gated_sql()}) a WHERE a.score > {O.sql_dbl(0.8)} GROUP BY ALL) f "
    "ON f.strategy = e.strategy AND f.prompt_id = e.prompt_id AND f.tier = e.tier",
)
def q_accepted_semi(spark, sf):
    """The prompts that each tier accepts at 0.8, for every strategy: its gate passes and none before it did."""
    accepted, _ = G.gate_split(_gated(spark, sf), 0.8)
    first = accepted.groupBy("strategy", "prompt_id").agg(F.min("tier").alias("tier"))
    return normalize(G.accepted_semi(_everyone(spark, sf), first, ["strategy", "prompt_id", "tier"]).select("strategy", "tier", "prompt_id", "gold_class"))


# ---------------------------------------------------------------------------------------------------------------
# Cascade accounting
# ---------------------------------------------------------------------------------------------------------------

from .operators import batching as BT  # noqa: E402


@register(
    "first_accept",
    sql=lambda: f"SELECT strategy, threshold, prompt_id, CAST(tier AS BIGINT) AS tier FROM ({O.sweep_final_sql()}) f",
)
def q_first_accept(spark, sf):
    return normalize(cascade.sweep_final(*stored_run(spark, sf)).select("strategy", "threshold", "prompt_id", "tier"))


@register(
    "tier_accounting",
    sql=lambda: f"""
    WITH per AS (SELECT strategy, threshold, tier, count(*) AS accepted FROM ({O.sweep_final_sql()}) f GROUP BY ALL)
    SELECT strategy, threshold, CAST(tier AS BIGINT) AS tier, accepted,
      CAST(sum(accepted) OVER (PARTITION BY strategy, threshold ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS completed,
      CAST(sum(accepted) OVER (PARTITION BY strategy, threshold) - sum(accepted) OVER (PARTITION BY strategy, threshold ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS remaining
    FROM per""",
)
def q_tier_accounting(spark, sf):
    return normalize(cascade.tier_accounting(cascade.sweep_cells(*stored_run(spark, sf))))


@register(
    "batch_offsets",
    sql=lambda: f"""
    WITH per AS (SELECT strategy, threshold, n_tiers, tier, count(*) AS acc FROM ({O.sweep_final_sql()}) f GROUP BY ALL),
    reached AS (SELECT strategy, threshold, n_tiers, tier,
                sum(acc) OVER (PARTITION BY strategy, threshold ORDER BY tier DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rows FROM per),
    steps AS (SELECT strategy, threshold, tier, rows, 'model' AS step, tier * 2 - 1 AS step_no FROM reached
              UNION ALL SELECT strategy, threshold, tier, rows, 'scorer', tier * 2 FROM reached WHERE tier < n_tiers)
    SELECT strategy, threshold, CAST(step_no AS BIGINT) AS step_no, CAST(tier AS BIGINT) AS tier, step, CAST(rows AS BIGINT) AS rows,
      CAST(ceil(rows / 4.0) AS BIGINT) AS batches,
      CAST(COALESCE(sum(CAST(ceil(rows / 4.0) AS BIGINT)) OVER (PARTITION BY strategy, threshold ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS batch_offset
    FROM steps""",
)
def q_batch_offsets(spark, sf):
    return normalize(BT.batch_offsets(cascade.sweep_cells(*stored_run(spark, sf)), C.BATCH_SIZE_CASCADE))


_FINAL_COLS_SQL = "strategy, threshold, prompt_id, CAST(tier AS BIGINT) AS tier, model, CAST(gold AS BIGINT) AS gold, CAST(pred AS BIGINT) AS pred, score"


def _sequential(spark, sf, strategy: str, threshold: float) -> DataFrame:
    p, answers, scores = stored_run(spark, sf)
    return cascade.sequential_final(p, strategy, threshold, cascade.from_answers(answers), cascade.from_scores(scores, strategy))


@register("cascade_union", sql=lambda: f"SELECT {_FINAL_COLS_SQL} FROM ({O.sweep_final_sql('boolq', ('strategy-9',), (0.8,))}) f")
def q_cascade_union(spark, sf):
    """U1 via C1: accepted rows of every tier of the sequential cascade, unioned with their tier."""
    return normalize(_sequential(spark, sf, "strategy-9", 0.8).drop("n_tiers"))


@register("cascade_sequential", sql=lambda: O.threshold_sweep_sql("boolq", tuple(C.STRATEGIES), (0.8,)))
def q_cascade_sequential(spark, sf):
    return normalize(cascade.cascade_sequential(*stored_run(spark, sf), tuple(C.STRATEGIES), 0.8))


@register("cascade_cost", sql=lambda: O.cascade_cost_sql(O.sweep_final_sql()))
def q_cascade_cost(spark, sf):
    return normalize(cascade.cost_from_cells(cascade.sweep_cells(*stored_run(spark, sf))))


@register(
    "distinct_thresholds",
    sql=lambda: f"SELECT DISTINCT strategy, threshold FROM ({O.threshold_sweep_sql()}) s",
)
def q_distinct_thresholds(spark, sf):
    return normalize(cascade.threshold_sweep(*stored_run(spark, sf)).select("strategy", "threshold").distinct())


# ---------------------------------------------------------------------------------------------------------------
# Sampling, splits, batches
# ---------------------------------------------------------------------------------------------------------------

from .operators import sampling as SM  # noqa: E402


def _sample_key_sql(col: str = "prompt_id", seed: int = 42) -> str:
    return f"md5(CAST({col} AS VARCHAR) || '-sample-' || '{seed}')"


@register(
    "sample_n",
    sql=lambda: f"SELECT prompt_id, dataset FROM ({O.prompts_sql('cnn_dm')}) p ORDER BY {_sample_key_sql()}, prompt_id LIMIT 256",
)
def q_sample_n(spark, sf):
    return normalize(SM.sample_n(P.prompts(spark, sf, "cnn_dm").select("prompt_id", "dataset"), 256))


@register(
    "split_positional",
    sql=lambda: f"""
    WITH s AS (SELECT prompt_id, dataset, {_sample_key_sql()} AS o FROM ({O.prompts_sql('cnn_dm')}) p ORDER BY o, prompt_id LIMIT 512)
    SELECT prompt_id, dataset, row_number() OVER (ORDER BY o, prompt_id) AS sample_pos,
      CASE WHEN row_number() OVER (ORDER BY o, prompt_id) <= 256 THEN 'train' ELSE 'test' END AS split FROM s""",
)
def q_split_positional(spark, sf):
    return normalize(SM.split_positional(P.prompts(spark, sf, "cnn_dm").select("prompt_id", "dataset"), 512, 256))


@register(
    "split_hash",
    sql=lambda: f"SELECT prompt_id, CASE WHEN {O.sql_h(O.sql_key('prompt_id', O.q('-split-'), O.q('42')))} < 20 THEN 'validation' ELSE 'train' END AS split "
    f"FROM ({O.prompts_sql('boolq')}) p",
)
def q_split_hash(spark, sf):
    return normalize(SM.split_hash(P.prompts(spark, sf, "boolq").select("prompt_id"), 20))


def _batch_plan_sql(dataset: str = "boolq", bs: int = C.BATCH_SIZE_CASCADE) -> str:
    return f"""
    SELECT dataset, prompt_id, CAST(length(prompt_text) AS BIGINT) AS n_chars,
      row_number() OVER (PARTITION BY dataset ORDER BY length(prompt_text), prompt_id) AS position,
      CAST((row_number() OVER (PARTITION BY dataset ORDER BY length(prompt_text), prompt_id) - 1) // {bs} AS BIGINT) AS batch_id
    FROM ({O.prompts_sql(dataset)}) p"""


@register("batch_plan", sql=_batch_plan_sql)
def q_batch_plan(spark, sf):
    return normalize(BT.batch_plan(P.prompts(spark, sf, "boolq"), C.BATCH_SIZE_CASCADE))


def _word_count_sql(x: str) -> str:
    t = f"regexp_replace({x}, '^{O.WS}+|{O.WS}+$', '', 'g')"
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(string_split_regex({t}, '{O.WS}+')) END)"


@register(
    "batch_stats",
    sql=lambda: f"""
    WITH b AS ({_batch_plan_sql()}),
    w AS (SELECT prompt_id, {_word_count_sql('prompt_text')} AS n_words FROM ({O.prompts_sql('boolq')}) p)
    SELECT dataset, batch_id, count(*) AS rows, CAST(min(n_chars) AS BIGINT) AS min_chars, CAST(max(n_chars) AS BIGINT) AS max_chars,
      round(avg(n_chars), 6) AS mean_chars, CAST(max(n_words) AS BIGINT) AS max_words, round(avg(n_words), 6) AS mean_words,
      CAST(count(*) * max(n_chars) - sum(n_chars) AS BIGINT) AS pad_chars
    FROM b JOIN w ON b.prompt_id = w.prompt_id GROUP BY dataset, batch_id""",
)
def q_batch_stats(spark, sf):
    p = P.prompts(spark, sf, "boolq")
    return normalize(BT.batch_stats(BT.batch_plan(p, C.BATCH_SIZE_CASCADE), p))


# ---------------------------------------------------------------------------------------------------------------
# Scorer training rows
# ---------------------------------------------------------------------------------------------------------------


def _scorer_labels_sql() -> str:
    parts = []
    for ch in ("flan", "phi"):
        parts.append(
            f"SELECT model, prompt_id, CAST(CASE WHEN pred = gold THEN 1 ELSE 0 END AS BIGINT) AS label FROM ({O.labelled_answers_sql('boolq', ch)}) x"
        )
    return " UNION ALL ".join(parts)


def _labelled_rows(spark, sf) -> DataFrame:
    """Answers of both chains with their labels, in one read of the answers."""
    p, answers, _ = stored_run(spark, sf)
    return cascade.labelled_answers(p, answers, "boolq", cascade.chain_models("flan", "phi"))


def _scorer_labels(spark, sf) -> DataFrame:
    return _labelled_rows(spark, sf).select("model", "prompt_id", (F.col("pred") == F.col("gold")).cast("int").alias("label"))


@register("scorer_labels_class", sql=_scorer_labels_sql)
def q_scorer_labels_class(spark, sf):
    """M4: a training row is right (1) when the answer's label equals gold."""
    return normalize(_scorer_labels(spark, sf))


@register(
    "scorer_label_balance",
    sql=lambda: f"SELECT model, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM ({_scorer_labels_sql()}) x GROUP BY model",
)
def q_scorer_label_balance(spark, sf):
    """Positive count of scorer labels per model."""
    return normalize(_scorer_labels(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives")))


@register(
    "pooled_training",
    sql=lambda: f"""
    SELECT x.model, x.prompt_id, p.prompt_text || x.answer AS scorer_text, CAST(CASE WHEN x.pred = x.gold THEN 1 ELSE 0 END AS BIGINT) AS label
    FROM ({O.labelled_answers_sql('boolq', 'flan')} UNION ALL {O.labelled_answers_sql('boolq', 'phi')}) x
    JOIN ({O.prompts_sql('boolq')}) p ON x.prompt_id = p.prompt_id""",
)
def q_pooled_training(spark, sf):
    """One pooled training table over all models (model kept as a column)."""
    rows = _labelled_rows(spark, sf)
    return normalize(rows.select("model", "prompt_id", SC.scorer_text("boolq").alias("scorer_text"), (F.col("pred") == F.col("gold")).cast("int").alias("label")))


# ---------------------------------------------------------------------------------------------------------------
# Emission records and energy
# ---------------------------------------------------------------------------------------------------------------

from .operators import energy as EN  # noqa: E402
from .sources import emissions as EM  # noqa: E402


@register(
    "parse_run_names",
    sql=lambda: f"SELECT project_name, {O.run_parts_sql()} FROM ({O.emission_records_sql()}) r",
)
def q_parse_run_names(spark, sf):
    recs = FX.emission_records(spark, sf)
    parts = EN.parse_project_name(F.col("project_name"), EM.DATASET)
    return normalize(recs.select("project_name", *[v.alias(k) for k, v in parts.items()]))


@register(
    "scan_emissions",
    sql=lambda: f"SELECT folder, project_name, duration, energy_consumed FROM ({O.emission_records_sql()}) r",
)
def q_scan_emissions(spark, sf):
    """S3 + S8: write the records as per-run CSV folders (dynamic partition overwrite), then scan them back."""
    import uuid

    base = scratch_path(spark, "emissions", uuid.uuid4().hex)
    EM.write_emissions(FX.emission_records(spark, sf), base)
    return normalize(EM.scan_emissions(spark, base).select("folder", "project_name", "duration", "energy_consumed"))


@register(
    "energy_rollup",
    sql=lambda: f"""SELECT run, count(*) AS batches, CAST(sum(energy_wh) AS DOUBLE) / count(*) AS avg_wh, CAST(sum(energy_wh) AS DOUBLE) AS total_wh
    FROM ({O.energy_batches_sql()}) b GROUP BY run""",
)
def q_energy_rollup(spark, sf):
    return normalize(EN.energy_rollup(EN.energy_batches(FX.emission_records(spark, sf), EM.DATASET)))


def _dup_records(spark, sf):
    recs = FX.emission_records(spark, sf).select("project_name", "run_id", "energy_consumed")
    first = recs.select("project_name", "energy_consumed", F.lit(0).alias("file_order"))
    from .functions.hashing import h as _h, key as _key

    again = recs.where(_h(_key(F.col("run_id"), "-dup")) < 10).select(
        "project_name", (F.col("energy_consumed") * F.lit(1.5)).alias("energy_consumed"), F.lit(1).alias("file_order")
    )
    return first.unionByName(again)


def _dup_records_sql() -> str:
    r = O.emission_records_sql()
    return (
        f"SELECT project_name, energy_consumed, 0 AS file_order FROM ({r}) a UNION ALL "
        f"SELECT project_name, energy_consumed * 1.5, 1 AS file_order FROM ({r}) b WHERE {O.sql_h(O.sql_key('run_id', O.q('-dup')))} < 10"
    )


@register(
    "energy_dedup",
    sql=lambda: f"SELECT project_name, arg_max(energy_consumed, file_order) AS energy_consumed, count(*) AS copies FROM ({_dup_records_sql()}) d GROUP BY project_name",
)
def q_energy_dedup(spark, sf):
    return normalize(EN.energy_dedup(_dup_records(spark, sf)))


@register(
    "energy_lookup",
    sql=lambda: f"""WITH b AS ({O.energy_batches_sql()}), c AS (SELECT run, count(*) AS n FROM b GROUP BY run)
    SELECT b.run, b.batch, b.project_name, CAST(b.energy_wh AS DOUBLE) AS energy_wh, b.batch < c.n AS indexed FROM b JOIN c ON b.run = c.run""",
)
def q_energy_lookup(spark, sf):
    """Every record with its energy, and whether the studied index loop (a gap drops the run's tail) reaches it."""
    return normalize(EN.energy_lookup(EN.energy_batches(FX.emission_records(spark, sf), EM.DATASET)).drop("strategy", "threshold"))


# ---------------------------------------------------------------------------------------------------------------
# Text metrics
# ---------------------------------------------------------------------------------------------------------------

from .operators import embed_match as EMB  # noqa: E402
from .operators import rouge as RG  # noqa: E402
from .plans import text_eval as TE  # noqa: E402


@register("rouge_1", sql=lambda: O.rouge_n_sql(O.conversation_pairs_sql(), 1))
def q_rouge_1(spark, sf):
    return normalize(RG.rouge_n(TE.conversation_pairs(spark, sf), 1))


@register("rouge_2", sql=lambda: O.rouge_n_sql(O.conversation_pairs_sql(), 2))
def q_rouge_2(spark, sf):
    return normalize(RG.rouge_n(TE.conversation_pairs(spark, sf), 2))


@register("rouge_l", sql=lambda: O.rouge_l_sql(O.conversation_pairs_sql()))
def q_rouge_l(spark, sf):
    """LCS-based F over whole texts."""
    return normalize(RG.rouge_l(TE.conversation_pairs(spark, sf)))


@register("embed_match", sql=lambda: O.embed_match_sql(O.conversation_pairs_sql()))
def q_embed_match(spark, sf):
    return normalize(EMB.embed_match(TE.conversation_pairs(spark, sf), _scan(spark, sf, "embeddings", "vec_id", "embedding")))


def _embeddings(spark, sf) -> DataFrame:
    return _scan(spark, sf, "embeddings", "vec_id", "embedding")


for _task, _key in (("samsum", "eval_samsum"), ("cnn_dm", "eval_cnn"), ("dolly", "eval_dolly")):
    def _mk(task):
        def run(spark, sf):
            return normalize(EV.eval_text(_labelled(spark, sf, task), _embeddings(spark, sf), ["model"]))

        return run

    register(_key, sql=O.eval_text_sql(_task))(_mk(_task))


@register("scorer_labels_text", sql=lambda: O.scorer_labels_text_sql())
def q_scorer_labels_text(spark, sf):
    rows = _labelled(spark, sf, "samsum")
    pairs = rows.select("model", F.col("prompt_id").alias("pair_id"), F.col("answer").alias("pred"), F.col("gold_text").alias("ref"))
    return normalize(TE.scorer_labels_text(pairs, _embeddings(spark, sf)))


@register("cascade_text", sql=lambda: O.cascade_text_sql())
def q_cascade_text(spark, sf):
    return normalize(TE.cascade_text(*FX.stored_text_run(spark, sf, "strategy-9"), _embeddings(spark, sf)))


# ---------------------------------------------------------------------------------------------------------------
# Prompt CSV, run outputs, inference plug-in
# ---------------------------------------------------------------------------------------------------------------

import uuid as _uuid  # noqa: E402

from .plans import responders as RS  # noqa: E402
from .sources import run_output as RO  # noqa: E402

PROMPT_CSV_SCHEMA = "prompt_id bigint, dataset string, prompt_text string, gold_class int, gold_text string"


@register("scan_prompts", sql=_prompt_cols_sql("boolq"))
def q_scan_prompts(spark, sf):
    """Prompts written as CSV (texts hold newlines and quotes) and scanned back with a declared schema."""
    base = scratch_path(spark, "prompts_csv", _uuid.uuid4().hex)
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (
        P.prompts(spark, sf, "boolq").write.mode("overwrite")
        .options(header=True, quoteAll=True, escape='"', **keep_spaces).csv(base)
    )
    df = spark.read.schema(PROMPT_CSV_SCHEMA).options(header=True, multiLine=True, escape='"', **keep_spaces).csv(base)
    return normalize(df)


def _run_tables(spark, sf):
    """(answers with position and batch, per-model batch times) for both chains over the boolq batch plan."""
    p, answers, _ = stored_run(spark, sf)
    plan = BT.batch_plan(p, C.BATCH_SIZE_CASCADE)
    rows = answers.select("model", "prompt_id", "response").join(plan.select("prompt_id", "position", "batch_id", "n_chars"), "prompt_id")
    rows = staged(rows, "run-rows")  # answers and times are both read from it
    times = FX.batch_times(rows, ("model", "batch_id"))  # each model's own batches, from its own answer rows
    return rows.drop("n_chars"), times


def _run_answers_times_sql() -> str:
    plan = O.batch_plan_sql("boolq", C.BATCH_SIZE_CASCADE)
    return f"SELECT r.model, r.position, r.batch_id, r.response, t.start_ts, t.end_ts FROM ({O.run_answers_sql()}) r JOIN ({O.batch_times_sql(plan)}) t ON r.batch_id = t.batch_id"


@register("scan_run_output", sql=_run_answers_times_sql)
def q_scan_run_output(spark, sf):
    """Answers and batch times written in the runner's JSON layout, then scanned and exploded back to rows."""
    rows, times = _run_tables(spark, sf)
    base = scratch_path(spark, "run_output", _uuid.uuid4().hex)
    RO.write_run_output_json(rows, times, C.BATCH_SIZE_CASCADE, base)
    out = RO.scan_run_output(spark, base, C.BATCH_SIZE_CASCADE)
    return normalize(out.select("model", "position", "batch_id", "response", "start_ts", "end_ts"))


@register("sink_responses", sql=lambda: f"SELECT model, prompt_id, batch_id, response FROM ({O.run_answers_sql()}) r")
def q_sink_responses(spark, sf):
    """Responses and batches written as model-partitioned parquet and read back."""
    rows, times = _run_tables(spark, sf)
    base = scratch_path(spark, "responses", _uuid.uuid4().hex)
    RO.write_responses(rows.select("model", "prompt_id", "batch_id", "response"), times, base)
    resp, _ = RO.read_responses(spark, base)
    return normalize(resp.select("model", "prompt_id", "batch_id", "response"))


@register(
    "batch_latency",
    sql=lambda: f"""WITH r AS ({O.run_answers_sql()}), t AS ({O.batch_times_sql(O.batch_plan_sql('boolq', C.BATCH_SIZE_CASCADE))})
    SELECT r.model, r.batch_id, count(*) AS rows, round(t.end_ts - t.start_ts, 6) AS latency_s, round(avg(length(r.response)), 6) AS mean_answer_chars
    FROM r JOIN t ON r.batch_id = t.batch_id GROUP BY r.model, r.batch_id, t.start_ts, t.end_ts""",
)
def q_batch_latency(spark, sf):
    rows, times = _run_tables(spark, sf)
    return normalize(RO.batch_latency(rows, times))


@register(
    "run_integrity",
    sql=lambda: f"""WITH r AS ({O.run_answers_sql()}), t AS ({O.batch_times_sql(O.batch_plan_sql('boolq', C.BATCH_SIZE_CASCADE))}),
    m AS (SELECT DISTINCT model FROM r)
    SELECT a.model, a.answers, b.batches, CAST(ceil(a.answers / {C.BATCH_SIZE_CASCADE}.0) AS BIGINT) AS expected_batches,
      b.batches = CAST(ceil(a.answers / {C.BATCH_SIZE_CASCADE}.0) AS BIGINT) AS consistent
    FROM (SELECT model, count(*) AS answers FROM r GROUP BY model) a
    JOIN (SELECT m.model, count(DISTINCT t.batch_id) AS batches FROM m CROSS JOIN t GROUP BY m.model) b ON a.model = b.model""",
)
def q_run_integrity(spark, sf):
    rows, times = _run_tables(spark, sf)
    return normalize(RO.run_integrity(rows, times, C.BATCH_SIZE_CASCADE))


@register("batch_inference", sql=lambda: O.batch_inference_sql("boolq", C.CHAINS["phi"], C.BATCH_SIZE_DEFAULT))
def q_batch_inference(spark, sf):
    """M1: each model of a chain runs over the length-sorted batch plan through ``mapInPandas`` (the plug-in path).

    The prompt text rides through the one range shuffle that numbers the rows; each model's batches keep their data set."""
    plan = BT.batch_plan(P.prompts(spark, sf, "boolq"), C.BATCH_SIZE_DEFAULT, keep=("prompt_text",))
    outs = [RS.pandas_responder(plan, t, lambda t=t: stub_pandas_model("boolq", t), ("dataset",)) for t in C.CHAINS["phi"]]
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return normalize(out.drop("dataset"))


# ---------------------------------------------------------------------------------------------------------------
# Result files and curves
# ---------------------------------------------------------------------------------------------------------------

from .plans import curves as CV  # noqa: E402


@register("union_results", sql=lambda: O.quality_rows_sql(O.threshold_sweep_sql()))
def q_union_results(spark, sf):
    """One result file per strategy (published layout), scanned together and stacked by name."""
    rows = CV.quality_rows(cascade.threshold_sweep(*stored_run(spark, sf))).cache()
    base = scratch_path(spark, "results_csv", _uuid.uuid4().hex)
    paths = []
    for s in C.STRATEGIES:
        path = f"{base}/boolq_{s}.csv"
        CV.write_quality_csv(rows.where(F.col("Model") == s), path)
        paths.append(path)
    out = CV.union_results(spark, paths)
    rows.unpersist()
    return normalize(out)


@register("sink_results", sql=lambda: O.quality_rows_sql(O.threshold_sweep_sql()))
def q_sink_results(spark, sf):
    """Commit all grid points, then single ones again - at first with wrong numbers, then right ones: each commit
    replaces its points and keeps all others."""
    run = stored_run(spark, sf)
    rows = staged(CV.quality_rows(cascade.threshold_sweep(*run)), "quality-rows")
    base = scratch_path(spark, "results", _uuid.uuid4().hex)
    CV.sink_results(rows, base)
    one = rows.where("Model = 'strategy-1' and Threshold = 0.7D")
    CV.sink_results(one.withColumn("M-F1", F.lit(-1.0)), base)
    CV.sink_results(CV.quality_rows(cascade.threshold_sweep(*run, "boolq", ("strategy-1",), (0.7,))), base)
    back = CV.read_results(spark, base)
    return normalize(back.select(*[F.col(f"`{c}`") for c in CV.QUALITY_COLUMNS]))


@register("baseline_broadcast", sql=lambda: f"SELECT b.*, th.threshold FROM ({O.baselines_sql()}) b CROSS JOIN {O.thresholds_values(C.THRESHOLDS_BOOLQ)}")
def q_baseline_broadcast(spark, sf):
    """Single-model baselines (F1, energy) drawn at every threshold of the sweep."""
    return normalize(CV.baseline_broadcast(CV.baselines(*stored_run(spark, sf)[:2])))


@register("cost_quality", sql=O.cost_quality_sql)
def q_cost_quality(spark, sf):
    """J9 + C8: quality against measured energy per (strategy, threshold), one-sided keys kept, single models as baselines."""
    run = stored_run(spark, sf)
    measured = CV.measured_energy(EN.energy_batches(FX.emission_records(spark, sf), EM.DATASET))
    return normalize(CV.cost_quality(CV.sweep_points(cascade.sweep_cells(*run)), CV.baselines(*run[:2]), measured))


@register(
    "curve_series",
    sql=lambda: f"""SELECT strategy, count(*) AS points,
      string_agg(printf('%.2f:%.9f:%.6f', threshold, m_f1, energy_wh), '|' ORDER BY threshold, m_f1, energy_wh) AS series
    FROM ({O.sweep_points_sql()}) c GROUP BY strategy""",
)
def q_curve_series(spark, sf):
    return normalize(CV.curve_series(CV.sweep_points(cascade.sweep_cells(*stored_run(spark, sf)))))


# ---------------------------------------------------------------------------------------------------------------
# Scorers trained by epochs, their registry, and the gate that reads it
# ---------------------------------------------------------------------------------------------------------------

from .plans import epochs as EP  # noqa: E402

POOLED = [EP.Scorer("pooled", None, EP.step_of(1e-5), 10)]


def _scorer_rows(spark, sf, dataset: str = "boolq", chains=("flan", "phi")) -> DataFrame:
    if dataset == "samsum":
        prompts, answers, _ = FX.stored_text_run(spark, sf, "strategy-9")
        return TE.training_rows_text(prompts, answers, _embeddings(spark, sf))
    return SC.training_prompts(*FX.stored_answers(spark, sf, dataset), dataset, chains)


def _examples(spark, sf, chains=("flan", "phi")) -> DataFrame:
    return EP.shared_examples(_scorer_rows(spark, sf, chains=chains), ["stripped/words"])


def _fit_sql(rows: str, scorers, result: str) -> str:
    return O.scorer_fit_sql(rows, scorers, EP.N_FEATURES, result)


@register(
    "train_scorer",
    sql=lambda: _fit_sql(
        O.scorer_rows_sql("boolq"), POOLED,
        "SELECT strategy, CAST(e AS BIGINT) AS epoch, n_train, n_val, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, kept FROM curve",
    ),
)
def q_train_scorer(spark, sf):
    """M3: a pooled scorer, epoch by epoch: its losses, and the epoch that is kept, the one with the lowest validation loss."""
    curve, _ = EP.train(_examples(spark, sf), POOLED)
    return normalize(EP.curve_table(spark, curve).drop("model"))


@register(
    "score_rows",
    sql=lambda: _fit_sql(
        O.scorer_rows_sql("boolq"), POOLED, "SELECT ex.model, ex.prompt_id, round(1 / (1 + exp(-z)), 6) AS score FROM logits JOIN ex ON ex.rid = logits.rid",
    ),
)
def q_score_rows(spark, sf):
    """M2: the kept epoch's class-1 probability for every (model, prompt) row."""
    data = _examples(spark, sf)
    _, registry = EP.train(data, POOLED)
    scores = EP.registry_scores(data, EP.registry_table(spark, registry))
    return normalize(scores.select("model", "prompt_id", F.round("score", 6).alias("score")))


GRIDS = {"boolq": C.STRATEGY_GRID, "mnli": C.STRATEGY_GRID_MNLI, "samsum": C.STRATEGY_GRID_SAMSUM}
GRID_CHAINS = {"boolq": ("flan", "phi"), "mnli": ("flan", "phi"), "samsum": ("phi",)}


def _grid_sql() -> str:
    parts = []
    for dataset, grid in GRIDS.items():
        models = sorted(t.model for c in GRID_CHAINS[dataset] for t in C.CHAINS[c])
        listed = _values_sql([(r[0], r[1], r[2], r[3], r[4], r[5] or "") for r in grid], "strategy, learning_rate, epochs, layout, training_text, base")
        result = f"""SELECT {O.q(dataset)} AS dataset, v.strategy, v.learning_rate, CAST(v.epochs AS BIGINT) AS epochs, v.layout, v.training_text, nullif(v.base, '') AS base,
          count(*) AS scorers, CAST(sum(n_train) AS BIGINT) AS n_train, CAST(sum(n_val) AS BIGINT) AS n_val, CAST(min(e) AS BIGINT) AS first_kept, CAST(max(e) AS BIGINT) AS last_kept,
          round(sum(n_val * val_loss) / sum(n_val), 6) AS val_loss
          FROM curve JOIN {listed} ON v.strategy = curve.strategy WHERE kept GROUP BY ALL"""
        parts.append(f"SELECT * FROM ({_fit_sql(O.scorer_rows_sql(dataset, GRID_CHAINS[dataset]), EP.scorers_of(grid, models), result)}) g_{dataset}")
    return " UNION ALL ".join(parts)


def _values_sql(rows, names: str) -> str:
    cell = lambda v: O.q(v) if isinstance(v, str) else O.sql_dbl(v) if isinstance(v, float) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({names})"


@register("train_grid", sql=_grid_sql)
def q_train_grid(spark, sf):
    """M6 + S10: the strategy grids of all three tasks, their training log appended to one ``strategies`` table and read back."""
    log = scratch_path(spark, "strategies", _uuid.uuid4().hex)
    for dataset, grid in GRIDS.items():
        table, _ = EP.train_grid(_scorer_rows(spark, sf, dataset), grid, dataset, log)
    return normalize(table)


#: One strategy in both layouts.
LAYOUTS = {
    "per_model": [EP.Scorer("strategy-1", t.model, EP.step_of(1e-5), 10) for t in C.CHAINS["flan"]],
    "pooled": [EP.Scorer("strategy-1", None, EP.step_of(1e-5), 10)],
}


@register(
    "scorer_layouts",
    sql=lambda: " UNION ALL ".join(
        "SELECT * FROM (" + _fit_sql(
            O.scorer_rows_sql("boolq", ("flan",)), scorers,
            f"SELECT strategy, {O.q(layout)} AS layout, model, n_train, n_val, CAST(e AS BIGINT) AS epoch, round(val_loss, 6) AS val_loss FROM curve WHERE kept",
        ) + f") x{layout}" for layout, scorers in LAYOUTS.items()
    ),
)
def q_scorer_layouts(spark, sf):
    """A strategy's scorers per model and its pooled one: rows, kept epoch and its validation loss."""
    curve = EP.curve_table(spark, EP.train(_examples(spark, sf, ("flan",)), [s for scorers in LAYOUTS.values() for s in scorers])[0])
    layout = F.when(F.col("model").isNull(), "pooled").otherwise("per_model")
    return normalize(curve.where("kept").select("strategy", layout.alias("layout"), "model", "n_train", "n_val", "epoch", "val_loss"))


def _cascade_fitted_sql() -> str:
    parts = []
    for layout, scorers in LAYOUTS.items():
        result = f"""SELECT {O.q(layout)} AS layout, threshold, CAST(tier AS BIGINT) AS tier, count(*) AS accepted FROM (
            SELECT prompt_id, threshold, min(CASE WHEN tier = 3 OR 1 / (1 + exp(-z)) > threshold THEN tier END) AS tier
            FROM logits JOIN ex ON ex.rid = logits.rid CROSS JOIN {O.thresholds_values(C.THRESHOLDS_BOOLQ)} GROUP BY prompt_id, threshold) t GROUP BY ALL"""
        parts.append(f"SELECT * FROM ({_fit_sql(O.scorer_rows_sql('boolq', ('flan',)), scorers, result)}) f_{layout}")
    return " UNION ALL ".join(parts)


@register("cascade_fitted", sql=_cascade_fitted_sql)
def q_cascade_fitted(spark, sf):
    """C2 + C5: the gate reads the scorer registry, once with a scorer per model and once with the pooled one: accepted prompts per
    threshold and tier."""
    prompts, answers = FX.stored_answers(spark, sf)
    data = _examples(spark, sf, ("flan",))
    out = []
    for layout, scorers in LAYOUTS.items():
        registry = EP.registry_table(spark, EP.train(data, scorers)[1])
        cells = cascade.sweep_cells(prompts, answers, EP.registry_scores(data, registry), "boolq", ("strategy-1",))
        out.append(cells.groupBy("threshold", "tier").agg(F.sum("_n").alias("accepted")).select(F.lit(layout).alias("layout"), "threshold", "tier", "accepted"))
    return normalize(out[0].unionByName(out[1]))


# ---------------------------------------------------------------------------------------------------------------
# Streams (oracle = the batch answer on what the stream may emit)
# ---------------------------------------------------------------------------------------------------------------

from .streaming import cascade as SCS  # noqa: E402
from .streaming import jobs as ST  # noqa: E402


@register(
    "stream_energy",
    sql=lambda: f"""WITH e AS (SELECT CAST(v.ts AS TIMESTAMP) AS ts, b.run, b.energy_kwh FROM ({O.batch_records_sql()}) b JOIN events v ON b.event_id = v.event_id),
    wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM e),
    agg AS (SELECT date_trunc('day', ts) AS ws, run, count(*) AS batches, sum(energy_kwh * 1000.0) AS energy FROM e GROUP BY ALL)
    SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, run, batches, round(energy, 6) AS energy_wh
    FROM agg CROSS JOIN wm WHERE ws + INTERVAL 1 DAY <= wm.w""",
)
def q_stream_energy(spark, sf):
    """Closed 1-day windows per run (watermark 1 hour; the last, still open day is not emitted)."""
    source = scratch_path(spark, "stream_energy_in", _uuid.uuid4().hex)
    records = FX.batch_records(spark, sf).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "run", "energy_kwh")
    records.write.parquet(source)
    return normalize(ST.stream_energy(spark, source, records.schema))


@register("stream_gate", sql=_route_sql)
def q_stream_gate(spark, sf):
    """The gate of every tier and strategy as a stream with two sinks."""
    return normalize(ST.stream_gate(spark, _gated(spark, sf), 0.8))


@register(
    "stream_cascade",
    sql=lambda: f"SELECT strategy, prompt_id, CAST(tier AS BIGINT) AS tier, CAST(pred AS BIGINT) AS pred, CASE WHEN tier < n_tiers THEN score END AS score "
    f"FROM ({O.sweep_final_sql('boolq', tuple(C.STRATEGIES), (0.8,))}) f",
)
def q_stream_cascade(spark, sf):
    """C1 / T2 as a stream over all tiers and strategies: answers and scores arrive in any order, some twice."""
    answers, scores = FX.arriving_run(spark, sf)
    accepted = SCS.stream_cascade(spark, answers, scores, *SCS.new_stream(spark), threshold=0.8, delay="2 hours")
    return normalize(accepted.select("strategy", "prompt_id", "tier", "pred", "score"))


@register("stream_dedup", sql=lambda: f"SELECT project_name, energy_consumed FROM ({O.emission_records_sql()}) r")
def q_stream_dedup(spark, sf):
    """First arrival wins within the watermark; the changed copies arrive later and are dropped."""
    from .functions.hashing import h as _h, key as _key

    recs = FX.emission_records(spark, sf).select("project_name", "run_id", F.col("timestamp").alias("ts"), "energy_consumed")
    first = recs.select("project_name", "ts", "energy_consumed")
    again = recs.where(_h(_key(F.col("run_id"), "-dup")) < 10).select(
        "project_name", "ts", (F.col("energy_consumed") * F.lit(1.5)).alias("energy_consumed")
    )
    return normalize(ST.stream_dedup(spark, first, again))


@register(
    "stream_last_wins",
    sql=lambda: f"SELECT project_name, arg_max(energy_consumed, file_order) AS energy_consumed, count(*) AS copies FROM ({_dup_records_sql()}) d GROUP BY project_name",
)
def q_stream_last_wins(spark, sf):
    """T3 / A11 as a stream: changed copies arrive after their first record, and the last one wins."""
    base = scratch_path(spark, "stream_last_wins", _uuid.uuid4().hex)
    rows = _dup_records(spark, sf).withColumn("file_order", F.col("file_order").cast("long"))
    for order in (0, 1):
        rows.where(F.col("file_order") == order).write.parquet(f"{base}/in/{order}")
    return normalize(ST.stream_last_wins(spark, f"{base}/in/*", f"{base}/table", f"{base}/ckpt"))


# ---------------------------------------------------------------------------------------------------------------
# Tracker logs
# ---------------------------------------------------------------------------------------------------------------

from .sources import tracker_logs as TL  # noqa: E402


def _tracker_sql() -> str:
    d = "duration_s"
    dur = f"CAST(trunc({d} / 3600) AS BIGINT) * 3600 + CAST(trunc(({d} % 3600) / 60) AS BIGINT) * 60 + CAST(printf('%05.2f', {d} % 60) AS DOUBLE)"
    cpu_none = f"{O.sql_h(O.sql_key('event_id', O.q('-cpu')))} < {FX.CPU_NONE_PCT}"
    return f"""SELECT run, CAST(batch AS BIGINT) AS batch, {O.q(FX.TRACKER_VERSION)} AS version, CAST({FX.TRACKER_PUE} AS DOUBLE) AS pue, {dur} AS duration_s,
      energy_kwh * 1e5 AS gpu_w_total, CASE WHEN {cpu_none} THEN NULL ELSE energy_kwh * 7e4 + energy_kwh * 5e4 END AS cpu_w_total,
      CAST({FX.INTENSITY_G_PER_KWH} AS DOUBLE) AS intensity_g_kwh, energy_kwh, energy_kwh * {FX.INTENSITY_G_PER_KWH!r} AS co2_g,
      energy_kwh * {FX.INTENSITY_G_PER_KWH!r} * {FX.KM_PER_G!r} AS km
    FROM ({O.batch_records_sql()}) b"""


@register("scan_tracker_logs", sql=_tracker_sql)
def q_scan_tracker_logs(spark, sf):
    """Tracker logs generated per batch record, written as shard documents, scanned and parsed back."""
    base = scratch_path(spark, "tracker_logs", _uuid.uuid4().hex)
    TL.write_logs(FX.log_documents(FX.batch_records(spark, sf)), base)
    t = TL.scan_tracker_logs(spark, base)
    return normalize(
        t.select(
            "run", "batch", "version", "pue", "duration_s",
            F.aggregate("gpu_w", F.lit(0.0), lambda a, x: a + x).alias("gpu_w_total"),
            F.aggregate("cpu_w", F.lit(0.0), lambda a, x: a + x).alias("cpu_w_total"),
            "intensity_g_kwh", "energy_kwh", "co2_g", "km",
        )
    )


@register(
    "grid",
    sql=lambda: f"""WITH r AS (SELECT {O.run_parts_sql()} FROM ({O.emission_records_sql()}) x)
    SELECT s.strategy, t.threshold FROM (SELECT DISTINCT strategy FROM r WHERE threshold IS NOT NULL) s
    CROSS JOIN (SELECT DISTINCT threshold FROM r WHERE threshold IS NOT NULL) t""",
)
def q_grid(spark, sf):
    """Strategies x thresholds of the measured runs (run names parsed from the emission records)."""
    recs = FX.emission_records(spark, sf)
    parts = EN.parse_project_name(F.col("project_name"), EM.DATASET)
    runs = recs.select(parts["strategy"].alias("strategy"), parts["threshold"].alias("threshold"))
    return normalize(CV.strategy_threshold_grid(runs))
