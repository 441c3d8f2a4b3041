"""Result tables and cost-versus-quality curves.

* quality rows are written in the published layout (``Model, Threshold, M-Pre, M-Rec, M-F1``, x100, 1 digit,
  rounded through a decimal so the printed value is the exact half-up of the stored one);
* ``sink_results`` commits grid points (``sources.point_table``): re-running one (strategy, threshold) replaces that point
  and keeps all others (the studied loop re-reads and re-writes a CSV);
* ``cost_quality`` full-outer-joins quality with measured energy on (strategy, threshold) - a key present on one side
  only keeps its row with nulls on the other - and adds the single models at every threshold;
* single-model baselines are one row per model, attached to every threshold of the sweep by a literal-array
  ``explode`` (no cross join), and ``curve_series`` folds each strategy's points into one ordered string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators.metrics import macro_prf_from_cells
from ..session import staged
from ..sources.point_table import read_points, write_points
from . import cascade

# Column names of the published result files.
QUALITY_COLUMNS = ("Model", "Threshold", "M-Pre", "M-Rec", "M-F1")
QUALITY_SCHEMA = "`Model` string, `Threshold` double, `M-Pre` double, `M-Rec` double, `M-F1` double"


def pct1(x: Column) -> Column:
    """x100 with one decimal, half-up on the decimal value."""
    return F.round((x * F.lit(100)).cast("decimal(18,6)"), 1).cast("double")


def quality_rows(sweep: DataFrame) -> DataFrame:
    return sweep.select(
        F.col("strategy").alias("Model"), F.col("threshold").alias("Threshold"),
        pct1(F.col("m_pre")).alias("M-Pre"), pct1(F.col("m_rec")).alias("M-Rec"), pct1(F.col("m_f1")).alias("M-F1"),
    )


def write_quality_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def union_results(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Read many result files with one declared schema and stack them by column name."""
    frames = [spark.read.schema(QUALITY_SCHEMA).option("header", True).csv(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


POINT = ("Model", "Threshold")


def sink_results(rows: DataFrame, base: str) -> int:
    """Write quality rows; the grid points that ``rows`` hold are replaced, all others stay. The commit's number."""
    return write_points(rows, base, POINT)


def read_results(spark: SparkSession, base: str) -> DataFrame:
    """The current quality rows of every grid point."""
    return read_points(spark, base, POINT)


def baselines(prompts: DataFrame, answers: DataFrame, dataset: str = "boolq", chains: Sequence[str] = ("flan", "phi")) -> DataFrame:
    """Each model alone on every prompt: (chain, model, tier, m_f1, energy_wh) with the C7 cost model.

    One read of prompts and answers: quality and cost both come from the cells of one aggregation, written once.
    """
    names = F.array(*[F.struct(F.lit(ch).alias("chain"), F.lit(t.model).alias("m"), F.lit(cascade.model_rate(t.tier)).alias("rate")) for ch in chains for t in C.CHAINS[ch]])
    lab = cascade.labelled_answers(prompts, answers, dataset, cascade.chain_models(*chains))
    lab = lab.select("model", "tier", "gold", "pred", (F.length("prompt_text") / F.lit(1000.0)).alias("kchar"), F.explode(names).alias("n"))
    lab = lab.where(F.col("n.m") == F.col("model"))
    keys = [F.col("n.chain").alias("chain"), "model", "tier"]
    cells = staged(
        lab.groupBy(*keys, F.col("gold").alias("_g"), F.col("pred").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("kchar") * F.col("n.rate")).alias("_wh")),
        "baseline-cells",
    )
    f1 = macro_prf_from_cells(cells.where(F.col("_g").isNotNull() & F.col("_p").isNotNull()), ["chain", "model", "tier"]).select("chain", "model", "tier", "m_f1")
    cost = cells.groupBy("chain", "model", "tier").agg(F.round(F.sum("_wh"), 6).alias("energy_wh"))
    return f1.join(cost, ["chain", "model", "tier"])


def baseline_broadcast(base: DataFrame, thresholds: Sequence[float] = C.THRESHOLDS_BOOLQ) -> DataFrame:
    """Every baseline row repeated at every threshold (a generate over a literal array)."""
    return base.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))


def sweep_points(cells: DataFrame) -> DataFrame:
    """(strategy, threshold, m_f1, energy_wh) of a sweep: its cells - a few rows per grid point - are written once, and
    quality and modelled cost are both read from them."""
    cells = staged(cells, "sweep-cells")
    quality = cascade.quality_from_cells(cells).select("strategy", "threshold", "m_f1")
    return quality.join(cascade.cost_from_cells(cells).select("strategy", "threshold", "energy_wh"), ["strategy", "threshold"], "full")


def measured_energy(batches: DataFrame) -> DataFrame:
    """(strategy, threshold, measured_wh) of emission batches; threshold is null for a model measured alone."""
    return batches.groupBy("strategy", "threshold").agg(F.sum("energy_wh").cast("double").alias("measured_wh"))


def cost_quality(points: DataFrame, single: DataFrame, measured: DataFrame, thresholds: Sequence[float] = C.THRESHOLDS_BOOLQ) -> DataFrame:
    """J9 + J10 + C8: (kind, strategy, threshold, m_f1, energy_wh, measured_wh).

    ``points``: quality and modelled energy of every (strategy, threshold); ``single``: each model alone (model, m_f1,
    energy_wh), drawn at every threshold; ``measured``: energy from emission records. Full outer joins: a point that
    was measured but has no quality row keeps its row, with a null, and so does one without a measurement.
    """
    grid = measured.where(F.col("threshold").isNotNull())
    curve = points.join(grid, ["strategy", "threshold"], "full")
    alone = measured.where(F.col("threshold").isNull()).select("strategy", "measured_wh")
    base = single.select(F.col("model").alias("strategy"), "m_f1", "energy_wh").join(alone, "strategy", "full")
    base = baseline_broadcast(base, thresholds)
    columns = ["strategy", "threshold", "m_f1", "energy_wh", "measured_wh"]
    return curve.select(F.lit("cascade").alias("kind"), *columns).unionByName(base.select(F.lit("single").alias("kind"), *columns))


def curve_series(points: DataFrame) -> DataFrame:
    """Per strategy, its points in threshold order as ``t:f1:wh|t:f1:wh|...``."""
    item = F.struct("threshold", "m_f1", "energy_wh")
    per = points.groupBy("strategy").agg(F.array_sort(F.collect_list(item)).alias("pts"), F.count(F.lit(1)).alias("points"))
    fmt = F.transform(
        "pts", lambda x: F.format_string("%.2f:%.9f:%.6f", x["threshold"], x["m_f1"], x["energy_wh"])
    )
    return per.select("strategy", "points", F.array_join(fmt, "|").alias("series"))


def strategy_threshold_grid(runs: DataFrame) -> DataFrame:
    """Every strategy seen in ``runs`` at every threshold seen in ``runs`` (the grid the studied mains loop over).

    No cross join: the distinct thresholds are one grid axis - a short list - read as a scalar subquery and
    exploded next to each distinct strategy.
    """
    axis = runs.where(F.col("threshold").isNotNull()).select(F.array_sort(F.collect_set("threshold"))).scalar()
    strategies = runs.where(F.col("threshold").isNotNull()).select("strategy").distinct()
    return strategies.select("strategy", F.explode(axis).alias("threshold"))
