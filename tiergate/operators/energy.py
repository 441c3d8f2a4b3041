"""Energy roll-ups.

Per-batch energy is rounded to 3 decimals of Wh *before* it is averaged and summed, through a decimal so the
rounding is the exact half-up of the printed value, not of the nearest binary double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wh_rounded(kwh: Column) -> Column:
    return F.round((kwh * F.lit(1000)).cast("decimal(18,9)"), 3)


def parse_project_name(name: Column, dataset: str) -> dict[str, Column]:
    """``<dataset>_<run>_<batch>`` with a known dataset prefix (runs may hold '_'), and
    ``run = <strategy>-<threshold>`` split at the last '-'. A run without a number there is a single model: threshold
    null, strategy = run. The record of another data set gives nulls."""
    rest = F.when(name.startswith(f"{dataset}_"), F.substr(name, F.lit(len(dataset) + 2)))
    run = F.regexp_extract(rest, "^(.*)_[^_]*$", 1)
    threshold = F.substring_index(run, "-", -1).try_cast("double")
    strategy = F.when(threshold.isNull(), run).otherwise(F.regexp_extract(run, "^(.*)-[^-]*$", 1))
    return {
        "run": run,
        "batch": F.substring_index(rest, "_", -1).try_cast("bigint"),
        "strategy": strategy,
        "threshold": threshold,
    }


def energy_batches(records: DataFrame, dataset: str) -> DataFrame:
    """(run, batch, project_name, energy_wh): one row per record, Wh rounded to 3 decimals."""
    parts = parse_project_name(F.col("project_name"), dataset)
    return records.select(
        *(parts[k].alias(k) for k in ("run", "batch", "strategy", "threshold")), "project_name",
        wh_rounded(F.col("energy_consumed")).alias("energy_wh"),
    )


def energy_rollup(batches: DataFrame) -> DataFrame:
    """A9 (+ A10, O2): per run, number of batches, mean and total of the rounded per-batch Wh, in run order."""
    agg = batches.groupBy("run").agg(F.count(F.lit(1)).alias("batches"), F.sum("energy_wh").alias("_total"))
    return agg.select(
        "run", "batches",
        (F.col("_total").cast("double") / F.col("batches")).alias("avg_wh"),
        F.col("_total").cast("double").alias("total_wh"),
    ).orderBy("run")


def energy_dedup(records: DataFrame, order_col: str = "file_order") -> DataFrame:
    """The last record per ``project_name`` wins (``max_by`` on the file order); no row is dropped blindly."""
    return records.groupBy("project_name").agg(
        F.max_by(F.col("energy_consumed"), F.col(order_col)).alias("energy_consumed"),
        F.count(F.lit(1)).alias("copies"),
    )


def energy_lookup(batches: DataFrame, strict_reference: bool = False) -> DataFrame:
    """The studied loop looks up keys ``<run>_0 .. <run>_{n-1}`` where n = number of records of the run, so a gap
    also drops the run's last batches. Here every record stays, and ``indexed`` tells whether that loop would reach
    it; ``strict_reference=True`` keeps only those.

    Implemented as a join against per-run counts (one row per run), not as an exploded index sequence.
    """
    counts = batches.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    out = batches.join(counts, "run").withColumn("indexed", F.coalesce(F.col("batch") < F.col("_n"), F.lit(False))).drop("_n")
    return out.where("indexed") if strict_reference else out


def energy_gaps(lookup: DataFrame) -> DataFrame:
    """(run, batches, dropped): how many records of each run the index loop misses."""
    return lookup.groupBy("run").agg(F.count(F.lit(1)).alias("batches"), F.count(F.when(~F.col("indexed"), F.lit(1))).alias("dropped"))
