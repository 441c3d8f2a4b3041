"""Step functions of a threshold, summed over a grid of thresholds.

A row that applies to the thresholds ``low <= t < high`` is one row, however long the grid is. Its two ends are looked up
in the sorted grid; summing +value at the low end and -value at the high end gives a table of differences of at most a few
rows per key and grid point, and running sums over that table give the value at every threshold. Values are integers or
decimals, so a running sum of differences is exact.

The grid is a table of any size. It is taken in blocks of at most ``BLOCK`` thresholds, the only part of it that the
driver holds; a usual grid is one block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import row_number_by

BLOCK = 1 << 16


def thresholds_table(spark: SparkSession, thresholds: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")


def grid_blocks(spark: SparkSession, thresholds: DataFrame | Sequence[float], block: int = BLOCK) -> Iterator[np.ndarray]:
    """The distinct thresholds, ascending, in arrays of at most ``block``; nulls are left out."""
    if not isinstance(thresholds, DataFrame):
        values = np.unique(np.array(list(thresholds), float))
        yield from (values[i : i + block] for i in range(0, len(values), block))
        return
    grid = thresholds.select(F.col("threshold").cast("double").alias("threshold")).where("threshold is not null").distinct()
    some = grid.limit(block + 1).toPandas()["threshold"].to_numpy()
    if len(some) <= block:
        if len(some):
            yield np.sort(some)
        return
    numbered = row_number_by(grid.withColumn("all", F.lit(0)), ["all"], ["threshold"], out="nth")
    numbered = numbered.select("threshold", F.floor((F.col("nth") - 1) / block).alias("block"))
    for i in range(numbered.agg(F.max("block")).first()[0] + 1):
        yield np.sort(numbered.where(F.col("block") == i).select("threshold").toPandas()["threshold"].to_numpy())


def _places(intervals: DataFrame, grid: np.ndarray) -> DataFrame:
    """``intervals`` that hold a grid point, with ``lo`` and ``hi``: they apply to grid points lo <= i < hi."""

    @F.pandas_udf("lo int, hi int")
    def search(low: pd.Series, high: pd.Series) -> pd.DataFrame:
        a = np.where(low.isna(), 0, np.searchsorted(grid, low.to_numpy(float), side="left"))
        b = np.where(high.isna(), len(grid), np.searchsorted(grid, high.to_numpy(float), side="left"))
        return pd.DataFrame({"lo": a.astype("int32"), "hi": b.astype("int32")})

    return intervals.withColumn("ends", search("low", "high")).select("*", "ends.*").drop("ends", "low", "high").where("lo < hi")


def _with_threshold(rows: DataFrame, grid: np.ndarray) -> DataFrame:
    """``rows`` with the threshold of grid point ``at`` in its place."""

    @F.pandas_udf("double")
    def value(at: pd.Series) -> pd.Series:
        return pd.Series(grid[at.to_numpy()])

    return rows.withColumn("threshold", value("at")).drop("at")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sums_on_grid(intervals: DataFrame, keys: Sequence[str], values: dict[str, Column], thresholds: DataFrame | Sequence[float], block: int = BLOCK) -> DataFrame:
    """(keys..., threshold, values...): the sum of each value over the intervals that hold the threshold.

    ``intervals``: (keys..., low, high, ...) with null for an open end. A key without any interval at a threshold has no row
    there. ``values`` are integer or decimal columns.
    """
    keys, names = list(keys), list(values)
    spark = intervals.sparkSession

    def on(grid: np.ndarray) -> DataFrame:
        placed = _places(intervals.select(*keys, "low", "high", *(v.alias(n) for n, v in values.items())).withColumn("_rows", F.lit(1).cast("long")), grid)
        ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("sign")))).alias("end")
        steps = placed.select(*keys, "_rows", *names, ends).where(F.col("end.at") < len(grid))
        steps = steps.groupBy(*keys, F.col("end.at").alias("at")).agg(*(F.sum(F.when(F.col("end.sign") > 0, F.col(n)).otherwise(-F.col(n))).alias(n) for n in ("_rows", *names)))
        so_far = Window.partitionBy(*keys).orderBy("at")
        level = steps.select(*keys, "at", F.lead("at", 1, len(grid)).over(so_far).alias("next"), *(F.sum(n).over(so_far).alias(n) for n in ("_rows", *names)))
        level = level.where("_rows > 0").select(*keys, F.explode(F.sequence("at", F.col("next") - 1)).alias("at"), *names)
        return _with_threshold(level, grid).select(*keys, "threshold", *names)

    blocks = list(grid_blocks(spark, thresholds, block)) or [np.zeros(0)]
    return _union([on(g) for g in blocks])


def rows_on_grid(intervals: DataFrame, thresholds: DataFrame | Sequence[float], block: int = BLOCK) -> DataFrame:
    """``intervals`` repeated at every threshold that they hold, for results that are rows per threshold."""

    def on(grid: np.ndarray) -> DataFrame:
        placed = _places(intervals, grid)
        rows = placed.select("*", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("at")).drop("lo", "hi")
        return _with_threshold(rows, grid)

    blocks = list(grid_blocks(intervals.sparkSession, thresholds, block)) or [np.zeros(0)]
    return _union([on(g) for g in blocks])
