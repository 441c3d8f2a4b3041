"""Distributed row numbering (W1 at scale).

``row_number() OVER (PARTITION BY k ORDER BY o)`` with a low-cardinality ``k`` (one dataset, one run) sorts a
whole key in one task. Here instead:

1. range-partition on (k, o) and sort within partitions - every task gets a contiguous slice of the order;
2. tag each row with its partition id and ``monotonically_increasing_id`` (consecutive inside a partition);
3. checkpoint that narrow table to the shared checkpoint folder, so the partitioning and ids are fixed even if
   executors are lost and stages re-run;
4. count rows per (partition, k) - a table of at most (#partitions + #keys) rows - and turn it into offsets
   with a running sum over partition ids;
5. row number = offset of (partition, k) + position inside the partition slice.

Result equals the single-window version for any total order ``o`` (include a unique column in it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_width


def row_number_by(
    df: DataFrame,
    partition_cols: Sequence[str],
    order_cols: Sequence[str],
    out: str = "rn",
    num_partitions: int | None = None,
) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or shuffle_width(spark)
    keys = list(partition_cols)
    order = list(order_cols)
    ranged = df.repartitionByRange(n, *[F.col(c) for c in keys + order]).sortWithinPartitions(*keys, *order)
    tagged = ranged.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    tagged = tagged.checkpoint(eager=True)
    stats = tagged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    stats = stats.select(
        F.col("_pid").alias("_spid"), *renamed, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    # null-safe join on the grouping keys (a null key is its own partition, as in a window); the stats side holds
    # at most (#partitions + #keys) rows, so AQE turns this into a broadcast join when it is small
    cond = [F.col("_pid") == F.col("_spid")] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = tagged.join(stats, cond).select(
        *[F.col(c) for c in df.columns],
        (F.col("_off") + (F.col("_mid") - F.col("_first")) + F.lit(1)).alias(out),
    )
    return joined
