"""Scans of the driver's parquet tables, with explicit column lists so only needed columns are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan of fewer splits than cores by a hash of ``keys`` before CPU-heavy per-row work.

    A small Parquet file is one split, so every rule, hash and UDF of the stage would run in one task. Inputs of many
    splits are left alone; the rows are the same either way. Planning a scan to count its splits runs no job.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *keys)
