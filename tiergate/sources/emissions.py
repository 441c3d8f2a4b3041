"""Emission records: one row per measured batch (S3, S8), and their CSV layout.

Layout on disk, as the meter writes it: one folder per run named ``<dataset>_<run>``, holding ``emissions.csv``
with 31 columns. Spark writes the same table partitioned by that folder name (``folder=<dataset>_<run>/``). The scan
reads the CSV files of every folder whose name holds the dataset, in either layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_width

DATASET = "boolq_test_1k"

# The meter's 31 columns.
EMISSIONS_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("project_name", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("emissions", T.DoubleType()),
        T.StructField("emissions_rate", T.DoubleType()),
        T.StructField("cpu_power", T.DoubleType()),
        T.StructField("gpu_power", T.DoubleType()),
        T.StructField("ram_power", T.DoubleType()),
        T.StructField("cpu_energy", T.DoubleType()),
        T.StructField("gpu_energy", T.DoubleType()),
        T.StructField("ram_energy", T.DoubleType()),
        T.StructField("energy_consumed", T.DoubleType()),
        T.StructField("country_name", T.StringType()),
        T.StructField("country_iso_code", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("cloud_provider", T.StringType()),
        T.StructField("cloud_region", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("python_version", T.StringType()),
        T.StructField("codecarbon_version", T.StringType()),
        T.StructField("cpu_count", T.IntegerType()),
        T.StructField("cpu_model", T.StringType()),
        T.StructField("gpu_count", T.IntegerType()),
        T.StructField("gpu_model", T.StringType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("ram_total_size", T.DoubleType()),
        T.StructField("tracking_mode", T.StringType()),
        T.StructField("on_cloud", T.StringType()),
        T.StructField("pue", T.DoubleType()),
    ]
)


def write_emissions(records: DataFrame, base: str) -> None:
    """Write one CSV set per run folder. Dynamic partition overwrite: re-running a run replaces only its folder.

    Range partitioning on (folder, project_name) gives each task a contiguous slice: a run holding a third of all
    records is written by many tasks (a few files in its folder), never by one.
    """
    n = shuffle_width(records.sparkSession)
    (
        records.repartitionByRange(n, "folder", "project_name")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("folder")
        .csv(base)
    )


def scan_emissions(spark: SparkSession, base: str, dataset: str = DATASET) -> DataFrame:
    """S3: every run folder whose name holds ``dataset``; declared schema, folder from the file path."""
    df = (
        spark.read.schema(EMISSIONS_SCHEMA)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.csv")
        .csv(f"{base.rstrip('/')}/*{dataset}*/")
    )
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, "/(?:folder=)?([^/]+)/[^/]+$", 1).alias("folder"), path.alias("file_path"))
