"""Spark session helpers.

The library never sets cluster-level knobs on a session it did not create. ``get_session`` is for
tests, the bench and the command line; on a cluster the caller passes its own session.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "tiergate") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("TIERGATE_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIERGATE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder: ``spark.checkpoint.dir``, else what ``setCheckpointDir`` was given.

    Only a local master gets a fresh scratch folder where neither is set (tests, the bench): on a cluster a local
    folder would be another one on each machine, so that is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="tiergate-ckpt-", dir=os.environ.get("TIERGATE_SCRATCH", "/tmp"))
        spark.conf.set(CHECKPOINT_KEY, current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder, for written tables that cut lineage or round-trip a format."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "tiergate", *parts])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: whatever made it never runs again."""
    path = scratch_path(df.sparkSession, "staged", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for an explicit range repartition: ``spark.sql.shuffle.partitions``, which the user sizes to
    the data, and at least one partition per core. Takes no job to find out."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were started elsewhere than in the repository.

    Nothing is done where PYTHONPATH or the working folder already lead to it. Once for each application.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    app = spark.sparkContext.applicationId
    if root in known or app in _SHIPPED:
        return
    base = os.path.join(tempfile.mkdtemp(prefix="tiergate-zip-"), "tiergate")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "tiergate"))
    _SHIPPED.add(app)


_SHIPPED: set[str] = set()
