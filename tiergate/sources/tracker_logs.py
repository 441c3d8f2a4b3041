"""Tracker logs (S4): free-text logs, one set per measured batch, parsed into one row per batch.

The tracker writes small files, ``<data>_<run>/carbon_tracker/<batch>__<pid>_<time>_carbontracker[_output].log``:
``scan_log_folders`` reads that layout. At scale a file per batch is too many, so ``write_logs`` stores documents as
JSON lines (run, batch, kind, value), as many to a file as the task holds, and ``scan_tracker_logs`` reads those.
``parse_logs`` is the same for both.

Parsing rules:
* power lines hold ``[a b ...]`` (space-padded lists) or ``None`` -> ``array<double>`` or null;
* the output log of batch *i* also carries the "Actual consumption" blocks of later batches, and predicted ones, so
  energy, CO2 and distance come from the **first** actual block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_SCHEMA = "run string, batch bigint, kind string, value string"


def write_logs(docs: DataFrame, base: str) -> None:
    """``docs``: (run, batch, kind = log | output, value), one JSON line each."""
    docs.select("run", "batch", "kind", "value").write.mode("overwrite").json(base)


def _num(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def _list(text: Column, pattern: str) -> Column:
    raw = F.regexp_extract(text, pattern, 1)
    inner = F.trim(F.regexp_replace(raw, "[\\[\\]]", ""))
    return F.when((raw == "") | (raw == "None"), F.lit(None).cast("array<double>")).otherwise(
        F.transform(F.split(inner, " +"), lambda x: x.try_cast("double"))
    )


def parse_logs(docs: DataFrame) -> DataFrame:
    """(run, batch, version, pue, duration_s, gpu_w, cpu_w, intensity_g_kwh, energy_kwh, co2_g, km) of log documents."""
    value = F.col("value")
    took = lambda i: F.regexp_extract(value, "Duration: ([0-9]+):([0-9]{2}):([0-9.]+)", i).try_cast("double")
    first = F.regexp_extract(value, "(?s)Actual consumption(.*?km travelled)", 1)
    logs = docs.where(F.col("kind") == "log").select(
        "run", "batch",
        F.regexp_extract(value, "carbontracker version ([0-9.]+)", 1).alias("version"),
        _num(value, "PUE coefficient of ([0-9]+(?:[.][0-9]+)?)").alias("pue"),
        (took(1) * 3600 + took(2) * 60 + took(3)).alias("duration_s"),
        _list(value, "for gpu: (None|\\[[^\\]]*\\])").alias("gpu_w"),
        _list(value, "for cpu: (None|\\[[^\\]]*\\])").alias("cpu_w"),
        _num(value, "during training was ([0-9]+(?:[.][0-9]+)?) gCO2/kWh").alias("intensity_g_kwh"),
    )
    outs = docs.where(F.col("kind") == "output").select("run", "batch", first.alias("block")).select(
        "run", "batch",
        _num(F.col("block"), "Energy:\t([0-9.eE+-]+) kWh").alias("energy_kwh"),
        _num(F.col("block"), "CO2eq:\t([0-9.eE+-]+) g").alias("co2_g"),
        _num(F.col("block"), "\t([0-9.eE+-]+) km travelled").alias("km"),
    )
    return logs.join(outs, ["run", "batch"], "full")


def scan_tracker_logs(spark: SparkSession, base: str) -> DataFrame:
    """S4, our layout."""
    return parse_logs(spark.read.schema(DOCUMENT_SCHEMA).json(base))


def scan_log_folders(spark: SparkSession, base: str, dataset: str) -> DataFrame:
    """S4, the tracker's layout: the log and output files of every ``<dataset>_<run>/carbon_tracker`` folder. Error logs
    are left out; a batch without an output file keeps its row, with null energy."""
    raw = spark.read.option("pathGlobFilter", "*_carbontracker*.log").text(f"{base.rstrip('/')}/{dataset}_*/carbon_tracker", wholetext=True)
    path = F.col("_metadata.file_path")
    docs = raw.select(
        F.regexp_extract(path, f"/{dataset}_([^/]+)/carbon_tracker/", 1).alias("run"),
        F.regexp_extract(path, "/([0-9]+)__[^/]*$", 1).try_cast("bigint").alias("batch"),
        F.when(path.endswith("_carbontracker.log"), "log").when(path.endswith("_carbontracker_output.log"), "output").alias("kind"),
        "value",
    )
    return parse_logs(docs.where(F.col("kind").isNotNull() & F.col("batch").isNotNull()))
