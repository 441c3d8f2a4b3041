"""Run outputs.

The studied runner writes one JSON document per run, ``<data>_<run>/output.json``: ``[[text, ...], [[start, end], ...]]``
- one text per prompt in length order, one time pair per batch.

* ``scan_output_json`` reads that layout: every run folder of a data set, one document each.
* ``write_run_output_json`` writes the same arrays as lines, one document per line for a bounded run of batches, many
  lines to a file and one folder per model, so neither a document nor the number of files follows the run's length;
  ``scan_run_output`` reads them. Texts and times of a document stand in one row: a text finds its batch's times by
  position, without a join.
* ``write_responses`` / ``read_responses`` are the native sink: ``responses`` and ``batches`` parquet tables
  partitioned by model; re-writing a model replaces only its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_width
from .run_folder import read_run_folders

LINE_BATCHES = 64  # batches in one line of our own layout
RUN_JSON = "first_batch bigint, texts array<string>, times array<array<double>>"


def write_run_output_json(answers: DataFrame, times: DataFrame, batch_size: int, base: str) -> None:
    """answers: (model, position, batch_id, response); times: (model, batch_id, start_ts, end_ts)."""
    first = (F.floor(F.col("batch_id") / LINE_BATCHES) * LINE_BATCHES).alias("first_batch")
    texts = answers.select("model", "position", "response", first).groupBy("model", "first_batch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "response"))), lambda x: x["response"]).alias("texts")
    )
    pairs = times.select("model", "batch_id", "start_ts", "end_ts", first).groupBy("model", "first_batch").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("batch_id", "start_ts", "end_ts"))), lambda x: F.array(x["start_ts"], x["end_ts"])
        ).alias("times")
    )
    lines = texts.join(pairs, ["model", "first_batch"]).select("model", F.to_json(F.struct("first_batch", "texts", "times"), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").partitionBy("model").text(base)


def _unfold(docs: DataFrame, batch_size: int, *keys: str) -> DataFrame:
    """One row per text of (keys..., first_batch, texts, times): position, batch and the batch's times."""
    rows = docs.select(*keys, "first_batch", "times", F.posexplode("texts").alias("i", "response"))
    nth = F.floor(F.col("i") / batch_size).cast("int")
    pair = F.get("times", nth)
    return rows.select(
        *keys, (F.col("first_batch") * batch_size + F.col("i") + 1).alias("position"), (F.col("first_batch") + nth).alias("batch_id"), "response",
        pair[0].alias("start_ts"), pair[1].alias("end_ts"),
    )


def scan_run_output(spark: SparkSession, base: str, batch_size: int) -> DataFrame:
    """S2, our layout: (model, position, batch_id, response, start_ts, end_ts)."""
    lines = spark.read.schema("value string, model string").text(base)
    return _unfold(lines.select("model", F.from_json("value", RUN_JSON).alias("d")).select("model", "d.*"), batch_size, "model")


def scan_output_json(spark: SparkSession, base: str, dataset: str, batch_size: int) -> DataFrame:
    """S2, the runner's layout: (run, position, batch_id, response, start_ts, end_ts) of every ``<dataset>_<run>/output.json``,
    read in byte ranges (``sources.run_folder``). A document that is not of that shape has no rows."""
    rows = read_run_folders(spark, base, batch_size, [dataset], skip_broken=True)
    return rows.select("run", "position", "batch_id", "response", "start_ts", "end_ts")


def write_responses(responses: DataFrame, batches: DataFrame, base: str) -> None:
    """``responses(model, prompt_id, batch_id, response)`` and ``batches(model, batch_id, start_ts, end_ts)``.

    Range partitioning on (model, batch_id): one model's run (the whole prompt table) is written by many tasks.
    """
    n = shuffle_width(responses.sparkSession)
    for name, df in (("responses", responses), ("batches", batches)):
        (
            df.repartitionByRange(n, "model", "batch_id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("model")
            .parquet(f"{base.rstrip('/')}/{name}")
        )


def read_responses(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{base.rstrip('/')}/responses"), spark.read.parquet(f"{base.rstrip('/')}/batches")


def batch_latency(responses: DataFrame, batches: DataFrame) -> DataFrame:
    """Per (model, batch): latency in seconds and mean answer length in characters."""
    lengths = responses.groupBy("model", "batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.length("response")), 6).alias("mean_answer_chars")
    )
    return lengths.join(batches, ["model", "batch_id"]).select(
        "model", "batch_id", "rows", F.round(F.col("end_ts") - F.col("start_ts"), 6).alias("latency_s"), "mean_answer_chars"
    )


def run_integrity(responses: DataFrame, batches: DataFrame, batch_size: int) -> DataFrame:
    """Answers per run and batches per run against ceil(answers / batch size)."""
    a = responses.groupBy("model").agg(F.count(F.lit(1)).alias("answers"))
    b = batches.groupBy("model").agg(F.countDistinct("batch_id").alias("batches"))
    j = a.join(b, "model", "full")
    expected = F.ceil(F.coalesce(F.col("answers"), F.lit(0)) / F.lit(batch_size)).cast("bigint")
    return j.select(
        "model", F.coalesce("answers", F.lit(0)).alias("answers"), F.coalesce("batches", F.lit(0)).alias("batches"),
        expected.alias("expected_batches"),
        (F.coalesce(F.col("batches"), F.lit(0)) == expected).alias("consistent"),
    )
