"""Structured Streaming jobs.

The studied runner appends one emission record per batch while it runs and routes rows batch by batch; as
streams:

* ``stream_energy`` (T1): per-run energy in tumbling event-time windows with a watermark, append mode - a window
  is emitted once the watermark passes its end; a row older than the watermark in force for late rows (the one
  set by the previous micro-batch) is dropped;
* ``stream_gate`` (T2): the gate as a stateless stream; ``foreachBatch`` writes each micro-batch to an accepted
  and an escalated table, overwriting that micro-batch's partition so a replayed batch is not written twice;
* ``stream_dedup`` (T3): duplicate emission records removed with ``dropDuplicatesWithinWatermark`` - the *first*
  arrival wins;
* ``stream_last_wins`` (T3 / A11): the *last* record of a key wins, as in the batch job. The result table is the state:
  hash buckets of keys are points of a ``point_table``, a micro-batch rewrites the buckets that it touches, and its
  number is committed with them, so a replayed micro-batch changes nothing.

All sinks are parquet with a checkpoint location under the shared checkpoint folder, and every run uses
``availableNow`` so it drains what is there and stops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gate import accepted_condition
from ..session import scratch_path
from ..sources.point_table import read_points, snapshot, write_points


def _run_to_parquet(stream: DataFrame, out: str, ckpt: str, mode: str = "append") -> None:
    q = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def record_stream(spark: SparkSession, source: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of arriving Parquet files of emission records as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source)


def stream_energy(
    spark: SparkSession, source: str, schema, window: str = "1 day", delay: str = "1 hour", files_per_trigger: int | None = None,
) -> DataFrame:
    """(window_start, run, batches, energy_wh) for windows closed by the watermark.

    ``source`` holds records (ts, run, energy_kwh), ``ts`` a wall-clock time (``timestamp_ntz``) read as UTC: the
    conversion there and back names the zones itself, so neither windows nor the rendered start depend on the session.
    """
    here = F.current_timezone()
    run = uuid.uuid4().hex
    path = scratch_path(spark, "stream_energy", run, "out")
    records = record_stream(spark, source, schema, files_per_trigger)
    rows = records.select(F.convert_timezone(F.lit("UTC"), here, "ts").cast("timestamp").alias("ts"), "run", "energy_kwh")
    agg = (
        rows.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "run")
        .agg(F.count(F.lit(1)).alias("batches"), F.sum(F.col("energy_kwh") * F.lit(1000.0)).alias("energy_wh"))
    )
    start = F.convert_timezone(here, F.lit("UTC"), F.col("window.start").cast("timestamp_ntz"))
    out = agg.select(F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("window_start"), "run", "batches", "energy_wh")
    _run_to_parquet(out, path, scratch_path(spark, "stream_energy", run, "ckpt"))
    res = spark.read.parquet(path)
    return res.select("window_start", "run", "batches", F.round("energy_wh", 6).alias("energy_wh"))


def stream_gate(spark: SparkSession, scored: DataFrame, threshold: float) -> DataFrame:
    """``scored`` (strategy, prompt_id, tier, score) is staged as files, streamed, and routed to two sinks."""
    run = uuid.uuid4().hex
    src = scratch_path(spark, "stream_gate", run, "src")
    scored.write.mode("overwrite").parquet(src)
    acc_path = scratch_path(spark, "stream_gate", run, "accepted")
    esc_path = scratch_path(spark, "stream_gate", run, "escalated")
    stream = spark.readStream.schema(scored.schema).parquet(src)

    def route(batch: DataFrame, batch_id: int) -> None:
        acc = accepted_condition(F.col("score"), F.lit(float(threshold)))
        tagged = batch.withColumn("batch_id", F.lit(batch_id))
        for cond, path in ((acc, acc_path), (~acc, esc_path)):
            (
                tagged.where(cond).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id").parquet(path)
            )

    q = (
        stream.writeStream.foreachBatch(route)
        .option("checkpointLocation", scratch_path(spark, "stream_gate", run, "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    cols = scored.columns
    acc = spark.read.schema(scored.schema).parquet(acc_path).select(*cols, F.lit("accept").alias("route"))
    esc = spark.read.schema(scored.schema).parquet(esc_path).select(*cols, F.lit("escalate").alias("route"))
    return acc.unionByName(esc)


def stream_dedup(spark: SparkSession, first: DataFrame, again: DataFrame, delay: str = "2 days") -> DataFrame:
    """``first`` arrives and is processed, then ``again`` (copies, changed values); copies of a key already seen
    within the watermark are dropped. Both frames: (project_name, ts timestamp, energy_consumed).

    State holds the keys of the last ``delay`` of event time, so ``delay`` bounds it: how late a copy may arrive.
    """
    run = uuid.uuid4().hex
    src = scratch_path(spark, "stream_dedup", run, "src")
    out, ckpt = scratch_path(spark, "stream_dedup", run, "out"), scratch_path(spark, "stream_dedup", run, "ckpt")
    for name, frame in (("a", first), ("b", again)):
        frame.write.mode("overwrite").parquet(f"{src}/{name}")
        stream = spark.readStream.schema(first.schema).parquet(f"{src}/*/")
        dedup = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["project_name"])
        _run_to_parquet(dedup, out, ckpt)
    return spark.read.parquet(out).select("project_name", "energy_consumed")


def stream_last_wins(spark: SparkSession, source: str, base: str, checkpoint: str, buckets: int = 64, files_per_trigger: int | None = None) -> DataFrame:
    """T3 with A11's rule: drain the Parquet folder ``source`` of records (project_name, energy_consumed, file_order) into the
    table at ``base`` and return it: (project_name, energy_consumed, copies) with the value of the highest ``file_order`` (of
    equal ones the larger value). After every micro-batch the table equals ``energy_dedup`` of the records so far.

    ``buckets`` bounds what a micro-batch rewrites: a record rewrites 1 / ``buckets`` of the table.
    """
    limit = {"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {}
    records = spark.readStream.schema("project_name string, energy_consumed double, file_order long").options(**limit).parquet(source)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        here = batch.sparkSession
        number, _, mark = snapshot(here, base)
        if mark is not None and mark >= batch_id:
            return  # committed before a restart
        fresh = batch.select("project_name", "energy_consumed", "file_order", F.lit(1).cast("long").alias("copies"))
        rows = fresh.withColumn("bucket", F.pmod(F.xxhash64("project_name"), F.lit(buckets)).cast("int"))
        if number:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
            rows = rows.unionByName(read_points(here, base, ["bucket"]).where(F.col("bucket").isin(touched)))
        last = F.max_by("energy_consumed", F.struct("file_order", "energy_consumed"))
        merged = rows.groupBy("bucket", "project_name").agg(last.alias("energy_consumed"), F.max("file_order").alias("file_order"), F.sum("copies").alias("copies"))
        write_points(merged, base, ["bucket"], mark=batch_id)

    q = records.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return read_points(spark, base, ["bucket"]).select("project_name", "energy_consumed", "copies")
