"""Streams: late rows behind the watermark are dropped; a replayed gate batch is not written twice."""

import datetime as dt

from pyspark.sql import functions as F

from tiergate.streaming import jobs


SCHEMA = "ts timestamp_ntz, run string, energy_kwh double"


def _arrivals(spark, src):
    def rows(hours, kwh):
        return [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), "strategy-1-0.8", kwh) for h in hours]

    # micro-batch 1: days 1-3; micro-batch 2: day 5 (the watermark moves to day 5, 03:00 and closes days 1-4);
    # micro-batch 3: a row back on day 1 - behind the watermark in force for late rows, so it is dropped
    # (Spark judges late rows by the previous batch's watermark: a row only counts as late once that has passed it)
    for name, data in (("a", rows([1, 30, 70], 0.1)), ("b", rows([100], 0.1)), ("c", rows([2], 0.007))):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{src}/{name}")


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "records_in")
    _arrivals(spark, src)
    got = {}
    for zone in ("UTC", "America/New_York"):
        old = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            out = jobs.stream_energy(spark, f"{src}/*/", spark.read.parquet(f"{src}/a").schema, files_per_trigger=1)
            got[zone] = {r.window_start: (r.batches, r.energy_wh) for r in out.collect()}
            assert spark.conf.get("spark.sql.session.timeZone") == zone
        finally:
            spark.conf.set("spark.sql.session.timeZone", old)
    assert got["UTC"] == got["America/New_York"]
    # the late day-1 row is not counted; the last day stays open under the watermark
    assert got["UTC"] == {f"2024-01-0{d} 00:00:00": (1, 100.0) for d in (1, 2, 3)}


def test_first_arrival_wins_over_many_files(spark):
    rows = [(f"p{i}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(i)) for i in range(200)]
    first = spark.createDataFrame(rows, "project_name string, ts timestamp, energy_consumed double").repartition(6)
    again = first.where("energy_consumed < 50").withColumn("energy_consumed", F.col("energy_consumed") + 1000).repartition(4)
    out = {r.project_name: r.energy_consumed for r in jobs.stream_dedup(spark, first, again).collect()}
    assert out == {n: e for n, _, e in rows}


def test_stream_gate_partitions_rows(spark):
    df = spark.createDataFrame([("s", 1, 0.9), ("s", 2, 0.8), ("s", 3, None)], "strategy string, prompt_id long, score double")
    out = {r.prompt_id: r.route for r in jobs.stream_gate(spark, df, 0.8).collect()}
    assert out == {1: "accept", 2: "escalate", 3: "escalate"}


def test_last_record_wins_after_every_micro_batch(spark, tmp_path):
    """The table equals the batch rule over what has arrived, also when a micro-batch is played again."""
    import random

    from tiergate.operators.energy import energy_dedup

    r, src, base, ckpt = random.Random(1), str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "ckpt")
    schema, so_far = "project_name string, energy_consumed double, file_order long", []
    for i in range(4):
        new = [(f"p{r.randint(0, 12)}" if r.random() < 0.95 else None, r.random(), i * 100 + k) for k in range(30)]
        so_far += new
        spark.createDataFrame(new, schema).coalesce(1).write.parquet(f"{src}/{i}")
        got = jobs.stream_last_wins(spark, f"{src}/*", base, ckpt, buckets=4)
        want = energy_dedup(spark.createDataFrame(so_far, schema))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # a driver that died after its commit and before the stream's own checkpoint: the last micro-batch runs again
    import os

    last = sorted(f for f in os.listdir(f"{ckpt}/commits") if f.isdigit())[-1]
    for name in (last, f".{last}.crc"):
        os.replace(f"{ckpt}/commits/{name}", f"{tmp_path}/{name}") if os.path.exists(f"{ckpt}/commits/{name}") else None
    again = jobs.stream_last_wins(spark, f"{src}/*", base, ckpt, buckets=4)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
