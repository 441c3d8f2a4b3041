"""Ranking, batching, run-output and tracker-log round trips."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from tiergate.operators.ranking import row_number_by
from tiergate.sources import tracker_logs as TL


def test_row_number_by_equals_window(spark):
    df = spark.read.parquet(f"{SF_MID}/events.parquet").select("event_type", "event_id", "user_id")
    ours = row_number_by(df, ["event_type"], ["user_id", "event_id"], num_partitions=5)
    ref = df.select("*", F.row_number().over(Window.partitionBy("event_type").orderBy("user_id", "event_id")).alias("rn"))
    assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0


def test_batch_plan_edges(spark):
    from tiergate.operators.batching import batch_plan

    df = spark.createDataFrame([(i, "x" * (5 if i < 6 else 9), "d") for i in range(7)], "prompt_id long, prompt_text string, dataset string")
    got = {r.prompt_id: r.batch_id for r in batch_plan(df, 4).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1}  # equal lengths -> id order; 7 rows -> batches of 4 + 3
    empty = spark.createDataFrame([], "prompt_id long, prompt_text string, dataset string")
    assert batch_plan(empty, 4).count() == 0


# Fixed format: the lines of a tracker log; the numbers are our own.
LOG = """2024-01-02 10:00:00 - carbontracker version 9.8.7
2024-01-02 10:00:00 - Only predicted and actual consumptions are multiplied by a PUE coefficient of 1.25 (A survey).
2024-01-02 10:00:01 - Epoch 1:
2024-01-02 10:00:01 - Duration: 1:02:01.05
2024-01-02 10:00:01 - Average power usage (W) for gpu: [12.5  3.25]
2024-01-02 10:00:01 - Average power usage (W) for cpu: {cpu}
2024-01-02 10:00:02 - Carbon intensities (gCO2/kWh) fetched every 900 s at detected location A, B, C: [400.5]
2024-01-02 10:00:02 - Average carbon intensity during training was 400.50 gCO2/kWh at detected location: A, B, C.
2024-01-02 10:00:02 - Live carbon intensity could not be fetched at detected location: A, B, C. Defaulted to average carbon intensity for C in 2021 of 77.00 gCO2/kWh. at detected location: A, B, C.
"""
BLOCK = """2024-01-02 10:00:03 - CarbonTracker: 
{kind} consumption for 1 epoch(s):
\tTime:\t0:00:02
\tEnergy:\t{kwh} kWh
\tCO2eq:\t{co2} g
\tThis is equivalent to:
\t{km} km travelled by car
"""


def _outputs():
    """A predicted block, the batch's own block, and the block of a later batch (invented numbers)."""
    blocks = (("Predicted", 9, 9, 9), ("Actual", 0.25, 100.125, 1e-05), ("Actual", 8, 8, 8))
    return "".join(BLOCK.format(kind=k, kwh=a, co2=b, km=c) for k, a, b, c in blocks)


def _check_log(r):
    assert (r.batch, r.version, r.pue, r.intensity_g_kwh) == (31, "9.8.7", 1.25, 400.5)
    assert abs(r.duration_s - 3721.05) < 1e-9 and list(r.gpu_w) == [12.5, 3.25] and r.cpu_w is None
    assert (r.energy_kwh, r.co2_g, r.km) == (0.25, 100.125, 1e-05)


def test_tracker_logs_in_both_layouts(spark, tmp_path):
    log, out = LOG.format(cpu="None"), _outputs()
    docs = spark.createDataFrame([("r", 31, "log", log), ("r", 31, "output", out)], "run string, batch long, kind string, value string")
    base = str(tmp_path / "lines")
    TL.write_logs(docs, base)
    _check_log(TL.scan_tracker_logs(spark, base).first())
    for run in ("r_1-0.9", "other"):
        folder = tmp_path / "folders" / f"data_{run}" / "carbon_tracker"
        folder.mkdir(parents=True)
        (folder / "31__77_2024-01-02T100000Z_carbontracker.log").write_text(log)
        (folder / "31__77_2024-01-02T100000Z_carbontracker_output.log").write_text(out)
        (folder / "31__77_2024-01-02T100000Z_carbontracker_err.log").write_text("a warning")
        (folder / "2__77_2024-01-02T090000Z_carbontracker.log").write_text(LOG.format(cpu="[1.5   2]"))
    rows = TL.scan_log_folders(spark, str(tmp_path / "folders"), "data").collect()
    assert sorted((r.run, r.batch) for r in rows) == [("other", 2), ("other", 31), ("r_1-0.9", 2), ("r_1-0.9", 31)]
    for r in rows:
        if r.batch == 31:
            _check_log(r)
        else:
            assert list(r.cpu_w) == [1.5, 2.0] and r.energy_kwh is None


def test_run_output_in_both_layouts(spark, tmp_path):
    import json

    from tiergate.sources import run_output as RO

    texts = [f"text {i}\n\"q\" é" for i in range(10)] + [None]
    times = [[1.5 + i, 2.5 + i] for i in range(3)]
    want = [(i + 1, i // 4, t, *times[i // 4]) for i, t in enumerate(texts)]
    for run in ("m-1", "strategy_1-0.9"):
        folder = tmp_path / "runs" / f"data_{run}"
        folder.mkdir(parents=True)
        (folder / "output.json").write_text(json.dumps([texts, times], indent=4, ensure_ascii=False))
    (tmp_path / "runs" / "data_broken").mkdir()
    (tmp_path / "runs" / "data_broken" / "output.json").write_text("{")
    rows = RO.scan_output_json(spark, str(tmp_path / "runs"), "data", 4).collect()
    for run in ("m-1", "strategy_1-0.9"):
        assert sorted(tuple(r)[1:] for r in rows if r.run == run) == want
    assert {r.run for r in rows} == {"m-1", "strategy_1-0.9"}
    # our own layout: many documents to a file, however many batches
    n = 1500
    answers = spark.createDataFrame([("m/1 x", i + 1, i // 4, f"t{i}") for i in range(n)], "model string, position long, batch_id long, response string")
    pairs = spark.createDataFrame([("m/1 x", b, float(b), b + 0.5) for b in range(n // 4)], "model string, batch_id long, start_ts double, end_ts double")
    base = str(tmp_path / "lines")
    RO.write_run_output_json(answers.coalesce(2), pairs, 4, base)
    files = [f for f in (tmp_path / "lines").rglob("part-*")]
    assert len(files) <= 8
    got = sorted(tuple(r) for r in RO.scan_run_output(spark, base, 4).collect())
    assert got == [("m/1 x", i + 1, i // 4, f"t{i}", float(i // 4), i // 4 + 0.5) for i in range(n)]


def test_emissions_in_both_layouts(spark, tmp_path):
    from tiergate.sources import emissions as EM

    names = [f.name for f in EM.EMISSIONS_SCHEMA.fields]
    row = {"project_name": "data_run-0.5_0", "energy_consumed": "0.5", "timestamp": "2024-01-01T10:00:00", "duration": "2.0"}
    folder = tmp_path / "m" / "data_run-0.5"
    folder.mkdir(parents=True)
    (folder / "emissions.csv").write_text(",".join(names) + "\n" + ",".join(row.get(n, "") for n in names) + "\n")
    (folder / "output.json").write_text("[[], []]")
    got = EM.scan_emissions(spark, str(tmp_path / "m"), "data").select("folder", "project_name", "energy_consumed").collect()
    assert [tuple(r) for r in got] == [("data_run-0.5", "data_run-0.5_0", 0.5)]
    again = EM.scan_emissions(spark, str(tmp_path / "m"), "data").drop("file_path")
    EM.write_emissions(again, str(tmp_path / "own"))
    back = EM.scan_emissions(spark, str(tmp_path / "own"), "data").select("folder", "project_name", "energy_consumed").collect()
    assert back == got


def test_row_number_by_with_a_hot_key(spark):
    """One key holds a third of all rows: the range partition splits it, the numbering still equals the window's."""
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("k"),
        F.col("id").alias("o"),
    )
    ours = row_number_by(df, ["k"], ["o"], num_partitions=8)
    ref = df.select("*", F.row_number().over(Window.partitionBy("k").orderBy("o")).alias("rn"))
    assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0
    ranged = df.repartitionByRange(8, "k", "o").select("k", F.spark_partition_id().alias("p"))
    assert ranged.where(F.col("k") == "hot").select("p").distinct().count() > 1
