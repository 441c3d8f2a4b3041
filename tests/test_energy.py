"""Energy roll-up on golden values copied from a published per-batch record file (10 batches)."""

from tiergate.operators import energy as EN

# Fixed golden values: energy_consumed (kWh) of batches 0-9 of one published run.
GOLDEN_KWH = [
    0.0001758126179312, 7.110259820740394e-05, 8.941454911691305e-06, 3.789544725909413e-06, 0.000423852475658,
    0.0002285579614344, 4.678824329296118e-06, 3.184002888553329e-06, 0.0008297189418642, 0.000282972830292453,
]


def _records(spark, kwh, run="strategy-100-0.8"):
    rows = [(f"samsum_test_1k_{run}_{i}", v) for i, v in enumerate(kwh)]
    return spark.createDataFrame(rows, "project_name string, energy_consumed double")


def test_round_first_then_sum(spark):
    b = EN.energy_batches(_records(spark, GOLDEN_KWH), "samsum_test_1k")
    r = EN.energy_rollup(b).first()
    assert r.run == "strategy-100-0.8" and r.batches == 10
    assert abs(r.total_wh - 2.034) < 1e-12  # each batch rounded to 3 decimals first
    assert round(sum(v * 1000 for v in GOLDEN_KWH), 3) == 2.033  # rounding the sum instead gives 2.033


def test_parse_names(spark):
    df = spark.createDataFrame([("mnli_test_1k_strategy_1-0.9_12",), ("boolq_test_1k_Phi-3-mini-4k-instruct_3",)], "project_name string")
    parts = EN.parse_project_name(df.project_name, "mnli_test_1k")
    r = df.select(*[v.alias(k) for k, v in parts.items()]).first()
    assert (r.run, r.batch, r.strategy, r.threshold) == ("strategy_1-0.9", 12, "strategy_1", 0.9)
    parts = EN.parse_project_name(df.project_name, "boolq_test_1k")
    r = df.select(*[v.alias(k) for k, v in parts.items()]).collect()[1]
    assert r.run == "Phi-3-mini-4k-instruct" and r.batch == 3 and r.threshold is None  # 'instruct' is not a number
    assert r.strategy == "Phi-3-mini-4k-instruct"
    other = df.select(*[v.alias(k) for k, v in parts.items()]).first()
    assert tuple(other) == (None, None, None, None)  # a record of another data set


def test_dedup_last_wins_and_lookup_gaps(spark):
    rows = [("d_r_0", 1.0, 0), ("d_r_0", 2.0, 1), ("d_r_1", 3.0, 0)]
    df = spark.createDataFrame(rows, "project_name string, energy_consumed double, file_order int")
    got = {r.project_name: r.energy_consumed for r in EN.energy_dedup(df).collect()}
    assert got == {"d_r_0": 2.0, "d_r_1": 3.0}
    recs = spark.createDataFrame([("d_r_0", 1e-3), ("d_r_2", 2e-3), ("d_r_3", 3e-3)], "project_name string, energy_consumed double")
    b = EN.energy_batches(recs, "d")
    strict = sorted(r.batch for r in EN.energy_lookup(b, strict_reference=True).collect())
    assert strict == [0, 2]  # n = 3 records -> indices 0..2; batch 1 missing, batch 3 beyond n
    every = EN.energy_lookup(b)
    assert sorted((r.batch, r.indexed) for r in every.collect()) == [(0, True), (2, True), (3, False)]
    assert [tuple(r) for r in EN.energy_gaps(every).collect()] == [("r", 3, 1)]


# Fixed golden values: energy_consumed (kWh) of the 25 batches of a second published run.
GOLDEN_KWH_25 = [
    0.0006736189729051, 0.0004792409712339, 0.0004629454900953, 0.0004612733102116, 0.0004814460504768,
    0.0004676203576694, 0.0004924677467869, 0.0004705127964564, 0.0004744164031735, 0.0004829793876584,
    0.0004872438606568, 0.0004815962782824, 0.0004790185748322, 0.0004801210991921, 0.0004805152284578,
    0.0004802479161639, 0.0004781374231513, 0.0004826856689135, 0.0004921559325606, 0.0004865578139069,
    0.0004805033424429, 0.0004891381497281, 0.0004846646146592, 0.0004862316273153, 0.00048574475522534226,
]


def test_round_first_second_run(spark):
    b = EN.energy_batches(_records(spark, GOLDEN_KWH_25, run="Phi-3-small-8k-instruct"), "samsum_test_1k")
    r = EN.energy_rollup(b).first()
    assert r.batches == 25 and abs(r.total_wh - 12.202) < 1e-12
    assert round(sum(v * 1000 for v in GOLDEN_KWH_25), 3) == 12.201
