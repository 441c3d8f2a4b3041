"""Stand-ins for model runs: stored tables of answers and scores, derived from the driver's tables.

Nothing here is an operator. Cascades, evaluators and the run-output reader take tables of answers and scores as a
real run leaves them; this module writes such tables, so that every query has some to read:

* ``stub_answers``: tier ``k`` answers right when ``h(prompt_id || '-a-' || model) < skill_k``; another hash picks the
  wording from a small phrase table; echoing models repeat the prompt in front of the answer;
* ``stub_score``: hash noise that leans on the true label, so gating behaves as with a useful scorer;
* ``stub_pandas_model``: a model wrapper as ``mapInPandas`` sees it, which knows prompts only;
* ``batch_times``: a clock for batches that no model ran;
* ``emission_records`` and ``log_documents``: meter records and tracker logs made from ``events``: run =
  ``<strategy>-<threshold>``, the strategy by event type and the threshold by ``user_id``; batch = 0-based position by
  ``event_id`` within the run (distributed row number); energy = ``value / 1e6`` kWh; duration = ``props.k / 10`` s.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions.hashing import h, h_py, hex_bits, key
from .functions.rules import CASCADE_RULES, TEXT_TASKS
from .functions.text import echoes, first_line, strip_echo
from .operators.batching import batch_plan
from .operators.ranking import row_number_by
from .session import scratch_path
from .sources.emissions import DATASET
from .sources.prompts import fill_template, labelled_documents, turn_pairs
from .sources.prompts import prompts as build_prompts
from .sources.tables import scan, spread_small

PHRASES = {"boolq": C.PHRASES_BOOLQ, "mnli": C.PHRASES_MNLI}
N_CLASSES = {"boolq": 2, "mnli": 3}
SCORE_RIGHT_BONUS = 60
SCORE_SCALE = 160.0


def chain_array(chain: Sequence[C.Tier]) -> Column:
    """Literal array<struct<tier, model, skill>> for one chain (at most a handful of tiers)."""
    return F.array(
        *[F.struct(F.lit(t.tier).alias("tier"), F.lit(t.model).alias("model"), F.lit(t.skill).alias("skill")) for t in chain]
    )


def answer_class(prompt_id: Column, gold: Column, model: Column, skill: Column, n_classes: int) -> Column:
    right = h(key(prompt_id, "-a-", model)) < skill
    wrong = (gold + F.lit(1) + h(key(prompt_id, "-w-", model), max(n_classes - 1, 1))) % F.lit(n_classes)
    return F.when(right, gold).otherwise(wrong).cast("int")


def phrase(dataset: str, cls: Column, prompt_id: Column, model: Column) -> Column:
    table = PHRASES[dataset]
    lit_table = F.array(*[F.array(*[F.lit(p) for p in row]) for row in table])
    pick = (h(key(prompt_id, "-p-", model), len(table[0])) + F.lit(1)).cast("int")
    return F.element_at(F.element_at(lit_table, (cls + F.lit(1)).cast("int")), pick)


def stub_answers(prompts: DataFrame, chain: Sequence[C.Tier], dataset: str = "boolq") -> DataFrame:
    """Long answer table (prompt_id, tier, model, response)."""
    t = prompts.select("prompt_id", "gold_class", "prompt_text", F.explode(chain_array(chain)).alias("t"))
    cls = answer_class(F.col("prompt_id"), F.col("gold_class"), F.col("t.model"), F.col("t.skill"), N_CLASSES[dataset])
    text = phrase(dataset, cls, F.col("prompt_id"), F.col("t.model"))
    response = F.when(echoes(F.col("t.model")), F.concat(F.col("prompt_text"), text)).otherwise(text)
    return t.select("prompt_id", F.col("t.tier").alias("tier"), F.col("t.model").alias("model"), response.alias("response"))


def stub_score(strategy: Column, prompt_id: Column, model: Column, is_right: Column) -> Column:
    """Class-1 probability stand-in in [0, 1): hash noise plus a bonus when the answer is right."""
    bonus = F.when(is_right, F.lit(SCORE_RIGHT_BONUS)).otherwise(F.lit(0))
    return (h(key(strategy, "-s-", prompt_id, "-", model)) + bonus).cast("double") / F.lit(SCORE_SCALE)


def stub_scores(prompts: DataFrame, answers: DataFrame, strategies: Sequence[str], dataset: str) -> DataFrame:
    """Score table (strategy, prompt_id, tier, score) of the answers that the strategies' chains gave."""
    rows = answers.join(prompts.select("prompt_id", "gold_class", "prompt_text"), "prompt_id")
    pred = CASCADE_RULES[dataset](strip_echo("response", "prompt_text", "model"), F.col("model"))
    rows = rows.select("prompt_id", "tier", "model", (pred == F.col("gold_class")).alias("right"))
    names = F.array(
        *[F.struct(F.lit(s).alias("strategy"), F.array(*[F.lit(t.model) for t in C.CHAINS[C.STRATEGIES[s]]]).alias("models")) for s in strategies]
    )
    long = rows.select("*", F.explode(names).alias("s")).where(F.array_contains("s.models", F.col("model")))
    return long.select(
        F.col("s.strategy").alias("strategy"), "prompt_id", "tier",
        stub_score(F.col("s.strategy"), F.col("prompt_id"), F.col("model"), F.col("right")).alias("score"),
    )


#: (application, input, run) -> paths of the stored tables.
_STORED: dict[tuple[str, str, str], list[str]] = {}


def _stored(spark: SparkSession, sf_dir: str, run: str, build: Callable[[], list[DataFrame]]) -> list[DataFrame]:
    """The tables of a run, written to the shared scratch folder once for each application and input, as a finished run
    would have left them, and read by whichever session asks."""
    at = (spark.sparkContext.applicationId, sf_dir, run)
    if at not in _STORED:
        base = scratch_path(spark, "runs", uuid.uuid4().hex)
        paths = []
        for i, table in enumerate(build()):
            paths.append(f"{base}/{i}")
            table.write.parquet(paths[-1])
        _STORED[at] = paths
    return [spark.read.parquet(p) for p in _STORED[at]]


def stored_answers(spark: SparkSession, sf_dir: str, dataset: str = "boolq") -> tuple[DataFrame, DataFrame]:
    """(prompts, answers): the prompt table, and the stored answers of all chains."""
    prompts = build_prompts(spark, sf_dir, dataset)
    models = {t.model: t for chain in C.CHAINS.values() for t in chain}
    return prompts, *_stored(spark, sf_dir, dataset, lambda: [stub_answers(prompts, list(models.values()), dataset)])


def stored_run(spark: SparkSession, sf_dir: str, dataset: str = "boolq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prompts, answers, scores): the prompt table, and the stored answers and scores of all chains and strategies."""
    prompts, answers = stored_answers(spark, sf_dir, dataset)
    return prompts, answers, *_stored(spark, sf_dir, f"{dataset}/scores", lambda: [stub_scores(prompts, answers, tuple(C.STRATEGIES), dataset)])


def arriving_run(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of answers and scores of the stored run as they arrive: scattered over an hour and over files in no order, some
    twice, then a heartbeat row per stream that moves event time on."""
    prompts, answers, scores = stored_run(spark, sf_dir)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    later = lambda *parts: F.timestamp_seconds(F.unix_timestamp(start) + h(key(*parts), 3000))
    a = answers.join(prompts.select("prompt_id", "prompt_text"), "prompt_id")
    a = a.select("prompt_id", "model", "prompt_text", "response", later(F.col("prompt_id"), "-at-", F.col("model")).alias("ts"))
    s = scores.select("strategy", "prompt_id", F.col("tier").cast("int").alias("tier"), "score", later(F.col("strategy"), "-at-", F.col("prompt_id"), "-", F.col("tier")).alias("ts"))
    beat = F.timestamp_seconds(F.unix_timestamp(start) + F.lit(100 * 3600)).alias("ts")
    base = scratch_path(spark, "arriving", uuid.uuid4().hex)
    for name, rows in (("answers", a), ("scores", s)):
        own = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in ("ts", "strategy")]
        tick = spark.range(1).select(*([F.lit("strategy-1").alias("strategy")] if name == "scores" else []), *own, beat)
        again = rows.where(h(key(F.col("prompt_id"), "-again")) < 20)
        part = F.pmod(F.xxhash64("prompt_id", "ts"), F.lit(3))
        for i, arrivals in enumerate((rows.where(part == 2), rows.where(part == 0).unionByName(again), rows.where(part == 1), tick)):
            arrivals.write.parquet(f"{base}/{name}/{i}")
    return f"{base}/answers/*", f"{base}/scores/*"


def blind_class(prompt_id: Column, model: Column, n_classes: int) -> Column:
    """Class that the pandas stub answers with: a model does not know the gold label, so a hash alone decides."""
    return h(key(prompt_id, "-b-", model), n_classes).cast("int")


def stub_pandas_model(dataset: str, tier: C.Tier) -> Callable[[pd.DataFrame], pd.Series]:
    """A model wrapper as ``pandas_responder`` takes it: a batch of prompts in, one answer per row out."""
    table = PHRASES[dataset]

    def generate(batch: pd.DataFrame) -> pd.Series:
        out = []
        for pid, prompt in zip(batch["prompt_id"].astype("int64").astype(str), batch["prompt_text"]):
            row = table[h_py(pid + "-b-" + tier.model, N_CLASSES[dataset])]
            text = row[h_py(pid + "-p-" + tier.model, len(row))]
            out.append(None if prompt is None and tier.echoes else prompt + text if tier.echoes else text)
        return pd.Series(out, dtype="object")

    return generate


# ---------------------------------------------------------------------------------------------------------------
# clock, meter and tracker
# ---------------------------------------------------------------------------------------------------------------

T0 = 1719946222.0
STEP_S = 2.5


def batch_times(planned: DataFrame, keys=("batch_id",)) -> DataFrame:
    """(keys..., start_ts, end_ts) from planned rows carrying ``n_chars`` and the keys (e.g. model, batch_id): a batch
    starts 2.5 s after the previous one and takes 0.5 s plus 1 ms per character of its longest prompt."""
    per = planned.groupBy(*keys).agg(F.max("n_chars").alias("max_chars"))
    start = F.lit(T0) + F.col("batch_id") * F.lit(STEP_S)
    return per.select(*keys, start.alias("start_ts"), (start + F.lit(0.5) + F.col("max_chars") / F.lit(1000.0)).alias("end_ts"))


RUN_THRESHOLDS = ("0.6", "0.65", "0.7", "0.75", "0.8", "0.85", "0.9", "0.95")
CO2_PER_KWH = 0.5  # kg per kWh, our own


#: Event type -> what the run measured: a strategy of the sweep, strategies without quality rows, a model alone.
RUN_OF_EVENT = (("click", "strategy-1"), ("purchase", "strategy-2"), ("view", "strategy-5"), ("signup", "strategy-6"))
SINGLE_MODEL_RUN = "flan-t5-large"


def run_name_col() -> Column:
    thr = F.element_at(F.array(*[F.lit(t) for t in RUN_THRESHOLDS]), ((F.col("user_id") % F.lit(len(RUN_THRESHOLDS))) + F.lit(1)).cast("int"))
    name = F.lit(SINGLE_MODEL_RUN)
    for event, strategy in RUN_OF_EVENT:
        name = F.when(F.col("event_type") == event, F.concat(F.lit(f"{strategy}-"), thr)).otherwise(name)
    return name


def batch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, run, batch, event_id, ts, energy_kwh, duration_s): one row per measured batch."""
    ev = scan(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    base = ev.select(
        F.lit(DATASET).alias("dataset"),
        run_name_col().alias("run"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("value") / F.lit(1e6)).alias("energy_kwh"),
        (F.get_json_object("props", "$.k").cast("double") / F.lit(10.0)).alias("duration_s"),
    )
    ranked = row_number_by(base, ["run"], ["event_id"], out="rn")
    return ranked.select("dataset", "run", (F.col("rn") - 1).alias("batch"), "event_id", "ts", "energy_kwh", "duration_s")


def emission_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the meter's 31-column shape, plus ``folder`` (= ``<dataset>_<run>``) for the partitioned write."""
    b = batch_records(spark, sf_dir)
    e = F.col("energy_kwh")
    dur = F.col("duration_s")
    return b.select(
        F.col("ts").alias("timestamp"),
        F.concat_ws("_", "dataset", "run", F.col("batch").cast("string")).alias("project_name"),
        F.md5(F.col("event_id").cast("string")).alias("run_id"),
        dur.alias("duration"),
        (e * F.lit(CO2_PER_KWH)).alias("emissions"),
        F.when(dur > 0, e * F.lit(CO2_PER_KWH) / dur).alias("emissions_rate"),
        F.when(dur > 0, e * 0.3 * 3.6e6 / dur).alias("cpu_power"),
        F.when(dur > 0, e * 0.6 * 3.6e6 / dur).alias("gpu_power"),
        F.when(dur > 0, e * 0.1 * 3.6e6 / dur).alias("ram_power"),
        (e * 0.3).alias("cpu_energy"),
        (e * 0.6).alias("gpu_energy"),
        (e - e * 0.3 - e * 0.6).alias("ram_energy"),
        e.alias("energy_consumed"),
        F.lit("Nowhere").alias("country_name"),
        F.lit("XXX").alias("country_iso_code"),
        F.lit(None).cast("string").alias("region"),
        F.lit(None).cast("string").alias("cloud_provider"),
        F.lit(None).cast("string").alias("cloud_region"),
        F.lit("Linux").alias("os"),
        F.lit("3").alias("python_version"),
        F.lit("0").alias("codecarbon_version"),
        F.lit(1).alias("cpu_count"),
        F.lit("CPU").alias("cpu_model"),
        F.lit(1).alias("gpu_count"),
        F.lit("GPU").alias("gpu_model"),
        F.lit(None).cast("double").alias("longitude"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(1.0).alias("ram_total_size"),
        F.lit("process").alias("tracking_mode"),
        F.lit("N").alias("on_cloud"),
        F.lit(1.0).alias("pue"),
        F.concat_ws("_", "dataset", "run").alias("folder"),
    )


# Values in the generated tracker logs, our own.
TRACKER_VERSION, TRACKER_PUE = "9.8.7", 1.25
# Fixed formats: the lines of a tracker log.
VERSION_LINE = f"{{ts}} - carbontracker version {TRACKER_VERSION}"
PUE_LINE = f"{{ts}} - Only predicted and actual consumptions are multiplied by a PUE coefficient of {TRACKER_PUE}."
EPOCH_LINE = "{ts} - Epoch 1:"
DURATION_LINE = "{ts} - Duration: {dur}"
GPU_LINE = "{ts} - Average power usage (W) for gpu: {gpu}"
CPU_LINE = "{ts} - Average power usage (W) for cpu: {cpu}"
INTENSITY_G_PER_KWH = 321.25
INTENSITY_LINE = f"{{ts}} - Average carbon intensity during training was {INTENSITY_G_PER_KWH} gCO2/kWh at detected location: XX."
ACTUAL_BLOCK = (
    "{ts} - CarbonTracker: \nActual consumption for 1 epoch(s):\n\tTime:\t0:00:02\n\tEnergy:\t{kwh} kWh\n"
    "\tCO2eq:\t{co2} g\n\tThis is equivalent to:\n\t{km} km travelled by car\n"
)
KM_PER_G = 1.0 / 100.0
CPU_NONE_PCT = 10


def _txt(c: Column) -> Column:
    """Shortest text that reads back to the same double (so parse(write(x)) == x exactly)."""
    return c.cast("string")


def log_documents(batches: DataFrame) -> DataFrame:
    """(run, batch, kind, value): one log and one output document per batch record.

    ``batches``: (run, batch, event_id, ts, energy_kwh, duration_s). The output log of a batch also holds the block
    of the next batch of its run (as the real logs repeat later blocks), built from a shifted copy of its values.
    """
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    dur = F.col("duration_s")
    dur_txt = F.format_string("%d:%02d:%05.2f", (dur / 3600).cast("int"), ((dur % 3600) / 60).cast("int"), dur % 60)
    gpu = F.concat(F.lit("["), _txt(F.col("energy_kwh") * F.lit(1e5)), F.lit("]"))
    cpu = F.when(h(key(F.col("event_id"), "-cpu")) < CPU_NONE_PCT, F.lit("None")).otherwise(
        F.concat(F.lit("["), _txt(F.col("energy_kwh") * F.lit(7e4)), F.lit("  "), _txt(F.col("energy_kwh") * F.lit(5e4)), F.lit("]"))
    )

    def line(template: str, **parts: Column) -> Column:
        pieces = []
        rest = template
        while "{" in rest:
            pre, tail = rest.split("{", 1)
            name, rest = tail.split("}", 1)
            pieces += [F.lit(pre), parts[name]]
        pieces.append(F.lit(rest))
        return F.concat(*pieces)

    log = F.concat_ws(
        "\n",
        line(VERSION_LINE, ts=ts), line(PUE_LINE, ts=ts), line(EPOCH_LINE, ts=ts), line(DURATION_LINE, ts=ts, dur=dur_txt),
        line(GPU_LINE, ts=ts, gpu=gpu), line(CPU_LINE, ts=ts, cpu=cpu), line(INTENSITY_LINE, ts=ts),
    )

    def block(kwh: Column) -> Column:
        co2 = kwh * F.lit(INTENSITY_G_PER_KWH)
        return line(ACTUAL_BLOCK, ts=ts, kwh=_txt(kwh), co2=_txt(co2), km=_txt(co2 * F.lit(KM_PER_G)))

    later = F.col("energy_kwh") * F.lit(2.0)  # the block of a later batch, different numbers
    output = F.concat(block(F.col("energy_kwh")), block(later))
    return batches.select(
        "run", "batch", F.explode(F.array(F.struct(F.lit("log").alias("kind"), log.alias("value")), F.struct(F.lit("output").alias("kind"), output.alias("value")))).alias("d")
    ).select("run", "batch", "d.kind", "d.value")


# ---------------------------------------------------------------------------------------------------------------
# answers and references of the evaluation tasks
# ---------------------------------------------------------------------------------------------------------------


def _lit_list(values) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values])


def _task_hash(tag: str) -> Column:
    return hex_bits(key(F.col("prompt_id"), tag, F.col("task"), "/", F.col("model")))


LABEL_TASK_SCHEMA = "map<string, struct<gold string, n int, phrases array<array<string>>, choices array<string>, parts int>>"


def _label_tasks() -> dict[str, dict]:
    """How the label tasks are made up. ``gold``: from quality ("quality"), quality + toxic ("sum"), both as a number
    ("number"), or ``parts`` words of ``choices`` by hash ("choice"). ``phrases``: wordings, by class where there are any."""
    classes = {t: {"gold": "sum" if t == "mnli" else "quality", "n": 3 if t == "mnli" else 2, "phrases": p} for t, p in C.EVAL_CLASS_PHRASES.items()}
    choices = {"vax": (C.VAX_GOLD_CHOICES, 1), "caves": (C.CAVES_LABELS, 2), "hatex": (C.HATEX_GOLD_CHOICES, 1)}
    vectors = {t: {"gold": "choice", "n": 1, "phrases": [p], "choices": choices[t][0], "parts": choices[t][1]} for t, p in C.EVAL_MULTILABEL_PHRASES.items()}
    return classes | vectors | {"stsb": {"gold": "number", "n": 1, "phrases": [C.STSB_PHRASES]}}


def eval_run(spark: SparkSession, sf_dir: str, tasks: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(answers, references) of evaluation tasks for the models of ``C.EVAL_MODELS``.

    Class, label and number tasks: prompt = the whole text of a labelled document, gold from its labels (or, for
    labels that the data do not have, a hash). Text tasks: prompt = a user turn or a document, gold = the turn after
    it or the document's first line; a model that is wrong repeats its source.
    """
    label_tasks = [t for t in tasks if t not in TEXT_TASKS]
    parts = [_label_task_run(spark, sf_dir, label_tasks)] if label_tasks else []
    parts += [_text_task_run(spark, sf_dir, t) for t in tasks if t in TEXT_TASKS]
    answers, references = parts[0]
    for a, r in parts[1:]:
        answers, references = answers.unionByName(a), references.unionByName(r)
    return answers, references


def _responses(rows: DataFrame, text: Column) -> DataFrame:
    response = F.when(echoes(F.col("model")), F.concat("prompt_text", text)).otherwise(text)
    return rows.select("task", "model", "prompt_id", response.alias("response"))


def _with_models(rows: DataFrame) -> DataFrame:
    models = F.array(*[F.struct(F.lit(t.model).alias("model"), F.lit(t.skill).alias("skill")) for t in C.EVAL_MODELS])
    return rows.select("*", F.inline(models))


def _label_task_run(spark: SparkSession, sf_dir: str, tasks: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """All label tasks in one pass over the labelled documents."""
    spec = F.element_at(F.from_json(F.lit(json.dumps(_label_tasks())), LABEL_TASK_SCHEMA), F.col("task"))
    docs = labelled_documents(spark, sf_dir).select("doc_id", "text", "quality", "toxic", F.explode(_lit_list(tasks)).alias("task"))
    prompt = F.concat("task", F.lit(": "), "text").alias("prompt_text")
    base = docs.select("task", F.col("doc_id").alias("prompt_id"), prompt, "quality", "toxic", spec.alias("spec"))
    kind, n = F.col("spec.gold"), F.col("spec.n")

    def nth(values: Column, k: Column) -> Column:
        return F.element_at(values, ((k % F.size(values)) + F.lit(1)).cast("int"))

    gold_hash = lambda tag: hex_bits(key(F.col("prompt_id"), tag, F.col("task")))
    chosen = nth(F.col("spec.choices"), gold_hash("-g-"))
    gold_class = (F.col("quality") + F.when(kind == "sum", F.col("toxic")).otherwise(F.lit(0))).cast("int")
    number = (F.col("quality") * F.lit(2.5) + F.col("toxic")).cast("double")
    gold_text = (
        F.when(kind == "number", number.cast("string"))
        .when((kind == "choice") & (F.col("spec.parts") == 2), F.concat(chosen, F.lit(","), nth(F.col("spec.choices"), gold_hash("-h-"))))
        .when(kind == "choice", chosen)
        .otherwise(gold_class.cast("string"))
    )
    asked = _with_models(base)
    wrong = (gold_class + F.lit(1) + _task_hash("-w-") % F.greatest(n - 1, F.lit(1))) % n
    cls = F.when(_task_hash("-a-") % F.lit(100) < F.col("skill"), gold_class).otherwise(wrong)
    row = F.element_at(F.col("spec.phrases"), F.when(n > 1, cls + F.lit(1)).otherwise(F.lit(1)).cast("int"))
    said = nth(row, _task_hash("-p-"))
    return _responses(asked, said), base.select("task", "prompt_id", "prompt_text", gold_text.alias("gold_text"))


#: Runs of the run-folder stand-in that a study would not have finished: one that is not there, one cut off half-way.
MISSING_RUN, SHORT_RUN = ("wnli", "flan-t5-xl"), ("cola", "Phi-3-small-8k-instruct")


def run_folder_rows(answers: DataFrame, references: DataFrame, batch_size: int) -> tuple[DataFrame, DataFrame]:
    """(dataset, run, position, response) and (dataset, run, batch_id, start_ts, end_ts) as runners of all answers leave them."""
    plan = batch_plan(references.select("task", "prompt_id", "prompt_text"), batch_size, ("task",))
    rows = answers.join(plan, ["task", "prompt_id"])
    half = references.groupBy("task").agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    run = F.struct("task", "model")
    is_run = lambda r: run == F.struct(F.lit(r[0]).alias("task"), F.lit(r[1]).alias("model"))
    rows = rows.join(F.broadcast(half), "task").where(~is_run(MISSING_RUN) & ((F.col("position") <= F.col("half")) | ~is_run(SHORT_RUN)))
    rows = rows.select(F.col("task").alias("dataset"), F.col("model").alias("run"), "position", "batch_id", "n_chars", "response")
    return rows.select("dataset", "run", "position", "response"), batch_times(rows, ("dataset", "run", "batch_id"))


def text_prompts(spark: SparkSession, sf_dir: str, task: str) -> DataFrame:
    """(prompt_id, prompt_text, gold_text, source_text) for one text task."""
    if task == "cnn_dm":
        d = spread_small(scan(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
        return d.select(
            F.col("doc_id").alias("prompt_id"), fill_template(C.TEMPLATE_CNN, F.col("text")).alias("prompt_text"), first_line("text").alias("gold_text"),
            F.col("text").alias("source_text"),
        )
    t = turn_pairs(spark, sf_dir)
    prompt = fill_template(C.TEMPLATE_SAMSUM, F.col("user_text")) if task == "samsum" else F.col("user_text")
    return t.select(
        F.col("pair_id").alias("prompt_id"), prompt.alias("prompt_text"), F.col("assistant_text").alias("gold_text"),
        F.col("user_text").alias("source_text"),
    )


def text_right(task: str, model: Column, skill: Column) -> Column:
    return (hex_bits(key(F.col("prompt_id"), "-a-", F.lit(task), "/", model)) % F.lit(100)) < skill


def _text_task_run(spark: SparkSession, sf_dir: str, task: str) -> tuple[DataFrame, DataFrame]:
    base = text_prompts(spark, sf_dir, task).withColumn("task", F.lit(task))
    asked = _with_models(base)
    said = F.when(text_right(task, F.col("model"), F.col("skill")), F.col("gold_text")).otherwise(F.col("source_text"))
    return _responses(asked, said), base.select("task", "prompt_id", "prompt_text", "gold_text")


def stored_text_run(spark: SparkSession, sf_dir: str, strategy: str, task: str = "samsum") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prompts, answers, scores) of a text cascade, in the shape of ``stored_run``; prompts carry ``gold_text``."""
    base = text_prompts(spark, sf_dir, task)

    def build() -> list[DataFrame]:
        rows = base.select("*", F.inline(chain_array(C.CHAINS[C.STRATEGIES[strategy]])))
        right = text_right(task, F.col("model"), F.col("skill"))
        said = F.when(right, F.col("gold_text")).otherwise(F.col("source_text"))
        response = F.when(echoes(F.col("model")), F.concat("prompt_text", said)).otherwise(said)
        score = stub_score(F.lit(strategy), F.col("prompt_id"), F.col("model"), right).alias("score")
        return [rows.select("prompt_id", "tier", "model", response.alias("response")), rows.select(F.lit(strategy).alias("strategy"), "prompt_id", "tier", score)]

    return base.select("prompt_id", "prompt_text", "gold_text"), *_stored(spark, sf_dir, f"{task}/{strategy}", build)
