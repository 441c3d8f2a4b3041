"""Scorer inputs (P7), training rows (M4, P5, U2), and Spark ML pipelines as scorers.

Training by epochs, grids, layouts and the registry are in ``plans.epochs``. A Spark ML ``PipelineModel`` plugs into the
gate as well (``as_score_fn``, ``scores_table``); ``fit_grid`` fits one, ``RegexTokenizer -> HashingTF -> IDF ->
LogisticRegression`` over the scorer input, for several settings, judged by validation log-loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import strip_echo
from ..operators.sampling import split_hash
from . import cascade

NUM_FEATURES = 1 << 16


def scorer_text(dataset: str) -> Column:
    """What a scorer reads of a labelled answer. boolq: prompt + stripped answer; mnli: prompt + class digit;
    samsum: the raw, unstripped output."""
    if dataset == "samsum":
        return F.col("response")
    return F.concat("prompt_text", F.col("answer") if dataset == "boolq" else F.col("pred").cast("string"))


def training_rows(prompts: DataFrame, answers: DataFrame, dataset: str = "boolq", chains: Sequence[str] = ("flan", "phi"), validation_pct: int | None = None) -> DataFrame:
    """(model, tier, prompt_id, scorer_text, response, label double, split): U2 pooled rows with the P5 split of the data set."""
    rows = cascade.labelled_answers(prompts, answers, dataset, cascade.chain_models(*chains))
    t = rows.select("model", "tier", "prompt_id", scorer_text(dataset).alias("scorer_text"), "response", (F.col("pred") == F.col("gold")).cast("double").alias("label"))
    return split_hash(t, C.VALIDATION_PCT[dataset] if validation_pct is None else validation_pct)


def training_prompts(prompts: DataFrame, answers: DataFrame, dataset: str = "boolq", chains: Sequence[str] = ("flan", "phi"), validation_pct: int | None = None) -> DataFrame:
    """The rows of ``training_rows``, those of a prompt in one: (prompt_id, split, shared_text, answers), answers being
    array<struct<model, tier, label, own_text, response>> and the scorer text of each ``shared_text`` + ``own_text``.

    No word crosses from one text to the other: a prompt that ends in a letter or digit is part of ``own_text``.
    """
    wanted = answers.where(F.col("model").isin(cascade.chain_models(*chains)) & F.col("prompt_id").isNotNull())
    said = wanted.groupBy("prompt_id").agg(F.collect_list(F.struct("model", "tier", "response")).alias("said"))
    rows = split_hash(said.join(prompts.select("prompt_id", "gold_class", "prompt_text"), "prompt_id"), C.VALIDATION_PCT[dataset] if validation_pct is None else validation_pct)
    prompt = F.col("prompt_text")
    apart = F.lit(dataset != "samsum") & ~F.lower(F.right(prompt, F.lit(1))).rlike("[a-z0-9]$")
    answered = F.transform("said", lambda a: F.struct(
        a["model"].alias("model"), a["tier"].alias("tier"), a["response"].alias("response"), strip_echo(a["response"], prompt, a["model"]).alias("answer"),
    ))
    rows = rows.select("prompt_id", "split", "gold_class", "prompt_text", F.when(apart, prompt).otherwise("").alias("shared_text"), answered.alias("said"))
    judged = F.transform("said", lambda a: F.struct(a["model"].alias("model"), a["tier"].alias("tier"), a["response"].alias("response"), a["answer"].alias("answer"), cascade.RULES[dataset](a["answer"], a["model"]).alias("pred")))

    def own(a: Column) -> Column:
        if dataset == "samsum":
            return a["response"]
        said = a["answer"] if dataset == "boolq" else a["pred"].cast("string")
        return F.when(prompt.isNotNull(), F.when(apart, said).otherwise(F.concat(prompt, said)))

    rows = rows.withColumn("said", judged)
    found = F.transform("said", lambda a: F.struct(a["model"].alias("model"), a["tier"].alias("tier"), (a["pred"] == F.col("gold_class")).cast("double").alias("label"), own(a).alias("own_text"), a["response"].alias("response")))
    return rows.select("prompt_id", "split", "shared_text", found.alias("answers"))


def feature_pipeline() -> Pipeline:
    """Text to features; the same for every setting, so it is fitted once."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="scorer_text", outputCol="tokens", pattern="[^a-z0-9]+", toLowercase=True),
            HashingTF(inputCol="tokens", outputCol="tf", numFeatures=NUM_FEATURES),
            IDF(inputCol="tf", outputCol="features"),
        ]
    )


def _logloss(pred: DataFrame) -> float:
    return MulticlassClassificationEvaluator(labelCol="label", metricName="logLoss").evaluate(pred)


def fit_grid(rows: DataFrame, grid: Sequence[tuple[float, int]], parallelism: int = 4) -> tuple[list[tuple], int, int]:
    """Fit every (regParam, maxIter) on the train split and score it on validation log-loss.

    Features are fitted once, on the train split, and the vectors of both splits are cached for all settings (no raw
    text is); the settings are fitted concurrently (each fit is a series of Spark jobs; a small thread pool keeps the
    cluster busy while one fit waits on its driver step). Returns ([(reg, iter, model, loss)], n_train, n_val).
    """
    from concurrent.futures import ThreadPoolExecutor

    features = feature_pipeline().fit(rows.where(F.col("split") == "train"))
    vectors = features.transform(rows).select("split", "label", "features")
    train = vectors.where(F.col("split") == "train").cache()
    val = vectors.where(F.col("split") == "validation").cache()
    n_train, n_val = train.count(), val.count()

    def one(setting):
        reg, it = setting
        model = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=it).fit(train)
        loss = _logloss(model.transform(val)) if n_val else float("nan")
        return (reg, it, PipelineModel(stages=[*features.stages, model]), loss)

    try:
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(grid)))) as pool:
            fitted = list(pool.map(one, grid))
    finally:
        train.unpersist()
        val.unpersist()
    return fitted, n_train, n_val


def fit_best(rows: DataFrame, grid: Sequence[tuple[float, int]]) -> tuple[PipelineModel, list[tuple]]:
    """Keep the setting with the lowest validation log-loss ("best epoch on validation")."""
    fitted, n_train, n_val = fit_grid(rows, grid)
    report = [(reg, it, n_train, n_val, loss) for reg, it, _, loss in fitted]
    scored = [f for f in fitted if f[3] == f[3]]
    best = min(scored, key=lambda f: f[3])[2] if scored else fitted[0][2]
    return best, report


def score_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """M2: class-1 probability for every row (Spark ML transform; no Python worker)."""
    out = model.transform(rows)
    return out.select("model", "prompt_id", vector_to_array("probability")[1].alias("score"))


def as_score_fn(model: PipelineModel, dataset: str = "boolq"):
    """A fitted scorer as a cascade takes it: adds ``score`` to rows with prompt_text, answer, response and pred."""

    def score(rows: DataFrame, tier) -> DataFrame:
        text = F.coalesce(scorer_text(dataset), F.lit(""))
        out = model.transform(rows.withColumn("scorer_text", text))
        return out.select(*rows.columns, vector_to_array("probability")[1].alias("score"))

    return score


def scores_table(model: PipelineModel, labelled: DataFrame, strategy: str, dataset: str = "boolq") -> DataFrame:
    """(strategy, prompt_id, tier, score): a fitted scorer's scores of labelled answers, as ``sweep_final`` takes them."""
    out = model.transform(labelled.withColumn("scorer_text", F.coalesce(scorer_text(dataset), F.lit(""))))
    return out.select(F.lit(strategy).alias("strategy"), "prompt_id", "tier", vector_to_array("probability")[1].alias("score"))
