"""Evaluation jobs (L1-L16; A1-A8) over stored answers.

Two tables in: ``answers(task, model, prompt_id, response)`` and ``references(task, prompt_id, prompt_text, gold_text)``.
They meet once, on (task, prompt_id); the whole response is stripped of its echoed prompt (P6) and labelled by the
task's row of the rule table. The labels of all tasks go through one aggregation each for classes, label vectors,
numbers and texts.

The rules are rows of a table (``functions.rules.task_rules``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import class_of, number_of, prepared_answer, rule_column, task_rules, vector_of
from ..functions.text import strip_head
from ..operators.batching import batch_plan
from ..operators.metrics import macro_prf, macro_prf_multilabel, regression_metrics
from ..session import staged
from ..sources.run_folder import read_answers
from .text_eval import text_metrics

def labelled(answers: DataFrame, references: DataFrame, rules: dict[str, dict] | None = None) -> DataFrame:
    """One row per answer: (task, model, prompt_id, kind, gold_class, pred_class, gold_vector, pred_vector, gold_number,
    pred_number, gold_text, answer); the columns of other kinds are null."""
    return labelled_rows(answers.select("task", "model", "prompt_id", "response").join(prompt_sizes(references), ["task", "prompt_id"]), rules)


def prompt_sizes(references: DataFrame) -> DataFrame:
    """What labelling needs of a reference: of the prompt only its length, which an echo has in front of the answer."""
    return references.select("task", "prompt_id", F.length("prompt_text").alias("n_chars"), "gold_text")


def labelled_rows(rows: DataFrame, rules: dict[str, dict] | None = None) -> DataFrame:
    """``labelled`` of answers that have met their reference: (task, model, prompt_id, response, n_chars of the prompt, gold_text)."""
    rows = rows.select("task", "model", "prompt_id", "gold_text", strip_head("response", "n_chars", "model").alias("answer"), rule_column(F.col("task"), rules).alias("rule"))
    rule, kind, gold, answer = F.col("rule"), F.col("rule.kind"), F.col("gold_text"), F.col("answer")
    text = prepared_answer(answer, F.col("model"), rule)
    return rows.select(
        "task", "model", "prompt_id", kind.alias("kind"),
        F.when(kind == "class", gold.try_cast("int")).alias("gold_class"),
        F.when(kind == "class", class_of(text, rule)).alias("pred_class"),
        F.when(kind == "vector", vector_of(F.coalesce(gold, rule["gold_if_null"]), rule["gold_words"])).alias("gold_vector"),
        F.when(kind == "vector", vector_of(text, rule["answer_words"])).alias("pred_vector"),
        F.when(kind == "number", gold.try_cast("double")).alias("gold_number"),
        F.when(kind == "number", number_of(answer)).alias("pred_number"),
        F.when(kind == "text", F.lower(gold)).alias("gold_text"),
        F.when(kind == "text", F.lower(answer)).alias("answer"),
    )


def eval_class(rows: DataFrame, keys: Sequence[str] = ("task", "model")) -> DataFrame:
    return macro_prf(rows.where("kind = 'class'"), list(keys), "gold_class", "pred_class")


def eval_multilabel(rows: DataFrame, keys: Sequence[str] = ("task", "model")) -> DataFrame:
    return macro_prf_multilabel(rows.where("kind = 'vector'"), list(keys), "gold_vector", "pred_vector")


def eval_number(rows: DataFrame, keys: Sequence[str] = ("task", "model")) -> DataFrame:
    """L12 + A4/A5; rows whose answer gives no number are counted in ``unparsed`` and left out of the metrics."""
    return regression_metrics(rows.where("kind = 'number'"), list(keys), "gold_number", "pred_number")


def eval_text(rows: DataFrame, embeddings: DataFrame, keys: Sequence[str] = ("task", "model")) -> DataFrame:
    """ROUGE-1 / 2 / L and embedding P / R / F1, means over prompts."""
    texts = rows.where("kind = 'text'")
    return text_metrics(texts.select(*keys, F.col("prompt_id").alias("pair_id"), F.col("answer").alias("pred"), F.col("gold_text").alias("ref")), embeddings, keys)


def eval_all(answers: DataFrame, references: DataFrame, embeddings: DataFrame, rules: dict[str, dict] | None = None) -> DataFrame:
    """Every task of the answers in one table (task, model, metric, value).

    Labels are written once (texts only for the text tasks) and every kind of metric reads them.
    """
    return eval_labelled(labelled(answers, references, rules), embeddings)


def eval_labelled(rows: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``eval_all`` of labelled answers."""
    rows = staged(rows, "labelled-answers")
    parts = [eval_class(rows), eval_multilabel(rows), eval_number(rows), eval_text(rows, embeddings)]
    out = None
    for part in parts:
        names = [c for c in part.columns if c not in ("task", "model")]
        values = part.select("task", "model", *(F.col(c).cast("double").alias(c) for c in names))
        long = values.unpivot(["task", "model"], names, "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def run_status(references: DataFrame, answers: DataFrame, models: Sequence[str]) -> DataFrame:
    """(task, model, references, answers): runs that a table of answers should hold, and how many answers it has. A run
    without answers is reported, not evaluated; so is one of a task or model that nobody asked for."""
    wanted = references.groupBy("task").agg(F.count(F.lit(1)).alias("references")).select("*", F.explode(F.array(*map(F.lit, models))).alias("model"))
    got = answers.groupBy("task", "model").agg(F.count(F.lit(1)).alias("answers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return wanted.join(got, ["task", "model"], "full").select("task", "model", zero("references"), zero("answers"))


def answers_of_folders(rows: DataFrame, references: DataFrame, batch_size: int) -> DataFrame:
    """(task, model, prompt_id, response, n_chars, gold_text): answers of run folders (dataset, run, position, response) meet the
    prompts that stand at their position of the length-sorted batch plan, task by task."""
    plan = batch_plan(references.select("task", "prompt_id", "prompt_text"), batch_size, ("task",)).select("task", "position", "prompt_id")
    plan = plan.join(prompt_sizes(references), ["task", "prompt_id"])  # before the answers come in, so that their texts move once
    said = rows.select(F.col("dataset").alias("task"), F.col("run").alias("model"), "position", "response")
    return said.join(plan, ["task", "position"]).select("task", "model", "prompt_id", "response", "n_chars", "gold_text")


def eval_run_folders(
    spark: SparkSession, base: str, references: DataFrame, embeddings: DataFrame, models: Sequence[str], batch_size: int, rules: dict[str, dict] | None = None,
) -> DataFrame:
    """L16 over a folder of runs, ``<task>_<model>/output.json``: (task, model, metric, value).

    Every run gets its ``references`` (prompts of its task) and ``answers`` (texts in its document); those that have both
    get their task's metrics, over the answers they have. A missing or unreadable run has 0 answers and no metrics.
    """
    rows = read_answers(spark, base, list(rules or task_rules()), skip_broken=True)
    found = rows.select(F.col("dataset").alias("task"), F.col("run").alias("model"))
    status = run_status(references, found, models).unpivot(["task", "model"], ["references", "answers"], "metric", "value")
    metrics = eval_labelled(labelled_rows(answers_of_folders(rows, references, batch_size), rules), embeddings)
    return metrics.unionByName(status.withColumn("value", F.col("value").cast("double")))
