"""Prompt tables (P1, P2): one row per prompt with a declared schema and a stable ``prompt_id``.

The studied programs build prompts from public datasets; here the same four templates are filled from the
driver's tables:

* boolq  ``documents JOIN labels``: question = first line of the text, passage = the text, gold = quality
* mnli   ``documents JOIN labels``: premise = the text, hypothesis = first line, gold = quality + toxic (0/1/2)
* cnn    ``documents``: article = the text, gold text = first line
* samsum ``conversations``: dialogue = a user turn, gold summary = the assistant turn right after it

Schema: ``prompt_id bigint, dataset string, prompt_text string, gold_class int, gold_text string``.
Null inputs give a null prompt (``concat`` semantics) instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import first_line
from .tables import scan, spread_small

PROMPT_COLUMNS = ("prompt_id", "dataset", "prompt_text", "gold_class", "gold_text")


def fill_template(pieces: tuple[str, ...], *inputs) -> F.Column:
    """pieces[0] + pieces[1] + inputs[0] + pieces[2] + inputs[1] + ... (+ the last piece when one is left)."""
    parts = [F.lit(pieces[0])]
    for i, value in enumerate(inputs):
        parts.append(F.lit(pieces[i + 1]))
        parts.append(value)
    if len(pieces) > len(inputs) + 1:
        parts.append(F.lit(pieces[len(inputs) + 1]))
    return F.concat(*parts)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_small(scan(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    labels = scan(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id")


def boolq_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled_documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").alias("prompt_id"),
        F.lit("boolq").alias("dataset"),
        fill_template(C.TEMPLATE_BOOLQ, first_line("text"), F.col("text")).alias("prompt_text"),
        F.col("quality").cast("int").alias("gold_class"),
        F.lit(None).cast("string").alias("gold_text"),
    )


def mnli_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled_documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").alias("prompt_id"),
        F.lit("mnli").alias("dataset"),
        fill_template(C.TEMPLATE_MNLI, F.col("text"), first_line("text")).alias("prompt_text"),
        (F.col("quality") + F.col("toxic")).cast("int").alias("gold_class"),
        F.lit(None).cast("string").alias("gold_text"),
    )


def cnn_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread_small(scan(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return d.select(
        F.col("doc_id").alias("prompt_id"),
        F.lit("cnn_dm").alias("dataset"),
        fill_template(C.TEMPLATE_CNN, F.col("text")).alias("prompt_text"),
        F.lit(None).cast("int").alias("gold_class"),
        first_line("text").alias("gold_text"),
    )


def pair_key(a: Column, b: Column) -> Column:
    """One number for two non-negative ones, different for every two (Szudzik's pairing): a conversation may have any
    number of turns. Exact while both are below 3e9."""
    return F.when(a >= b, a * a + a + b).otherwise(b * b + a)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, conv_id, user_text, assistant_text): a user turn and the assistant turn right after it."""
    conv = spread_small(scan(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), "conv_id", "turn")
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_text"))
    bot = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_text")
    )
    return user.join(bot, ["conv_id", "turn"]).select(
        pair_key(F.col("conv_id"), F.col("turn")).alias("pair_id"), "conv_id", "user_text", "assistant_text"
    )


def samsum_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = turn_pairs(spark, sf_dir)
    return p.select(
        F.col("pair_id").alias("prompt_id"),
        F.lit("samsum").alias("dataset"),
        fill_template(C.TEMPLATE_SAMSUM, F.col("user_text")).alias("prompt_text"),
        F.lit(None).cast("int").alias("gold_class"),
        F.col("assistant_text").alias("gold_text"),
    )


BUILDERS = {"boolq": boolq_prompts, "mnli": mnli_prompts, "cnn_dm": cnn_prompts, "samsum": samsum_prompts}


def prompts(spark: SparkSession, sf_dir: str, dataset: str = "boolq") -> DataFrame:
    return BUILDERS[dataset](spark, sf_dir)
