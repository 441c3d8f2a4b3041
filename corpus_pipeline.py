"""Corpus pipeline: classify, remove boilerplate lines, remove near-duplicates, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergate.llm import best_fit_packing, line_dedup, quality_classifier, simhash_dedup, source_mixing
from tiergate.llm.common import read_table, stage

#: The classifier, the random draws of the mix and the tokeniser have no SQL form.
ORACLE_SQL = None


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites (one occurrence of each stays)."""
    return _recounted(line_dedup.remove_boilerplate(docs), docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.keep_one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and parts of documents that bring each source to its target."""
    return _recounted(source_mixing.mix_documents(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their place in the packed sequences."""
    return best_fit_packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", remove_lines),
    ("simhash_dedup", keep_one),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
