"""Host-level quality rules.

Every document is measured and checked against the rules. Failures are counted per host (documents' ``source``); an
empirical beta prior, fitted to the hosts' failure rates by their mean and variance, shrinks each rate, so that a host
with few documents is judged mostly by the others. The verdict on the host is joined back to its documents.

DataFrame functions only. Counting repeated word windows stays inside the row: window hashes are compared first, and
only texts in which some hash repeats have their windows sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergate.llm.common import SPACE, let, stage

MIN_WORDS = 50
REPEAT_PERCENT = 50
HOST_LIMIT = 0.6

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def _words(text: Column) -> Column:
    """Words as an array; a text without words gives an empty one."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice."""

    def covered(places: Column) -> Column:
        # each repeated window covers its three words, less what the next one covers again
        ordered = F.array_sort(places)
        step = lambda p, i, a: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - p, F.lit(3)))
        return let(ordered, lambda a: F.aggregate(F.transform(a, lambda p, i: step(p, i, a)), F.lit(0), lambda s, x: s + x))

    def repeated(pairs: Column) -> Column:
        same = lambda a, i, j: F.coalesce(F.get(a, j)["h"] == F.get(a, i)["h"], F.lit(False))
        hits = F.filter(pairs, lambda _, i: same(pairs, i, i - 1) | same(pairs, i, i + 1))
        return F.transform(hits, lambda x: x["i"])

    def of_hashes(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(let(pairs, repeated)))

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return let(F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), of_hashes)

    return let(words, lambda w: F.when(F.size(w) < 4, 0).otherwise(of_words(w)))


def measured(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) for every row; a null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare, gaps = F.length(_without(t, f"[^{SPACE}]+")), F.length(_without(t, f"[^{SPACE}]+", "w"))
    worded = F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    return docs.select(
        "doc_id",
        F.col(host).alias("host"),
        (gaps - bare).cast("long").alias("n_words"),
        (F.length(t) - bare).cast("long").alias("word_chars"),
        F.length(_without(t, "[^#*$%&|<>]+")).cast("long").alias("n_symbols"),
        let(worded, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        _repeat_words(_words(t)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def soft_failed() -> Column:
    """Further rules that count against a host but reject no document by themselves."""
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return (mean < 3) | (mean > 14) | (F.col("n_symbols") * 10 > F.col("word_chars"))


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, rate, good): the shrunk failure rate of every host and whether its documents stay.

    Prior: mean m and variance v of the hosts' raw rates give strength s = m (1 - m) / v - 1, at least 1 and at most
    the mean number of documents per host (also used where rates do not vary); rate = (failed + s m) / (documents + s).
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = hosts.withColumn("raw", F.col("n_failed") / F.col("n_docs"))
    prior = hosts.agg(F.avg("raw").alias("m"), F.var_pop("raw").alias("v"), F.avg("n_docs").alias("docs_per_host"))
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least("docs_per_host", F.col("m") * (1 - F.col("m")) / F.col("v") - 1)))
    m, s = prior.select("m", F.coalesce(strength, "docs_per_host")).first()  # two numbers; null without hosts
    m, s = (F.lit(x).cast("double") for x in (m, s))
    rate = (F.col("n_failed") + s * m) / (F.col("n_docs") + s)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate")).withColumn("good", F.col("rate") <= limit)


def judge(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of ``docs``.

    Null texts count as empty, a null host is a host of its own, repeated rows are judged once each, and an empty table
    gives an empty result. A document is kept if it passes the base rules and its host is good.
    """
    rows = stage(measured(docs, text, host).withColumn("base_failed", base_failed()).withColumn("failed", F.col("base_failed") | soft_failed()), "measures")
    verdicts = host_verdicts(rows, limit).select(F.col("host").alias("__host"), "good")
    judged = rows.join(verdicts, rows["host"].eqNullSafe(F.col("__host")))
    return judged.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.col("good")).alias("kept"))
