"""Line dedup by distinct-site spread.

A line is boilerplate if it stands on at least ``min_sites`` distinct sites. Each line hash carries a HyperLogLog
sketch of its sites, merged by aggregation. Only lines whose estimate lies within ``margin`` of the limit are counted
exactly; below and above, the estimate decides. Of every boilerplate line one occurrence stays (lowest document id,
then text hash, then place), so nothing is lost from the corpus: a passage that thousands of documents share is kept once.

Everything is DataFrame functions. Lines travel as hashes; texts move once, when the line numbers to remove meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergate.llm.common import free_name, let, row_key, stage, with_keys

MIN_SITES = 5
MARGIN = 0.5
LG_K = 6

#: What does not count at the ends of a line: space, tab, VT, FF and carriage return (of CRLF texts).
BLANK = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_table(docs: DataFrame, site: str = "source") -> DataFrame:
    """(h1, h2, site, doc_id, tie, pos): one row per line with a non-blank character; a null site counts as a site.

    Two 64-bit hashes of the trimmed line stand for it, so a line is the same with and without a carriage return.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.xxhash64(F.col(site)).alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.col("line"), F.lit(BLANK))).filter("line != ''")
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site", "doc_id", "tie", "pos")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, n_sites, first): the lines on at least ``min_sites`` sites; ``first`` is the occurrence that stays."""
    place = F.struct(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"), "tie", "pos")
    seen = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"), F.min(place).alias("first"))
    # a line seen fewer times than the limit, or on one site only, cannot reach it: no sketch for it
    wanted = stage(seen.filter((F.col("n") >= min_sites) & (F.col("low") != F.col("high"))).select("h1", "h2", "first"), "line-candidates")
    among = lines.join(wanted.select("h1", "h2"), ["h1", "h2"], "left_semi")
    sketched = among.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    spread = stage(sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")), "line-spread")
    near = spread.filter(F.abs(F.col("estimate") - min_sites) <= margin * min_sites)
    exact = among.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("n_sites"))
    sure = spread.filter(F.col("estimate") > (1 + margin) * min_sites).select("h1", "h2", F.col("estimate").alias("n_sites"))
    return sure.unionByName(exact.filter(F.col("n_sites") >= min_sites)).join(wanted, ["h1", "h2"])


def marked(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, margin: float = MARGIN, drop: str = "drop") -> DataFrame:
    """``docs`` with a column ``drop``: the numbers (from 0) of the lines to remove, null where none is."""
    lines = stage(line_table(docs, site), "lines")
    common = boilerplate(lines, min_sites, margin)
    here = F.struct(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"), "tie", "pos")
    gone = lines.join(common.select("h1", "h2", "first"), ["h1", "h2"]).filter(here != F.col("first"))
    keys = [free_name(docs, f"__key{i}") for i in range(3)]
    by_doc = with_keys(gone, keys, row_key(F.col("doc_id"), F.col("tie"))).groupBy(*keys).agg(F.collect_set("pos").alias(drop))
    keyed = with_keys(docs, keys, row_key(docs["doc_id"], F.xxhash64(docs["text"])))
    return keyed.join(by_doc, keys, "left").drop(*keys)


def kept_text(text: Column, drop: Column) -> Column:
    """The text without the lines numbered in ``drop``; other lines keep their order and their spaces."""

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return F.when(drop.isNull(), text).otherwise(let(_lines(text), rest))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """``docs`` (same columns and rows) with cross-site boilerplate lines taken out of ``text``."""
    drop = free_name(docs, "__drop")
    return marked(docs, site, min_sites, margin, drop).withColumn("text", kept_text(F.col("text"), F.col(drop))).select(*docs.columns)


def line_report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, kept_md5) for every row of ``docs``, repeated rows included.

    ``removed``: the numbers of the removed lines, ascending, comma-joined. A null text has no line and a null digest;
    an empty text has one (empty) line. Lines of white space only
    are never removed. Equal rows get equal results.
    """
    found = marked(docs.select("doc_id", "text", F.col(site).alias("site")), "site", min_sites, margin)
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    return found.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.array_join(F.array_sort(gone), ",").alias("removed"),
        F.md5(kept_text(F.col("text"), F.col("drop"))).alias("kept_md5"),
    )
