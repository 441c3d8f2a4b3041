"""Web pages as deduplicated WARC archives, and back.

Every page becomes one record. Of pages with equal payloads of at least ``min_bytes`` bytes the one with the smallest id
is a response that holds the payload; the others are revisits, which hold its digest and length and refer to it.

A revisit needs no payload, so payloads move once, and only towards response records: pages are told apart by a record
id, equal rows meet in the map-side part of an aggregation, and a semi-join with the first page of each payload keeps the
responses. Everything else runs on narrow rows. A payload that more than a thousandth of all pages share is joined by
broadcast (there are fewer than a thousand of those), so no group of copies lands in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergate.llm.common import stage
from tiergate.llm.warc_source import SCHEMA, register_warc
from tiergate.session import scratch_path, shuffle_width

MIN_BYTES = 100
PAGE_ID, REFERS_TO_PAGE = "Page-ID", "Refers-To-Page-ID"
#: A payload on more than this share of all pages is joined by broadcast; fewer than 1 / HOT_SHARE payloads are.
HOT_SHARE = 0.001


def record_id(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A record id that follows from the page, so a task that runs again writes the same one."""
    name = F.md5(F.concat_ws("|", F.to_json(F.struct(page_id.alias("p"), url.alias("u"))), digest, copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, limit: float) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per ``key``, its number of rows in ``n``). Groups of more than ``limit`` rows
    are broadcast; the caller's limit bounds their number."""
    hot = F.broadcast(groups.filter(F.col("n") > limit))
    warm = rows.join(hot.select(key), key, "left_anti").join(groups.filter(F.col("n") <= limit), key)
    return rows.join(hot, key).unionByName(warm)


def archive_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Records of ``pages`` (page_id, url, html) as ``format("warc")`` writes them, one for every row of ``pages``.

    Null html is an empty payload; a null url or id leaves its header field out, and a page without an id comes last among
    equal payloads. Of rows that repeat an id and a payload one is the response. Other columns are ignored; an empty table
    has no record. Control characters of a url are percent-encoded.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page, url = F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")
    rows = pages.select(page, url, html.alias("payload"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    rows = rows.withColumn("rid", record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.lit(0)))
    small = F.when(F.col("bytes") < min_bytes, F.col("payload"))
    narrow = stage(rows.select("rid", "page_id", "url", "digest", "bytes", small.alias("payload")).groupBy("rid").agg(
        *(F.first(c).alias(c) for c in ("page_id", "url", "digest", "bytes", "payload")), F.count("*").alias("copies")
    ), "warc-pages")
    large = narrow.filter(F.col("bytes") >= min_bytes)
    rank = F.struct(F.col("page_id").isNull(), "page_id", "rid")
    heads = large.groupBy("digest").agg(F.min_by(F.struct("rid", "page_id", "url"), rank).alias("head"), F.count("*").alias("n"))
    heads = stage(heads.select("digest", F.col("head.rid").alias("head_rid"), F.col("head.page_id").alias("head_page"), "n"), "warc-heads")

    # equal rows meet before they move; then one row per page, of which the first of each payload stays
    once = rows.filter(F.col("bytes") >= min_bytes).groupBy("rid").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "digest", "bytes", "payload")))
    first = once.join(heads.select(F.col("head_rid").alias("rid")), "rid", "left_semi")
    response = F.lit("response")
    nobody = F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("long").alias("refers_page")
    columns = ["page_id", "url", "digest", "bytes", "payload"]
    firsts = first.select(response.alias("record_type"), F.col("rid").alias("record_id"), *nobody, *columns)

    copies = F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy")
    rid = record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))
    smalls = narrow.filter(F.col("bytes") < min_bytes).select(*columns, copies)
    smalls = smalls.select(response.alias("record_type"), rid.alias("record_id"), *nobody, *columns)

    total = narrow.count()
    known = join_by_group(large.drop("payload"), heads, "digest", max(1.0, HOT_SHARE * total))
    is_head = F.col("rid") == F.col("head_rid")
    again = known.filter(~is_head | (F.col("copies") > 1)).withColumn("from", is_head.cast("int"))
    again = again.select("*", F.explode(F.sequence(F.col("from"), F.col("copies").cast("int") - 1)).alias("copy"))
    again = again.select(
        F.lit("revisit").alias("record_type"), rid.alias("record_id"), F.col("head_rid").alias("refers_to"), F.col("head_page").alias("refers_page"),
        "page_id", "url", "digest", "bytes", F.lit(None).cast("binary").alias("payload"),
    )
    every = firsts.unionByName(smalls).unionByName(again)
    headers = F.map_filter(
        F.create_map(F.lit(PAGE_ID), F.col("page_id").cast("string"), F.lit(REFERS_TO_PAGE), F.col("refers_page").cast("string")), lambda _, v: v.isNotNull()
    )
    return every.select(
        "record_type", "record_id", F.col("url").alias("target_uri"), "refers_to", F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        headers.alias("headers"), F.col("bytes").alias("payload_bytes"), "payload",
    )


def write_pages(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, **options) -> None:
    """Write the records of ``pages`` to new archives under ``path``."""
    register_warc(pages.sparkSession)
    archive_records(pages, min_bytes).write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, record_types: tuple[str, ...] = (), columns: tuple[str, ...] = (), **options) -> DataFrame:
    """Records of the archives under ``path`` (see ``warc_source.SCHEMA``). Only records of ``record_types`` (all, if none
    are named) are decoded, and only ``columns`` (all, if none are named) are read."""
    register_warc(spark)
    schema = {c.split(" ")[0]: c for c in SCHEMA.split(", ")}
    reader = spark.read.format("warc").schema(", ".join(schema[c] for c in columns or schema))
    if record_types:
        reader = reader.option("recordTypes", ",".join(record_types))
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return reader.options(**{"pushdown": pushdown, "minPartitions": shuffle_width(spark), **options}).load(path)


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the page records of archives: length and digest
    of a response are those of the payload that was read; a revisit has them in its headers."""
    records = read_warc(spark, path, ("response", "revisit"), ("record_type", "payload_digest", "headers", "payload_bytes", "payload"))
    told = F.substring_index("payload_digest", ":", -1)
    return records.select(
        F.col("headers")[PAGE_ID].cast("long").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.when(F.col("payload").isNull(), told).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        F.col("headers")[REFERS_TO_PAGE].cast("long").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives to the shared scratch folder and report what is read back, one row per page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "llm", f"warc-{uuid.uuid4().hex}")
    write_pages(pages, path)
    return page_report(spark, path)
