"""WARC archives: record format, planning, predicates, commits, and deduplicated pages against a plain reading."""

import gzip
import hashlib
import os
import uuid
from collections import Counter, defaultdict

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tiergate.llm import warc_archive as A
from tiergate.llm import warc_source as W

PAGES = "page_id long, url string, html string"


def brute(rows):
    """rows (page_id, url, html) -> Counter of (page_id, bytes, digest, type, refers_to)."""
    groups = defaultdict(list)
    for page_id, url, html in rows:
        payload = (html or "").encode()
        groups[payload].append((page_id is None, page_id or 0, page_id))
    out = Counter()
    for payload, ids in groups.items():
        ids.sort()
        for i, (*_, page_id) in enumerate(ids):
            again = i > 0 and len(payload) >= 100
            out[page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0][2] if again else None] += 1
    return out


def as_counter(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def awkward_rows():
    page = "<html>" + "é漢😀\r\n\r\nWARC/1.1\r\n" * 30 + "</html>"
    rows = [(i, f"http://a.b/{i}", page) for i in range(40, 90)]  # one payload on many pages
    rows += [(1, "http://x\r\nWARC-Type: revisit\r\n\r\n", "y" * 99), (2, None, "y" * 99), (3, "u", "z" * 100), (4, "u", "z" * 100), (5, "", None), (6, "u", "")]
    rows += [(7, "same", "s" * 500)] * 4 + [(8, "same", "s" * 500), (7, "other", "s" * 500)]  # the first page repeats
    rows += [(None, "n", "n" * 200), (None, "m", "n" * 200), (9, "n", "n" * 200), (None, None, None), (None, "k", "k" * 300), (10, " lead ", "x" * 300_000)]
    return rows + [(11, "tiny", "t")] * 3


def test_pages_come_back(spark):
    rows = awkward_rows()
    df = spark.createDataFrame(rows, PAGES).repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("payload", "digest", "rid", "copies", "head", "n", "bytes", "record_type", "headers", "copy")})
    assert as_counter(A.round_trip(df)) == brute(rows)
    assert A.round_trip(df.limit(0)).count() == 0


def test_many_warm_groups_and_a_hot_one(spark):
    rows = [(i, f"u{i}", f"page {i % 1500} " * 20 if i % 3 else "common " * 20) for i in range(6000)]
    assert as_counter(A.round_trip(spark.createDataFrame(rows, PAGES))) == brute(rows)


def test_table(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    assert as_counter(A.round_trip(pages)) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


@pytest.fixture(scope="module", params=["gzip", "none"])
def archive(spark, request, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('warc')}/a"
    A.write_pages(spark.createDataFrame(awkward_rows(), PAGES).repartition(3), path, compression=request.param, maxFileBytes=3000)
    return path


def test_records_and_splits(spark, archive):
    whole = A.read_warc(spark, archive)
    assert whole.columns == [c.split(" ")[0] for c in W.SCHEMA.split(", ")]
    rows = whole.collect()
    kinds = Counter(r.record_type for r in rows)
    assert kinds["warcinfo"] > 3 and kinds["response"] + kinds["revisit"] == len(awkward_rows())
    assert len({r.record_id for r in rows}) == len(rows)
    ids = {r.record_id: r for r in rows}
    for r in rows:
        if r.record_type == "response":
            assert r.payload_digest == "sha256:" + hashlib.sha256(r.payload).hexdigest() and len(r.payload) == r.payload_bytes
        if r.record_type == "revisit":
            first = ids[r.refers_to]
            assert r.payload is None and (first.payload_digest, first.payload_bytes) == (r.payload_digest, r.payload_bytes) and first.record_type == "response"
    assert "http://x%0D%0AWARC-Type: revisit%0D%0A%0D%0A" in {r.target_uri for r in rows}
    W.LEAST_SPLIT_BYTES, least = 1, W.LEAST_SPLIT_BYTES
    try:
        units = W.WarcReader({"path": archive, "splitBytes": "700"}, whole.schema).partitions()
        assert max(len(u.parts) for u in units) >= 1 and len(units) > len([f for f in os.listdir(archive) if f.endswith((".warc", ".gz"))])
    finally:
        W.LEAST_SPLIT_BYTES = least
    cut = A.read_warc(spark, archive, splitBytes=700, minPartitions=1)
    assert Counter((r.record_id, r.at) for r in cut.collect()) == Counter((r.record_id, r.at) for r in rows)


def test_predicates_reach_the_headers(spark, archive):
    rows = A.read_warc(spark, archive).collect()
    reader = W.PushdownWarcReader({"path": archive}, A.read_warc(spark, archive, columns=("record_id", "record_type")).schema)
    D = W.D
    pushed = [D.EqualTo(("record_type",), "response"), D.StringContains(("target_uri",), "a.b"), D.GreaterThan(("payload_bytes",), 5), D.IsNotNull(("target_uri",))]
    assert list(reader.pushFilters(pushed)) == [pushed[2]]
    got = {x for u in reader.partitions() for b in reader.read(u) for x in b.column("record_id").to_pylist()}
    assert got == {r.record_id for r in rows if r.record_type == "response" and "a.b" in (r.target_uri or "")}
    key = "spark.sql.python.filterPushdown.enabled"
    for on in ("true", "false"):
        spark.conf.set(key, on)
        try:
            df = A.read_warc(spark, archive, columns=("record_type", "target_uri", "record_id")).filter("record_type = 'revisit' and target_uri like 'http://a.b/8%'")
            assert {r.record_id for r in df.collect()} == {r.record_id for r in rows if r.record_type == "revisit" and r.target_uri.startswith("http://a.b/8")}
        finally:
            spark.conf.set(key, "false")
    assert {r.record_type for r in A.read_warc(spark, archive, ("revisit",), ("record_type",)).collect()} == {"revisit"}
    assert A.read_warc(spark, archive, columns=("target_uri",), uriPrefix="http://a.b/").count() == 50


def test_rejected_payloads_are_not_read(tmp_path):
    """Past a rejected record a plain or indexed archive seeks: its damaged payload is never met."""
    good = W.encode_record({"WARC-Type": "response", "WARC-Record-ID": "<a>"}, b"x" * 500, 500)
    info = W.encode_record({"WARC-Type": "metadata", "WARC-Record-ID": "<b>"}, b"y" * 500_000, 500_000)
    path = tmp_path / "x.warc.gz"
    members = [gzip.compress(info)[:200] + b"\0" * 900, gzip.compress(good)]
    path.write_bytes(b"".join(members))
    (tmp_path / "x.warc.gz.idx").write_bytes(W.np.array([0, len(members[0])], "<u8").tobytes())
    only = lambda f: f["warc-type"] == "response"
    assert [(f["WARC-Record-ID"], p) for f, p, *_ in W.read_records(str(path), only, True, (0, 2))] == [("<a>", b"x" * 500)]
    with pytest.raises(Exception):
        list(W.read_records(str(path)))


def test_archives_of_others(spark, tmp_path):
    """Plain, gzip by record, and one gzip for a whole file; records without HTTP headers; folded header lines."""
    one = W.encode_record({"WARC-Type": "response", "WARC-Record-ID": "<1>", "WARC-Target-URI": "http://a"}, b"p\r\n\r\nWARC/1.0\r\n", 15)
    two = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <2>\r\nX-Note: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    odd = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Record-ID: <3>\r\nContent-Length: 7\r\n\r\nno http\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + two + odd)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(odd))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(one + two + odd))
    (tmp_path / "notes.txt").write_text("not an archive")
    rows = A.read_warc(spark, str(tmp_path)).collect()
    assert Counter((r.record_id, bytes(r.payload), r.payload_bytes) for r in rows) == {("<1>", b"p\r\n\r\nWARC/1.0\r\n", 15): 3, ("<2>", b"abc", 3): 3, ("<3>", b"no http", 7): 3}
    assert {r.headers.get("X-Note") for r in rows if r.record_id == "<2>"} == {"a b"}
    assert A.read_warc(spark, str(tmp_path / "a.warc"), ("resource",), ("payload_bytes",)).collect()[0][0] == 3
    (tmp_path / "d.warc").write_bytes(one[:-30])
    with pytest.raises(Exception, match="d.warc"):
        A.read_warc(spark, str(tmp_path)).collect()


def test_only_committed_files_are_read(spark, tmp_path):
    path = f"{tmp_path}/a"
    pages = spark.createDataFrame(awkward_rows(), PAGES)
    A.write_pages(pages, path)
    before = as_counter(A.page_report(spark, path))
    with open(f"{path}/{uuid.uuid4().hex}-00000.warc", "wb") as f:  # what a lost task left
        f.write(W.encode_record({"WARC-Type": "response", "WARC-Record-ID": "<z>"}, b"z", 1))
    assert as_counter(A.page_report(spark, path)) == before
    broken = A.archive_records(pages).withColumn("record_id", F.when(F.col("payload_bytes") > 1000, F.raise_error(F.lit("boom"))).otherwise(F.col("record_id")))
    with pytest.raises(Exception, match="boom"):
        broken.write.format("warc").mode("append").save(path)
    assert as_counter(A.page_report(spark, path)) == before
    A.write_pages(pages, path)  # another job adds its records
    assert as_counter(A.page_report(spark, path)) == before + before
    A.archive_records(pages).write.format("warc").mode("overwrite").save(path)
    assert as_counter(A.page_report(spark, path)) == before
