"""Line dedup against a plain reading."""

import hashlib
from collections import Counter, defaultdict

from cases import awkward, empty
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tiergate.llm import line_dedup as D


def brute(rows, min_sites=D.MIN_SITES):
    """rows (doc_id, text, site, tie) -> Counter of (doc_id, n_lines, n_removed, removed, md5)."""
    sites, first = defaultdict(set), {}
    for doc_id, text, site, tie in rows:
        for i, line in enumerate((text or "").split("\n")):
            if line := line.strip(D.BLANK):
                sites[line].add(site)
                place = (-1 if doc_id is None else doc_id, tie, i)
                first[line] = min(first.get(line, place), place)
    out = Counter()
    for doc_id, text, _, tie in rows:
        lines = [] if text is None else text.split("\n")
        me = lambda i: (-1 if doc_id is None else doc_id, tie, i)
        gone = [i for i, x in enumerate(lines) if x.strip(D.BLANK) and len(sites[x.strip(D.BLANK)]) >= min_sites and first[x.strip(D.BLANK)] != me(i)]
        kept = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[doc_id, len(lines), len(gone), ",".join(map(str, gone)), None if kept is None else hashlib.md5(kept.encode()).hexdigest()] += 1
    return out


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "source", F.xxhash64("text").alias("tie")).collect()]


def crowd(spark, sites: int, copies: int):
    """A footer on many sites, lines near the limit, a long passage, and lines on one site only."""
    rows = []
    for s in range(sites):
        for c in range(copies):
            i = s * copies + c
            text = f"own line {i}\nfooter of all\n  footer of all  \nonly on site {s}"
            for k in range(2, 9):
                if s < k:
                    text += f"\non {k} sites"
            rows.append((i, text, f"site{s}" if s else None))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_near_and_far_lines(spark):
    for lg_k in (4, 6):
        docs = crowd(spark, 60, 3)
        lines = D.line_table(docs)
        got = {(r.h1, r.h2) for r in D.boilerplate(lines, lg_k=lg_k).collect()}
        names = ["footer of all"] + [f"on {k} sites" for k in range(2, 9)]
        hashed = spark.createDataFrame([(n,) for n in names], "line string").select("line", F.xxhash64("line"), F.xxhash64(F.lit(1), "line")).collect()
        assert {r[0] for r in hashed if (r[1], r[2]) in got} == {"footer of all", "on 5 sites", "on 6 sites", "on 7 sites", "on 8 sites"}
        assert len(got) == 5
    assert Counter(tuple(r) for r in D.line_report(docs).collect()) == brute(rows_of(docs))


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert Counter(tuple(r) for r in D.line_report(docs, min_sites=2).collect()) == brute(rows_of(docs), 2)
    out = D.remove_boilerplate(docs, min_sites=2)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert D.line_report(empty(spark)).count() == 0 and D.remove_boilerplate(empty(spark)).count() == 0


def test_windows_line_ends(spark):
    rows = [(i, f"own {i}\r\n\r\n\t\r\nfooter{end}\nbody {i}\r\n", f"site{i}") for i, end in enumerate(["\r", "", "\t", "\r", " \r", "", "\x0b", "\r"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Counter(tuple(r) for r in D.line_report(docs).collect()) == brute(rows_of(docs))
    left = {r.doc_id: r.text for r in D.remove_boilerplate(docs).collect()}
    assert left[0] == rows[0][1] and all(left[i] == f"own {i}\r\n\r\n\t\r\nbody {i}\r\n" for i in range(1, 8))


def test_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert Counter(tuple(r) for r in D.line_report(docs).collect()) == brute(rows_of(docs))


def test_one_occurrence_of_every_line_stays(spark):
    docs = crowd(spark, 12, 2)
    before = {x.strip(D.BLANK) for r in docs.collect() for x in r.text.split("\n")}
    left = Counter(x.strip(D.BLANK) for r in D.remove_boilerplate(docs).collect() for x in r.text.split("\n"))
    assert set(left) == before and left["footer of all"] == 1 and left["only on site 3"] == 2
