"""URL filter: rules against a plain reading, features, and held-out hosts."""

import math
import re

import pytest
from conftest import SF_MID

from tiergate.llm import url_filter as U

URLS = [
    "http://a.net/x", "https://NET/", "http://example.net/en/1?x=1", "http://sub.Example.NET/en/1", "http://example.net/de/1", "http://notexample.com/de/1", "http://example.com/de/1",
    "http://www.example.com/de", "http://x.org/fr/", "http://org/fr/1", "http://x.org/frx", "http://a.net", "http://a.net?q=/x", "http://a.net#/x", "no scheme", "", None, "://", "x://h:80/p?q://z/",
    "http://" + "a" * 50_000 + ".com/" + "b/" * 20_000, "http://ü.example.com/ä?ö", "http://a.net/x", "mailto:x@y", "http:///path",
]


def brute(url):
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_rules_on_awkward_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS score", "1 AS suffix", "2 AS bad", "3 AS features", "4 AS label", "5 AS fold", "6 AS given", "7 AS __id")
    got = U.judge(df).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, u in rows:
        host, path, rule, verdict = brute(u)
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict in (None, r.verdict)
    assert U.judge(df.limit(0)).count() == 0


def test_entropy(spark):
    texts = ["", "aaaa", "ab", "hello", "éé日"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [-sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) for t in texts]
    assert [r[0] for r in df.select(U.entropy(df.t)).collect()] == pytest.approx(want)


def bits(text):
    return -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))


def plain_features(url):
    """The lexical features, written down a second time."""
    url = url or ""
    host, path, *_ = brute(url)
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    count = lambda t, cs: sum(c in cs for c in t)
    return {
        "url_length": len(url), "host_length": len(host), "path_length": len(path), "query_length": len(query), "host_parts": host.count(".") + 1,
        "path_depth": path.count("/"), "n_params": query.count("&") + 1 if query else 0, "digit_ratio": count(url, "0123456789") / max(1, len(url)),
        "host_digit_ratio": count(host, "0123456789") / max(1, len(host)), "host_hyphens": host.count("-"), "path_hyphens": count(path, "-_"),
        "longest_part": max(map(len, host.split("."))), "vowel_ratio": count(host, "aeiouy") / max(1, len(host)), "host_entropy": bits(host), "url_entropy": bits(url),
        "secure": url.startswith("https:"), "has_port": bool(re.search(r":[0-9]+$", host)), "escapes": url.count("%"),
    }


def plain_statistics(rows):
    """Shares and out-of-fold rates from (suffix, top, fold, bad) rows."""
    mean, out = sum(r["bad"] for r in rows) / len(rows), []
    for r in rows:
        own = {}
        for key in ("suffix", "top"):
            same = [x for x in rows if x[key] == r[key]]
            others = [x for x in same if x["fold"] != r["fold"]]
            own[f"{key}_share"] = math.log(len(same) / len(rows))
            own[f"{key}_rate"] = (sum(x["bad"] for x in others) + U.SMOOTHING * mean) / (len(others) + U.SMOOTHING)
        out.append(own)
    return out


def test_every_feature(spark):
    some = [r.url for r in spark.read.parquet(f"{SF_MID}/pages.parquet").limit(60).collect()]
    urls = [u for u in URLS if u is None or len(u) < 1000] + some + ["https://a-b.c1.example.com:8080/x_y-z/%20?q=1&r=&s#f?g", "http://x.y/a?b#c?d"]
    rows = [(i, u) for i, u in enumerate(urls)]
    got = U.with_suffix_statistics(U.lexical(U.parsed(spark.createDataFrame(rows, "page_id long, url string")))).collect()
    assert len(got) == len(rows)
    statistics = plain_statistics([r.asDict() for r in got])
    for r, stats in zip(got, statistics):
        want = {**plain_features(urls[r.page_id]), **stats}
        assert set(want) == set(U.FEATURES)
        for name, value in want.items():
            assert r[name] == pytest.approx(float(value), abs=1e-12), (urls[r.page_id], name)


def test_labels_and_their_order(spark):
    """A given label comes first, then the rule, then the word list; folds keep a host together."""
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://casino.com/"), (3, "http://b.org/fr/"), (4, "http://a.net/2"), (None, "http://casino.com/")], "page_id long, url string")
    got = {(r.page_id, r.host): (r.bad, r.fold) for r in U.parsed(pages).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, "a.net"): True, (2, "casino.com"): True, (3, "b.org"): False, (4, "a.net"): True, (None, "casino.com"): True}
    assert got[1, "a.net"][1] == got[4, "a.net"][1]
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, 1), (3, 0), (4, None), (None, 0), (99, 1)], "page_id long, bad int")
    again = U.parsed(pages, labels=labels)
    assert again.count() == 5 and {r.page_id: r.bad for r in again.collect()} == {1: False, 2: False, 3: True, 4: True, None: True}


def test_given_labels_are_learned(spark):
    """Labels that follow a lexical pattern, on hosts that the fit has not seen: the reported AUC is of those."""
    rows = [(i, f"http://{'x' * (1 + i % 3)}{i}.site{i % 7}.com/" + ("a-1-" * 6 if i % 2 else "plain/page")) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "page_id long, bad int")
    got = U.judge(pages, labels).collect()
    assert got[0].held_out_auc > 0.95 and len({r.held_out_auc for r in got}) == 1
    assert sum((r.verdict == "block") == r.page_id % 2 for r in got) / len(got) > 0.95
    noise = spark.createDataFrame([(i, i * 7919 % 1009 % 2) for i, _ in rows], "page_id long, bad int")
    assert abs(U.judge(pages, noise).first().held_out_auc - 0.5) < 0.15  # a label of its own would give more


def test_trees_on_a_table(spark):
    got = U.judge(spark.read.parquet(f"{SF_MID}/pages.parquet")).collect()
    assert got[0].held_out_auc is not None and got[0].held_out_auc > 0.6


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, "http://good.example.com/en/"), (2, "http://fine.example.com/en/2")], "page_id long, url string")
    assert {(r.verdict, r.score) for r in U.judge(df).collect()} == {("allow", 0.0)}
