"""Host-level quality rules against a plain reading."""

import re
from collections import Counter, defaultdict

from cases import awkward, empty
from conftest import SF_SMALL

from tiergate.llm import host_quality_rules as H


def measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + o for i in range(len(words) - 2) if grams[words[i], words[i + 1], words[i + 2]] > 1 for o in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def brute(rows, limit=H.HOST_LIMIT):
    """rows (doc_id, text, host) -> Counter of results."""
    out, n, k = [], Counter(), Counter()
    for doc_id, text, host in rows:
        nw, wc, ns, dl, rw = measures(text)
        base = nw < 50 or 100 * rw > 50 * nw
        mean = wc / max(nw, 1)
        n[host] += 1
        k[host] += base or mean < 3 or mean > 14 or ns * 10 > wc
        out.append((doc_id, host, nw, wc, ns, dl, rw, base))
    rates = [k[h] / n[h] for h in n]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    docs = sum(n.values()) / len(n)
    s = max(1.0, min(docs, m * (1 - m) / v - 1)) if v > 0 else docs
    good = {h: (k[h] + s * m) / (n[h] + s) <= limit for h in n}
    return Counter((d, *rest, not rest[-1] and good[h]) for d, h, *rest in out)


def check(spark, docs):
    got = Counter(tuple(r) for r in H.judge(docs).collect())
    assert got == brute([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()])


def test_measures(spark):
    texts = ["a b c a b c", "a b c d a b c", "a a a a", "a b a b a", "x\nx\n x\n\n\n x", "a b c", "", "  a\tb\nc d  a b c d", "é é é é|#"]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in H.measured(df).collect()}
    assert got == {i: measures(t) for i, t in enumerate(texts)}


def test_awkward_rows(spark):
    check(spark, awkward(spark))
    assert H.judge(empty(spark)).count() == 0


def test_table(spark):
    check(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"))


def test_shrinkage(spark):
    """A small bad host is pulled to the others, a large bad one is not."""
    rows = [("small", True)] * 2 + [("large", True)] * 95 + [("large", False)] * 5
    rows += [(f"h{i}", j == 0) for i in range(30) for j in range(20)]
    df = spark.createDataFrame(rows, "host string, failed boolean")
    got = {r.host: r for r in H.host_verdicts(df).collect()}
    assert not got["large"].good and got["h1"].good and got["small"].rate < 1.0
    assert got["small"].rate < got["large"].rate
    same = {r.host: r.rate for r in H.host_verdicts(spark.createDataFrame([("a", True), ("b", True)], "host string, failed boolean")).collect()}
    assert same == {"a": 1.0, "b": 1.0}
    totals = defaultdict(int)
    for r in got.values():
        totals["n"] += r.n_docs
    assert totals["n"] == len(rows)
