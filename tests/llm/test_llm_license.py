"""License scan against a plain reading of its rules."""

import random
import re
from collections import Counter

import pytest
from cases import awkward, empty
from conftest import SF_SMALL

from tiergate.llm import license_scan as L
from tiergate.llm.license_rules import rules, stems


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, base = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    line, found = f" {' '.join(words)} " if words else " ", []
    for r in rules():
        for m in re.finditer(r["pattern"], line):
            a = line[: m.start()].count(" ") - 1
            found.append((a, -(a + m[0].count(" ") + 1), r["num"], r["cls"], r["label"]))
    found.sort()
    labels, score = set(), 0.0
    for i, d in enumerate(found):
        if not any(e[1] <= d[1] and e[3] <= d[3] for e in found[:i]):
            labels.add(d[4])
            score = max(score, L.CLASS_SCORE[d[3]])
    joined = lambda s: ",".join(sorted(s))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), joined(base), joined(base | labels), 1.0 if base else score


TEXTS = [
    "Under the MIT License under the mit license", "x Apache-License, Version 2.0! cc by-nc 4.0", "GNU lesser general public license version 3; GNU General Public License v3",
    "SPDX-License-Identifier: GPL-3.0-or-later\nreleased under the MIT license.", "K under the mit license K café ×2 $1 \\x", "all rights reserved " * 300,
    "see https://creativecommons.org/licenses/by-nc/4.0/ and www.mozilla.org/MPL/2.0", "BSD 3-clause license, 2-clause BSD license under the unlicense", "cc by nc sa 4.0 cc by",
    "bunder the mit license", "under the mit licensed", "Permission is hereby granted, free of charge, to any person obtaining a copy", "mİt license under the mit licenſe",
]


def test_rule_table():
    assert len(rules()) > 200 and len({r["pattern"] for r in rules()}) > 200
    assert [r["cls"] for r in rules()] == sorted(r["cls"] for r in rules())
    for r in rules():
        assert any(s in r["stem"] for s in stems())


def example(tree, pick) -> str:
    """A random text that a parsed expression matches."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, value = pick.choice(arg)
            out += chr(value if str(kind) == "LITERAL" else pick.randint(*value))
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            out += "".join(example(inner, pick) for _ in range(pick.randint(low, min(high, low + 2))))
        elif op == "BRANCH":
            out += example(pick.choice(arg[1]), pick)
        elif op == "SUBPATTERN":
            out += example(arg[-1], pick)
        else:
            assert op == "ASSERT", op
    return out


def test_every_match_passes_the_prefilter():
    """Whatever a rule can match holds its keyword and its stem."""
    pick = random.Random(1)
    for r in rules():
        tree = re._parser.parse(r["pattern"].removeprefix("(?<= )").removesuffix("(?= )"))
        for _ in range(60):
            text = example(tree, pick)
            assert re.search(r["pattern"], f" {text} "), (r, text)
            assert r["keyword"] in f" {text} " and r["stem"] in text, (r, text)


def test_operator(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, ""])]
    got = {r.doc_id: tuple(r)[1:] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert Counter(tuple(r) for r in L.scan(docs).collect()) == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert L.scan(empty(spark)).count() == 0


def test_long_runs_of_separators(spark):
    runs = [" " * 100_000, "\t" * 100_000, " \t\n.-| " * 20_000, " " * 100_000 + "under the MIT license" + " \t" * 50_000, "released under" + " " * 100_000 + "the MIT" + "-" * 100_000 + " license"]
    rows = list(enumerate(runs))
    got = {r.doc_id: tuple(r)[1:] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


@pytest.mark.parametrize("sf", [SF_SMALL])
def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {tuple(r) for r in L.scan(docs).collect()} == {(r.doc_id, *brute(r.text)) for r in docs.collect()}
