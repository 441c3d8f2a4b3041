"""License scan with ordered signature rules.

Texts become lower-case words with one space between them. A text that holds none of the rules' keywords is done after
that. On the others, rules whose keyword occurs are matched, and every match is an interval of words. Intervals are
resolved by priority and containment: sorted by start (longest first, then rule order), an interval goes if one of the
same or a more reliable class contains it. What is left names the licenses.

DataFrame functions inside the row; nothing is shuffled. Markers put around each match turn places into array
positions, so finding them is linear in the text.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergate.llm.common import let, lower_az, text_or_empty
from tiergate.llm.license_rules import rules, stems

#: A plain class (it holds the space): a repeated group would recurse once for each character of a long run.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that always count, in every place.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

CLASS_SCORE = (1.0, 0.9, 0.7, 0.4)
OPEN, CLOSE = "\x01", "\x02"  # control characters never stand in a word


def word_line(text: Column) -> Column:
    """The words of a text between single spaces, with a space at both ends; one space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_az(text), F.lit(" ")), NOT_WORD, " ")


def _rule_table() -> Column:
    """The rules as one literal array."""
    schema = "array<struct<num int, cls int, label string, keyword string, pattern string>>"
    return F.from_json(F.lit(json.dumps(rules())), schema)


def places(line: Column, pattern: Column) -> Column:
    """Word intervals [start, end) of all matches of a pattern in a word line."""
    marked = F.regexp_replace(line, pattern, F.lit(f"{OPEN} $0 {CLOSE}"))

    def of_words(words: Column) -> Column:
        at = lambda mark: F.filter(F.transform(words, lambda w, i: F.when(w == mark, i)), lambda x: x.isNotNull())
        pairs = F.zip_with(at(OPEN), at(CLOSE), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(pairs, lambda p, k: F.struct((p["a"] - 2 * k).alias("start"), (p["b"] - 2 * k - 1).alias("end")))

    return let(F.split(F.btrim(marked), " "), of_words)


def detections(line: Column, table: Column) -> Column:
    """All matches of the rules whose keyword the line holds, by start, longest first, then rule order."""
    tried = F.filter(table, lambda r: line.contains(r["keyword"]) & F.rlike(line, r["pattern"]))

    def found(r: Column) -> Column:
        return F.transform(
            places(line, r["pattern"]),
            lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("neg_end"), r["num"].alias("num"), r["cls"].alias("cls"), r["label"].alias("label")),
        )

    return F.array_sort(F.flatten(F.transform(tried, found)))


def resolved(found: Column) -> Column:
    """(labels, score) of the detections that no detection of the same or a more reliable class contains."""
    classes = range(len(CLASS_SCORE))
    start = F.struct(
        *(F.lit(-1).alias(f"end_{c}") for c in classes),
        F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"),
    )

    def step(acc: Column, d: Column) -> Column:
        end = -d["neg_end"]
        reach, weight = acc["end_0"], F.lit(CLASS_SCORE[0])
        for c in classes:
            reach = F.when(d["cls"] == c, acc[f"end_{c}"]).otherwise(reach)
            weight = F.when(d["cls"] == c, CLASS_SCORE[c]).otherwise(weight)
        stays = end > reach  # an earlier interval starts no later; it contains this one if it ends no sooner
        return F.struct(
            *(F.when(d["cls"] <= c, F.greatest(acc[f"end_{c}"], end)).otherwise(acc[f"end_{c}"]).alias(f"end_{c}") for c in classes),
            F.when(stays, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(stays, F.greatest(acc["score"], weight)).otherwise(acc["score"]).alias("score"),
        )

    return F.aggregate(found, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``.

    A null text counts as empty: no words, no places, empty label strings, score 0. Repeated rows are scanned once
    each; other columns are ignored; an empty table gives an empty result. ``score``: the weight of the most reliable
    detection that is left, 1 where a base phrase stands.
    """
    table = _rule_table()
    nothing = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    no_place = F.array().cast("array<struct<start int, end int>>")

    def of_line(line: Column) -> Column:
        spots = [F.when(line.contains(f" {phrase} "), places(line, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(no_place) for phrase, _ in BASE]
        base = F.array_compact(F.array(*(F.when(line.contains(f" {phrase} "), label) for phrase, label in BASE)))
        gate = reduce(lambda a, b: a | b, [line.contains(s) for s in stems()])
        return F.struct(
            (F.length(line) - F.length(F.replace(line, F.lit(" "))) - 1).cast("long").alias("n_words"),
            F.array_sort(F.transform(F.concat(*spots), lambda p: p["start"])).alias("starts"),
            base.alias("base"),
            F.when(gate, resolved(detections(line, table))).otherwise(nothing).alias("more"),
        )

    rows = docs.select("doc_id", F.inline(F.transform(F.array(word_line(text_or_empty(text))), of_line)))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.get("starts", F.lit(0)).cast("long").alias("first_word"),
        F.element_at("starts", F.when(F.size("starts") > 0, -1).otherwise(F.lit(None))).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "more.labels")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.col("more.score")).alias("score"),
    )
