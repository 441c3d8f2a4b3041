"""ROUGE-1 / ROUGE-2 / ROUGE-L F-measure over a table of text pairs.

Input: ``pairs(pair_id, pred, ref, <group cols>)``. Tokens: lower case, every run of characters outside
``[a-z0-9]`` is a separator.

ROUGE-N is a counting job inside one row: both texts of a pair are already in the same row, so the clipped n-gram
overlap needs no shuffle at all. Tokens are made JVM-side (``lower`` + ``regexp_replace`` + ``split``); one
Arrow-batched pandas UDF counts the n-grams of both sides for every requested n in one pass (``Counter``
intersection). Only the final mean over pairs aggregates (partial, then a tiny shuffle).
Where all numbers of a pair are wanted at once (``plans.text_eval``), ``overlaps`` and ``lcs_lengths`` take them from the word numbers
of a whole batch (``token_columns``), as array operations over all its pairs.
``rouge_n_exploded`` keeps the relational form (explode grams, aggregate per (pair, gram), clip, sum): it shuffles
every n-gram, so it is only for cross-checking.

ROUGE-L needs the longest common subsequence of each pair - sequential, quadratic work that no built-in
expresses. It runs as an Arrow-batched pandas UDF over the token arrays with a bit-parallel LCS (a few machine
words per token of the other side), on whole texts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .token_columns import counted, distinct, found_in, pair_codes, row_of

DIGITS = 9


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    cleaned = F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def ngrams(toks: Column, n: int) -> Column:
    if n == 1:
        return toks
    parts = [F.slice(toks, k + 1, F.greatest(F.size(toks) - F.lit(n - 1), F.lit(0))) for k in range(n)]
    zipped = F.arrays_zip(*parts)
    return F.transform(zipped, lambda z: F.concat_ws(" ", *[z[str(k)] for k in range(n)]))


def _fmeasure(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def _overlap_counts(pred: Sequence[str], ref: Sequence[str], n: int) -> tuple[int, int, int]:
    from collections import Counter

    p = Counter(tuple(pred[i : i + n]) for i in range(len(pred) - n + 1))
    r = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
    return sum(p.values()), sum(r.values()), sum((p & r).values())


def _counts_batch(ns: tuple[int, ...]):
    def run(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        cols: dict[str, list[int]] = {f"{k}{n}": [] for n in ns for k in ("np", "nr", "ov")}
        for p, r in zip(pred, ref):
            p = [] if p is None else list(p)
            r = [] if r is None else list(r)
            for n in ns:
                a, b, c = _overlap_counts(p, r, n)
                cols[f"np{n}"].append(a)
                cols[f"nr{n}"].append(b)
                cols[f"ov{n}"].append(c)
        return pd.DataFrame(cols)

    return run


def rouge_counts(pairs: DataFrame, ns: Sequence[int] = (1, 2), group_cols: Sequence[str] = ()) -> DataFrame:
    """Per pair: n-gram counts of both sides and the clipped overlap for every n in ``ns`` (no shuffle)."""
    ns = tuple(ns)
    schema = ", ".join(f"{k}{n} bigint" for n in ns for k in ("np", "nr", "ov"))
    udf = F.pandas_udf(_counts_batch(ns), schema)
    t = pairs.select(*group_cols, "pair_id", udf(tokens("pred"), tokens("ref")).alias("c"))
    return t.select(*group_cols, "pair_id", "c.*")


def _prf(overlap: Column, n_pred: Column, n_ref: Column) -> tuple[Column, Column, Column]:
    p = F.when(n_pred > 0, overlap / n_pred).otherwise(F.lit(0.0))
    r = F.when(n_ref > 0, overlap / n_ref).otherwise(F.lit(0.0))
    return p, r, _fmeasure(p, r)


def rouge_n_pairs(pairs: DataFrame, n: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per pair: overlap, counts and P / R / F of ROUGE-n."""
    c = rouge_counts(pairs, (n,), group_cols)
    p, r, f = _prf(F.col(f"ov{n}"), F.col(f"np{n}"), F.col(f"nr{n}"))
    return c.select(
        *group_cols, "pair_id", F.col(f"ov{n}").alias("overlap"), F.col(f"np{n}").alias("n_pred"), F.col(f"nr{n}").alias("n_ref"),
        p.alias("p"), r.alias("r"), f.alias("f"),
    )


def rouge_n_exploded(pairs: DataFrame, n: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Relational ROUGE-n per pair (cross-check only: shuffles every n-gram)."""
    g = list(group_cols)
    side = lambda col, tag: pairs.select(
        *g, "pair_id", F.explode(ngrams(tokens(col), n)).alias("gram"), F.lit(tag).alias("side")
    )
    grams = side("pred", "p").unionByName(side("ref", "r"))
    per_gram = grams.groupBy(*g, "pair_id", "gram").agg(
        F.sum(F.when(F.col("side") == "p", 1).otherwise(0)).alias("pc"),
        F.sum(F.when(F.col("side") == "r", 1).otherwise(0)).alias("rc"),
    )
    per_pair = per_gram.groupBy(*g, "pair_id").agg(
        F.sum(F.least("pc", "rc")).alias("overlap"), F.sum("pc").alias("n_pred"), F.sum("rc").alias("n_ref")
    )
    # pairs where one side has no n-gram at all still count (score 0)
    everyone = pairs.select(*g, "pair_id")
    full = everyone.join(per_pair, [*g, "pair_id"], "left").fillna(0, subset=["overlap", "n_pred", "n_ref"])
    p = F.when(F.col("n_pred") > 0, F.col("overlap") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("n_ref") > 0, F.col("overlap") / F.col("n_ref")).otherwise(F.lit(0.0))
    return full.select(*g, "pair_id", "overlap", "n_pred", "n_ref", p.alias("p"), r.alias("r"), _fmeasure(p, r).alias("f"))


def rouge_n(pairs: DataFrame, n: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean ROUGE-n F over the pairs of each group."""
    per = rouge_n_pairs(pairs, n, group_cols)
    return per.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("f"), DIGITS).alias(f"rouge{n}"))


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Bit-parallel LCS length (one big-int word-vector over ``a``, one step per token of ``b``)."""
    if not len(a) or not len(b):
        return 0
    pos: dict[str, int] = {}
    for i, t in enumerate(a):
        pos[t] = pos.get(t, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    v = mask
    for t in b:
        u = v & pos.get(t, 0)
        v = ((v + u) | (v - u)) & mask
    return len(a) - bin(v).count("1")


def _clipped(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], span: int, n_rows: int) -> np.ndarray:
    """Clipped overlap of each row's grams; ``a``, ``b``: (gram below ``span``, row)."""
    (p, p_n), (r, r_n) = (counted(rows * span + grams) for grams, rows in (a, b))
    both, at = found_in(p, r)
    return np.bincount(p[both] // span, weights=np.minimum(p_n[both], r_n[at[both]]), minlength=n_rows).astype(np.int64)


def overlaps(words: int, pred: tuple[np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """np, nr and ov of words (1) and word pairs (2) of every row; ``pred``, ``ref``: (codes, offsets) of ``word_codes``, of
    ``words`` different words."""
    n_rows, out = len(pred[1]) - 1, {}
    rows = [row_of(offsets) for _, offsets in (pred, ref)]
    singles = [(codes, row) for (codes, _), row in zip((pred, ref), rows)]
    pairs = [pair_codes(words, codes, row) for codes, row in singles]
    known, at = distinct(np.r_[pairs[0][0], pairs[1][0]])
    pairs = [(at[: len(pairs[0][0])], pairs[0][1]), (at[len(pairs[0][0]) :], pairs[1][1])]
    for n, grams, span in ((1, singles, words), (2, pairs, len(known))):
        for side, (_, row) in zip("pr", grams):
            out[f"n{side}{n}"] = np.bincount(row, minlength=n_rows)
        out[f"ov{n}"] = _clipped(*grams, max(span, 1), n_rows)
    return out


def lcs_lengths(words: int, pred: tuple[np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Length of the longest common subsequence of every row. Words that the other side does not hold cannot be in it."""
    span, n_rows = max(words, 1), len(pred[1]) - 1
    keys = [row_of(offsets) * span + codes for codes, offsets in (pred, ref)]
    held = [np.unique(k) for k in keys]
    sides = []
    for own, other in ((0, 1), (1, 0)):
        kept = keys[own][found_in(keys[own], held[other])[0]]
        sides.append(((kept % span).tolist(), np.searchsorted(kept // span, np.arange(n_rows + 1)).tolist()))
    (a, a_at), (b, b_at) = sides
    out = np.zeros(n_rows, np.int64)
    for i in range(n_rows):
        x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
        out[i] = len(x) if x == y else lcs_length(x, y) if len(x) > len(y) else lcs_length(y, x)
    return out


def _lcs_batch(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([0 if p is None or r is None else lcs_length(list(p), list(r)) for p, r in zip(pred, ref)], dtype="int64")


def _lcs_udf(pred: Column, ref: Column) -> Column:
    # built when the plan is built (driver side); workers only unpickle ``_lcs_batch``
    return F.pandas_udf(_lcs_batch, "bigint")(pred, ref)


def rouge_l_pairs(pairs: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    toks = pairs.select(*group_cols, "pair_id", tokens("pred").alias("pt"), tokens("ref").alias("rt"))
    with_lcs = toks.select(*group_cols, "pair_id", F.size("pt").alias("n_pred"), F.size("rt").alias("n_ref"), _lcs_udf("pt", "rt").alias("lcs"))
    p = F.when(F.col("n_pred") > 0, F.col("lcs") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("n_ref") > 0, F.col("lcs") / F.col("n_ref")).otherwise(F.lit(0.0))
    return with_lcs.select("*", _fmeasure(p, r).alias("f"))


def rouge_l(pairs: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    per = rouge_l_pairs(pairs, group_cols)
    return per.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("f"), DIGITS).alias("rougeL"))
