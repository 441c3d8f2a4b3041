"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each visit fits a shallow tree (at most four leaves) to the logistic
gradient of one binned feature and adds it to that feature's lookup table. The strongest feature pairs, ranked by the
gain that the residual leaves on a coarse grid, get two-dimensional tables the same way. A score is the sum of table
entries at the document's bins, through the logistic function.

Training rows are a bounded sample of the labelled documents (``max_train_rows``, lowest hash first, so reruns agree);
feature extraction and scoring run over every whole text inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_words", "log_bytes", "mean_word", "std_word", "long_words", "distinct_words", "top_word",
    "upper", "digits", "spaces", "sentence_ends", "commas", "shouts", "symbols", "brackets", "other_ascii",
    "non_ascii", "entropy", "log_lines", "distinct_lines", "words_per_line", "capital_words", "number_words", "short_words",
)

_CLASS = np.zeros((10, 256))
for _row, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".", b",;:", b"!?", b"#*$%&|<>", b"()[]{}\"'", b"-_/\\@+=~^`")
):
    _CLASS[_row, list(_chars)] = 1
_CLASS[9, 128:] = 1


def features_of(text: str | None) -> np.ndarray:
    """Feature vector of one whole text; null counts as empty, and an empty text gives zeros."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return out
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    up, dig, sp, ends, commas, shouts, sym, br, other, wide = (_CLASS @ counts) / n
    p = counts[counts > 0] / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    nw, nl = len(words), max(1, len(lines))
    if nw:
        lens = np.fromiter(map(len, words), np.int64, nw)
        kinds = set(words)
        firsts = np.frombuffer(bytes([w[0] for w in words]), np.uint8)
        mean, std = lens.mean(), lens.std()
        long_, short = (lens > 14).mean(), (lens <= 2).mean()
        distinct = len(kinds) / nw
        top = words.count(words[0]) / nw
        caps = ((firsts >= 65) & (firsts <= 90)).mean()
        nums = ((firsts >= 48) & (firsts <= 57)).mean()
    else:
        mean = std = long_ = short = distinct = top = caps = nums = 0.0
    return np.array(
        (
            np.log1p(nw), np.log1p(n), mean, std, long_, distinct, top, up, dig, sp, ends, commas, shouts, sym, br, other,
            wide, -(p * np.log2(p)).sum(), np.log1p(nl), len(set(lines)) / nl, nw / nl, caps, nums, short,
        )
    )


def feature_matrix(texts) -> np.ndarray:
    return np.stack([features_of(t) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))


@dataclass
class GamModel:
    """Lookup tables of a fitted model. ``cuts[f]`` are bin borders; pair tables use the coarse borders."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.cuts[f], x[:, f], side="right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return _logistic(z)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _borders(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if len(v) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of one run of bins; place 0 if no cut leaves enough weight on both sides."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gt, ht = gl[-1] + g[-1], hl[-1] + h[-1]
    gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
    gain[(hl < least) | (ht - hl < least)] = 0
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 0 else (0.0, 0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> np.ndarray:
    """Leaf value for every bin of a tree of depth two."""
    out = np.zeros(len(g))
    _, mid = _best_cut(g, h, penalty, least)
    for lo, hi in ((0, mid), (mid, len(g))) if mid else ((0, len(g)),):
        _, at = _best_cut(g[lo:hi], h[lo:hi], penalty, least)
        for a, b in ((lo, lo + at), (lo + at, hi)) if at else ((lo, hi),):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> np.ndarray:
    """The better of two depth-two trees over a grid: rows first then columns, or columns first then rows."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, gg.shape[0]):
            value, gain = np.zeros_like(gg), 0.0
            for lo, hi in ((0, cut), (cut, gg.shape[0])):
                gs, hs = gg[lo:hi].sum(0), hh[lo:hi].sum(0)
                _, at = _best_cut(gs, hs, penalty, least)
                for a, b in ((0, at), (at, len(gs))) if at else ((0, len(gs)),):
                    gain += gs[a:b].sum() ** 2 / (hs[a:b].sum() + penalty)
                    value[lo:hi, a:b] = gs[a:b].sum() / (hs[a:b].sum() + penalty)
            if gain > best:
                best, out = gain, value.T if turned else value
    return out


def fit_gam(
    x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 8, rounds: int = 160, pair_rounds: int = 60,
    n_pairs: int = 6, rate: float = 0.12, penalty: float = 4.0, least: float = 2.0,
) -> GamModel:
    """Fit on features ``x`` and labels ``y`` in 0..1. Without rows, or without features, every score is 0.5."""
    model = GamModel()
    if not len(x):
        return model
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.intercept = float(np.log(mean / (1 - mean)))
    n_f = x.shape[1]
    model.cuts = [_borders(x[:, f], bins) for f in range(n_f)]
    model.coarse = [_borders(x[:, f], coarse_bins) for f in range(n_f)]
    at = [np.searchsorted(model.cuts[f], x[:, f], side="right") for f in range(n_f)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(x), model.intercept)
    for _ in range(rounds):
        for f in range(n_f):
            p = _logistic(z)
            size = len(model.tables[f])
            step = rate * _shallow_tree(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), penalty, least)
            model.tables[f] += step
            z += step[at[f]]
    p = _logistic(z)
    small = [np.searchsorted(model.coarse[f], x[:, f], side="right") for f in range(n_f)]
    ranked = []
    for a in range(n_f):
        for b in range(a + 1, n_f):
            size = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
            cell = small[a] * size[1] + small[b]
            g, h = (np.bincount(cell, w, size[0] * size[1]) for w in (y - p, p * (1 - p)))
            ranked.append((float((g**2 / (h + penalty)).sum()), a, b, size, cell))
    ranked.sort(key=lambda r: (-r[0], r[1], r[2]))
    chosen = [(a, b, size, cell, np.zeros(size)) for _, a, b, size, cell in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for _a, _b, size, cell, table in chosen:
            p = _logistic(z)
            g, h = (np.bincount(cell, w, size[0] * size[1]).reshape(size) for w in (y - p, p * (1 - p)))
            step = rate * _pair_tree(g, h, penalty, least)
            table += step
            z += step.ravel()[cell]
    model.pairs = [(a, b, table) for a, b, _, _, table in chosen]
    return model


def held_out(doc_id: Column) -> Column:
    """True for one document in five, by the CRC-32 of its id as text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, label: str = "quality") -> DataFrame:
    """(doc_id, text, y) of at most ``max_train_rows`` labelled documents that are not held out, lowest id hash first.

    Labels that repeat an id are averaged, and of documents that repeat an id the smallest text counts, once; null ids,
    null labels and labels without a document do not count.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("double").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.avg("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> GamModel:
    """Fit the model; only the feature vectors of the bounded sample reach the driver."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "x": list(feature_matrix(part["text"])), "y": part["y"]})

    rows = training_rows(docs, labels, max_train_rows).mapInPandas(extract, "doc_id long, x array<double>, y double").toPandas()
    if rows.empty:
        return fit_gam(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(rows["x"]), rows["y"].to_numpy(float)
    order = np.lexsort([*x.T, y, rows["doc_id"].to_numpy()])  # the same sums whatever the order of arrival
    return fit_gam(x[order], y[order])


def score_column(model: GamModel, text: str = "text") -> Column:
    """The model's score of a text column, as an Arrow-batched expression."""

    @F.pandas_udf("double")
    def gam_score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_matrix(texts)))

    return gam_score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, repeated rows included.

    Null and empty texts are scored as texts without words; with no usable label every score is 0.5. Other columns
    of ``docs`` are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, max_train_rows)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` (all columns) that the classifier does not reject."""
    return docs.filter(score_column(train(docs, labels, max_train_rows)) >= threshold)
