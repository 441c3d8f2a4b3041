"""Scorers trained by epochs, kept in a registry, and applied all at once.

A scorer is a logistic model over hashed token features of what it reads. Words of a prompt that all its answers are read with
are counted, kept and multiplied once (``shared_examples``). Training is full-batch gradient descent, one pass
over the written examples per epoch, with the weights of the epoch before as warm start. All scorers of a grid learn in
the same pass: a task holds one weight column per scorer, multiplies its sparse examples with all of them (chunk by chunk, as
matrices, no Python object per row or word) and adds up
partial gradients and losses, which Spark sums by (scorer, feature). What reaches the driver is (features +
losses) x scorers numbers, whatever the number of rows. The weights of each epoch are kept; the epoch with the lowest
validation loss is chosen, and a scorer can stop ``patience`` epochs after it.

The registry is a table (strategy, model or null) -> weights. A row of a model is scored by the strategy's own scorer for
that model or, where there is none, by its pooled one (model null); all strategies come from one pass.

The studied scorers are fine-tuned transformers; our mapping of a grid row is: step = 0.5 x sqrt(learning rate / 1e-5),
training text "stripped" or "original", and a base for long inputs ("longformer") reads word pairs besides words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.token_columns import distinct, found_in, hash32, hashes, lengths, pair_codes, row_of, slices, spans, word_codes
from ..session import staged

N_FEATURES = 1024
WEIGHT_LIMIT_BYTES = 64 << 20
CHUNK_ROWS = 1_000  # of a batch, read and multiplied at once (as a dense matrix of this many rows)
PART_BYTES, ANSWER_BYTES = 4 << 20, 64  # of packed features read at once; what an answer counts for beside its features
DIGITS = 6
#: Rows of a pass beside the feature gradients.
INTERCEPT, TRAIN_LOSS, N_TRAIN, VAL_LOSS, N_VAL = range(5)
REGISTRY = "strategy string, model string, kind string, epoch int, intercept double, weights array<double>"


@dataclass(frozen=True)
class Scorer:
    """One scorer to train: its strategy, the model whose answers it reads (None: all), its step and number of epochs, and
    the kind of its features, ``<training text>/<words or pairs>``."""

    strategy: str
    model: str | None
    step: float
    epochs: int
    kind: str = "stripped/words"


def step_of(learning_rate: float) -> float:
    return 0.5 * math.sqrt(learning_rate / 1e-5)


def scorers_of(grid: Sequence[tuple], models: Sequence[str]) -> list[Scorer]:
    """The scorers of grid rows (strategy, learning rate, epochs, layout, training text, base): one per model, or one pooled."""
    out = []
    for strategy, rate, epochs, layout, text, base in grid:
        kind = f"{text}/{'pairs' if base and base.startswith('longformer') else 'words'}"
        out += [Scorer(strategy, m, step_of(rate), epochs, kind) for m in (models if layout == "per-model" else [None])]
    return out


# --- examples -------------------------------------------------------------------------------------------------------


def _bucket(token: str, n: int) -> int:
    return hash32(token) % n


FEATURES = pa.struct([("idx", pa.binary()), ("n", pa.binary())])


def _features(text: pa.Array, pairs: np.ndarray, n_features: int) -> pa.Array:
    """struct<idx, n> of lower-cased texts, a slice of bounded size at a time."""

    def of_slice(text: pa.Array, two: np.ndarray) -> pa.Array:
        words, ((codes, offsets),) = word_codes(text)
        rows = row_of(offsets)
        buckets = (hashes(words) % n_features)[codes]
        if two.any():
            asked = two[rows]
            numbers, pair_rows = pair_codes(len(words), codes[asked], rows[asked])
            known, at = distinct(numbers)
            named = np.fromiter((hash32(f"{words[k // len(words)]} {words[k % len(words)]}") for k in known.tolist()), np.int64, len(known))
            rows, buckets = np.r_[rows, pair_rows], np.r_[buckets, (named % n_features)[at]]
        counts = np.bincount(rows * n_features + buckets, minlength=len(text) * n_features)
        some = np.flatnonzero(counts)
        ends = np.r_[0, np.cumsum(np.bincount(some // n_features, minlength=len(text)))].astype(np.int32) * 4
        packed = [pa.BinaryArray.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(ends), pa.py_buffer(x.astype("<i4"))]) for x in (some % n_features, counts[some])]
        return pa.StructArray.from_arrays(packed, fields=list(FEATURES))

    parts, at = [], 0
    for (part,) in slices(text, parts=4):
        parts.append(of_slice(part, pairs[at : at + len(part)]))
        at += len(part)
    return pa.concat_arrays(parts) if parts else pa.array([], FEATURES)


def _flags(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, False).to_numpy(zero_copy_only=False).astype(bool)


def feature_udf(n_features: int):
    """struct<idx, n> of lower-cased texts: the features that a text has, in order, and how often (words, and pairs where asked).
    Both are arrays of 32-bit integers in one binary value, which every epoch reads without a step per feature."""

    @F.arrow_udf("idx binary, n binary")
    def features(text: pa.Array, pairs: pa.Array) -> pa.Array:
        return _features(text, _flags(pairs), n_features)

    return features


def shared_feature_udf(n_features: int):
    """The same of a row's text, and in ``own`` of each of its answers' texts."""

    @F.arrow_udf("idx binary, n binary, own array<struct<idx: binary, n: binary>>")
    def features(text: pa.Array, own: pa.Array, pairs: pa.Array) -> pa.Array:
        two, sizes = _flags(pairs), pc.fill_null(pc.list_value_length(own), 0).to_numpy().astype(np.int64)
        shared, parts = _features(text, two, n_features), _features(own.flatten(), np.repeat(two, sizes), n_features)
        parts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), parts)
        return pa.StructArray.from_arrays([*shared.flatten(), parts], names=["idx", "n", "own"])

    return features


def examples(rows: DataFrame, kinds: Sequence[str], n_features: int = N_FEATURES) -> DataFrame:
    """(model, prompt_id, tier, split, label, kind, idx, n), written once: an example per row and kind of features (``feature_udf``).

    ``rows``: (model, prompt_id, tier, split, label, scorer_text, response); a null text has no feature.
    """
    long = rows.select("model", "prompt_id", "tier", "split", "label", "scorer_text", "response", F.explode(_wanted(kinds)).alias("k"))
    text = F.when(F.col("k.text") == "original", F.col("response")).otherwise(F.col("scorer_text"))
    out = long.select("model", "prompt_id", "tier", "split", "label", F.col("k.kind").alias("kind"), feature_udf(n_features)(F.lower(text), F.col("k.pairs")).alias("x"))
    return staged(out.select("model", "prompt_id", "tier", "split", "label", "kind", "x.idx", "x.n"), "scorer-examples")


def _wanted(kinds: Sequence[str]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(k.split("/")[0]).alias("text"), F.lit(k.endswith("/pairs")).alias("pairs")) for k in kinds))


def shared_examples(rows: DataFrame, kinds: Sequence[str], n_features: int = N_FEATURES) -> DataFrame:
    """(prompt_id, split, kind, idx, n, answers), written once: the examples of ``examples``, a row per prompt and kind.

    ``rows``: (prompt_id, split, shared_text, answers), see ``scorer.training_prompts``. Words that all answers to a prompt are
    read with are counted once, in ``idx`` and ``n``; an answer (model, tier, label, known, idx, n) adds its own, and has no
    feature at all where it is not ``known`` (null text). Pairs of words cross the border of the two texts and are the answers' own.
    """
    long = rows.select("prompt_id", "split", "shared_text", "answers", F.explode(_wanted(kinds)).alias("k"))
    split_up = (F.col("k.text") != "original") & ~F.col("k.pairs")
    whole = lambda a: F.when(F.col("k.text") == "original", a["response"]).otherwise(F.concat("shared_text", a["own_text"]))
    texts = F.transform("answers", lambda a: F.lower(F.when(split_up, a["own_text"]).otherwise(whole(a))))
    meta = F.transform("answers", lambda a: F.struct(a["model"].alias("model"), a["tier"].alias("tier"), a["label"].alias("label")))
    long = long.select("prompt_id", "split", "k", F.when(split_up, F.lower("shared_text")).alias("shared"), texts.alias("texts"), meta.alias("meta"))
    x = shared_feature_udf(n_features)("shared", "texts", "k.pairs")
    out = long.select("prompt_id", "split", "k.kind", "meta", F.transform("texts", lambda t: t.isNotNull()).alias("known"), x.alias("x"))
    answers = F.transform("meta", lambda a, i: F.struct(
        a["model"].alias("model"), a["tier"].alias("tier"), a["label"].alias("label"), F.get("known", i).alias("known"),
        F.get("x.own", i)["idx"].alias("idx"), F.get("x.own", i)["n"].alias("n"),
    ))
    return staged(out.select("prompt_id", "split", "kind", "x.idx", "x.n", answers.alias("answers")), "scorer-examples")


def _by_prompt(data: DataFrame) -> DataFrame:
    """Examples in the form of ``shared_examples``: those of ``examples`` share no words."""
    answer = lambda a: F.struct(
        a["model"].alias("model"), a["tier"].cast("int").alias("tier"), a["label"].cast("double").alias("label"), a["known"].alias("known"), a["idx"].alias("idx"), a["n"].alias("n"),
    )
    if "answers" in data.columns:
        idx, n, answers = F.col("idx"), F.col("n"), F.transform("answers", answer)
    else:
        own = {c: F.col(c) for c in ("model", "tier", "label", "idx", "n")} | {"known": F.lit(True)}
        idx, n, answers = F.lit(b""), F.lit(b""), F.array(answer(own))
    return data.select(F.col("prompt_id").cast("long").alias("prompt_id"), "split", "kind", idx.alias("idx"), n.alias("n"), answers.alias("answers"))


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the rows, integers) of a column of packed integers; null is none."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, ends, raw = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return (offsets - offsets[0]) // 4, data.view("<i4").astype(np.int64)


@dataclass
class _Counts:
    """Counts of features of some rows: offsets of the rows, then feature and count of each entry."""

    offsets: np.ndarray
    feature: np.ndarray
    count: np.ndarray

    @classmethod
    def read(cls, idx: pa.Array, n: pa.Array) -> _Counts:
        offsets, feature = _integers(idx)
        return cls(offsets, feature, _integers(n)[1].astype(float))

    def squares(self) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(self.count * self.count)]  # whole numbers: exact
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def dense(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features that ``rows`` have, matrix of the counts: rows x these features)."""
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        at = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.offsets[rows], sizes)
        feature = self.feature[place]
        known = np.flatnonzero(np.bincount(feature)) if len(feature) else np.zeros(0, np.int64)
        number = np.zeros(known[-1] + 1 if len(known) else 0, np.int64)
        number[known] = np.arange(len(known))
        matrix = np.bincount(at * len(known) + number[feature], weights=self.count[place], minlength=len(rows) * len(known))
        return known, matrix.reshape(len(rows), len(known))


class _Part:
    """A slice of rows of ``_by_prompt`` (see ``_parts``), as arrays; each example's counts are scaled to length 1."""

    def __init__(self, batch: pa.RecordBatch, n_features: int):
        self.batch = batch
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        answers, self.kind = column("answers"), column("kind")
        self.row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(answers), 0).to_numpy())  # of each answer
        flat = answers.flatten()
        self.answer = dict(zip((f.name for f in flat.type), flat.flatten()))
        self.known = _flags(self.answer["known"])
        self.shared, self.own = _Counts.read(column("idx"), column("n")), _Counts.read(self.answer["idx"], self.answer["n"])
        of_answer = row_of(self.own.offsets)
        there = row_of(self.shared.offsets) * n_features + self.shared.feature  # in order
        both, at = found_in(self.row[of_answer] * n_features + self.own.feature, there)
        cross = np.bincount(of_answer[both], weights=(self.own.count[both] * self.shared.count[at[both]]), minlength=len(self.row))
        length = np.sqrt(np.where(self.known, self.shared.squares()[self.row] + 2 * cross, 0) + self.own.squares())
        self.scale = np.divide(1.0, length, out=np.zeros(len(length)), where=length > 0)

    def split(self, name: str) -> np.ndarray:
        return _flags(pc.equal(self.batch.column(self.batch.schema.get_field_index("split")), name))[self.row]

    def groups(self, own_of: Callable[[str, str], tuple]) -> dict[tuple, np.ndarray]:
        """Answers by what ``own_of(kind, model)`` gives; those without a kind or model are in none."""
        kind, model = self.kind.dictionary_encode(), self.answer["model"].dictionary_encode()
        n = max(len(model.dictionary), 1)
        pair = pc.fill_null(kind.indices, -1).to_numpy().astype(np.int64)[self.row]
        pair = np.where((pair < 0) | model.indices.is_null().to_numpy(zero_copy_only=False), -1, pair * n + pc.fill_null(model.indices, 0).to_numpy())
        found: dict[tuple, list] = {}
        for x in np.unique(pair[pair >= 0]).tolist():
            found.setdefault(own_of(kind.dictionary[x // n].as_py(), model.dictionary[x % n].as_py()), []).append(x)
        return {own: np.flatnonzero(np.isin(pair, some)) for own, some in found.items() if own}


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the features of each row, those of its answers included."""
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    flat = column("answers").flatten()
    answer = dict(zip((f.name for f in flat.type), flat.flatten()))
    total = np.r_[0, np.cumsum(lengths(answer["idx"], answer["n"]) + ANSWER_BYTES)]
    counts = pc.fill_null(pc.list_value_length(column("answers")), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(counts)
    return lengths(column("idx"), column("n")) + total[ends] - total[ends - counts]


def _parts(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[_Part]:
    """Batches in slices of at most CHUNK_ROWS rows and PART_BYTES of features (one row at least), so what a task holds beside
    Spark's batch follows neither its size nor the length of texts or the number of answers to a prompt."""
    for batch in batches:
        for at, end in spans(_sizes(batch), CHUNK_ROWS, PART_BYTES):
            yield _Part(batch.slice(at, end - at), n_features)


def _scored(part: _Part, own_of: Callable[[str, str], tuple], weights: np.ndarray, intercept: np.ndarray, learn: Callable | None = None) -> Iterator[tuple]:
    """(columns of weights, answers, probabilities) of a part, for its answers by the columns that ``own_of`` gives them.

    With ``learn(columns, answers, probabilities) -> error`` the gradient comes last, as (None, features, gradient of all columns).
    """
    with_words = np.flatnonzero(np.diff(part.shared.offsets))
    known, shared = part.shared.dense(with_words)
    place = np.zeros(len(part.shared.offsets) - 1, np.int64)
    place[with_words] = np.arange(len(with_words))
    by_words = part.known & (np.diff(part.shared.offsets) > 0)[part.row]
    groups = part.groups(own_of)
    used = np.array(sorted({c for own, rows in groups.items() if by_words[rows].any() for c in own}), np.int64)
    product, error_sum = shared @ weights[np.ix_(known, used)], np.zeros((len(with_words), len(used)))
    for chosen, rows in groups.items():
        columns = np.array(chosen, np.int64)
        in_used = np.searchsorted(used, columns)
        for k in range(0, len(rows), CHUNK_ROWS):
            own = rows[k : k + CHUNK_ROWS]
            own_known, matrix = part.own.dense(own)
            z, has = matrix @ weights[np.ix_(own_known, columns)], np.flatnonzero(by_words[own])
            at = np.ix_(place[part.row[own[has]]], in_used) if len(has) else None
            if at is not None:
                z[has] += product[at]
            p = _sigmoid(z * part.scale[own][:, None] + intercept[columns])
            yield columns, own, p
            if learn is not None:
                error = learn(columns, own, p) * part.scale[own][:, None]
                yield None, (own_known, columns), matrix.T @ error
                if at is not None:
                    np.add.at(error_sum, at, error[has])
    if learn is not None and len(with_words):
        yield None, (known, used), shared.T @ error_sum


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# --- training -------------------------------------------------------------------------------------------------------


def _pass(data: DataFrame, scorers: Sequence[Scorer], weights: np.ndarray, intercept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (features x scorers) and the five sums (see INTERCEPT ..) of all scorers at the given weights."""
    n_features = weights.shape[0]
    out_type = pa.schema([("scorer", pa.int32()), ("feature", pa.int32()), ("g", pa.float64())])

    def own_of(kind: str, model: str) -> tuple:
        return tuple(i for i, s in enumerate(scorers) if s.kind == kind and s.model in (None, model))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros(weights.shape), np.zeros((5, len(scorers)))
        for part in _parts(batches, n_features):
            label = part.answer["label"].to_numpy(zero_copy_only=False).astype(float)  # null: NaN
            in_train, in_held = (part.split(name) & ~np.isnan(label) for name in ("train", "validation"))

            def learn(columns: np.ndarray, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
                y, train, held = (c[rows][:, None] for c in (label, in_train, in_held))  # noqa: B023
                loss = -(y * np.log(np.maximum(p, 1e-15)) + (1 - y) * np.log(np.maximum(1 - p, 1e-15)))
                error = np.where(train, p - y, 0.0)
                sums[:3, columns] += np.stack([error.sum(0), np.where(train, loss, 0).sum(0), np.full(len(columns), train.sum())])
                sums[3:, columns] += np.stack([np.where(held, loss, 0).sum(0), np.full(len(columns), held.sum())])
                return error

            for columns, at, found in _scored(part, own_of, weights, intercept, learn):
                if columns is None:
                    total[np.ix_(*at)] += found
        for i in range(len(scorers)):
            some = np.flatnonzero(total[:, i])
            feature, g = np.r_[some, n_features + np.arange(5)], np.r_[total[some, i], sums[:, i]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i), pa.int32()), pa.array(feature, pa.int32()), pa.array(g)], schema=out_type)

    parts = _by_prompt(data).drop("prompt_id").mapInArrow(add_up, "scorer int, feature int, g double")
    got = parts.groupBy("scorer", "feature").agg(F.sum("g").alias("g")).toPandas()  # (features + 5) x scorers
    out = np.zeros((n_features + 5, len(scorers)))
    out[got["feature"].to_numpy(int), got["scorer"].to_numpy(int)] = got["g"].to_numpy()
    return out[:n_features], out[n_features:]


def train(data: DataFrame, scorers: Sequence[Scorer], n_features: int = N_FEATURES, patience: int | None = None) -> tuple[list[tuple], list[tuple]]:
    """(curve, registry rows) of ``scorers`` over ``examples``.

    Curve: (strategy, model, epoch, n_train, n_val, train_loss, val_loss, kept), a row per scorer and epoch from 1 on; losses
    are means, null without rows. Kept is the first epoch with the lowest validation loss (without validation rows the last
    one). A scorer without training rows keeps zero weights, which score 0.5.
    """
    if n_features * len(scorers) * 8 > WEIGHT_LIMIT_BYTES:
        raise ValueError(f"{len(scorers)} scorers of {n_features} features pass {WEIGHT_LIMIT_BYTES} bytes: train them in parts")
    weights, intercept = np.zeros((n_features, len(scorers))), np.zeros(len(scorers))
    steps, epochs = np.array([s.step for s in scorers]), np.array([s.epochs for s in scorers])
    history, losses, live = [], [], np.ones(len(scorers), bool)
    for epoch in range(int(epochs.max(initial=0)) + 1):
        gradient, sums = _pass(data, scorers, weights, intercept)
        history.append((weights, intercept))
        losses.append(sums)
        if patience is not None and epoch > patience:
            curve = np.stack([s[VAL_LOSS] for s in losses[1:]])
            live = live & (epoch - 1 - curve.argmin(0) < patience)
            if not live.any():
                break
        rate = np.where(live & (epoch < epochs), steps, 0.0) / np.maximum(sums[N_TRAIN], 1)
        weights, intercept = weights - rate * gradient, intercept - rate * sums[INTERCEPT]
    curve, registry = [], []
    for i, s in enumerate(scorers):
        seen = range(1, min(s.epochs, len(losses) - 1) + 1)
        n_train, n_val = int(losses[0][N_TRAIN, i]), int(losses[0][N_VAL, i])
        mean = lambda e, what, n: float(losses[e][what, i] / n) if n else None  # noqa: B023, E731
        kept = min(seen, key=lambda e: (losses[e][VAL_LOSS, i], e)) if n_val else max(seen)
        curve += [(s.strategy, s.model, e, n_train, n_val, mean(e, TRAIN_LOSS, n_train), mean(e, VAL_LOSS, n_val), e == kept) for e in seen]
        registry.append((s.strategy, s.model, s.kind, kept, float(history[kept][1][i]), history[kept][0][:, i].tolist()))
    return curve, registry


CURVE = "strategy string, model string, epoch int, n_train long, n_val long, train_loss double, val_loss double, kept boolean"


def curve_table(spark: SparkSession, curve: list[tuple]) -> DataFrame:
    rounded = [F.round(c, DIGITS).alias(c) for c in ("train_loss", "val_loss")]
    return spark.createDataFrame(curve, CURVE).select("strategy", "model", "epoch", "n_train", "n_val", *rounded, "kept")


def registry_table(spark: SparkSession, registry: list[tuple]) -> DataFrame:
    """The registry as a written table."""
    return staged(spark.createDataFrame(registry, REGISTRY), "scorer-registry")


LOG = (
    "dataset string, strategy string, learning_rate double, epochs bigint, layout string, training_text string, base string, scorers bigint, "
    "n_train bigint, n_val bigint, first_kept bigint, last_kept bigint, val_loss double"
)


def train_grid(rows: DataFrame, grid: Sequence[tuple], dataset: str, log_path: str | None = None) -> tuple[DataFrame, list[tuple]]:
    """M6: (training log, registry rows) of every strategy of a grid; all its scorers learn in the same passes.

    ``rows``: as ``examples`` or ``shared_examples`` take them.

    A log row per strategy: its rows, the range of epochs that its scorers kept, and their mean loss over its validation
    rows. S10: the rows are appended to the log table at ``log_path`` when one is given, and the table is read back.
    """
    spark = rows.sparkSession
    kinds = sorted({s.kind for s in scorers_of(grid, [""])})
    data = shared_examples(rows, kinds) if "answers" in rows.columns else examples(rows, kinds)
    model = F.explode("answers.model").alias("model") if "answers" in data.columns else "model"
    scorers = scorers_of(grid, sorted(r["model"] for r in data.select(model).distinct().collect()))  # a handful of models
    curve, registry = train(data, scorers)
    log = []
    for strategy, rate, epochs, layout, text, base in grid:
        own = [c for c in curve if c[0] == strategy and c[7]]
        n_train, n_val = sum(c[3] for c in own), sum(c[4] for c in own)
        loss = round(sum(c[4] * c[6] for c in own if c[4]) / n_val, DIGITS) if n_val else None
        kept = [c[2] for c in own]
        log.append((dataset, strategy, float(rate), epochs, layout, text, base, len(own), n_train, n_val, min(kept), max(kept), loss))
    report = spark.createDataFrame(log, LOG)
    if log_path is not None:
        report.coalesce(1).write.mode("append").parquet(log_path)
        report = spark.read.schema(LOG).parquet(log_path)
    return report, registry


# --- scoring --------------------------------------------------------------------------------------------------------


def registry_scores(data: DataFrame, registry: DataFrame, strategies: Sequence[str] | None = None) -> DataFrame:
    """(strategy, model, prompt_id, tier, score): examples scored by each strategy's scorer for their model, or its pooled one.

    Every strategy that has a scorer for a row gives a score, all in one pass, as one product with the weight columns; a
    row of a model without a scorer of its own or a pooled one gets none from that strategy. ``data`` needs an example per
    kind of features that the registry names.
    """
    known = registry if strategies is None else registry.where(F.col("strategy").isin(list(strategies)))
    size = known.agg(F.sum(F.size("weights").cast("long"))).first()[0] or 0
    if size * 8 > WEIGHT_LIMIT_BYTES:
        raise ValueError(f"the registry holds {size * 8} bytes of weights: score its strategies in parts")
    table = known.orderBy("strategy", "model").collect()
    weights = np.stack([r["weights"] for r in table], 1) if table else np.zeros((N_FEATURES, 0))
    intercept = np.array([r["intercept"] for r in table])
    place = {(r["strategy"], r["model"]): (i, r["kind"]) for i, r in enumerate(table)}
    named = [r["strategy"] for r in table]
    names = sorted(set(named))

    def using(kind: str, model: str) -> tuple:
        found = [place.get((s, model), place.get((s, None))) for s in names]
        return tuple(at[0] for at in found if at is not None and at[1] == kind)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, weights.shape[0]):
            prompt = part.batch.column(part.batch.schema.get_field_index("prompt_id"))
            for columns, rows, p in _scored(part, using, weights, intercept):
                at = pa.array(rows)
                own = [part.answer["model"].take(at), prompt.take(pa.array(part.row[rows])), part.answer["tier"].take(at)]
                for j, i in enumerate(columns.tolist()):
                    yield pa.RecordBatch.from_arrays([pa.array([named[i]] * len(rows), pa.string()), *own, pa.array(p[:, j])], names=["strategy", "model", "prompt_id", "tier", "score"])

    return _by_prompt(data).drop("split").mapInArrow(score, "strategy string, model string, prompt_id long, tier int, score double")
