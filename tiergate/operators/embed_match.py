"""Embedding match precision / recall / F1 (A8, A16): greedy best cosine per token, as BERT-score does.

P = count-weighted mean over predicted tokens of the best cosine with any reference token, R the same over reference tokens,
F = 2PR / (P + R); mean over pairs. A token is mapped to a key: the hash into the range of the vector table's own ids, or
for a table of token vectors the token's own 64-bit hash. A token whose key has no vector takes no part and is counted in
``no_vector``; vectors that cannot be compared are as if absent (``usable_vectors``). Two plans give the same numbers:

* A vector table under ``BROADCAST_LIMIT_BYTES`` (rows x width x 8, checked before anything is collected) goes to every
  executor once, and each pair is scored inside its own row from its two lists of keys: no token rows, no shuffle.
* A larger table is written once to the shared folder, as files of bounded bytes with ordered keys and rows of fixed width. A
  task reads from them the vectors that a slice of its pairs names, in ranges, and scores the slice with the same function as
  the other plan. What a task holds follows the words of a slice, and disk holds the vectors once: neither keys, counts nor
  vectors are shuffled, however many pairs there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..functions.hashing import hex_bits
from ..session import scratch_path
from ..sources.run_folder import open_fs
from .rouge import lcs_lengths, overlaps
from .token_columns import counted, found_in, hashes, long_hashes, row_of, slices, word_codes

DIGITS = 9
BROADCAST_LIMIT_BYTES = 64 << 20
STRIPE_BYTES = 16 << 20  # of a file of vectors
FETCH_BYTES = 64 << 20  # of vectors that a slice of pairs reads at once (one pair at least)
GAP_BYTES = 8 << 10  # between two vectors of a file that are read together
COSINES = 1 << 22  # held of a pair at once


def token_vec_id(token: Column, n_vectors: int) -> Column:
    return hex_bits(token, 8) % F.lit(n_vectors)


def _usable(embeddings: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(rows that ``usable_vectors`` takes, a key's repeated ones included; their width, or 0)."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    whole = embeddings.where(F.col(key).isNotNull() & (F.size("embedding") > 0) & F.coalesce(F.forall("embedding", fine), F.lit(False)))
    widths = whole.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    top = widths.orderBy(F.desc("n"), F.desc("width")).first()
    width = top["width"] if top else 0
    return whole.where(F.size("embedding") == width), width


def _one_per_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("embedding").alias("embedding"))


def usable_vectors(embeddings: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, embedding) of vectors that can be compared: a key, no component that is null, NaN or infinite, and the width that
    most such rows have (of equally frequent widths the larger). Of a key's vectors the smallest counts. Both plans see the
    same rows; other vectors are as if absent."""
    return _one_per_key(_usable(embeddings, key)[0], key)


def unit_vectors(embeddings: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, u): the embedding as double[] scaled to length 1 (zero vectors stay zero)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return embeddings.select(key, F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v).alias("u"))


def id_range(embeddings: DataFrame) -> int:
    """Tokens are mapped to 0 .. largest vec_id of the table: its own ids decide, not how many there are."""
    top = embeddings.select(F.max("vec_id")).first()[0]
    return 0 if top is None else int(top) + 1


@dataclass(frozen=True)
class Held:
    """Vectors that every executor has, as (ids, unit vectors); words mean the ids from 0 to ``n_ids`` - 1."""

    vectors: Broadcast
    n_ids: int

    def keys_of(self, words: list[str]) -> np.ndarray:
        return hashes(words) % self.n_ids

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.vectors.value

    def size(self, words: list[str]) -> int:
        """Bytes that ``of`` makes at most."""
        return 0


@dataclass(frozen=True)
class VectorFiles:
    """Vectors in files: the keys of a file in order, then the vectors as rows of ``width`` numbers. Words mean ids as in
    ``Held``, or without ``n_ids`` their 60-bit hash."""

    files: tuple[tuple[str, int], ...]  # path, rows
    width: int
    dtype: str
    n_ids: int | None

    def keys_of(self, words: list[str]) -> np.ndarray:
        return long_hashes(words) if self.n_ids is None else hashes(words) % max(self.n_ids, 1)

    def size(self, words: list[str]) -> int:
        return len(words) * self.width * 8

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(those of ``keys`` that have a vector, in order; their unit vectors)."""
        keys, known, rows = np.unique(keys), [], []
        row_bytes = self.width * np.dtype(self.dtype).itemsize
        for path, n in self.files:
            fs, name = open_fs(path)
            with fs.open_input_file(name) as f:
                has, at = found_in(keys, np.frombuffer(f.read_at(8 * n, 0), "<i8"))
                at = at[has]
                cuts = np.flatnonzero(np.diff(at) * row_bytes > GAP_BYTES) + 1
                for own in np.split(at, cuts) if len(at) else ():
                    data = f.read_at(int(own[-1] - own[0] + 1) * row_bytes, 8 * n + int(own[0]) * row_bytes)
                    rows.append(np.frombuffer(data, self.dtype).reshape(-1, self.width)[own - own[0]])
                known.append(keys[has])
        if not rows:
            return np.zeros(0, np.int64), np.zeros((0, 1))
        ids = np.concatenate(known)
        order = np.argsort(ids)
        return ids[order], _unit(np.concatenate(rows)[order].astype(np.float64))


def _unit(v: np.ndarray) -> np.ndarray:
    """``unit_vectors`` of rows, with sums in the same order."""
    square = np.zeros(len(v))
    for j in range(v.shape[1]):
        square += v[:, j] * v[:, j]
    norm = np.sqrt(square)
    return np.divide(v, norm[:, None], out=v, where=norm[:, None] > 0)


def vector_files(vectors: DataFrame, width: int, n_ids: int | None, file_bytes: int = STRIPE_BYTES) -> VectorFiles:
    """Write ``vectors`` (key, embedding; a row a key, all of ``width``) to the shared folder, a file for each ``file_bytes`` of a
    task. Files of a task that ran twice are named by one of its runs only."""
    base = scratch_path(vectors.sparkSession, "vectors", uuid.uuid4().hex)
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    dtype, type_ = ("<f4", "float") if single else ("<f8", "double")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(base)
        keys, rows, written = [], [], []

        def flush() -> None:
            if keys:
                fs.create_dir(root, recursive=True)
                name = uuid.uuid4().hex
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for part in keys + rows:
                        out.write(part.tobytes())
                written.append((f"{base}/{name}", sum(map(len, keys))))
                keys.clear()
                rows.clear()

        most = max(1, file_bytes // (width * np.dtype(dtype).itemsize))
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(key), width)
            while len(key):
                room = most - sum(map(len, keys))
                keys.append(key[:room])
                rows.append(matrix[:room].copy())
                key, matrix = key[room:], matrix[room:]
                if sum(map(len, keys)) >= most:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in written], pa.string()), pa.array([x[1] for x in written], pa.int64())], names=["path", "n"])

    ordered = vectors.select(F.col("key").cast("long").alias("key"), F.col("embedding").cast(f"array<{type_}>").alias("embedding")).sortWithinPartitions("key")
    found = ordered.mapInArrow(write, "path string, n long").collect() if width else []  # a row for each ``file_bytes`` of vectors
    return VectorFiles(tuple((r["path"], r["n"]) for r in found), width, dtype, n_ids)


def shared_vectors(embeddings: DataFrame, allow_broadcast: bool = True, file_bytes: int = STRIPE_BYTES) -> Held | VectorFiles:
    """The vectors as tasks find them: broadcast where the table is under ``BROADCAST_LIMIT_BYTES``, otherwise written to files."""
    rows, width = _usable(embeddings, "vec_id")
    n_ids = id_range(embeddings)
    if allow_broadcast and n_ids and rows.select("vec_id").distinct().count() * width * 8 <= BROADCAST_LIMIT_BYTES:
        vecs = unit_vectors(_one_per_key(rows, "vec_id")).orderBy("vec_id").toPandas()
        ids = vecs["vec_id"].to_numpy(dtype=np.int64)
        u = np.stack(vecs["u"]) if len(ids) else np.zeros((0, 1))
        return Held(embeddings.sparkSession.sparkContext.broadcast((ids, u)), n_ids)
    return vector_files(_one_per_key(rows, "vec_id").withColumnRenamed("vec_id", "key"), width, n_ids, file_bytes)


def _best(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best cosine of each vector of ``a`` with any of ``b``, a bounded number of cosines at a time."""
    step, other = max(1, COSINES // len(b)), u[b].T
    return np.concatenate([(u[a[at : at + step]] @ other).max(1) for at in range(0, len(a), step)])


def matches(words: list[str], pred: tuple[np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray], n_ids: int) -> dict[str, np.ndarray]:
    """``matches_of`` with ``vectors`` as (ids, unit vectors)."""
    return matches_of(hashes(words) % n_ids, pred, ref, vectors)


def matches_of(keys: np.ndarray, pred: tuple[np.ndarray, np.ndarray], ref: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """p, r and no_vector of every row; ``keys``: of the words; ``pred``, ``ref``: (codes, offsets) of ``word_codes``.

    A vector that both sides of a pair hold is its own best match, so only the others are multiplied with the other side.
    """
    known, u = vectors
    has, place = found_in(keys, known)
    span, n_rows, sides, lost = max(len(known), 1), len(pred[1]) - 1, [], np.zeros(len(pred[1]) - 1, np.int64)
    for codes, offsets in (pred, ref):
        fine, rows = has[codes], row_of(offsets)
        lost += np.bincount(rows[~fine], minlength=n_rows)
        sides.append(counted(rows[fine] * span + place[codes[fine]]))
    at = [np.searchsorted(keys // span, np.arange(n_rows + 1)) for keys, _ in sides]
    places = [keys % span for keys, _ in sides]
    shared = [found_in(sides[i][0], sides[1 - i][0])[0] for i in (0, 1)]
    best = [np.where(s, np.einsum("ij,ij->i", u, u)[p], 0.0) if len(p) else np.zeros(0) for s, p in zip(shared, places)]
    alone = [np.bincount(keys[~s] // span, minlength=n_rows) for (keys, _), s in zip(sides, shared)]
    size = [np.diff(x) for x in at]
    for i in np.flatnonzero((size[0] > 0) & (size[1] > 0) & (alone[0] + alone[1] > 0)).tolist():
        own = [slice(x[i], x[i + 1]) for x in at]
        if alone[0][i] * size[1][i] + alone[1][i] * size[0][i] >= size[0][i] * size[1][i]:
            if size[0][i] * size[1][i] > COSINES:
                for k in (0, 1):
                    best[k][own[k]] = _best(u, places[k][own[k]], places[1 - k][own[1 - k]])
                continue
            cosine = u[places[0][own[0]]] @ u[places[1][own[1]]].T
            best[0][own[0]], best[1][own[1]] = cosine.max(1), cosine.max(0)
            continue
        for k in (0, 1):
            left = own[k].start + np.flatnonzero(~shared[k][own[k]])
            if len(left):
                best[k][left] = _best(u, places[k][left], places[1 - k][own[1 - k]])
    some = (size[0] > 0) & (size[1] > 0)
    out = {"no_vector": lost}
    for name, k in (("p", 0), ("r", 1)):
        keys, n = sides[k]
        total = np.bincount(keys // span, weights=best[k] * n, minlength=n_rows)
        out[name] = np.where(some, total / np.maximum(np.bincount(keys // span, weights=n, minlength=n_rows), 1), 0.0)
    return out


def _in_reach(texts: tuple[pa.Array, ...], vectors: Held | VectorFiles | None) -> Iterator[tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]]:
    """``word_codes`` of a slice, cut into halves until its vectors are under ``FETCH_BYTES`` (or one row is left)."""
    words, coded = word_codes(*texts)
    n = len(texts[0])
    if vectors is None or n < 2 or vectors.size(words) <= FETCH_BYTES:
        yield words, coded
        return
    for part in ([c.slice(0, n // 2) for c in texts], [c.slice(n // 2) for c in texts]):
        yield from _in_reach(tuple(part), vectors)


def pair_numbers_udf(vectors: Held | VectorFiles | None, overlap: bool = True):
    """Numbers of pairs of lower-cased texts, from one look at their words: struct of np, nr and ov of words (1) and word pairs (2)
    and lcs, where ``overlap`` is asked for, and of p, r and no_vector, where there are vectors."""
    names = ["np1", "nr1", "ov1", "np2", "nr2", "ov2", "lcs"] if overlap else []
    fields = [(c, pa.int64()) for c in names] + ([("p", pa.float64()), ("r", pa.float64()), ("no_vector", pa.int64())] if vectors else [])
    type_ = pa.struct(fields)

    @F.arrow_udf(", ".join(f"{c} {'double' if t == pa.float64() else 'bigint'}" for c, t in fields))
    def numbers(pred: pa.Array, ref: pa.Array) -> pa.Array:
        parts = []
        for texts in slices(pred, ref):
            for words, (a, b) in _in_reach(texts, vectors):
                got = overlaps(len(words), a, b) | {"lcs": lcs_lengths(len(words), a, b)} if overlap else {}
                if vectors is not None:
                    keys = vectors.keys_of(words)
                    got |= matches_of(keys, a, b, vectors.of(keys))
                parts.append(pa.StructArray.from_arrays([pa.array(got[c], t) for c, t in fields], fields=list(type_)))
        return pa.concat_arrays(parts) if parts else pa.array([], type_)

    return numbers


def embed_match_pairs(
    pairs: DataFrame, embeddings: DataFrame | None, group_cols: Sequence[str] = (), allow_broadcast: bool = True,
    token_vectors: DataFrame | None = None, stripe_bytes: int = STRIPE_BYTES,
) -> DataFrame:
    """Per pair: P, R, F of the greedy embedding match.

    Vectors come from ``embeddings`` (vec_id, embedding) through the token hash, or - the token-embedder plug-in -
    straight from ``token_vectors`` (token, embedding), found by the token (tokens without a vector are left out).
    """
    if token_vectors is not None:
        named = token_vectors.where("token IS NOT NULL").select(hex_bits(F.col("token"), 15).alias("key"), "embedding")
        rows, width = _usable(named, "key")
        vectors = vector_files(_one_per_key(rows, "key"), width, None, stripe_bytes)
    else:
        vectors = shared_vectors(embeddings, allow_broadcast, stripe_bytes)
    scored = pairs.select(*group_cols, "pair_id", pair_numbers_udf(vectors, overlap=False)(F.lower("pred"), F.lower("ref")).alias("m"))
    p, r = F.col("m.p"), F.col("m.r")
    f = F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
    return scored.select(*group_cols, "pair_id", p.alias("p"), r.alias("r"), f.alias("f"), F.col("m.no_vector").alias("no_vector"))


def embed_match(pairs: DataFrame, embeddings: DataFrame, group_cols: Sequence[str] = (), allow_broadcast: bool = True) -> DataFrame:
    per = embed_match_pairs(pairs, embeddings, group_cols, allow_broadcast)
    return per.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(F.avg("p"), DIGITS).alias("emb_p"),
        F.round(F.avg("r"), DIGITS).alias("emb_r"),
        F.round(F.avg("f"), DIGITS).alias("emb_f1"),
        F.sum("no_vector").cast("bigint").alias("no_vector"),
    )
