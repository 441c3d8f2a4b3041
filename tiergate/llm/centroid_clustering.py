"""Centroid clustering (Lloyd's rounds over integer vectors) with norm-of-sum bounds.

Each vector keeps, for every centroid, the exact distance of the last time both met and the round of that meeting. The
driver keeps the history of all centroids, rounds x k x d integers. In a later round the stored distance is loosened by
the norm of the centroid's total displacement since that meeting, which is never more, and mostly far less, than the sum
of its drifts round by round. If the loosened upper bound of a vector's own centroid is below the loosened lower bounds
of all others, the vector stays without any distance being computed. Where that fails, the distance to its own centroid
and to the centroids whose bounds fail is computed again, exactly, in integers; ties go to the smaller number.

A round is one map over the state table (vectors, cluster, distances, rounds) and one aggregation of component sums. The
new state is written to the shared folder and the one before it is removed there, so lineage stays one round long and
disk use does not follow the number of rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergate.llm.common import discard, stage

K, DIMS, ROUNDS, SCALE, SEED = 8, 64, 10, 1024, 3
#: Components at or beyond this have squared distances that no long holds.
LIMIT = 1 << 27
#: Slack of bound tests, far above the rounding of square roots and far below one unit of the integer grid.
RELATIVE, ABSOLUTE = 1e-9, 1e-6


def whole(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def usable(vector: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """True for vectors of ``dims`` components that are all finite and in range."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(LIMIT / scale))
    return vector.isNotNull() & (F.size(vector) == dims) & F.coalesce(F.forall(vector, fine), F.lit(False))


class Bounds:
    """Bound tests and exact rescans of a batch against the newest centroids of a history."""

    def __init__(self, history: np.ndarray):
        """``history``: (rounds so far, k, d) integers, the newest last."""
        self.now = len(history) - 1
        self.centroids = history[-1]
        moved = (history - history[-1]).astype(np.float64)
        self.moved = np.sqrt((moved**2).sum(2))  # (round, centroid): norm of the total displacement since that round

    def exact(self, vectors: np.ndarray, j: int) -> np.ndarray:
        return ((vectors - self.centroids[j]) ** 2).sum(1)

    def first(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, distances, rounds) of vectors that have met no centroid yet."""
        squared = np.stack([self.exact(vectors, j) for j in range(len(self.centroids))], 1) if len(vectors) else np.zeros((0, len(self.centroids)), np.int64)
        return squared.argmin(1), np.sqrt(squared), np.full(squared.shape, self.now, np.int16)

    def again(self, vectors: np.ndarray, cluster: np.ndarray, met: np.ndarray, seen: np.ndarray):
        """(cluster, distances, rounds, distances computed) of vectors with stored distances ``met`` of rounds ``seen``."""
        n, k = met.shape
        cluster, met, seen, rows = cluster.copy(), met.copy(), seen.copy(), np.arange(n)
        drift = self.moved[seen, np.arange(k)]
        lower = (met - drift) * (1 - RELATIVE) - ABSOLUTE
        upper = (met + drift)[rows, cluster] * (1 + RELATIVE) + ABSOLUTE
        lower[rows, cluster] = np.inf
        doubt = np.flatnonzero(lower.min(1) <= upper)
        computed = 0
        if len(doubt):
            # exact distance to the own centroid; bounds that still reach it are replaced by exact distances
            best = np.empty(len(doubt), np.int64)
            own = cluster[doubt]
            for j in np.unique(own):
                at = own == j
                best[at] = self.exact(vectors[doubt[at]], j)
            met[doubt, own], seen[doubt, own] = np.sqrt(best), self.now
            computed += len(doubt)
            reach = lower[doubt] <= (np.sqrt(best) * (1 + RELATIVE) + ABSOLUTE)[:, None]
            choice = own.copy()
            for j in range(k):
                at = np.flatnonzero(reach[:, j])
                d = self.exact(vectors[doubt[at]], j)
                met[doubt[at], j], seen[doubt[at], j] = np.sqrt(d), self.now
                computed += len(at)
                closer = (d < best[at]) | ((d == best[at]) & (j < choice[at]))
                best[at[closer]], choice[at[closer]] = d[closer], j
            cluster[doubt] = choice
        return cluster, met, seen, computed


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.reshape(-1), kind))


STATE = "vec_id long, v array<int>, cluster int, met array<double>, seen array<short>"


def assign(state: DataFrame, history: np.ndarray) -> DataFrame:
    """``state`` with every vector at the nearest of the newest centroids of ``history``. A state of (vec_id, v) is new."""
    fresh = "cluster" not in state.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        for batch in batches:
            vectors = _matrix(batch.column("v"), np.int64)
            if fresh:
                cluster, met, seen = bounds.first(vectors)
            else:
                old = batch.column("cluster").to_numpy()
                cluster, met, seen, _ = bounds.again(vectors, old, _matrix(batch.column("met"), np.float64), _matrix(batch.column("seen"), np.int16))
            arrays = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), _lists(met, pa.float64()), _lists(seen, pa.int16())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "v", "cluster", "met", "seen"])

    return state.mapInArrow(step, STATE)


def start_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest sha256 of ``seed:id``, in that order. Ids that repeat take the smaller
    vector first; vectors without an id never start."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter(F.col("vec_id").isNotNull()).orderBy(order, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; empty clusters keep their centroid."""
    dims = centroids.shape[1]
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding"):
    """(assignment, centroids): (vec_id, cluster, distance) for every usable row of ``vectors``, and the final (k, d) array.

    Vectors that are null, have another length or a component that is null, not finite or beyond ``LIMIT / scale`` take no
    part. Rows that repeat an id take part each; rows without an id are clustered but never start a cluster. With fewer
    than ``k`` vectors that have an id there are as many clusters as those; without any, and for an empty table, the result
    is empty.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(usable(F.col("v"), dims, scale))
    state = stage(rows.select("vec_id", whole(F.col("v"), scale).alias("v")), "cluster-vectors")
    first = start_centroids(state, k, seed)
    if not len(first):
        first = np.zeros((1, dims), np.int64)  # nothing with an id: no vector starts, so none is kept
        state = state.limit(0)
    history = first[None]
    for i in range(rounds + 1):
        new = stage(assign(state, history), f"cluster-{i}")
        discard(state)
        state = new
        if i < rounds:
            history = np.concatenate((history, moved_centroids(state, history[-1])[None]))
    final = history[-1]
    nearest = F.array(*(F.array(*(F.lit(int(x)).cast("long") for x in c)) for c in final))
    own = F.get(nearest, F.col("cluster"))
    distance = F.aggregate(F.zip_with("v", own, lambda a, b: (a.cast("long") - b) * (a.cast("long") - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return state.select("vec_id", "cluster", distance.alias("distance")), final


def report(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every usable row of ``vectors``."""
    assigned, final = cluster(vectors, **options)
    assigned = stage(assigned, "clustered")
    per = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    of = lambda values: F.get(F.array(*(F.lit(v) for v in values)), F.col("cluster"))
    return assigned.select(
        "vec_id", "cluster", "distance",
        of([int(per.get(j, 0)) for j in range(len(final))]).cast("long").alias("cluster_inertia"),
        F.lit(int(sum(per.values()))).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"),
    )
