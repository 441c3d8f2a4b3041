"""Exact top-k inner-product search over a bit-sliced index.

Components are quantised to integers, floor(scale * x). A task holds one stripe of the vectors as vertical bit slices:
slice i of an attribute is a bitmap over the stripe's rows. A query adds the slices of its attributes with bitmap
arithmetic only: the bits of its weights shift them, a negative weight takes complemented slices, and carry-save adders
reduce all bitmaps of equal weight. From the sums, the k-th best row is found from the most significant slice downward.

Only the upper ``top_bits`` of each attribute are sliced. What the cut bits can add to a score is bounded for each
query, so every row whose sliced sum may still reach the k-th place is a boundary row; boundary rows (ties included)
get their exact integer score, and ties go to the smaller id.

Distribution: vectors are dealt once into stripes of bounded bytes. A task builds the index of a stripe when the stripe's
last vector has passed, then streams the queries past it in Arrow batches; a vector is never copied and an index is built
once. Stripes answer with at most k + 1 rows per query; a last ranking takes the query's own row out and keeps the best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergate.llm.common import stage
from tiergate.session import shuffle_width

K = 5
SCALE = 256
TOP_BITS = 6
STRIPE_BYTES = 32 << 20


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) per component as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


class SlicedIndex:
    """Bit slices of one stripe: rows (n, d) of integers in the order of ``ids`` (ascending)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, top_bits: int = TOP_BITS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.n, self.d = rows.shape
        low, high = (rows.min(0), rows.max(0)) if self.n else (np.zeros(self.d, np.int64),) * 2
        bits = max(1, int((high - low).max(initial=0)).bit_length())
        self.cut = max(0, bits - top_bits)
        self.bits = bits - self.cut
        upper = ((self.rows - low) >> self.cut).astype(np.uint64)
        lanes = np.stack([((upper >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) for b in range(self.bits)])  # bits, n, d
        lanes = np.pad(lanes.transpose(2, 0, 1), ((0, 0), (0, 0), (0, -self.n % 64)))
        self.slices = np.ascontiguousarray(np.packbits(lanes, axis=2, bitorder="little")).view("<u8")  # d, bits, words
        self.valid = np.ascontiguousarray(np.packbits(np.pad(np.ones(self.n, np.uint8), (0, -self.n % 64)), bitorder="little")).view("<u8")

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bit slices, least significant first, of sum over attributes of |w| * v, v = sliced value or its complement."""
        size = np.abs(weights)
        signed = np.where((weights < 0)[:, None, None], ~self.slices, self.slices)
        levels: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            chosen = signed[(size >> j & 1).astype(bool)]
            for i in range(self.bits):
                if len(chosen):
                    levels.setdefault(i + j, []).append(chosen[:, i])
        out: list[np.ndarray] = []
        level = 0
        while level <= max(levels, default=-1):
            stack = np.concatenate(levels[level]) if level in levels else np.zeros((1, self.slices.shape[2]), "<u8")
            while len(stack) > 1:  # three bitmaps of a weight make one of it and one carry
                if len(stack) == 2:
                    a, b = stack
                    total, carry = (a ^ b)[None], (a & b)[None]
                    rest = stack[:0]
                else:
                    third = len(stack) // 3
                    a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                    half = a ^ b
                    total, carry = half ^ c, (a & b) | (half & c)
                    rest = stack[3 * third :]
                levels.setdefault(level + 1, []).append(carry)
                stack = np.concatenate((total, rest))
            out.append(stack[0])
            level += 1
        return out

    def _candidates(self, sums: list[np.ndarray], alive: np.ndarray, k: int, slack: int) -> np.ndarray:
        """Bitmap of rows whose sliced sum is at least the k-th best one less ``slack``."""
        sure, maybe, kth = np.zeros_like(alive), alive, 0
        for i in reversed(range(len(sums))):
            if _count(sure | (maybe & sums[i])) >= k:
                maybe, kth = maybe & sums[i], kth | 1 << i
            else:
                sure, maybe = sure | (maybe & sums[i]), maybe & ~sums[i]
        least = max(0, kth - slack)
        above, same = np.zeros_like(alive), alive
        for i in reversed(range(len(sums))):
            if least >> i & 1:
                same = same & sums[i]
            else:
                above, same = above | (same & sums[i]), same & ~sums[i]
        return above | same

    def search(self, weights: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``ids``, scores) of the k best rows, best first, ties to the smaller id, then to a row equal to
        the query."""
        alive = self.valid.copy()
        if self.n > k:
            spare = int(np.abs(weights).sum()) * ((1 << self.cut) - 1)  # most that the cut bits can add
            alive = self._candidates(self.sums(weights), alive, k, -(-spare >> self.cut))
        near = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
        scores = self.rows[near] @ weights
        other = (self.rows[near] != weights).any(1)
        best = np.lexsort((other, self.ids[near], -scores))[:k]
        return near[best], scores[best]


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, top_bits: int = TOP_BITS,
    stripe_bytes: int = STRIPE_BYTES, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best vectors by integer inner product, its own row left out.

    Every row counts: of rows that share an id each is a candidate of its own, and each query row gets its own k rows. A
    query's own row is one candidate with its id and its vector. Vectors that are null or hold null or non-finite
    components take no part on either side, and neither do rows without an id. A query meets only vectors of its own
    length. With fewer than k candidates all are returned; empty inputs give an empty result. Scores must fit 64 bits.
    """

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
        rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", quantise(F.col("v"), scale).alias("v"))
        return rows.withColumn("dim", F.size("v"))

    spark = vectors.sparkSession
    rows, asked = stage(prepared(vectors), "vectors"), stage(prepared(queries), "queries")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()
    # bounded bytes each; small tables are spread over the cores
    stripes = max(1, -(-8 * total // stripe_bytes), min(shuffle_width(spark), -(-n // 4096)))
    left = rows.select(F.pmod(F.xxhash64("row"), F.lit(stripes)).cast("int").alias("stripe"), F.lit(False).alias("asks"), "row", "id", "v", "dim")
    every = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    right = asked.select(every.alias("stripe"), F.lit(True).alias("asks"), "row", "id", "v", "dim")
    order = ["stripe", "dim", "asks"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, parts, index = None, [], [], None
        for batch in batches:
            out = []
            for (stripe, dim, asks), own in batch.groupby(order):  # runs of the sorted batch
                if at != (stripe, dim):
                    at, ids, parts, index = (stripe, dim), [], [], None
                v = np.stack(own["v"]).astype(np.int64)
                if not asks:
                    ids.append(own["id"].to_numpy())
                    parts.append(v)
                    continue
                if parts:
                    index, ids, parts = SlicedIndex(np.concatenate(ids), np.concatenate(parts), top_bits), [], []
                if index is None:
                    continue
                for row, query_id, weights in zip(own["row"], own["id"], v):
                    places, scores = index.search(weights, k + 1)
                    same = (index.ids[places] == query_id) & (index.rows[places] == weights).all(1)
                    out += [(row, query_id, *x) for x in zip(index.ids[places].tolist(), scores.tolist(), same.tolist())]
            yield pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score", "own"])

    cells = left.unionByName(right).repartition(stripes, "stripe").sortWithinPartitions(*order)
    found = cells.mapInPandas(search, "row long, query_id long, vec_id long, score long, own boolean")
    by_query = Window.partitionBy("row")
    place = F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id", F.desc("own")))
    ranked = found.withColumn("place", place).filter(F.col("place") <= k + 1)
    ranked = ranked.withColumn("mine", F.coalesce(F.min(F.when(F.col("own"), F.col("place"))).over(by_query), F.lit(k + 2)))
    ranked = ranked.filter(F.col("place") != F.col("mine")).withColumn("rank", F.col("place") - (F.col("place") > F.col("mine")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
