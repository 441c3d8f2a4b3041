"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: XXH64 of every word shingle of the whole text, majority per bit (Arrow batches). Equal fingerprints are
merged first; the rest of the work is on distinct fingerprints.

Candidates: 64 bits in five bands; two fingerprints that differ in at most three bits agree on at least two whole
bands, so each fingerprint goes to the ten buckets of its band pairs (25 or 26 bits each). Nothing is lost and nothing
is capped: a bucket over ``CHUNK`` members is dealt into chunks, and every pair of chunks becomes a cell of its own.

Comparison inside a cell is bit-sliced: bit planes stand vertically (one machine word holds a bit of 64 fingerprints),
carry-save counters add the 64 difference planes to many distances at once, and a block is given up as soon as all of
its distances exceed the radius. A cell returns a spanning forest of its links, never all pairs.

Components: alternating large-star and small-star steps over the links, each a partial minimum and a join, until
nothing changes; each round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergate.llm.common import free_name, row_key, stage, with_keys

SHINGLE = 3
RADIUS = 3
SEED = 42
CHUNK = 1024

#: (lowest bit, bits) of the five bands.
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BAND_PAIRS = tuple((a, b) for a in range(5) for b in range(a + 1, 5))


# --- fingerprints ---------------------------------------------------------------------------------------------------


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint of a whole text. Words are runs without ASCII white space, A-Z lower-cased; shingles repeat as
    often as they stand there; fewer words than a shingle count as one; no words give 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return fingerprint(F.col(text))


# --- bit-sliced comparison ------------------------------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of unsigned 64-bit fingerprints: bit j of word w of plane b is bit b of fingerprint 64 w + j."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits = np.pad(bits, ((0, -len(fps) % 64), (0, 0)))
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(differences, radius: int = RADIUS, look: int = 8) -> np.ndarray | None:
    """Bitmap of the lanes whose difference planes hold at most ``radius`` ones; None if the block was given up.

    Carry-save counting: counter k holds bit k of each lane's distance so far. Every ``look`` planes the block is
    given up if each lane is past the radius.
    """
    bits = radius.bit_length()
    counters, over = None, None
    for i, carry in enumerate(differences):
        if counters is None:
            counters, over = [np.zeros_like(carry) for _ in range(bits)], np.zeros_like(carry)
        for k in range(bits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if (i + 1) % look == 0 and not (~(over | _above(counters, radius))).any():
            return None
    return ~(over | _above(counters, radius))


def _above(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose counters exceed ``limit``, most significant counter first."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if limit >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def _lanes(bitmap: np.ndarray, n: int) -> np.ndarray:
    """Boolean lanes of bitmaps (..., words)."""
    return np.unpackbits(np.ascontiguousarray(bitmap).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def forest_of_run(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs of positions that span the components of one run of distinct fingerprints.

    Breadth first, 64 heads at a time: reached fingerprints, or else the next unreached ones. Heads are compared with
    all that were not heads yet, each other included; only what is known to be in the one component of all heads is
    left out. So of every link one end has met the other, or both are in one component already.
    """
    left, front, pairs = np.arange(len(fps)), np.zeros(0, np.int64), []
    label, full = np.arange(len(fps)), ~np.uint64(0)  # the component of each position so far

    def tie(a: np.ndarray, b: np.ndarray) -> None:
        apart = label[a] != label[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            if label[i] != label[j]:
                pairs.append((i, j))
                label[label == label[j]] = label[i]

    while len(left) or (label[front] != label[front[:1]]).any():
        if len(front):
            front = front[np.argsort(label[front], kind="stable")]
            heads, front = front[:64], front[64:]
        else:
            heads, left = left[:64], left[64:]
        joined = (label[heads] == label[heads[0]]).all()
        others = front[label[front] != label[heads[0]]] if joined else np.concatenate((heads, front))
        seen = np.concatenate((others, left))
        if not len(seen):
            continue
        own, planes = fps[heads], planes_of(fps[seen])
        masks = [np.where(own >> np.uint64(b) & np.uint64(1), full, np.uint64(0))[:, None] for b in range(64)]
        close = within((planes[b][None, :] ^ masks[b] for b in range(64)), radius)
        if close is None:
            continue
        hit = _lanes(close, len(seen))
        if not joined:  # heads that hit the same fingerprint, or each other
            i, j = np.nonzero(np.triu(hit.astype(np.float32) @ hit.T.astype(np.float32), 1))
            tie(heads[i], heads[j])
        parent, reached = heads[hit.argmax(0)], hit.any(0)
        old, new = reached[: len(others)], reached[len(others) :]
        tie(parent[: len(others)][old], others[old])
        above, found = parent[len(others) :][new], left[new]
        pairs += zip(above.tolist(), found.tolist())
        label[found] = label[above]
        front, left = np.concatenate((front, found)), left[~new]
    return pairs


def links_of_runs(run: np.ndarray, fps: np.ndarray, radius: int = RADIUS, short: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links inside every run of equal ``run`` values (sorted): two arrays of fingerprints.

    Short runs are compared all at once, lag by lag, in shared bit planes; a longer run has its own planes.
    """
    out_a, out_b = [], []
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(run)])))
    left_in_run = np.repeat(starts + sizes, sizes) - np.arange(len(run))
    size_of = np.repeat(sizes, sizes)
    for lag in range(1, short):
        a = np.flatnonzero((size_of <= short) & (left_in_run > lag))
        if not len(a):
            break
        pa, pb = planes_of(fps[a]), planes_of(fps[a + lag])
        for at in range(0, pa.shape[1], 512):  # a block of the planes
            close = within((pa[b, at : at + 512] ^ pb[b, at : at + 512] for b in range(64)), radius)
            if close is not None:
                hit = a[64 * at :][: 64 * close.size][_lanes(close, min(64 * close.size, len(a) - 64 * at))]
                out_a.append(fps[hit])
                out_b.append(fps[hit + lag])
    for s, n in zip(starts[sizes > short], sizes[sizes > short]):
        if links := forest_of_run(own := fps[s : s + n], radius):
            i, j = np.array(links).T
            out_a.append(own[i])
            out_b.append(own[j])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


# --- links over all fingerprints ------------------------------------------------------------------------------------


def _bucket_keys(fp: Column) -> Column:
    keys = []
    for i, (a, b) in enumerate(BAND_PAIRS):
        (la, na), (lb, nb) = BANDS[a], BANDS[b]
        part = F.shiftrightunsigned(fp, la).bitwiseAND(F.lit((1 << na) - 1))
        other = F.shiftrightunsigned(fp, lb).bitwiseAND(F.lit((1 << nb) - 1))
        keys.append(F.lit(i) * F.lit(1 << 26) + part * F.lit(1 << nb) + other)
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, n_rows: int | None = None) -> DataFrame:
    """(a, b), a < b: links that connect every component of the distinct fingerprints ``fp`` (longs)."""
    if radius > 3:
        raise ValueError("five bands find distances up to 3")
    n_rows = distinct.count() if n_rows is None else n_rows
    rows = distinct.select("fp", F.explode(_bucket_keys(F.col("fp"))).alias("bucket"))
    hot = rows.groupBy("bucket").count().filter(F.col("count") > chunk)
    hot = hot.select("bucket", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    rows = rows.join(hot, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != F.col("own"))
    cells = F.transform(others, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = rows.select("bucket", "fp", F.explode(F.when(F.col("chunks") > 1, cells).otherwise(alone)).alias("cell"))
    rows = rows.select("bucket", "cell.i", "cell.j", "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for part in batches:
            part = part if kept is None else pd.concat([kept, part], ignore_index=True)
            key = part[["bucket", "i", "j"]].to_numpy()
            new = np.concatenate(([True], (key[1:] != key[:-1]).any(1)))
            last = int(np.flatnonzero(new)[-1])  # the last cell may go on in the next batch
            kept = part.iloc[last:]
            if last:
                yield found(np.cumsum(new)[:last], part["fp"].to_numpy()[:last])
        if kept is not None:
            yield found(np.zeros(len(kept), np.int64), kept["fp"].to_numpy())

    def found(run: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        a, b = (x.view(np.int64) for x in links_of_runs(run, np.ascontiguousarray(fps).view(np.uint64), radius))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    width = 1 + n_rows // 20_000  # ten entries for each fingerprint: about 200,000 small rows in a task
    dealt = rows.repartition(width, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "fp")
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node it is connected to.

    Large-star then small-star until the edges do not change; then each edge points from a node to its root.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        # each node with the neighbours it hands over: larger ones (large star), or smaller ones and itself (small star)
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if small:
            both = both.filter("b < a")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        moved = both.join(low, "a")
        if small:
            up = moved.filter("b <> low").select(F.col("b").alias("x"), "low").union(low.select(F.col("a").alias("x"), "low"))
        else:
            up = moved.filter("b > a").select(F.col("b").alias("x"), "low")
        return up.filter("x <> low").select(F.col("low").alias("a"), F.col("x").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())

    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = mark(edges)
    while before[0]:
        edges = stage(star(star(edges, small=False), small=True), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def fingerprint_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): every distinct fingerprint of ``prints`` with the one that names its component."""
    distinct = prints.select("fp").distinct()
    roots = components(links(distinct, radius, n_rows=prints.count()))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``, repeated rows included.

    ``component_id``: the smallest doc_id reachable over links of at most ``radius`` differing bits, null only where no
    row of the component has an id. Null and empty texts, and texts without words, have fingerprint zero and link like
    any other. An empty table gives an empty result; other columns are ignored.
    """
    prints = stage(docs.select("doc_id", fingerprint_column("text", shingle, seed).alias("fp")), "fingerprints")
    groups = fingerprint_groups(prints, radius)
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(groups, "fp")
    named = lowest.groupBy("root").agg(F.min("low").alias("component_id")).join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand for their group: of each component the row with the smallest
    doc_id (rows without an id last, then by text hash), once where equal rows repeat."""
    tie = F.xxhash64("text")
    prints = stage(docs.select("doc_id", tie.alias("tie"), fingerprint_column("text", shingle, seed).alias("fp")), "fingerprints")
    groups = fingerprint_groups(prints, radius)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    best = prints.groupBy("fp").agg(F.min(place).alias("best")).join(groups, "fp").groupBy("root").agg(F.min("best").alias("best"))
    keys, nth = [free_name(docs, f"__key{i}") for i in range(3)], free_name(docs, "__nth")
    best = best.select(*(k.alias(n) for n, k in zip(keys, row_key(F.col("best.doc_id"), F.col("best.tie")))))
    kept = with_keys(docs, keys, row_key(docs["doc_id"], F.xxhash64(docs["text"]))).join(best, keys)
    first = Window.partitionBy(*keys).orderBy(F.lit(1))
    return kept.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).select(*docs.columns)
