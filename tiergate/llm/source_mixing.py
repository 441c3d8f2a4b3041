"""Mixing sources to target weights.

Every source's words form one stream (documents in a fixed pseudorandom order), cut into blocks of a fixed length. The
mix is a list of output shards; the slots of a shard are dealt to sources by a multinomial draw. A source numbers its
slots over all shards, and slot number ``k`` takes block ``perm(epoch, k mod n)`` with ``epoch = k div n``: a
pseudorandom permutation of the source's ``n`` block numbers for each epoch. Blocks meet their slots by an equi-join
on (source, block). A source never gets more slots than ``repeats`` times its blocks, so no word is taken more often.

The draws fluctuate around the targets; the last shards settle the difference (a source that is over its quota loses
its last slots, one that is under gets the rest in closing shards), so every source ends within about one block of its target.

Driver state is one row per source (name, size, weight, target), as in any mixing table. Positions in a stream come
from two-level running sums over salted buckets, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergate.llm.common import SPACE, free_name, let, row_key, stage, with_keys

BLOCK_WORDS = 64
REPEATS = 3
SEED = 7

_WORD = re.compile(f"[^{SPACE}]+")

#: A table of per-source driver state is broadcast up to this many sources (some MB); beyond it joins shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "w")
    return F.length(F.translate(gaps, " \t\n\x0b\x0c\r", "")).cast("long")


def shard_size(n_slots: int) -> int:
    """Slots of an output shard; grows with the root of the mix, so neither shards nor slots in a shard get too many."""
    return 1024 + math.isqrt(n_slots)


def cyclic_weights(names: list) -> dict:
    """Weights 1, 2, 3, 1, ... by code point order of the source names, null last."""
    ordered = sorted(names, key=lambda s: (s is None, s or ""))
    return {s: float(1 + i % 3) for i, s in enumerate(ordered)}


def target_sizes(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Share the total of ``sizes`` by weight; a source stops at ``repeats`` times its size, the excess is shared again by weight."""
    left, free, out = float(sum(sizes.values())), dict(weights), {}
    while free:
        unit = left / sum(free.values())
        full = [s for s, w in free.items() if w * unit > repeats * sizes[s]]
        if not full:
            out |= {s: w * unit for s, w in free.items()}
            break
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
            del free[s]
    return out


class BlockPermutation:
    """A keyed pseudorandom permutation of 0..n-1 (balanced Feistel rounds over the next even power of two, cycle-walked)."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)

    def _once(self, v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(self.half), v & self.mask
        for k in self.keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & self.mask)
        return (left << np.uint64(self.half)) | right

    def __call__(self, v: np.ndarray) -> np.ndarray:
        out = self._once(v.astype(np.uint64))
        while (far := out >= self.n).any():
            out[far] = self._once(out[far])
        return out.astype(np.int64)


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, tie): what the mix needs of a document; ``tie`` orders equal ids."""
    return docs.select("doc_id", F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("tie"))


def source_table(rows: DataFrame, weigh=cyclic_weights, repeats: int = REPEATS, block_words: int = BLOCK_WORDS) -> list[dict]:
    """One entry per source, in code point order with null last: number, name, size, blocks, target and slot quota."""
    sizes = {r["source"]: int(r["size"] or 0) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = target_sizes(sizes, weigh(list(sizes)), repeats)
    out = []
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        blocks = -(-sizes[s] // block_words)
        quota = min(repeats * blocks, round(targets[s] * blocks / sizes[s])) if blocks else 0
        out.append({"num": i, "source": s, "size": sizes[s], "blocks": blocks, "target": targets[s], "quota": quota})
    return out


def _per_source(table: DataFrame, sources: list[dict]) -> DataFrame:
    return F.broadcast(table) if len(sources) <= BROADCAST_SOURCES else table


def _numbered(rows: DataFrame, sources: list[dict]) -> DataFrame:
    """Join the per-source entries (driver state, one row per source) to rows of ``source``."""
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(s["num"], s["source"], s["size"], s["target"]) for s in sources], "num int, name string, source_size long, target double"
    )
    table = _per_source(table, sources)
    return rows.join(table, rows["source"].eqNullSafe(table["name"])).drop("name")


def with_offsets(rows: DataFrame, n_rows: int, seed: int = SEED) -> DataFrame:
    """Add ``at``: where the document's words start in its source's stream.

    Order of the stream: hash bucket, then id hash. Running sums inside (source, bucket), plus the sum of the earlier
    buckets of the source. There are as many buckets as the root of the rows, so both sums stay small in every task.
    """
    n_buckets = 1 + math.isqrt(n_rows)
    rows = rows.withColumn("mix", F.xxhash64(F.lit(seed), "doc_id", "tie")).withColumn("bucket", F.pmod("mix", F.lit(n_buckets)).cast("int"))
    sums = rows.groupBy("num", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("num").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("num", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("num", "bucket").orderBy("mix", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("upto", F.sum("size").over(inside))
    return running.join(sums, ["num", "bucket"]).withColumn("at", F.col("base") + F.col("upto") - F.col("size")).drop("base", "upto", "bucket", "mix")


def shard_draws(spark, sources: list[dict], seed: int = SEED) -> DataFrame:
    """(shard, num, first, slots): the slots of every output shard that go to each source, numbered from ``first`` per source.

    Each shard draws its multinomial on its own, from the seed and its number; running sums over shards number the
    slots. Quotas then settle the difference: slots past a quota are cut, and missing ones fill closing shards.
    """
    quota = np.array([s["quota"] for s in sources], np.int64)
    total = int(quota.sum())
    shard_slots = shard_size(total)
    n_shards = -(-total // shard_slots)
    share = quota / max(1, total)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for shard in part["id"]:
                size = shard_slots if shard < n_shards - 1 else total - shard_slots * (n_shards - 1)
                got = np.random.default_rng([seed, int(shard)]).multinomial(size, share)
                used = np.flatnonzero(got)
                yield pd.DataFrame({"shard": shard, "num": used.astype(np.int32), "slots": got[used]})

    drawn = spark.range(0, n_shards).mapInPandas(draw, "shard long, num int, slots long")
    totals = _per_source(spark.createDataFrame([(s["num"], s["quota"]) for s in sources], "num int, quota long"), sources)
    earlier = Window.partitionBy("num").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("slots").over(earlier), F.lit(0)))
    missing = (
        drawn.groupBy("num").agg(F.sum("slots").alias("drawn")).join(totals, "num", "right")
        .withColumn("first", F.coalesce("drawn", F.lit(0).cast("long")))
        .filter(F.col("first") < F.col("quota"))
        .select("num", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - F.col("first") - 1) / shard_slots))).alias("part"), "quota")
        .select(
            (F.col("part") + n_shards).alias("shard"), "num", (F.col("first") + F.col("part") * shard_slots).alias("first"),
            F.least(F.lit(shard_slots).cast("long"), F.col("quota") - F.col("first") - F.col("part") * shard_slots).alias("slots"),
        )
    )
    kept = (
        drawn.join(totals, "num")
        .withColumn("slots", F.least("slots", F.col("quota") - F.col("first")))
        .filter("slots > 0")
        .select("shard", "num", "first", "slots")
    )
    return kept.unionByName(missing)


def slot_blocks(draws: DataFrame, sources: list[dict], seed: int = SEED) -> DataFrame:
    """(shard, slot, num, block, epoch): the block that every slot of the mix takes; ``epoch``: how often it was taken before."""
    blocks = {s["num"]: s["blocks"] for s in sources}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        perms: dict[tuple[int, int], BlockPermutation] = {}
        for part in batches:
            for shard, num, first, slots in part[["shard", "num", "first", "slots"]].itertuples(index=False):
                n = blocks[num]
                k = np.arange(first, first + slots, dtype=np.int64)
                taken = np.empty(len(k), np.int64)
                for epoch in range(int(k[0]) // n, int(k[-1]) // n + 1):
                    if (num, epoch) not in perms:
                        perms[num, epoch] = BlockPermutation(n, hash((seed, num, epoch)) & 0x7FFFFFFF)
                    own = k // n == epoch
                    taken[own] = perms[num, epoch](k[own] % n)
                yield pd.DataFrame({"shard": shard, "slot": k, "num": np.int32(num), "block": taken, "epoch": k // n})

    spread = draws.repartition(1 + sum(s["quota"] for s in sources) // 50_000, "shard", "num")  # few rows that unfold to many
    return spread.mapInPandas(deal, "shard long, slot long, num int, block long, epoch long")


def _at_blocks(parts: DataFrame, slots: DataFrame) -> DataFrame:
    """Join what documents have of a block with rows of slots. A few rows per shard unfold to all slots, and a row per document
    to all its blocks, which Spark's size estimates don't see: without the hint it would broadcast one of the sides."""
    return parts.join(slots.hint("merge"), ["num", "block"])


def doc_blocks(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each (document, block that holds some of its words): ``lo`` and ``hi`` are word numbers in the document."""
    b = F.lit(block_words)
    ids = F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))
    parts = rows.filter("size > 0").select("*", F.explode(ids).alias("block"))
    lo = F.greatest(F.col("block") * b - F.col("at"), F.lit(0).cast("long"))
    hi = F.least((F.col("block") + 1) * b - F.col("at"), F.col("size"))
    return parts.withColumns({"lo": lo, "hi": hi})


def plan_mix(docs: DataFrame, weigh=cyclic_weights, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, seed: int = SEED):
    """(rows, slots): documents placed in their source's stream, and the blocks that the slots of the mix take."""
    rows = stage(sized(docs), "mix-sizes")
    sources = source_table(rows, weigh, repeats, block_words)
    placed = with_offsets(_numbered(rows, sources), rows.count(), seed)
    return placed, slot_blocks(shard_draws(docs.sparkSession, sources, seed), sources, seed)


def mix_counts(docs: DataFrame, weigh=cyclic_weights, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``, repeated rows included.

    A null or empty text has size 0 and nothing taken from it; null is a source of its own. An empty table gives an
    empty result. Other columns are ignored.
    """
    placed, slots = plan_mix(docs, weigh, repeats, block_words, seed)
    # the row number inside a stream is unique among documents that have words
    times = slots.groupBy("num", "block").agg(F.count("*").alias("times"))
    hits = _at_blocks(doc_blocks(placed, block_words), times)
    taken = hits.groupBy("num", "at").agg(F.sum(F.col("times") * (F.col("hi") - F.col("lo"))).alias("taken"))
    full = placed.withColumn("key", F.when(F.col("size") > 0, F.col("at")))
    out = full.join(taken.withColumnRenamed("at", "key"), ["num", "key"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def _cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
    """The word ranges (ascending) of each text, white space inside a range kept, joined by line feeds."""
    out = []
    for text, own in zip(texts, ranges):
        if text is None or own is None:  # a whole document, kept as it is
            out.append(None)
            continue
        words = [m.span() for m in _WORD.finditer(text)]
        out.append("\n".join(text[words[r["lo"]][0] : words[r["hi"] - 1][1]] for r in own))
    return pd.Series(out)


def mix_documents(docs: DataFrame, weigh=cyclic_weights, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row per document and epoch that takes words from it.

    An epoch that takes all words of a document gives it unchanged; otherwise ``text`` holds the taken ranges, in
    order, one per line. Documents without words are not in the mix. ``source`` and other columns are copied; rows that
    repeat id, text and source share their other columns.
    """
    placed, slots = plan_mix(docs, weigh, repeats, block_words, seed)
    # runs of neighbouring blocks: words lo..hi of the document at ``at`` in its source's stream, taken in this epoch
    parts = _at_blocks(doc_blocks(placed, block_words), slots.select("num", "block", "epoch"))
    key = ["doc_id", "tie", "source", "num", "at", "size", "epoch"]
    ranges = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))

    def joined(found: Column) -> Column:
        # a range starts where the one before it does not end
        lows = F.filter(found, lambda r, i: (i == 0) | (F.get(found, i - 1)["hi"] != r["lo"]))
        highs = F.filter(found, lambda r, i: (i == F.size(found) - 1) | (F.get(found, i + 1)["lo"] != r["hi"]))
        return F.zip_with(lows, highs, lambda a, b: F.struct(a["lo"].alias("lo"), b["hi"].alias("hi")))

    ranges = ranges.withColumn("ranges", let(F.col("ranges"), joined))
    whole = (F.size("ranges") == 1) & (F.col("ranges")[0]["hi"] - F.col("ranges")[0]["lo"] == F.col("size"))
    keys = [free_name(docs, f"__key{i}") for i in range(3)]
    nth, taken = free_name(docs, "__nth"), free_name(docs, "__ranges")
    copies = with_keys(ranges, keys, row_key(F.col("doc_id"), F.col("tie"), F.col("source")))
    copies = copies.select(*keys, F.when(~whole, F.col("ranges")).alias(taken))
    keyed = with_keys(docs, keys, row_key(docs["doc_id"], F.xxhash64(docs["text"]), docs["source"]))
    once = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))).filter(F.col(nth) == 1)
    some = F.col(taken).isNotNull()
    cut = F.pandas_udf(_cut, "string")(F.when(some, F.col("text")), F.col(taken))
    return once.join(copies, keys).withColumn("text", F.when(some, cut).otherwise(F.col("text"))).select(*docs.columns)
