"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Best fit decreasing looks at lengths only, so the packing of any corpus is decided by its length histogram. The driver
runs best fit over that histogram (at most ``capacity`` counts): lengths from long to short, a segment tree over
remaining capacities finds the tightest open bin in logarithmic time, and pieces of equal length that meet bins of
equal remaining capacity are placed together. Each length adds at most a few new kinds of bins, so the plan has
O(capacity) entries however many documents there are. Executors number the pieces of each length (salted, so that a
length with a third of all pieces is spread out) and look their sequence and offset up in the plan.

Documents are tokenised once, in Arrow batches; lengths and checksums go to the shared folder before packing.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiergate.llm.common import stage

CAPACITY = 2048
END_ID = 0

#: Texts with a longer run of white space are encoded by ``tokenizers`` (``tiktoken`` fails from about 900,000 on).
LONG_GAP = 100_000


def longest_gap(text: str) -> int:
    """Length of the longest run of white space; 0 for texts that are too short to matter."""
    return 0 if len(text) <= LONG_GAP else max(map(len, re.findall(r"\s+", text)), default=0)


@lru_cache(maxsize=2)
def load_encoder(path: str | None = None):
    """Encoder for a byte-level BPE vocabulary file of the ``tokenizers`` library (``None``: byte_bpe_50k.json).

    Merges of such a vocabulary are ordered by id, so ``tiktoken`` gives the same ids from the same file, about three
    times as fast; a test compares both. Added tokens that a text names become their own ids and the text between them is
    encoded piece by piece, as in ``tokenizers``; that library itself does it if they also take spaces or need word ends,
    and it encodes texts with a very long run of white space, on which the expression engine of ``tiktoken`` gives up.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    library = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))  # read by the workers that need it only
    by_library = lambda text: library().encode(text, add_special_tokens=False).ids
    added = spec.get("added_tokens", [])
    id_of = {x["content"]: x["id"] for x in added}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]  # the others are shifted past 255, in order
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in id_of}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    ordinary = lambda text: by_library(text) if longest_gap(text) > LONG_GAP else fast(text)
    if not added:
        return ordinary
    plain = not any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip"))
    names = re.compile("|".join(re.escape(name) for name in sorted(id_of, key=len, reverse=True)))  # the longest first

    def encode(text: str) -> list[int]:
        if not names.search(text):
            return ordinary(text)
        if not plain or longest_gap(text) > LONG_GAP:
            return by_library(text)
        ids, at = [], 0
        for name in names.finditer(text):
            ids += ordinary(text[at : name.start()])
            ids.append(id_of[name[0]])
            at = name.end()
        return ids + ordinary(text[at:])

    return encode


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else the remainder first and full pieces after it."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, tie, piece, start, length, ids_crc32[, ids]) for every row of ``docs``; null texts count as empty."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder(tokenizer_path)
        for part in batches:
            out = []
            for doc_id, tie, text in zip(part["doc_id"], part["tie"], part["text"]):
                ids = np.array([*encoder(text or ""), END_ID], "<u4")
                for piece, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    own = ids[start : start + length]
                    out.append((doc_id, tie, piece, start, length, zlib.crc32(own.tobytes()), *([own.astype("int32")] if keep_ids else [])))
            frame = pd.DataFrame(out, columns=columns)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    columns = ["doc_id", "tie", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, tie long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInPandas(encode, schema)


class RoomTree:
    """Segment tree over remaining capacities 0..capacity that tells which ones have an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        i = self.leaves + room
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest room of at least ``need`` with an open bin."""
        i = self.leaves + need
        while not self.any[i]:
            while i & 1:  # a right child: go up to the next subtree on the right
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit decreasing over {length: count}: (plan, number of bins).

    A plan entry (length, lo, hi, per_bin, first_bin, offset) places pieces lo <= rank < hi of that length: rank r
    goes to bin ``first_bin + (r - lo) div per_bin`` at ``offset + length * ((r - lo) mod per_bin)``.
    """
    tree = RoomTree(capacity)
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first bin, number of bins) with that room
    plan, n_bins = [], 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            rooms.setdefault(room, []).append(run)
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            room = tree.tightest(length)
            if room is None:
                room, need = capacity, -(-(count - rank) // (capacity // length))
                run, n_bins = (n_bins, need), n_bins + need
            else:
                run = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    tree.set(room, False)
            # a bin takes as many pieces as fit before the next looser bin gets one, as best fit would
            first, bins = run
            per_bin = room // length
            full = min(bins, (count - rank) // per_bin)
            if full:
                plan.append((length, rank, rank + full * per_bin, per_bin, first, capacity - room))
                rank += full * per_bin
                put(room - per_bin * length, (first, full))
            rest = count - rank
            if full < bins and 0 < rest < per_bin:
                plan.append((length, rank, count, rest, first + full, capacity - room))
                rank = count
                put(room - rest * length, (first + full, 1))
                full += 1
            put(room, (first + full, bins - full))
    return plan, n_bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, tie, piece, length, ...), at most ``capacity`` long each."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan, _ = plan_bins(histogram, capacity)
    # number the pieces of a length: salts grow with the root of the pieces, so neither level of the sums gets large
    salts = 1 + math.isqrt(sum(histogram.values()))
    order = ["doc_id", "tie", "piece"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("here"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy(*order)
    ranked = salted.withColumn("rank", F.row_number().over(inside)).join(counts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("base")).drop("salt", "base")
    place = _lookup(plan)
    return ranked.withColumn("at", place("length", "rank")).withColumns({"sequence_id": F.col("at.bin"), "offset": F.col("at.offset")}).drop("at", "rank")


def _lookup(plan: list[tuple[int, int, int, int, int, int]]):
    """Arrow-batched lookup of (length, rank) in the plan, whose size is O(capacity)."""
    wide = 1 << 48  # ranks are below this
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)
    starts = table[:, 0] * wide + table[:, 1]

    @F.pandas_udf("bin long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        run = table[np.searchsorted(starts, length.to_numpy() * wide + rank.to_numpy(), side="right") - 1]
        nth = rank.to_numpy() - run[:, 1]
        return pd.DataFrame({"bin": run[:, 4] + nth // run[:, 3], "offset": run[:, 5] + run[:, 0] * (nth % run[:, 3])})

    return place


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): one row per piece of every row of ``docs``.

    A null or empty text is the single end id; a text of any length is cut into full pieces after a first shorter one.
    Repeated rows are packed once each. An empty table gives an empty result. Other columns are ignored.
    """
    pieces = stage(tokenised_pieces(docs, capacity, tokenizer_path, keep_ids), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    return pack(pieces, capacity).select(*columns)
