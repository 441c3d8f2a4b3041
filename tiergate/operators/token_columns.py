"""Words of text columns inside Arrow batches: numbers for words instead of Python strings.

Words are those of ``rouge.tokens`` - maximal runs of a-z and 0-9 of the lower-cased text - and are found by array operations
over the bytes of a whole column (bytes of other characters separate words, as those characters do). Texts arrive lower-cased by
Spark, whose rules for letters hold. Batches are cut into slices of bounded bytes, so memory does not follow the batch size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 4 << 20, 2_000
CACHED = 1 << 17
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_HASHES: dict[str, int] = {}


def hash32(word: str) -> int:
    """The first 8 hex digits of the md5 of a word as a number; frequent words are remembered (a bounded number)."""
    got = _HASHES.get(word)
    if got is None:
        got = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
        if len(_HASHES) < CACHED:
            _HASHES[word] = got
    return got


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hash32, words), np.int64, len(words))


def long_hashes(words: list[str]) -> np.ndarray:
    """The first 15 hex digits of the md5 of words: for tables whose keys are words, not numbers of a range."""
    return np.fromiter((int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words), np.int64, len(words))


def spans(sizes: np.ndarray, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of at most ``rows`` rows whose ``sizes`` sum up to at most ``size`` (one row at least)."""
    ends = np.cumsum(sizes)
    at, before = 0, 0
    while at < len(ends):
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield at, end
        at, before = end, int(ends[end - 1])


def lengths(*columns: pa.Array) -> np.ndarray:
    """Bytes of each row of text or binary columns, summed over the columns; null has none."""
    return sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)


def slices(*columns: pa.Array, parts: int = 1) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of a batch in slices of at most ``SLICE_ROWS`` rows and about ``SLICE_BYTES`` bytes of text (one row at least);
    with ``parts``, of so many times less."""
    for at, end in spans(lengths(*columns), max(SLICE_ROWS // parts, 1), SLICE_BYTES // parts):
        yield tuple(c.slice(at, end - at) for c in columns)


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of a column, where each row's words start and end); a null text has none."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, raw = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kept = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)  # a word may start or end here
    edge[1:-1] = kept[1:] != kept[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts = cuts[:-1][kept[cuts[:-1]]] if len(data) else cuts[:0]
    sizes = np.diff(cuts)[kept[cuts[:-1]]] if len(data) else cuts[:0]
    places = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[kept]))
    return words, np.searchsorted(starts, offsets)


def word_codes(*columns: pa.Array) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """(words, [(codes, offsets) of each column]): the words of row i are ``codes[offsets[i]:offsets[i + 1]]``, numbers of ``words``."""
    found = [_words(c) for c in columns]
    coded = pa.concat_arrays([w for w, _ in found]).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    cuts = np.cumsum([0] + [len(w) for w, _ in found])
    return coded.dictionary.to_pylist(), [(codes[a:b], offsets) for a, b, (_, offsets) in zip(cuts, cuts[1:], found)]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, number of each value among them)."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def pair_codes(n_words: int, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, row) of every two words that stand side by side in a row: first word x ``n_words`` + second word."""
    inside = rows[1:] == rows[:-1]
    return (codes[:-1] * n_words + codes[1:])[inside], rows[1:][inside]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, how often each stands there)."""
    return np.unique(keys, return_counts=True)


def found_in(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value is among the ordered distinct ones, its place there)."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at
