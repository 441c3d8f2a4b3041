"""Fill-in-the-middle transformation of whole texts, cut at code points.

A text of n code points is cut at two drawn places into prefix, middle and suffix, and written in one of two orders with
sentinels before the parts, so that a model learns to write the middle from both sides.

The cuts are found without decoding. The UTF-8 bytes of an Arrow batch are viewed as 64-bit words; word arithmetic marks
each byte that ends a code point (the byte after it is no continuation byte), ``bitwise_count`` counts the marks of each
word, and one running sum numbers the code points of the batch. A cut after k units is a search for the word that holds
the k-th mark, then a select inside that word by byte-wise prefix sums. All texts of a batch are done at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
FIM_PERCENT = 90
SPM_PERCENT = 20

ONES = np.uint64(0x0101010101010101)
_TOP = np.uint64(56)
_U = np.uint64


# --- code points of a buffer ----------------------------------------------------------------------------------------


class UnitIndex:
    """Code points of a UTF-8 buffer: how many end before a byte, and where the k-th one ends."""

    def __init__(self, data: np.ndarray):
        """``data``: uint8. Bytes that are no valid UTF-8 count as Spark counts them: all but continuation bytes."""
        n = len(data)
        words = np.zeros(-(-n // 8) + 1, "<u8")  # a word past the end, so the last byte ends its code point
        words.view(np.uint8)[:n] = data
        starts = ~(words >> _U(7) & ~(words >> _U(6))) & ONES  # lowest bit of each byte that is no continuation byte
        self.ends = (starts[:-1] >> _U(8)) | (starts[1:] << _TOP)  # a byte ends a unit if the next one starts another
        spare = -n % 8
        if spare and len(self.ends):  # bytes of padding end nothing
            self.ends[-1] &= _U((1 << 8 * (8 - spare)) - 1)
        self.total = np.zeros(len(self.ends) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.total[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each byte offset."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        ends = np.append(self.ends, _U(0))[word]
        below = ends & ((_U(1) << (inside * _U(8))) - _U(1))
        return self.total[word] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte offset after the k-th unit (from 1) of the buffer; 0 for k = 0."""
        word = np.searchsorted(self.total, k, side="left") - 1  # total[word] < k <= total[word + 1]
        found = k > 0
        word = np.where(found, word, 0)
        left = (k - self.total[word]).astype(np.uint64)
        prefix = (self.ends[word] if len(self.ends) else np.zeros(len(k), np.uint64)) * ONES  # marks up to and with each byte
        # bytes whose prefix sum is below ``left`` (both at most 8): the carry into bit 7 tells
        below = (((left * ONES) | (ONES << _U(7))) - prefix - ONES) >> _U(7) & ONES
        return np.where(found, word * 8 + np.bitwise_count(below).astype(np.int64) + 1, 0)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings or binaries, nulls taken as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut_batch(texts: pa.Array, h: list[np.ndarray], fim_percent: int, spm_percent: int) -> dict[str, list | np.ndarray]:
    """Units, form, part lengths and output of every text of a batch; ``h``: four draws for each text."""
    data, offsets = _buffer(texts)
    index = UnitIndex(data)
    first = index.rank(offsets[:-1])
    n = index.rank(offsets[1:]) - first
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    at_low = np.where(low > 0, index.select(first + low), offsets[:-1])
    at_high = np.where(high > 0, index.select(first + high), offsets[:-1])
    raw = data.tobytes()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    cut = (n > 0) & (h[2] % 100 < fim_percent)
    spm = h[3] % 100 < spm_percent
    form, output = [], []
    for start, i, j, end, cuts, swaps in zip(offsets[:-1].tolist(), at_low.tolist(), at_high.tolist(), offsets[1:].tolist(), cut.tolist(), spm.tolist()):
        if not cuts or any(raw.find(mark, start, end) >= 0 for mark in marks):
            form.append("plain")
            output.append(raw[start:end])
            continue
        prefix, middle, suffix = raw[start:i], raw[i:j], raw[j:end]
        form.append("spm" if swaps else "psm")
        output.append(b"".join((s, suffix, p, prefix, m, middle) if swaps else (p, prefix, s, suffix, m, middle)))
    return {"n": n, "form": form, "prefix_chars": low, "middle_chars": high - low, "output": output}


# --- over documents -------------------------------------------------------------------------------------------------


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit draws of a document: groups of 8 hex digits of the sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"draw{i}") for i in range(4)]


def transform(docs: DataFrame, text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    Form ``psm``: prefix, suffix, middle; ``spm``: suffix, prefix, middle, each part after its sentinel; ``plain``: the
    text, if it is empty, holds a sentinel or is drawn to stay. A null text counts as empty. A null doc_id draws from the
    seed alone. Rows that repeat an id and a text get the same result. Plain rows have null part lengths. Other columns
    are ignored; an empty table gives an empty result.
    """
    columns = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(f"draw{i}").to_numpy() for i in range(4)]
            got = cut_batch(batch.column("body"), h, fim_percent, spm_percent)
            plain = np.array([f == "plain" for f in got["form"]], bool)
            arrays = [
                batch.column("doc_id"), pa.array(got["n"], pa.int64()), pa.array(got["form"], pa.string()),
                pa.array(got["prefix_chars"], pa.int64(), mask=plain), pa.array(got["middle_chars"], pa.int64(), mask=plain), pa.array(got["output"], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"), *draws(F.col("doc_id"), seed))
    out = rows.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output and its form. Sentinels stand once each in a cut text: the text holds none, and none can
    arise where a part meets a sentinel, as no sentinel begins as another one ends."""
    inner = lambda after, before: F.split_part(F.split_part(output, F.lit(after), F.lit(2)), F.lit(before), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(inner(PREFIX, SUFFIX), middle, inner(SUFFIX, MIDDLE))
    spm = F.concat(inner(PREFIX, MIDDLE), middle, inner(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for every row of ``docs``."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    again = restored(F.col("output"), F.col("form"))
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))
