"""Run folders as a PySpark data source (S2, S9): ``spark.read.format("run_folder")`` and ``spark.readStream``.

A run leaves one JSON document, ``<data>_<run>/output.json``: ``[[text, ...], [[start, end], ...]]``, the texts in
prompt-length order and a time pair per batch. A document grows with its run, so it is read in byte ranges: each
partition is a range of a file, and a task parses the elements that *start* in its range.

A range starts anywhere, so a task first finds out where it is: inside a text, between texts, or among the times. It
carries all possibilities forward over the bytes; JSON's own grammar refutes the wrong ones, as a rule within the first
text. If not, the search starts again further back; at the start of the file the place is known. A range without any
quote can be times, or lie inside a long text that looks like times: its rows are kept only if no later range of the
file holds a quote. So the answer is always exact, whatever the texts hold.

Rows say which range they come from and their number in it; a row of kind ``quote`` stands for a range that holds one.
``read_run_folders`` turns these into positions: the rows are written once, counted by range (a few bytes a range), and
the running count of a file's ranges is joined back.

Options: ``path``, ``rangeBytes``, ``dataset`` (an expression for names of data sets), and ``broken``: ``fail`` (the default) or
``report``, which gives a row of kind ``broken`` with the reason in place of an error. As a stream the source takes each document once, when it appears: documents must appear whole (written elsewhere and
renamed), and later than those already taken.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import staged

RANGE_BYTES = 32 << 20
CHUNK = 1 << 20
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20
SCHEMA = "dataset string, run string, file string, range_start long, kind string, i long, response string, start_ts double, end_ts double"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


# --- where a range starts -------------------------------------------------------------------------------------------

#: Places between which a document moves. TEXT, ESCAPE: inside a text, and after a backslash there. BEFORE, AFTER: where a
#: text may start, and behind one. NULL1 .. NULL3: behind n, nu, nul. TIMES: behind the array of texts.
TEXT, ESCAPE, BEFORE, AFTER, NULL1, NULL2, NULL3, TIMES = range(8)
_PLAIN = re.compile(rb'[^"\\]*+')
_NUMBERS = re.compile(rb"[ \t\r\n0-9+\-.eENaInfity,\[\]]*+")  # with NaN and Infinity, which Python writes
_TOKEN = re.compile(rb'["\]]|null')
_TAIL = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_TAIL_ESCAPED = re.compile(rb'.[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_STRING = re.compile(rb'"([^"\\]*+(?:\\.[^"\\]*+)*+)"', re.S)
_PAIR = re.compile(rb"\[[ \t\r\n0-9+\-.eENaInfity,]++\]")  # the bracket that opens the array of times is followed by another one


def follow(place: int, data: bytes) -> int | None:
    """The place behind ``data``, starting at ``place``; None where JSON's grammar rules the start out."""
    at, n = 0, len(data)
    while at < n:
        if place == TEXT:
            at = _PLAIN.match(data, at).end()
            if at < n:
                place, at = (AFTER if data[at] == 0x22 else ESCAPE), at + 1
            continue
        if place == TIMES:
            return TIMES if _NUMBERS.match(data, at).end() == n else None
        c = data[at : at + 1]
        at += 1
        if place == ESCAPE:
            if c not in b'"\\/bfnrtu':
                return None
            place = TEXT
        elif place in (NULL1, NULL2, NULL3):
            if c != (b"u", b"l", b"l")[place - NULL1]:
                return None
            place = AFTER if place == NULL3 else place + 1
        elif c in b" \t\r\n":
            continue
        elif c == b"]":
            place = TIMES
        elif place == BEFORE and c in b'"n':
            place = TEXT if c == b'"' else NULL1
        elif place == AFTER and c == b",":
            place = BEFORE
        else:
            return None
    return place


def first_section(f) -> int:
    """Offset behind the two brackets that open a document."""
    f.seek(0)
    head = re.match(rb"\s*\[\s*\[", f.read(1 << 16))
    if not head:
        raise ValueError("not a run output: it does not start with two arrays")
    return head.end()


def place_at(f, start: int, end: int, opening: int) -> tuple[int | None, bool]:
    """(place of byte ``start``, whether bytes start..end hold a quote) in a document whose texts begin at ``opening``.

    A range without a quote holds no start of a text; if it can be times it is taken for times, and the caller drops those
    before the last quote of the document (they stand inside a text). The place is None if no element starts in the range.
    """
    ahead, quote = b"", -1
    f.seek(start)
    while quote < 0 and len(ahead) < end - start:
        seen = len(ahead)
        got = f.read(min(CHUNK, end - start - seen))
        if not got:
            break
        ahead += got
        quote = ahead.find(b'"', seen)
    if start <= opening:
        return BEFORE, quote >= 0
    if quote < 0 and not any(c in ahead for c in (b"n", b"u", b"l")):
        return (TIMES if follow(TIMES, ahead) == TIMES else None), False
    ahead += f.read(CHUNK)
    back = start
    while True:
        f.seek(back)
        before = f.read(start - back)
        ends = {follow(p, before) for p in ((BEFORE,) if back <= opening else range(8))} - {None}
        alive = {p for p in ends if follow(p, ahead) is not None}
        if not alive:
            raise ValueError(f"not a run output: nothing fits at byte {start}")
        if len(alive) == 1:
            return alive.pop(), quote >= 0
        back = max(opening, back - max(CHUNK, start - back))  # twice as far back; at the opening one place is left


def elements(f, start: int, end: int, place: int) -> Iterator[tuple[int, str, object]]:
    """(offset, kind, value) of the elements that start in bytes start <= offset < end: texts (str or None) and time pairs."""
    buffer, base, at = b"", start, 0
    f.seek(start)

    def until(find) -> re.Match | None:
        nonlocal buffer, base, at
        while not (m := find(buffer, at)):
            got = f.read(max(CHUNK, len(buffer) - at))  # for a text longer than the buffer it doubles
            if not got:
                return None
            buffer, base, at = buffer[at:] + got, base + at, 0
        return m

    if place in (TEXT, ESCAPE):  # the rest of a text of the range before
        m = until((_TAIL_ESCAPED if place == ESCAPE else _TAIL).match)
        if m is None:
            raise ValueError("end of file inside a text")
        at, place = m.end(), AFTER
    while place != TIMES:
        m = until(_TOKEN.search)
        if m is None:
            raise ValueError("end of file inside the texts")
        first = base + m.start()
        if first >= end:
            return
        if m[0] == b'"':
            at = m.start()
            m = until(_STRING.match)
            if m is None:
                raise ValueError("end of file inside a text")
            yield first, "text", json.loads(m[0]) if b"\\" in m[1] else m[1].decode("utf-8")
        elif m[0] == b"null":
            yield first, "text", None
        else:
            place = TIMES
        at = m.end()
    while (m := until(_PAIR.search)) and base + m.start() < end:
        yield base + m.start(), "time", _pair(m[0])
        at = m.end()


def _pair(raw: bytes) -> list[float | None]:
    """Start and end; nulls for what is no pair of numbers."""
    try:
        start, end = json.loads(raw)
        return [float(start), float(end)]
    except (ValueError, TypeError):
        return [None, None]


# --- data source ----------------------------------------------------------------------------------------------------


@dataclass
class Range(D.InputPartition):
    dataset: str
    run: str
    path: str
    start: int
    end: int


def _documents(path: str, dataset: str) -> list[tuple[int, str, str, str, int]]:
    """(modification time, path, data set, run, size) of the run outputs under a folder, sorted."""
    fs, base = open_fs(path)
    root = re.sub(r"/+$", "", path)
    out = []
    for x in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
        m = re.search(rf"/((?:{dataset}))_([^/]+)/output\.json$", x.path)
        if m and x.type == pafs.FileType.File:
            out.append((x.mtime_ns or 0, root + x.path[len(base.rstrip("/")) :], m[1], m[2], x.size))
    return sorted(out)


def _ranges(documents, range_bytes: int) -> list[Range]:
    return [Range(data, run, path, a, min(a + range_bytes, size)) for _, path, data, run, size in documents for a in range(0, size, range_bytes)]


def _rows(part: Range, report: bool) -> Iterator[pa.RecordBatch]:
    fs, name = open_fs(part.path)
    rows, held, counts = [], 0, {"text": 0, "time": 0}

    def batch() -> pa.RecordBatch:
        kinds, numbers, texts, a, b = zip(*rows)
        n = len(rows)
        same = [pa.array([v] * n, t) for v, t in ((part.dataset, pa.string()), (part.run, pa.string()), (part.path, pa.string()), (part.start, pa.int64()))]
        rest = [pa.array(kinds, pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(a, pa.float64()), pa.array(b, pa.float64())]
        return pa.RecordBatch.from_arrays(same + rest, names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    with fs.open_input_file(name) as f:
        try:
            opening = first_section(f)
            start = max(part.start, opening)
            place, quoted = place_at(f, start, part.end, opening) if start < part.end else (None, False)
            if quoted:
                rows.append(("quote", 0, None, None, None))
            for _, kind, value in elements(f, start, part.end, place) if place is not None else ():
                a, b = (value[0], value[1]) if kind == "time" else (None, None)
                rows.append((kind, counts[kind], value if kind == "text" else None, a, b))
                counts[kind] += 1
                held += len(value or "") if kind == "text" else 16
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        except ValueError as e:
            if not report:
                raise ValueError(f"{part.path}: {e}") from e
            rows.append(("broken", 0, str(e), None, None))
    if rows:
        yield batch()


class RunFolderReader(D.DataSourceReader):
    def __init__(self, options):
        self.path, self.dataset = options["path"], options.get("dataset", "[^/]+?")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.report = options.get("broken", "fail") == "report"

    def partitions(self):
        return _ranges(_documents(self.path, self.dataset), self.range_bytes) or [Range("", "", "", 0, 0)]

    def read(self, partition):
        return _rows(partition, self.report) if partition.path else iter(())


class RunFolderStream(D.DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.dataset = options["path"], options.get("dataset", "[^/]+?")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.report = options.get("broken", "fail") == "report"

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = _documents(self.path, self.dataset)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        fresh = [d for d in _documents(self.path, self.dataset) if (start["time"], start["path"]) < d[:2] <= (end["time"], end["path"])]
        return _ranges(fresh, self.range_bytes)

    def read(self, partition):
        return _rows(partition, self.report)

    def commit(self, end: dict) -> None:
        """Nothing is kept between offsets."""


class RunFolderSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RunFolderReader:
        return RunFolderReader(self.options)

    def streamReader(self, schema: StructType) -> RunFolderStream:
        return RunFolderStream(self.options)


def scan_run_folders(spark: SparkSession, base: str, datasets: Sequence[str] = (), range_bytes: int = RANGE_BYTES, skip_broken: bool = False) -> DataFrame:
    """Elements of every ``<dataset>_<run>/output.json`` under ``base`` as the source gives them. Names of data sets may hold
    underscores where they are given; otherwise the name is what stands before the first underscore."""
    spark.dataSource.register(RunFolderSource)
    reader = spark.read.format("run_folder").option("rangeBytes", range_bytes).option("broken", "report" if skip_broken else "fail")
    names = "|".join(re.escape(d) for d in sorted(datasets, key=len, reverse=True))
    return (reader.option("dataset", names) if names else reader).load(base)


def _placed(spark: SparkSession, base: str, datasets: Sequence[str], range_bytes: int, skip_broken: bool) -> DataFrame:
    """Elements with ``nth``, their number from 0 among the texts or times of their document. Whole texts stay where they are: what
    is known of a file or range is a few bytes, and is sent to them."""
    rows = staged(scan_run_folders(spark, base, datasets, range_bytes, skip_broken), "run-folder-rows")
    if skip_broken:
        rows = rows.join(F.broadcast(rows.where("kind = 'broken'").select("file").distinct()), "file", "left_anti")
    last = rows.where("kind = 'quote'").groupBy("file").agg(F.max("range_start").alias("last_quote"))
    kept = rows.where("kind <> 'quote'").join(F.broadcast(last), "file", "left").where("kind = 'text' or last_quote is null or range_start >= last_quote")
    counts = kept.groupBy("file", "kind", "range_start").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file", "kind").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("file", "kind", "range_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return kept.join(F.broadcast(bases), ["file", "kind", "range_start"]).withColumn("nth", F.col("base") + F.col("i"))


def read_answers(spark: SparkSession, base: str, datasets: Sequence[str] = (), range_bytes: int = RANGE_BYTES, skip_broken: bool = False) -> DataFrame:
    """(dataset, run, position, response) of ``read_run_folders``, where times are not wanted: no text is shuffled."""
    texts = _placed(spark, base, datasets, range_bytes, skip_broken).where("kind = 'text'")
    return texts.select("dataset", "run", (F.col("nth") + 1).alias("position"), "response")


def read_run_folders(
    spark: SparkSession, base: str, batch_size: int, datasets: Sequence[str] = (), range_bytes: int = RANGE_BYTES, skip_broken: bool = False
) -> DataFrame:
    """(dataset, run, position, batch_id, response, start_ts, end_ts): one row per answer, positions from 1 in document
    order, with the times of its batch (null where the document has none). A document that is broken anywhere is an error,
    or has no rows with ``skip_broken``."""
    placed = _placed(spark, base, datasets, range_bytes, skip_broken)
    texts = placed.where("kind = 'text'").select("dataset", "run", "file", (F.col("nth") + 1).alias("position"), F.floor(F.col("nth") / batch_size).alias("batch_id"), "response")
    times = placed.where("kind = 'time'").select("file", F.col("nth").alias("batch_id"), "start_ts", "end_ts")
    return texts.join(times, ["file", "batch_id"], "left").select("dataset", "run", "position", "batch_id", "response", "start_ts", "end_ts")


# --- writing run folders --------------------------------------------------------------------------------------------


def write_run_folders(answers: DataFrame, times: DataFrame, base: str) -> None:
    """S9 in the runner's layout: one ``<dataset>_<run>/output.json`` per run of ``answers`` (dataset, run, position, response)
    and ``times`` (dataset, run, batch_id, start_ts, end_ts).

    The layout is one document a run, so one task writes a run, in a stream of bounded memory; ``write_responses`` is the
    sink without that bound. A document is written beside its place and moved there when it is whole, so a task that runs
    again replaces it.
    """
    texts = answers.select("dataset", "run", F.lit(0).alias("part"), F.col("position").cast("long").alias("nth"), "response", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    pairs = times.select("dataset", "run", F.lit(1).alias("part"), F.col("batch_id").cast("long").alias("nth"), F.lit(None).cast("string").alias("response"), F.col("start_ts").alias("a"), F.col("end_ts").alias("b"))
    rows = texts.unionByName(pairs).repartition("dataset", "run").sortWithinPartitions("dataset", "run", "part", "nth")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(base)
        at, out, part, written = None, None, 0, []

        def close() -> None:
            if at is not None:
                out.write(b"]]" if part else b"], []]")
                out.close()
                fs.move(f"{folder}/{hidden}", f"{folder}/output.json")
                written.append("/".join(at))

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["dataset"], row["run"])
                if here != at:
                    close()
                    at, part, folder, hidden = here, 0, f"{root}/{row['dataset']}_{row['run']}", f".{uuid.uuid4().hex}"
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{hidden}", compression=None)
                    out.write(b"[[")
                    comma = b""
                if row["part"] != part:
                    out.write(b"], [")
                    part, comma = 1, b""
                out.write(comma + json.dumps(row["response"] if not part else [row["a"], row["b"]]).encode())
                comma = b", "
        close()
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], names=["run"])

    rows.mapInArrow(write, "run string").write.mode("overwrite").format("noop").save()
