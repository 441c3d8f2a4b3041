"""WARC archives as a PySpark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading. Partitions are planned over files: archives written here list their files, sizes and record counts in a manifest
and keep an index of record offsets beside each file, so a large file is cut into record ranges; other archives are one
unit a file, and small files share a partition. A task parses the header fields of a record first and tests the pushed
predicates on them (record type, ids, URI, date, digest); a record that fails, or a payload that nobody asked for, is
never decoded: an indexed or plain archive seeks past it. Filters reach the reader through Spark's filter pushdown
(``spark.sql.python.filterPushdown.enabled``, with the option ``pushdown``; ``read_warc`` sets it where Spark has pushdown
on), or as the options ``recordTypes`` and ``uriPrefix`` in any session. Columns are pruned by a declared schema: without
``payload`` in ``spark.read.schema(...)`` no payload is read.

Writing. Each task writes its own files (rolled at ``maxFileBytes``, one gzip member a record) under new names; the
driver commits a manifest that names the files of the successful tasks, so readers never see what a failed or repeated
task left behind.

Options: ``path``; reading ``recordTypes``, ``uriPrefix``, ``splitBytes``, ``minPartitions``, ``pushdown``; writing
``maxFileBytes``, ``compression`` (``gzip`` or ``none``), ``date``. Paths are opened with ``pyarrow.fs``: shared folders, HDFS and object stores.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

SPLIT_BYTES, LEAST_SPLIT_BYTES = 128 << 20, 1 << 20
MAX_FILE_BYTES = 1 << 30
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000
VERSION = b"WARC/1.1"

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "headers map<string,string>, payload_bytes long, payload binary, file string, at long"
)
#: Columns that are WARC header fields, and their names there.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
_COLUMN_OF = {v.lower(): k for k, v in FIELDS.items()}
_ARROW = {
    **dict.fromkeys([*FIELDS, "file"], pa.string()), "headers": pa.map_(pa.string(), pa.string()),
    "payload_bytes": pa.int64(), "at": pa.int64(), "payload": pa.binary(),
}


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


# --- records --------------------------------------------------------------------------------------------------------


def clean(value: str) -> str:
    """A header value on one line: control characters and outer spaces are percent-encoded."""
    code = lambda m: "".join(f"%{b:02X}" for b in m[0].encode())
    return re.sub(r"[\x00-\x1f\x7f]|^ +| +$", code, value)


def encode_record(fields: dict[str, str | None], payload: bytes | None, payload_bytes: int) -> bytes:
    """One record. Responses and revisits hold HTTP headers with the length of the full payload; a revisit no payload."""
    block = payload or b""
    if fields["WARC-Type"] in ("response", "revisit"):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
        block = http.encode() + block
        fields = {**fields, "Content-Type": "application/http; msgtype=response"}
    lines = [f"{k}: {clean(v)}\r\n".encode() for k, v in fields.items() if v is not None]
    return b"".join([VERSION, b"\r\n", *lines, b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def _header_lines(stream, limit: int | None = None) -> tuple[list[bytes], int, bool]:
    """(lines up to the blank one, bytes read, whether a blank line was met within ``limit`` bytes)."""
    lines, size = [], 0
    while limit is None or size < limit:
        line = stream.readline(-1 if limit is None else limit - size)
        if not line:
            raise ValueError("end of file inside the headers of a record")
        size += len(line)
        if line in (b"\r\n", b"\n"):
            return lines, size, True
        lines.append(line)
    return lines, size, False


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Named fields in lower case; a line that starts with white space goes on with the one before it."""
    out, last = {}, None
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            last, value = text.split(":", 1)
            last = last.strip()
            out[last] = value.strip()
    return out


class _Inflate(io.RawIOBase):
    """The bytes of one gzip member, inflated as far as they are read."""

    def __init__(self, raw):
        self.raw, self.engine, self.todo = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.engine.eof:
            data = self.todo or self.raw.read(1 << 16)
            if not data:
                raise ValueError("end of file inside a gzip member")
            got = self.engine.decompress(data, len(into))
            self.todo = self.engine.unconsumed_tail
            if got:
                into[: len(got)] = got
                return len(got)
        return 0


def _records_of(stream, seeks: bool, wanted, need_payload: bool, single: bool = False):
    """(fields, payload, payload length, bytes before the record) of the records of a stream that ``wanted`` accepts."""
    at = 0

    def skip(n: int) -> None:
        if seeks:
            stream.seek(n, io.SEEK_CUR)
            return
        while n > 0:
            got = len(stream.read(min(n, 1 << 16)))
            if not got:
                raise ValueError("end of file inside a record")
            n -= got

    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():  # between records
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        lines, size, _ = _header_lines(stream)
        fields = _fields(lines)
        lower = {k.lower(): v for k, v in fields.items()}
        left = int(lower["content-length"])
        at += size + left
        if wanted(lower):
            yield fields, *_payload(stream, lower, left, need_payload, skip), start
        else:
            skip(left)
        if single:
            return


def _payload(stream, fields: dict, left: int, needed: bool, skip) -> tuple[bytes | None, int | None]:
    """(payload, its length) of a record's block of ``left`` bytes; HTTP headers of the block are no payload."""
    head, told, revisit = b"", None, fields.get("warc-type") == "revisit"
    if fields.get("content-type", "").startswith("application/http"):
        lines, size, ended = _header_lines(stream, left)
        left -= size
        if ended:
            told = {k.lower(): v for k, v in _fields(lines).items()}.get("content-length", "")
        else:  # no HTTP headers after all
            head = b"".join(lines)
    if revisit:
        skip(left)
        return None, int(told) if told and told.isdigit() else None
    length = len(head) + left
    if not needed:
        skip(left)
        return None, length
    payload = head + stream.read(left)
    if len(payload) < length:
        raise ValueError("end of file inside a payload")
    return payload, length


def read_records(path: str, wanted=lambda fields: True, need_payload: bool = True, records: tuple[int, int] | None = None):
    """(fields, payload, payload length, offset) of the accepted records of a file. ``records``: an ordinal range, for
    files with an index. For plain files and files with a gzip member a record the offset is that of the record, for others
    that of the member."""
    fs, name = open_fs(path)
    with fs.open_input_file(name) as f:
        raw = io.BufferedReader(f, 1 << 16)
        packed = raw.peek(2)[:2] == b"\x1f\x8b"
        if records is not None:
            with fs.open_input_file(f"{name}.idx") as index:
                index.seek(8 * records[0])
                starts = np.frombuffer(index.read(8 * (records[1] - records[0])), "<u8").tolist()
            for start in starts:
                raw.seek(start)
                stream = io.BufferedReader(_Inflate(raw)) if packed else raw
                yield from ((*r[:3], start) for r in _records_of(stream, not packed, wanted, need_payload, single=True))
        elif not packed:
            yield from _records_of(raw, True, wanted, need_payload)
        else:
            at = 0
            while raw.peek(1):
                member = _Inflate(raw)
                yield from ((*r[:3], at) for r in _records_of(io.BufferedReader(member), False, wanted, need_payload))
                at = raw.tell() - len(member.engine.unused_data)  # the next member starts after what this one used
                raw.seek(at)


# --- reader ---------------------------------------------------------------------------------------------------------


@dataclass
class Files(D.InputPartition):
    """Files of a partition: (path, first record, end record), both None for a whole file."""

    parts: list[tuple[str, int | None, int | None]]


def test_of(f: D.Filter):
    """A pushed filter as (header field, test), or None if it cannot be told from the headers."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in FIELDS:
        return None
    v = getattr(f, "value", None)
    tests = {
        D.EqualTo: lambda x: x is not None and x == v, D.EqualNullSafe: lambda x: x == v, D.In: lambda x: x is not None and x in v,
        D.IsNull: lambda x: x is None, D.IsNotNull: lambda x: x is not None,
        D.StringStartsWith: lambda x: x is not None and x.startswith(v), D.StringEndsWith: lambda x: x is not None and x.endswith(v),
        D.StringContains: lambda x: x is not None and v in x,
        D.GreaterThan: lambda x: x is not None and x > v, D.GreaterThanOrEqual: lambda x: x is not None and x >= v,
        D.LessThan: lambda x: x is not None and x < v, D.LessThanOrEqual: lambda x: x is not None and x <= v,
    }
    test = tests.get(type(f))
    return test and (FIELDS[column].lower(), test)


class WarcReader(D.DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.columns = options["path"], schema.names
        self.split_bytes, self.min_partitions = int(options.get("splitBytes", SPLIT_BYTES)), int(options.get("minPartitions", 1))
        self.filters: list[D.Filter] = []
        if options.get("recordTypes"):
            self.filters.append(D.In(("record_type",), tuple(options["recordTypes"].split(","))))
        if options.get("uriPrefix"):
            self.filters.append(D.StringStartsWith(("target_uri",), options["uriPrefix"]))
        if unknown := set(self.columns) - set(_ARROW):
            raise ValueError(f"no such columns in a WARC record: {sorted(unknown)}")

    def partitions(self):
        fs, base = open_fs(self.path)
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        root = re.sub(r"/+$", "", self.path)
        if info.type == pafs.FileType.File:
            units = [(info.size, self.path, None)]
        else:
            found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
            names = [x for x in found if x.type == pafs.FileType.File]
            manifests = [x for x in names if re.search(r"/_manifest-[^/]*\.json$", x.path)]
            if manifests:
                units = []
                for m in manifests:
                    with fs.open_input_file(m.path) as f:
                        units += [(x["bytes"], f"{root}/{x['name']}", x["records"]) for x in json.loads(f.read())["files"]]
            else:
                units = [(x.size, root + x.path[len(base.rstrip("/")) :], None) for x in names if re.search(r"\.warc(\.gz)?$", x.path)]
        share = -(-sum(u[0] for u in units) // self.min_partitions)
        split = min(self.split_bytes, max(LEAST_SPLIT_BYTES, share))
        out, small, room = [], [], split
        for size, path, records in sorted(units, key=lambda u: (-u[0], u[1])):
            if records and size > split:
                cuts = np.linspace(0, records, min(records, -(-size // split)) + 1).astype(int).tolist()
                out += [Files([(path, a, b)]) for a, b in zip(cuts, cuts[1:]) if a < b]
            else:
                if small and room < size:
                    out.append(Files(small))
                    small, room = [], split
                small.append((path, 0, records) if records is not None else (path, None, None))
                room -= size
        return out + ([Files(small)] if small else []) or [Files([])]

    def read(self, partition: Files):
        tests = [test_of(f) for f in self.filters]
        wanted = lambda fields: all(test(fields.get(name)) for name, test in tests)
        rows, size = [], 0
        for path, first, end in partition.parts:
            records = None if first is None else (first, end)
            try:
                for fields, payload, length, at in read_records(path, wanted, "payload" in self.columns, records):
                    rows.append(self._row(fields, payload, length, path, at))
                    size += 512 + len(payload or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield self._batch(rows)
                        rows, size = [], 0
            except (ValueError, KeyError, zlib.error) as e:
                raise ValueError(f"{path}: {e}") from e
        if rows:
            yield self._batch(rows)

    def _row(self, fields, payload, length, path, at) -> dict:
        row = {"payload": payload, "payload_bytes": length, "file": path, "at": at}
        row |= {_COLUMN_OF[k.lower()]: v for k, v in fields.items() if k.lower() in _COLUMN_OF}
        row["headers"] = [(k, v) for k, v in fields.items() if k.lower() not in _COLUMN_OF]
        return row

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([r.get(c) for r in rows], _ARROW[c]) for c in self.columns]
        return pa.RecordBatch.from_arrays(arrays, names=self.columns)


class PushdownWarcReader(WarcReader):
    """The reader of sessions with filter pushdown (Spark refuses a reader that takes filters where it is off)."""

    def pushFilters(self, filters):
        for f in filters:
            if test_of(f):
                self.filters.append(f)
            else:
                yield f


# --- writer ---------------------------------------------------------------------------------------------------------


def named(headers: list[tuple[str, str | None]]) -> dict[str, str | None]:
    """More header fields of a record, by name; the names are checked, and the length is always that of the record."""
    if bad := [k for k, _ in headers if not re.fullmatch(r"[!-9;-~]+", k)]:
        raise ValueError(f"no names of header fields: {bad}")
    return {k: v for k, v in headers if k.lower() != "content-length"}


@dataclass
class Written(D.WriterCommitMessage):
    files: list[dict]


class _Archive:
    """Files of one task, rolled at a size; each gets an index of its record offsets."""

    def __init__(self, fs, base: str, packed: bool, max_bytes: int, date: str):
        self.fs, self.base, self.packed, self.max_bytes, self.date = fs, base, packed, max_bytes, date
        self.task, self.files, self.out = uuid.uuid4().hex, [], None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{self.task}-{len(self.files):05d}.warc{'.gz' if self.packed else ''}"
            self.out, self.offsets, self.at = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None), [], 0
            info = b"software: tiergate\r\nformat: WARC File Format 1.1\r\n"
            fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": self.date, "Content-Type": "application/warc-fields"}
            self._put(encode_record(fields, info, len(info)))
        self._put(record)
        if self.at >= self.max_bytes:
            self.close()

    def _put(self, record: bytes) -> None:
        if self.packed:
            engine = zlib.compressobj(1, zlib.DEFLATED, 31)
            record = engine.compress(record) + engine.flush()
        self.offsets.append(self.at)
        self.out.write(record)
        self.at += len(record)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            with self.fs.open_output_stream(f"{self.base}/{self.name}.idx", compression=None) as index:
                index.write(np.array(self.offsets, "<u8").tobytes())
            self.files.append({"name": self.name, "bytes": self.at, "records": len(self.offsets)})
            self.out = None


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], schema.names, overwrite
        self.packed = options.get("compression", "gzip") != "none"
        self.max_bytes = int(options.get("maxFileBytes", MAX_FILE_BYTES))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        if missing := {"record_type", "record_id", "payload"} - set(self.columns):
            raise ValueError(f"a WARC record needs {sorted(missing)}")

    def write(self, iterator) -> Written:
        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        archive = _Archive(fs, base, self.packed, self.max_bytes, self.date)
        for batch in iterator:
            for row in batch.to_pylist():
                fields = {name: row.get(c) for c, name in FIELDS.items()}
                fields["WARC-Date"] = fields["WARC-Date"] or self.date
                if fields["WARC-Type"] == "revisit":
                    fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                fields |= named(row.get("headers") or [])
                payload = row["payload"]
                length = row.get("payload_bytes")
                archive.add(encode_record(fields, payload, len(payload or b"") if length is None else length))
        archive.close()
        return Written(archive.files)

    def commit(self, messages) -> None:
        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        old = [x.path for x in fs.get_file_info(pafs.FileSelector(base)) if re.search(r"/_manifest-[^/]*\.json$", x.path)]
        files = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps({"files": files}).encode())
        for path in old if self.overwrite else []:
            fs.delete_file(path)

    def abort(self, messages) -> None:
        fs, base = open_fs(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            for name in (f["name"], f"{f['name']}.idx"):
                fs.delete_file(f"{base}/{name}")


class WarcSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return (PushdownWarcReader if self.options.get("pushdown") == "true" else WarcReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


def register_warc(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to a session."""
    spark.dataSource.register(WarcSource)
