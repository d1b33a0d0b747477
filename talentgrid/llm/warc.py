"""WARC archives as a Python data source, and revisit records for equal payloads.

``register(spark)``, then ``spark.read.format("warc").load(folder)`` and
``df.write.format("warc").mode("append").save(folder)``.

Reading: each file is planned by its size, small files share a partition. Filters on ``record_type`` and on
the header columns are pushed to the reader; options ``record_type`` and ``target_prefix`` do the same. Of each record the header block is
parsed first. If a filter rejects it, or the requested schema has no ``payload``, its payload is not decoded:
plain files are skipped by Content-Length, compressed ones by the skip lengths that this writer puts in
each member's header (the optional ``sl`` field of the standard); foreign members without it are inflated.

Writing: one file for each task, compressed record by record. Files get a name of their own attempt and are
listed in a manifest by the driver when all tasks are done; readers of a folder with manifests read only
listed files, so lost or repeated attempts leave nothing behind that counts.

Paths go through ``pyarrow.fs``, so any store that it opens will do; all executors must reach it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = ("record_type string, record_id string, target_uri string, record_key long, refers_to_key long,"
          " payload_digest string, payload_bytes long, content_type string, payload binary")
PARTITION_BYTES = 64 << 20
_ARROW = {"record_key": pa.int64(), "refers_to_key": pa.int64(), "payload_bytes": pa.int64(),
          "payload": pa.binary()}
_BATCH_ROWS, _BATCH_BYTES = 2000, 16 << 20
_HEAD = 4096  #: bytes inflated to look at a record's headers; more follow where they are longer
_MANIFEST = "_manifest-"
_DATE = "2000-01-01T00:00:00Z"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class _Files(InputPartition):
    paths: list[str]


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class WarcSource(DataSource):
    """Short name ``warc``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], [f.name for f in schema.fields], dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"])


class WarcReader(DataSourceReader):
    """Plans files and reads records that pass the pushed filters."""

    def __init__(self, path: str, columns: list[str], options: dict):
        self.path, self.columns = path, columns
        self.equal: dict[str, set] = {}
        self.prefix: dict[str, list[str]] = {}
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        if options.get("record_type"):
            self.equal["record_type"] = set(options["record_type"].split(","))
        if options.get("target_prefix"):
            self.prefix["target_uri"] = [options["target_prefix"]]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("payload", "payload_bytes", "content_type", None):
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.equal[name] = self.equal.get(name, {f.value}) & {f.value}
            elif isinstance(f, In):
                self.equal[name] = self.equal.get(name, set(f.value)) & set(f.value)
            elif isinstance(f, StringStartsWith):
                self.prefix.setdefault(name, []).append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = _open(self.path)
        infos = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file]
        manifests = [x for x in infos if x.base_name.startswith(_MANIFEST)]
        files = [x for x in infos if not x.base_name.startswith(("_", "."))]
        if manifests:
            listed = set()
            for m in manifests:
                with store.open_input_stream(m.path) as f:
                    listed.update(json.loads(f.read()))
            files = [x for x in files if x.base_name in listed]
        out: list[_Files] = []
        size = 0
        for x in sorted(files, key=lambda x: x.path):
            if not out or size + x.size > self.partition_bytes:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for row in self._records(f):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([r.get(c) for r in rows], _ARROW.get(c, pa.string())) for c in self.columns]
        return pa.RecordBatch.from_arrays(arrays, self.columns)

    def _wanted(self, row: dict) -> bool:
        return all(row.get(c) in v for c, v in self.equal.items()) and all(
            (row.get(c) or "").startswith(p) for c, v in self.prefix.items() for p in v)

    def _records(self, f) -> Iterator[dict]:
        end = f.size()
        while f.tell() < end:
            at = f.tell()
            if f.read(2) == b"\x1f\x8b":
                f.seek(at)
                yield from self._member(f, at, end)
            else:
                f.seek(at)
                yield from self._plain(f, at)

    def _plain(self, f, at: int) -> Iterator[dict]:
        head = b""
        while b"\r\n\r\n" not in head:
            more = f.read(_HEAD)
            if not more:
                if head.strip():
                    raise ValueError(f"a record that begins at byte {at} has no end of its headers")
                return
            head += more
        skip = len(head) - len(head.lstrip(b"\r\n"))
        row, length, begin = _headers(head[skip:])
        begin += at + skip
        if self._wanted(row):
            self._block(row, lambda n: _at(f, begin, min(n, length)), length)
            yield row
        f.seek(begin + length + 4)

    def _member(self, f, at: int, end: int) -> Iterator[dict]:
        skip = _skip_length(f, at)
        inflate, parts, whole = zlib.decompressobj(31), [], False

        def upto(n: int | None) -> bytes:
            """Inflate until n bytes are there, or all of the member."""
            nonlocal whole
            have = sum(map(len, parts))
            while not inflate.eof and (n is None or have < n):
                given = inflate.unconsumed_tail or f.read(1 << 16)
                if not given:
                    raise ValueError(f"the member that begins at byte {at} is cut off")
                parts.append(inflate.decompress(given, 0 if n is None else max(_HEAD, n - have)))
                have += len(parts[-1])
            whole = inflate.eof
            parts[:] = [b"".join(parts)]
            return parts[0]

        n = _HEAD
        while b"\r\n\r\n" not in upto(n) and not whole:
            n *= 2
        row, length, begin = _headers(parts[0])
        if self._wanted(row):
            self._block(row, lambda n: upto(begin + min(n, length))[begin:begin + length], length)
            yield row
        if skip:
            f.seek(at + skip)
        else:
            upto(None)
            f.seek(min(end, f.tell() - len(inflate.unused_data)))

    def _block(self, row: dict, read, length: int) -> None:
        """Add what stands in the record's block; ``read(n)`` gives its first n bytes."""
        if not {"payload", "payload_bytes", "content_type"} & {*self.columns}:
            return
        if not (row.get("block_type") or "").startswith("application/http"):
            row["payload_bytes"], row["content_type"] = length, row.get("block_type")
            if "payload" in self.columns:
                row["payload"] = read(length)
            return
        n = _HEAD
        while b"\r\n\r\n" not in (head := read(n)) and n < length:
            n *= 2
        http, _, _ = head.partition(b"\r\n\r\n")
        fields = _fields(http.split(b"\r\n")[1:])
        body = length - len(http) - 4
        row["content_type"] = fields.get("content-type")
        row["payload_bytes"] = int(fields.get("content-length", body)) if row["record_type"] == "revisit" else body
        if "payload" in self.columns and row["record_type"] != "revisit":
            row["payload"] = read(length)[len(http) + 4:]


def _at(f, begin: int, n: int) -> bytes:
    f.seek(begin)
    return f.read(n)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _headers(record: bytes) -> tuple[dict, int, int]:
    """Columns of a record's header block, the length of its block and where that begins."""
    head, _, _ = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    h = _fields(lines[1:])
    number = lambda k: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None
    row = {
        "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"),
        "record_key": number("record-key"), "refers_to_key": number("refers-to-key"),
        "payload_digest": h["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in h else None,
        "block_type": h.get("content-type"),
    }
    return row, number("content-length") or 0, len(head) + 4


def _skip_length(f, at: int) -> int:
    """Bytes of the compressed member at ``at`` by its ``sl`` field; 0 without one. Leaves f at ``at``."""
    head = f.read(24)
    f.seek(at)
    if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
        return struct.unpack("<I", head[16:20])[0]
    return 0


def _compressed(record: bytes) -> bytes:
    """A gzip member with skip lengths: compressed and plain size."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _line(value: str | None) -> str:
    return " ".join((value or "").split())


def record_bytes(row: dict) -> bytes:
    """A response or revisit record of ``record_type``, ``record_key``, ``target_uri``, ``payload`` and
    ``refers_to_key``; a null key or address leaves its header out."""
    payload, key, refers = row["payload"] or b"", row["record_key"], row["refers_to_key"]
    revisit = row["record_type"] == "revisit"
    name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{k}')}>"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {name(key) if key is not None else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    lines += [f"WARC-Target-URI: {_line(row['target_uri'])}"] if row["target_uri"] is not None else []
    lines += [f"Record-Key: {key}"] if key is not None else []
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {name(refers)}", f"Refers-To-Key: {refers}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of ``record_type, record_key, target_uri, payload, refers_to_key``."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _open(self.path)
        name, out = f"records-{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(_compressed(record_bytes({c: batch.column(c)[i].as_py() for c in batch.schema.names})))
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        names = [m.name for m in messages if m is not None and m.name]
        with store.open_output_stream(f"{root}/{_MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/{m.name}")


def with_revisits(pages: DataFrame, key_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0) -> DataFrame:
    """Rows for ``WarcWriter``: of records with equal payloads of at least ``min_bytes`` bytes that with the
    smallest key is the response and the others are revisits of it.

    A null payload is the empty payload. Payloads are equal when their SHA-256 and length are. A null key is
    a revisit wherever a row with a key has its payload; rows that repeat the smallest key are responses all.
    """
    rows = pages.select(
        pages[key_col].cast("long").alias("record_key"), pages[uri_col].alias("target_uri"),
        F.coalesce(pages[payload_col], F.lit("")).cast("binary").alias("payload"),
    )
    keyed = rows.withColumn("n", F.octet_length("payload")).withColumn("sha", F.sha2("payload", 256))
    groups = keyed.where(F.col("n") >= min_bytes).groupBy("n", "sha").agg(
        F.min("record_key").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size")
    joined = keyed.join(groups, ["n", "sha"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("record_key").eqNullSafe(F.col("first"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "record_key", "target_uri",
        "payload", F.when(revisit, F.col("first")).alias("refers_to_key"))


def register(spark: SparkSession) -> None:
    """Make the format known; Spark asks for the setting where a Python source takes filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(records: DataFrame, path: str) -> None:
    """Append records to a folder of archives."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Records of a folder; only ``columns`` are parsed. Options: see the module."""
    register(spark)
    reader = spark.read.format("warc").options(**options)
    if columns:
        kinds = dict(x.strip().split(" ") for x in SCHEMA.split(","))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)
