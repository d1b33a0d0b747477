"""Vectors in ``.npy`` and ``.npz`` files as a data source that splits a file into row ranges.

The header of an array gives its type, its shape and where its rows begin; a partition is a range of rows and reads
only their bytes. A stored member of an ``.npz`` archive is split in the same way; a compressed one can only be read
from its start, so it is one partition, read in chunks.

Options of the format ``vectors``: ``path`` (a file or a folder), ``vector`` and ``key`` (names of the members of an
archive; a ``.npy`` file is its vectors), ``rows`` (rows of a partition). Columns: ``file``, ``row`` (0-based in its
file), ``key`` where that option is given, ``vector``.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 65_536
_CHUNK = 4_096  #: rows of a record batch


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), os.path.abspath(path)


@dataclass(frozen=True)
class _Array:
    """Where the rows of an array stand; ``member`` is set where they are compressed."""

    dtype: str
    shape: tuple[int, ...]
    begin: int
    member: str | None = None

    @property
    def width(self) -> int:
        return self.shape[1] if len(self.shape) == 2 else 1


def _header(f) -> tuple[str, tuple[int, ...]]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if dtype.hasobject or len(shape) not in (1, 2) or (fortran and len(shape) == 2):
        raise ValueError(f"not an array of rows: {dtype}, shape {shape}, columns first {fortran}")
    return dtype.str, shape


def _arrays(f, name: str, members: list[str]) -> list[_Array]:
    """The arrays with these member names; of a ``.npy`` file its only one."""
    if not name.endswith(".npz"):
        if len(members) != 1:
            raise ValueError(f"{name} has vectors only, no keys")
        return [_Array(*_header(f), f.tell())]
    found = []
    with zipfile.ZipFile(f) as archive:
        for member in members:
            info = archive.getinfo(f"{member}.npy")
            with archive.open(info) as content:
                dtype, shape = _header(content)
                length = content.tell()
            if info.compress_type != zipfile.ZIP_STORED:
                found.append(_Array(dtype, shape, length, f"{member}.npy"))
                continue
            f.seek(info.header_offset + 26)  # lengths of the local name and extra field stand here
            local = np.frombuffer(f.read(4), "<u2")
            found.append(_Array(dtype, shape, info.header_offset + 30 + int(local.sum()) + length))
    if len({a.shape[0] for a in found}) > 1:
        raise ValueError(f"{name}: keys and vectors differ in number")
    return found


def _column(values: np.ndarray, listed: bool) -> pa.Array:
    if values.dtype.kind == "U":
        return pa.array(values.tolist(), pa.string())
    kind = np.int64 if values.dtype.kind in "iub" else np.float32 if values.dtype.itemsize <= 4 else np.float64
    if not listed:
        return pa.array(values.astype(kind))
    wide = values.reshape(len(values), -1).astype(np.float64 if kind is np.int64 else kind)
    offsets = np.arange(len(wide) + 1, dtype=np.int32) * wide.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(wide.ravel()))


def _spark_type(array: _Array, listed: bool) -> T.DataType:
    arrow = _column(np.zeros((1, array.width) if listed else 1, np.dtype(array.dtype)), listed).type
    simple = {pa.string(): T.StringType(), pa.int64(): T.LongType(), pa.float32(): T.FloatType(), pa.float64(): T.DoubleType()}
    return T.ArrayType(simple[arrow.value_type]) if listed else simple[arrow]


@dataclass
class _Rows(InputPartition):
    path: str
    first: int
    count: int
    arrays: tuple[_Array, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, members: list[str], rows: int):
        self.path, self.members, self.rows = path, members, rows

    def files(self) -> list[str]:
        store, root = _store(self.path)
        if store.get_file_info(root).type == pa.fs.FileType.File:
            return [root]
        listed = store.get_file_info(pa.fs.FileSelector(root, recursive=True))
        return sorted(i.path for i in listed if i.type == pa.fs.FileType.File and i.path.endswith((".npy", ".npz")))

    def headers(self) -> Iterator[tuple[str, list[_Array]]]:
        store, _ = _store(self.path)
        for name in self.files():
            with store.open_input_file(name) as f:
                yield name, _arrays(f, name, self.members)

    def partitions(self) -> list[InputPartition]:
        out = []
        for name, arrays in self.headers():
            total = arrays[0].shape[0]
            step = max(total, 1) if any(a.member for a in arrays) else self.rows
            out.extend(_Rows(name, at, min(step, total - at), tuple(arrays)) for at in range(0, total, step))
        return out

    def read(self, partition: _Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # files without rows are planned as one task with nothing to read
            return
        store, _ = _store(self.path)
        files = [store.open_input_file(partition.path) for _ in partition.arrays]
        try:
            streams = []
            for f, a in zip(files, partition.arrays, strict=True):
                row = np.dtype(a.dtype).itemsize * a.width
                if a.member:
                    f = zipfile.ZipFile(f).open(a.member)
                    f.read(a.begin)
                else:
                    f.seek(a.begin + partition.first * row)
                streams.append((f, a, row))
            for at in range(0, partition.count, _CHUNK):
                n = min(_CHUNK, partition.count - at)
                read = []
                for f, a, row in streams:
                    raw = f.read(n * row)
                    if len(raw) != n * row:
                        raise ValueError(f"{partition.path} ends within its rows")
                    read.append(np.frombuffer(raw, a.dtype).reshape(n, a.width))
                columns = [pa.array([partition.path] * n), pa.array(np.arange(n, dtype=np.int64) + partition.first + at),
                           *(_column(v[:, 0], False) for v in read[1:]), _column(read[0], True)]
                names = ["file", "row", *(["key"] if len(read) == 2 else []), "vector"]
                yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            for f in files:
                f.close()


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def _reader(self) -> _Reader:
        key = self.options.get("key")
        members = [self.options.get("vector", "vectors"), *([key] if key else [])]
        rows = int(self.options.get("rows", ROWS))
        if rows < 1:
            raise ValueError("rows must be at least 1")
        return _Reader(self.options["path"], members, rows)

    def schema(self) -> T.StructType:
        reader = self._reader()
        _, arrays = next(reader.headers(), (None, None))
        if arrays is None:
            raise ValueError(f"no .npy or .npz file in {self.options['path']}")
        out = T.StructType().add("file", T.StringType()).add("row", T.LongType())
        if len(arrays) == 2:
            out = out.add("key", _spark_type(arrays[1], False))
        return out.add("vector", _spark_type(arrays[0], True))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return self._reader()


def read_vectors(spark: SparkSession, path: str, vector: str = "vectors", key: str | None = None, rows: int = ROWS) -> DataFrame:
    """Rows of ``.npy`` or ``.npz`` files; files of one path have one type. Arrays of objects are refused."""
    spark.dataSource.register(VectorFiles)
    options = {"vector": vector, "rows": str(rows), **({"key": key} if key else {})}
    return spark.read.format("vectors").options(**options).load(path)


def write_vectors(df: DataFrame, key: str, vector: str, path: str, rows: int = ROWS) -> int:
    """Keys and vectors as ``.npz`` files of at most ``rows`` rows; returns the number of files.

    Vectors have one length and, like the keys, no nulls. A task that runs again writes the same names anew."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        part, number, held = TaskContext.get().partitionId(), 0, []
        for b in batches:
            for at in range(0, b.num_rows, rows):
                held.append(b.slice(at, rows))
                if sum(x.num_rows for x in held) >= rows:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    save(store, f"{root}/part-{part:05d}-{number:05d}.npz", whole.slice(0, rows))
                    number, held = number + 1, whole.slice(rows).to_batches()
        if sum(x.num_rows for x in held):
            save(store, f"{root}/part-{part:05d}-{number:05d}.npz", pa.Table.from_batches(held))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], ["files"])

    def save(store: pa.fs.FileSystem, name: str, table: pa.Table) -> None:
        keys, lists = table.column(0).combine_chunks(), table.column(1).combine_chunks()
        if keys.null_count or lists.null_count:
            raise ValueError("keys and vectors must not be null")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ids = np.array(keys.to_pylist(), dtype=str) if pa.types.is_string(keys.type) else keys.to_numpy(zero_copy_only=False)
        with store.open_output_stream(name) as f:
            np.savez(f, ids=ids, vectors=flat.reshape(len(ids), -1))

    counts = df.select(key, vector).mapInArrow(write, "files long")
    return counts.groupBy().sum("files").first()[0] or 0
