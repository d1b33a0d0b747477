"""Bounded-space online packing of token ids into sequences of one length.

A document is cut into whole sequences and one rest. Each partition keeps a fixed number of open windows;
a rest goes to the window that it fills best, and when none has room the fullest is closed. What is open
at the end of a partition is written with its ids; these leftovers are merged into full sequences by tasks
of bounded size. A task holds ``open_windows`` windows at any input size; no text or id is shuffled but
those of leftovers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.encoding import encoder
from talentgrid.llm.shared import picked, portions, settled

SEQUENCE = 4096
OPEN_WINDOWS = 64
MERGED_WINDOWS = 512  #: leftover windows that one merging task takes: 8 MB of ids
_FIELDS = [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
           ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
PIECES = ("id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_BATCH = 20_000


def _batch(rows: list[tuple], ids: list[bytes | None] | None = None) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FIELDS)]
    names = [name for name, _ in _FIELDS]
    if ids is not None:
        columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names)


def _piece(key, start: int, ids: bytes, total: int, sequence: int, offset: int) -> tuple:
    return key, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset


class _Windows:
    """Open windows of one partition: each a list of (key, start, ids, total) and the ids it holds."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[tuple[int, list]] = []

    def place(self, piece: tuple) -> list | None:
        """Put the piece in the window with the least room for it; returns a window that was closed."""
        length, closed = len(piece[2]) // 4, None
        best = max((i for i, (used, _) in enumerate(self.open) if used + length <= self.size),
                   key=lambda i: self.open[i][0], default=None)
        if best is not None:
            used, pieces = self.open[best]
            pieces.append(piece)
            if used + length == self.size:
                return self.open.pop(best)[1]
            self.open[best] = (used + length, pieces)
            return None
        if len(self.open) >= self.most:
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            closed = self.open.pop(fullest)[1]
        self.open.append((length, [piece]))
        return closed


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, end: bytes, size: int,
          most: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer).encode_all
    windows, sequence = _Windows(size, most), TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    for given in portions(batches):
        for key, ids in zip(given.column("id").to_pylist(), encode(given.column("text").to_pylist()), strict=True):
            ids += end
            total = len(ids) // 4
            whole = total - total % size
            for start in range(0, whole, size):
                rows.append(_piece(key, start, ids[4 * start:4 * (start + size)], total, sequence, 0))
                sequence += 1
            if whole < total:
                closed = windows.place((key, whole, ids[4 * whole:], total))
                if closed is not None:
                    rows.extend(_in_order(closed, sequence))
                    sequence += 1
            if len(rows) >= _BATCH:
                yield _batch(rows, [None] * len(rows))
                rows = []
    if rows:
        yield _batch(rows, [None] * len(rows))
    for _, pieces in windows.open:
        yield _batch(_in_order(pieces, sequence), [p[2] for p in pieces])
        sequence += 1


def _in_order(pieces: list[tuple], sequence: int) -> list[tuple]:
    out, offset = [], 0
    for key, start, ids, total in pieces:
        out.append(_piece(key, start, ids, total, sequence, offset))
        offset += len(ids) // 4
    return out


def _merge(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Leftovers end to end, cut where a sequence is full; the last is cut at powers of two."""
    sequence, pieces, used = (1 << 62) | (TaskContext.get().partitionId() << 32), [], 0
    for given in batches:
        rows: list[tuple] = []
        for r in given.to_pylist():
            start, ids = r["start"], r["ids"]
            while used + len(ids) // 4 >= size:
                take = 4 * (size - used)
                pieces.append((r["id"], start, ids[:take], r["doc_tokens"]))
                rows.extend(_in_order(pieces, sequence))
                sequence, pieces, used = sequence + 1, [], 0
                start, ids = start + take // 4, ids[take:]
            if ids:
                pieces.append((r["id"], start, ids, r["doc_tokens"]))
                used += len(ids) // 4
        if rows:
            yield _batch(rows)
    rows = []
    while used:
        room = 1 << (used.bit_length() - 1)
        used -= room
        part: list[tuple] = []
        while room:
            key, start, ids, total = pieces.pop(0)
            part.append((key, start, ids[:4 * room], total))
            if len(ids) > 4 * room:
                pieces.insert(0, (key, start + room, ids[4 * room:], total))
            room -= len(part[-1][2]) // 4
        rows.extend(_in_order(part, sequence))
        sequence += 1
    if rows:
        yield _batch(rows)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
         sequence: int = SEQUENCE, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: ``id``, ``start`` (ids of its document before it), ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id`` and ``offset`` in that sequence.

    A document is its whole text's ids and ``end_id``; a null or empty text is that one id. Sequences hold
    at most ``sequence`` ids; only closed windows are short, and the end of each merging task is cut at
    powers of two, which need no padding. Repeated ids and null ids are packed as rows of their own. No rows
    give no pieces.
    """
    end = np.array([end_id], "<u4").tobytes()
    rows = picked(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    packed = settled(rows.mapInArrow(
        lambda it: _pack(it, tokenizer, end, sequence, open_windows), f"{PIECES}, ids binary"), "packed")
    left = packed.where("ids is not null")
    tasks = 1 + left.where("offset = 0").count() // MERGED_WINDOWS
    merged = left.repartition(tasks).mapInArrow(lambda it: _merge(it, sequence), PIECES)
    return packed.where("ids is null").drop("ids").unionByName(merged)
