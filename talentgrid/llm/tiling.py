"""Benchmark decontamination by greedy string tiling of words.

Documents and benchmark items are words (runs of letters and digits, lower-cased). A document joins the
items with which it shares a seed of ``MIN_MATCH`` words. For such a pair the longest common word runs that
do not overlap are marked, again and again, by running Karp-Rabin with shrinking search lengths; the share
of the item's words that got marked is its coverage. Order does not count, so passages whose parts were
reordered are caught, as far as the parts have ``MIN_MATCH`` words.

The benchmark is the query set: it goes to the tasks in blocks of bounded size, one pass over the documents
for each block, and each document is worked on where it is read. No document text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.shared import picked

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_BYTES = 8 << 20  #: benchmark text that one pass holds
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MATCHES = "item_words long, matched_words long, tiles long, coverage double"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Rolling:
    """Karp-Rabin hashes of all windows of any length, in 64-bit arithmetic that wraps round."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        unpower = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
        # prefix[k] = sum of ids[i] * base**-i, so a window is moved to a common place by one product
        self.prefix = np.concatenate([[np.uint64(0)], np.add.accumulate(ids.astype(np.uint64) * unpower[:n])])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:-length]) * self.power[:n] if n > 0 else np.zeros(0, np.uint64)


def tile(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, words) of greedy string tiling; longer ones first."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    hashes_i, hashes_t = _Rolling(item), _Rolling(text)
    tiles, length = [], max(least, len(item))
    while True:
        found = _matches(item, text, free_i, free_t, hashes_i, hashes_t, length)
        marked = False
        for n, i, t in found:
            if n < found[0][0]:
                break  # what is left of longer matches comes first
            if free_i[i:i + n].all() and free_t[t:t + n].all():
                free_i[i:i + n] = free_t[t:t + n] = False
                tiles.append((int(i), int(t), int(n)))
                marked = True
        if not marked and length == least:
            return tiles
        if not marked:
            length = max(least, length // 2)


def _matches(item, text, free_i, free_t, hashes_i, hashes_t, length: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches of at least ``length`` words, longest first."""
    if length > min(len(item), len(text)):
        return []
    starts_i, starts_t = _free_windows(free_i, length), _free_windows(free_t, length)
    if not len(starts_i) or not len(starts_t):
        return []
    hash_i, hash_t = hashes_i.windows(length)[starts_i], hashes_t.windows(length)[starts_t]
    order = np.argsort(hash_i, kind="stable")
    hash_i, starts_i = hash_i[order], starts_i[order]
    low, high = np.searchsorted(hash_i, hash_t, "left"), np.searchsorted(hash_i, hash_t, "right")
    many = high - low
    t = np.repeat(starts_t, many)
    i = starts_i[np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(t))]
    # a match that can be begun a word earlier is part of that longer one
    earlier = (i > 0) & (t > 0)
    earlier[earlier] = (item[i[earlier] - 1] == text[t[earlier] - 1]) & free_i[i[earlier] - 1] & free_t[t[earlier] - 1]
    i, t = i[~earlier], t[~earlier]
    size, alive = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(alive):
        a, b = i[alive] + size[alive], t[alive] + size[alive]
        inside = (a < len(item)) & (b < len(text))
        alive, a, b = alive[inside], a[inside], b[inside]
        alive = alive[(item[a] == text[b]) & free_i[a] & free_t[b]]
        size[alive] += 1
    real = size >= length  # equal hashes of other words end here
    order = np.lexsort((t[real], i[real], -size[real]))
    return list(zip(size[real][order], i[real][order], t[real][order], strict=True))


def _free_windows(free: np.ndarray, length: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(total[length:] - total[:-length] == length)


@dataclass
class Block:
    """Items of one block: their words as numbers, and the seeds that occur in them, sorted by hash."""

    items: list
    ids: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        """Of (item id, text) rows. An item of fewer than ``MIN_MATCH`` words is its own seed; items without
        words match nothing."""
        vocabulary: dict[str, int] = {}
        ids = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)], np.int64) for _, t in rows]
        seeds = {}
        for n in sorted({min(len(x), MIN_MATCH) for x in ids if len(x)}):
            with_n = [k for k, x in enumerate(ids) if min(len(x), MIN_MATCH) == n]
            hashes = [_Rolling(ids[k]).windows(n) for k in with_n]
            item = np.repeat(with_n, [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            seeds[n] = (flat[order], item[order], place[order])
        return cls([r[0] for r in rows], ids, vocabulary, seeds)

    def search(self, text: str | None, coverage: float) -> list[tuple]:
        """(item id, item words, matched words, tiles, coverage) of the items that the text covers."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        out = []
        for n, (hashes, items, places) in self.seeds.items():
            starts = _free_windows(ids > 0, n) if len(ids) >= n else np.zeros(0, np.int64)
            if not len(starts):
                continue
            windows = _Rolling(ids).windows(n)[starts]
            at = np.minimum(np.searchsorted(hashes, windows), len(hashes) - 1)
            hit = hashes[at] == windows
            if not hit.any():
                continue
            met = np.unique(windows[hit])
            low, high = np.searchsorted(hashes, met, "left"), np.searchsorted(hashes, met, "right")
            which = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
            # words near a seed of the block; the others cannot be in a tile
            near = np.zeros(len(ids), bool)
            for k in range(n):
                near[starts[hit] + k] = True
            kept = np.where(near, ids, 0)[near | np.concatenate([[False], near[:-1]])]
            for k in np.unique(items[which]):
                item, reach = self.ids[k], np.zeros(len(self.ids[k]), bool)
                for p in places[which][items[which] == k]:
                    reach[p:p + n] = True
                if reach.sum() < coverage * len(item):
                    continue
                tiles = tile(item, kept, n)
                matched = sum(x[2] for x in tiles)
                if matched >= coverage * len(item):
                    out.append((self.items[k], len(item), matched, len(tiles), matched / len(item)))
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes`` of text; rows that repeat count once."""
    rows = picked(benchmark, id_col, text_col).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // block_bytes
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        got = sorted(((r.id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r))
        if got:
            yield Block.of(got)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item that it covers to at least ``coverage``: ``id``, ``item_id``,
    ``item_words``, ``matched_words``, ``tiles``, ``coverage``. Clean documents have no row.

    Whole texts; a null or empty text, and an item without words, match nothing. Repeated documents and null
    ids give rows of their own. Empty tables give no rows.
    """
    rows = picked(docs, id_col, text_col)
    item_kind = benchmark.schema["item_id"].dataType if "item_id" in benchmark.columns else benchmark.schema[0].dataType
    kind, context = rows.schema["id"].dataType, docs.sparkSession.sparkContext
    schema = f"id {kind.simpleString()}, item_id {item_kind.simpleString()}, {MATCHES}"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        shared = context.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(key, *m) for key, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True)
                         for m in shared.value.search(text.as_py(), coverage)]
                if found:
                    kinds = [b.column("id").type, None, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)],
                        ["id", "item_id", "item_words", "matched_words", "tiles", "coverage"])

        out = out.unionByName(rows.mapInArrow(search, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                      coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, with all columns, that cover no item."""
    place, context = docs.columns.index(text_col), docs.sparkSession.sparkContext
    for block in blocks(benchmark):
        shared = context.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.search(t.as_py(), coverage) for t in b.column(place)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
