"""SimHash near-dedup with BK-trees of shards.

Fingerprints are distinct nodes. Two that differ in at most ``RADIUS`` bits agree in at least one of
``RADIUS + 1`` blocks of bits, so a shard holds the fingerprints that agree in one block, and each goes to
``RADIUS + 1`` shards. A shard of more than ``LARGEST`` fingerprints is cut again by blocks of its free bits,
down to ``LEVELS`` times, when no more than ``2**13`` fingerprints can agree; so no tree outgrows a task, at
any input and any distribution, and no link is lost. A task builds the BK-tree of one shard at a time
(children keyed by their Hamming distance to the parent) and follows only edges within the radius.

Trees are built where the shuffle brings their shard and its queries together. They are not broadcast:
broadcasting all trees would send every fingerprint through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.components import components
from talentgrid.llm.shared import cut, picked

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
LARGEST = 2000
LEVELS = 4
_SLICE = 1 << 16
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = 256 * np.arange(8)


def shingle_hashes(text: str | None, words_in_shingle: int) -> list[int]:
    """XXH64 values (seed 42) of the shingles in order, repeats included.

    Words are runs of other than ASCII white space, A-Z lower-cased; a shingle is ``words_in_shingle`` words
    joined by spaces; fewer words are one shingle; no words, and null, give none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(words_in_shingle, len(words))
    starts = [0, *(ends[:len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], SEED) for i, j in zip(starts, ends[k - 1:].tolist(), strict=True)]


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set where over half the values of ``shingle_hashes`` have it; no words give 0."""
    hashes = shingle_hashes(text, words_in_shingle)
    if not hashes:
        return 0
    ones = np.zeros((8, 8), np.int64)
    for i in range(0, len(hashes), _SLICE):
        octets = np.array(hashes[i:i + _SLICE], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.bincount((octets + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _ONES
    bits = (2 * ones > len(hashes)).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(texts) -> pa.Array:
    return pa.array([_signed(fingerprint(t.as_py())) for t in texts], pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``h`` (a hash of the text) and ``fp`` (signed 64 bits) of every row."""
    rows = picked(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), _fingerprints(b.column("text"))],
                                             ["id", "h", "fp"])

    return rows.mapInArrow(hashed, f"id {rows.schema['id'].dataType.simpleString()}, h long, fp long")


def submasks(mask: int) -> list[int]:
    """``mask`` and, in turn, each of ``RADIUS + 1`` blocks of the bits that it leaves free."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    parts = RADIUS + 1
    return [mask | sum(1 << i for i in free[len(free) * k // parts:len(free) * (k + 1) // parts]) for k in range(parts)]


class BKTree:
    """Values by Hamming distance: children of a node are keyed by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        node, new = 0, len(self.values) - 1
        while node != new:
            node = self.children[node].setdefault((value ^ self.values[node]).bit_count(), new)

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (value ^ self.values[node]).bit_count()
            if distance <= radius:
                found.append(node)
            children = self.children[node]
            if children:
                todo.extend(children[d] for d in range(distance - radius, distance + radius + 1) if d in children)
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the values of a shard as all pairs within the radius would: each value and the first of
    its group. The tree grows value by value, so each pair is met once."""
    tree, first = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while first[i] != i:
            first[i] = i = first[first[i]]
        return i

    for i, v in enumerate(values):
        for j in tree.near(v, radius):
            a, b = top(i), top(j)
            first[max(a, b)] = min(a, b)
        tree.add(v)
    return [(values[top(i)], v) for i, v in enumerate(values) if top(i) != i]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows stand by shard; a shard may go on in the next batch."""
    rest = np.zeros((0, 3), np.int64)

    def of(rows: np.ndarray) -> pa.RecordBatch | None:
        begins = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.zeros(0, int)
        found = [pair for i, j in zip(begins, np.r_[begins[1:], len(rows)], strict=True) if j - i > 1
                 for pair in shard_links([v & (1 << 64) - 1 for v in rows[i:j, 2].tolist()])]
        return pa.RecordBatch.from_arrays([pa.array([_signed(p[k]) for p in found], pa.int64()) for k in (0, 1)],
                                          ["a", "b"]) if found else None

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.concatenate([rest, np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)])
        new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
        upto = int(new[-1]) + 1 if len(new) else 0
        rest = rows[upto:]
        if (out := of(rows[:upto])) is not None:
            yield out
    if (out := of(rest)) is not None:
        yield out


def _split(masks: list[int], mask: Column) -> Column:
    """Array of the submasks of a mask that is one of ``masks``."""
    known = F.create_map(*[x for m in masks for x in (
        F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in submasks(m)]))])
    return known[mask]


def links(fps: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) between distinct fingerprints ``fp`` whose components are those of all pairs that
    differ in at most ``RADIUS`` bits."""
    masks, parts = [0], []
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(LEVELS):
        rows = rows.select("fp", F.explode(_split(masks, F.col("mask"))).alias("mask"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({s for m in masks for s in submasks(m)})
        if level < LEVELS - 1:
            sizes = rows.groupBy("mask", "value").count()
            large = cut(sizes.where(F.col("count") > LARGEST).drop("count"))
            if not large.isEmpty():
                parts.append(rows.join(large, ["mask", "value"], "left_anti"))
                rows = rows.join(large, ["mask", "value"], "left_semi").select("fp", "mask")
                continue
        parts.append(rows)
        break
    shards = parts[0]
    for p in parts[1:]:
        shards = shards.unionByName(p)
    shards = shards.select("mask", "value", "fp").repartition("mask", "value")
    return shards.sortWithinPartitions("mask", "value", "fp").mapInArrow(_links, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``h``, ``fp``, ``root`` (a fingerprint that names the group) and ``component_id`` (smallest id of
    all documents that links reach) of every row.

    Null and empty texts have the fingerprint 0 and link as any other; rows with a null id are members, and
    give a null component only where no member has an id; no rows give no rows.
    """
    hashed = cut(fingerprints(docs, id_col, text_col))
    first = cut(hashed.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(first.select("fp"))).withColumnRenamed("node", "fp")
    named = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = named.join(least, "root").select("fp", "root", "component_id")
    return hashed.join(groups, "fp").select("id", "h", "fp", "root", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, one of each group: that with the smallest id, null ids last, and
    of rows that repeat an id the one with the smallest hash of its text. Of rows that repeat an id and a text
    one stays. The decisions, a few numbers a row, are joined to the rows; texts move only in that join.
    """
    return one_of_each(docs, near_groups(docs, id_col, text_col), id_col, text_col)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``drop_near`` keeps; ``groups``: ``id``, ``h`` and ``root`` of every row."""
    members = cut(groups.groupBy("root", "id", "h").agg(
        F.count("*").alias("rows"))).withColumn("order", F.struct(F.col("id").isNull(), "id", "h"))
    keepers = members.groupBy("root").agg(F.min("order").alias("keep"), F.sum("rows").alias("size"))
    met = members.join(keepers.where("size > 1"), "root")
    decided = cut(met.select("id", "h", (F.col("order") == F.col("keep")).alias("stays"), "rows"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("key"),
                       F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("text_hash"))
    going = decided.where(~F.col("stays") | (F.col("rows") > 1))
    tied = decided.where(F.col("stays") & (F.col("rows") > 1))

    def same(side: DataFrame):
        return rows["key"].eqNullSafe(side["id"]) & (rows["text_hash"] == side["h"])

    kept = rows.join(going, same(going), "left_anti").select("row")
    one = rows.join(tied, same(tied), "left_semi").groupBy("key", "text_hash").agg(F.first("row").alias("row"))
    return kept.unionByName(one.select("row")).select("row.*")
