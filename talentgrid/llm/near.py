"""Near copies of documents: SimHash groups (operator 2), MinHash bands of five-word shingles with exact Jaccard
verification, components over both.

0. The groups of ``simhash.near_groups`` are links between their different texts.

1. A text gets ``BANDS`` keys of ``ROWS`` minima each over the 64-bit hashes of its shingles. A pair of
   similarity 0.8 shares a key with probability 1 - 3e-6; closer pairs nearly always.
2. Texts that share a key are a bucket; of buckets with the same texts one is kept. Only for their texts the
   shingles are taken again, by a second scan behind a bitmap of fixed size, and move once for each bucket.
3. In a bucket, pairs are verified by exact Jaccard similarity of their sets of shingle hashes and joined
   locally. A bucket of more than ``lines.LARGEST`` texts is dealt to tasks by pairs of its chunks, so a task
   compares at most two chunks at a time and no pair is lost.
4. Distributed components over the links; one document of each component stays.

Equal texts have one hash and are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.components import components
from talentgrid.llm.lines import _buckets
from talentgrid.llm.shared import cut, marks, picked, settled, with_marks
from talentgrid.llm.simhash import near_groups, one_of_each, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
_CHUNK = 1 << 12  #: shingles that meet all hash functions at a time
_RANDOM = np.random.RandomState(20240608)
_ADD = _RANDOM.randint(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None]
_TIMES = _RANDOM.randint(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the different shingles, in order; a text without words has none."""
    return np.unique(np.array(shingle_hashes(text, WORDS), "<u8"))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set; the sets without shingles share theirs."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), _CHUNK):
        least = np.minimum(least, ((shingles[i:i + _CHUNK] ^ _ADD) * _TIMES).min(axis=1))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least ``SIMILARITY``; sets without shingles are equal."""
    small, large = sorted((len(a), len(b)))
    if small < SIMILARITY * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (small + large - both) - 1e-9


def bucket_links(rows: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that join the texts of a bucket as all similar pairs would. A text is compared with the members
    of a group until one is similar, then the group is joined."""
    groups: list[list[int]] = []
    for i, (_, shingles) in enumerate(rows):
        met = [g for g in groups if any(similar(shingles, rows[j][1]) for j in g)]
        if met:
            groups = [g for g in groups if not any(g is m for m in met)]
            groups.append(sorted([i, *(j for g in met for j in g)]))
        else:
            groups.append([i])
    return [(rows[g[0]][0], rows[j][0]) for g in groups for j in g[1:]]


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [band_keys(shingle_set(t.as_py())) for t in b.column("text")]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS),
                                         pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("h"), bands], ["line", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t.as_py()).tobytes() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(sets, pa.binary())], ["line", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, line, shingles) stand by bucket and pair of chunks."""
    current, bucket = None, []

    def found() -> Iterator[pa.RecordBatch]:
        if pairs := bucket_links(bucket):
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        for key, i, j, line, shingles in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (key, i, j) != current:
                yield from found()
                current, bucket = (key, i, j), []
            bucket.append((line, np.frombuffer(shingles, "<u8")))
    yield from found()


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (``a``, ``b``) between hashes of different texts whose components are those of all pairs of
    five-word Jaccard similarity of at least ``SIMILARITY`` that share a band."""
    texts = picked(docs, id_col, text_col).select(F.xxhash64("text").alias("h"), "text")
    rows = texts.mapInArrow(_banded, "line long, bands array<long>")
    rows = rows.select(F.explode("bands").alias("key"), "line").repartition("key").sortWithinPartitions("key", "line")
    buckets = settled(rows.mapInArrow(_buckets, "key long, line long, chunk int"), "near-buckets")
    marked = with_marks(texts.withColumnRenamed("h", "line"), cut(marks(buckets.select("line").distinct())), "line")
    marked = marked.where("marked").select(F.col("line").alias("h"), "text")
    sets = marked.mapInArrow(_sets, "line long, shingles binary").groupBy("line").agg(F.first("shingles").alias("shingles"))
    # near copies share most of their keys: of buckets with the same texts one is verified
    met = buckets.groupBy("key").agg(
        F.bit_xor(F.xxhash64("line")).alias("x"), F.bit_xor(F.xxhash64("line", F.lit(1))).alias("y"),
        F.count("*").alias("size"), F.max("chunk").alias("last"))
    kept = met.groupBy("x", "y", "size").agg(F.min(F.struct("key", "last")).alias("of")).select("of.*")
    dealt = buckets.join(kept, "key").select("key", "chunk", "line", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "line")
    pairs = dealt.join(sets, "line").select("key", "i", "j", "line", "shingles").repartition("key", "i", "j")
    return pairs.sortWithinPartitions("key", "i", "j", "line").mapInArrow(_verified, "a long, b long").distinct()


def simhash_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (``a``, ``b``) of the different texts of each SimHash group to the one with the smallest hash."""
    members = cut(near_groups(docs, id_col, text_col).select("root", "h").distinct())
    least = members.groupBy("root").agg(F.min("h").alias("least"))
    return members.join(least, "root").where("h <> least").select(F.col("least").alias("a"), F.col("h").alias("b"))


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``h`` (a hash of the text) and ``root`` (a hash that names the group) of every row."""
    rows = picked(docs, id_col, text_col).select("id", F.xxhash64("text").alias("h"))
    found = near_links(docs, id_col, text_col).unionByName(simhash_links(docs, id_col, text_col)).distinct()
    roots = components(cut(found)).withColumnRenamed("node", "h")
    return rows.join(roots, "h", "left").select("id", "h", F.coalesce("root", "h").alias("root"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, one of each group, chosen as ``simhash.drop_near`` does.

    Words are those of the fingerprint (runs of other than ASCII white space, A-Z lower-cased); a text of fewer
    than five words is one shingle, and null texts and texts without words are one group.
    """
    return one_of_each(docs, near_copy_groups(docs, id_col, text_col), id_col, text_col)
