"""Token ids in Parquet list columns, for selective reads of ids and of metadata.

Layout: one row per document in ascending id order, files split by ranges of the id. ``tokens`` is a list
column, either dictionary-encoded (ids of one vocabulary repeat) or, without a dictionary, with the delta
encodings of format version 2. Row groups and pages have set sizes and pages carry indexes, so a reader
that asks for some ids reads their pages only, and one that asks for metadata reads no token page.

Positions: a row holds the number of ids before it in its own shard (written while the shard streams
through); the totals of the shards, one small row each, give the position in the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentgrid.llm.encoding import encoder
from talentgrid.llm.shared import cut, picked, portions

SCHEMA = "id long, shard int, start_in_shard long, n_tokens long, tokens array<int>"
MOST_BROADCAST = 1_000_000  #: shards whose totals, 24 bytes each, are broadcast; more are joined by a shuffle
BATCH_TOKENS = 1_000_000  #: ids that one record batch holds before it is passed on
_TOKENS = "tokens.list.element"


def list_column(values: list[bytes]) -> pa.Array:
    """Arrow list column of 32-bit ids from their bytes."""
    ends = np.cumsum([0, *(len(v) // 4 for v in values)]).astype(np.int32)
    ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(values))])
    return pa.ListArray.from_arrays(pa.array(ends), ids)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: bytes) -> Iterator[pa.RecordBatch]:
    shard, start = TaskContext.get().partitionId(), 0
    encode = encoder(path).encode_all
    rows: list[tuple[int | None, int, bytes]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        ids = [r[2] for r in rows]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int32()),
            pa.array([r[1] for r in rows], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
            list_column(ids),
        ], ["id", "shard", "start_in_shard", "n_tokens", "tokens"])

    for given in portions(batches):
        for key, ids in zip(given.column("id").to_pylist(), encode(given.column("text").to_pylist()), strict=True):
            ids += end
            rows.append((key, start, ids))
            start, size = start + len(ids) // 4, size + len(ids) // 4
            if size >= BATCH_TOKENS:
                yield batch()
                rows, size = [], 0
    if rows:
        yield batch()


def _range_of(ids: DataFrame, ranges: int) -> Column:
    """The range of ``id``, of about ``ranges`` ranges of equal size; bounds come from the ids alone, so no text is
    read to find them. Null ids are in the first range, equal ids in one. A few bounds are compared with each row:
    the last of each group of bounds, then the group."""
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    found = ids.agg(F.percentile_approx("id", shares, 10 * ranges).alias("b")).first().b or []
    group = int(len(found) ** 0.5) + 1

    def below(bounds: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")

    if not found or ranges < 2:
        return F.lit(0)
    above = F.size(F.filter(below(found[group - 1::group] or [2**63 - 1]), lambda b: b < F.col("id")))
    inside = F.size(F.filter(F.slice(below(found), above * group + 1, F.lit(group)), lambda b: b < F.col("id")))
    return F.when(F.col("id").isNull(), 0).otherwise(above * group + inside)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", encoding: str = "dictionary", row_group_bytes: int = 32 << 20,
                 page_bytes: int = 1 << 20, page_rows: int = 2000) -> None:
    """Encode every whole text, append ``end_id`` and write the files under ``path``.

    ``tokenizer``: a file that all executors have. ``encoding``: ``dictionary`` or ``delta``. A null text is
    the empty text; rows with a null id come first; rows of one id stand in the order of their text's hash;
    no rows give an empty table. Integer ids only.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    end = np.array([end_id], "<u4").tobytes()
    rows = picked(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionById(ranges, _range_of(rows.select("id"), ranges))
    ranged.sortWithinPartitions("id", F.xxhash64("text")).mapInArrow(
        lambda it: _encode(it, tokenizer, end), SCHEMA
    ).write.options(**{
        "compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "PARQUET_2_0",
        f"parquet.enable.dictionary#{_TOKENS}": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": 1 << 20,
    }).parquet(path)


def _starts(files: DataFrame) -> DataFrame:
    """Number of ids before each shard: one row per shard."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``id``, ``start``, ``n_tokens``, ``tokens`` of the documents that meet ``where`` (on ``id`` or
    ``n_tokens``; pushed down to row groups and pages). Selecting no ``tokens`` reads none.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    starts = cut(_starts(files))
    if starts.count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    rows = files if where is None else files.where(where)
    return rows.join(starts, "shard").select(
        "id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "tokens"
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``start`` and ``n_tokens`` of all documents, without reading token pages."""
    return read_tokens(spark, path).drop("tokens")
