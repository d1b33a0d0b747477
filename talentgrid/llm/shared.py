"""Helpers of the operators: input columns, checkpoints and written tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.session import ensure_checkpoints, new_path

#: ASCII white space as a pattern of Java, RE2 and Python
BLANKS = r"[\x20\x09-\x0D]+"
SCREEN_BITS = 1 << 25  #: places of a bitmap: 4 MB
PORTION = 1 << 20  #: bytes of the texts that a task has as Python strings at once


def picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as ``id`` and ``text``; a null text is the empty text.

    Other columns are left out first, so their names cannot clash with those of an operator.
    """
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def portions(batches: Iterable[pa.RecordBatch], most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices whose ``text`` has at most ``most`` bytes, or one row.

    A batch of Spark's has a number of rows, so its texts may be of any size.
    """
    for given in batches:
        ends = np.cumsum(pc.binary_length(given.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < given.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield given.slice(at, end - at)
            at = end


def blanks_joined(text: Column) -> Column:
    """The text with every run of ASCII white space replaced by one space."""
    return F.regexp_replace(text, BLANKS, " ")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; computed once, survives lost executors."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read back; for rows with long values."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SCREEN_BITS))


def marks(keys: DataFrame) -> DataFrame:
    """Bitmap of the places of all rows of ``keys``: (bucket, bits), ``SCREEN_BITS / 8`` bytes at most."""
    place = _place(*keys.columns)
    return keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )


def with_marks(rows: DataFrame, bitmap: DataFrame, *keys: str) -> DataFrame:
    """``rows`` and ``marked``: whether the bitmap has a mark at the place of ``keys``."""
    rows = rows.withColumn("place", _place(*keys))
    rows = rows.withColumn("bucket", F.bitmap_bucket_number("place"))
    rows = rows.withColumn("spot", F.bitmap_bit_position("place"))
    marked = F.expr("shiftright(cast(conv(hex(substring(bits, cast(spot div 8 as int) + 1, 1)), 16, 10)"
                    " as int), cast(spot % 8 as int)) & 1 = 1")
    return rows.join(F.broadcast(bitmap), "bucket", "left").withColumn(
        "marked", F.coalesce(marked, F.lit(False))).drop("bucket", "bits", "spot", "place")
