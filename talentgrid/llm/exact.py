"""Exact dedup by progressive refinement, with DataFrame functions only.

1. Rows are counted by the length of their normalised text; lengths that occur again are marked.
2. Rows of marked lengths are counted by length and hash of a prefix; pairs that occur again are marked.
3. A second scan reads full contents, and takes their SHA-256, only for rows whose pair is marked.
4. Rows are grouped by length and SHA-256.

No text is shuffled to find the groups: exchanges carry lengths and hashes. Counting is combined before
each shuffle, so a length or a text of a third of all rows is no hot key. Marks are bits of a bitmap of
fixed size at any input size, the only broadcast; marks that fall together only cause more
counting and full hashes, never other results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.shared import blanks_joined, cut, marks, with_marks

PREFIX_CHARS = 256


def _keys(text: Column) -> tuple[Column, Column]:
    return F.length(text), F.xxhash64(F.substring(text, 1, PREFIX_CHARS))


def _screen(texts: DataFrame) -> DataFrame:
    """Marks of the (length, prefix hash) pairs that occur more than once."""
    length, prefix = _keys(F.col("text"))
    keys = cut(texts.select(length.alias("n"), prefix.alias("p")))
    lengths = keys.groupBy("n").count().where("count > 1").select("n")
    met = with_marks(keys, marks(lengths), "n").where("marked")
    return marks(met.groupBy("n", "p").count().where("count > 1").select("n", "p"))


def _hashed(rows: DataFrame, screen: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) and ``n``, ``sha``: the SHA-256 where the screen has a mark, else null."""
    length, prefix = _keys(F.col("text"))
    rows = with_marks(rows.withColumn("n", length).withColumn("p", prefix), screen, "n", "p")
    return rows.withColumn("sha", F.when(F.col("marked"), F.sha2("text", 256))).drop("marked", "p")


def _groups(hashed: DataFrame) -> DataFrame:
    """(n, sha, keep, size) of the texts that occur more than once."""
    return hashed.where("sha is not null").groupBy("n", "sha").agg(
        F.min("id").alias("keep"), F.count("*").alias("size")
    ).where("size > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept`` and the columns of ``carry``.

    Texts are equal when identical after every run of ASCII white space became one space; null counts as
    empty, so all null, empty texts form one group. ``keep_id`` is the smallest id of the group. ``carry``:
    further columns, computed in the second scan from the normalised ``text``. A null id is never the
    smallest unless a group has no other; rows that repeat the kept id are all ``kept`` here
    (``drop_copies`` leaves one). No rows give no rows.
    """
    carry = carry or {}
    texts = docs.select(docs[id_col].alias("id"),
                        blanks_joined(F.coalesce(docs[text_col], F.lit(""))).alias("text"))
    hashed = cut(_hashed(texts, _screen(texts)).select(
        "id", "n", "sha", *[c.alias(k) for k, c in carry.items()]))
    alone = hashed.where("sha is null").withColumns({"keep": F.col("id"), "size": F.lit(1).cast("long")})
    met = hashed.where("sha is not null").join(_groups(hashed), ["n", "sha"], "left")
    return alone.unionByName(met).select(
        "id", F.when(F.coalesce("size", F.lit(1)) > 1, F.col("keep")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | F.col("id").eqNullSafe(F.col("keep"))).alias("kept"), *carry,
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of equal texts: that with the
    smallest id, and of rows that repeat it one. Texts whose pair is not marked never meet a shuffle.
    """
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"),
        blanks_joined(F.coalesce(docs[text_col], F.lit(""))).alias("text"),
    )
    screen = cut(_screen(whole.select("text")))
    hashed = _hashed(whole, screen)
    met = hashed.where("sha is not null")
    by_id = met.groupBy("n", "sha", "id").count()
    first = cut(by_id.groupBy("n", "sha").agg(F.min("id").alias("keep")).join(
        by_id, ["n", "sha"]).where(F.col("id").eqNullSafe(F.col("keep"))).select("n", "sha", "keep", "count"))
    stays = met.drop("text").join(first, ["n", "sha"]).where(F.col("id").eqNullSafe(F.col("keep")))
    one = stays.where("count = 1").select("row")
    tied = stays.where("count > 1").groupBy("n", "sha").agg(F.first("row").alias("row"))
    return hashed.where("sha is null").select("row").unionByName(one).unionByName(
        tied.select("row")).select("row.*")
