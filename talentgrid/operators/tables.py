"""Table-level helpers shared by the operators: totals, top-n, ranks and exact indexes that
never put a whole hot group, or the whole table, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentgrid.session import ensure_checkpoints, new_path

BLOCK_ROWS = 512  #: lookup rows that one array holds
HASH_HEX_DIGITS = 3  # 4096 uniform hash buckets per group


def cut_plan(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for results that several branches of a plan read."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def parquet_cut(df: DataFrame, name: str) -> DataFrame:
    """As ``cut_plan``, written compressed; for rows with lists or many repeated values."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join on ``keys`` in which null meets null; the keys appear once."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    cond = None
    for k in keys:
        same = left[k].eqNullSafe(other[f"_same_{k}"])
        cond = same if cond is None else cond & same
    return left.join(other, cond, how).drop(*[f"_same_{k}" for k in keys])


def with_totals(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Attach per-key aggregates by a pre-aggregated join.

    Unlike a window, the aggregation combines map-side and a hot key is not moved into one task;
    AQE broadcasts the totals when their measured size allows it and splits skewed joins otherwise.
    Rows with a null key form a group of their own.
    """
    totals = df.groupBy(*keys).agg(*aggs)
    return join_same(df, totals, keys)


def top_n(df: DataFrame, n: int, *order: Column, by: list[str] | None = None,
          rank: str | None = None) -> DataFrame:
    """First n rows overall or per group. Both forms cut to n rows before the shuffle."""
    if not by:
        top = df.orderBy(*order).limit(n)
        if rank:
            top = top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
        return top
    col = rank or "_rank"
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(col, F.row_number().over(w)).where(F.col(col) <= n)
    return out if rank else out.drop(col)


def best_row(df: DataFrame, by: list[str], order: Column, *cols: str) -> DataFrame:
    """Row with the largest ``order`` struct per group, as a map-side combined aggregate."""
    picked = F.max_by(F.struct(*cols), order).alias("_best")
    return df.groupBy(*by).agg(picked).select(*by, "_best.*")


def seeded_hash(key: Column, seed: int) -> Column:
    """Uniform hex text from a key and a seed; the same in every engine with md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_ranked(df: DataFrame, key: str, seed: int, by: list[str] | None = None,
                rank: str = "rank", size: str = "group_rows") -> DataFrame:
    """Exact 1-based rank of every row in seeded-hash order within its group, and the group size.

    Rows are ranked inside uniform hash buckets; bucket offsets come from counts. A group holding
    a third of all rows is spread over 4096 buckets instead of one sort task.
    """
    by = by or []
    h = df.withColumn("_h", seeded_hash(F.col(key), seed)).withColumn(
        "_b", F.substring("_h", 1, HASH_HEX_DIGITS)
    )
    counts = h.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_b", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias(size),
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_h", key)
    ranked = h.withColumn("_r", F.row_number().over(inside))
    return (
        join_same(ranked, offsets, [*by, "_b"])
        .withColumn(rank, F.col("_before") + F.col("_r"))
        .drop("_h", "_b", "_r", "_before")
    )


def dense_index(df: DataFrame, *order: str, index: str = "idx") -> DataFrame:
    """0-based position of every row in a global sort, without a single-task window.

    Range-partitioned, sorted inside partitions and checkpointed, so that partition contents are
    fixed; offsets come from one count per partition (as many rows as partitions).
    """
    ranged = cut_plan(df.repartitionByRange(*order).sortWithinPartitions(*order))
    shift = F.lit(2).cast("long") * F.lit(1 << 32)
    numbered = ranged.withColumn("_p", F.spark_partition_id()).withColumn(
        "_i", F.monotonically_increasing_id()
    ).withColumn("_i", F.col("_i") - F.col("_p") * shift)
    counts = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    # bounded: one row per shuffle partition
    return (
        numbered.join(F.broadcast(offsets), "_p")
        .withColumn(index, F.col("_i") + F.col("_before"))
        .drop("_p", "_i", "_before")
    )


def spread(df: DataFrame) -> DataFrame:
    """Use every core for heavy per-row work when the input has fewer splits than cores.

    Small files come in one split; large tables already have many and stay as they are.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def in_blocks(df: DataFrame, key: str, *cols: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Column]:
    """A lookup table as few rows of arrays: (block, rows[]), each about ``block_rows`` entries, and the
    number of blocks as a scalar subquery, so that planning starts no job."""
    n = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows)).cast("int").alias("n")).scalar()
    block = F.pmod(F.xxhash64(key), n).cast("int")
    blocks = df.withColumn("block", block).groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("rows")
    )
    return blocks, n


def with_blocks(df: DataFrame, blocks: DataFrame, n: Column) -> DataFrame:
    """Every row once for each block, with the block's lookup rows as the array ``rows``; callers bring the
    results of a row together by its own value. The same at every size of the lookup table."""
    fan = df.withColumn("block", F.explode(F.sequence(F.lit(0), n - 1)))
    return fan.join(blocks, "block").drop("block")
