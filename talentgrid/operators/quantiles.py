"""Exact quantiles and histograms that do not gather a group in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _interpolate(df: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, p, r, v, n_before, n_upto) rows pick the two order statistics around rank r."""
    lo, hi = F.floor("r"), F.ceil("r")
    at = lambda k: F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_upto")), F.col("v")))
    out = df.groupBy(*keys, "p").agg(
        F.first("r").alias("r"), at(lo).alias("_lo"), at(hi).alias("_hi")
    )
    frac = F.col("r") - F.floor("r")
    return out.select(
        *keys, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("quantile")
    )


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], by: list[str] | None = None,
                    accuracy: int = 20_000) -> DataFrame:
    """Linear-interpolated quantiles per group: columns ``by…, p, quantile``.

    A mergeable sketch brackets each rank; one pass counts the rows below the bracket, and only
    values inside it are counted one by one. If a sketch misses its rank, the counts show it and
    the bracket widens to the group's min or max, so the answer is exact in every case.
    """
    by = by or []
    base = df.select(*by, value.cast("double").alias("v")).where(F.col("v").isNotNull())
    margin = 4.0 / accuracy
    edges = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)})
    sketch = base.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"),
        F.percentile_approx("v", F.array(*[F.lit(e) for e in edges]), accuracy).alias("e"),
    )
    wanted = F.array(*[
        F.struct(
            F.lit(p).alias("p"),
            F.element_at("e", edges.index(min(1.0, max(0.0, p - margin))) + 1).alias("lo"),
            F.element_at("e", edges.index(min(1.0, max(0.0, p + margin))) + 1).alias("hi"),
        )
        for p in probs
    ])
    brackets = sketch.select(*by, "n", "v_min", "v_max", F.explode(wanted).alias("w")).select(
        *by, "n", "v_min", "v_max", "w.*", (F.col("w.p") * (F.col("n") - 1)).alias("r")
    )
    # per-row comparison against the group's brackets: one row per group and probability
    grouped = brackets.groupBy(*by).agg(
        F.collect_list(F.struct("p", "r", "lo", "hi", "v_min", "v_max")).alias("bs")
    )
    joined = base.join(grouped, by) if by else base.withColumn(
        "bs", grouped.select("bs").scalar()
    )
    tested = joined.select(*by, "v", F.explode("bs").alias("b"))
    checked = tested.groupBy(*by, F.col("b.p").alias("p")).agg(
        F.first("b").alias("b"),
        F.count_if(F.col("v") < F.col("b.lo")).alias("below"),
        F.count_if(F.col("v") <= F.col("b.hi")).alias("upto"),
    )
    low_ok = F.col("below") <= F.floor("b.r")
    high_ok = F.col("upto") > F.ceil("b.r")
    fixed = checked.select(
        *by, "p", F.col("b.r").alias("r"),
        F.when(low_ok, F.col("b.lo")).otherwise(F.col("b.v_min")).alias("lo"),
        F.when(high_ok, F.col("b.hi")).otherwise(F.col("b.v_max")).alias("hi"),
        F.when(low_ok, F.col("below")).otherwise(F.lit(0)).alias("below"),
    )
    fixed_arr = fixed.groupBy(*by).agg(
        F.collect_list(F.struct("p", "r", "lo", "hi", "below")).alias("bs")
    )
    again = base.join(fixed_arr, by) if by else base.withColumn(
        "bs", fixed_arr.select("bs").scalar()
    )
    inside = (
        again.select(*by, "v", F.explode("bs").alias("b"))
        .where(F.col("v").between(F.col("b.lo"), F.col("b.hi")))
        .groupBy(*by, F.col("b.p").alias("p"), "v")
        .agg(F.count("*").alias("c"), F.first("b.r").alias("r"), F.first("b.below").alias("below"))
    )
    run = Window.partitionBy(*by, "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("n_upto", F.col("below") + F.sum("c").over(run)).withColumn(
        "n_before", F.col("n_upto") - F.col("c")
    )
    return _interpolate(placed, by)


def count_quantiles(df: DataFrame, value: str, probs: list[float],
                    by: list[str] | None = None) -> DataFrame:
    """Exact quantiles of a small-domain integer column (counts, lengths) from its value counts."""
    by = by or []
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("c"))
    )
    group = Window.partitionBy(*by)
    run = group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(
        *by, "v", "c", F.sum("c").over(run).alias("n_upto"), F.sum("c").over(group).alias("n"),
    ).withColumn("n_before", F.col("n_upto") - F.col("c"))
    exploded = placed.withColumn("p", F.explode(F.array(*[F.lit(p) for p in probs])))
    return _interpolate(exploded.withColumn("r", F.col("p") * (F.col("n") - 1)), by)


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width histogram between min and max, the last bin closed: ``bin, n``."""
    base = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    span = base.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    spanned = base.withColumn("s", span)
    width = F.col("s.hi") - F.col("s.lo")
    raw = F.when(width > 0, F.floor((F.col("v") - F.col("s.lo")) / width * bins)).otherwise(0)
    bucket = F.least(F.lit(bins - 1), raw).cast("long")
    return spanned.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))
