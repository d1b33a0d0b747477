"""Set algebra on record tables, quality gates and record validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentgrid import fixed_values as V
from talentgrid.functions.lists import string_map
from talentgrid.functions.text import clean_token


def gazetteer(sources: list[tuple[str, DataFrame]], synonyms: dict[str, str] | None = None,
              stops=None) -> DataFrame:
    """Provenance-tagged union of skill names: the first source wins a canonical name, further
    surfaces of it are kept as alias rows. Sources have a ``skill`` column and are given in order."""
    m = string_map(V.SYNONYMS if synonyms is None else synonyms)
    stops = V.STOP_SKILLS if stops is None else stops
    parts = [
        df.select(clean_token(F.col("skill")).alias("surface")).distinct().select(
            "surface", F.lit(name).alias("source"), F.lit(i).alias("prio"))
        for i, (name, df) in enumerate(sources)
    ]
    rows = reduce(DataFrame.unionByName, parts).where(
        (F.length("surface") >= 2) & ~F.col("surface").isin(list(stops))
    ).withColumn("canonical", F.coalesce(F.try_element_at(m, F.col("surface")), F.col("surface")))
    # distinct surfaces of one canonical name: a handful of rows
    first = Window.partitionBy("canonical").orderBy("prio", "surface")
    return rows.withColumn("_r", F.row_number().over(first)).where(
        (F.col("_r") == 1) | (F.col("surface") != F.col("canonical"))
    ).select("surface", "canonical", "source")


def upsampled_union(real: DataFrame, generated: DataFrame, extra_copies: int = 4) -> DataFrame:
    """Tagged union with real rows kept once and repeated ``extra_copies`` times."""
    copies = real.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(extra_copies)))).withColumn(
        "origin", F.lit("real"))
    return copies.unionByName(
        generated.withColumn("copy", F.lit(0)).withColumn("origin", F.lit("generated")))


def split_overlaps(assigned: DataFrame, key: str, splits=("train", "val", "test")) -> DataFrame:
    """Keys shared by each pair of splits; all counts are 0 for a clean split."""
    flags = assigned.groupBy(key).agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in splits])
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1:]]
    wide = flags.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.col(f"`{a}|{b}`").alias("shared"))
        for a, b in pairs])))


def review_partition(skills: DataFrame, vocab: DataFrame) -> DataFrame:
    """Accepted (low risk) skills in the vocabulary, accepted but unmapped, rejected (high risk);
    others stay pending. ``skills``: skill, risk."""
    known = vocab.select("skill").distinct().withColumn("_v", F.lit(True))
    flagged = skills.join(known, "skill", "left")
    part = (F.when((F.col("risk") == "low") & F.col("_v").isNotNull(), "validated")
            .when(F.col("risk") == "low", "unmapped").when(F.col("risk") == "high", "rejected")
            .otherwise("pending"))
    return flagged.withColumn("part", part).drop("_v")


def union_roles(data_backed: DataFrame, suggested: DataFrame, *keys: str) -> DataFrame:
    """Data-backed roles plus suggested ones that are not already there."""
    fresh = suggested.join(data_backed.select(*keys), list(keys), "left_anti")
    return data_backed.select(*keys).withColumn("layer", F.lit("data")).unionByName(
        fresh.select(*keys).withColumn("layer", F.lit("suggested")))


def gate(name: str, value: DataFrame, passed, detail: str = "value") -> DataFrame:
    """One (check, passed, detail) row from a one-row DataFrame with a ``value`` column."""
    return value.select(F.lit(name).alias("check"), passed(F.col("value")).alias("passed"),
                        F.col("value").cast("string").alias("detail"))


def quality_gates(tables: dict[str, DataFrame], vocab: DataFrame, roles: DataFrame, splits: DataFrame,
                  key: str, n_roles: int = 50, vocab_range=(500, 650)) -> DataFrame:
    """Non-empty tables, role count, vocabulary range, no key in two splits."""
    count = lambda df: df.agg(F.count("*").alias("value"))
    lo, hi = vocab_range
    rows = [gate(f"rows:{n}", count(df), lambda v: v > 0) for n, df in tables.items()]
    rows.append(gate("roles", count(roles.distinct()), lambda v: v == n_roles))
    rows.append(gate("vocabulary", count(vocab.distinct()), lambda v: (v >= lo) & (v <= hi)))
    twice = splits.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1")
    rows.append(gate("split_overlap", count(twice), lambda v: v == 0))
    return reduce(DataFrame.unionByName, rows)


def violations(rules: dict[str, Column]) -> Column:
    """Names of the broken rules as a sorted array (a null test counts as broken)."""
    named = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in sorted(rules.items())])
    return F.filter(named, lambda x: x.isNotNull())


def profile_rules() -> dict[str, Column]:
    """Limits of a profile record held in columns of the usual names."""
    return {
        "name_length": F.length("name") <= 255, "phone_length": F.length("phone") <= 50,
        "skill_count": F.size("skills") <= 200,
        "skill_length": ~F.exists("skills", lambda s: F.length(s) > 100),
        "years_range": F.col("years").between(0, 60),
    }


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and an order-insensitive content hash per table."""
    rows = [
        df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("hash"))
        .select(F.lit(name).alias("artifact"), "rows", F.md5(F.col("hash").cast("string")).alias("content_hash"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)
