"""Market statistics over postings.

Inputs use two shapes: ``postings`` (one row per job_id with role and attributes) and
``posting_skills`` (distinct job_id, role, skill). Role × skill numbers come from one grouped pass;
totals are pre-aggregated and joined back, so a role with a third of all postings stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.functions.numeric import clamp, saturate
from talentgrid.operators.quantiles import count_quantiles, exact_quantiles
from talentgrid.operators.tables import top_n, with_totals


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def skill_counts(posting_skills: DataFrame) -> DataFrame:
    return value_counts(posting_skills, "skill")


def cleaning_audit(raw: DataFrame, clean: DataFrame, noise: list[str]) -> DataFrame:
    """Counts per skill before and after cleaning, with the noise flag."""
    both = raw.select("skill", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        clean.select("skill", F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return both.groupBy("skill").agg(
        F.sum("b").alias("before"), F.sum("a").alias("after")
    ).withColumn("is_noise", F.col("skill").isin(noise))


def missing_rate(postings: DataFrame, count: str = "skill_count") -> DataFrame:
    """Postings without skills per role, plus an ``(all)`` row, in % with one decimal."""
    per_role = postings.groupBy("role").agg(
        F.count("*").alias("total"), F.count_if(F.col(count) == 0).alias("missing")
    )
    overall = per_role.agg(F.sum("total").alias("total"), F.sum("missing").alias("missing"))
    both = per_role.unionByName(overall.withColumn("role", F.lit("(all)")))
    return both.withColumn("missing_pct", F.round(100.0 * F.col("missing") / F.col("total"), 1))


def competition(postings: DataFrame) -> DataFrame:
    """Mean and exact median applicants, and postings, per role."""
    base = postings.groupBy("role").agg(
        F.avg("applicants").alias("mean_applicants"), F.count("*").alias("jobs")
    )
    med = exact_quantiles(postings, F.col("applicants"), [0.5], ["role"])
    return base.join(med.select("role", F.col("quantile").alias("median_applicants")), "role", "left")


def remote_flag(c: Column) -> Column:
    """Text or number to boolean: non-zero is true; null stays null."""
    return c.try_cast("double") != 0


def remote_rate(postings: DataFrame, remote: str = "remote") -> DataFrame:
    """Remote share per role over rows where the flag is known, plus an ``(all)`` row."""
    known = postings.where(F.col(remote).isNotNull())
    per_role = known.groupBy("role").agg(
        F.count("*").alias("total"), F.count_if(remote_flag(F.col(remote))).alias("remote_jobs")
    )
    overall = per_role.agg(
        F.sum("total").alias("total"), F.sum("remote_jobs").alias("remote_jobs")
    ).withColumn("role", F.lit("(all)"))
    return per_role.unionByName(overall).withColumn(
        "remote_pct", 100.0 * F.col("remote_jobs") / F.col("total")
    )


def remote_share_kpi(remote: str = "remote") -> Column:
    """KPI variant: an unknown flag counts as not remote."""
    return F.avg(F.coalesce(remote_flag(F.col(remote)), F.lit(False)).cast("int")) * 100


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent values (ties by value), as a one-column sub-query."""
    return top_n(value_counts(df, col), n, F.desc("n"), F.asc(col)).select(col)


def level_mix(postings: DataFrame, level: str, order: list[str], n_roles: int) -> DataFrame:
    """Row-normalised role × level percentages, top roles only, levels in a fixed order, 0 filled."""
    wide = (
        postings.where(F.col(level).isin(order))
        .groupBy("role").pivot(level, order).count().fillna(0, order)
    )
    total = sum((F.col(f"`{c}`") for c in order), F.lit(0))
    pct = wide.select("role", *[(F.col(f"`{c}`") / total * 100).alias(c) for c in order])
    top = top_values(postings, "role", n_roles)
    return top.join(pct, "role", "left")


def collapse_rare(df: DataFrame, col: str, min_share: float = 0.02, other: str = "other") -> DataFrame:
    """Counts per value with values under ``min_share`` of all rows merged into ``other``."""
    counts = value_counts(df.where(F.col(col).isNotNull()), col)
    total = counts.agg(F.sum("n")).scalar()
    label = F.when(F.col("n") >= total * min_share, F.col(col)).otherwise(F.lit(other))
    return counts.groupBy(label.alias(col)).agg(F.sum("n").alias("n"))


def role_sizes(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("role").isNotNull()).groupBy("role").agg(
        F.count("*").alias("role_jobs")
    )


def role_skill_counts(posting_skills: DataFrame) -> DataFrame:
    return posting_skills.groupBy("role", "skill").agg(F.count("*").alias("n"))


def raw_frequency(postings: DataFrame, posting_skills: DataFrame) -> DataFrame:
    """Share of a role's postings that name the skill."""
    return role_skill_counts(posting_skills).join(role_sizes(postings), "role").withColumn(
        "freq", F.col("n") / F.col("role_jobs")
    )


def max_normalised(counts: DataFrame) -> DataFrame:
    """Role-skill count over the role's largest count."""
    return with_totals(counts, ["role"], F.max("n").alias("max_n")).withColumn(
        "weight", F.col("n") / F.col("max_n")
    )


def versatility(counts: DataFrame, postings: DataFrame) -> DataFrame:
    """Share of all roles that use the skill; ``counts`` has one row per (role, skill)."""
    n_roles = role_sizes(postings).agg(F.count("*")).scalar()
    return counts.groupBy("skill").agg(F.count("*").alias("roles_using")).withColumn(
        "versatility", F.col("roles_using") / n_roles
    )


def affinity(counts: DataFrame) -> DataFrame:
    """Share of a skill's postings that belong to the role."""
    return with_totals(counts, ["skill"], F.sum("n").alias("skill_n")).withColumn(
        "affinity", F.col("n") / F.col("skill_n")
    )


def tfidf(postings: DataFrame, posting_skills: DataFrame) -> DataFrame:
    """freq × ln(R / (1 + df)) per role and skill, min-max scaled per role (0.5 when flat).

    The idf of a skill used by every role is negative; it is kept.
    """
    freq = raw_frequency(postings, posting_skills)
    n_roles = role_sizes(postings).agg(F.count("*")).scalar()
    # rows are (role, skill) counts, at most roles × vocabulary: a window holds one role or one skill
    scored = freq.withColumn("df", F.count("*").over(Window.partitionBy("skill"))).withColumn(
        "tfidf", F.col("freq") * F.log(n_roles / (1 + F.col("df")))
    )
    role = Window.partitionBy("role")
    ranged = scored.withColumn("lo", F.min("tfidf").over(role)).withColumn("hi", F.max("tfidf").over(role))
    span = F.col("hi") - F.col("lo")
    scaled = F.when(span < 1e-8, F.lit(0.5)).otherwise((F.col("tfidf") - F.col("lo")) / span)
    return ranged.select("role", "skill", "n", "freq", "df", "tfidf", scaled.alias("scaled"))


def priority(tfidf_scores: DataFrame, alpha: float = 2.0) -> DataFrame:
    """Closed-form priority 1 − e^(−α·scaled tf-idf)."""
    return tfidf_scores.withColumn("priority", saturate(F.col("scaled"), alpha))


def skill_trend(postings: DataFrame, posting_skills: DataFrame, months: int = 6) -> DataFrame:
    """clip(share in the last months − share before + 0.5, 0, 1) per skill."""
    dated = postings.where(F.col("posted").isNotNull())
    cutoff = dated.agg(F.add_months(F.max("posted"), -months)).scalar()
    sizes = dated.agg(
        F.struct(
            F.greatest(F.count_if(F.col("posted") >= cutoff), F.lit(1)).alias("recent"),
            F.greatest(F.count_if(F.col("posted") < cutoff), F.lit(1)).alias("older"),
        ).alias("s")
    ).scalar()
    per_skill = posting_skills.groupBy("skill").agg(
        F.count_if(F.col("posted") >= cutoff).alias("n_recent"),
        F.count_if(F.col("posted") < cutoff).alias("n_older"),
    ).withColumn("s", sizes)
    raw = F.col("n_recent") / F.col("s.recent") - F.col("n_older") / F.col("s.older") + 0.5
    return per_skill.select("skill", "n_recent", "n_older", clamp(raw, 0, 1).alias("trend"))


def period_trend(postings: DataFrame, period: Column, *by: str) -> DataFrame:
    return postings.where(F.col("posted").isNotNull()).groupBy(
        period.alias("period"), *by
    ).agg(F.count("*").alias("n"))


def top_skill_trend(posting_skills: DataFrame, period: Column, n: int = 8) -> DataFrame:
    """Counts per period of the n globally most frequent skills."""
    return period_trend(
        posting_skills.join(top_values(posting_skills, "skill", n), "skill", "left_semi"),
        period, "skill",
    )


def penetration(postings: DataFrame, posting_skills: DataFrame, n_roles: int,
                n_skills: int) -> DataFrame:
    """% of a top role's postings naming a top skill, every (role, skill) cell present."""
    roles = top_values(postings, "role", n_roles)
    skills = top_values(posting_skills, "skill", n_skills)
    # both lists are cut to the report's size, so the grid is n_roles × n_skills rows
    names = skills.agg(F.collect_list("skill")).scalar()
    grid = roles.withColumn("skill", F.explode(names))
    counts = role_skill_counts(
        posting_skills.join(roles, "role", "left_semi").join(skills, "skill", "left_semi")
    )
    return (
        grid.join(counts, ["role", "skill"], "left").join(role_sizes(postings), "role")
        .select("role", "skill",
                (F.coalesce("n", F.lit(0)) / F.col("role_jobs") * 100).alias("pct"))
    )


def supported_vocabulary(posting_skills: DataFrame, min_support: int, fallback: int = 50) -> DataFrame:
    """Skills named by at least ``min_support`` postings, or the first ``fallback`` by name."""
    counts = skill_counts(posting_skills)
    good = counts.where(F.col("n") >= min_support).select("skill")
    any_good = good.agg(F.count("*")).scalar()
    first = counts.select("skill").orderBy("skill").limit(fallback).where(any_good == 0)
    return good.unionByName(first)


def role_profile(postings: DataFrame, posting_skills: DataFrame, min_support: int = 15) -> DataFrame:
    """Mean multi-hot vector per role in sparse form: (role, skill, share > 0)."""
    vocab = supported_vocabulary(posting_skills, min_support)
    kept = posting_skills.join(vocab, "skill", "left_semi")
    return raw_frequency(postings, kept).select("role", "skill", F.col("freq").alias("share"))


def kpi_block(postings: DataFrame, posting_skills: DataFrame, courses: DataFrame) -> DataFrame:
    """One row: jobs, roles, distinct skills, courses, remote %, mean skills per posting."""
    skills = posting_skills.agg(
        F.count_distinct("skill").alias("skills"), F.count("*").alias("links")
    ).select(F.struct("skills", "links")).scalar()
    n_courses = courses.agg(F.count("*")).scalar()
    jobs = postings.agg(
        F.count("*").alias("jobs"), F.count_distinct("role").alias("roles"),
        remote_share_kpi().alias("remote_pct"),
    )
    return jobs.withColumn("s", skills).withColumn("courses", n_courses).select(
        "jobs", "roles", F.col("s.skills").alias("skills"), "courses", "remote_pct",
        (F.col("s.links") / F.col("jobs")).alias("mean_skills"),
    )


def role_card(postings: DataFrame, posting_skills: DataFrame, n: int = 5) -> DataFrame:
    """Per role: jobs, mean skills, remote %, mean applicants and the top skills with their share."""
    base = postings.groupBy("role").agg(
        F.count("*").alias("jobs"), F.avg("applicants").alias("mean_applicants"),
        remote_share_kpi().alias("remote_pct"),
    )
    counts = role_skill_counts(posting_skills)
    links = counts.groupBy("role").agg(F.sum("n").alias("links"))
    top = top_n(counts, n, F.desc("n"), F.asc("skill"), by=["role"], rank="rank")
    return (
        base.join(links, "role").join(top, "role")
        .select("role", "jobs", "mean_applicants", "remote_pct",
                (F.col("links") / F.col("jobs")).alias("mean_skills"), "rank", "skill",
                (F.col("n") / F.col("jobs") * 100).alias("skill_pct"))
    )


def skills_per_posting(postings: DataFrame, n_roles: int = 12) -> DataFrame:
    """Median skills per posting of the largest roles."""
    top = top_values(postings, "role", n_roles)
    kept = postings.join(top, "role", "left_semi")
    return count_quantiles(kept, "skill_count", [0.5], ["role"]).select(
        "role", F.col("quantile").alias("median_skills")
    )


def imbalance(postings: DataFrame) -> DataFrame:
    """Largest over smallest role with their names (ties by name)."""
    sizes = role_sizes(postings)
    largest = F.min_by("role", F.struct(-F.col("role_jobs"), "role"))
    return sizes.agg(
        F.sum("role_jobs").alias("rows"), F.count("*").alias("roles"),
        F.max("role_jobs").alias("max_jobs"), F.min("role_jobs").alias("min_jobs"),
        largest.alias("largest"), F.min_by("role", F.struct("role_jobs", "role")).alias("smallest"),
    ).withColumn("ratio", F.col("max_jobs") / F.col("min_jobs"))


def skill_correlation(postings: DataFrame, posting_skills: DataFrame, n: int = 15) -> DataFrame:
    """Correlation of presence over all postings, for each pair of the n most used skills.

    Each posting becomes one n-slot 0/1 row; all pairs are one aggregate over those rows, so no
    pair rows are produced per posting.
    """
    top = top_n(skill_counts(posting_skills), n, F.desc("n"), F.asc("skill"), rank="slot")
    names = top.agg(F.map_from_entries(F.collect_list(F.struct("slot", "skill")))).scalar()
    slots = posting_skills.join(top.select("skill", "slot"), "skill").groupBy("job_id").agg(
        *[F.max((F.col("slot") == i).cast("double")).alias(f"s{i}") for i in range(1, n + 1)]
    )
    full = postings.select("job_id").join(slots, "job_id", "left").fillna(0.0)
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
    wide = full.agg(*[F.corr(f"s{i}", f"s{j}").alias(f"c{i}_{j}") for i, j in pairs])
    long = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("corr"))
        for i, j in pairs
    ]))
    return wide.select(long.alias("x")).withColumn("names", names).select(
        F.try_element_at("names", F.col("x.i")).alias("skill_a"),
        F.try_element_at("names", F.col("x.j")).alias("skill_b"), F.col("x.corr").alias("corr"),
    ).where(F.col("skill_b").isNotNull())


def skill_weights(course_skills: DataFrame, posting_skills: DataFrame) -> DataFrame:
    """Catalog skill weight: its posting frequency, 1 when no posting names it."""
    catalog = course_skills.select("skill").distinct()
    return catalog.join(skill_counts(posting_skills), "skill", "left").select(
        "skill", F.coalesce("n", F.lit(1)).cast("double").alias("weight")
    )


def pooled_skills(postings_lists: DataFrame) -> DataFrame:
    """A role's pooled skill lists, one row per (role, posting, skill).

    The long form is the pool; gathering a role's lists into one array would put a whole role in
    one row.
    """
    return postings_lists.select("role", "job_id", F.explode("skills").alias("skill"))


def supply_gap(posting_skills: DataFrame, course_skills: DataFrame, n: int = 10) -> DataFrame:
    """Top demanded beside top taught skills."""
    demand = top_n(skill_counts(posting_skills), n, F.desc("n"), F.asc("skill"), rank="demand_rank")
    taught = top_n(skill_counts(course_skills), n, F.desc("n"), F.asc("skill"), rank="supply_rank")
    return demand.withColumnRenamed("n", "jobs").join(
        taught.withColumnRenamed("n", "courses"), "skill", "full_outer"
    )


def taught_and_demanded(course_skills: DataFrame, posting_skills: DataFrame) -> DataFrame:
    """Course skills kept only when some posting names them, with course counts."""
    vocab = posting_skills.select("skill").distinct()
    return skill_counts(course_skills.join(vocab, "skill", "left_semi"))
