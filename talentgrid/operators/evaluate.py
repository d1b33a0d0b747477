"""Evaluation statistics: regression errors, role predictors and their comparison."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentgrid.operators.market import raw_frequency, role_skill_counts, supported_vocabulary
from talentgrid.operators.tables import top_n


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5,
                       alpha: float = 2.0) -> DataFrame:
    """MAE, MSE, thresholded accuracy and MAE weighted by 1 + αy."""
    err = F.abs(F.col(y) - F.col(p))
    same = (F.col(y) > threshold) == (F.col(p) > threshold)
    return df.agg(
        F.count("*").alias("n"), F.avg(err).alias("mae"), F.avg(err * err).alias("mse"),
        F.avg(same.cast("int")).alias("accuracy"),
        F.avg(err * (1 + F.col(y) * alpha)).alias("weighted_mae"))


def worst_groups(df: DataFrame, by: str, n: int = 20, y: str = "y", p: str = "p") -> DataFrame:
    """Groups (skills) with the largest mean absolute error."""
    mae = df.groupBy(by).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))
    return top_n(mae, n, F.desc("mae"), F.asc(by))


def calibration(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Mean absolute error per prediction bin of [0, 1); empty bins give 0."""
    kept = df.where((F.col(p) >= 0) & (F.col(p) < 1))
    per = kept.groupBy(F.floor(F.col(p) * bins).cast("long").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(per, "bin", "left").fillna(0, ["n"]).fillna(0.0, ["mae"])


# --- role predictors ----------------------------------------------------------------

def _complete(test: DataFrame, best: DataFrame, roles: DataFrame) -> DataFrame:
    """Every test posting with its prediction; no evidence falls to the first role by name."""
    first = roles.agg(F.min("role")).scalar()
    return test.select("job_id", "role").join(best, "job_id", "left").withColumn(
        "predicted", F.coalesce("predicted", first))


def predict_by_signature(train_skills: DataFrame, test: DataFrame, test_skills: DataFrame,
                         n: int = 3) -> DataFrame:
    """Role whose top-n skills overlap most with the posting (ties: first role by name)."""
    top = top_n(role_skill_counts(train_skills), n, F.desc("n"), F.asc("skill"), by=["role"]).select(
        F.col("role").alias("predicted"), "skill")
    hits = test_skills.select("job_id", "skill").join(top, "skill").groupBy(
        "job_id", "predicted").agg(F.count("*").alias("hits"))
    # best = most hits, then smallest name: order the negated count ascending
    best = hits.groupBy("job_id").agg(
        F.min(F.struct((-F.col("hits")).alias("h"), "predicted")).alias("b")
    ).select("job_id", F.col("b.predicted").alias("predicted"))
    return _complete(test, best, train_skills)


def predict_by_profile(train: DataFrame, train_skills: DataFrame, test: DataFrame,
                       test_skills: DataFrame, vocab: DataFrame) -> DataFrame:
    """Role with the highest cosine to the posting's 0/1 skill vector (ties: first role by name).

    Sparse: only shared skills meet. The posting's own norm scales all roles alike and is left out.
    """
    profile = raw_frequency(train, train_skills.join(vocab, "skill", "left_semi")).select(
        "role", "skill", F.col("freq").alias("share"))
    norms = profile.groupBy("role").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("norm"))
    scaled = profile.join(norms, "role").select(
        F.col("role").alias("predicted"), "skill", (F.col("share") / F.col("norm")).alias("w"))
    sims = test_skills.select("job_id", "skill").join(scaled, "skill").groupBy(
        "job_id", "predicted").agg(F.round(F.sum("w"), 9).alias("sim"))
    best = sims.groupBy("job_id").agg(
        F.min(F.struct((-F.col("sim")).alias("s"), "predicted")).alias("b")
    ).select("job_id", F.col("b.predicted").alias("predicted"))
    return _complete(test, best, train_skills)


def vocabulary(posting_skills: DataFrame, min_support: int = 20) -> DataFrame:
    """Vocabulary of the comparison; it is built on all rows, the test part included, as the
    compared strategies do (a mild leak that is kept for equal results)."""
    return supported_vocabulary(posting_skills, min_support)


def precision_at_1(predictions: DataFrame) -> DataFrame:
    """Share of right predictions per role and overall ((all) row)."""
    hit = (F.col("predicted") == F.col("role")).cast("int")
    per = predictions.groupBy("role").agg(F.count("*").alias("n"), F.sum(hit).alias("right"))
    total = per.agg(F.sum("n").alias("n"), F.sum("right").alias("right")).withColumn("role", F.lit("(all)"))
    return per.unionByName(total).withColumn("precision", F.col("right") / F.col("n"))


def contingency(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Paired outcomes and the continuity-corrected McNemar statistic."""
    t = df.agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"),
        F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither"))
    d = F.col("a_only") + F.col("b_only")
    gap = F.abs(F.col("a_only") - F.col("b_only")) - 1
    return t.withColumn("statistic", F.when(d > 0, gap * gap / d).otherwise(F.lit(0.0)))


def chi2_tail(statistic: Column, terms: int = 200) -> Column:
    """Upper tail of χ² with one degree of freedom, erfc(√(x/2)).

    Below x = 4 as 1 − erf by a series of positive terms, above by the continued fraction of the incomplete gamma
    function, which ``terms`` steps bring to double precision at every x; beyond x = 1500 it is 0 in doubles.
    """
    x2 = statistic / 2.0

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * x2 / (k + 0.5)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["total"])
    erf = 2.0 / math.sqrt(math.pi) * F.sqrt(x2) * F.exp(-x2) * series
    # from the innermost denominator outwards: x2 + 2k − 3/2 − k(k − 1/2) / (the one within)
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), x2 + (2 * terms + 0.5),
                           lambda acc, k: x2 + (2 * k - 1.5) - k * (k - 0.5) / acc)
    erfc = F.sqrt(x2 / math.pi) * F.exp(-x2) / fraction
    return F.when(x2 < 2, F.greatest(F.lit(0.0), 1.0 - erf)).when(x2 <= 750, erfc).otherwise(F.exp(-x2))


def mcnemar(df: DataFrame, a: Column, b: Column, alpha: float = 0.05) -> DataFrame:
    """Contingency table with p-value (χ², one degree of freedom) and the decision."""
    return with_decision(contingency(df, a, b), alpha)


def with_decision(t: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A contingency row with ``p_value`` and ``decision``."""
    p = F.when(F.col("a_only") + F.col("b_only") > 0, chi2_tail(F.col("statistic"))).otherwise(F.lit(1.0))
    return t.withColumn("p_value", p).withColumn(
        "decision", F.when(F.col("p_value") >= alpha, "no difference")
        .when(F.col("b_only") > F.col("a_only"), "b better").otherwise("a better"))


def bootstrap_difference(df: DataFrame, a: Column, b: Column, resamples: int = 5000,
                         seed: int = 42) -> DataFrame:
    """Mean and 95 % interval of accuracy(b) − accuracy(a), in percentage points.

    A paired difference is −1, 0 or 1, so a resample of n rows is one multinomial draw from three
    counts: the rows are scanned once and never multiplied. Draws are seeded per resample.
    """
    d = b.cast("int") - a.cast("int")
    counts = df.select(d.alias("d")).agg(F.struct(
        F.count_if(F.col("d") == -1).alias("m"), F.count_if(F.col("d") == 0).alias("z"),
        F.count_if(F.col("d") == 1).alias("p")).alias("c")).scalar()

    @F.pandas_udf(T.DoubleType())
    def draw(i: pd.Series, m: pd.Series, z: pd.Series, p: pd.Series) -> pd.Series:
        n = int(m.iloc[0] + z.iloc[0] + p.iloc[0]) if len(i) else 0
        if n == 0:
            return pd.Series(np.zeros(len(i)))
        shares = np.array([m.iloc[0], z.iloc[0], p.iloc[0]], dtype=float) / n
        return pd.Series([
            (lambda k: (k[2] - k[0]) / n)(np.random.default_rng([seed, int(x)]).multinomial(n, shares))
            for x in i])

    runs = df.sparkSession.range(resamples).withColumn("c", counts)
    diffs = runs.select((draw("id", "c.m", "c.z", "c.p") * 100).alias("diff"))
    return diffs.agg(
        F.count("*").alias("resamples"), F.avg("diff").alias("mean_diff"),
        F.percentile("diff", F.lit(0.025)).alias("ci_low"),
        F.percentile("diff", F.lit(0.975)).alias("ci_high"))


