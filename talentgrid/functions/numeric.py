"""Scores, tiers and vector arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid import fixed_values as V
from talentgrid.functions.lists import bind, string_map


def saturate(x: Column, alpha: float = 2.0) -> Column:
    """1 − e^(−αx)."""
    return 1.0 - F.exp(x * F.lit(-alpha))


def rounded(x: Column, digits: int = 6) -> Column:
    """As Spark's ``round`` of doubles, which forms a decimal number for every value; here only where a value is close to
    the middle of two results, large, or not a number."""
    y = x * F.lit(10.0 ** digits) + 0.5
    z = F.floor(y)
    plain = (F.abs(y) < 1e9) & (y - z).between(1e-4, 1 - 1e-4)
    return F.when(plain, z / F.lit(10.0 ** digits)).otherwise(F.round(x, digits))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def safe_double(x: Column) -> Column:
    """Cast to double; unparsable, NaN and infinite values become 0."""
    d = x.try_cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.when(finite, d).otherwise(F.lit(0.0))


def blend(match: Column, affinity: Column, weight: float = 0.4) -> Column:
    """(1 − w)·match + w·affinity with the affinity clipped to 0..1."""
    return match * (1 - weight) + clamp(affinity, 0, 1) * weight


def readiness_level(score: Column) -> Column:
    return (
        F.when(score >= 0.75, "excellent").when(score >= 0.55, "high")
        .when(score >= 0.35, "moderate").otherwise("low")
    )


def support_tier(rows: Column) -> Column:
    return (
        F.when(rows >= 500, "OK").when(rows >= 200, "MED").when(rows >= 100, "LOW")
        .otherwise("MIN")
    )


def confidence_risk(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "low").when(confidence >= 0.6, "medium").otherwise("high")


def score_band(score: Column) -> Column:
    """Colour band of a 0..1 score shown as a whole percentage (half rounds up)."""
    pct = F.floor(F.coalesce(score, F.lit(0.0)) * 100 + 0.5)
    return F.when(pct >= 75, "green").when(pct >= 50, "amber").otherwise("red")


def transferable_pct(transferable: Column, to_develop: Column) -> Column:
    """transferable / (transferable + to develop) in %, one decimal, 0 when both are empty."""
    total = transferable + to_develop
    pct = F.bround(transferable / total * 100, 1)
    return F.when(total > 0, pct).otherwise(F.lit(0.0))


def pivot_metrics(overlap: Column, demand: Column, difficulty: Column, months: Column) -> Column:
    """Radar struct: skill_match, demand, ease, speed, overall (0..100)."""
    def points(table, key):
        m = string_map({k: str(v) for k, v in table.items()})
        return F.coalesce(F.try_element_at(m, F.lower(key)).cast("double"), F.lit(50.0))

    def half_up(x):
        return F.floor(x + 0.5).cast("double")

    match = F.least(F.lit(100.0), F.coalesce(overlap, F.lit(0.0)))
    dem, ease = points(V.DEMAND_POINTS, demand), points(V.EASE_POINTS, difficulty)
    m = F.coalesce(months.cast("double"), F.lit(12.0))
    speed = half_up(F.greatest(F.lit(10.0), (1 - (m - 1) / 24) * 100))
    overall = half_up((match + dem + ease + speed) / 4)
    return F.struct(
        match.alias("skill_match"), dem.alias("demand"), ease.alias("ease"),
        speed.alias("speed"), overall.alias("overall"),
    )


# --- vectors: ARRAY<FLOAT>, arithmetic in double -----------------------------

def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Vector divided by its length; the 1e-9 guard maps a zero vector to zeros."""
    return bind(norm(a) + 1e-9, lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + 1e-9) * (norm(b) + 1e-9))


def blend_units(a: Column, b: Column, wa: float = 0.4, wb: float = 0.6) -> Column:
    """Weighted sum of two unit vectors."""
    return F.zip_with(unit(a), unit(b), lambda x, y: x * wa + y * wb)
