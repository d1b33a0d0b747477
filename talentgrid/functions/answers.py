"""Parsing and normalising generated JSON answers held as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid import fixed_values as V
from talentgrid.functions.lists import STRINGS, bind, empty_strings
from talentgrid.functions.numeric import clamp

# raw answer fields are read as text, then coerced one by one
ROLE_NAMES = [
    "role_name", "sbert_match_score", "skill_overlap_pct", "category", "why_good_fit",
    "transferable_skills", "skills_to_develop", "skills", "missing_skills", "gap_skills",
    "transition_difficulty", "estimated_transition_time", "estimated_transition_months",
    "skill_readiness_pct", "first_step", "market_demand",
]
_ROLES = "array<struct<" + ",".join(f"{n}:string" for n in ROLE_NAMES) + ">>"
ANSWER_SCHEMA = (
    "thinking_process string, "
    "current_role_assessment struct<target_role:string,readiness_score:string,"
    f"readiness_level:string,verdict:string>, alternative_roles {_ROLES}, "
    f"ai_discovered_roles {_ROLES}, strongest_transferable_skills string, "
    "suggested_certifications string, universal_advice string"
)


def json_block(raw: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; null when there is none."""
    first = F.position(F.lit("{"), raw)
    last = F.length(raw) - F.position(F.lit("}"), F.reverse(raw)) + 1
    return F.when((first > 0) & F.contains(raw, F.lit("}")) & (last > first),
                  F.substring(raw, first, last - first + 1))


def parse_tolerant(raw: Column, schema: str) -> Column:
    """Strict parse, else parse of the braces block; null when neither holds an object."""
    def valid(text: Column) -> Column:
        # from_json alone would turn bad text into a struct of nulls
        ok = F.get_json_object(text, "$").isNotNull() & F.trim(text).startswith("{")
        return F.when(ok, F.from_json(text, schema))

    return F.coalesce(valid(raw), valid(json_block(raw)))


def parse_layer(raw: Column) -> Column:
    """Which step read the answer: strict, block or failed."""
    def good(text):
        return F.get_json_object(text, "$").isNotNull() & F.trim(text).startswith("{")
    return (
        F.when(F.coalesce(good(raw), F.lit(False)), "strict")
        .when(F.coalesce(good(json_block(raw)), F.lit(False)), "block").otherwise("failed")
    )


def strip_hint(c: Column) -> Column:
    """Drop a trailing parenthesised hint; a bare placeholder becomes ''."""
    bare = F.trim(F.regexp_replace(c, V.TRAILING_HINT, ""))
    return bind(bare, lambda s: F.when(s.startswith("__FILL__"), "").otherwise(s))


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(V.PLACEHOLDERS)


def coerce_enum(c: Column, allowed: list[str], default: str) -> Column:
    """First allowed value contained in the lowered text, else by synonym, else the default."""
    def pick(s: Column) -> Column:
        def has(*words: str) -> Column:
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(s, F.lit(w))
            return hit

        out = F.when(s.isNull(), default)
        for value in allowed:
            out = out.when(has(value), value)
        if "challenging" in allowed:
            out = out.when(has("difficult", "hard"), "challenging")
        middle = "medium" if "medium" in allowed else "moderate" if "moderate" in allowed else None
        if middle:
            out = out.when(has("moderate", "average"), middle)
        if "low" in allowed:
            out = out.when(has("weak", "slow", "less"), "low")
        return out.otherwise(default)

    return bind(F.lower(F.trim(F.regexp_replace(c, V.TRAILING_HINT, ""))), pick)


def unit_score(c: Column) -> Column:
    """Number or numeric text clamped to 0..1, bad text 0."""
    return clamp(F.coalesce(c.try_cast("double"), F.lit(0.0)), 0, 1)


def percent(c: Column) -> Column:
    """``75%`` or 75 clamped to 0..100, bad text 0."""
    return clamp(
        F.coalesce(F.trim(F.regexp_replace(c, "%", "")).try_cast("double"), F.lit(0.0)), 0, 100
    )


def readiness_score(c: Column, quoted: Column) -> Column:
    """0..1 score; text above 1 (``75%``) is a percentage, a plain number is clamped."""
    v = F.coalesce(F.trim(F.regexp_replace(c, "%", "")).try_cast("double"), F.lit(0.0))
    return clamp(F.when(quoted & (v > 1), v / 100).otherwise(v), 0, 1)


def transition_months(months: Column, time_text: Column) -> Column:
    """Whole months 1..48: the given value, else the first number in the time text, else 6."""
    from_text = F.regexp_extract(time_text, r"(\d+)", 1).try_cast("int")
    given = F.floor(months.try_cast("double")).cast("int")
    value = F.when(months.isNotNull(), F.coalesce(given, F.lit(6))).otherwise(
        F.coalesce(from_text, F.lit(6))
    )
    return F.greatest(F.lit(1), F.least(F.lit(48), value))


def transition_time(c: Column) -> Column:
    """A bare number means months; text loses its hint."""
    n = c.try_cast("double")
    return F.when(n.isNotNull(), F.concat(n.cast("int").cast("string"), F.lit(" months"))).otherwise(
        strip_hint(c)
    )


def skill_names(json_list: Column) -> Column:
    """JSON list of names or ``{skill | name}`` objects to clean names without placeholders."""
    items = F.coalesce(F.from_json(json_list, STRINGS), empty_strings())

    def name(item: Column) -> Column:
        picked = F.coalesce(F.get_json_object(item, "$.skill"), F.get_json_object(item, "$.name"),
                            F.lit(""))
        return strip_hint(F.when(item.startswith("{"), picked).otherwise(item))

    return F.filter(F.transform(items, name), lambda s: (s != "") & ~is_placeholder(s))


def skill_relevance(json_list: Column, key: str = "skill") -> Column:
    """JSON list of names or objects to STRUCT<name, relevance>; names alone get ''."""
    items = F.filter(
        F.coalesce(F.from_json(json_list, STRINGS), empty_strings()), lambda s: ~is_placeholder(s)
    )

    def pair(item: Column) -> Column:
        is_object = item.startswith("{")
        n = F.coalesce(F.get_json_object(item, f"$.{key}"), F.lit(""))
        rel = strip_hint(F.coalesce(F.get_json_object(item, "$.relevance"), F.lit("")))
        return F.struct(
            strip_hint(F.when(is_object, n).otherwise(item)).alias("name"),
            F.when(is_object & ~is_placeholder(rel), rel).otherwise("").alias("relevance"),
        )

    return F.filter(F.transform(items, pair), lambda p: (p["name"] != "") & ~is_placeholder(p["name"]))


def discovered_roles(roles: Column) -> Column:
    """Suggested roles, fields coerced; readiness is recomputed from the two skill lists.

    Two chained transforms: the lists are parsed once, then used by several fields.
    """
    def with_lists(r: Column) -> Column:
        return F.struct(
            r.alias("r"), skill_names(r["transferable_skills"]).alias("own"),
            skill_names(F.coalesce(F.nullif(r["skills_to_develop"], F.lit("[]")), r["skills"],
                                   r["missing_skills"])).alias("dev"),
        )

    def final(x: Column) -> Column:
        r, total = x["r"], F.size(x["own"]) + F.size(x["dev"])
        pct = F.bround(F.size(x["own"]) / total * 100, 1)
        return F.struct(
            strip_hint(F.coalesce(r["role_name"], F.lit(""))).alias("role_name"),
            coerce_enum(r["category"], V.CATEGORY_VALUES, "adjacent").alias("category"),
            strip_hint(F.coalesce(r["why_good_fit"], F.lit(""))).alias("why_good_fit"),
            x["own"].alias("transferable_skills"), x["dev"].alias("skills_to_develop"),
            coerce_enum(r["transition_difficulty"], V.DIFFICULTY_VALUES, "moderate")
            .alias("transition_difficulty"),
            transition_months(r["estimated_transition_months"], r["estimated_transition_time"])
            .alias("estimated_transition_months"),
            F.when(total > 0, pct).otherwise(F.lit(0.0)).alias("skill_readiness_pct"),
            F.coalesce(r["first_step"], F.lit("Learn the essential skills for this role."))
            .alias("first_step"),
            coerce_enum(r["market_demand"], V.DEMAND_VALUES, "medium").alias("market_demand"),
        )

    return F.transform(F.transform(roles, with_lists), final)


def alternative_roles(roles: Column) -> Column:
    """Data-backed roles, fields coerced."""
    return F.transform(roles, lambda r: F.struct(
        F.coalesce(r["role_name"], F.lit("")).alias("role_name"),
        unit_score(r["sbert_match_score"]).alias("match_score"),
        percent(r["skill_overlap_pct"]).alias("skill_overlap_pct"),
        F.coalesce(r["why_good_fit"], F.lit("")).alias("why_good_fit"),
        skill_relevance(r["transferable_skills"]).alias("transferable_skills"),
        F.coalesce(F.from_json(r["gap_skills"], STRINGS), empty_strings()).alias("gap_skills"),
        coerce_enum(r["transition_difficulty"], V.DIFFICULTY_VALUES, "moderate")
        .alias("transition_difficulty"),
        transition_time(r["estimated_transition_time"]).alias("estimated_transition_time"),
        F.coalesce(r["first_step"], F.lit("")).alias("first_step"),
    ))


def normalize_answers(df: DataFrame, raw: str, out: str = "answer") -> DataFrame:
    """Parse the answer text once, then coerce every field; unparsable answers give null."""
    quoted = F.coalesce(F.col(raw), F.lit("")).rlike(r'"readiness_score"\s*:\s*"')
    a, now = F.col("_a"), F.col("_a.current_role_assessment")
    answer = F.struct(
        F.coalesce(a["thinking_process"], F.lit("")).alias("thinking_process"),
        F.struct(
            F.coalesce(now["target_role"], F.lit("")).alias("target_role"),
            readiness_score(now["readiness_score"], quoted).alias("readiness_score"),
            coerce_enum(now["readiness_level"], V.READINESS_VALUES, "moderate")
            .alias("readiness_level"),
            F.coalesce(now["verdict"], F.lit("")).alias("verdict"),
        ).alias("current_role_assessment"),
        F.coalesce(alternative_roles(a["alternative_roles"]), F.array())
        .alias("alternative_roles"),
        F.coalesce(discovered_roles(a["ai_discovered_roles"]), F.array())
        .alias("ai_discovered_roles"),
        skill_names(a["strongest_transferable_skills"]).alias("strongest_transferable_skills"),
        skill_relevance(a["suggested_certifications"], "name").alias("suggested_certifications"),
        F.coalesce(a["universal_advice"], F.lit("")).alias("universal_advice"),
    )
    parsed = df.withColumn("_a", parse_tolerant(F.col(raw), ANSWER_SCHEMA))
    return parsed.withColumn(out, F.when(a.isNotNull(), answer)).drop("_a")
