"""Row filters, recodes and projections over postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid import fixed_values as V
from talentgrid.functions.lists import string_map
from talentgrid.functions.text import detect_language, role_is_usable


def usable_roles(df: DataFrame, role: str = "role") -> DataFrame:
    return df.where(role_is_usable(F.col(role)))


def optional_filters(df: DataFrame, selections: dict[str, list]) -> DataFrame:
    """Keep rows whose column value is selected; an empty selection does not filter."""
    for col, values in selections.items():
        if values:
            df = df.where(F.col(col).isin(list(values)))
    return df


def drop_excluded_roles(df: DataFrame, role: str = "role", excluded=None) -> DataFrame:
    listed = F.col(role).isin(V.EXCLUDED_ROLES if excluded is None else list(excluded))
    return df.where(role_is_usable(F.col(role)) & ~listed)


def merge_roles(df: DataFrame, role: str = "role", merges: dict[str, str] | None = None) -> DataFrame:
    """Recode small roles to their nearest larger one; a literal map, so no join or shuffle."""
    m = string_map(V.ROLE_MERGES if merges is None else merges)
    return df.withColumn(role, F.coalesce(F.try_element_at(m, F.col(role)), F.col(role)))


def min_support(df: DataFrame, role: str = "role", rows: int = V.MIN_ROLE_ROWS) -> DataFrame:
    """Keep roles with at least ``rows`` rows. Counts are combined map-side and semi-joined, so a
    dominant role is not collected in one task as a window would."""
    kept = df.groupBy(role).agg(F.count("*").alias("_n")).where(F.col("_n") >= rows).select(role)
    return df.join(kept, role, "left_semi")


def with_skills(df: DataFrame, skills: str = "skills") -> DataFrame:
    return df.where(F.size(skills) > 0)


def impute_no_skills(df: DataFrame, skills: str = "skills", marker: str = "no_skills") -> DataFrame:
    filled = F.when(F.size(skills) == 0, F.array(F.lit(marker))).otherwise(F.col(skills))
    return df.withColumn(skills, filled)


def language_gate(df: DataFrame, text: str, stop_words: dict[str, list[str]], keep: str = "en",
                  lang: str | None = None) -> DataFrame:
    """Rows in one language: by a language column if there is one, else by stop-word scores."""
    code = F.col(lang) if lang else detect_language(F.col(text), stop_words)
    return df.where(code == keep)


def project_available(df: DataFrame, keep=None) -> DataFrame:
    """Project the kept columns that exist, adding a final title from the first title column."""
    keep = V.MODELLING_COLUMNS if keep is None else list(keep)
    titles = [c for c in ("standardizedTitle", "title") if c in df.columns]
    cols = [F.col(c) for c in keep if c in df.columns]
    if "final_role" not in df.columns and "final_role" in keep:
        first = F.coalesce(*[F.col(c) for c in titles], F.lit(""))
        cols.append(first.alias("final_role"))
    return df.select(*cols)


def modelling_table(df: DataFrame, skills: str = "skills", role: str = "role") -> DataFrame:
    """Excluded roles out, small roles merged, thin roles out, postings without skills out."""
    kept = min_support(merge_roles(drop_excluded_roles(df, role), role), role)
    return with_skills(kept, skills)
