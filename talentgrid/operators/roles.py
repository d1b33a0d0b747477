"""Role labelling by weighted keywords.

Rules are a table (role, role_order, keyword, keyword_order); the rule set is the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid import fixed_values as V
from talentgrid.functions.text import norm_text
from talentgrid.operators.containment import contained


def rules_table(spark, rules: dict[str, list[str]]) -> DataFrame:
    rows = [(r, i, k, j) for i, (r, ks) in enumerate(rules.items()) for j, k in enumerate(ks)]
    return spark.createDataFrame(rows, "role string, role_order int, keyword string, keyword_order int")


def _role_rows(rules: DataFrame) -> DataFrame:
    """One row per role with its keywords in order."""
    return rules.groupBy("role_order", "role").agg(
        F.array_sort(F.collect_list(F.struct("keyword_order", "keyword"))).alias("k")
    ).select("role_order", "role", F.col("k.keyword").alias("keywords"))


def keyword_hits(df: DataFrame, fields: list[str], rules: DataFrame) -> DataFrame:
    """Input rows with ``hits``: per role the first keyword contained in each field (null if none).

    A raw substring test on lowercase text. Different texts meet the keywords by an index of rare grams
    (``contained``); hits come back to the rows by the texts' digest: one row for each input row at any size. The
    empty keyword is in every text that is not null.
    """
    roles = _role_rows(rules)
    every = roles.agg(F.array_sort(F.collect_list(F.struct("role_order", "role", "keywords")))).scalar()
    texts = df.withColumn("_texts", F.array(*[norm_text(F.col(f)) for f in fields]))
    texts = texts.withColumn("_d", F.sha2(F.to_json(F.struct("_texts")), 256))
    values = texts.select("_d", "_texts").dropDuplicates(["_d"])
    places = values.select("_d", F.posexplode("_texts").alias("i", "text")).select(
        F.struct("_d", "i").alias("id"), "text").where("text IS NOT NULL")
    words = roles.select(F.explode("keywords").alias("key")).distinct()
    found = contained(places, words).groupBy(F.col("id._d").alias("_d")).agg(
        F.collect_set(F.struct(F.col("id.i").alias("i"), "key")).alias("_found"))  # bounded by the keywords

    def first(role: Column, i: int) -> Column:
        word = F.filter(role["keywords"], lambda k: F.array_contains(F.get("_in", F.lit(i)), k) | (
            (k == "") & F.get("_texts", F.lit(i)).isNotNull()))
        return F.get(word, F.lit(0))

    def inside(i: int) -> Column:
        return F.transform(F.filter("_found", lambda x: x["i"] == i), lambda x: x["key"])

    held = F.array(*[F.coalesce(inside(i), F.array().cast("array<string>")) for i in range(len(fields))])
    hits = F.transform("_roles", lambda r: F.struct(
        r["role_order"].alias("role_order"), r["role"].alias("role"),
        F.array(*[first(r, i) for i in range(len(fields))]).alias("words")))
    return texts.join(found, "_d", "left").withColumn("_in", held).withColumn("_roles", every).withColumn(
        "hits", hits).drop("_d", "_texts", "_found", "_in", "_roles")


def classify_roles(df: DataFrame, row_id: str, rules: DataFrame,
                   weights: list[tuple[str, int]] | None = None) -> DataFrame:
    """Best role per row: label, score, source field and first keyword.

    One hit per field counts its weight; the earliest declared role wins a tie; no hit gives the
    fallback label. Whole texts are searched.
    """
    weights = weights or V.FIELD_WEIGHTS
    fields = [f for f, _ in weights if f in df.columns]
    w = dict(weights)
    scored = keyword_hits(df.select(row_id, *fields), fields, rules)

    def score(h: Column) -> Column:
        total = F.lit(0)
        for i, f in enumerate(fields):
            total = total + F.when(F.get(h["words"], F.lit(i)).isNotNull(), w[f]).otherwise(0)
        return total

    best = F.array_max(F.transform("hits", lambda h: F.struct(
        score(h).alias("score"), (-h["role_order"]).alias("o"), h["role"].alias("role"),
        h["words"].alias("words"))))
    top = scored.select(row_id, best.alias("b"))
    pos = F.array_position(F.transform("b.words", lambda x: x.isNotNull()), True)
    hit = F.coalesce(F.col("b.score"), F.lit(0)) > 0
    return top.select(
        row_id,
        F.when(hit, F.col("b.role")).otherwise(V.FALLBACK_ROLE).alias("role_label"),
        F.when(hit, F.col("b.score")).otherwise(0).alias("label_score"),
        F.when(hit, F.get(F.array(*[F.lit(f) for f in fields]), (pos - 1).cast("int")))
        .otherwise(V.FALLBACK_SOURCE).alias("label_source"),
        F.when(hit, F.get("b.words", (pos - 1).cast("int"))).otherwise(V.FALLBACK_KEYWORD)
        .alias("label_keyword"))


def role_summary(rules: DataFrame, labelled: DataFrame, role: str = "role_label") -> DataFrame:
    """Every declared role with id R01…, its keywords joined by ``; `` and its row count (0 filled)."""
    counts = labelled.groupBy(F.col(role).alias("role")).agg(F.count("*").alias("total_rows"))
    roles = _role_rows(rules).select(
        F.concat(F.lit("R"), F.lpad((F.col("role_order") + 1).cast("string"), 2, "0")).alias("role_id"),
        "role", F.array_join("keywords", "; ").alias("keywords"))
    return roles.join(counts, "role", "left").fillna(0, ["total_rows"])
