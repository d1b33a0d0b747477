"""Key resolution: synonyms, case-insensitive roles, cascades, containment and fuzzy keys."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from talentgrid import fixed_values as V
from talentgrid.functions.lists import bind, strip
from talentgrid.operators.containment import contained
from talentgrid.operators.similar import best_keys
from talentgrid.operators.tables import join_same


def synonyms(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Replace a value by its canonical form where the mapping (raw, canonical) has one."""
    m = mapping.select(F.col("raw").alias(col), "canonical")
    return df.join(m, col, "left").withColumn(
        col, F.coalesce("canonical", F.col(col))).drop("canonical")


def resolve_roles(requests: DataFrame, roles: DataFrame, col: str = "role") -> DataFrame:
    """Case- and blank-insensitive role resolution; ``resolved`` is null for unknown roles."""
    keyed = roles.select(F.lower(strip("role")).alias("_k"), F.col("role").alias("resolved"))
    return requests.withColumn("_k", F.lower(strip(F.col(col)))).join(
        keyed, "_k", "left").drop("_k")


def courses_for_role(roles: DataFrame, courses: DataFrame) -> DataFrame:
    """Courses whose category equals the role; roles without one get the courses whose category
    contains the first word of the role (both ignoring case)."""
    cats = courses.select("category").distinct()
    exact = roles.join(cats, roles.role == cats.category).select("role", "category")
    rest = roles.join(exact.select("role"), "role", "left_anti").withColumn(
        "_word", F.lower(F.substring_index("role", " ", 1)))
    named = cats.select(F.col("category").alias("id"), F.lower("category").alias("text"))
    words = rest.select(F.col("_word").alias("key"))
    loose = contained(named, words).join(rest, F.col("key") == F.col("_word")).select("role", F.col("id").alias("category"))
    # every category contains the empty word
    every = rest.where("_word = ''").select("role", F.lit(True).alias("_all")).join(
        cats.where("category IS NOT NULL").withColumn("_all", F.lit(True)), "_all").select("role", "category")
    return exact.unionByName(loose).unionByName(every).join(courses, "category")


def containment_category(df: DataFrame, text: str, taxonomy: DataFrame,
                         default: str = V.DEFAULT_CATEGORY) -> DataFrame:
    """Category of the exact key, else of the first key (by order) that contains the text or is
    contained in it, else the default. ``taxonomy``: key, key_order, category."""
    low = df.withColumn("_t", F.lower(strip(F.col(text))))
    values = low.select("_t").where("_t IS NOT NULL").distinct()
    known = taxonomy.where("key IS NOT NULL")
    entry = F.struct(F.when(F.col("key") == F.col("_t"), 0).otherwise(1).alias("q"), F.col("key_order").alias("o"),
                     F.col("category").alias("category"))
    inside = contained(values.select(F.col("_t").alias("id"), F.col("_t").alias("text")), known).withColumnRenamed("id", "_t")
    around = contained(known.select(F.col("key").alias("id"), F.col("key").alias("text")).distinct(),
                       values.select(F.col("_t").alias("key"))).select(F.col("key").alias("_t"), F.col("id").alias("key"))
    met = inside.unionByName(around).distinct().join(known, "key").groupBy("_t").agg(F.min(entry).alias("_b"))
    # the empty text is in every key, the empty key in every text: one entry each, the first
    lead = F.min(F.struct(F.lit(1).alias("q"), F.col("key_order").alias("o"), F.col("category").alias("category")))
    blank_key = known.where("key = ''").agg(lead).scalar()
    blank_text = known.agg(F.min(F.struct(F.when(F.col("key") == "", 0).otherwise(1).alias("q"),
                                          F.col("key_order").alias("o"), F.col("category").alias("category")))).scalar()
    best = values.join(met, "_t", "left").withColumn(
        "_b", F.when(F.col("_t") == "", blank_text).otherwise(F.least("_b", blank_key)))
    return join_same(low, best, ["_t"], "left").withColumn(
        "category", F.when(F.col("_b").isNotNull(), F.col("_b.category")).otherwise(default)).drop("_b", "_t")


# --- fuzzy keys -------------------------------------------------------------------

@pandas_udf(T.DoubleType())
def sequence_ratio(key: pd.Series, word: pd.Series) -> pd.Series:
    """Matching-block ratio of a vocabulary key against a word; no built-in computes it."""
    matcher, last, out = difflib.SequenceMatcher(), None, []
    for k, w in zip(key, word):
        if w != last:
            matcher.set_seq2(w)
            last = w
        matcher.set_seq1(k)
        out.append(matcher.ratio())
    return pd.Series(out)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 − Levenshtein distance over the longer length."""
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _char_tokens(s: Column) -> Column:
    """Characters tagged with their occurrence number."""
    return bind(F.split(s, ""), lambda chars: F.transform(chars, lambda c, i: F.concat(
        F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string"), c)))


def nearest_key(words: DataFrame, vocab: DataFrame, cutoff: float = 0.6,
                metric: str = "ratio") -> DataFrame:
    """Best vocabulary key per word with similarity ≥ cutoff (ties: the greater key).

    ``metric``: ``ratio`` (matching-block ratio) or ``edit`` (native Levenshtein similarity). Pairs are found by
    rare pieces (``similar``); for the ratio they must share enough characters before they are scored.
    """
    def edit(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("score", edit_similarity(F.col("word"), F.col("key")))

    def ratio(pairs: DataFrame) -> DataFrame:
        shared = F.size(F.array_intersect(_char_tokens(F.col("word")), _char_tokens(F.col("key"))))
        near = pairs.where(2 * shared >= cutoff * (F.length("word") + F.length("key")) - 1e-9)
        return near.withColumn("score", sequence_ratio("key", "word"))

    return best_keys(words, vocab, cutoff, metric, ratio if metric == "ratio" else edit)


def recognise(words: DataFrame, vocab: DataFrame, cutoff: float = 0.75, metric: str = "ratio") -> DataFrame:
    """Word → vocabulary key: exact when known, else the nearest key. Only unknown words are compared."""
    w = words.select(F.lower(strip("word")).alias("word")).distinct()
    v = vocab.select("key").distinct()
    exact = w.join(v, w.word == v.key, "left_semi").withColumn("key", F.col("word"))
    unknown = w.join(v, w.word == v.key, "left_anti")
    return exact.unionByName(nearest_key(unknown, vocab, cutoff, metric).select("word", "key"))


def recognised(rows: DataFrame, vocab: DataFrame, cutoff: float = 0.75, metric: str = "ratio") -> DataFrame:
    """Rows with ``skill`` replaced by the vocabulary's spelling: equal ignoring case and outer white space, else
    the nearest key. Rows without one go, repeated rows become one. Each different spelling is looked up once.
    """
    key = F.lower(strip("skill"))
    known = vocab.groupBy(key.alias("key")).agg(F.min("skill").alias("_known"))
    words = rows.select(key.alias("word")).distinct()
    found = recognise(words, known.select("key"), cutoff, metric).join(known, "key").select("word", "_known")
    return rows.withColumn("word", key).join(found, "word").withColumn("skill", F.col("_known")).drop(
        "word", "_known").distinct()


def mapping_cascade(source: DataFrame, target: DataFrame, curated: DataFrame, cutoff: float = 0.7,
                    metric: str = "ratio") -> DataFrame:
    """Source skill → target skill with the step that found it: curated (valid on both sides),
    exact, then nearest. ``source``/``target``: skill; ``curated``: skill, mapped."""
    tgt = target.select(F.col("skill").alias("mapped")).distinct()
    src = source.select("skill").distinct()
    c = curated.join(src, "skill", "left_semi").join(tgt, "mapped", "left_semi").select(
        "skill", "mapped").distinct()
    rest = src.join(c.select("skill"), "skill", "left_anti")
    exact = rest.join(tgt, rest.skill == tgt.mapped).select("skill", "mapped")
    unknown = rest.join(tgt, rest.skill == tgt.mapped, "left_anti")
    near = nearest_key(unknown.select(F.col("skill").alias("word")),
                       tgt.select(F.col("mapped").alias("key")), cutoff, metric)
    parts = [(c, "curated"), (exact, "exact"),
             (near.select(F.col("word").alias("skill"), F.col("key").alias("mapped")), "nearest")]
    out = None
    for df, step in parts:
        df = df.withColumn("step", F.lit(step))
        out = df if out is None else out.unionByName(df)
    return out


def category_cascade(words: DataFrame, taxonomy: DataFrame, aliases: DataFrame, cutoff: float = 0.8,
                     metric: str = "ratio", default: str = V.DEFAULT_CATEGORY) -> DataFrame:
    """Normalised name and category per word: taxonomy key, alias, nearest key, else the default.

    ``taxonomy``: key, category; ``aliases``: raw, canonical.
    """
    w = words.select(strip("word").alias("word"), F.lower(strip("word")).alias("low")).distinct()
    tax = taxonomy.select(F.col("key").alias("low"), F.col("category").alias("c1"))
    al = aliases.select(F.col("raw").alias("low"), "canonical")
    al_cat = taxonomy.select(F.col("key").alias("_ck"), F.col("category").alias("c2"))
    base = w.join(tax, "low", "left").join(al, "low", "left").withColumn(
        "_ck", F.lower("canonical")).join(al_cat, "_ck", "left")
    unknown = base.where("c1 IS NULL AND canonical IS NULL").select(F.col("low").alias("word"))
    near = nearest_key(unknown, taxonomy.select("key"), cutoff, metric).select(
        F.col("word").alias("low"), F.col("key").alias("near"))
    near = near.join(taxonomy.select(F.col("key").alias("near"), F.col("category").alias("c3")), "near")
    name = (F.when(F.col("c1").isNotNull(), F.coalesce("canonical", F.col("word")))
            .when(F.col("canonical").isNotNull(), F.col("canonical"))
            .when(F.col("near").isNotNull(), F.initcap("near")).otherwise(F.col("word")))
    cat = (F.when(F.col("c1").isNotNull(), F.col("c1"))
           .when(F.col("canonical").isNotNull(), F.coalesce("c2", F.lit(default)))
           .otherwise(F.coalesce("c3", F.lit(default))))
    return base.join(near, "low", "left").select("word", name.alias("name"), cat.alias("category"))
