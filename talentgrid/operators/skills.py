"""Dictionary skill extraction from free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid import fixed_values as V
from talentgrid.functions.tokens import NON_WORD, WORD, word_grams

HITS = "array<struct<start:int,stop:int,skill:string>>"


def build_dictionary(surfaces: DataFrame, extra=None, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(surface, canonical): dictionary entries, fixed additions and alias → canonical rows.

    A later entry for the same surface (ignoring case) wins, as in a keyword processor.
    """
    spark = surfaces.sparkSession
    extra = V.EXTRA_DICTIONARY if extra is None else extra
    aliases = V.DICTIONARY_ALIASES if aliases is None else aliases
    fixed = [(s, s, 1) for s in extra] + [(a, c, 2) for c, al in aliases.items() for a in al]
    base = surfaces.select(F.trim("surface").alias("surface")).where("surface <> ''").select(
        "surface", F.col("surface").alias("canonical"), F.lit(0).alias("rank"))
    if fixed:
        base = base.unionByName(spark.createDataFrame(fixed, "surface string, canonical string, rank int"))
    return base.groupBy(F.lower("surface").alias("surface")).agg(
        F.max_by("canonical", F.struct("rank", "canonical")).alias("canonical"))


def dictionary_hits(docs: DataFrame, doc_id: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Every whole-phrase occurrence of a dictionary surface: (doc_id, start, stop, skill).

    A document emits its word sequences of the lengths that phrases have, and these meet the phrases by
    equality; the text between and around the words, which the sequence carries, is then checked. A common
    first word or a long phrase makes no other rows than those of its own length.
    """
    words = F.regexp_extract_all(F.lower("surface"), F.lit(f"{WORD}+"), F.lit(0))
    phrases = dictionary.select(
        F.lower("surface").alias("phrase"), F.col("canonical").alias("skill"), words.alias("w"),
        F.length(F.regexp_extract("surface", f"^{NON_WORD}*", 0)).alias("skip"),
    ).where(F.size("w") > 0).select("phrase", "skill", "skip", F.array_join("w", " ").alias("gram"), F.size("w").alias("n"))
    lengths = phrases.agg(F.coalesce(F.array_sort(F.collect_set("n")), F.array().cast("array<int>"))).scalar()
    grams = docs.withColumn("_n", lengths).select(
        doc_id, F.explode(word_grams(F.col(text), F.col("_n"))).alias("t")).select(doc_id, "t.*")
    at = F.col("lead") - F.col("skip")
    n = F.length("phrase")
    same = F.lower(F.substring("context", at + 1, n)) == F.col("phrase")
    after = F.substring("context", at + n + 1, F.lit(1))
    begin = F.col("start") - F.col("skip")
    open_before = (F.col("skip") == 0) | (at > 0) | (begin == 0)
    return (
        grams.join(phrases.drop("n"), "gram").where((at >= 0) & same & ~after.rlike(WORD) & open_before)
        .select(doc_id, begin.alias("start"), (begin + n).alias("stop"), "skill"))


def leftmost_longest(hits: DataFrame, doc_id: str) -> DataFrame:
    """Resolve overlaps per document: leftmost first, then longest."""
    ordered = F.array_sort(F.collect_list(F.struct(
        "start", (-F.col("stop")).alias("m"), "skill")))
    per_doc = hits.groupBy(doc_id).agg(ordered.alias("hits"))

    def step(acc, h):
        free = h["start"] >= acc["last"]
        one = F.array(F.struct(h["start"].alias("start"), (-h["m"]).alias("stop"), h["skill"].alias("skill")))
        return F.struct(
            F.when(free, -h["m"]).otherwise(acc["last"]).alias("last"),
            F.when(free, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("last"), F.array().cast(HITS).alias("out"))
    kept = F.aggregate("hits", zero, step, lambda acc: acc["out"])
    return per_doc.select(doc_id, F.inline(kept))


def extract_skills(docs: DataFrame, doc_id: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Distinct canonical skills per document and their count; documents without hits get none."""
    found = leftmost_longest(dictionary_hits(docs, doc_id, text, dictionary), doc_id)
    lists = found.groupBy(doc_id).agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    return docs.select(doc_id).join(lists, doc_id, "left").select(
        doc_id, F.coalesce("skills", F.array().cast("array<string>")).alias("skills")
    ).withColumn("skill_count", F.size("skills"))


def first_occurrences(docs: DataFrame, doc_id: str, text: str, dictionary: DataFrame,
                      min_chars: int = 50) -> DataFrame:
    """First whole-phrase occurrence of each known skill in documents of at least 50 characters."""
    long_docs = docs.where(F.length(F.trim(text)) >= min_chars)
    return dictionary_hits(long_docs, doc_id, text, dictionary).groupBy(doc_id, "skill").agg(
        F.min_by(F.struct("start", "stop"), F.struct("start", -F.col("stop"))).alias("h")
    ).select(doc_id, "skill", "h.start", "h.stop")
