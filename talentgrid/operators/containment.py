"""Containment join: which keys stand inside which texts, by an index of the keys' rarest grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4  #: characters of a gram; a shorter key is its own gram


def _grams(text: Column, n: int) -> Column:
    """All strings of ``n`` characters in a text, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _gram_rows(keys: DataFrame) -> DataFrame:
    """Rows (key, gram) of non-empty keys."""
    size = F.length("key")
    own = _grams(F.col("key"), GRAM)
    for n in range(GRAM - 1, 0, -1):
        own = F.when(size == n, _grams(F.col("key"), n)).otherwise(own)
    return keys.select("key").where(size > 0).distinct().select("key", F.explode(F.array_distinct(own)).alias("gram"))


def _host_grams(hosts: DataFrame, key_grams: DataFrame) -> DataFrame:
    """Rows (id, gram) of the grams that are grams of keys too; only lengths that keys have are formed."""
    lengths = key_grams.agg(F.collect_set(F.least(F.length("key"), F.lit(GRAM)))).scalar()
    none = F.array().cast("array<string>")
    parts = [F.when(F.array_contains(lengths, F.lit(n)), _grams(F.col("text"), n)).otherwise(none)
             for n in range(1, GRAM + 1)]
    rows = hosts.select("id", F.explode(F.array_distinct(F.concat(*parts))).alias("gram"))
    return rows.join(key_grams.select("gram").distinct(), "gram", "left_semi")


def contained(hosts: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs (id, key) of texts and the keys that are substrings of them.

    ``hosts``: id, text, an id for each different text; ``keys``: key. A key is looked up by the one of its grams that
    the fewest texts have, so texts meet only keys whose rarest gram they hold, and a key with a gram that no text has
    meets none; what meets is tested with ``contains``. Null and empty keys and texts are in no pair, repeated keys
    are one. A frequent gram is a join key like others, which the adaptive planner splits.
    """
    grams = _gram_rows(keys)
    found = _host_grams(hosts, grams)
    counts = found.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(counts, "gram", "left").groupBy("key").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select(
        "key", F.col("r.gram").alias("gram"))
    met = found.join(rarest, "gram").select("id", "key")
    return met.join(hosts.select("id", "text"), "id").where(F.contains("text", "key")).select("id", "key")
