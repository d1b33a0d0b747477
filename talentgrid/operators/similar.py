"""Similarity join of words with vocabulary keys by rare pieces, for edit distance and the matching-block ratio.

Pigeonhole: a pair within D operations leaves at least one of D + 1 disjoint pieces of the key whole, at a place in
the word that is shifted by at most D. D follows from the two lengths, so each key is indexed once for each
length of words by the D + 1 disjoint pieces that are rarest among the words (of one width, from 4 characters down
to 1, whichever is met least); frequent pieces such as a common prefix bring nothing together. Words are probed by
all their pieces; pairs meet on length and piece, within the shift, and only distinct pairs are scored.

Only the best key of a word is wanted, so the search deepens: a word that has a key at a high cutoff has its best
key there and leaves; the others go on at the next lower cutoff, where more pieces are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.operators.tables import cut_plan

WIDTHS = (4, 3, 2, 1)  #: characters of a piece
STEPS = (0.8, 0.75, 0.68)  #: cutoffs that are tried before the wanted one
_EPS = 1e-9


def _whole(c: Column) -> Column:
    return F.floor(c + _EPS).cast("int")


def operations(m: Column, n: Column, cutoff: float, metric: str) -> Column:
    """Most operations between strings of ``m`` and ``n`` characters that reach the cutoff: edits, or for the ratio
    characters outside its blocks."""
    return _whole((m + n) * (1 - cutoff)) if metric == "ratio" else _whole(F.greatest(m, n) * (1 - cutoff))


def share_of(cutoff: float, metric: str) -> float:
    """Least share of either string's characters that the other one keeps; bounds the lengths too."""
    return cutoff / (2 - cutoff) if metric == "ratio" else cutoff


def needed(n: Column, width: Column, most: Column, share: float) -> Column:
    """Disjoint pieces of a key of ``n`` characters of which one stays whole under ``most`` operations; a single
    character is lost only with itself, so fewer are needed where ``share`` bounds the loss."""
    return F.when(width == 1, F.least(most + 1, n - F.ceil(n * share - _EPS).cast("int") + 1)).otherwise(most + 1)


def pieces(df: DataFrame, col: str) -> DataFrame:
    """``col``, ``size``, ``width``, ``at`` and ``piece`` of all pieces of distinct strings that are not empty."""
    rows = df.select(col).where(F.col(col) != "").distinct().withColumn("size", F.length(col))

    def of(width: int) -> Column:
        places = F.when(F.col("size") >= width, F.sequence(F.lit(1), F.col("size") - width + 1)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(
            F.lit(width).alias("width"), i.alias("at"), F.substring(F.col(col), i, F.lit(width)).alias("piece")))

    of_all = F.flatten(F.array(*map(of, WIDTHS)))
    return rows.select(col, "size", F.explode(of_all).alias("p")).select(col, "size", "p.*")


def _disjoint(rows: Column, width: Column, count: Column) -> Column:
    """The first ``count`` of the rows (in order) that do not overlap one another."""
    none = F.array().cast("array<struct<met:bigint,at:int,piece:string>>")
    return F.aggregate(rows, none, lambda taken, r: F.when(
        (F.size(taken) < count) & ~F.exists(taken, lambda t: F.abs(t["at"] - r["at"]) < width),
        F.concat(taken, F.array(r))).otherwise(taken))


def signatures(keys: DataFrame, words: DataFrame, cutoff: float, metric: str) -> DataFrame:
    """``key``, ``size`` (of words), ``width``, ``piece``, ``key_at`` and ``shift``: for each key and length of words
    the pieces of the width whose rarest disjoint ones meet the fewest words. ``keys`` and ``words`` are piece tables."""
    share, n = share_of(cutoff, metric), F.col("size")
    met = words.groupBy("width", "piece").agg(F.count("*").alias("met"))
    rated = keys.join(met, ["width", "piece"], "left").groupBy("key", "size", "width").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("met", F.lit(0).cast("long")).alias("met"), "at", "piece"))).alias("rows"))
    sizes = F.sequence(F.greatest(F.lit(1), F.ceil(n * share - _EPS).cast("int")), _whole(n / share))
    most = F.array_distinct(F.transform(sizes, lambda m: operations(m, n, cutoff, metric)))
    rated = rated.withColumn("most", F.explode(most))
    rated = rated.withColumn("count", needed(n, F.col("width"), F.col("most"), share)).where(F.size("rows") >= F.col("count"))
    chosen = rated.withColumn("taken", _disjoint(F.col("rows"), F.col("width"), F.col("count")))
    cost = F.aggregate("taken", F.lit(0).cast("long"), lambda a, r: a + r["met"])
    order = F.struct(F.size("taken") < F.col("count"), cost, -F.col("width"))  # too few pieces come last
    best = chosen.groupBy("key", "size", "most").agg(F.min_by(F.struct("width", "taken"), order).alias("b"))
    best = best.select("key", "most", F.col("b.width").alias("width"), F.col("b.taken").alias("taken"), F.explode(F.filter(
        sizes, lambda m: operations(m, n, cutoff, metric) == F.col("most"))).alias("size"))
    return best.select("key", "size", "width", F.col("most").alias("shift"), F.explode("taken").alias("t")).select(
        "key", "size", "width", "shift", "t.piece", F.col("t.at").alias("key_at"))


def candidates(words: DataFrame, keys: DataFrame, cutoff: float, metric: str) -> DataFrame:
    """Distinct (``word``, ``key``) pairs among which are all that reach the cutoff; both inputs are piece tables."""
    met = words.join(signatures(keys, words, cutoff, metric), ["size", "width", "piece"])
    return met.where(F.abs(F.col("at") - F.col("key_at")) <= F.col("shift")).select("word", "key").distinct()


def best_keys(words: DataFrame, vocab: DataFrame, cutoff: float, metric: str, score) -> DataFrame:
    """``word``, ``key`` and ``score`` of the best key of each word that has one of at least the cutoff (ties: the
    greater key). ``score(pairs)`` adds the column ``score``; ``operations`` bounds it for the metric.

    Nulls and empty strings have no key.
    """
    left, keys = cut_plan(pieces(words, "word")), cut_plan(pieces(vocab, "key"))
    out = None
    for step in [*(s for s in STEPS if s > cutoff), cutoff]:
        scored = score(candidates(left, keys, step, metric)).where(F.col("score") >= step)
        found = cut_plan(scored.groupBy("word").agg(F.max(F.struct("score", "key")).alias("b")).select(
            "word", F.col("b.key").alias("key"), F.col("b.score").alias("score")))
        out = found if out is None else out.unionByName(found)
        left = left.join(found, "word", "left_anti")
    return out
