"""Exact threshold join of vectors by pivots and the triangle inequality of angles.

A few right vectors are pivots; every right vector belongs to the nearest one and to a ring of angles around it. Rings
are cut into blocks of bounded rows. A left vector is sent only to blocks that may hold a vector within the
angle, by three bounds: the ring's least and greatest angle, the pivot's own range, and the nearest pivot (a vector
of another pivot's cell is at least half the difference of the two pivots' angles away). Inside a block the angle
to the pivot excludes single vectors before their product is formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.lists import bind
from talentgrid.functions.numeric import dot, unit
from talentgrid.operators.tables import BLOCK_ROWS, cut_plan, join_same

PIVOTS = 64  #: pivots, so the directory of rings is bounded
RING = 0.1  #: radians
SLACK = 1e-6  #: more than the rounding of an angle


def _units(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, u, n): guarded unit vectors and their lengths; vectors without a finite direction go."""
    both = bind(unit(F.col(vector)), lambda u: F.struct(u.alias("u"), F.sqrt(dot(u, u)).alias("n")))
    return df.select(F.col(ident).alias("id"), _once(both)).where("n > 0 AND n < 2")


def _once(fields: Column) -> Column:
    """Fields of a struct as columns that later lambdas read instead of computing them again."""
    return F.inline(F.array(fields))


def _angle(u: Column, n: Column, w: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, w) / n)))


def _cells(right: DataFrame, pivots: Column) -> DataFrame:
    """Right vectors with their cell: (id, u, copies, pivot, ring, d)."""
    same = right.groupBy("id", "u", "n").agg(F.count("*").cast("int").alias("copies"))
    near = F.array_min(F.transform("_p", lambda w, i: F.struct(_angle(F.col("u"), F.col("n"), w).alias("d"), i.alias("pivot"))))
    return same.withColumn("_p", pivots).withColumn("c", near).select(
        "id", "u", "copies", F.col("c.pivot").alias("pivot"), F.floor(F.col("c.d") / RING).cast("int").alias("ring"), F.col("c.d").alias("d"))


def _candidates(left: DataFrame, cells: DataFrame, pivots: Column, angle: float) -> DataFrame:
    """Left rows (id, u) with ``near``: the right vectors of one block that the bounds leave."""
    reach = angle + SLACK
    rings = cells.groupBy("pivot", "ring").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("subs"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    sub = F.pmod(F.xxhash64("id", "u"), F.col("subs")).cast("int")
    blocks = cells.join(rings.select("pivot", "ring", "subs"), ["pivot", "ring"]).withColumn("sub", sub).groupBy(
        "pivot", "ring", "sub").agg(F.collect_list(F.struct("id", "u", "d", "copies")).alias("rows"))
    # at most PIVOTS entries of pi / RING rings each
    directory = rings.groupBy("pivot").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("ring", "subs", "lo", "hi")).alias("rings")
    ).agg(F.collect_list(F.struct("pivot", "lo", "hi", "rings"))).scalar()

    def within(d: Column, e: Column) -> Column:
        return (d - reach <= e["hi"]) & (d + reach >= e["lo"])

    def at(e: Column) -> Column:
        return F.get("_d", e["pivot"])

    open_cells = F.filter("_dir", lambda e: within(at(e), e) & (at(e) - F.col("_least") <= 2 * reach))
    to = F.flatten(F.transform(open_cells, lambda e: F.transform(
        F.filter(e["rings"], lambda r: within(at(e), r)),
        lambda r: F.struct(e["pivot"].alias("pivot"), r["ring"].alias("ring"), r["subs"].alias("subs"), at(e).alias("d")))))
    angles = bind(F.transform("_p", lambda w: _angle(F.col("u"), F.col("n"), w)),
                  lambda d: F.struct(d.alias("_d"), F.array_min(d).alias("_least")))
    sent = left.withColumn("_p", pivots).select("id", "u", _once(angles)).withColumn("_dir", directory).select(
        "id", "u", F.explode(to).alias("t")).select(
        "id", "u", "t.pivot", "t.ring", F.col("t.d").alias("d"), F.explode(F.sequence(F.lit(0), F.col("t.subs") - 1)).alias("sub"))
    return sent.join(blocks, ["pivot", "ring", "sub"]).select(
        "id", "u", F.filter("rows", lambda r: F.abs(r["d"] - F.col("d")) <= reach).alias("near"))


def _parts(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vec: str, right_vec: str):
    lu, ru = _units(left, left_id, left_vec), _units(right, right_id, right_vec)
    w = F.transform("u", lambda x: x / F.col("n"))
    first = ru.select(F.md5(F.to_json(F.struct("id"))).alias("h"), w.alias("w")).orderBy("h", "w").limit(PIVOTS)
    pivots = first.agg(F.array_sort(F.collect_list(F.struct("h", "w")))["w"]).scalar()
    return lu, ru, cut_plan(_cells(ru, pivots)), pivots


def _scored(candidates: DataFrame) -> DataFrame:
    return candidates.select("id", F.explode(F.transform("near", lambda r: F.struct(
        dot(F.col("u"), r["u"]).alias("sim"), r["id"].alias("id"), r["copies"].alias("copies")))).alias("s"))


def threshold_links(left: DataFrame, right: DataFrame, left_id: str, right_id: str, min_sim: float = 0.6,
                    floor_sim: float = 0.3, left_vec: str = "vector", right_vec: str = "vector") -> DataFrame:
    """All right rows with cosine ≥ ``min_sim``; a left id without one keeps its single best (ties: the
    greater id) if that exceeds ``floor_sim``: (left_id, right_id, sim).

    The second search is run for the left ids without a link alone. The left side is read twice and must give the same
    vectors each time, as a table does; the right side is checkpointed with its cells. Null, zero and non-finite vectors have no link;
    repeated rows of either side have the links of each; null ids are an id. Both bounds are at least 0, the first
    is the greater.
    """
    if not 0 <= floor_sim <= min_sim <= 1 or min_sim == 0:
        raise ValueError("thresholds must satisfy 0 <= floor_sim <= min_sim <= 1 and min_sim > 0")
    lu, ru, cells, pivots = _parts(left, right, left_id, right_id, left_vec, right_vec)
    links = _scored(_candidates(lu, cells, pivots, math.acos(min_sim))).where(F.col("s.sim") >= min_sim)
    linked = links.select("id").distinct().withColumn("_linked", F.lit(True))
    alone = join_same(lu, linked, ["id"], "left").where("_linked IS NULL").drop("_linked")
    best = _scored(_candidates(alone, cells, pivots, math.acos(floor_sim))).where(F.col("s.sim") > floor_sim)
    # counted first, so that repeated rows of one id meet as numbers
    best = best.groupBy("id", "s").agg(F.count("*").cast("int").alias("rows")).groupBy("id").agg(
        F.max(F.struct("s.sim", "s.id", "rows")).alias("b")).select(
        "id", F.explode(F.array_repeat(F.struct("b.sim", "b.id"), F.col("b.rows"))).alias("s"))
    links = links.select("id", F.explode(F.array_repeat(F.struct("s.sim", "s.id"), F.col("s.copies"))).alias("s"))
    return links.unionByName(best).select(
        F.col("id").alias(left_id), F.col("s.id").alias(right_id), F.col("s.sim").alias("sim"))


def pairs_scored(left: DataFrame, right: DataFrame, left_id: str, right_id: str, min_sim: float = 0.6,
                 left_vec: str = "vector", right_vec: str = "vector") -> DataFrame:
    """One row (scored, pairs): how many products the search for ``min_sim`` forms, of how many pairs."""
    lu, ru, cells, pivots = _parts(left, right, left_id, right_id, left_vec, right_vec)
    scored = _candidates(lu, cells, pivots, math.acos(min_sim)).agg(
        F.coalesce(F.sum(F.size("near")), F.lit(0)).alias("scored"))
    return scored.withColumn("pairs", lu.agg(F.count("*")).scalar() * ru.agg(F.count("*")).scalar())
