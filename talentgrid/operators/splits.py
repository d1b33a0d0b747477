"""Reproducible splits, samples and drawn tables.

Order comes from a seeded hash of the key, so results are the same on every run and cluster size.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.numeric import saturate
from talentgrid.operators.tables import cut_plan, hash_ranked, seeded_hash, top_n, with_totals

DRAW_ROWS = 256  #: profiles of a role that a group of a weighted sample holds
DRAW_SKILLS = 1 << 15  #: skills of a role's pool that it holds


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform number in (0, 1) from keys and a seed, by md5: the same in every engine."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def stratified_split(df: DataFrame, key: str, by: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Exact share of every group into train, the rest into test."""
    ranked = hash_ranked(df, key, seed, [by])
    cut = F.floor(F.col("group_rows") * train)
    return ranked.withColumn("split", F.when(F.col("rank") <= cut, "train").otherwise("test")).drop(
        "rank", "group_rows")


def three_way_split(df: DataFrame, key: str, seed: int = 42, hold_out: float = 0.3) -> DataFrame:
    """70/15/15: the hold-out share is rounded up and halved, the test half rounded up."""
    ranked = hash_ranked(df, key, seed)
    n = F.col("group_rows")
    held = F.ceil(n * hold_out - 1e-9)
    train = n - held
    test = F.ceil(held / 2)
    split = F.when(F.col("rank") <= train, "train").when(
        F.col("rank") <= train + held - test, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("rank", "group_rows")


def document_split(docs: DataFrame, key: str = "doc_id", source: str = "source", seed: int = 42,
                   val: float = 0.12, test: float = 0.08) -> DataFrame:
    """Curated documents 80/12/8; silver and synthetic documents only train. Documents of other sources belong to
    no split and are left out, as the inventory asks."""
    curated = hash_ranked(docs.where(F.col(source) == "curated"), key, seed)
    n = F.col("group_rows")
    n_val = F.greatest(F.lit(1), F.bround(n * val).cast("long"))
    n_test = F.greatest(F.lit(1), F.bround(n * test).cast("long"))
    split = F.when(F.col("rank") <= n - n_val - n_test, "train").when(
        F.col("rank") <= n - n_test, "val").otherwise("test")
    rest = docs.where(F.col(source).isin("silver", "synthetic")).withColumn("split", F.lit("train"))
    return curated.withColumn("split", split).drop("rank", "group_rows").unionByName(rest)


def sized_split(df: DataFrame, key: str, seed: int = 42, val: float = 0.12, test: float = 0.08,
                at_least: int = 50, max_train: int | None = None) -> DataFrame:
    """Shuffle and cut into train, val and test of fixed sizes; ``max_train`` ends train early and
    the other parts follow at once (rows after them belong to no split)."""
    ranked = hash_ranked(df, key, seed)
    n = F.col("group_rows")
    n_test = F.greatest(F.floor(n * test), F.lit(at_least))
    n_val = F.greatest(F.floor(n * val), F.lit(at_least))
    n_train = n - n_val - n_test
    if max_train:
        n_train = F.least(n_train, F.lit(max_train))
    r = F.col("rank")
    split = F.when(r <= n_train, "train").when(r <= n_train + n_val, "val").when(
        r <= n_train + n_val + n_test, "test")
    return ranked.withColumn("split", split).where("split IS NOT NULL").drop("rank", "group_rows")


def shuffled_take(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in seeded-hash order."""
    order = seeded_hash(F.col(key), seed)
    return top_n(df.withColumn("_h", order), n, F.asc("_h"), F.asc(key)).drop("_h")


def role_pools(frequency: DataFrame) -> DataFrame:
    """Per role: its skills with weights as one array (bounded by the vocabulary)."""
    pool = F.array_sort(F.collect_list(F.struct("skill", F.col("freq").alias("w"))))
    return frequency.groupBy("role").agg(pool.alias("pool"))


def _draw(needs: pa.Table, pool: pa.Table, seed: int) -> pa.Table:
    """For each need its ``n`` smallest keys -ln(u)/w of a piece of its role's pool (more where the last ones tie);
    ``u`` is ``uniform(seed, profile_id, skill)``, taken from the bytes of the digests."""
    places, sizes, keys = [], [], []
    skills = pa.array([], pa.string())
    if needs.num_rows and pool.num_rows:
        entries = pa.concat_arrays([c.flatten() for c in pool.column("pool").chunks])
        skills = entries.field("skill")
        tails = ["|".join([*([] if s is None else [s]), str(seed)]).encode() for s in skills.to_pylist()]
        weights = entries.field("w").to_numpy(zero_copy_only=False).astype(float)
        for me, n, weighted in zip(*(needs.column(c).to_pylist() for c in ("me", "n", "weighted"))):
            head = b"" if me is None else me.encode() + b"|"
            digests = b"".join([md5(head + t, usedforsecurity=False).digest() for t in tails])
            bits = np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)
            k = -np.log((bits.astype(float) + 0.5) / float(1 << 52)) / (weights if weighted else 1.0)
            some = np.flatnonzero(k <= np.partition(k, n - 1)[n - 1]) if n < len(k) else np.arange(len(k))
            places.append(some)
            sizes.append(len(some))
            keys.append(k[some])
    met = needs.select(["profile_id", "role", "n", "weighted"]).slice(0, len(sizes))
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
    flat = pa.StructArray.from_arrays([
        pa.array(np.concatenate([np.zeros(0), *keys])),
        skills.take(pa.array(np.concatenate([np.zeros(0, np.int64), *places])))], ["k", "skill"])
    return met.append_column("drawn", pa.ListArray.from_arrays(ends, flat))


def weighted_sample(profiles: DataFrame, pools: DataFrame, size: Column, seed: int = 42,
                    weighted: Column | None = None) -> DataFrame:
    """Skills drawn without replacement per profile, by role frequency (or uniformly where
    ``weighted`` is false): smallest −ln(u)/w keys first. One row per profile, no candidate rows.

    Every profile meets every skill of its role, as the draw is defined; groups of (profiles, pool piece) of
    bounded size are dealt to tasks, and the smallest keys of the pieces are brought together."""
    use_w = F.lit(True) if weighted is None else F.coalesce(weighted, F.lit(False))
    keys = ["profile_id", "role", "n", "weighted"]
    starts = F.sequence(F.lit(0), F.greatest(F.size("pool") - 1, F.lit(0)), F.lit(DRAW_SKILLS))
    pieces = cut_plan(pools.select(F.col("role").alias("role"), F.size(starts).alias("pieces"), F.posexplode(
        F.transform(starts, lambda i: F.slice("pool", i + 1, DRAW_SKILLS))).alias("piece", "pool")))
    rows = profiles.join(pieces.where("piece = 0").select("role"), "role", "left_semi").select(
        "role", *[c for c in profiles.columns if c != "role"], F.struct(size.cast("int").alias("n"), use_w.alias("weighted")).alias("_draw"))
    # equal rows draw the same; rows without a size draw nothing
    needs = rows.select("profile_id", "role", "_draw.*").where("n > 0").distinct()
    needs = cut_plan(with_totals(needs, ["role"], F.ceil(F.count("*") / DRAW_ROWS).cast("int").alias("chunks")).select(
        *keys, F.col("profile_id").cast("string").alias("me"),
        F.pmod(F.xxhash64("profile_id", "n"), F.col("chunks")).cast("int").alias("chunk"), "chunks"))
    left = needs.join(pieces.select("role", "pieces").distinct(), "role").select(
        *keys, "me", "chunk", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    right = pieces.join(needs.select("role", "chunks").distinct(), "role").select(
        "role", "piece", "pool", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    group = ["role", "chunk", "piece"]
    kind = needs.schema["profile_id"].dataType.simpleString()
    drawn = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
        lambda a, b: _draw(a, b, seed),
        f"profile_id {kind}, role string, n int, weighted boolean, drawn array<struct<k:double,skill:string>>")
    drawn = drawn.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("drawn"))).alias("_drawn")).select(
        F.struct("profile_id", "role").alias("_of"), F.struct("n", "weighted").alias("_by"), "_drawn")
    same = F.col("profile_id").eqNullSafe(F.col("_of.profile_id")) & (F.col("role") == F.col("_of.role")) & (
        F.col("_draw.n") == F.col("_by.n")) & (F.col("_draw.weighted") == F.col("_by.weighted"))
    none = F.array().cast("array<struct<k:double,skill:string>>")
    first = F.slice(F.coalesce("_drawn", none), F.lit(1), F.col("_draw.n"))
    owned = F.array_sort(F.transform(first, lambda d: d["skill"])).alias("owned")
    return rows.join(drawn, same, "left").select("role", *[c for c in profiles.columns if c != "role"], owned)


def weighted_choice(df: DataFrame, key: str, choices: DataFrame, value: str, weight: str,
                    seed: int = 42) -> DataFrame:
    """One categorical draw per row with probability proportional to the weight.

    The choices (roles) are few: their cumulative shares are one array."""
    lists = choices.agg(F.array_sort(F.collect_list(F.struct(value, weight))).alias("c"))
    arr = lists.select("c").scalar()
    rows = df.withColumn("_c", arr)
    total = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x[weight])
    target = uniform(seed, F.col(key)) * total
    walk = F.aggregate(
        "_c", F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("v")),
        lambda a, x: F.struct(
            (a["sum"] + x[weight]).alias("sum"),
            F.when(a["v"].isNull() & (a["sum"] + x[weight] >= target), x[value]).otherwise(a["v"]).alias("v")))
    return rows.withColumn(value, walk["v"]).drop("_c")


def profile_targets(profiles: DataFrame, frequency: DataFrame, scaled: DataFrame, seed: int = 42,
                    realistic: float = 0.8, smallest: int = 2, largest: int = 12) -> DataFrame:
    """Drawn profiles with priority targets of the skills they lack.

    A share of the profiles draws by role frequency, the others uniformly. ``profiles``:
    profile_id, role; ``scaled``: role, skill, scaled tf-idf.
    """
    me = F.col("profile_id")
    size = F.floor(uniform(seed + 1, me) * (largest - smallest + 1)) + smallest
    drawn = weighted_sample(profiles, role_pools(frequency), size, seed,
                            weighted=uniform(seed + 2, me) < realistic)
    goals = scaled.select("role", "skill", saturate(F.col("scaled")).alias("target")).groupBy("role").agg(
        F.array_sort(F.collect_list(F.struct("skill", "target"))).alias("goals"))
    rows = drawn.join(goals, "role")
    lacking = F.filter("goals", lambda g: ~F.array_contains("owned", g["skill"]))
    return rows.select("profile_id", "role", "owned", lacking.alias("targets"))


def demand_rows(demands: DataFrame, sizes: DataFrame, role_skills: DataFrame, mapping: DataFrame,
                course_skills: DataFrame, seed: int = 42) -> DataFrame:
    """Per demand: a role drawn by posting count, its top skills and one overlapping course drawn
    uniformly. Valid courses are numbered per role, so the draw is an equi-join on a number."""
    from talentgrid.operators.gap import equivalents

    drawn = weighted_choice(demands, "demand_id", sizes, "role", "role_jobs", seed)
    valid = equivalents(role_skills.select("role", "skill"), mapping, course_skills).join(
        course_skills.select("course_id", "skill"), "skill").select("role", "course_id").distinct()
    numbered = hash_ranked(valid, "course_id", seed, ["role"], rank="number", size="valid")
    n_valid = numbered.groupBy("role").agg(F.first("valid").alias("valid"))
    skills = role_skills.groupBy("role").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    number = F.floor(uniform(seed + 3, F.col("demand_id")) * F.col("valid")) + 1
    picked = drawn.join(n_valid, "role").withColumn("number", number)
    return picked.join(numbered.select("role", "number", "course_id"), ["role", "number"]).join(
        skills, "role").select("demand_id", "role", "skills", "course_id")
