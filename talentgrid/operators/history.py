"""Analysis history: an append-only log, and a state that later entries update in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.operators.tables import cut_plan
from talentgrid.session import finished_parts


def current_state(log: DataFrame, groups: dict[str, list[str]], key: str = "id", at: str = "updated_at",
                  stage: str = "stage", deleted: str = "deleted") -> DataFrame:
    """Latest values per id: each stage sets its own columns, its newest entry wins; ids with a
    deletion entry disappear. ``groups``: stage → columns. One map-side combined aggregation."""
    aggs = [F.max(F.col(stage) == deleted).alias("_gone"), F.min(at).alias("created_at"),
            F.max(at).alias("updated_at")]
    for name, cols in groups.items():
        mine = F.when(F.col(stage) == name, F.struct(*cols))
        order = F.when(F.col(stage) == name, F.struct(F.col(at), F.to_json(F.struct(*cols))))
        aggs.append(F.max_by(mine, order).alias(f"_{name}"))
    state = log.groupBy(key).agg(*aggs).where(~F.col("_gone"))
    flat = [F.col(f"_{n}.{c}").alias(f"{n}_{c}") for n, cols in groups.items() for c in cols]
    return state.select(key, "created_at", "updated_at", *flat)


def listing(state: DataFrame, user: str, user_id, newest_first: bool = True) -> DataFrame:
    """A user's analyses ordered by creation."""
    order = F.desc("created_at") if newest_first else F.asc("created_at")
    return state.where(F.col(user) == user_id).orderBy(order, "id")


def item(state: DataFrame, item_id) -> DataFrame:
    return state.where(F.col("id") == item_id)


class MaintainedState:
    """The current state of a growing log, kept in buckets of ids; an update reads its own entries and the buckets
    that these touch, nothing else.

    ``update`` writes the touched buckets anew as version n and then the list of the versions of all buckets; the
    list is used once its write has finished, so a reader sees all of an update or nothing, and a failed update
    leaves unused files. Values merge by newest entry and deletions stay as marks, so entries may come in any order
    and an update that is repeated changes nothing. ``groups``, ``key``, ``at``, ``stage``, ``deleted``: as for
    ``current_state``; a null key is an id of its own. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, groups: dict[str, list[str]], key: str = "id",
                 at: str = "updated_at", stage: str = "stage", deleted: str = "deleted", buckets: int = 64):
        self.spark, self.path, self.groups, self.key, self.buckets = spark, path.rstrip("/"), groups, key, buckets
        self.at, self.stage, self.deleted = at, stage, deleted

    def _versions(self) -> tuple[int, dict[int, int]]:
        """The newest version and, of each bucket that has rows, the version that holds it."""
        done = [int(n.split("=")[1]) for n in finished_parts(self.spark, f"{self.path}/lists")]
        if not done:
            return 0, {}
        rows = self.spark.read.parquet(f"{self.path}/lists/v={max(done)}").collect()  # one row a bucket
        return max(done), {r.bucket: r.version for r in rows}

    def files(self, buckets: set[int] | None = None) -> list[str]:
        """Folders of the given buckets' rows, or of all."""
        _, versions = self._versions()
        return [f"{self.path}/rows/v={v}/bucket={b}" for b, v in sorted(versions.items()) if buckets is None or b in buckets]

    def _rows(self, log: DataFrame) -> DataFrame:
        at = F.col(self.at)
        entries = [F.when(F.col(self.stage) == name, F.struct(
            at.alias("at"), F.to_json(F.struct(*cols)).alias("text"), F.struct(*cols).alias("values"))).alias(f"_{name}")
            for name, cols in self.groups.items()]
        return log.select(F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket"), self.key,
                          at.alias("created_at"), at.alias("updated_at"),
                          (F.col(self.stage) == self.deleted).alias("gone"), *entries)

    def _merged(self, rows: DataFrame) -> DataFrame:
        newest = [F.max_by(c, F.struct(f"{c}.at", f"{c}.text")).alias(c) for c in (f"_{n}" for n in self.groups)]
        return rows.groupBy("bucket", self.key).agg(
            F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
            F.max("gone").alias("gone"), *newest)

    def update(self, log: DataFrame) -> list[str]:
        """Merge entries; returns the folders of the old state that were read."""
        last, versions = self._versions()
        delta = cut_plan(self._merged(self._rows(log)))
        touched = {r.bucket for r in delta.select("bucket").distinct().collect()}  # at most one row a bucket
        if not touched:
            return []
        old, rows = self.files(touched), delta
        if old:
            kept = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*old).select(*delta.columns)
            rows = self._merged(kept.unionByName(delta))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/rows/v={last + 1}")
        table = {**versions, **dict.fromkeys(touched, last + 1)}
        self.spark.createDataFrame(sorted(table.items()), "bucket int, version int").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/lists/v={last + 1}")
        return old

    def current(self) -> DataFrame | None:
        """The columns of ``current_state``, of the ids that are not deleted; None before the first update."""
        files = self.files()
        if not files:
            return None
        flat = [F.col(f"_{n}.values.{c}").alias(f"{n}_{c}") for n, cols in self.groups.items() for c in cols]
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*files).where("NOT gone").select(
            self.key, "created_at", "updated_at", *flat)
