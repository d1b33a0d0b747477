"""Incremental ingest and period counts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.session import finished_parts


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str,
           checkpoint: str) -> None:
    """Process the files that arrived since the last run and append the result.

    The checkpoint holds which files are done, so a restart neither repeats nor skips any."""
    query = (
        transform(stream).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
    query.awaitTermination()


def period_counts(rows: DataFrame, at: str, *by: str, period: str = "1 day") -> DataFrame:
    """Counts per tumbling window of the rows at hand: ``period``, the groups and ``n``."""
    timed = rows.withColumn("_ts", F.col(at).cast("timestamp"))
    return timed.groupBy(F.window("_ts", period).alias("w"), *by).agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("period"), *by, "n")


class CountLog:
    """Counts that any later delivery may add to, as a log of partial counts that merge by addition.

    A batch writes its own counts once, as ``deltas/batch=<id>``: a batch that is repeated after a failure replaces
    its part, so nothing counts twice, and a row counts in its period however late it comes. The stream keeps no
    state. ``compact`` adds up the log into the next base; a base is used from the moment that its mark is written,
    and it names the last batch that it holds, so a reader adds exactly the later batches, whatever a failed run
    left behind. Parts of one base or batch are never changed once they count.
    """

    def __init__(self, spark: SparkSession, path: str, by: list[str]):
        self.spark, self.path, self.by = spark, path.rstrip("/"), list(by)

    def _names(self, part: str) -> list[str]:
        return finished_parts(self.spark, f"{self.path}/{part}")

    def base(self) -> int | None:
        """The last batch of the newest base; None before the first one."""
        return max((int(n.split("=")[1]) for n in self._names("bases")), default=None)

    def add(self, counts: DataFrame, batch_id: int) -> None:
        """Write the counts of one batch; batches up to the base are part of it and stay out."""
        base = self.base()
        if base is None or batch_id > base:
            counts.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")

    def _parts(self) -> list[str]:
        base = self.base()
        later = [n for n in self._names("deltas") if base is None or int(n.split("=")[1]) > base]
        return [f"{self.path}/deltas/{n}" for n in later] + ([] if base is None else [f"{self.path}/bases/upto={base}"])

    def read(self) -> DataFrame | None:
        """``period``, the groups and ``n`` of all batches; None while there is none."""
        parts = self._parts()
        return self.spark.read.parquet(*parts).groupBy("period", *self.by).agg(F.sum("n").alias("n")) if parts else None

    def compact(self) -> None:
        """Add all parts up into a new base; readers keep seeing the old parts until it is complete."""
        batches = [int(n.split("=")[1]) for n in self._names("deltas")]
        if batches and (self.base() is None or max(batches) > self.base()):
            self.read().write.mode("overwrite").parquet(f"{self.path}/bases/upto={max(batches)}")


def add_counts(stream: DataFrame, at: str, log: CountLog, checkpoint: str, period: str = "1 day") -> None:
    """Count what arrived since the last run into the log, batch by batch."""
    query = (
        stream.writeStream.foreachBatch(
            lambda batch, batch_id: log.add(period_counts(batch, at, *log.by, period=period), batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
