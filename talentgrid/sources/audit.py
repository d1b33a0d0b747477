"""Parse audits: rows that a schema cannot read are counted in the pass that reads the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def read_audited(spark: SparkSession, path: str, fmt: str, schema: str, **options) -> DataFrame:
    """Every record of CSV or JSON files, with the raw text of those that do not parse in ``_corrupt_record``."""
    whole = {"columnPruning": False} if fmt == "csv" else {}  # a pruned parser would not see all faults
    return spark.read.format(fmt).schema(f"{schema}, {CORRUPT} string").options(
        mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **whole, **options).load(path)


def _unparsed(df: DataFrame) -> Column:
    """How many records do not parse. It reads all columns, so that no column is left unparsed."""
    others = [F.col(f"`{c}`") for c in df.columns if c != CORRUPT]
    return F.count(F.when(F.col(CORRUPT).isNotNull(), F.xxhash64(*others)))


def parsed(df: DataFrame, seen: Observation | None = None) -> DataFrame:
    """The records that parse. ``seen`` gets ``rows`` and ``unparsed`` from whichever job reads them first."""
    if seen is not None:
        df = df.observe(seen, F.count("*").alias("rows"), _unparsed(df).alias("unparsed"))
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def parse_gates(name: str, df: DataFrame) -> DataFrame:
    """Gates ``rows:<name>`` and ``rows_parse:<name>`` of audited records, in one pass: check, passed, detail."""
    counts = df.agg(F.count("*").alias("rows"), _unparsed(df).alias("unparsed"))

    def row(check: str, passed: Column, value: str) -> Column:
        return F.struct(F.lit(f"{check}:{name}").alias("check"), passed.alias("passed"),
                        F.col(value).cast("string").alias("detail"))

    return counts.select(F.inline(F.array(row("rows", F.col("rows") > 0, "rows"),
                                          row("rows_parse", F.col("unparsed") == 0, "unparsed"))))
