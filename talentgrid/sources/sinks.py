"""File sinks and resumable enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from talentgrid.session import finished_parts


def write_csv(df: DataFrame, path: str, **options) -> None:
    """Tabular text sink with a header and no index; text columns are quoted and escaped."""
    opts = {"header": True, "quote": '"', "escape": "\\", "escapeQuotes": True, **options}
    df.write.mode("overwrite").options(**opts).csv(path)


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON record per line."""
    df.write.mode("overwrite").json(path)


def write_map_document(df: DataFrame, key: str, value: str, path: str) -> None:
    """A small lookup table (vocabulary, synonym rules) as one JSON map document.

    The format itself is one document; tables that grow with the data belong in ``write_jsonl``."""
    entries = F.array_sort(F.collect_list(F.struct(key, value)))
    doc = df.agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    doc.write.mode("overwrite").text(path)


def resume_enrichment(df: DataFrame, key: str, column: str, expression: Column, path: str) -> int:
    """Enrich only rows whose key is not yet in the output and append them.

    A restart continues after what is written: finished keys are anti-joined. Returns how many
    rows were waiting."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        todo = df.join(done, key, "left_anti")
    except Exception as exc:  # no output yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        todo = df
    seen = Observation()
    enriched = todo.observe(seen, F.count("*").alias("rows")).withColumn(column, expression)
    enriched.write.mode("append").parquet(path)
    return seen.get["rows"]


def _attempted(batches: Iterator[pa.RecordBatch], function: Callable, source: str, column: str,
               attempts: int) -> Iterator[pa.RecordBatch]:
    for given in batches:
        values, errors = [], []
        for value in given.column(source).to_pylist():
            out, error = None, None
            for _ in range(attempts):
                try:
                    out, error = function(value), None
                    break
                except Exception as exc:  # any failure of a row is a result of that row
                    error = f"{type(exc).__name__}: {exc}"
            values.append(value if out is None else out)
            errors.append(error)
        yield pa.RecordBatch.from_arrays(
            [*given.columns, pa.array(values, pa.string()), pa.array(errors, pa.string())],
            [*given.schema.names, column, f"{column}_error"])


def enrich_by_attempts(df: DataFrame, key: str, source: str, column: str, function: Callable[[str], str | None],
                       path: str, attempts: int = 2, batches: int = 16) -> int:
    """Enrich the rows of one delivery with a function that may fail; returns how many batches this run wrote.

    ``function`` gets the text of ``source``. A row that fails ``attempts`` times keeps its source text, with the
    cause in ``<column>_error``; so does, without a cause, a row for which it returns nothing. Rows are dealt to
    batches by a hash of the key, and a batch is one folder. Finished folders are the ledger of a restart: they are
    neither read nor run again, and a folder without the mark of a finished write is written anew, so a crash at any
    point leaves one result a row. Rows of a null key are a batch's rows like others; no rows give empty folders.
    """
    done = set(finished_parts(df.sparkSession, path))
    rows = df.withColumn(source, F.col(source).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    written = 0
    for n in range(batches):
        if f"batch={n}" in done:
            continue
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(batches)) == n)
        part.mapInArrow(lambda it: _attempted(it, function, source, column, attempts),
                        f"{schema}, `{column}` string, `{column}_error` string").write.mode("overwrite").parquet(
            f"{path}/batch={n}")
        written += 1
    return written
