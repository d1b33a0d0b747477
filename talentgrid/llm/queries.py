"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm.alignment import align
from talentgrid.llm.exact import exact_groups
from talentgrid.llm.html import extract
from talentgrid.llm.lines import drop_lines
from talentgrid.llm.packing import pack
from talentgrid.llm.quality import held_out, score, train
from talentgrid.llm.simhash import near_groups
from talentgrid.llm.suffixes import drop_repeats
from talentgrid.llm.tiling import contaminations
from talentgrid.llm.token_counts import token_counts
from talentgrid.llm.token_files import read_tokens, write_tokens
from talentgrid.llm.vector_codes import compress, oracle
from talentgrid.llm.warc import payload_digest, read_warc, with_revisits, write_warc
from talentgrid.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         "component_id")


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def _ids_crc32(batches):
    """``tokens`` replaced by ``ids_crc32``, of the ids as little-endian unsigned 32-bit integers."""
    for b in batches:
        lists = b.column("tokens")
        ends, ids = lists.offsets.to_numpy(), np.asarray(lists.values).astype("<u4")
        sums = [zlib.crc32(ids[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).mapInArrow(
        _ids_crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op7_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2("text", 256)})
    return groups.withColumnRenamed("id", "doc_id")


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.drop("kept").withColumnRenamed("id", "doc_id")


def _digests(batches):
    """The digest of what was read for responses, that of the header for revisits."""
    for b in batches:
        rows = b.to_pylist()
        read = [(len(r["payload"]), payload_digest(r["payload"])) if r["record_type"] == "response"
                else (r["payload_bytes"], r["payload_digest"]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column("record_key"), pa.array([x[0] for x in read], pa.int64()),
             pa.array([x[1] for x in read], pa.string()), b.column("record_type"), b.column("refers_to_key")],
            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


@query("op9_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(with_revisits(table(spark, sf_dir, "pages")), path)
    return read_warc(spark, path).mapInArrow(
        _digests, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumnRenamed("id", "doc_id")


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                  public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumnRenamed("id", "doc_id")


@query("op13_vector_codes", oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label").withColumnRenamed("id", "vec_id")
