"""Corpus pipeline over ``documents``: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talentgrid.llm.exact import drop_copies
from talentgrid.llm.near import drop_near_copies
from talentgrid.llm.packing import pack
from talentgrid.llm.quality import keep_good, train
from talentgrid.llm.shared import settled
from talentgrid.llm.tiling import drop_contaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 3)."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 7)."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by SimHash (operator 2) or by five-word Jaccard similarity of at
    least 0.8."""
    return drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item (operator 5)."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences (operator 10)."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("exact copies", exact_copies), ("near copies", near_copies),
          ("benchmark passages", benchmark_passages), ("packing", packing)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
