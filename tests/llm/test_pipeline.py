"""The corpus pipeline stage by stage against the operators' results, and the registered queries."""

import duckdb

import corpus_pipeline
from talentgrid.llm.queries import QUERIES, SQL


def test_stages_keep_columns_and_follow_their_operators(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
    assert kept["quality"] == {r.doc_id for r in QUERIES["op3_quality"](spark, small).where("predicted = 1").collect()} <= ids
    assert kept["exact copies"] < kept["quality"]
    assert kept["near copies"] <= kept["exact copies"] and kept["benchmark passages"] < kept["near copies"]
    leaks = {r.doc_id for r in QUERIES["op5_decontamination"](spark, small).collect()}
    assert kept["benchmark passages"] == kept["near copies"] - leaks
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == kept["benchmark passages"]
    whole = corpus_pipeline.run(spark, small).collect()
    assert {(r.doc_id, r.doc_tokens) for r in whole} == {(r.doc_id, r.doc_tokens) for r in packed}


def test_stages_take_odd_rows(spark, odd, small):
    docs = odd.withColumnRenamed("id", "doc_id")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).collect()
        assert stage(spark, docs.limit(0), small).collect() == []


def test_sql_of_the_queries(spark, small):
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in SQL.items():
        result = con.execute(sql)
        columns, want = [d[0] for d in result.description], sorted(result.fetchall())
        assert sorted(map(tuple, QUERIES[name](spark, small).select(*columns).collect())) == want
