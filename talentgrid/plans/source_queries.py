"""Source, sink and stream queries: input tables are written as files and read back."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from talentgrid.operators.tables import spread
from talentgrid.plans.registry import query
from talentgrid.plans.views import CV_SQL, cv_texts
from talentgrid.session import new_path
from talentgrid.sources import arrays, audit, files, sinks
from talentgrid.streaming import ingest as ST


@query("src_1_postings_csv", """SELECT round(o_totalprice, 2) AS applicants, o_orderpriority AS employment, 'He said "hi", ' || o_orderkey || chr(10) || 'line \\ two' AS description, strftime(o_orderdate, '%d/%m/%Y') AS posted FROM orders""".replace("\\\\", "\\"))
def _(t):
    body = F.concat(F.lit('He said "hi", '), F.col("o_orderkey").cast("string"), F.lit("\nline \\ two"))
    rows = t.orders.select(
        F.col("o_totalprice").alias("applicantsCount"), body.alias("descriptionText"), F.col("o_orderpriority").alias("employmentType"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("postedAt"))
    path = new_path(t.spark, "postings")
    sinks.write_csv(rows, path)
    schema = "applicantsCount double, descriptionText string, employmentType string, postedAt string"
    return files.postings_csv(t.spark, path, schema).select(
        F.round("applicantsCount", 2).alias("applicants"), F.col("employmentType").alias("employment"),
        F.col("descriptionText").alias("description"), F.col("postedAt").alias("posted"))


@query("src_1_dropped_rows", """SELECT o_orderpriority AS employment, count(*) AS kept, (SELECT count(*) FROM orders WHERE o_orderkey % 13 = 0) AS dropped
  FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY 1""")
def _(t):
    amount = F.when(F.col("o_orderkey") % 13 == 0, "not given").otherwise(F.col("o_totalprice").cast("string"))
    rows = t.orders.select(amount.alias("applicantsCount"), F.lit("two\nlines").alias("descriptionText"), F.col("o_orderpriority").alias("employmentType"))
    path, out, seen = new_path(t.spark, "postings"), new_path(t.spark, "postings-read"), Observation()
    sinks.write_csv(rows, path)
    schema = "applicantsCount double, descriptionText string, employmentType string"
    sinks.write_parquet(files.postings_csv(t.spark, path, schema, seen), out)
    return t.spark.read.parquet(out).groupBy(F.col("employmentType").alias("employment")).agg(
        F.count("*").alias("kept")).withColumn("dropped", F.lit(seen.get["unparsed"]).cast("long"))


@query("src_2_courses_csv", """SELECT s_name AS name, 'Ünï ' || n_name AS partner, 'sql|' || n_name || '|é' AS skills, 3 AS skill_count FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0""")
def _(t):
    header = ["Name", "Patners 1", "Skills", "Url"]
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("Name"), F.concat(F.lit("Ünï "), F.col("n_name")).alias("Patners 1"),
        F.when(F.col("s_suppkey") % 10 != 0, F.concat(F.lit("sql; "), F.col("n_name"), F.lit(" ;é;"))).alias("Skills"),
        F.concat(F.lit("https://learn.example.com/"), F.col("s_suppkey").cast("string")).alias("Url"))
    # the file opens with a title line and then the header line
    top = t.spark.createDataFrame([("Catalog export", None, None, None), tuple(header)], ", ".join(f"`{c}` string" for c in header))
    path = new_path(t.spark, "courses")
    top.unionByName(rows).write.options(sep=";", encoding="ISO-8859-1").csv(path)
    c = files.courses_csv(t.spark, path, header)
    return c.select("name", "partner", F.array_join("skills_list", "|").alias("skills"), F.col("skill_count").cast("int").alias("skill_count"))


@query("src_4_dictionary_csv", "SELECT DISTINCT skill FROM (SELECT p_name AS skill FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT lower(p_type) FROM part)")
def _(t):
    rows = t.part.select(F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(" "), F.upper("p_name"))).alias("Example"),
                         F.col("p_type").alias("Commodity Title"), F.col("p_brand").alias("Code"))
    path = new_path(t.spark, "dictionary")
    sinks.write_csv(rows, path)
    return files.dictionary_csv(t.spark, path)


@query("src_5_annotated_documents", CV_SQL + """, x AS (SELECT md5(text) AS doc_id, text, seg FROM cv WHERE doc_id % 9 <> 0)
  SELECT DISTINCT doc_id, s, e, label FROM (SELECT doc_id, strpos(text, 'python') - 1 AS s, strpos(text, 'python') + 5 AS e, 'Skills' AS label FROM x
   UNION ALL SELECT doc_id, strpos(text, seg || ' Corp') - 1, strpos(text, seg || ' Corp') + length(seg) + 4, 'Companies worked at' FROM x UNION ALL SELECT doc_id, 0, 4, 'UNKNOWN' FROM x)""")
def _(t):
    point = lambda s, n: F.struct(s.cast("int").alias("start"), (s + n - 1).cast("int").alias("end"))
    ann = lambda lab, *pts: F.struct(F.array(F.lit(lab)).alias("label"), F.array(*pts).alias("points"))
    at = lambda s: F.position(s, F.col("text")) - 1
    corp = F.concat("seg", F.lit(" Corp"))
    docs = cv_texts(t).select(F.when(F.col("doc_id") % 9 != 0, F.col("text")).otherwise(" ").alias("content"), F.array(
        ann("Skills", point(at(F.lit("python")), 6)), ann("Companies Worked At", point(at(corp), F.length(corp))),
        ann("Hobby", point(F.lit(0), 4)), ann("", point(F.lit(2), 4))).alias("annotation"))
    path = new_path(t.spark, "annotated")
    sinks.write_jsonl(docs, path)
    return files.annotated_documents(t.spark, path).select(
        "doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "label").distinct()


@query("src_6_tagged_jsonl", r"SELECT doc_id::VARCHAR AS doc_id, len(regexp_extract_all(text, '\S+')) AS n, source FROM documents WHERE doc_id % 7 <> 0 AND len(regexp_extract_all(text, '\S+')) > 0")
def _(t):
    toks = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    rows = spread(t.documents).select(F.col("doc_id").cast("string").alias("doc_id"), toks.alias("tokens"), "source").withColumn(
        "ner_tags_str", F.transform("tokens", lambda x: F.when(x.rlike(r"^\p{Lu}"), "1").otherwise("O")))
    cut = F.slice("ner_tags_str", F.lit(2), F.size("ner_tags_str"))
    rows = rows.withColumn("ner_tags_str", F.when(F.col("doc_id").cast("long") % 7 == 0, cut).otherwise(F.col("ner_tags_str")))
    path = new_path(t.spark, "tagged")
    sinks.write_jsonl(rows, path)
    return files.tagged_jsonl(t.spark, path, ["O", "B-Skills"]).select(
        "doc_id", F.size("tokens").cast("long").alias("n"), "source")


@query("qlt_1_rows_parse", """SELECT 'rows:train' AS "check", count(*) > 0 AS passed, count(*)::VARCHAR AS detail FROM documents UNION ALL SELECT 'rows_parse:train', true, '0'
  UNION ALL SELECT 'rows:test', count(*) > 0, count(*)::VARCHAR FROM conversations UNION ALL SELECT 'rows_parse:test', count(*) = 0, count(*)::VARCHAR FROM conversations WHERE conv_id % 11 = 0""")
def _(t):
    train, test = new_path(t.spark, "train"), new_path(t.spark, "test")
    sinks.write_jsonl(t.documents.select("doc_id", "text", "source"), train)
    line = F.to_json(F.struct("conv_id", "text"))
    # lines that lost their last character, as an interrupted copy leaves them
    cut = F.when(F.col("conv_id") % 11 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    t.conversations.select(cut.alias("value")).write.text(test)
    return audit.parse_gates("train", audit.read_audited(t.spark, train, "json", "doc_id long, text string, source string")).unionByName(
        audit.parse_gates("test", audit.read_audited(t.spark, test, "json", "conv_id long, text string")))


@query("src_8_vector_files", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, len(embedding) AS dim FROM embeddings WHERE embedding IS NOT NULL")
def _(t):
    path = new_path(t.spark, "vectors")
    arrays.write_vectors(t.embeddings.where("embedding IS NOT NULL"), "vec_id", "embedding", path)
    rows = arrays.read_vectors(t.spark, path, key="ids", rows=256)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rows.select(F.col("key").alias("vec_id"), F.round(total, 4).alias("total"), F.size("vector").cast("long").alias("dim"))


@query("src_7_lookup_artifacts", "SELECT p_name AS key, avg(p_size) AS value FROM part GROUP BY 1")
def _(t):
    rows = t.part.groupBy("p_name").agg(F.avg("p_size").alias("value"))
    path = new_path(t.spark, "lookup")
    sinks.write_map_document(rows, "p_name", "value", path)
    return files.lookup_json(t.spark, path)


@query("src_9_resumable_enrichment", "SELECT doc_id, upper(lang) || ':' || n_chars AS enriched FROM documents")
def _(t):
    path = new_path(t.spark, "enriched")
    docs, value = t.documents.select("doc_id", "lang", "n_chars"), F.concat(F.upper("lang"), F.lit(":"), F.col("n_chars").cast("string"))
    # an interrupted first run, then the resumed run over the whole table
    sinks.resume_enrichment(docs.where("lang = 'en'"), "doc_id", "enriched", value, path)
    sinks.resume_enrichment(docs, "doc_id", "enriched", value, path)
    return t.spark.read.parquet(path).select("doc_id", "enriched")


def _described(text: str) -> str | None:
    """Fails on Spanish rows, has nothing to say about short French ones."""
    lang, n = text.split(" ")
    if lang == "es":
        raise ValueError(f"no reader for {lang}")
    return f"{lang.upper()}:{n}" if lang != "fr" or int(n) > 500 else None


@query("src_9_enrichment_attempts", """SELECT doc_id, CASE WHEN lang = 'es' OR (lang = 'fr' AND n_chars <= 500) THEN lang || ' ' || n_chars ELSE upper(lang) || ':' || n_chars END AS enriched,
  CASE WHEN lang = 'es' THEN 'ValueError: no reader for es' END AS enriched_error FROM documents""")
def _(t):
    path = new_path(t.spark, "attempts")
    docs = t.documents.select("doc_id", F.concat_ws(" ", "lang", F.col("n_chars").cast("string")).alias("about"))
    sinks.enrich_by_attempts(docs, "doc_id", "about", "enriched", _described, path, batches=4)
    return t.spark.read.parquet(path).select("doc_id", "enriched", "enriched_error")


@query("src_11_table_round_trip", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def _(t):
    cols = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
    a, b = new_path(t.spark, "table"), new_path(t.spark, "table-csv")
    sinks.write_parquet(t.customer.select(*cols), a, "c_mktsegment")
    sinks.write_csv(t.spark.read.parquet(a).select(*cols), b)
    return t.spark.read.schema("c_custkey long, c_name string, c_mktsegment string, c_acctbal double").option("header", True).csv(b)


@query("src_12_jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    path = new_path(t.spark, "records")
    sinks.write_jsonl(t.conversations.select("conv_id", "turn", "role", "text"), path)
    return t.spark.read.schema("conv_id long, turn long, role string, text string").json(path)


@query("str_1_incremental_ingest", "SELECT event_id, user_id, upper(event_type) AS kind FROM events")
def _(t):
    src, out, ck = (new_path(t.spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    ev = t.events.select("event_id", "user_id", "event_type")
    change = lambda df: df.select("event_id", "user_id", F.upper("event_type").alias("kind"))
    # two deliveries; the second run starts from the checkpoint of the first
    ev.where("event_type = 'click'").write.mode("append").parquet(src)
    ST.ingest(ST.file_stream(t.spark, src, ev.schema), change, out, ck)
    ev.where("event_type <> 'click'").write.mode("append").parquet(src)
    ST.ingest(ST.file_stream(t.spark, src, ev.schema), change, out, ck)
    return t.spark.read.parquet(out)


@query("str_2_incremental_trend", "SELECT strftime(ts, '%Y-%m-%d') AS period, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    src, out, ck = (new_path(t.spark, n) for n in ("trend-in", "trend-out", "trend-state"))
    ev, log = t.events.select("ts", "event_type"), ST.CountLog(t.spark, out, ["event_type"])
    # three deliveries, the newest days first; the log is compacted between them
    for part in (1, 2, 0):
        ev.where(F.dayofmonth("ts") % 3 == part).write.mode("append").parquet(src)
        ST.add_counts(ST.file_stream(t.spark, src, ev.schema), "ts", log, ck)
        if part == 2:
            log.compact()
    return log.read().select(F.date_format("period", "yyyy-MM-dd").alias("period"), "event_type", "n")
