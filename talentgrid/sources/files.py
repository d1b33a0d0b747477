"""File sources: postings, catalogs, dictionaries, annotated documents, lookup artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from talentgrid.functions.lists import parse_delimited, strip, wide_columns_to_list
from talentgrid.functions.spans import map_annotation_label
from talentgrid.functions.text import clean_document
from talentgrid.operators.profile import sections
from talentgrid.sources.audit import parsed, read_audited

# fixed values: column names and types of the documented inputs
POSTING_SCHEMA = (
    "applicantsCount double, applyMethod string, companyName string, country string, "
    "descriptionText string, employmentType string, industries string, jobFunction string, "
    "postedAt string, salary string, seniorityLevel string, standardizedTitle string, title string, "
    "workRemoteAllowed string"
)
ANNOTATION_SCHEMA = (
    "content string, annotation array<struct<label:array<string>,"
    "points:array<struct<start:int,end:int,text:string>>>>"
)
TAGGED_SCHEMA = "doc_id string, tokens array<string>, ner_tags_str array<string>, source string"
COURSE_COLUMNS = {
    "Name": "name", "Patners 1": "partner", "Url": "url", "Job category": "role_category",
    "Difficulty": "difficulty", "Duration": "duration",
}


def postings_csv(spark: SparkSession, path: str, schema: str = POSTING_SCHEMA, seen: Observation | None = None) -> DataFrame:
    """Quoted free text over several lines, backslash escapes, malformed rows skipped; ``seen`` counts ``rows`` and
    ``unparsed`` records."""
    return parsed(read_audited(spark, path, "csv", schema, header=True, multiLine=True, quote='"', escape="\\"), seen)


def courses_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Semicolon-separated latin-1 catalog whose header is the second line.

    The reader gets the column names; a row equal to them in all columns is the header line. Rows without
    skills, as the title line, are dropped; courses without a name stay. The skill list is parsed."""
    schema = ", ".join(f"`{c}` string" for c in header)
    raw = spark.read.schema(schema).option("sep", ";").option("encoding", "ISO-8859-1").option(
        "quote", '"').csv(path)
    is_header = F.lit(True)
    for c in header:
        is_header = is_header & F.col(f"`{c}`").eqNullSafe(F.lit(c))
    kept = raw.where(~is_header).where(F.col("Skills").isNotNull())
    listed = kept.withColumn("skills_list", parse_delimited(F.col("Skills"), ";")).withColumn(
        "skill_count", F.size("skills_list"))
    for old, new in COURSE_COLUMNS.items():
        if old in listed.columns:
            listed = listed.withColumnRenamed(old, new)
    return listed


def wide_skill_columns(df: DataFrame) -> DataFrame:
    """Every column whose name contains ``skill`` collected into one lowercase list per row."""
    cols = [F.col(f"`{c}`") for c in df.columns if "skill" in c.lower()]
    return df.withColumn("skill_list", wide_columns_to_list(cols))


def dictionary_csv(spark: SparkSession, path: str, columns=("Example", "Commodity Title")) -> DataFrame:
    """Distinct trimmed lowercase names from the dictionary columns that exist."""
    raw = spark.read.option("header", True).csv(path)
    have = [F.col(f"`{c}`") for c in columns if c in raw.columns]
    names = F.explode(F.transform(F.array(*have), lambda s: F.lower(strip(s))))
    return raw.select(names.alias("skill")).where("skill IS NOT NULL AND skill <> ''").distinct()


def annotated_documents(spark: SparkSession, path: str, seen: Observation | None = None) -> DataFrame:
    """One JSON object per line; bad lines (counted by ``seen``) and blank texts are skipped. Long form of the
    spans: doc_id (hash of the text), content, span_id, s, e (exclusive), label."""
    docs = parsed(read_audited(spark, path, "json", ANNOTATION_SCHEMA), seen)
    good = docs.withColumn("content", strip("content")).where("content IS NOT NULL AND content <> ''")
    ided = good.withColumn("doc_id", F.md5("content"))
    anns = ided.select("doc_id", "content", F.posexplode_outer("annotation").alias("i", "a"))
    pts = anns.select("doc_id", "content", "i", F.get("a.label", F.lit(0)).alias("raw"),
                      F.posexplode_outer("a.points").alias("j", "p"))
    return pts.select(
        "doc_id", "content", (F.col("i").cast("long") * (1 << 32) + F.col("j")).alias("span_id"), F.col("p.start").alias("s"),
        (F.col("p.end") + 1).alias("e"), map_annotation_label(F.col("raw")).alias("label"),
    ).where("e > s AND label IS NOT NULL")


def tagged_jsonl(spark: SparkSession, path: str, id_to_tag: list[str] | None = None) -> DataFrame:
    """Token/tag records with equal, non-zero lengths; integer tags are decoded by position."""
    recs = spark.read.schema(TAGGED_SCHEMA).json(path)
    if id_to_tag:
        names = F.array(*[F.lit(x) for x in id_to_tag])
        decode = lambda g: F.coalesce(F.get(names, g.try_cast("int")), g)
        recs = recs.withColumn("ner_tags_str", F.transform("ner_tags_str", decode))
    return recs.where((F.size("tokens") > 0) & (F.size("tokens") == F.size("ner_tags_str")))


def lookup_json(spark: SparkSession, path: str, value_type: str = "double", field: str | None = None) -> DataFrame:
    """A JSON document holding one map (optionally under ``field``) as (key, value) rows."""
    schema = f"map<string,{value_type}>"
    raw = spark.read.text(path, wholetext=True)
    doc = F.get_json_object("value", f"$.{field}") if field else F.col("value")
    return raw.select(F.explode(F.from_json(doc, schema)).alias("key", "value"))


def taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """category → skills as (key, key_order, category); keys are lowercase."""
    rows = lookup_json(spark, path, "array<string>")
    return rows.select(F.col("key").alias("category"), F.posexplode("value").alias("key_order", "s")).select(
        F.lower("s").alias("key"), "key_order", "category")


def vectors(spark: SparkSession, path: str, key: str, vector: str = "vector") -> DataFrame:
    """Vector table: a key and an array of floats, read with only those columns."""
    return spark.read.parquet(path).select(key, vector)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: path and whole content."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))


def intake(df: DataFrame, text: str) -> DataFrame:
    """Cleaned text with its sections, method, page count and warnings as one struct."""
    t = clean_document(F.col(text))
    secs = sections(F.col("_t"))
    return df.withColumn("_t", t).withColumn("intake", F.struct(
        F.col("_t").alias("raw_text"), secs.alias("sections"), F.lit("text").alias("method"),
        F.lit(1).alias("pages"), F.array().cast("array<string>").alias("warnings"))).drop("_t")
