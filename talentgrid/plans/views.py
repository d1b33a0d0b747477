"""Views over the input tables: postings, their skills, courses, tokens and profiles."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.operators.tables import spread


class Tables:
    """Lazy access to the input tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = table  # one schema read for each table
        return table

    @cached_property
    def roles(self) -> DataFrame:
        """customer key → role (nation), market segment."""
        return self.customer.join(
            self.nation, F.col("c_nationkey") == F.col("n_nationkey")
        ).select("c_custkey", F.col("n_name").alias("role"), F.col("c_mktsegment").alias("segment"),
                 "n_nationkey")

    @cached_property
    def postings(self) -> DataFrame:
        """One row per posting."""
        return self.orders.join(self.roles, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("job_id"), "role", "segment",
            F.col("o_orderdate").cast("date").alias("posted"),
            F.col("o_totalprice").alias("applicants"), F.col("o_orderstatus").alias("level"),
            F.col("o_orderpriority").alias("emp_type"),
        )

    @cached_property
    def job_links(self) -> DataFrame:
        """Distinct (job, brand, name): which skills a posting names. Distinct per job, so the
        shuffle on the job key serves the later join with postings."""
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("job_id"), F.col("p_brand").alias("brand"),
            F.concat_ws(" ", "p_brand", "p_name").alias("skill"),
        ).distinct()

    @cached_property
    def posting_skills(self) -> DataFrame:
        """Distinct (job, role, skill) with the posting's attributes."""
        return self.postings.join(self.job_links.drop("brand"), "job_id")

    @cached_property
    def posting_brands(self) -> DataFrame:
        """As ``posting_skills`` with the 25 brands as skills."""
        links = self.job_links.select("job_id", F.col("brand").alias("skill")).distinct()
        return self.postings.join(links, "job_id")

    @cached_property
    def posting_lists(self) -> DataFrame:
        """Postings with their sorted skill array (empty when none)."""
        lists = self.job_links.groupBy("job_id").agg(
            F.array_sort(F.collect_set("skill")).alias("skills")
        )
        return self.postings.join(lists, "job_id", "left").withColumn(
            "skills", F.coalesce("skills", F.array().cast("array<string>"))
        )

    @cached_property
    def course_skills(self) -> DataFrame:
        """Distinct (course, name, category, skill)."""
        links = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            "l_suppkey", F.concat_ws(" ", "p_brand", "p_name").alias("skill")
        ).distinct()
        return self.courses.join(links, F.col("course_id") == F.col("l_suppkey")).select(
            "course_id", "name", "category", "category_key", "skill"
        )

    @cached_property
    def courses(self) -> DataFrame:
        return self.supplier.join(
            self.nation, F.col("s_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("s_suppkey").alias("course_id"), F.col("s_name").alias("name"),
            F.col("n_name").alias("category"), F.col("n_nationkey").alias("category_key"),
            F.col("s_acctbal").alias("balance"),
        )

    @cached_property
    def profile_skills(self) -> DataFrame:
        """Distinct (profile, target role, skill): a customer's skills, the nation as target."""
        return self._skills_of(self.orders)

    def profile_skills_of(self, profiles: DataFrame) -> DataFrame:
        """``profile_skills`` of the profiles in ``profiles`` (profile_id) alone, chosen before line items meet parts."""
        keys = profiles.select(F.col("profile_id").alias("o_custkey")).distinct()
        return self._skills_of(self.orders.join(keys, "o_custkey", "left_semi"))

    def _skills_of(self, orders: DataFrame) -> DataFrame:
        links = orders.join(self.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(
            self.part, F.col("l_partkey") == F.col("p_partkey")
        ).select("o_custkey", F.concat_ws(" ", "p_brand", "p_name").alias("skill")).distinct()
        return links.join(self.roles, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_custkey").alias("profile_id"), F.col("role").alias("target_role"), "skill"
        )

    @cached_property
    def posting_vocabulary(self) -> DataFrame:
        """The different skills of ``posting_skills``, without forming the different skills of every posting."""
        named = self.lineitem.join(self.postings.select(F.col("job_id").alias("l_orderkey")), "l_orderkey", "left_semi")
        return named.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.concat_ws(" ", "p_brand", "p_name").alias("skill")).distinct()


# SQL forms of the same views
P_SQL = """WITH jr AS (
  SELECT o_orderkey AS job_id, n_name AS role, c_mktsegment AS segment, CAST(o_orderdate AS DATE) AS posted,
         o_totalprice AS applicants, o_orderstatus AS level, o_orderpriority AS emp_type, o_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ls AS (SELECT DISTINCT l_orderkey AS job_id, p_brand AS brand, p_brand || ' ' || p_name AS skill
       FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT jr.*, ls.skill FROM jr JOIN ls USING (job_id)),
pb AS (SELECT DISTINCT jr.*, ls.brand AS skill FROM jr JOIN ls USING (job_id)),
pl AS (SELECT jr.*, coalesce(s.skills, []) AS skills FROM jr LEFT JOIN
       (SELECT job_id, list_sort(list(skill)) AS skills FROM ls GROUP BY job_id) s USING (job_id)),
c AS (SELECT DISTINCT s_suppkey AS course_id, s_name AS name, n_name AS category, n_nationkey AS category_key,
             p_brand || ' ' || p_name AS skill
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey),
prof AS (SELECT DISTINCT c_custkey AS profile_id, n_name AS target_role, p_brand || ' ' || p_name AS skill
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def cv_texts(t: Tables) -> DataFrame:
    """CV-like text per order, built from that row's own values (no grouping)."""
    seg, reg = F.initcap(F.lower("c_mktsegment")), F.initcap(F.lower("r_name"))
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    text = F.concat_ws(
        "\n",
        F.when(k % 5 == 0, "Curriculum Vitae"),
        F.concat_ws(" ", seg, reg),
        F.concat(F.lit("Port "), seg, F.lit(", "), reg),
        F.concat(F.lower("c_mktsegment"), k.cast("string"), F.lit("@mail.example.com | 0812 "),
                 F.lpad((k % 10000000).cast("string"), 7, "0")),
        F.when(k % 4 == 1, "SKILLS:").when(k % 4 != 2, "Technical Skills"),
        F.concat(F.lit("python, sql, "), F.lower(F.substring("o_orderpriority", 3, 100)),
                 F.lit(", Docker and Node.js; ABC+")),
        F.when(k % 7 != 3, "Work Experience"),
        F.concat(seg, F.lit(" Corp - "), F.col("n_name")),
        F.concat(F.date_format("o_orderdate", "MMM yyyy"), F.lit(" - "),
                 F.when(k % 3 == 0, "Present").otherwise(
                     F.concat(F.lit("Dec "), (y + 1).cast("string")))),
        F.concat(F.lit("Senior "), seg, F.lit(" Engineer")),
        F.concat(F.lit("- Built systems for "), F.col("n_name"), F.lit(" during "),
                 (k % 9).cast("string"), F.when(k % 2 == 0, " years").otherwise(" audits")),
        F.concat(F.lit("Beta "), reg, F.lit(" Ltd - "), F.col("n_name")),
        F.concat((y - 2).cast("string"), F.lit(" - "), y.cast("string")),
        F.lit("Data Analyst"),
        F.lit("Education"),
        F.concat(reg, F.lit(" University - "), F.col("n_name")),
        F.concat(F.lit("Bachelor of "), seg, F.lit(", 3.5")),
        F.concat((y - 8).cast("string"), F.lit(" - "), (y - 4).cast("string")),
        F.when(k % 6 == 0, F.concat(F.lit("Studying at the "), reg, F.lit(" College"))),
    )
    return (
        spread(t.orders).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(k.alias("doc_id"), text.alias("text"), seg.alias("seg"), reg.alias("reg"),
                F.col("n_name"), F.col("o_orderdate"))
    )


CV_SQL = """WITH cv0 AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, o_orderdate, o_orderpriority, c_mktsegment, n_name,
   upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS seg, replace(upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)), ' e', ' E') AS reg
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cv AS (SELECT k AS doc_id, seg, reg, n_name, o_orderdate, concat_ws(chr(10),
   CASE WHEN k % 5 = 0 THEN 'Curriculum Vitae' END, seg || ' ' || reg, 'Port ' || seg || ', ' || reg,
   lower(c_mktsegment) || k || '@mail.example.com | 0812 ' || lpad((k % 10000000)::VARCHAR, 7, '0'),
   CASE WHEN k % 4 = 1 THEN 'SKILLS:' WHEN k % 4 <> 2 THEN 'Technical Skills' END,
   'python, sql, ' || lower(substr(o_orderpriority, 3)) || ', Docker and Node.js; ABC+',
   CASE WHEN k % 7 <> 3 THEN 'Work Experience' END, seg || ' Corp - ' || n_name,
   strftime(o_orderdate, '%b %Y') || ' - ' || CASE WHEN k % 3 = 0 THEN 'Present' ELSE 'Dec ' || (y + 1) END,
   'Senior ' || seg || ' Engineer',
   '- Built systems for ' || n_name || ' during ' || (k % 9) || CASE WHEN k % 2 = 0 THEN ' years' ELSE ' audits' END,
   'Beta ' || reg || ' Ltd - ' || n_name, (y - 2) || ' - ' || y, 'Data Analyst', 'Education',
   reg || ' University - ' || n_name, 'Bachelor of ' || seg || ', 3.5', (y - 8) || ' - ' || (y - 4),
   CASE WHEN k % 6 = 0 THEN 'Studying at the ' || reg || ' College' END) AS text FROM cv0)
"""


def document_tokens(t: Tables) -> DataFrame:
    """Distinct whitespace tokens of all documents with their counts."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return spread(t.documents).select(words.alias("token")).groupBy("token").agg(F.count("*").alias("n"))


TOK_SQL = r"""WITH tk AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS token FROM documents) GROUP BY 1)
"""


def sql_list(values) -> str:
    """Comma-separated SQL string literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
