"""Evaluation, split, quality, set and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.operators import evaluate as E
from talentgrid.operators import history as H
from talentgrid.operators import market as M
from talentgrid.operators import quality as Q
from talentgrid.operators import splits as SPL
from talentgrid.operators.quantiles import exact_quantiles, histogram
from talentgrid.plans.market_queries import TFIDF_SQL
from talentgrid.plans.registry import query
from talentgrid.plans.vector_queries import _MAP, role_demand, skill_map
from talentgrid.plans.views import P_SQL
from talentgrid.session import new_path

R = lambda c, d=6: F.round(c, d)


# --- regression-type errors: label quality against a number from the document -----------

def predictions(t):
    return t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id").select(
        "doc_id", "source", F.col("quality").cast("double").alias("y"), (F.col("n_chars") % 101 / 100).alias("p"))


_PRED = "WITH pr AS (SELECT doc_id, source, quality::DOUBLE AS y, n_chars % 101 / 100 AS p FROM labels JOIN documents USING (doc_id))"


@query("agg_29_regression_metrics", _PRED + """SELECT count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 6) AS mse,
  round(avg(((y > 0.5) = (p > 0.5))::INT), 6) AS accuracy, round(avg(abs(y - p) * (1 + 2 * y)), 6) AS weighted_mae FROM pr""")
def _(t):
    m = E.regression_metrics(predictions(t))
    return m.select("n", *[R(c).alias(c) for c in ("mae", "mse", "accuracy", "weighted_mae")])


@query("agg_30_worst_groups", _PRED + "SELECT source, round(avg(abs(y - p)), 6) AS mae FROM pr GROUP BY 1 ORDER BY avg(abs(y - p)) DESC, source LIMIT 20")
def _(t):
    return E.worst_groups(predictions(t), "source").withColumn("mae", R("mae"))


@query("agg_31_calibration", _PRED + """, g AS (SELECT floor(p * 10)::BIGINT AS bin, count(*) AS n, avg(abs(y - p)) AS mae FROM pr WHERE p < 1 GROUP BY 1)
  SELECT bin, coalesce(n, 0) AS n, round(coalesce(mae, 0), 6) AS mae FROM range(10) r(bin) LEFT JOIN g USING (bin)""")
def _(t):
    return E.calibration(predictions(t)).withColumn("mae", R("mae"))


@query("agg_41_residual_histogram", _PRED + """, r AS (SELECT y - p AS v FROM pr), m AS (SELECT min(v) AS lo, max(v) AS hi FROM r)
  SELECT CAST(least(49, floor((v - lo) / (hi - lo) * 50)) AS BIGINT) AS bin, count(*) AS n FROM r, m GROUP BY 1""")
def _(t):
    return histogram(predictions(t), F.col("y") - F.col("p"), 50)


@query("agg_41_quartiles", " UNION ALL ".join(f"SELECT c_mktsegment AS grp, {p}::DOUBLE AS p, round(quantile_cont(c_acctbal, {p}), 4) AS quantile FROM customer GROUP BY 1" for p in (0.25, 0.5, 0.75, 1.0)))
def _(t):
    q = exact_quantiles(t.customer.withColumnRenamed("c_mktsegment", "grp"), F.col("c_acctbal"), [0.25, 0.5, 0.75, 1.0], ["grp"])
    return q.withColumn("quantile", R("quantile", 4))


@query("agg_41_scatter_sample", _PRED + "SELECT doc_id, y, p FROM pr ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id LIMIT 200")
def _(t):
    return SPL.shuffled_take(predictions(t).select("doc_id", "y", "p"), "doc_id", 200, 7)


@query("agg_35_contingency", """SELECT count_if(q AND x) AS both, count_if(q AND NOT x) AS a_only, count_if(NOT q AND x) AS b_only, count_if(NOT q AND NOT x) AS neither,
  round((abs(count_if(q AND NOT x) - count_if(NOT q AND x)) - 1) ^ 2 / (count_if(q AND NOT x) + count_if(NOT q AND x)), 6) AS statistic FROM (SELECT quality = 1 AS q, toxic = 1 AS x FROM labels)""".replace(" AS both", ' AS "both"'))
def _(t):
    c = E.contingency(t.labels, F.col("quality") == 1, F.col("toxic") == 1)
    return c.withColumn("statistic", R("statistic"))


RECURSIVE_TAIL = """, er AS (SELECT 0 AS k, statistic / 2 AS x2, 1.0::DOUBLE AS term, 1.0::DOUBLE AS total FROM ct UNION ALL
    SELECT k + 1, x2, term * x2 / (k + 1.5), total + term * x2 / (k + 1.5) FROM er WHERE k < 200),
  pv AS (SELECT CASE WHEN a_only + b_only > 0 THEN greatest(0, 1 - 2 / sqrt(pi()) * sqrt(x2) * exp(-x2) * total) ELSE 1.0 END AS p_value FROM er, ct WHERE k = 200),
  de AS (SELECT CASE WHEN p_value >= 0.05 THEN 'no difference' WHEN b_only > a_only THEN 'b better' ELSE 'a better' END AS decision FROM pv, ct)
"""


@query("agg_35_mcnemar_test", """WITH RECURSIVE ct0 AS (SELECT count_if(l_discount > 0.05 AND l_tax > 0.04) AS "both", count_if(l_discount > 0.05 AND NOT l_tax > 0.04) AS a_only,
   count_if(NOT l_discount > 0.05 AND l_tax > 0.04) AS b_only, count_if(NOT l_discount > 0.05 AND NOT l_tax > 0.04) AS neither FROM lineitem),
  ct AS (SELECT "both", a_only, b_only, neither, (abs(a_only - b_only) - 1) ^ 2 / (a_only + b_only) AS statistic FROM ct0)""" + RECURSIVE_TAIL + """
  SELECT "both", a_only, b_only, neither, round(statistic, 4) AS statistic, round(p_value, 6) AS p_value, decision FROM ct, pv, de""")
def _(t):
    m = E.mcnemar(t.lineitem, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04)
    return m.withColumn("statistic", R("statistic", 4)).withColumn("p_value", R("p_value"))


@query("agg_36_bootstrap_interval")
def _(t):
    return E.bootstrap_difference(t.labels, F.col("toxic") == 1, F.col("quality") == 1)


# --- splits -----------------------------------------------------------------------------

_STRAT = P_SQL + """, st AS (SELECT job_id, role, CASE WHEN row_number() OVER (PARTITION BY role ORDER BY md5(job_id::VARCHAR || '|42'), job_id) <= floor(count(*) OVER (PARTITION BY role) * 0.8) THEN 'train' ELSE 'test' END AS split FROM jr)
"""


def stratified(t):
    return SPL.stratified_split(t.postings.select("job_id", "role"), "job_id", "role")


@query("smp_1_stratified_split", _STRAT + "SELECT job_id, role, split FROM st")
def _(t):
    return stratified(t).select("job_id", "role", "split")


@query("smp_2_three_way_split", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS rk, count(*) OVER () AS n FROM documents),
  h AS (SELECT *, ceil(n * 0.3 - 1e-9) AS held FROM r)
  SELECT doc_id, CASE WHEN rk <= n - held THEN 'train' WHEN rk <= n - ceil(held / 2) THEN 'val' ELSE 'test' END AS split FROM h""")
def _(t):
    return SPL.three_way_split(t.documents.select("doc_id"), "doc_id")


def sourced_docs(t):
    n = F.substring("source", 4, 5).cast("int")
    return t.documents.select("doc_id", F.when(n < 10, "curated").when(n < 15, "silver").otherwise("synthetic").alias("source"))


_SRC = "WITH sd AS (SELECT doc_id, CASE WHEN substr(source, 4)::INT < 10 THEN 'curated' WHEN substr(source, 4)::INT < 15 THEN 'silver' ELSE 'synthetic' END AS source FROM documents)"
_DSPLIT = _SRC + """, c AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS rk, count(*) OVER () AS n FROM sd WHERE source = 'curated'),
  ds AS (SELECT doc_id, source, CASE WHEN rk <= n - greatest(1, round_even(n * 0.12, 0)) - greatest(1, round_even(n * 0.08, 0)) THEN 'train' WHEN rk <= n - greatest(1, round_even(n * 0.08, 0)) THEN 'val' ELSE 'test' END AS split FROM c
   UNION ALL SELECT doc_id, source, 'train' FROM sd WHERE source <> 'curated')
"""


@query("smp_3_document_split", _DSPLIT + "SELECT doc_id, source, split FROM ds")
def _(t):
    return SPL.document_split(sourced_docs(t)).select("doc_id", "source", "split")


@query("smp_4_shuffled_take", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 50 ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id LIMIT 500")
def _(t):
    good = t.documents.where(F.length(F.trim("text")) >= 50).select("doc_id")
    return SPL.shuffled_take(good, "doc_id", 500)


@query("smp_9_sized_split", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS rk, count(*) OVER () AS n FROM documents),
  s AS (SELECT *, greatest(floor(n * 0.08), 50) AS nt, greatest(floor(n * 0.12), 50) AS nv FROM r), z AS (SELECT *, least(n - nt - nv, 700) AS tr FROM s)
  SELECT doc_id, CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + nv THEN 'val' ELSE 'test' END AS split FROM z WHERE rk <= tr + nv + nt""")
def _(t):
    return SPL.sized_split(t.documents.select("doc_id"), "doc_id", max_train=700)


@query("jon_14_split_manifest_join", _DSPLIT + "SELECT d.doc_id, split, lang, n_chars FROM documents d JOIN ds USING (doc_id) WHERE split = 'val'")
def _(t):
    wanted = SPL.document_split(sourced_docs(t)).where("split = 'val'").select("doc_id", "split")
    return t.documents.join(wanted, "doc_id").select("doc_id", "split", "lang", "n_chars")


@query("set_4_split_overlaps", _DSPLIT + """SELECT a AS left_split, b AS right_split, (SELECT count(*) FROM (SELECT doc_id FROM ds WHERE split = a INTERSECT SELECT doc_id FROM ds WHERE split = b)) AS shared
  FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) v(a, b)""")
def _(t):
    return Q.split_overlaps(SPL.document_split(sourced_docs(t)), "doc_id")


@query("set_3_upsampled_union", _SRC + """SELECT doc_id, c AS copy, 'real' AS origin FROM sd, range(5) r(c) WHERE source = 'curated' UNION ALL SELECT doc_id, 0, 'generated' FROM sd WHERE source <> 'curated'""")
def _(t):
    d = sourced_docs(t)
    return Q.upsampled_union(d.where("source = 'curated'").select("doc_id"), d.where("source <> 'curated'").select("doc_id")).withColumn(
        "copy", F.col("copy").cast("long"))


# --- role predictors -----------------------------------------------------------------------

_TT = _STRAT + """, tp AS (SELECT st.job_id, st.role, split, skill FROM st JOIN p USING (job_id)),
  rc AS (SELECT role, skill, count(*) AS n FROM tp WHERE split = 'train' GROUP BY 1, 2),
  t3 AS (SELECT role AS predicted, skill FROM rc QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, skill) <= 3),
  ha AS (SELECT job_id, predicted, count(*) AS h FROM tp JOIN t3 USING (skill) WHERE split = 'test' GROUP BY 1, 2),
  pa AS (SELECT job_id, predicted FROM ha QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY h DESC, predicted) = 1),
  f1 AS (SELECT min(role) AS r0 FROM rc),
  A AS (SELECT st.job_id, st.role, coalesce(predicted, r0) AS predicted FROM st CROSS JOIN f1 LEFT JOIN pa USING (job_id) WHERE split = 'test'),
  vc AS (SELECT skill FROM p GROUP BY 1 HAVING count(*) >= 20), tz AS (SELECT role, count(*) AS k FROM st WHERE split = 'train' GROUP BY 1),
  sh AS (SELECT role, skill, n / k AS share FROM rc JOIN tz USING (role) WHERE skill IN (SELECT skill FROM vc)),
  nm AS (SELECT role, sqrt(sum(share * share)) AS nrm FROM sh GROUP BY 1),
  hb AS (SELECT job_id, sh.role AS predicted, round(sum(share / nrm), 9) AS s FROM tp JOIN sh USING (skill) JOIN nm ON nm.role = sh.role WHERE split = 'test' GROUP BY 1, 2),
  pb2 AS (SELECT job_id, predicted FROM hb QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY s DESC, predicted) = 1),
  B AS (SELECT st.job_id, st.role, coalesce(predicted, r0) AS predicted FROM st CROSS JOIN f1 LEFT JOIN pb2 USING (job_id) WHERE split = 'test')
"""


def _parts(t):
    split = stratified(t).select("job_id", "split")
    jobs = t.postings.select("job_id", "role").join(split, "job_id")
    skills = jobs.join(t.job_links.select("job_id", "skill"), "job_id")
    pick = lambda df, s: df.where(F.col("split") == s).drop("split")
    return pick(jobs, "train"), pick(skills, "train"), pick(jobs, "test"), pick(skills, "test")


def strategy_a(t):
    _tr, tr_s, te, te_s = _parts(t)
    return E.predict_by_signature(tr_s, te, te_s)


def strategy_b(t):
    tr, tr_s, te, te_s = _parts(t)
    return E.predict_by_profile(tr, tr_s, te, te_s, E.vocabulary(t.job_links, 20))


@query("cls_5_signature_predictor", _TT + "SELECT job_id, role, predicted FROM A")
def _(t):
    return strategy_a(t)


@query("cls_6_profile_predictor", _TT + "SELECT job_id, role, predicted FROM B")
def _(t):
    return strategy_b(t)


@query("agg_34_precision_at_1", _TT + """, g AS (SELECT role, count(*) AS n, count_if(role = predicted) AS k FROM B GROUP BY 1), u AS (SELECT * FROM g UNION ALL SELECT '(all)', sum(n), sum(k) FROM g)
  SELECT role, n::BIGINT AS n, k::BIGINT AS right, round(k / n, 6) AS "precision" FROM u""".replace(" AS right,", ' AS "right",'))
def _(t):
    return E.precision_at_1(strategy_b(t)).withColumn("precision", R("precision"))


@query("cls_7_strategy_report", (_TT + """, j AS (SELECT A.predicted = A.role AS a, B.predicted = B.role AS b FROM A JOIN B USING (job_id)),
  cc AS (SELECT count(*) AS n, count_if(a AND b) AS bo, count_if(a AND NOT b) AS ao, count_if(NOT a AND b) AS b0, count_if(NOT a AND NOT b) AS ne FROM j)
""").replace("WITH ", "WITH RECURSIVE ", 1) + """, ct AS (SELECT n, bo AS "both", ao AS a_only, b0 AS b_only, ne AS neither, CASE WHEN ao + b0 > 0 THEN (abs(ao - b0) - 1) ^ 2 / (ao + b0) ELSE 0 END AS statistic FROM cc)
  """ + RECURSIVE_TAIL + """SELECT "both", a_only, b_only, neither, round(statistic, 6) AS statistic, round(("both" + a_only) / n, 6) AS precision_a,
   round(("both" + b_only) / n, 6) AS precision_b, round(p_value, 6) AS p_value, decision FROM ct, pv, de""")
def _(t):
    a = strategy_a(t).select("job_id", "role", F.col("predicted").alias("a"))
    b = strategy_b(t).select("job_id", F.col("predicted").alias("b"))
    c = E.contingency(a.join(b, "job_id"), F.col("a") == F.col("role"), F.col("b") == F.col("role"))
    n = F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither")
    c = E.with_decision(c).withColumn("p_value", R("p_value"))
    return c.withColumn("precision_a", R((F.col("both") + F.col("a_only")) / n)).withColumn(
        "precision_b", R((F.col("both") + F.col("b_only")) / n)).withColumn("statistic", R("statistic"))


# --- drawn tables ---------------------------------------------------------------------------

def role_profiles(t):
    return t.roles.select(F.col("c_custkey").alias("profile_id"), "role")


def _uniform(seed, *keys):
    """The draw of ``splits.uniform`` as SQL."""
    text = " || '|' || ".join(f"{k}::VARCHAR" for k in keys)
    return f"((('0x' || substr(md5({text} || '|{seed}'), 1, 13))::BIGINT + 0.5) / {float(1 << 52)!r})"


_FREQ = TFIDF_SQL + """, rp AS (SELECT c_custkey AS profile_id, n_name AS role FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""
_CHOICE = P_SQL + f""", sz AS (SELECT role, count(*)::DOUBLE AS w FROM jr GROUP BY 1),
  cu AS (SELECT role, sum(w) OVER (ORDER BY role) AS upto, sum(w) OVER () AS total FROM sz),
  dr AS (SELECT c_custkey AS demand_id, min(role) AS role FROM customer CROSS JOIN cu WHERE upto >= {_uniform(42, 'c_custkey')} * total GROUP BY 1)
"""


@query("smp_5_weighted_sample", _FREQ + f""", k AS (SELECT profile_id, rp.role, skill, row_number() OVER (PARTITION BY profile_id ORDER BY -ln({_uniform(42, 'profile_id', 'skill')}) / freq, skill) AS r FROM rp JOIN f USING (role))
  SELECT profile_id, role, count(*)::INTEGER AS n, string_agg(skill, '; ' ORDER BY skill) AS owned FROM k WHERE r <= profile_id % 11 + 2 GROUP BY 1, 2""")
def _(t):
    freq = M.raw_frequency(t.postings, t.posting_skills).select("role", "skill", "freq")
    size = F.col("profile_id") % 11 + 2
    drawn = SPL.weighted_sample(role_profiles(t), SPL.role_pools(freq), size)
    return drawn.select("profile_id", "role", F.size("owned").alias("n"), F.array_join("owned", "; ").alias("owned"))


@query("smp_6_weighted_choice", _CHOICE + "SELECT demand_id, role FROM dr")
def _(t):
    sizes = M.role_sizes(t.postings).withColumn("role_jobs", F.col("role_jobs").cast("double"))
    demands = t.customer.select(F.col("c_custkey").alias("demand_id"))
    return SPL.weighted_choice(demands, "demand_id", sizes, "role", "role_jobs")


@query("smp_7_profile_targets", _FREQ + f""", k AS (SELECT profile_id, rp.role, skill, row_number() OVER (PARTITION BY profile_id ORDER BY
     -ln({_uniform(42, 'profile_id', 'skill')}) / CASE WHEN {_uniform(44, 'profile_id')} < 0.8 THEN freq ELSE 1.0 END, skill) AS r FROM rp JOIN f USING (role)),
  ow AS (SELECT profile_id, role, skill FROM k WHERE r <= floor({_uniform(43, 'profile_id')} * 11) + 2),
  oa AS (SELECT profile_id, role, string_agg(skill, '; ' ORDER BY skill) AS owned FROM ow GROUP BY 1, 2),
  go AS (SELECT oa.profile_id, count(*) AS n, max(1 - exp(-2 * scaled)) AS top FROM oa JOIN ti USING (role) WHERE NOT EXISTS (SELECT 1 FROM ow WHERE ow.profile_id = oa.profile_id AND ow.skill = ti.skill) GROUP BY 1)
  SELECT profile_id, role, owned, coalesce(n, 0)::INTEGER AS targets, round(top, 6) AS top_target FROM oa LEFT JOIN go USING (profile_id)""")
def _(t):
    freq = M.raw_frequency(t.postings, t.posting_skills).select("role", "skill", "freq")
    scaled = M.tfidf(t.postings, t.posting_skills).select("role", "skill", "scaled")
    p = SPL.profile_targets(role_profiles(t), freq, scaled)
    return p.select("profile_id", "role", F.array_join("owned", "; ").alias("owned"), F.size("targets").alias("targets"),
                    R(F.array_max(F.transform("targets", lambda x: x["target"]))).alias("top_target"))


@query("smp_8_demand_rows", TFIDF_SQL + _MAP + f""", sz1 AS (SELECT role, count(*)::DOUBLE AS w FROM jr GROUP BY 1),
  cu AS (SELECT role, sum(w) OVER (ORDER BY role) AS upto, sum(w) OVER () AS total FROM sz1),
  dr AS (SELECT c_custkey AS demand_id, min(role) AS role FROM customer CROSS JOIN cu WHERE upto >= {_uniform(42, 'c_custkey')} * total GROUP BY 1),
  rd AS (SELECT role, skill, round(scaled, 6) AS sc FROM ti QUALIFY row_number() OVER (PARTITION BY role ORDER BY sc DESC, skill) <= 15),
  vl AS (SELECT DISTINCT role, course_id FROM rd JOIN sm USING (skill) JOIN c ON c.skill = equivalent),
  nb AS (SELECT role, course_id, row_number() OVER (PARTITION BY role ORDER BY md5(course_id::VARCHAR || '|42'), course_id) AS number, count(*) OVER (PARTITION BY role) AS valid FROM vl),
  sk AS (SELECT role, string_agg(skill, '; ' ORDER BY skill) AS skills FROM rd GROUP BY 1)
  SELECT demand_id, dr.role, skills, course_id FROM dr JOIN nb ON nb.role = dr.role AND number = floor({_uniform(45, 'demand_id')} * valid) + 1 JOIN sk ON sk.role = dr.role""")
def _(t):
    sizes = M.role_sizes(t.postings).withColumn("role_jobs", F.col("role_jobs").cast("double"))
    demands = t.customer.select(F.col("c_custkey").alias("demand_id"))
    d = SPL.demand_rows(demands, sizes, role_demand(t), skill_map(t), t.course_skills)
    return d.select("demand_id", "role", F.array_join("skills", "; ").alias("skills"), "course_id")


# --- sets, gates, validation ---------------------------------------------------------------

_SYN = {"red bolt": "bolt", "small bolt": "bolt", "hot ring": "ring"}


@query("set_2_gazetteer", """WITH s AS (SELECT DISTINCT p_name AS surface, 'postings' AS source, 0 AS prio FROM part JOIN lineitem ON p_partkey = l_partkey UNION SELECT DISTINCT split_part(p_name, ' ', 2), 'courses', 1 FROM part
    UNION SELECT DISTINCT lower(p_type), 'dictionary', 2 FROM part UNION SELECT DISTINCT p_name, 'dictionary', 2 FROM part),
  c AS (SELECT *, CASE surface WHEN 'red bolt' THEN 'bolt' WHEN 'small bolt' THEN 'bolt' WHEN 'hot ring' THEN 'ring' ELSE surface END AS canonical FROM s WHERE length(surface) >= 2 AND surface NOT IN ('promo', 'old plate'))
  SELECT surface, canonical, source FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY prio, surface) AS r FROM c) WHERE r = 1 OR surface <> canonical""")
def _(t):
    used = t.lineitem.select("l_partkey").distinct()
    names = t.part.join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_name").alias("skill"))
    second = t.part.select(F.substring_index("p_name", " ", -1).alias("skill"))
    types = t.part.select(F.explode(F.array("p_type", "p_name")).alias("skill"))
    return Q.gazetteer([("postings", names), ("courses", second), ("dictionary", types)], _SYN, ["promo", "old plate"])


@query("set_6_review_partition", """WITH v AS (SELECT DISTINCT p_brand AS skill FROM part WHERE p_size > 10),
  s AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS skill, CASE WHEN p_retailprice % 3 < 1 THEN 'low' WHEN p_retailprice % 3 < 2 THEN 'medium' ELSE 'high' END AS risk FROM part)
  SELECT id, skill, risk, CASE WHEN risk = 'low' AND skill IN (SELECT skill FROM v) THEN 'validated' WHEN risk = 'low' THEN 'unmapped' WHEN risk = 'high' THEN 'rejected' ELSE 'pending' END AS part FROM s""")
def _(t):
    m = F.col("p_retailprice") % 3
    s = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("skill"),
                      F.when(m < 1, "low").when(m < 2, "medium").otherwise("high").alias("risk"))
    vocab = t.part.where("p_size > 10").select(F.col("p_brand").alias("skill"))
    return Q.review_partition(s, vocab).select("id", "skill", "risk", "part")


@query("set_7_union_roles", """WITH d AS (SELECT DISTINCT c_nationkey AS id, c_mktsegment AS role FROM customer WHERE c_acctbal > 5000), s AS (SELECT DISTINCT c_nationkey AS id, c_mktsegment AS role FROM customer)
  SELECT id, role, 'data' AS layer FROM d UNION ALL SELECT id, role, 'suggested' FROM (SELECT * FROM s EXCEPT SELECT * FROM d)""")
def _(t):
    c = t.customer.select(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("role"), "c_acctbal")
    return Q.union_roles(c.where("c_acctbal > 5000").select("id", "role").distinct(), c.select("id", "role").distinct(), "id", "role")


@query("qlt_1_quality_gates", _DSPLIT + """SELECT 'rows:documents' AS "check", count(*) > 0 AS passed, count(*)::VARCHAR AS detail FROM documents UNION ALL SELECT 'rows:orders', count(*) > 0, count(*)::VARCHAR FROM orders
  UNION ALL SELECT 'roles', count(*) = 25, count(*)::VARCHAR FROM nation UNION ALL SELECT 'vocabulary', count(*) BETWEEN 500 AND 1200, count(*)::VARCHAR FROM (SELECT DISTINCT p_brand, p_name FROM part JOIN lineitem ON l_partkey = p_partkey)
  UNION ALL SELECT 'split_overlap', count(*) = 0, count(*)::VARCHAR FROM (SELECT doc_id FROM ds GROUP BY 1 HAVING count(DISTINCT split) > 1)""")
def _(t):
    return Q.quality_gates({"documents": t.documents, "orders": t.orders}, t.job_links.select("skill"), t.nation.select("n_name"),
                           SPL.document_split(sourced_docs(t)), "doc_id", 25, (500, 1200))


@query("qlt_2_record_validation", """SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN length(repeat(c_name, c_nationkey)) > 255 THEN 'name_length' END, CASE WHEN c_custkey % 7 = 0 THEN 'skill_length' END,
   CASE WHEN NOT (c_acctbal / 100 BETWEEN 0 AND 60) THEN 'years_range' END], lambda x: x IS NOT NULL), '|') AS broken FROM customer""")
def _(t):
    skills = F.array("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, F.repeat("c_mktsegment", 20)).otherwise("ok"))
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.expr("repeat(c_name, c_nationkey)").alias("name"), F.lit("1").alias("phone"),
                             skills.alias("skills"), (F.col("c_acctbal") / 100).alias("years"))
    return rows.select("id", F.array_join(Q.violations(Q.profile_rules()), "|").alias("broken"))


@query("qlt_3_output_invariants", """SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'level_known' END, CASE WHEN o_totalprice / 400000 NOT BETWEEN 0 AND 1 THEN 'score_range' END], lambda x: x IS NOT NULL), '|') AS broken
  FROM orders WHERE o_orderstatus NOT IN ('O', 'F') OR o_totalprice / 400000 NOT BETWEEN 0 AND 1""")
def _(t):
    rules = {"score_range": (F.col("o_totalprice") / 400000).between(0, 1), "level_known": F.col("o_orderstatus").isin("O", "F")}
    rows = t.orders.select(F.col("o_orderkey").alias("id"), Q.violations(rules).alias("b"))
    return rows.where(F.size("b") > 0).select("id", F.array_join("b", "|").alias("broken"))


@query("src_14_manifest", """SELECT 'postings' AS artifact, count(*) AS rows FROM orders UNION ALL SELECT 'skills', count(DISTINCT p_brand || ' ' || p_name) FROM part JOIN lineitem ON l_partkey = p_partkey
  UNION ALL SELECT 'documents', count(*) FROM documents""")
def _(t):
    m = Q.manifest({"postings": t.postings, "skills": t.job_links.select("skill").distinct(), "documents": t.documents})
    return m.select("artifact", "rows")


@query("src_14_manifest_hashes")
def _(t):
    return Q.manifest({"postings": t.postings, "documents": t.documents, "events": t.events})


# --- history -----------------------------------------------------------------------------------

def history_log(t):
    """Events as an analysis log: an id per user and slot, stages by event type."""
    stage = (F.when(F.col("event_type") == "click", "extract").when(F.col("event_type") == "view", "analyze")
             .when(F.col("event_type") == "error", "deleted").otherwise("pivot"))
    return t.events.select(
        F.concat_ws("-", "user_id", F.col("event_id") % 97).alias("id"), "user_id", F.col("ts").alias("updated_at"),
        stage.alias("stage"), F.col("value").alias("score"), F.get_json_object("props", "$.k").alias("k"))


_GROUPS = {"extract": ["user_id", "k"], "analyze": ["score", "k"], "pivot": ["score"]}
_LOG = """WITH lg AS (SELECT user_id || '-' || (event_id % 97) AS id, user_id, ts AS tsx, CASE event_type WHEN 'click' THEN 'extract' WHEN 'view' THEN 'analyze' WHEN 'error' THEN 'deleted' ELSE 'pivot' END AS stage, value AS score, json_extract_string(props, '$.k') AS k FROM events),
  cs AS (SELECT id, min(tsx) AS created_at, max(tsx) AS updated_at, max_by(user_id, tsx) FILTER (stage = 'extract') AS extract_user_id, max_by(k, tsx) FILTER (stage = 'extract') AS extract_k,
    max_by(score, tsx) FILTER (stage = 'analyze') AS analyze_score, max_by(k, tsx) FILTER (stage = 'analyze') AS analyze_k, max_by(score, tsx) FILTER (stage = 'pivot') AS pivot_score
   FROM lg GROUP BY 1 HAVING NOT bool_or(stage = 'deleted'))
"""
_TIMES = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"


def _printed(df):
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("his_1_current_state", _LOG + f"SELECT * REPLACE ({_TIMES.replace(' AS created_at, ', ' AS created_at, ')}) FROM cs")
def _(t):
    return _printed(H.current_state(history_log(t), _GROUPS))


@query("his_1_maintained_state", _LOG + f"SELECT * REPLACE ({_TIMES}) FROM cs")
def _(t):
    log = history_log(t).withColumn("part", F.pmod(F.crc32("id"), F.lit(3)))
    state = H.MaintainedState(t.spark, new_path(t.spark, "history"), _GROUPS)
    # deletions of one part come before its entries, the stages of the others in two updates
    for rows in ("part = 0 AND stage = 'deleted'", "part > 0 AND stage = 'extract'",
                 "part = 0 AND stage <> 'deleted'", "part > 0 AND stage <> 'extract'"):
        state.update(log.where(rows).drop("part"))
    return _printed(state.current())


@query("top_5_history_listing", _LOG + f"SELECT id, {_TIMES} FROM cs WHERE extract_user_id = 7 ORDER BY cs.created_at DESC")
def _(t):
    state = H.current_state(history_log(t), _GROUPS)
    return _printed(H.listing(state, "extract_user_id", 7)).select("id", "created_at", "updated_at")


@query("top_5_history_item", _LOG + "SELECT id, analyze_score, pivot_score FROM cs WHERE id = (SELECT min(id) FROM cs)")
def _(t):
    state = H.current_state(history_log(t), _GROUPS)
    return H.item(state, state.agg(F.min("id")).scalar()).select("id", "analyze_score", "pivot_score")
