"""Market, ranking and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import dates, numeric
from talentgrid.operators import market as M
from talentgrid.operators.quantiles import count_quantiles, histogram
from talentgrid.operators.tables import dense_index, top_n, with_totals
from talentgrid.plans.registry import query
from talentgrid.plans.views import P_SQL

R = lambda c, d=6: F.round(c, d)


def with_flags(t):
    """Postings with a nullable remote flag (text) and the number of skills."""
    flag = t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.max(F.when(F.col("l_linestatus") == "O", "1.0").otherwise("0.0")).alias("remote")
    )
    n = t.job_links.groupBy("job_id").agg(F.count("*").alias("skill_count"))
    return t.postings.join(flag, "job_id", "left").join(n, "job_id", "left").withColumn(
        "skill_count", F.coalesce("skill_count", F.lit(0))
    )


FLAG_SQL = P_SQL + """, fl AS (SELECT jr.*, r.remote, coalesce(n.k, 0) AS skill_count FROM jr
  LEFT JOIN (SELECT l_orderkey AS job_id, max(CASE WHEN l_linestatus='O' THEN '1.0' ELSE '0.0' END) AS remote
             FROM lineitem GROUP BY 1) r USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) AS k FROM ls GROUP BY 1) n USING (job_id))
"""
COUNTS_SQL = P_SQL + ", rs AS (SELECT role, skill, count(*) AS n FROM p GROUP BY 1, 2), " \
    "sz AS (SELECT role, count(*) AS role_jobs FROM jr GROUP BY 1)"
TFIDF_SQL = COUNTS_SQL + """, f AS (SELECT rs.*, n / role_jobs AS freq FROM rs JOIN sz USING (role)),
  d AS (SELECT *, count(*) OVER (PARTITION BY skill) AS df FROM f),
  x AS (SELECT *, freq * ln((SELECT count(*) FROM sz) / (1 + df)) AS tfidf FROM d),
  y AS (SELECT *, min(tfidf) OVER (PARTITION BY role) AS lo, max(tfidf) OVER (PARTITION BY role) AS hi FROM x),
  ti AS (SELECT role, skill, n, freq, df, tfidf, CASE WHEN hi - lo < 1e-8 THEN 0.5 ELSE (tfidf - lo) / (hi - lo) END AS scaled FROM y)
"""


@query("agg_1_value_counts", "SELECT o_orderpriority AS emp_type, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return M.value_counts(t.orders.select(F.col("o_orderpriority").alias("emp_type")), "emp_type")


@query("agg_2_skill_counts", P_SQL + "SELECT skill, count(*) AS n FROM p GROUP BY 1")
def _(t):
    # explode of the list form; counts only need the distinct job links
    lists = t.job_links.groupBy("job_id").agg(F.collect_set("skill").alias("skills"))
    return M.skill_counts(lists.select(F.explode("skills").alias("skill")))


@query("agg_3_cleaning_audit", P_SQL + """SELECT skill, count(*) AS before,
  CAST(sum(CASE WHEN skill IN ('Brand#1','Brand#13') THEN 0 ELSE 1 END) AS BIGINT) AS after,
  skill IN ('Brand#1','Brand#13') AS is_noise FROM pb GROUP BY 1""")
def _(t):
    noise = ["Brand#1", "Brand#13"]
    raw = t.job_links.select("job_id", F.col("brand").alias("skill")).distinct()
    clean = raw.where(~F.col("skill").isin(noise))
    return M.cleaning_audit(raw, clean, noise)


@query("agg_4_missing_rate", FLAG_SQL + """, g AS (SELECT role, count(*) AS total, count_if(skill_count = 0) AS missing FROM fl GROUP BY 1),
  u AS (SELECT * FROM g UNION ALL SELECT '(all)', sum(total), sum(missing) FROM g)
  SELECT role, CAST(total AS BIGINT) AS total, CAST(missing AS BIGINT) AS missing, round(100.0 * missing / total, 1) AS missing_pct FROM u""")
def _(t):
    return M.missing_rate(with_flags(t))


@query("agg_5_competition", P_SQL + """SELECT role, round(avg(applicants), 6) AS mean_applicants,
  round(median(applicants), 6) AS median_applicants, count(*) AS jobs FROM jr GROUP BY 1""")
def _(t):
    return M.competition(t.postings).select(
        "role", R("mean_applicants").alias("mean_applicants"),
        R("median_applicants").alias("median_applicants"), "jobs")


@query("agg_6_remote_rate", """WITH b AS (SELECT p_type AS role, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS rem
  FROM lineitem JOIN part ON l_partkey = p_partkey),
  g AS (SELECT role, count(*) AS total, sum(rem) AS r FROM b WHERE rem IS NOT NULL GROUP BY 1),
  u AS (SELECT * FROM g UNION ALL SELECT '(all)', sum(total), sum(r) FROM g)
  SELECT role, CAST(total AS BIGINT) AS total, CAST(r AS BIGINT) AS remote_jobs, round(100.0 * r / total, 6) AS remote_pct FROM u""")
def _(t):
    flag = F.when(F.col("l_returnflag") == "R", "1.0").when(F.col("l_returnflag") == "A", "0.0")
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("role"), flag.alias("remote"))
    return M.remote_rate(rows).withColumn("remote_pct", R("remote_pct"))


@query("agg_6_remote_kpi", """SELECT round(100.0 * sum(CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END) / count(*), 6) AS remote_pct FROM lineitem""")
def _(t):
    flag = F.when(F.col("l_returnflag") == "R", "1.0").when(F.col("l_returnflag") == "A", "0.0")
    return t.lineitem.select(flag.alias("remote")).agg(R(M.remote_share_kpi()).alias("remote_pct"))


@query("agg_7_level_mix", P_SQL + """, top AS (SELECT role FROM jr GROUP BY 1 ORDER BY count(*) DESC, role LIMIT 10)
  SELECT role, round(100.0 * count_if(level='O') / count(*), 6) AS O, round(100.0 * count_if(level='F') / count(*), 6) AS F,
         round(100.0 * count_if(level='P') / count(*), 6) AS P, 0.0::DOUBLE AS X
  FROM jr JOIN top USING (role) GROUP BY 1""")
def _(t):
    mix = M.level_mix(t.postings, "level", ["O", "F", "P", "X"], 10)
    return mix.select("role", *[R(c).alias(c) for c in ["O", "F", "P", "X"]])


@query("agg_8_collapse_rare", """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
  SELECT CASE WHEN n >= (SELECT sum(n) FROM g) * 0.05 THEN source ELSE 'other' END AS source, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1""")
def _(t):
    return M.collapse_rare(t.documents, "source", 0.05)


@query("agg_9_penetration", COUNTS_SQL + """, r12 AS (SELECT role FROM jr GROUP BY 1 ORDER BY count(*) DESC, role LIMIT 12),
  s20 AS (SELECT skill FROM p GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT 20)
  SELECT r12.role, s20.skill, round(coalesce(n, 0) / role_jobs * 100, 6) AS pct
  FROM r12 CROSS JOIN s20 JOIN sz USING (role) LEFT JOIN rs ON rs.role = r12.role AND rs.skill = s20.skill""")
def _(t):
    return M.penetration(t.postings, t.posting_skills, 12, 20).withColumn("pct", R("pct"))


@query("agg_10_role_profile", COUNTS_SQL + """SELECT role, skill, round(n / role_jobs, 6) AS share FROM rs JOIN sz USING (role)
  WHERE skill IN (SELECT skill FROM p GROUP BY 1 HAVING count(*) >= 15)""")
def _(t):
    return M.role_profile(t.postings, t.posting_skills, 15).withColumn("share", R("share"))


@query("agg_11_raw_frequency", COUNTS_SQL + "SELECT role, skill, n, round(n / role_jobs, 6) AS freq FROM rs JOIN sz USING (role)")
def _(t):
    return M.raw_frequency(t.postings, t.posting_skills).select("role", "skill", "n", R("freq").alias("freq"))


@query("agg_12_max_normalised", COUNTS_SQL + "SELECT role, skill, n, round(n / max(n) OVER (PARTITION BY role), 6) AS weight FROM rs")
def _(t):
    return M.max_normalised(M.role_skill_counts(t.posting_skills)).select(
        "role", "skill", "n", R("weight").alias("weight"))


@query("agg_13_versatility", COUNTS_SQL + """SELECT skill, count(*) AS roles_using, round(count(*) / (SELECT count(*) FROM sz), 6) AS versatility FROM rs GROUP BY 1""")
def _(t):
    return M.versatility(M.role_skill_counts(t.posting_skills), t.postings).withColumn(
        "versatility", R("versatility"))


@query("agg_14_skill_trend", P_SQL + """, k AS (SELECT max(posted) - INTERVAL 6 MONTH AS cut FROM jr),
  z AS (SELECT greatest(count_if(posted >= cut), 1) AS a, greatest(count_if(posted < cut), 1) AS b FROM jr, k),
  g AS (SELECT skill, count_if(posted >= cut) AS n_recent, count_if(posted < cut) AS n_older FROM p, k GROUP BY 1)
  SELECT skill, CAST(n_recent AS BIGINT) AS n_recent, CAST(n_older AS BIGINT) AS n_older,
         round(greatest(0.0, least(1.0, n_recent / a - n_older / b + 0.5)), 6) AS trend FROM g, z""")
def _(t):
    return M.skill_trend(t.postings, t.posting_skills).withColumn("trend", R("trend"))


@query("agg_15_affinity", COUNTS_SQL + "SELECT role, skill, n, round(n / sum(n) OVER (PARTITION BY skill), 6) AS affinity FROM rs")
def _(t):
    return M.affinity(M.role_skill_counts(t.posting_skills)).select(
        "role", "skill", "n", R("affinity").alias("affinity"))


@query("agg_16_tfidf", TFIDF_SQL + "SELECT role, skill, n, df, round(tfidf, 6) AS tfidf, round(scaled, 6) AS scaled FROM ti")
def _(t):
    return M.tfidf(t.postings, t.posting_skills).select(
        "role", "skill", "n", "df", R("tfidf").alias("tfidf"), R("scaled").alias("scaled"))


@query("mth_4_saturating_priority", TFIDF_SQL + "SELECT role, skill, round(1 - exp(-2 * scaled), 6) AS priority FROM ti")
def _(t):
    return M.priority(M.tfidf(t.postings, t.posting_skills)).select(
        "role", "skill", R("priority").alias("priority"))


@query("rnk_1_top_priority_skills", TFIDF_SQL + """, r AS (SELECT role, skill, n, round(1 - exp(-2 * scaled), 6) AS priority FROM ti)
  SELECT role, skill, n, priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY priority DESC, n DESC, skill) AS rank FROM r) WHERE rank <= 7""")
def _(t):
    scored = M.priority(M.tfidf(t.postings, t.posting_skills)).select(
        "role", "skill", "n", R("priority").alias("priority"))
    return top_n(scored, 7, F.desc("priority"), F.desc("n"), F.asc("skill"), by=["role"], rank="rank").withColumn(
        "rank", F.col("rank").cast("long"))


@query("rnk_1_top_skills_per_role", COUNTS_SQL + "SELECT role, skill, n FROM rs QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, skill) <= 12")
def _(t):
    return top_n(M.role_skill_counts(t.posting_skills), 12, F.desc("n"), F.asc("skill"), by=["role"])


@query("rnk_2_signature_sets", COUNTS_SQL + """, q AS (SELECT role, skill FROM rs QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, skill) <= 3)
  SELECT role, array_to_string(list_sort(list(skill)), '; ') AS signature FROM q GROUP BY 1""")
def _(t):
    top = top_n(M.role_skill_counts(t.posting_skills), 3, F.desc("n"), F.asc("skill"), by=["role"])
    # three rows per role
    return top.groupBy("role").agg(
        F.array_join(F.array_sort(F.collect_set("skill")), "; ").alias("signature"))


@query("rnk_4_minmax_per_role", COUNTS_SQL + """SELECT role, skill, round((n - min(n) OVER w) / greatest(max(n) OVER w - min(n) OVER w, 1), 6) AS minmax,
  round(n / max(n) OVER w, 6) AS maxnorm FROM rs WINDOW w AS (PARTITION BY role)""")
def _(t):
    counts = with_totals(M.role_skill_counts(t.posting_skills), ["role"],
                         F.min("n").alias("lo"), F.max("n").alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    return counts.select("role", "skill", R((F.col("n") - F.col("lo")) / span).alias("minmax"),
                         R(F.col("n") / F.col("hi")).alias("maxnorm"))


@query("agg_17_period_trend", P_SQL + "SELECT strftime(posted, '%Y-%m') AS period, role, count(*) AS n FROM jr GROUP BY 1, 2")
def _(t):
    return M.period_trend(t.postings, dates.year_month(F.col("posted")), "role")


@query("agg_17_yearly_trend", "SELECT CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return M.period_trend(t.orders.select(F.col("o_orderdate").alias("posted")), F.year("posted"))


@query("agg_18_top_skill_trend", P_SQL + """SELECT strftime(posted, '%Y-%m') AS period, skill, count(*) AS n FROM p
  WHERE skill IN (SELECT skill FROM p GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT 8) GROUP BY 1, 2""")
def _(t):
    return M.top_skill_trend(t.posting_skills, dates.year_month(F.col("posted")), 8)


@query("agg_19_kpi_block", FLAG_SQL + """SELECT count(*) AS jobs, count(DISTINCT role) AS roles, (SELECT count(DISTINCT skill) FROM p) AS skills,
  (SELECT count(*) FROM supplier) AS courses, round(100.0 * sum(CASE WHEN remote = '1.0' THEN 1 ELSE 0 END) / count(*), 6) AS remote_pct,
  round((SELECT count(*) FROM p) / count(*), 6) AS mean_skills FROM fl""")
def _(t):
    return M.kpi_block(with_flags(t), t.job_links, t.supplier).withColumn(
        "remote_pct", R("remote_pct")).withColumn("mean_skills", R("mean_skills"))


@query("agg_20_role_card", FLAG_SQL + """, b AS (SELECT role, count(*) AS jobs, avg(applicants) AS ma, 100.0 * sum(CASE WHEN remote='1.0' THEN 1 ELSE 0 END) / count(*) AS rp FROM fl GROUP BY 1),
  rs AS (SELECT role, skill, count(*) AS n FROM p GROUP BY 1, 2), l AS (SELECT role, sum(n) AS links FROM rs GROUP BY 1),
  q AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, skill) AS rank FROM rs QUALIFY rank <= 5)
  SELECT role, jobs, round(ma, 6) AS mean_applicants, round(rp, 6) AS remote_pct, round(links / jobs, 6) AS mean_skills,
         CAST(rank AS INTEGER) AS rank, skill, round(n / jobs * 100, 6) AS skill_pct FROM b JOIN l USING (role) JOIN q USING (role)""")
def _(t):
    card = M.role_card(with_flags(t), t.posting_skills)
    return card.select("role", "jobs", R("mean_applicants").alias("mean_applicants"),
                       R("remote_pct").alias("remote_pct"), R("mean_skills").alias("mean_skills"),
                       "rank", "skill", R("skill_pct").alias("skill_pct"))


@query("agg_21_skills_histogram", FLAG_SQL + """, m AS (SELECT min(skill_count) AS lo, max(skill_count) AS hi FROM fl)
  SELECT CAST(least(29, floor((skill_count - lo) / (hi - lo) * 30)) AS BIGINT) AS bin, count(*) AS n FROM fl, m GROUP BY 1""")
def _(t):
    return histogram(with_flags(t), F.col("skill_count"), 30)


@query("agg_21_skills_median", FLAG_SQL + """SELECT role, round(median(skill_count), 6) AS median_skills FROM fl
  WHERE role IN (SELECT role FROM jr GROUP BY 1 ORDER BY count(*) DESC, role LIMIT 12) GROUP BY 1""")
def _(t):
    return M.skills_per_posting(with_flags(t), 12)


@query("agg_21_skills_summary", FLAG_SQL + "SELECT round(avg(skill_count), 6) AS mean_skills, round(median(skill_count), 6) AS median_skills FROM fl")
def _(t):
    rows = with_flags(t)
    med = count_quantiles(rows, "skill_count", [0.5]).select("quantile").scalar()
    return rows.agg(R(F.avg("skill_count")).alias("mean_skills")).withColumn("median_skills", med)


@query("agg_26_imbalance", P_SQL + """, sz AS (SELECT role, count(*) AS n FROM jr GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS roles, max(n) AS max_jobs, min(n) AS min_jobs,
   (SELECT role FROM sz ORDER BY n DESC, role LIMIT 1) AS largest, (SELECT role FROM sz ORDER BY n, role LIMIT 1) AS smallest,
   round(max(n) / min(n), 6) AS ratio FROM sz""")
def _(t):
    return M.imbalance(t.postings).withColumn("ratio", R("ratio"))


@query("agg_28_skill_correlation", P_SQL + """, top AS (SELECT skill, row_number() OVER (ORDER BY count(*) DESC, skill) AS slot FROM p GROUP BY 1 ORDER BY slot LIMIT 15),
  x AS (SELECT DISTINCT job_id, slot FROM p JOIN top USING (skill)), N AS (SELECT count(*)::DOUBLE AS n FROM jr),
  s AS (SELECT slot, count(*)::DOUBLE AS k FROM x GROUP BY 1),
  ab AS (SELECT a.slot AS i, b.slot AS j, count(*)::DOUBLE AS k FROM x a JOIN x b ON a.job_id = b.job_id AND a.slot < b.slot GROUP BY 1, 2)
  SELECT ta.skill AS skill_a, tb.skill AS skill_b,
    round((n * coalesce(ab.k, 0) - sa.k * sb.k) / sqrt(sa.k * (n - sa.k) * sb.k * (n - sb.k)), 6) AS corr
  FROM top ta JOIN top tb ON ta.slot < tb.slot JOIN s sa ON sa.slot = ta.slot JOIN s sb ON sb.slot = tb.slot
  CROSS JOIN N LEFT JOIN ab ON ab.i = ta.slot AND ab.j = tb.slot""")
def _(t):
    return M.skill_correlation(t.postings, t.posting_skills, 15).withColumn("corr", R("corr"))


@query("agg_37_vocabulary_index", P_SQL + "SELECT skill, row_number() OVER (ORDER BY skill) - 1 AS idx FROM (SELECT DISTINCT skill FROM p)")
def _(t):
    return dense_index(t.job_links.select("skill").distinct(), "skill")


@query("agg_38_catalog_categories", """SELECT n_name AS category, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1 ORDER BY n DESC, category LIMIT 20""")
def _(t):
    return top_n(M.value_counts(t.courses, "category"), 20, F.desc("n"), F.asc("category"))


@query("agg_39_skill_weights", P_SQL + """SELECT skill, coalesce(n, 1)::DOUBLE AS weight FROM (SELECT DISTINCT skill FROM c)
  LEFT JOIN (SELECT skill, count(*) AS n FROM p GROUP BY 1) USING (skill)""")
def _(t):
    return M.skill_weights(t.course_skills, t.posting_skills)


@query("agg_40_pooled_skills", P_SQL + "SELECT role, job_id, skill FROM p")
def _(t):
    return M.pooled_skills(t.posting_lists)


@query("cls_13_supply_gap", P_SQL + """, d AS (SELECT skill, count(*) AS jobs, row_number() OVER (ORDER BY count(*) DESC, skill) AS demand_rank FROM p GROUP BY 1 QUALIFY demand_rank <= 10),
  s AS (SELECT skill, count(*) AS courses, row_number() OVER (ORDER BY count(*) DESC, skill) AS supply_rank FROM c GROUP BY 1 QUALIFY supply_rank <= 10)
  SELECT skill, jobs, CAST(demand_rank AS INTEGER) AS demand_rank, courses, CAST(supply_rank AS INTEGER) AS supply_rank FROM d FULL JOIN s USING (skill)""")
def _(t):
    return M.supply_gap(t.posting_skills, t.course_skills, 10)


@query("jon_2_taught_and_demanded", P_SQL + "SELECT skill, count(*) AS n FROM c WHERE skill IN (SELECT skill FROM p) GROUP BY 1")
def _(t):
    return M.taught_and_demanded(t.course_skills, t.job_links)


@query("top_1_global_top_skills", P_SQL + "SELECT skill, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, skill LIMIT 25")
def _(t):
    return top_n(M.skill_counts(t.job_links), 25, F.desc("n"), F.asc("skill"))


@query("top_4_fixed_level_order", """SELECT level, ord, count(o_orderkey) AS n FROM (VALUES ('P', 0), ('O', 1), ('F', 2), ('X', 3)) v(level, ord)
  LEFT JOIN orders ON o_orderstatus = level GROUP BY 1, 2""")
def _(t):
    order = F.array(*[F.struct(F.lit(v).alias("level"), F.lit(i).alias("ord")) for i, v in enumerate("POFX")])
    levels = t.spark.range(1).select(F.inline(order))
    counts = M.value_counts(t.orders.select(F.col("o_orderstatus").alias("level")), "level")
    return levels.join(counts, "level", "left").fillna(0, ["n"]).orderBy("ord")


@query("top_8_top_roles_and_skills", P_SQL + """SELECT role, skill, count(*) AS n FROM p
  WHERE role IN (SELECT role FROM jr GROUP BY 1 ORDER BY count(*) DESC, role LIMIT 8)
    AND skill IN (SELECT skill FROM p GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT 30) GROUP BY 1, 2""")
def _(t):
    roles = M.top_values(t.postings, "role", 8)
    skills = M.top_values(t.job_links, "skill", 30)
    return M.role_skill_counts(
        t.posting_skills.join(roles, "role", "left_semi").join(skills, "skill", "left_semi"))


@query("set_1_level_specific_skills", P_SQL + """, a AS (SELECT skill FROM p WHERE level='O' GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT 12),
  b AS (SELECT skill FROM p WHERE level='F' GROUP BY 1 ORDER BY count(*) DESC, skill LIMIT 12)
  SELECT 'O' AS level, skill FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'F', skill FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(t):
    a = M.top_values(t.posting_skills.where("level = 'O'"), "skill", 12)
    b = M.top_values(t.posting_skills.where("level = 'F'"), "skill", 12)
    return a.subtract(b).select(F.lit("O").alias("level"), "skill").unionByName(
        b.subtract(a).select(F.lit("F").alias("level"), "skill"))


@query("mth_2_period_labels", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m') AS year_month,
  strftime(o_orderdate, '%b %Y') AS label, count(*) AS n FROM orders GROUP BY 1, 2, 3""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.groupBy(F.year(d).alias("year"), dates.year_month(d).alias("year_month"),
                            dates.month_label(d).alias("label")).agg(F.count("*").alias("n"))


@query("mth_3_six_month_cutoff", """SELECT strftime(max(o_orderdate) - INTERVAL 6 MONTH, '%Y-%m-%d') AS cutoff,
  (SELECT count(*) FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 6 MONTH FROM orders)) AS recent FROM orders""")
def _(t):
    cutoff = t.orders.agg(dates.months_before(F.max("o_orderdate"), 6)).scalar()
    return t.orders.agg(
        F.date_format(F.first(cutoff), "yyyy-MM-dd").alias("cutoff"),
        F.count_if(F.col("o_orderdate") >= cutoff).alias("recent"))


@query("mth_10_multi_hot", P_SQL + """, v AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS idx FROM (SELECT DISTINCT brand FROM ls))
  SELECT DISTINCT job_id, idx FROM ls JOIN v USING (brand)""")
def _(t):
    # sparse rows of the multi-hot matrix: (posting, vocabulary index)
    links = t.job_links.select("job_id", "brand").distinct()
    vocab = dense_index(links.select("brand").distinct(), "brand")
    return links.join(vocab, "brand").select("job_id", "idx")


@query("flt_16_support_tiers", P_SQL + """SELECT role, count(*) AS n, CASE WHEN count(*) >= 500 THEN 'OK' WHEN count(*) >= 200 THEN 'MED'
  WHEN count(*) >= 100 THEN 'LOW' ELSE 'MIN' END AS tier FROM jr GROUP BY 1""")
def _(t):
    return M.value_counts(t.postings, "role").withColumn("tier", numeric.support_tier(F.col("n")))


@query("flt_16_score_tiers", """WITH s AS (SELECT o_orderkey AS id, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS x FROM orders)
  SELECT id, CASE WHEN x >= 0.75 THEN 'excellent' WHEN x >= 0.55 THEN 'high' WHEN x >= 0.35 THEN 'moderate' ELSE 'low' END AS readiness,
   CASE WHEN x >= 0.85 THEN 'low' WHEN x >= 0.6 THEN 'medium' ELSE 'high' END AS risk,
   CASE WHEN floor(x * 100 + 0.5) >= 75 THEN 'green' WHEN floor(x * 100 + 0.5) >= 50 THEN 'amber' ELSE 'red' END AS band FROM s""")
def _(t):
    x = F.col("o_totalprice") / t.orders.agg(F.max("o_totalprice")).scalar()
    return t.orders.select(F.col("o_orderkey").alias("id"), numeric.readiness_level(x).alias("readiness"),
                           numeric.confidence_risk(x).alias("risk"), numeric.score_band(x).alias("band"))
