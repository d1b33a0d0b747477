"""Vector, gap, readiness and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import numeric
from talentgrid.operators import cooccurrence as CO
from talentgrid.operators import gap as G
from talentgrid.operators import lookups as L
from talentgrid.operators import market as M
from talentgrid.operators import pivots as PV
from talentgrid.operators import vectors as X
from talentgrid.operators.tables import best_row, cut_plan, top_n
from talentgrid.plans.market_queries import TFIDF_SQL
from talentgrid.plans.registry import query
from talentgrid.plans.views import P_SQL

R = lambda c, d=6: F.round(c, d)
DIM = 64
COS = "list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-9) * (sqrt(list_dot_product({b}, {b})) + 1e-9))"
VEC_SQL = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 ce0 AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY 1, 2),
 ce AS (SELECT label, list(m ORDER BY i) AS v FROM ce0 GROUP BY 1)
"""


def label_centroids(t):
    return X.centroids(t.embeddings, "label", DIM)


@query("src_8_vector_table", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, len(embedding) AS dim FROM embeddings")
def _(t):
    v = t.embeddings
    return v.select("vec_id", "label", R(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
                    F.size("embedding").cast("long").alias("dim"))


@query("agg_22_centroids", VEC_SQL + "SELECT label, i - 1 AS pos, round(v[i], 5) AS mean FROM ce, range(1, 65) r(i)")
def _(t):
    return label_centroids(t).select("label", F.posexplode("vector").alias("pos", "m")).select(
        "label", F.col("pos").cast("long").alias("pos"), R("m", 5).alias("mean"))


@query("mth_5_cosine", VEC_SQL + f"SELECT vec_id, round({COS.format(a='e.v', b='ce.v')}, 5) AS cos FROM e JOIN ce USING (label)")
def _(t):
    rows = t.embeddings.join(label_centroids(t), "label")
    return rows.select("vec_id", R(numeric.cosine(F.col("embedding"), F.col("vector")), 5).alias("cos"))


_UNIT = "list_transform({a}, lambda x: x / (sqrt(list_dot_product({a}, {a})) + 1e-9))"


@query("mth_6_vector_blend", VEC_SQL + f""", u AS (SELECT vec_id, e.v AS a, ce.v AS b, sqrt(list_dot_product(e.v, e.v)) + 1e-9 AS na, sqrt(list_dot_product(ce.v, ce.v)) + 1e-9 AS nb FROM e JOIN ce USING (label))
  SELECT vec_id, i - 1 AS pos, round(0.4 * a[i] / na + 0.6 * b[i] / nb, 5) AS x FROM u, range(1, 65) r(i)""")
def _(t):
    rows = t.embeddings.join(label_centroids(t), "label")
    return rows.select("vec_id", F.posexplode(numeric.blend_units(F.col("embedding"), F.col("vector"))).alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), R("x", 5).alias("x"))


_PAIR_SQL = VEC_SQL + f", s AS (SELECT e.vec_id, e.label AS own, ce.label AS role, {COS.format(a='e.v', b='ce.v')} AS sim FROM e CROSS JOIN ce)"


@query("jon_6_threshold_links", _PAIR_SQL + """, m AS (SELECT *, max(sim) OVER (PARTITION BY vec_id) AS top, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, role DESC) AS rn FROM s)
  SELECT vec_id, role, round(sim, 5) AS sim FROM m WHERE sim >= 0.6 OR (top < 0.6 AND rn = 1 AND sim > 0.3)""")
def _(t):
    cents = label_centroids(t).withColumnRenamed("label", "role")
    return PV.threshold_links(t.embeddings, cents, "vec_id", "role", left_vec="embedding").select(
        "vec_id", "role", R("sim", 5).alias("sim"))


@query("jon_9_role_similarity", _PAIR_SQL + "SELECT vec_id, role, round(sim, 5) AS sim FROM s WHERE role <> own")
def _(t):
    cents = label_centroids(t).withColumnRenamed("label", "role")
    rows = t.embeddings.withColumnRenamed("label", "own")
    return X.nearest(rows, cents, "vec_id", None, "role", left_vec="embedding", exclude="own").select(
        "vec_id", "role", R("sim", 5).alias("sim"))


@query("top_3_alternative_roles", _PAIR_SQL + """SELECT vec_id, role, round(sim, 5) AS sim, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, role) AS INTEGER) AS rank FROM s WHERE role <> own QUALIFY rank <= 4""")
def _(t):
    cents = label_centroids(t).withColumnRenamed("label", "role")
    rows = t.embeddings.withColumnRenamed("label", "own")
    return X.nearest(rows, cents, "vec_id", 4, "role", left_vec="embedding", exclude="own").select(
        "vec_id", "role", R("sim", 5).alias("sim"), "rank")


@query("jon_17_vector_default", VEC_SQL + """, k AS (SELECT s_suppkey AS course_id, (s_suppkey % 13)::VARCHAR AS category FROM supplier),
  w AS (SELECT CASE label WHEN 0 THEN 'Unknown' ELSE label::VARCHAR END AS category, v FROM ce)
  SELECT course_id, k.category, round(coalesce(w.v, (SELECT v FROM w WHERE category = 'Unknown'))[1], 5) AS first FROM k LEFT JOIN w USING (category)""")
def _(t):
    cat = F.when(F.col("label") == 0, "Unknown").otherwise(F.col("label").cast("string"))
    vectors = label_centroids(t).select(cat.alias("category"), "vector")
    rows = t.supplier.select(F.col("s_suppkey").alias("course_id"), (F.col("s_suppkey") % 13).cast("string").alias("category"))
    return X.lookup_with_default(rows, "category", vectors).select(
        "course_id", "category", R(F.get("vector", F.lit(0)), 5).alias("first"))


# posting vectors: embedding of the posting with that key, role = label
def posting_vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("job_id"), F.col("label").alias("role"), "embedding")


def labelled_skills(t):
    """Distinct (job, role = label, skill) of the postings that have a vector."""
    return posting_vectors(t).select("job_id", "role").join(t.job_links.drop("brand"), "job_id")


def vector_profiles(t):
    """Customers with a vector; the target role is the next label."""
    return t.embeddings.join(t.customer, F.col("vec_id") == F.col("c_custkey")).select(
        F.col("vec_id").alias("profile_id"), ((F.col("label") + 1) % 10).alias("target_role"),
        F.col("embedding").alias("vector"))


def customer_skills(t):
    return t.profile_skills.select("profile_id", "skill")


_RS = P_SQL + """, e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 un AS (SELECT vec_id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9)) AS u FROM e),
 js AS (SELECT un.vec_id AS job_id, un.label AS role, un.u, ls.skill FROM un JOIN ls ON ls.job_id = un.vec_id),
 pv AS (SELECT vec_id AS profile_id, (label + 1) % 10 AS target_role, u FROM un JOIN customer ON c_custkey = vec_id),
 ms AS (SELECT profile_id, target_role AS role, skill, sum(list_dot_product(pv.u, js.u)) AS mass FROM pv JOIN js ON js.role = pv.target_role GROUP BY 1, 2, 3)
"""


@query("agg_23_similarity_mass", _RS + "SELECT profile_id, role, skill, round(mass, 5) AS mass FROM ms")
def _(t):
    masses = X.skill_vectors(posting_vectors(t), labelled_skills(t), DIM)
    return X.similarity_mass(vector_profiles(t), masses).select("profile_id", "role", "skill", R("mass", 5).alias("mass"))


@query("cls_11_readiness", _RS + """, ow AS (SELECT ms.profile_id, sum(mass) AS own, count(*) AS matched FROM ms JOIN prof ON prof.profile_id = ms.profile_id AND prof.skill = ms.skill GROUP BY 1),
  tt AS (SELECT profile_id, sum(mass) AS total FROM ms GROUP BY 1)
  SELECT pv.profile_id, pv.target_role AS role, coalesce(matched, 0) AS matched, round(CASE WHEN coalesce(total, 0) <> 0 THEN coalesce(own, 0) / total ELSE 0.0 END, 4) AS score
  FROM pv LEFT JOIN tt USING (profile_id) LEFT JOIN ow USING (profile_id)""")
def _(t):
    masses = X.skill_vectors(posting_vectors(t), labelled_skills(t), DIM)
    return X.readiness(vector_profiles(t), customer_skills(t), masses, DIM).withColumn("score", R("score", 4))


_ALT = _RS + f""", wn AS (SELECT role, skill, n / max(n) OVER (PARTITION BY role) AS w FROM (SELECT role, skill, count(*) AS n FROM js GROUP BY 1, 2)),
  imp AS (SELECT * FROM wn WHERE w >= 0.1), ni AS (SELECT role, count(*) AS n FROM imp GROUP BY 1),
  ce0 AS (SELECT label AS role, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY 1, 2), ce AS (SELECT role, list(m ORDER BY i) AS v FROM ce0 GROUP BY 1),
  bs AS (SELECT profile_id, role, {COS.format(a='pv.u', b='ce.v')} AS sim FROM pv JOIN ce ON ce.role <> pv.target_role),
  bk AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY sim DESC, role) AS INTEGER) AS rank FROM bs QUALIFY rank <= 4),
  fl AS (SELECT profile_id, role, rank, sim, skill, w, EXISTS (SELECT 1 FROM prof WHERE prof.profile_id = bk.profile_id AND prof.skill = imp.skill) AS own FROM bk JOIN imp USING (role)),
  gp AS (SELECT profile_id, role, skill, row_number() OVER (PARTITION BY profile_id, role ORDER BY w DESC, skill) AS g FROM fl WHERE NOT own QUALIFY g <= 10)
  SELECT profile_id, role, any_value(rank) AS rank, round(any_value(sim), 5) AS sim, round(count_if(own) / count(*) * 100, 4) AS overlap_pct,
   coalesce(string_agg(skill, '; ' ORDER BY skill) FILTER (own), '') AS matched,
   coalesce((SELECT string_agg(skill, '; ' ORDER BY g) FROM gp WHERE gp.profile_id = fl.profile_id AND gp.role = fl.role), '') AS gap FROM fl GROUP BY profile_id, role"""


@query("cls_12_alternative_roles", _ALT)
def _(t):
    weights = M.max_normalised(M.role_skill_counts(labelled_skills(t)))
    owned = customer_skills(t).groupBy("profile_id").agg(F.array_sort(F.collect_set("skill")).alias("owned"))
    profiles = vector_profiles(t).join(owned, "profile_id", "left").withColumn(
        "owned", F.coalesce("owned", F.array().cast("array<string>")))
    cents = X.centroids(posting_vectors(t), "role", DIM)
    alt = G.alternative_roles(profiles, cents, weights)
    return alt.select("profile_id", "role", "rank", R("sim", 5).alias("sim"), R("overlap_pct", 4).alias("overlap_pct"),
                      F.array_join("matched", "; ").alias("matched"), F.array_join("gap", "; ").alias("gap"))


# --- gap and courses ------------------------------------------------------------------

_GAP = TFIDF_SQL + """, pr AS (SELECT role, skill, round(1 - exp(-2 * scaled), 6) AS priority FROM ti),
  wn AS (SELECT role, skill, n / max(n) OVER (PARTITION BY role) AS w FROM rs),
  pp AS (SELECT DISTINCT profile_id, target_role FROM prof),
  lk AS (SELECT pp.profile_id, pp.target_role, pr.skill, priority FROM pp JOIN pr ON pr.role = pp.target_role
         WHERE NOT EXISTS (SELECT 1 FROM prof x WHERE x.profile_id = pp.profile_id AND x.skill = pr.skill)),
  c20 AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY priority DESC, skill) AS rk FROM lk QUALIFY rk <= 20),
  c15 AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY rk) AS r2 FROM c20 WHERE priority > 0 QUALIFY r2 <= 15)
"""


def priorities(t):
    return M.priority(M.tfidf(t.postings, t.posting_skills)).select("role", "skill", R("priority").alias("priority"))


def missing_long(t):
    profiles = G.profile_lists(t.profile_skills)
    miss = G.missing_skills(profiles, G.ranked_role_skills(priorities(t), "priority"))
    return miss.select("profile_id", "target_role", F.posexplode("missing").alias("pos", "m")).select(
        "profile_id", "target_role", "pos", "m.skill", F.col("m.score").alias("priority"))


@query("top_2_missing_top_k", _GAP + "SELECT profile_id, target_role, CAST(r2 - 1 AS INTEGER) AS pos, skill, priority FROM c15")
def _(t):
    return missing_long(t)


@query("cls_8_skill_gap", _GAP + """, mt AS (SELECT p.profile_id, string_agg(p.skill, '; ' ORDER BY p.skill) AS matched FROM prof p JOIN wn ON wn.role = p.target_role AND wn.skill = p.skill WHERE w >= 0.1 GROUP BY 1),
  ms AS (SELECT profile_id, string_agg(skill, '; ' ORDER BY r2) AS missing, round(sum(priority), 6) AS missing_score FROM c15 GROUP BY 1)
  SELECT pp.profile_id, pp.target_role, coalesce(matched, '') AS matched, missing, missing_score FROM pp JOIN ms USING (profile_id) LEFT JOIN mt USING (profile_id)""")
def _(t):
    weights = M.max_normalised(M.role_skill_counts(t.posting_skills))
    g = G.skill_gap(G.profile_lists(t.profile_skills), priorities(t), weights)
    return g.select("profile_id", "target_role", F.array_join("matched", "; ").alias("matched"),
                    F.array_join("missing.skill", "; ").alias("missing"),
                    R(F.aggregate("missing", F.lit(0.0), lambda a, m: a + m["score"]), 6).alias("missing_score"))


_KNOWN = P_SQL + """, ps AS (SELECT profile_id, target_role, CASE WHEN length(skill) % 5 = 0 THEN ' ' || upper(substr(skill, 1, length(skill) - 1)) || 'x' WHEN length(skill) % 7 = 0 THEN 'unknown ' || reverse(skill) ELSE skill END AS raw FROM prof),
  vk AS (SELECT lower(skill) AS key, min(skill) AS skill FROM p GROUP BY 1),
  uw AS (SELECT DISTINCT lower(trim(raw)) AS w FROM ps WHERE lower(trim(raw)) NOT IN (SELECT key FROM vk)),
  nk AS (SELECT w, key FROM (SELECT w, key, 1 - levenshtein(w, key) / greatest(length(w), length(key)) AS s FROM uw CROSS JOIN vk) WHERE s >= 0.75 QUALIFY row_number() OVER (PARTITION BY w ORDER BY s DESC, key DESC) = 1),
  rp AS (SELECT DISTINCT profile_id, target_role, vk.skill FROM ps JOIN (SELECT key AS w, key FROM vk UNION ALL SELECT w, key FROM nk) m ON lower(trim(raw)) = m.w JOIN vk USING (key))
"""


def _recognised_sql(sql):
    """The same statement over recognised profile skills."""
    return _KNOWN + sql[len(P_SQL):].replace("FROM prof", "FROM rp").replace("JOIN prof ", "JOIN rp AS prof ")


def spelled(t, profiles=None):
    """Profile skills, all or of ``profiles``, as people write them: some in capitals with a wrong letter, some unknown."""
    n = F.length("skill")
    raw = F.when(n % 5 == 0, F.concat(F.lit(" "), F.upper(F.substring("skill", F.lit(1), n - 1)), F.lit("x"))).when(
        n % 7 == 0, F.concat(F.lit("unknown "), F.reverse("skill"))).otherwise(F.col("skill"))
    return (t.profile_skills if profiles is None else t.profile_skills_of(profiles)).withColumn("skill", raw)


def recognised_skills(t, profiles=None):
    return L.recognised(spelled(t, profiles), t.posting_vocabulary, 0.75, "edit")


@query("cls_8_recognised_gap", _recognised_sql(_GAP) + """, mt AS (SELECT p.profile_id, string_agg(p.skill, '; ' ORDER BY p.skill) AS matched FROM rp p JOIN wn ON wn.role = p.target_role AND wn.skill = p.skill WHERE w >= 0.1 GROUP BY 1),
  ms AS (SELECT profile_id, string_agg(skill, '; ' ORDER BY r2) AS missing FROM c15 GROUP BY 1)
  SELECT pp.profile_id, pp.target_role, coalesce(matched, '') AS matched, missing FROM pp JOIN ms USING (profile_id) LEFT JOIN mt USING (profile_id)""")
def _(t):
    weights = M.max_normalised(M.role_skill_counts(t.posting_skills))
    g = G.skill_gap(G.profile_lists(recognised_skills(t)), priorities(t), weights)
    return g.select("profile_id", "target_role", F.array_join("matched", "; ").alias("matched"),
                    F.array_join("missing.skill", "; ").alias("missing"))


@query("cls_11_recognised_readiness", _KNOWN + _RS[len(P_SQL):] + """, ow AS (SELECT ms.profile_id, sum(mass) AS own, count(*) AS matched FROM ms JOIN rp ON rp.profile_id = ms.profile_id AND rp.skill = ms.skill GROUP BY 1),
  tt AS (SELECT profile_id, sum(mass) AS total FROM ms GROUP BY 1)
  SELECT pv.profile_id, pv.target_role AS role, coalesce(matched, 0) AS matched, round(CASE WHEN coalesce(total, 0) <> 0 THEN coalesce(own, 0) / total ELSE 0.0 END, 4) AS score
  FROM pv LEFT JOIN tt USING (profile_id) LEFT JOIN ow USING (profile_id)""")
def _(t):
    masses = X.skill_vectors(posting_vectors(t), labelled_skills(t), DIM)
    profiles = vector_profiles(t)  # skills of the others would meet nothing
    owned = recognised_skills(t, profiles).select("profile_id", "skill")
    return X.readiness(profiles, owned, masses, DIM).withColumn("score", R("score", 4))


@query("cls_12_blended_roles", _KNOWN + _RS[len(P_SQL):] + f""", ce0 AS (SELECT label AS role, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY 1, 2), ce AS (SELECT role, list(m ORDER BY i) AS v FROM ce0 GROUP BY 1),
  kn AS (SELECT profile_id, count(*) AS known FROM rp GROUP BY 1),
  bl AS (SELECT a.profile_id, a.target_role, CASE WHEN known IS NULL THEN b.u WHEN b.u IS NULL THEN a.u ELSE list_transform(range(1, 65), lambda i: 0.4 * a.u[i] + 0.6 * b.u[i]) END AS u
         FROM pv a LEFT JOIN kn USING (profile_id) LEFT JOIN un b ON b.vec_id = a.profile_id + 1 WHERE known IS NOT NULL OR b.u IS NOT NULL),
  bs AS (SELECT profile_id, role, {COS.format(a='bl.u', b='ce.v')} AS sim FROM bl JOIN ce ON ce.role <> bl.target_role)
  SELECT profile_id, role, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY sim DESC, role) AS INTEGER) AS rank, round(sim, 5) AS sim FROM bs QUALIFY rank <= 4""")
def _(t):
    known = recognised_skills(t).groupBy("profile_id").agg(F.count("*").alias("known"))
    titles = t.embeddings.select((F.col("vec_id") - 1).alias("profile_id"), F.col("embedding").alias("title_vector"))
    rows = vector_profiles(t).join(known, "profile_id", "left").join(titles, "profile_id", "left")
    skills = F.when(F.col("known").isNotNull(), F.col("vector"))
    rows = rows.withColumn("vector", G.profile_vector(skills, F.col("title_vector"))).where("vector IS NOT NULL")
    cents = X.centroids(posting_vectors(t), "role", DIM)
    return X.nearest(rows, cents, "profile_id", 4, "role", exclude="target_role").select(
        "profile_id", "role", "rank", R("sim", 5).alias("sim"))


@query("jon_11_gap_anti_join", _GAP + """SELECT pp.profile_id, pp.target_role, wn.skill FROM pp JOIN wn ON wn.role = pp.target_role AND w >= 0.5
  WHERE NOT EXISTS (SELECT 1 FROM prof x WHERE x.profile_id = pp.profile_id AND x.skill = wn.skill)""")
def _(t):
    weights = M.max_normalised(M.role_skill_counts(t.posting_skills))
    return G.gap_against_role(G.profile_lists(t.profile_skills), weights, 0.5).drop("pos")


def skill_map(t):
    """Each posting skill maps to itself and to the same item of the next brand."""
    s = t.part.select("p_brand", "p_name").distinct()
    nxt = F.concat(F.lit("Brand#"), (F.substring("p_brand", 7, 3).cast("int") % 25 + 1).cast("string"))
    me = F.concat_ws(" ", "p_brand", "p_name")
    return s.select(me.alias("skill"), F.explode(F.array(me, F.concat_ws(" ", nxt, "p_name"))).alias("equivalent")).distinct()


_MAP = """, sm0 AS (SELECT DISTINCT p_brand || ' ' || p_name AS skill, p_name, substr(p_brand, 7)::INTEGER AS b FROM part),
  sm AS (SELECT skill, skill AS equivalent FROM sm0 UNION SELECT skill, 'Brand#' || (b % 25 + 1) || ' ' || p_name FROM sm0)
"""


@query("jon_8_equivalent_skills", _GAP + _MAP + "SELECT DISTINCT profile_id, equivalent AS skill FROM c15 JOIN sm USING (skill) WHERE equivalent IN (SELECT skill FROM c)")
def _(t):
    return G.equivalents(missing_long(t).select("profile_id", "skill"), skill_map(t), t.course_skills)


def role_demand(t, n=15):
    """Top skills per role by scaled tf-idf."""
    scored = M.tfidf(t.postings, t.posting_skills).select("role", "skill", R("scaled").alias("scaled"))
    return top_n(scored, n, F.desc("scaled"), F.asc("skill"), by=["role"])


def affinity_table(t):
    """Role × category affinity from label centroids (nation key modulo the labels)."""
    n = t.nation.select(F.col("n_name"), (F.col("n_nationkey") % 10).alias("label")).join(label_centroids(t), "label")
    return X.affinities(n.select(F.col("n_name").alias("role"), "vector"),
                        n.select(F.col("n_name").alias("category"), "vector"), "role", "category")


_AFF = """, e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 ce0 AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY 1, 2),
 ce AS (SELECT label, list(m ORDER BY i) AS v FROM ce0 GROUP BY 1),
 nv AS (SELECT n_name, v FROM nation JOIN ce ON n_nationkey % 10 = label),
 af AS (SELECT a.n_name AS role, b.n_name AS category, greatest(0.0, least(1.0, """ + COS.format(a="a.v", b="b.v") + """)) AS affinity FROM nv a CROSS JOIN nv b),
 sw AS (SELECT skill, coalesce(n, 1)::DOUBLE AS weight FROM (SELECT DISTINCT skill FROM c) LEFT JOIN (SELECT skill, count(*) AS n FROM p GROUP BY 1) USING (skill)),
 cn AS (SELECT course_id, count(*) AS course_n FROM c GROUP BY 1), cm AS (SELECT DISTINCT course_id, category FROM c)
"""


def _overlap_sql(key):
    return f""", dw AS (SELECT {key}, skill, coalesce(weight, 1.0) AS weight FROM dm LEFT JOIN sw USING (skill)),
 dz AS (SELECT {key}, count(*) AS dn, sum(weight) AS wsum FROM dw GROUP BY 1),
 bo AS (SELECT {key}, course_id, count(*) AS nb, sum(weight) AS bw FROM dw JOIN c USING (skill) GROUP BY 1, 2),
 ov AS (SELECT {key}, course_id, bw / wsum AS coverage, nb / (dn + course_n - nb) AS jaccard, nb / course_n AS prec FROM bo JOIN dz USING ({key}) JOIN cn USING (course_id)),
 oo AS (SELECT *, (coverage + jaccard + prec) / 3 AS overlap FROM ov)
"""


_DEM = TFIDF_SQL + _MAP + _AFF + """, rd AS (SELECT role, skill, round(scaled, 6) AS sc FROM ti QUALIFY row_number() OVER (PARTITION BY role ORDER BY sc DESC, skill) <= 15),
  dm AS (SELECT DISTINCT role, equivalent AS skill FROM rd JOIN sm USING (skill) WHERE equivalent IN (SELECT skill FROM c))""" + _overlap_sql("role")


def demand_overlap(t):
    demand = G.equivalents(role_demand(t).select("role", "skill"), skill_map(t), t.course_skills)
    return G.course_overlap(demand, t.course_skills, M.skill_weights(t.course_skills, t.job_links), key="role")


@query("jon_12_demand_course_overlap", _DEM + 'SELECT role, course_id, round(coverage, 6) AS coverage, round(jaccard, 6) AS jaccard, round(prec, 6) AS "precision" FROM oo')
def _(t):
    o = demand_overlap(t)
    return o.select("role", "course_id", *[R(c).alias(c) for c in ("coverage", "jaccard", "precision")])


@query("cls_10_match_targets", _DEM + """SELECT role, course_id, round(overlap * (0.4 + 0.6 * affinity) / max(overlap) OVER (PARTITION BY role), 5) AS target
  FROM oo JOIN cm USING (course_id) JOIN af USING (role, category)""")
def _(t):
    o = demand_overlap(t).join(t.courses.select("course_id", "category"), "course_id")
    return G.match_targets(o, affinity_table(t), "role").select("role", "course_id", R("match", 5).alias("target"))


_REC = _GAP + _MAP + _AFF + """, dm AS (SELECT DISTINCT profile_id, equivalent AS skill FROM c15 JOIN sm USING (skill) WHERE equivalent IN (SELECT skill FROM c))""" + _overlap_sql("profile_id") + """,
  mx AS (SELECT profile_id, course_id, overlap / max(overlap) OVER (PARTITION BY profile_id) AS rel FROM oo),
  al AS (SELECT pp.profile_id, pp.target_role AS role, s_suppkey AS course_id, 'https://learn.example.com/' || (s_suppkey // 2) AS url, n_name AS category FROM (SELECT DISTINCT profile_id, target_role FROM c15) pp CROSS JOIN supplier JOIN nation ON s_nationkey = n_nationkey),
  sc AS (SELECT al.profile_id, al.course_id, url, coalesce(rel, 0) * (0.4 + 0.6 * affinity) AS match, affinity FROM al JOIN af USING (role, category) LEFT JOIN mx USING (profile_id, course_id)),
  cb AS (SELECT *, round(0.6 * match + 0.4 * affinity, 7) AS combined FROM sc),
  ur AS (SELECT * FROM cb QUALIFY row_number() OVER (PARTITION BY profile_id, url ORDER BY combined DESC, course_id) = 1),
  rec AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY combined DESC, course_id) AS rank FROM ur QUALIFY rank <= 20)
"""


def recommendations(t):
    url = F.concat(F.lit("https://learn.example.com/"), F.floor(F.col("course_id") / 2).cast("string"))
    missing = cut_plan(missing_long(t).select("profile_id", F.col("target_role").alias("role"), "skill"))
    taught = cut_plan(t.course_skills.select("course_id", "skill"))
    rec = G.recommend_courses(missing, skill_map(t), t.courses.withColumn("url", url), taught,
                              M.skill_weights(taught, t.job_links), affinity_table(t))
    return rec, missing, taught


@query("cls_9_course_recommendation", _REC + "SELECT profile_id, course_id, round(match, 4) AS match FROM rec")
def _(t):
    rec, _missing, _taught = recommendations(t)
    return rec.select("profile_id", "course_id", R("match", 4).alias("match"))


@query("cls_9_covered_skills", _REC + """SELECT rec.profile_id, rec.course_id, string_agg(dm.skill, '; ' ORDER BY dm.skill) AS covered FROM rec JOIN dm USING (profile_id)
  JOIN c ON c.course_id = rec.course_id AND c.skill = dm.skill GROUP BY 1, 2""")
def _(t):
    rec, missing, taught = recommendations(t)
    demand = G.equivalents(missing.select("profile_id", "skill"), skill_map(t), taught)
    return G.covered_skills(rec, demand, taught).select(
        "profile_id", "course_id", F.array_join("covered", "; ").alias("covered"))


@query("rnk_6_best_row_per_url", """WITH u AS (SELECT l_orderkey AS profile_id, 'https://learn.example.com/' || (l_suppkey // 2) AS url, l_suppkey AS course_id, l_extendedprice AS score FROM lineitem),
  b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY profile_id, url ORDER BY score DESC, course_id) = 1)
  SELECT profile_id, url, course_id, score FROM b QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, url) <= 3""")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("profile_id"), F.concat(
        F.lit("https://learn.example.com/"), F.floor(F.col("l_suppkey") / 2).cast("string")).alias("url"),
        F.col("l_suppkey").alias("course_id"), F.col("l_extendedprice").alias("score"))
    best = best_row(rows, ["profile_id", "url"], F.struct(F.col("score"), -F.col("course_id")), "course_id", "score")
    return top_n(best, 3, F.desc("score"), F.asc("url"), by=["profile_id"])


@query("agg_24_conditional_cooccurrence", P_SQL + """, hit AS (SELECT DISTINCT x.profile_id, x.target_role, y.job_id FROM prof x JOIN p y ON y.role = x.target_role AND y.skill = x.skill),
  tot AS (SELECT profile_id, count(*) AS n FROM hit GROUP BY 1),
  g AS (SELECT h.profile_id, h.target_role, y.skill, count(*) AS k FROM hit h JOIN ls y USING (job_id) GROUP BY 1, 2, 3)
  SELECT g.profile_id, g.target_role, g.skill, round(k / n, 6) AS cooccurrence FROM g JOIN tot USING (profile_id)
  WHERE NOT EXISTS (SELECT 1 FROM prof x WHERE x.profile_id = g.profile_id AND x.skill = g.skill)""")
def _(t):
    return CO.conditional_cooccurrence(t.profile_skills, t.posting_skills).withColumn("cooccurrence", numeric.rounded(F.col("cooccurrence")))


@query("agg_25_four_signal_priority", P_SQL + """, hit AS (SELECT DISTINCT x.profile_id, x.target_role, y.job_id FROM prof x JOIN p y ON y.role = x.target_role AND y.skill = x.skill),
  tot AS (SELECT profile_id, count(*) AS n FROM hit GROUP BY 1),
  g AS (SELECT h.profile_id, h.target_role, y.skill, count(*) AS k FROM hit h JOIN ls y USING (job_id) GROUP BY 1, 2, 3),
  sz AS (SELECT role, count(*) AS role_jobs FROM jr GROUP BY 1), rs AS (SELECT role, skill, count(*) AS n FROM p GROUP BY 1, 2),
  vs AS (SELECT skill, count(*) / (SELECT count(*) FROM sz) AS v FROM rs GROUP BY 1),
  k6 AS (SELECT max(posted) - INTERVAL 6 MONTH AS cut FROM jr), z AS (SELECT count_if(posted >= cut) AS a, count_if(posted < cut) AS b FROM jr, k6),
  tr AS (SELECT skill, greatest(0.0, least(1.0, count_if(posted >= cut) / any_value(a) - count_if(posted < cut) / any_value(b) + 0.5)) AS t FROM p, k6, z GROUP BY 1)
  SELECT g.profile_id, g.target_role, g.skill, round(1 - exp(-2 * (rs.n / role_jobs + k / tot.n + v + t) / 4), 6) AS priority
  FROM g JOIN tot USING (profile_id) JOIN rs ON rs.role = g.target_role AND rs.skill = g.skill JOIN sz ON sz.role = g.target_role JOIN vs ON vs.skill = g.skill JOIN tr ON tr.skill = g.skill
  WHERE NOT EXISTS (SELECT 1 FROM prof x WHERE x.profile_id = g.profile_id AND x.skill = g.skill)""")
def _(t):
    counts = M.role_skill_counts(t.posting_skills)
    return G.four_signal_priority(
        CO.conditional_cooccurrence(t.profile_skills, t.posting_skills), M.raw_frequency(t.postings, t.posting_skills),
        M.versatility(counts, t.postings), M.skill_trend(t.postings, t.posting_skills),
    ).withColumn("priority", numeric.rounded(F.col("priority")))
