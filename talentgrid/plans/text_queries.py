"""Role labelling, dictionary extraction and key-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid import fixed_values as V
from talentgrid.functions import text, tokens
from talentgrid.operators import lookups as L
from talentgrid.operators import market as M
from talentgrid.operators import roles as RL
from talentgrid.operators import skills as S
from talentgrid.operators.tables import spread, top_n
from talentgrid.plans.registry import query
from talentgrid.plans.views import P_SQL, sql_list

R = lambda c, d=6: F.round(c, d)
ROLE_RULES = {
    "Fastening Engineer": ["bolt", "large bolt", "rod"],
    "Ring Designer": ["ring", "red ring"],
    "Plate Analyst": ["plate", "econ"],
    "Prose Editor": ["the ", "und ", "ement"],
    "Source Steward": ["src1", "brand#1"],
    "Tooling Lead": ["gizmo", "widget", "promo"],
}


def labelled_input(t):
    """Documents as descriptions with the part of the same key as title fields."""
    d = spread(t.documents)
    rows = d.join(t.part, F.col("doc_id") == F.col("p_partkey"), "left")
    return rows.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("p_type")).alias("standardizedTitle"),
                       F.col("p_name").alias("title"), F.col("p_brand").alias("jobFunction"),
                       F.col("source").alias("industries"), F.col("text").alias("descriptionText"))


_RULE_VALUES = ", ".join(f"('{r}', {i}, '{k}', {j})" for i, (r, ks) in enumerate(ROLE_RULES.items()) for j, k in enumerate(ks))
_LABEL_SQL = f"""WITH kw(role, ro, kw, ko) AS (VALUES {_RULE_VALUES}),
  b AS (SELECT doc_id, unnest([1, 2, 3, 4, 5]) AS f, unnest([5, 4, 2, 1, 1]) AS w, unnest(['standardizedTitle', 'title', 'jobFunction', 'industries', 'descriptionText']) AS fname,
    unnest([lower(coalesce(CASE WHEN doc_id % 3 <> 0 THEN p_type END, '')), lower(coalesce(p_name, '')), lower(coalesce(p_brand, '')), lower(source), lower(text)]) AS s
    FROM documents LEFT JOIN part ON doc_id = p_partkey),
  h AS (SELECT doc_id, role, ro, f, w, fname, min_by(kw, ko) AS kw FROM b JOIN kw ON contains(s, kw) GROUP BY 1, 2, 3, 4, 5, 6)
"""


@query("cls_1_role_labels", _LABEL_SQL + f"""SELECT d.doc_id, coalesce(role, '{V.FALLBACK_ROLE}') AS role_label, CAST(coalesce(score, 0) AS INTEGER) AS label_score, coalesce(src, 'fallback') AS label_source, coalesce(kw, 'fallback_no_match') AS label_keyword
  FROM documents d LEFT JOIN (SELECT doc_id, role, sum(w) AS score, min_by(fname, f) AS src, min_by(kw, f) AS kw FROM h GROUP BY doc_id, role, ro
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sum(w) DESC, ro) = 1) USING (doc_id)""")
def _(t):
    return RL.classify_roles(labelled_input(t), "doc_id", RL.rules_table(t.spark, ROLE_RULES))


@query("jon_18_keyword_contains", _LABEL_SQL + "SELECT doc_id, role, fname AS field, kw AS keyword FROM h")
def _(t):
    fields = [f for f, _w in V.FIELD_WEIGHTS]
    hits = RL.keyword_hits(labelled_input(t), fields, RL.rules_table(t.spark, ROLE_RULES))
    long = hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.role", F.posexplode("h.words").alias("i", "keyword"))
    return long.where("keyword IS NOT NULL").select(
        "doc_id", "role", F.get(F.array(*[F.lit(f) for f in fields]), F.col("i")).alias("field"), "keyword")


@query("rnk_3_argmax_role", _LABEL_SQL + "SELECT doc_id, role, CAST(sum(w) AS BIGINT) AS score FROM h GROUP BY doc_id, role, ro QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sum(w) DESC, ro) = 1")
def _(t):
    from talentgrid.operators.tables import best_row

    fields = [f for f, _w in V.FIELD_WEIGHTS]
    w = F.array(*[F.lit(x) for _f, x in V.FIELD_WEIGHTS])
    hits = RL.keyword_hits(labelled_input(t), fields, RL.rules_table(t.spark, ROLE_RULES))
    long = hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.role", "h.role_order", F.posexplode("h.words").alias("i", "kw"))
    scores = long.where("kw IS NOT NULL").groupBy("doc_id", "role", "role_order").agg(F.sum(F.get(w, F.col("i"))).alias("score"))
    return best_row(scores, ["doc_id"], F.struct(F.col("score"), -F.col("role_order")), "role", "score")


@query("jon_1_role_table", P_SQL + """SELECT 'R' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS role_id, n_name AS role, n_name || '; ' || r_name AS keywords, count(job_id) AS total_rows
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN jr ON jr.role = n_name AND jr.level = 'P' GROUP BY ALL""")
def _(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = F.array(F.struct(F.col("n_name").alias("keyword"), F.lit(0).alias("keyword_order")),
                    F.struct(F.col("r_name").alias("keyword"), F.lit(1).alias("keyword_order")))
    rules = n.select(F.col("n_name").alias("role"), F.col("n_nationkey").alias("role_order"), F.inline(pairs))
    return RL.role_summary(rules, t.postings.where("level = 'P'").withColumnRenamed("role", "role_label"))


@query("jon_4_synonyms", P_SQL + """SELECT sk AS skill, count(*) AS n FROM (SELECT CASE WHEN skill LIKE '% red %' THEN replace(skill, ' red ', ' crimson ') ELSE skill END AS sk FROM p) GROUP BY 1""")
def _(t):
    red = t.job_links.select("skill").distinct().where(F.contains("skill", F.lit(" red ")))
    mapping = red.select(F.col("skill").alias("raw"), F.replace("skill", F.lit(" red "), F.lit(" crimson ")).alias("canonical"))
    # count first: the mapping then meets one row per skill instead of one per posting
    counts = L.synonyms(M.skill_counts(t.job_links), "skill", mapping)
    return counts.groupBy("skill").agg(F.sum("n").alias("n"))


@query("jon_10_role_resolution", """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN n_name END AS resolved FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = F.when(F.col("c_custkey") % 11 == 0, F.lit("Astronaut")).otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")))
    reqs = rows.select(F.col("c_custkey").alias("id"), asked.alias("role"))
    return L.resolve_roles(reqs, t.nation.select(F.col("n_name").alias("role"))).select("id", "resolved")


@query("jon_13_role_courses", """WITH ct AS (SELECT s_suppkey AS course_id, CASE WHEN s_suppkey % 2 = 0 THEN c_mktsegment ELSE initcap_seg || ' studies' END AS category
   FROM supplier JOIN (SELECT c_custkey, c_mktsegment, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS initcap_seg FROM customer) ON c_custkey = s_suppkey),
  r AS (SELECT DISTINCT c_mktsegment AS role FROM customer UNION SELECT DISTINCT c_mktsegment || ' Lead' FROM customer),
  ex AS (SELECT role, category FROM r JOIN (SELECT DISTINCT category FROM ct) ON role = category),
  lo AS (SELECT role, category FROM r JOIN (SELECT DISTINCT category FROM ct) ON contains(lower(category), lower(split_part(role, ' ', 1))) WHERE role NOT IN (SELECT role FROM ex))
  SELECT role, category, course_id FROM (SELECT * FROM ex UNION ALL SELECT * FROM lo) JOIN ct USING (category)""")
def _(t):
    seg = F.col("c_mktsegment")
    cat = F.when(F.col("s_suppkey") % 2 == 0, seg).otherwise(F.concat(F.initcap(F.lower(seg)), F.lit(" studies")))
    courses = t.supplier.join(t.customer, F.col("c_custkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("course_id"), cat.alias("category"))
    roles = t.customer.select(F.explode(F.array(seg, F.concat(seg, F.lit(" Lead")))).alias("role")).distinct()
    return L.courses_for_role(roles, courses).select("role", "category", "course_id")


# --- fuzzy keys -----------------------------------------------------------------------

def typos(t):
    """Skill names without vowels, as misspelt words."""
    return t.job_links.select("skill").distinct().select(F.regexp_replace("skill", "[aeiou]", "").alias("word"))


def vocab(t):
    return t.job_links.select(F.col("skill").alias("key")).distinct()


_FUZZY = P_SQL + """, v AS (SELECT DISTINCT skill AS key FROM ls), w AS (SELECT DISTINCT regexp_replace(skill, '[aeiou]', '', 'g') AS word FROM ls),
  s AS (SELECT word, key, 1 - levenshtein(word, key) / greatest(length(word), length(key)) AS score FROM w JOIN v ON length(key) >= 0.6 * length(word) AND length(word) >= 0.6 * length(key))
"""


@query("jon_7_fuzzy_native", _FUZZY + "SELECT word, key, round(score, 6) AS score FROM s WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, key DESC) = 1")
def _(t):
    return L.nearest_key(typos(t), vocab(t), 0.7, "edit").withColumn("score", R("score"))


@query("jon_7_fuzzy_ratio")
def _(t):
    return L.nearest_key(typos(t), vocab(t), 0.8, "ratio").withColumn("score", R("score"))


@query("jon_5_mapping_cascade", """WITH nm AS (SELECT DISTINCT p_name FROM part),
  src AS (SELECT CASE WHEN p_name LIKE '% ring' THEN regexp_replace(p_name, '[aeiou]', '', 'g') ELSE p_name END AS skill FROM nm),
  cu AS (SELECT p_name AS skill, 'blue ' || split_part(p_name, ' ', 2) AS mapped FROM nm WHERE p_name LIKE 'red %'),
  c AS (SELECT * FROM cu WHERE skill IN (SELECT skill FROM src) AND mapped IN (SELECT p_name FROM nm)),
  ex AS (SELECT skill, skill AS mapped FROM src WHERE skill NOT IN (SELECT skill FROM c) AND skill IN (SELECT p_name FROM nm)),
  nr AS (SELECT skill, p_name AS mapped FROM src, nm WHERE skill NOT IN (SELECT skill FROM c) AND skill NOT IN (SELECT skill FROM ex)
    AND 1 - levenshtein(skill, p_name) / greatest(length(skill), length(p_name)) >= 0.7 QUALIFY row_number() OVER (PARTITION BY skill ORDER BY 1 - levenshtein(skill, p_name) / greatest(length(skill), length(p_name)) DESC, p_name DESC) = 1)
  SELECT *, 'curated' AS step FROM c UNION ALL SELECT *, 'exact' FROM ex UNION ALL SELECT *, 'nearest' FROM nr""")
def _(t):
    names = t.part.select("p_name").distinct()
    src = names.select(F.when(F.col("p_name").endswith(" ring"), F.regexp_replace("p_name", "[aeiou]", "")).otherwise(F.col("p_name")).alias("skill"))
    curated = names.where(F.col("p_name").startswith("red ")).select(
        F.col("p_name").alias("skill"), F.concat(F.lit("blue "), F.substring_index("p_name", " ", -1)).alias("mapped"))
    return L.mapping_cascade(src, names.select(F.col("p_name").alias("skill")), curated, 0.7, "edit")


def taxonomy(t):
    """p_name → its smallest type, keys ordered by name."""
    return t.part.groupBy(F.col("p_name").alias("key")).agg(F.min("p_type").alias("category"))


@query("jon_15_category_cascade", """WITH tx AS (SELECT p_name AS key, min(p_type) AS category FROM part GROUP BY 1),
  w AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'old-' || split_part(p_name, ' ', 2) WHEN 2 THEN replace(p_name, 'e', 'ee') ELSE p_brand END AS word FROM part),
  al AS (SELECT DISTINCT 'old-' || split_part(p_name, ' ', 2) AS raw, 'Old ' || split_part(p_name, ' ', 2) AS canonical FROM part WHERE p_name NOT LIKE '%bolt'),
  b AS (SELECT word, lower(word) AS low, t1.category AS c1, canonical, t2.category AS c2 FROM w LEFT JOIN tx t1 ON t1.key = lower(word) LEFT JOIN al ON raw = lower(word) LEFT JOIN tx t2 ON t2.key = lower(canonical)),
  nr AS (SELECT low, key AS near, category AS c3 FROM (SELECT DISTINCT low FROM b WHERE c1 IS NULL AND canonical IS NULL), tx WHERE 1 - levenshtein(low, key) / greatest(length(low), length(key)) >= 0.8
    QUALIFY row_number() OVER (PARTITION BY low ORDER BY 1 - levenshtein(low, key) / greatest(length(low), length(key)) DESC, key DESC) = 1)
  SELECT word, CASE WHEN c1 IS NOT NULL THEN coalesce(canonical, word) WHEN canonical IS NOT NULL THEN canonical WHEN near IS NOT NULL THEN
     upper(substr(near, 1, 1)) || split_part(substr(near, 2), ' ', 1) || ' ' || upper(substr(split_part(near, ' ', 2), 1, 1)) || substr(split_part(near, ' ', 2), 2) ELSE word END AS name,
   coalesce(c1, CASE WHEN canonical IS NOT NULL THEN coalesce(c2, 'other_tools') ELSE coalesce(c3, 'other_tools') END) AS category FROM b LEFT JOIN nr USING (low)""")
def _(t):
    n2 = F.substring_index("p_name", " ", -1)
    k = F.col("p_size") % 4
    words = t.part.select(F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit("old-"), n2)).when(
        k == 2, F.replace("p_name", F.lit("e"), F.lit("ee"))).otherwise(F.col("p_brand")).alias("word"))
    aliases = t.part.where(~F.col("p_name").endswith("bolt")).select(
        F.concat(F.lit("old-"), n2).alias("raw"), F.concat(F.lit("Old "), n2).alias("canonical")).distinct()
    return L.category_cascade(words, taxonomy(t), aliases, 0.8, "edit")


@query("jon_16_category_contains", """WITH tx AS (SELECT p_name AS key, min(p_type) AS category FROM part WHERE p_name NOT LIKE 'small%' GROUP BY 1),
  w AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN p_brand || ' ' || p_name WHEN 1 THEN split_part(p_name, ' ', 2) ELSE upper(p_name) END AS word FROM part),
  m AS (SELECT word, category, CASE WHEN key = lower(word) THEN 0 ELSE 1 END AS q, key FROM w JOIN tx ON contains(lower(word), key) OR contains(key, lower(word)))
  SELECT word, coalesce(category, 'other_tools') AS category FROM w LEFT JOIN (SELECT word, category FROM m QUALIFY row_number() OVER (PARTITION BY word ORDER BY q, key) = 1) USING (word)""")
def _(t):
    k = F.col("p_size") % 3
    words = t.part.select(F.when(k == 0, F.concat_ws(" ", "p_brand", "p_name")).when(
        k == 1, F.substring_index("p_name", " ", -1)).otherwise(F.upper("p_name")).alias("word")).distinct()
    tax = taxonomy(t).where(~F.col("key").startswith("small")).withColumn("key_order", F.col("key"))
    return L.containment_category(words, "word", tax)


# --- dictionary extraction ---------------------------------------------------------------

def phrase_dictionary(t):
    """Long words and adjacent word pairs of the benchmark texts; canonical = marked surface."""
    words = F.regexp_extract_all("text", F.lit(f"{tokens.WORD}{{8,}}"), F.lit(0))
    ws = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat(F.get(ws, i - 1), F.lit(" "), F.get(ws, i)))
    pairs = F.filter(pairs, lambda p: p.rlike(rf"^{tokens.WORD}+ {tokens.WORD}+$"))
    surf = t.benchmark.select(F.explode(F.concat(words, pairs)).alias("surface")).select(F.lower("surface").alias("surface")).distinct()
    return surf.withColumn("canonical", F.concat(F.lit("skill:"), F.col("surface")))


_HITS_SQL = r"""WITH bt AS (SELECT string_split(text, ' ') AS ws, text FROM benchmark),
  dict AS (SELECT DISTINCT lower(s) AS phrase FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{8,}')) AS s FROM bt UNION ALL
     SELECT ws[i] || ' ' || ws[i + 1] FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM bt) WHERE regexp_matches(ws[i] || ' ' || ws[i + 1], '^[\p{L}\p{N}_]+ [\p{L}\p{N}_]+$'))),
  pc AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^\p{L}\p{N}_]*[\p{L}\p{N}_]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[^\p{L}\p{N}_]*[\p{L}\p{N}_]+'), 1) AS i FROM documents),
  wd0 AS (SELECT doc_id, i, piece, regexp_replace(piece, '^[^\p{L}\p{N}_]+', '') AS word, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM pc),
  wd AS (SELECT doc_id, i, word, stop - length(word) AS start, stop, lead(piece) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM wd0),
  cand AS (SELECT doc_id, start, stop, lower(word) AS phrase FROM wd UNION ALL SELECT doc_id, start, stop + length(nxt), lower(word || nxt) FROM wd WHERE nxt IS NOT NULL),
  hit AS (SELECT doc_id, start, stop, 'skill:' || phrase AS skill FROM cand JOIN dict USING (phrase))
"""
_GREEDY = """, gl AS (SELECT doc_id, list_reduce(list({'s': start, 'e': stop, 'k': [skill]} ORDER BY start, stop DESC), lambda a, h: CASE WHEN h.s >= a.e THEN {'s': h.s, 'e': h.e, 'k': list_concat(a.k, h.k)} ELSE a END, {'s': 0::BIGINT, 'e': 0::BIGINT, 'k': []::VARCHAR[]}) AS r FROM hit GROUP BY 1)
"""


@query("cls_2_dictionary_skills", _HITS_SQL + _GREEDY + """SELECT d.doc_id, coalesce(array_to_string(list_sort(list_distinct(r.k)), '; '), '') AS skills, coalesce(len(list_distinct(r.k)), 0) AS skill_count FROM documents d LEFT JOIN gl USING (doc_id)""")
def _(t):
    out = S.extract_skills(spread(t.documents), "doc_id", "text", phrase_dictionary(t))
    return out.select("doc_id", F.array_join("skills", "; ").alias("skills"), F.col("skill_count").cast("long").alias("skill_count"))


@query("cls_4_first_occurrences", _HITS_SQL + """SELECT doc_id, skill, h.start AS start, h.stop AS stop FROM (SELECT doc_id, skill, min_by({'start': start, 'stop': stop}, start) AS h FROM hit JOIN documents USING (doc_id) WHERE length(trim(text)) >= 50 GROUP BY 1, 2)""")
def _(t):
    h = S.first_occurrences(spread(t.documents), "doc_id", "text", phrase_dictionary(t))
    return h.select("doc_id", "skill", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("cls_3_known_skill_scan", f"SELECT doc_id, array_to_string(list_filter([{sql_list(V.KNOWN_SKILLS)}], lambda s: contains(lower(text), s)), '; ') AS skills FROM documents")
def _(t):
    return spread(t.documents).select("doc_id", F.array_join(text.known_skills_in(F.col("text")), "; ").alias("skills"))


@query("fun_7_whitespace_tokens", r"""WITH pc AS (SELECT doc_id, unnest(regexp_extract_all(text, '\s*\S+')) AS piece, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) AS i FROM documents),
  e AS (SELECT doc_id, i, regexp_replace(piece, '^\s+', '') AS token, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM pc)
  SELECT doc_id, i - 1 AS pos, token, stop - length(token) AS start, stop AS "end" FROM e""")
def _(t):
    rows = spread(t.documents).select("doc_id", F.posexplode(tokens.whitespace_tokens(F.col("text"))).alias("pos", "t"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "t.token",
                       F.col("t.start").cast("long").alias("start"), F.col("t.end").cast("long").alias("end"))
