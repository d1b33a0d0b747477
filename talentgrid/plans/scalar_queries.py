"""Filters, recodes and scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid import fixed_values as V
from talentgrid.functions import answers, dates, lists, numeric, spans, text
from talentgrid.operators import filters
from talentgrid.plans.registry import query
from talentgrid.plans.views import CV_SQL, P_SQL, TOK_SQL, cv_texts, document_tokens, sql_list

R = lambda c, d=6: F.round(c, d)
# stop words of the four languages of the documents table
STOP_WORDS = {
    "de": ["der", "die", "und", "von", "ist", "für", "sich", "eine"],
    "en": ["the", "and", "of", "in", "to", "with", "that", "for"],
    "es": ["el", "los", "las", "y", "del", "por", "una", "con"],
    "fr": ["le", "les", "et", "des", "pour", "dans", "que", "un"],
}


def attribute(t):
    """Order priority with sentinel spellings mixed in."""
    p = F.col("o_orderpriority")
    return (F.when(p == "3-MEDIUM", " Undefined ").when(p == "4-NOT SPECIFIED", "N/A")
            .when(p == "5-LOW", "").when(p == "2-HIGH", F.lit(None)).otherwise(p))


ATTR_SQL = """CASE o_orderpriority WHEN '3-MEDIUM' THEN ' Undefined ' WHEN '4-NOT SPECIFIED' THEN 'N/A'
  WHEN '5-LOW' THEN '' WHEN '2-HIGH' THEN NULL ELSE o_orderpriority END"""


@query("flt_1_null_safe_lower", "SELECT doc_id, lower(coalesce(CASE WHEN lang = 'es' THEN NULL ELSE text END, '')) AS norm FROM documents")
def _(t):
    return t.documents.select(
        "doc_id", text.norm_text(F.when(F.col("lang") != "es", F.col("text"))).alias("norm"))


@query("flt_2_sentinels_to_null", f"""SELECT o_orderkey AS id, CASE WHEN lower(trim(a)) NOT IN ('undefined','nan','none','') THEN a END AS cleaned
  FROM (SELECT o_orderkey, {ATTR_SQL} AS a FROM orders)""")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("id"),
                           text.null_sentinels(attribute(t)).alias("cleaned"))


@query("flt_3_usable_roles", f"""SELECT a AS role, count(*) AS n FROM (SELECT {ATTR_SQL} AS a FROM orders)
  WHERE a IS NOT NULL AND lower(trim(a)) NOT IN ('undefined', '') GROUP BY 1""")
def _(t):
    return filters.usable_roles(t.orders.select(attribute(t).alias("role"))).groupBy("role").agg(
        F.count("*").alias("n"))


@query("flt_4_optional_filters", P_SQL + """SELECT job_id, role, CAST(year(posted) AS INTEGER) AS year FROM jr
  WHERE role IN ('NATION_1', 'NATION_7') AND year(posted) IN (1996, 1999)""")
def _(t):
    rows = t.postings.select("job_id", "role", F.year("posted").alias("year"))
    return filters.optional_filters(
        rows, {"role": ["NATION_1", "NATION_7"], "year": [1996, 1999], "job_id": []})


EXCLUDED = [f"NATION_{i}" for i in range(13)]
MERGES = {f"NATION_{i}": f"NATION_{i + 1}" for i in (13, 15, 17, 19)}


@query("flt_5_excluded_roles", P_SQL + f"SELECT job_id, role FROM jr WHERE role NOT IN ({sql_list(EXCLUDED)})")
def _(t):
    return filters.drop_excluded_roles(t.postings, excluded=EXCLUDED).select("job_id", "role")


MERGE_CASE = "CASE role WHEN 'NATION_13' THEN 'NATION_14' WHEN 'NATION_15' THEN 'NATION_16' " \
    "WHEN 'NATION_17' THEN 'NATION_18' WHEN 'NATION_19' THEN 'NATION_20' ELSE role END"


@query("flt_6_role_merges", P_SQL + f"SELECT job_id, {MERGE_CASE} AS role FROM jr")
def _(t):
    return filters.merge_roles(t.postings, merges=MERGES).select("job_id", "role")


@query("flt_7_min_support", P_SQL + f""", m AS (SELECT job_id, {MERGE_CASE} AS role FROM jr)
  SELECT job_id, role FROM m WHERE role IN (SELECT role FROM m GROUP BY 1 HAVING count(*) >= 600)""")
def _(t):
    merged = filters.merge_roles(t.postings, merges=MERGES)
    return filters.min_support(merged, rows=600).select("job_id", "role")


@query("flt_8_postings_with_skills", P_SQL + "SELECT job_id, role, len(skills) AS skill_count FROM pl WHERE len(skills) > 0")
def _(t):
    return filters.with_skills(t.posting_lists).select(
        "job_id", "role", F.size("skills").cast("long").alias("skill_count"))


@query("flt_8_impute_no_skills", P_SQL + "SELECT job_id, CASE WHEN len(skills) = 0 THEN 'no_skills' ELSE array_to_string(skills, ', ') END AS skills FROM pl")
def _(t):
    return filters.impute_no_skills(t.posting_lists).select(
        "job_id", F.array_join("skills", ", ").alias("skills"))


@query("flt_9_language_gate", "SELECT doc_id FROM documents WHERE lang = 'en'")
def _(t):
    return filters.language_gate(t.documents, "text", STOP_WORDS, "en", "lang").select("doc_id")


_LANG_SCORES = " UNION ALL ".join(
    f"SELECT doc_id, '{code}' AS lang, len(list_intersect(toks, [{sql_list(ws)}])) AS score FROM tk"
    for code, ws in STOP_WORDS.items())


@query("flt_9_detected_language", rf"""WITH tk AS (SELECT doc_id, text, list_distinct(string_split_regex(lower(text), '[^\p{{L}}]+')) AS toks FROM documents),
  s AS ({_LANG_SCORES}), b AS (SELECT doc_id, lang, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) = 1)
  SELECT doc_id, CASE WHEN trim(text) = '' OR score = 0 THEN 'unknown' ELSE b.lang END AS lang FROM tk JOIN b USING (doc_id)""")
def _(t):
    return t.documents.select(
        "doc_id", text.detect_language(F.col("text"), STOP_WORDS).alias("lang"))


@query("flt_10_available_columns", P_SQL + """SELECT applicants AS "applicantsCount", emp_type AS "employmentType", role AS role_label, level AS final_role FROM jr""")
def _(t):
    p = t.postings.select(F.col("applicants").alias("applicantsCount"), "posted",
                          F.col("emp_type").alias("employmentType"),
                          F.col("role").alias("role_label"), F.col("level").alias("title"))
    return filters.project_available(p)


@query("flt_11_valid_skills", TOK_SQL + rf"""SELECT token, n FROM tk WHERE regexp_matches(token, '[a-zA-Z]') AND length(token) BETWEEN 2 AND 30
  AND (length(token) <> 2 OR lower(token) IN ({sql_list(V.SHORT_SKILLS_2)}))
  AND NOT regexp_matches(token, '[({{\[<"''/)\]>}}]$')
  AND length(regexp_replace(token, '[^\p{{L}}\p{{N}}\-+#./_ ]', '', 'g')) / length(token) >= 0.6
  AND lower(token) NOT IN ({sql_list(V.SKILL_BLOCKLIST)})
  AND NOT regexp_matches(token, '(?i)^[\p{{L}}\p{{N}}_.+-]+@|^https?://|^www\.')""")
def _(t):
    return document_tokens(t).where(text.is_valid_skill(F.col("token")))


_COMPANY = """(SELECT token AS s FROM tk UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part
  UNION SELECT upper(substr(p_name, 1, 1)) || substr(p_name, 2) FROM part)"""


@query("flt_12_valid_companies", TOK_SQL + rf"""SELECT s FROM {_COMPANY} WHERE length(s) >= 3 AND regexp_matches(s, '[a-zA-Z]') AND regexp_matches(s, '^\p{{Lu}}')
  AND (regexp_matches(s, '\s') OR (((upper(s) = s AND lower(s) <> s) OR length(s) >= 5) AND lower(s) NOT IN ({sql_list(V.COMPANY_BLOCKLIST)})))""")
def _(t):
    name = F.col("p_name")
    cap = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    rows = document_tokens(t).select(F.col("token").alias("s")).union(t.supplier.select("s_name")).union(
        t.part.select("p_name")).union(t.part.select(cap)).distinct()
    return rows.where(text.is_valid_company(F.col("s")))


@query("flt_13_valid_durations", r"""SELECT o_orderkey AS id, s FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%b %Y') || ' - present'
   WHEN 'O' THEN o_orderpriority ELSE (o_orderkey % 9) || CASE WHEN o_orderkey % 2 = 0 THEN ' tahun' ELSE ' items' END END AS s FROM orders)
  WHERE regexp_matches(s, '(?i)\b(20[0-3]\d|19\d\d)\b|\b(present|now|current|today|aktif|sekarang|tahun|bulan|years?|months?)\b')""")
def _(t):
    s = (F.when(F.col("o_orderstatus") == "F", F.concat(F.date_format("o_orderdate", "MMM yyyy"), F.lit(" - present")))
         .when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))
         .otherwise(F.concat((F.col("o_orderkey") % 9).cast("string"),
                             F.when(F.col("o_orderkey") % 2 == 0, " tahun").otherwise(" items"))))
    return t.orders.select(F.col("o_orderkey").alias("id"), s.alias("s")).where(
        text.is_valid_duration(F.col("s")))


@query("flt_14_garbage_values", f"""SELECT o_orderkey AS id, (a IS NULL OR a = '' OR lower(trim(a)) IN ({sql_list(V.GARBAGE_WORDS)})) AS garbage
  FROM (SELECT o_orderkey, {ATTR_SQL} AS a FROM orders)""")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), text.is_garbage(attribute(t)).alias("garbage"))


@query("flt_15_name_location_filters", TOK_SQL + f"""SELECT token,
  length(token) >= 3 AND NOT starts_with(token, 'http') AND NOT starts_with(token, 'www') AND lower(token) NOT IN ({sql_list(V.NAME_BLOCKLIST)}) AS name_ok,
  length(token) >= 3 AND lower(token) NOT IN ({sql_list(V.LOCATION_BLOCKLIST)}) AS location_ok FROM tk""")
def _(t):
    c = F.col("token")
    return document_tokens(t).select("token", text.is_valid_name(c).alias("name_ok"),
                                     text.is_valid_location(c).alias("location_ok"))


@query("flt_17_employment_buckets", """SELECT b AS bucket, count(*) AS n FROM (SELECT CASE WHEN upper(s) LIKE '%FULL%' THEN 'full_time' WHEN upper(s) LIKE '%CONTRACT%' THEN 'contract' ELSE 'other' END AS b
  FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Full-time' WHEN '2-HIGH' THEN 'FULL_TIME' WHEN '3-MEDIUM' THEN 'Contractor' ELSE o_orderpriority END AS s FROM orders)) GROUP BY 1""")
def _(t):
    p = F.col("o_orderpriority")
    s = F.when(p == "1-URGENT", "Full-time").when(p == "2-HIGH", "FULL_TIME").when(
        p == "3-MEDIUM", "Contractor").otherwise(p)
    return t.orders.groupBy(text.employment_bucket(s).alias("bucket")).agg(F.count("*").alias("n"))


# --- lists ----------------------------------------------------------------------

@query("fun_1_list_literals", P_SQL + """SELECT job_id, CASE WHEN job_id % 50 = 0 THEN 0 ELSE len(skills) END AS n,
  CASE WHEN job_id % 50 = 0 THEN '' ELSE array_to_string(skills, '; ') END AS skills FROM pl""")
def _(t):
    single = F.concat(F.lit("['"), F.array_join("skills", "', '"), F.lit("']"))
    double = F.concat(F.lit('["'), F.array_join("skills", '", "'), F.lit('"]'))
    literal = (F.when(F.col("job_id") % 50 == 0, "[broken 'x")
               .when(F.size("skills") == 0, "[]").when(F.col("level") == "P", double).otherwise(single))
    parsed = lists.parse_list_literal(literal)
    return t.posting_lists.select("job_id", F.size(parsed).cast("long").alias("n"),
                                  F.array_join(parsed, "; ").alias("skills"))


@query("fun_2_delimited_lists", """SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) || '|' || lower(split_part(p_name, ' ', 2)) || '|' || lower(p_brand) AS parts FROM part""")
def _(t):
    joined = F.concat(F.translate("p_name", " ", ";"), F.lit(";; "), F.col("p_brand"), F.lit(" ;"))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(
        lists.parse_delimited(joined, ";", lower=True), "|").alias("parts"))


def part_list(t):
    """A noisy skill list per part, built from the row's own words."""
    w = F.split("p_name", " ")
    return F.array(F.get(w, F.lit(0)), F.upper(F.get(w, F.lit(0))), F.lit("Design"), F.lit(" C "),
                   F.lit("J"), F.lit("Go"), F.lit("xv"), F.lit("ab"), F.lit(" "), F.lit("Z"),
                   F.lit("c#"), F.substring("p_brand", 6, 2), F.get(w, F.lit(1)), F.col("p_type"))


_PART_LIST = """[split_part(p_name, ' ', 1), upper(split_part(p_name, ' ', 1)), 'Design', ' C ', 'J', 'Go', 'xv', 'ab', ' ', 'Z', 'c#',
   substr(p_brand, 6, 2), split_part(p_name, ' ', 2), p_type]"""
_DEDUP = "list_filter(l, lambda s, i: list_position(list_transform(l, lambda q: lower(q)), lower(s)) = i)"


def _clean_sql(two):
    rule = f"AND (length(s) <> 2 OR upper(s) IN ({sql_list([v.upper() for v in V.VALID_SHORT_SKILLS])}))" if two else ""
    return f"""SELECT p_partkey AS id, array_to_string({_DEDUP}, '|') AS skills FROM (SELECT p_partkey,
     list_filter(list_transform({_PART_LIST}, lambda s: trim(s)), lambda s: s <> '' AND s NOT IN ({sql_list(V.NOISY_SKILLS)})
     AND (length(s) <> 1 OR s IN ({sql_list(V.VALID_SHORT_SKILLS)})) {rule}) AS l FROM part)"""


@query("fun_3_clean_skill_list", _clean_sql(True))
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(
        lists.clean_skill_list(part_list(t)), "|").alias("skills"))


@query("fun_3_clean_skill_list_variant", _clean_sql(False))
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(
        lists.clean_skill_list(part_list(t), two_char_rule=False), "|").alias("skills"))


@query("rnk_5_dedup_keep_first", f"""SELECT p_partkey AS id, array_to_string({_DEDUP}, '|') AS kept,
   array_to_string(list_filter(f, lambda s, i: list_position(f, s) = i), '|') AS flat
  FROM (SELECT p_partkey, l, list_filter(list_transform(l, lambda s: trim(lower(s))), lambda s: s <> '') AS f FROM (SELECT p_partkey, {_PART_LIST} AS l FROM part))""")
def _(t):
    a = part_list(t)
    return t.part.select(F.col("p_partkey").alias("id"),
                         F.array_join(lists.dedup_ignoring_case(a), "|").alias("kept"),
                         F.array_join(lists.flatten_lower(a), "|").alias("flat"))


_STOPS, _SYN = ["red", "bolt", "design"], {"small": "tiny", "ring": "loop", "large": "big", "blue": "red"}
_SYN_CASE = "CASE s WHEN 'small' THEN 'tiny' WHEN 'ring' THEN 'loop' WHEN 'large' THEN 'big' WHEN 'blue' THEN 'red' ELSE s END"


@query("jon_3_stop_list", f"""SELECT p_partkey AS id,
   array_to_string(list_filter(list_transform(list_transform({_PART_LIST}, lambda s: trim(lower(s))), lambda s: {_SYN_CASE}), lambda s: s NOT IN ({sql_list(_STOPS)})), '|') AS map_then_stop,
   array_to_string(list_transform(list_filter(list_transform({_PART_LIST}, lambda s: regexp_replace(lower(trim(s)), '\\s+', ' ', 'g')), lambda s: s NOT IN ({sql_list(_STOPS)}) AND length(s) >= 2), lambda s: {_SYN_CASE}), '|') AS stop_then_map
  FROM part""")
def _(t):
    a = part_list(t)
    return t.part.select(F.col("p_partkey").alias("id"),
                         F.array_join(lists.map_then_stop(a, _SYN, _STOPS), "|").alias("map_then_stop"),
                         F.array_join(lists.stop_then_map(a, _SYN, _STOPS), "|").alias("stop_then_map"))


@query("src_3_wide_skill_columns", """SELECT p_partkey AS id, lower(p_brand) || '|' || lower(p_name) || '|' || lower(p_type) AS skills FROM part""")
def _(t):
    wide = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("Skills 1"),
                         F.concat(F.lit(" "), F.col("p_name")).alias("Skills 2"), F.lit(" ").alias("Skills 3"),
                         F.lit(None).cast("string").alias("Skills 4"), F.col("p_type").alias("Skills 5"))
    cols = [F.col(f"`{c}`") for c in wide.columns if "skill" in c.lower()]
    return wide.select("id", F.array_join(lists.wide_columns_to_list(cols), "|").alias("skills"))


@query("set_5_overlap_measures", P_SQL + """, d AS (SELECT job_id, list_distinct(list_transform(skills, lambda s: split_part(s, ' ', 1))) AS x, list_distinct(list_transform(skills, lambda s: split_part(s, ' ', 2))) AS y0 FROM pl),
  e AS (SELECT job_id, x, list_distinct(list_concat(list_sort(x)[1:2], y0)) AS y FROM d)
  SELECT job_id, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) ELSE 0.0 END AS jaccard,
   CASE WHEN len(y) > 0 THEN round(len(list_intersect(x, y)) / len(y), 6) ELSE 0.0 END AS "precision",
   CASE WHEN len(x) > 0 THEN round(list_sum(list_transform(list_intersect(x, y), lambda s: length(s))) / list_sum(list_transform(x, lambda s: length(s))), 6) ELSE 0.0 END AS coverage FROM e""")
def _(t):
    x = F.array_distinct(F.transform("skills", lambda s: F.substring_index(s, " ", 1)))
    y0 = F.array_distinct(F.transform("skills", lambda s: F.get(F.split(s, " "), F.lit(1))))
    rows = t.posting_lists.select("job_id", x.alias("x"), y0.alias("y0")).withColumn(
        "y", F.array_distinct(F.concat(F.slice(F.array_sort("x"), 1, 2), "y0")))
    cov = lists.weighted_coverage(F.col("x"), F.col("y"), lambda s: F.length(s).cast("double"))
    return rows.select("job_id", R(lists.jaccard(F.col("x"), F.col("y"))).alias("jaccard"),
                       R(lists.precision(F.col("x"), F.col("y"))).alias("precision"), R(cov).alias("coverage"))


@query("rnk_12_pair_by_position", P_SQL + """SELECT job_id, i, coalesce(a[i], '') AS degree, coalesce(b[i], '') AS institution FROM
  (SELECT job_id, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM (SELECT job_id, skills[1:(job_id % 4)::BIGINT] AS a, list_reverse(skills) AS b FROM pl))""")
def _(t):
    a, b = F.slice("skills", F.lit(1), (F.col("job_id") % 4).cast("int")), F.reverse("skills")
    pairs = lists.pair_by_position(a, b, "degree", "institution")
    return t.posting_lists.select("job_id", F.posexplode(pairs).alias("i", "p")).select(
        "job_id", (F.col("i") + 1).cast("long").alias("i"), "p.degree", "p.institution")


@query("rnk_13_recent_trajectory", P_SQL + """SELECT job_id, CASE WHEN len(skills) = 0 THEN 'unknown' ELSE array_to_string(skills[greatest(len(skills) - 2, 1):], ' → ') END AS trajectory FROM pl""")
def _(t):
    return t.posting_lists.select("job_id", lists.last_joined(F.col("skills")).alias("trajectory"))


@query("top_6_course_listing", P_SQL + """, l AS (SELECT course_id, name, list_sort(list(skill)) AS sk FROM c GROUP BY 1, 2)
  SELECT course_id, name, array_to_string(sk[1:6], ', ') || CASE WHEN len(sk) > 6 THEN ' +' || (len(sk) - 6) || ' more' ELSE '' END AS skills
  FROM l ORDER BY name LIMIT 15""")
def _(t):
    top = t.courses.orderBy("name").limit(15)
    kept = t.course_skills.join(top.select("course_id"), "course_id", "left_semi")
    agg = kept.groupBy("course_id", "name").agg(F.array_sort(F.collect_set("skill")).alias("sk"))
    return agg.select("course_id", "name", lists.first_with_more(F.col("sk")).alias("skills"))


@query("top_7_role_search", "SELECT n_name AS role FROM nation WHERE contains(lower(n_name), 'n_1')")
def _(t):
    return t.nation.select(F.col("n_name").alias("role")).where(
        F.contains(F.lower("role"), F.lower(F.lit("N_1"))))


# --- text -------------------------------------------------------------------------

@query("fun_4_clean_tokens", r"SELECT p_partkey AS id, regexp_replace(lower(trim('  ' || upper(p_brand) || '   ' || p_name || ' ')), '\s+', ' ', 'g') AS token FROM part")
def _(t):
    raw = F.concat(F.lit("  "), F.upper("p_brand"), F.lit("   "), F.col("p_name"), F.lit(" "))
    return t.part.select(F.col("p_partkey").alias("id"), text.clean_token(raw).alias("token"))


_RULES = {"the": "definite", "and": "conjunction"}


def _surface_sql(c):
    s1 = rf"trim(regexp_replace(lower(regexp_replace(regexp_replace(trim({c}), '^[^a-zA-Z0-9#+.\-]+', ''), '[^a-zA-Z0-9#+.\-/]+$', '')), '\s+', ' ', 'g'))"
    return s1


_SURF_DROP = rf"""(length(s) < 2 OR regexp_matches(s, '^\d+$') OR s IN ({sql_list(V.SURFACE_BLOCKLIST)})
   OR regexp_matches(s, '(?i)^[bmd][a-z.]?\.(sc|s|eng|tech|a|com|ed|arch|pharm)\.?$'))"""


@query("fun_5_normalize_surface", TOK_SQL + f"""SELECT token, CASE WHEN {_SURF_DROP} THEN '' WHEN s = 'the' THEN 'definite' WHEN s = 'and' THEN 'conjunction' ELSE s END AS normalized
  FROM (SELECT token, {_surface_sql('token')} AS s FROM tk)""")
def _(t):
    return document_tokens(t).select(
        "token", text.normalize_surface(F.col("token"), _RULES).alias("normalized"))


@query("fun_6_split_spans", rf"""WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
  pt AS (SELECT doc_id, trim(unnest(string_split_regex(line, '(?i)[,;|•·\n\r\t]+|\s+and\s+|\s+or\s+'))) AS surface FROM ln),
  nm AS (SELECT doc_id, surface, {_surface_sql('surface')} AS s FROM pt WHERE surface <> ''),
  z AS (SELECT doc_id, surface, CASE WHEN {_SURF_DROP} THEN '' ELSE s END AS normalized FROM nm)
  SELECT doc_id, surface, normalized, count(*) AS n FROM z WHERE length(normalized) >= 2 GROUP BY 1, 2, 3""")
def _(t):
    line = t.documents.select("doc_id", F.explode(text.lines(F.col("text"))).alias("line"))
    return line.select("doc_id", F.inline(text.split_surface(F.col("line")))).groupBy(
        "doc_id", "surface", "normalized").agg(F.count("*").alias("n"))


@query("fun_10_label_remap", """WITH x AS (SELECT e.event_id AS id, (CASE event_id % 3 WHEN 0 THEN 'B-' WHEN 1 THEN 'I-' ELSE '' END) || (CASE event_type WHEN 'click' THEN 'Skills' WHEN 'view' THEN 'Skill_DevOps'
     WHEN 'error' THEN 'Email Address' WHEN 'purchase' THEN 'College Name' ELSE event_type END) AS tag FROM events e)
  SELECT id, CASE WHEN NOT regexp_matches(tag, '^[BI]-') THEN 'O' WHEN tag LIKE '_-Skill%' THEN tag[1:2] || 'Skill' WHEN tag LIKE '_-Email Address' THEN tag[1:2] || 'Email'
    WHEN tag LIKE '_-College Name' THEN tag[1:2] || 'Institution' ELSE 'O' END AS new_tag,
   CASE WHEN tag IN ('Skills', 'Email Address', 'College Name') THEN tag ELSE 'UNKNOWN' END AS label FROM x""")
def _(t):
    ev, e = t.events, F.col("event_type")
    prefix = F.when(F.col("event_id") % 3 == 0, "B-").when(F.col("event_id") % 3 == 1, "I-").otherwise("")
    tag = F.concat(prefix, F.when(e == "click", "Skills").when(e == "view", "Skill_DevOps")
                   .when(e == "error", "Email Address").when(e == "purchase", "College Name").otherwise(e))
    labels = ["Skill", *V.TAG_LABELS.values()]
    return ev.select(F.col("event_id").alias("id"), spans.remap_tag(tag, labels).alias("new_tag"),
                     spans.map_annotation_label(tag).alias("label"))


_EMAIL_RE = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
_PHONE_RE = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{4,6}"


@query("fun_11_contacts", rf"""SELECT doc_id, regexp_extract(text, '{_EMAIL_RE}') AS email,
   CASE WHEN length(regexp_replace(ph, '\D', '', 'g')) >= 7 THEN ph ELSE '' END AS phone
  FROM (SELECT doc_id, text, trim(regexp_extract(text, '{_PHONE_RE}')) AS ph FROM documents)""")
def _(t):
    c = F.col("text")
    return t.documents.select("doc_id", text.email(c).alias("email"), text.phone(c).alias("phone"))


_NAME_RE = r"^[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){1,3}$"
_CITY_RE = r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,2})\s*,\s*([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,2})\b"
NAME_SQL = f"coalesce(list_filter(string_split(text, chr(10))[1:10], lambda s: regexp_matches(s, '{_NAME_RE}') AND lower(s) NOT IN ({sql_list(V.NAME_BLOCKLIST)}))[1], '')"
CITY_SQL = f"coalesce(list_filter(string_split(text, chr(10))[1:5], lambda s: regexp_matches(s, '{_CITY_RE}') AND lower(regexp_extract(s, '{_CITY_RE}', 1)) NOT IN ({sql_list(V.NAME_BLOCKLIST)}))[1], '')"


@query("fun_12_header_fields", CV_SQL + f"SELECT doc_id, {NAME_SQL} AS name, {CITY_SQL} AS location FROM cv")
def _(t):
    c = F.col("text")
    return cv_texts(t).select("doc_id", text.header_name(c).alias("name"),
                              text.header_location(c).alias("location"))


@query("fun_13_name_from_file", r"""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE
   upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || 'Nation' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    # "CV_Household-nation_3_2024 (final).pdf"; every third file lacks the second word
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    second = F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.lower("n_name"))
    file = F.concat(F.lit("/in/CV_"), F.col("c_mktsegment"), F.lit("-"), second, F.lit("_2024 (final).pdf"))
    return rows.select(F.col("c_custkey").alias("id"), text.name_from_file(file).alias("name"))


_KNOWN_ORDERED = sorted(V.BLOCK_KNOWN_SKILLS, key=lambda s: (-len(s), s))
_STRIP = r"regexp_replace({0}, '^[ .,:;()\[\]{{}}]+|[ .,:;()\[\]{{}}]+$', '', 'g')"
_SQUEEZE = r"trim(regexp_replace({0}, '[\s\x{{a0}}]+', ' ', 'g'))"


@query("fun_14_skill_candidates", CV_SQL + rf""", tk AS (SELECT doc_id, lower(text) AS low, list_transform(string_split_regex(text, '[\n,;|/•*\-]+'),
    lambda s: {_STRIP.format(_SQUEEZE.format('s'))}) AS toks FROM cv),
  cd AS (SELECT doc_id, list_concat(list_filter([{sql_list(_KNOWN_ORDERED)}], lambda k: contains(low, k)),
    list_transform(list_filter(toks, lambda s: s <> '' AND (lower(s) IN ({sql_list(V.BLOCK_KNOWN_SKILLS)}) OR
      (regexp_matches(s, '^[A-Z0-9+#.-]{{2,12}}$') AND lower(s) NOT IN ({sql_list(V.FILE_PREFIXES)})))), lambda s: lower(s))) AS c FROM tk),
  l AS (SELECT doc_id, c, list_filter(list_transform(c, lambda s: {_STRIP.format(_SQUEEZE.format('s'))}), lambda s: s <> '' AND s NOT IN ({sql_list(V.STOP_SKILL_TOKENS)})
     AND NOT regexp_matches(s, '{V.NUMERIC_ONLY}') AND NOT regexp_matches(s, '{V.DATE_TOKEN}') AND NOT regexp_matches(s, '{V.GRADE_WORD}') AND NOT regexp_matches(s, '{V.DATE_WORD}')) AS l FROM cd)
  SELECT doc_id, array_to_string(c, '|') AS candidates, array_to_string({_DEDUP}, '|') AS skills FROM l""")
def _(t):
    c = text.skill_candidates(F.col("text"))
    return cv_texts(t).select("doc_id", c.alias("c")).select(
        "doc_id", F.array_join("c", "|").alias("candidates"),
        F.array_join(text.sanitize_skills(F.col("c")), "|").alias("skills"))


@query("fun_15_expand_fragment", r"""WITH f AS (SELECT doc_id, text, regexp_replace(substr(text, 4, 6), '^\s+|\s+$', '', 'g') AS frag FROM documents),
  p AS (SELECT *, CASE WHEN strpos(text, frag) > 0 THEN strpos(text, frag) ELSE strpos(lower(text), lower(frag)) END AS pos FROM f),
  g AS (SELECT *, trim(regexp_extract(substr(text, 1, pos - 1), '([\p{L}\p{N}]*)$', 1) || substr(text, pos, length(frag)) || regexp_extract(substr(text, pos + length(frag)), '^([\p{L}\p{N}]*)', 1)) AS grown FROM p)
  SELECT doc_id, CASE WHEN frag = '' OR pos = 0 OR length(grown) > length(frag) + 15 THEN frag ELSE grown END AS expanded FROM g""")
def _(t):
    c = F.col("text")
    return t.documents.select("doc_id", text.expand_fragment(F.substring(c, 4, 6), c).alias("expanded"))


@query("fun_17_labels", r"""SELECT p_partkey AS id, p_type || '_' || replace(p_name, ' ', '_') AS file_key,
   upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS label FROM part""")
def _(t):
    key = F.concat("p_type", F.lit("/"), F.translate("p_name", " ", "\\"))
    return t.part.select(F.col("p_partkey").alias("id"), text.role_file_key(key).alias("file_key"),
                         text.label_title(F.upper(F.translate("p_name", " ", "_"))).alias("label"))


@query("fun_18_mixed_skill_lists", """SELECT p_partkey AS id, split_part(p_name, ' ', 1) || '|' || p_brand || '|' || p_type AS skills FROM part""")
def _(t):
    w = F.split("p_name", " ")
    raw = F.concat(F.lit('["'), F.get(w, F.lit(0)), F.lit('", {"surface": "'), F.col("p_brand"),
                   F.lit('", "x": 1}, {"surface": "", "normalized_guess": "'), F.col("p_type"), F.lit('"}, {"y": 2}, ""]'))
    return t.part.select(F.col("p_partkey").alias("id"),
                         F.array_join(lists.flat_skill_names(raw), "|").alias("skills"))


@query("prf_2_clean_documents", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '[ \t]+', ' ', 'g'),
   '\n{3,}', chr(10) || chr(10), 'g'), '[^\S\n]+\n', chr(10), 'g'), '^[\s]+|[\s]+$', '', 'g') AS text FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.clean_document(F.col("text")).alias("text"))


# --- answers --------------------------------------------------------------------------

def answer_text(t):
    """Answer-like JSON per order with the usual defects, from the row's own values."""
    k, pri = F.col("o_orderkey"), F.lower(F.substring("o_orderpriority", 3, 100))
    body = F.concat(
        F.lit('{"thinking_process": "'), F.col("c_mktsegment"),
        F.lit('", "current_role_assessment": {"target_role": "'), F.col("n_name"),
        F.lit('", "readiness_score": '),
        F.when(k % 3 == 0, F.concat(F.lit('"'), (k % 150).cast("string"), F.lit('%"')))
        .otherwise(((k % 130) / 100).cast("string")),
        F.lit(', "readiness_level": "'), F.when(k % 2 == 0, "High (low|moderate|high)").otherwise("__FILL__"),
        F.lit('", "verdict": "ok"}, "ai_discovered_roles": [{"role_name": "'), F.col("n_name"), F.lit(' Lead (e.g. x)", "market_demand": "'), pri,
        F.lit('", "transition_difficulty": "'), F.when(k % 4 == 0, "Very hard").otherwise("Easy"),
        F.lit('", "estimated_transition_time": "about '), (k % 60).cast("string"), F.lit(' months", "transferable_skills": ["sql", {"skill": "'), F.col("c_mktsegment"),
        F.lit('"}, "__FILL__"], "skills_to_develop": ["python (new)"]}]'), F.when(k % 7 == 0, "").otherwise("}"))
    raw = F.when(k % 5 == 0, F.concat(F.lit("Sure! "), body, F.lit(" Done."))).otherwise(body)
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("id"), raw.alias("raw"))


_ANS = """WITH a AS (SELECT o_orderkey AS k, lower(substr(o_orderpriority, 3)) AS pri, c_mktsegment AS seg, n_name FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


@query("fun_19_tolerant_parse", _ANS + """SELECT k AS id, CASE WHEN k % 7 = 0 THEN 'failed' WHEN k % 5 = 0 THEN 'block' ELSE 'strict' END AS layer,
   CASE WHEN k % 7 <> 0 THEN seg END AS thinking, CASE WHEN k % 7 <> 0 THEN n_name END AS target_role FROM a""")
def _(t):
    rows = answer_text(t)
    a = answers.parse_tolerant(F.col("raw"), answers.ANSWER_SCHEMA)
    return rows.select("id", answers.parse_layer(F.col("raw")).alias("layer"), a.alias("a")).select(
        "id", "layer", F.col("a.thinking_process").alias("thinking"),
        F.col("a.current_role_assessment.target_role").alias("target_role"))


@query("fun_20_normalized_answers", _ANS + """SELECT k AS id, round(least(1.0, CASE WHEN k % 3 = 0 AND k % 150 > 1 THEN (k % 150) / 100 WHEN k % 3 = 0 THEN k % 150 ELSE (k % 130) / 100 END), 6) AS score,
   CASE WHEN k % 2 = 0 THEN 'high' ELSE 'moderate' END AS level, n_name || ' Lead' AS role_name,
   CASE WHEN pri = 'high' THEN 'high' WHEN pri = 'low' THEN 'low' ELSE 'medium' END AS demand,
   CASE WHEN k % 4 = 0 THEN 'challenging' ELSE 'easy' END AS difficulty, CAST(greatest(1, least(48, k % 60)) AS INTEGER) AS months,
   'sql|' || seg AS transferable, 'python' AS develop, 66.7::DOUBLE AS readiness_pct FROM a WHERE k % 7 <> 0""")
def _(t):
    readable = answer_text(t).where(answers.parse_layer(F.col("raw")) != "failed")
    n = answers.normalize_answers(readable, "raw", "a").select(
        "id", "a.current_role_assessment", F.explode("a.ai_discovered_roles").alias("role"))
    role = F.col("role")
    return n.select(
        "id", R(F.col("current_role_assessment.readiness_score")).alias("score"),
        F.col("current_role_assessment.readiness_level").alias("level"), role["role_name"].alias("role_name"),
        role["market_demand"].alias("demand"), role["transition_difficulty"].alias("difficulty"),
        role["estimated_transition_months"].alias("months"),
        F.array_join(role["transferable_skills"], "|").alias("transferable"),
        F.array_join(role["skills_to_develop"], "|").alias("develop"),
        role["skill_readiness_pct"].alias("readiness_pct"))


@query("fun_21_transferable_pct", """SELECT l_orderkey AS id, l_linenumber, round_even(l_quantity / (l_quantity + l_linenumber) * 100, 1) AS pct FROM lineitem""")
def _(t):
    return t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber",
                             numeric.transferable_pct(F.col("l_quantity"), F.col("l_linenumber")).alias("pct"))


@query("fun_22_pivot_metrics", """WITH a AS (SELECT o_orderkey AS id, least(100.0, o_totalprice / 4000) AS m,
    CASE o_orderpriority WHEN '2-HIGH' THEN 100.0 WHEN '3-MEDIUM' THEN 65.0 WHEN '5-LOW' THEN 30.0 ELSE 50.0 END AS d,
    CASE o_orderstatus WHEN 'F' THEN 100.0 WHEN 'O' THEN 25.0 ELSE 50.0 END AS e,
    floor(greatest(10.0, (1 - ((o_orderkey % 40) - 1) / 24) * 100) + 0.5) AS s FROM orders)
  SELECT id, round(m, 6) AS skill_match, d::DOUBLE AS demand, e::DOUBLE AS ease, s::DOUBLE AS speed, floor((m + d + e + s) / 4 + 0.5)::DOUBLE AS overall FROM a""")
def _(t):
    diff = F.when(F.col("o_orderstatus") == "F", "Easy").when(F.col("o_orderstatus") == "O", "challenging")
    m = numeric.pivot_metrics(F.col("o_totalprice") / 4000, F.substring("o_orderpriority", 3, 50), diff,
                              F.col("o_orderkey") % 40)
    return t.orders.select(F.col("o_orderkey").alias("id"), m.alias("m")).select(
        "id", R("m.skill_match").alias("skill_match"), "m.demand", "m.ease", "m.speed", "m.overall")


# --- dates and numbers --------------------------------------------------------------------

@query("mth_1_day_first_dates", """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS posted FROM orders""")
def _(t):
    d, p = F.col("o_orderdate"), F.col("o_orderpriority")
    raw = (F.when(p == "1-URGENT", F.date_format(d, "dd/MM/yyyy")).when(p == "2-HIGH", F.date_format(d, "d-M-yyyy"))
           .when(p == "3-MEDIUM", F.date_format(d, "yyyy-MM-dd")).when(p == "4-NOT SPECIFIED", F.date_format(d, "d MMM yyyy"))
           .otherwise("31/02/1999"))
    return t.orders.select(F.col("o_orderkey").alias("id"), dates.parse_day_first(raw).alias("posted"))


@query("mth_7_score_blend", "SELECT l_orderkey AS id, l_linenumber, round(0.6 * l_tax + 0.4 * greatest(0.0, least(1.0, l_quantity / 25 - 0.5)), 6) AS score FROM lineitem")
def _(t):
    s = numeric.blend(F.col("l_tax"), F.col("l_quantity") / 25 - 0.5)
    return t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", R(s).alias("score"))


@query("mth_8_safe_double", """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice WHEN '2-HIGH' THEN -1.5 ELSE 0.0 END AS value FROM orders""")
def _(t):
    p = F.col("o_orderpriority")
    raw = (F.when(p == "1-URGENT", F.col("o_totalprice").cast("string")).when(p == "2-HIGH", "-1.5")
           .when(p == "3-MEDIUM", "NaN").when(p == "4-NOT SPECIFIED", "Infinity").otherwise("abc"))
    return t.orders.select(F.col("o_orderkey").alias("id"), numeric.safe_double(raw).alias("value"))


YEARS_SQL = r"""CASE WHEN len(ex) > 0 THEN list_max(ex) WHEN len(ys) >= 2 AND 2026 - list_min(ys) BETWEEN 1 AND 40 THEN round_even((2026 - list_min(ys)) * 0.8, 1) ELSE 0.0 END"""
YEARS_LISTS = r"""list_filter(list_transform(regexp_extract_all(text, '(?i)(\d+\.?\d*)\s*\+?\s*(?:years?|tahun)', 1), lambda v: v::DOUBLE), lambda v: v < 50) AS ex,
   list_transform(regexp_extract_all(text, '\b(20[0-3]\d)\b', 1), lambda v: v::INTEGER) AS ys"""


@query("mth_9_experience_years", CV_SQL + f", y AS (SELECT doc_id, {YEARS_LISTS} FROM cv) SELECT doc_id, {YEARS_SQL} AS years FROM y")
def _(t):
    return cv_texts(t).select("doc_id", text.experience_years(F.col("text"), 2026).alias("years"))


@query("mth_9_experience_years_documents", f"WITH y AS (SELECT doc_id, {YEARS_LISTS} FROM documents) SELECT doc_id, {YEARS_SQL} AS years FROM y")
def _(t):
    return t.documents.select("doc_id", text.experience_years(F.col("text"), 2026).alias("years"))


def _pad(text_col, n):
    return F.concat(F.repeat(text_col, n), F.lit(" tail"))


@query("fun_16_capped_profile", """SELECT c_custkey AS id, trim(substr(repeat(c_name, 20) || ' tail', 1, 255)) AS name, trim(substr(repeat(c_name, 3) || ' tail', 1, 50)) AS phone,
   trim(substr(repeat(c_mktsegment, 20) || ' tail', 1, 255)) AS company, trim(substr(repeat(c_mktsegment, 20) || ' tail', 1, 100)) AS duration, trim(substr(repeat(c_mktsegment, 20) || ' tail', 1, 100)) AS skill FROM customer""")
def _(t):
    from talentgrid.operators.profile import capped_profile

    seg = _pad(F.col("c_mktsegment"), 20)
    job = F.struct(seg.alias("company"), F.lit(None).cast("string").alias("designation"), seg.alias("duration"))
    edu = F.struct(seg.alias("degree"), seg.alias("institution"), seg.alias("year"))
    prof = F.struct(_pad(F.col("c_name"), 20).alias("name"), F.lit("a@b.co").alias("email"),
                    _pad(F.col("c_name"), 3).alias("phone"), seg.alias("location"),
                    F.lit(1.0).alias("total_experience_years"), F.array(seg).alias("skills"),
                    F.array(job).alias("work_experience"), F.array(edu).alias("education"))
    p = t.customer.select(F.col("c_custkey").alias("id"), capped_profile(prof).alias("p"))
    return p.select("id", "p.name", "p.phone", F.col("p.work_experience")[0]["company"].alias("company"),
                    F.col("p.work_experience")[0]["duration"].alias("duration"), F.col("p.skills")[0].alias("skill"))


@query("fun_23_prompt_records", """WITH g AS (SELECT conv_id, turn, role, text FROM conversations)
  SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'not available' ELSE upper(role) || ' @ ' || trim(text) END AS work,
   to_json({role_name: role, overlap_pct: 12.5, gap_skills: [upper(role), role]}) AS role_json FROM g""")
def _(t):
    from talentgrid.operators.profile import prompt_role_json, work_line

    jobs = F.array(F.struct(F.col("text").alias("company"), F.upper("role").alias("designation")))
    js = prompt_role_json(F.col("role"), F.lit(12.5), F.array(F.upper("role"), F.col("role"), F.lit("a"), F.lit("b")), 2)
    return t.conversations.select("conv_id", "turn", work_line(jobs).alias("work"), js.alias("role_json"))
