"""Edge cases and brute-force comparisons on small hand-made rows."""

import difflib
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentgrid.functions import answers, lists, numeric, spans, text, tokens
from talentgrid.operators import evaluate, lookups, profile, splits
from talentgrid.operators import skills as S
from talentgrid.operators import spans as SP
from talentgrid.operators.quantiles import exact_quantiles
from talentgrid.operators.roles import classify_roles, rules_table
from talentgrid.operators.tables import dense_index, hash_ranked
from talentgrid.sources import files, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.gauss(0, 1), 0.0, 7.5])) for g in "aab" for _ in range(700)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.p): r.quantile for r in exact_quantiles(df, F.col("v"), [0.1, 0.5, 0.95], ["g"], accuracy=50).collect()}
    for g in "abc":
        vals = [v for k, v in rows if k == g]
        for p in (0.1, 0.5, 0.95):
            assert abs(got[g, p] - np.quantile(vals, p)) < 1e-9


def test_hash_rank_and_dense_index(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("x"))
    ranks = hash_ranked(df, "id", 1, ["g"]).groupBy("g").agg(
        F.count_distinct("rank").alias("d"), F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.d == r.m == r.n for r in ranks)
    words = [f"w{i:04d}" for i in range(500)]
    idx = dense_index(spark.createDataFrame([(w,) for w in words], "w string").repartition(7), "w").collect()
    assert [r.w for r in sorted(idx, key=lambda r: r.idx)] == words
    assert [r.idx for r in sorted(idx, key=lambda r: r.idx)] == list(range(500))


def test_fuzzy_ratio_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = sorted({"".join(rng.choice("abcde +") for _ in range(rng.randint(1, 9))).strip() for _ in range(60)} - {""})
    words = sorted({"".join(rng.choice("abcde+") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    for cutoff in (0.6, 0.75):
        got = {r.word: r.key for r in lookups.nearest_key(
            spark.createDataFrame([(w,) for w in words], "word string"),
            spark.createDataFrame([(v,) for v in vocab], "key string"), cutoff).collect()}
        want = {w: m[0] for w in words if (m := difflib.get_close_matches(w, vocab, n=1, cutoff=cutoff))}
        assert got == want


def test_role_ties_fallback_and_order(spark):
    rules = rules_table(spark, {"B": ["rag", "x"], "A": ["dev"], "C": ["zz"]})
    df = spark.createDataFrame([
        (1, "dev rag", None, None, None, None), (2, None, None, None, None, "fragment"),
        (3, None, "nothing", None, None, None), (4, None, "zz", "dev", None, "zz")],
        "id int, standardizedTitle string, title string, jobFunction string, industries string, descriptionText string")
    got = {r.id: tuple(r)[1:] for r in classify_roles(df, "id", rules).collect()}
    assert got[1] == ("B", 5, "standardizedTitle", "rag")
    assert got[2] == ("B", 1, "descriptionText", "rag")
    assert got[3] == ("General IT Specialist", 0, "fallback", "fallback_no_match")
    assert got[4] == ("C", 5, "title", "zz")


def test_dictionary_symbols_and_longest_match(spark):
    docs = spark.createDataFrame([
        (1, "C++ and c, c# node js; NodeJS. Data Science team"), (2, "none"), (3, "use .NET"), (4, "x.net xc++")],
        "doc_id int, text string")
    d = S.build_dictionary(spark.createDataFrame([("Data",), ("Data Science",), ("C",), (".NET",)], "surface string"))
    got = {r.doc_id: r.skills for r in S.extract_skills(docs, "doc_id", "text", d).collect()}
    assert got[1] == ["C", "C#", "C++", "Data Science", "Node.js"]
    assert got[2] == [] and got[3] == [".NET"] and got[4] == []


def test_tokens_and_occurrences(spark):
    body = " a  bb\tccc\n" * 400
    toks = one(spark, tokens.whitespace_tokens(F.lit(body)))
    assert len(toks) == 1200
    assert all(body[t["start"]:t["end"]] == t["token"] for t in toks)
    assert one(spark, tokens.occurrences(F.lit("aB"), F.lit("xabABaab"))) == [1, 3, 6]
    assert one(spark, tokens.occurrences(F.lit("q"), F.lit("xab"))) == []


def test_windows_follow_the_loop(spark):
    for n in (1, 99, 100, 101, 200, 201, 300, 301, 555):
        starts = [w["start"] for w in one(spark, SP.windows(F.sequence(F.lit(1), F.lit(n))))]
        want = []
        for s in range(0, n, 100):
            want.append(s)
            if s + 200 >= n:
                break
        assert starts == want, n


def test_span_offsets(spark):
    t = "Skills: Java (Less than 1 year), Python; C and Node.js, 3 years"
    got = one(spark, spans.split_span_offsets(F.lit(t), F.lit(8), F.lit(len(t))))
    assert [t[o["start"]:o["end"]] for o in got] == ["Java", "Python", "Node.js"]


def test_decode_drops_orphans_and_respects_labels(spark):
    tags = ["I-A", "B-A", "I-A", "I-B", "B-B", "B-B", "O", "I-B"]
    df = spark.createDataFrame([(1, i, f"t{i}", g) for i, g in enumerate(tags)], "doc_id int, pos int, token string, tag string")
    got = sorted((r.label, r.start, r.stop) for r in SP.decode_spans(df).collect())
    assert got == [("A", 1, 3), ("B", 4, 5), ("B", 5, 6)]


def test_experience_and_education_records(spark):
    cv = "Acme - Oslo\nFeb 2026 - Present\nJunior Engineer\n\nBeta Ltd - Rome\nTutor\n2019 - 2020\n- did things\nOslo University - X\nBachelor of Arts, 3.9\n2015 - 2019"
    jobs = [tuple(j) for j in one(spark, profile.experience_records(F.lit(cv)))]
    assert jobs[0] == ("Acme", "Junior Engineer", "Feb 2026 - Present")
    assert jobs[1] == ("Beta Ltd", "Tutor", "2019 - 2020")
    schools = [tuple(s) for s in one(spark, profile.education_records(F.lit(cv)))]
    assert schools == [("Bachelor of Arts", "Oslo University", "2019")]


def test_merge_uses_each_tagged_job_once(spark):
    job = lambda c, d, y: F.struct(F.lit(c).alias("company"), F.lit(d).alias("designation"), F.lit(y).alias("duration"))
    rules = F.array(job("Acme", "", "2019 - 2020"), job("Acme", "Dev", "2021"))
    tagged = F.array(job("Acme Corporation", "Engineer", "none"), job("Zeta", "", "x"), job("Longer Name Ltd", "", "May 1999"))
    got = [tuple(j) for j in one(spark, profile.merge_experience(rules, tagged))]
    assert got == [("Acme Corporation", "Engineer", "2019 - 2020"), ("Acme", "Dev", "2021"), ("Longer Name Ltd", "", "May 1999")]


def test_line_sections_cross_over(spark):
    cv = "Jane Doe\nWork Experience\nAcme\nBachelor at Foo\nnotes\nEDUCATION\nFoo College\nSoftware engineer at Bar\nSkills\nPython, SQL"
    got = [(x["line"], x["section"]) for x in one(spark, profile.line_sections(F.lit(cv)))]
    assert got == [("Jane Doe", "misc"), ("Acme", "work"), ("Bachelor at Foo", "education"), ("notes", "education"),
                   ("Foo College", "education"), ("Software engineer at Bar", "work"), ("Python, SQL", "skills")]


def test_answer_normalising(spark):
    pick = lambda v: one(spark, answers.coerce_enum(F.lit(v).cast("string"), ["easy", "moderate", "challenging"], "moderate"))
    assert [pick(v) for v in ("Easy (a|b)", "very hard", "average", None, "?")] == ["easy", "challenging", "moderate", "moderate", "moderate"]
    raw = 'ok {"ai_discovered_roles": [{"role_name": "X (e.g. y)", "estimated_transition_months": 90, "transferable_skills": [{"name": "sql"}, "..."]}]} bye'
    df = answers.normalize_answers(spark.createDataFrame([(raw,), ("no json",)], "raw string"), "raw").collect()
    role = df[0].answer["ai_discovered_roles"][0]
    assert (role["role_name"], role["estimated_transition_months"], role["transferable_skills"]) == ("X", 48, ["sql"])
    assert role["skill_readiness_pct"] == 100.0 and df[1].answer is None


def test_small_scalars(spark):
    assert one(spark, lists.parse_list_literal(F.lit("['a', \"it's\"]"))) == ["a", "it's"]
    assert one(spark, lists.parse_list_literal(F.lit("[oops"))) == []
    assert one(spark, text.experience_years(F.lit("2019 and 2021"), 2026)) == 5.6
    assert one(spark, text.name_from_file(F.lit("CV_jane_van-doe_2024_final.pdf"))) == "Jane Van Doe"
    assert one(spark, numeric.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, text.is_valid_skill(F.lit("differential)"))) is False


def test_mcnemar_bootstrap_and_draws(spark):
    df = spark.createDataFrame([(i % 3 == 0, i % 2 == 0) for i in range(600)], "a boolean, b boolean")
    m = evaluate.mcnemar(df, F.col("a"), F.col("b")).first()
    assert (m.both, m.a_only, m.b_only, m.neither) == (100, 100, 200, 200)
    assert abs(m.statistic - 99 ** 2 / 300) < 1e-9 and 0 < m.p_value < 1e-6 and m.decision == "b better"
    b1, b2 = (evaluate.bootstrap_difference(df, F.col("a"), F.col("b"), 500).first() for _ in range(2))
    assert b1 == b2 and b1.ci_low < 100 / 6 < b1.ci_high
    pools = spark.createDataFrame([("r", [("x", 0.9), ("y", 0.05), ("z", 0.05)])], "role string, pool array<struct<skill:string,w:double>>")
    people = spark.range(2000).select(F.col("id").alias("profile_id"), F.lit("r").alias("role"))
    drawn = splits.weighted_sample(people, pools, F.lit(1))
    share = drawn.agg(F.avg(F.array_contains("owned", "x").cast("int"))).first()[0]
    assert abs(share - 0.9) < 0.03


@pytest.mark.parametrize("rows,skills", [(256, 1 << 15), (2, 3)])
def test_weighted_draws_in_pieces_are_the_smallest_keys(spark, monkeypatch, rows, skills):
    monkeypatch.setattr(splits, "DRAW_ROWS", rows)
    monkeypatch.setattr(splits, "DRAW_SKILLS", skills)
    pool = {"r": [(f"s{i:02}é", (i + 1) / 20) for i in range(20)], "q": [("only", 0.5)]}
    pools = spark.createDataFrame(list(pool.items()), "role string, pool array<struct<skill:string,w:double>>")
    people = [(i, "qr"[i % 3 > 0], i % 5) for i in range(23)] + [(7, "r", 4), (None, "r", 3), (30, "r", None), (31, "no", 2), (32, None, 2)]

    def draw(me, role, n):
        u = lambda s: (int(hashlib.md5("|".join([*([] if me is None else [str(me)]), s, "42"]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        keys = sorted((-math.log(u(s)) / (w if me is not None and me % 2 else 1.0), s) for s, w in pool[role])
        return None if n is None else sorted(s for _, s in keys[:n])

    want = [(*p, draw(*p)) for p in people if p[1] in pool]
    df = spark.createDataFrame(people, "profile_id long, role string, size int")
    got = splits.weighted_sample(df, pools, F.col("size"), weighted=F.col("profile_id") % 2 == 1)
    assert got.columns == ["role", "profile_id", "size", "owned"]
    assert sorted(((r.profile_id, r.role, r.size, r.owned) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_sources_skip_bad_rows(spark, tmp_path):
    p = tmp_path / "jobs.csv"
    p.write_text('applicantsCount,title\n3,"a ""q"" b\nc"\nnot-a-number,z\n4,ok\n')
    rows = files.postings_csv(spark, str(p), "applicantsCount double, title string").collect()
    assert [r.applicantsCount for r in rows] == [3.0, 4.0]
    j = tmp_path / "ann.json"
    j.write_text('{"content": "Python dev", "annotation": [{"label": ["Skills"], "points": [{"start": 0, "end": 5, "text": "Python"}]}]}\n{bad\n{"content": " "}\n')
    got = files.annotated_documents(spark, str(j)).collect()
    assert [(r.s, r.e, r.label) for r in got] == [(0, 6, "Skills")]
    out = str(tmp_path / "enriched")
    df = spark.range(10)
    assert sinks.resume_enrichment(df.where("id < 4"), "id", "v", F.col("id") * 2, out) == 4
    assert sinks.resume_enrichment(df, "id", "v", F.col("id") * 2, out) == 6
    assert spark.read.parquet(out).count() == 10


def test_plans_stay_in_the_jvm(spark, small):
    from talentgrid.plans.catalog import QUERIES

    for name in ("agg_16_tfidf", "cls_2_dictionary_skills", "cls_8_skill_gap", "prf_4_experience_records"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_long_phrases_and_common_first_words(spark):
    long = " ".join(f"word{i}" for i in range(30))
    words = [f"the thing {i}" for i in range(5000)] + [long]
    d = S.build_dictionary(spark.createDataFrame([(w,) for w in words], "surface string"), extra=[], aliases={})
    docs = spark.createDataFrame([(1, f"The thing 77, and {long}!"), (2, "the the the thing"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.skills for r in S.extract_skills(docs, "doc_id", "text", d).collect()}
    assert got == {1: ["the thing 77", long], 2: [], 3: []}


def test_list_literals_dates_and_white_space(spark):
    from talentgrid.functions import dates, lists, text

    df = spark.createDataFrame([
        (1, "['a', 'b']"), (2, "['a', None]"), (3, "['a',]"), (4, "('a', \"b\")"), (5, r"['a\x41', 'it\'s', \"x\\y\"]".replace('\\"', '"')),
        (6, "[]"), (7, None), (8, "nothing"), (9, "['a'"), (10, "['a, b', 'c]']"), (11, "[1, 'two']")], "id int, t string")
    got = {r.id: r.v for r in df.select("id", lists.parse_list_literal(F.col("t")).alias("v")).collect()}
    assert got == {1: ["a", "b"], 2: ["a", None], 3: ["a"], 4: ["a", "b"], 5: ["aA", "it's", "x\\y"], 6: [], 7: [], 8: [], 9: [],
                   10: ["a, b", "c]"], 11: ["1", "two"]}
    df = spark.createDataFrame([(x,) for x in (
        "2021-03-04T10:00:00Z", "2021-03-04 10:00:00", "2021/03/04", "March 4, 2021", "04-03-21", "4/3/2021", " 4 Mar 2021 ", "x", None)], "t string")
    got = [str(r.d) for r in df.select(dates.parse_day_first(F.col("t")).alias("d")).collect()]
    assert got == ["2021-03-04"] * 7 + ["None"] * 2
    row = spark.sql(r"SELECT '\tPython  3\n' AS a, 'nan\t' AS b, 'a\t; b \n;c\n' AS c").select(
        text.clean_token(F.col("a")), text.null_sentinels(F.col("b")), lists.parse_delimited(F.col("c"), ";")).first()
    assert tuple(row) == ("python 3", None, ["a", "b", "c"])


@pytest.mark.parametrize("keys", [1, 600])
def test_lookups_behave_alike_at_every_size(spark, keys):
    from talentgrid.operators.lookups import containment_category
    from talentgrid.operators.roles import keyword_hits

    taxonomy = spark.createDataFrame([("sql", 0, "Data")] + [(f"key{i}", i, "Other") for i in range(1, keys)], "key string, key_order int, category string")
    rows = spark.createDataFrame([(1, "my SQL"), (1, "my SQL"), (2, "none"), (3, None)], "id int, word string")
    got = sorted(tuple(r) for r in containment_category(rows, "word", taxonomy).select("id", "category").collect())
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[0] == got[1] == (1, "Data") and got[2][1] == got[3][1] != "Data"
    rules = rules_table(spark, {f"R{i}": [f"word{i}"] for i in range(keys)})
    docs = spark.createDataFrame([(1, "has word0"), (1, "has word0"), (2, None)], "id int, t string")
    assert [len(r.hits) for r in keyword_hits(docs, ["t"], rules).collect()] == [keys] * 3
    assert sorted(r.label_score for r in classify_roles(docs.withColumnRenamed("t", "title"), "id", rules).collect()) == [0, 4, 4]


def test_null_keys_and_long_labels_stay(spark):
    from talentgrid.operators.spans import decode_spans
    from talentgrid.operators.splits import stratified_split, three_way_split
    from talentgrid.operators.tables import with_totals

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (None, "a")], "id int, role string")
    assert stratified_split(rows, "id", "role").count() == 5 and three_way_split(rows, "id").count() == 5
    got = with_totals(rows, ["role"], F.count("*").alias("n"))
    assert sorted((r.n for r in got.collect())) == [2, 2, 3, 3, 3] and got.columns == ["id", "role", "n"]
    label = "L" * 1500
    tokens = spark.createDataFrame([(1, 0, "x", f"B-{label}"), (1, 1, "y", f"I-{label}")], "doc_id int, pos int, token string, tag string")
    assert [(r.label, r.text) for r in decode_spans(tokens).collect()] == [(label, "x y")]


def test_building_queries_starts_no_job(spark, small):
    from talentgrid.plans.catalog import QUERIES

    context = spark.sparkContext
    # the searches of cls_9, jon_5, jon_7 and jon_15 and agg_24 checkpoint shared results while they are built (README)
    for name in ("agg_16_tfidf", "cls_8_skill_gap", "cls_6_profile_predictor", "jon_16_containment_category",
                 "cls_1_role_labels", "smp_1_stratified_split", "jon_6_threshold_links"):
        name = next((q for q in QUERIES if q == name or q.startswith("_".join(name.split("_")[:2]) + "_")), None)
        spark.sparkContext.setJobGroup("build", name)
        before = len(context.statusTracker().getJobIdsForGroup("build"))
        QUERIES[name](spark, small)
        jobs = len(context.statusTracker().getJobIdsForGroup("build")) - before
        context.setLocalProperty("spark.jobGroup.id", None)
        assert jobs <= 14, (name, jobs)  # at most a schema read for each table


def test_searches_build_with_a_fixed_number_of_cuts(spark, small, monkeypatch):
    """Their checkpoints are one a step, however many rows there are."""
    from talentgrid.operators import cooccurrence, gap, similar, tables, topk
    from talentgrid.plans.catalog import QUERIES

    cuts = []

    def counted(df):
        cuts.append(df)
        return tables.cut_plan(df)

    for module in (cooccurrence, gap, similar, topk):
        monkeypatch.setattr(module, "cut_plan", counted)
    for name, most in (("cls_9_course_recommendation", 7), ("jon_5_mapping_cascade", 5), ("agg_24_conditional_cooccurrence", 5)):
        cuts.clear()
        QUERIES[name](spark, small)
        assert 0 < len(cuts) <= most, (name, len(cuts))


def test_recognised_skills_and_blended_vectors(spark):
    from talentgrid.operators.gap import profile_vector
    from talentgrid.operators.lookups import recognised

    vocab = spark.createDataFrame([("Machine Learning",), ("Python",), ("SQL",)], "skill string")
    rows = spark.createDataFrame([(1, " PYTHON\t"), (1, "python"), (2, "machine lerning"), (3, "AWS"), (4, None)], "profile_id int, skill string")
    for metric in ("edit", "ratio"):
        got = sorted(tuple(r) for r in recognised(rows, vocab, 0.75, metric).collect())
        assert got == [(1, "Python"), (2, "Machine Learning")]
    df = spark.createDataFrame([(1, [3.0, 0.0], [0.0, 2.0]), (2, [3.0, 0.0], None), (3, None, [0.0, 2.0]), (4, None, None)],
                               "id int, a array<double>, b array<double>")
    got = {r.id: r.v for r in df.select("id", profile_vector(F.col("a"), F.col("b")).alias("v")).collect()}
    assert np.allclose(got[1], [0.4, 0.6], atol=1e-6) and got[2] == [3.0, 0.0] and got[3] == [0.0, 2.0] and got[4] is None


def test_chi2_tail_is_that_of_the_library(spark):
    import math

    xs = [0.0, 0.01, 1.0, 3.84, 10.0, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.p for r in df.select(evaluate.chi2_tail(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [math.erfc(math.sqrt(x / 2)) for x in xs], atol=1e-9)


def test_chi2_tail_of_large_statistics(spark):
    import math

    xs = [3.9, 4.0, 4.1, 20.0, 187.0, 300.0, 350.0, 400.0, 1000.0, 1400.0, 1499.0, 1501.0, 1e5, 1e7, 1e300, math.inf]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.p for r in df.select(evaluate.chi2_tail(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [math.erfc(math.sqrt(x / 2)) for x in xs], rtol=1e-9, atol=1e-320)
    t = spark.createDataFrame([(0, 9000, 4000, 0, 1922.8)], "both long, a_only long, b_only long, neither long, statistic double")
    assert evaluate.with_decision(t).first().decision == "a better"
