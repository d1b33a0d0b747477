"""Pruned searches against scoring every pair."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import gap, similar, topk
from talentgrid.operators.lookups import nearest_key
from talentgrid.plans import text_queries
from talentgrid.plans.views import Tables


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def strings(draw, n, letters, longest):
    return sorted({"".join(draw.choice(letters) for _ in range(draw.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("metric,cutoff", [("edit", 0.6), ("edit", 0.8), ("ratio", 0.6), ("ratio", 0.85)])
def test_nearest_keys_equal_all_pairs(spark, metric, cutoff):
    draw = random.Random(7)
    vocab = strings(draw, 70, "abcd +é", 12) + ["Brand#12 " + w for w in strings(draw, 30, "abcde", 10)]
    words = strings(draw, 60, "abcd+é", 12) + ["Brand#13 " + w for w in strings(draw, 30, "abcde", 10)] + ["", None, None]

    def score(w, k):
        if metric == "edit":
            return 1 - levenshtein(w, k) / max(len(w), len(k))
        return difflib.SequenceMatcher(None, k, w).ratio()

    want = {}
    for w in {w for w in words if w}:
        best = max((score(w, k), k) for k in vocab)
        if best[0] >= cutoff:
            want[w] = best[1]
    got = nearest_key(spark.createDataFrame([(w,) for w in words], "word string"),
                      spark.createDataFrame([(k,) for k in [*vocab, "", None]], "key string"), cutoff, metric).collect()
    assert {r.word: r.key for r in got} == want and len(got) == len(want)


def test_few_pairs_are_scored(spark, small):
    t = Tables(spark, small.replace("sf0.001", "sf0.01"))
    words, vocab = text_queries.typos(t), text_queries.vocab(t)
    for cutoff in (0.7, 0.8):
        met = []
        left, keys = similar.pieces(words, "word").persist(), similar.pieces(vocab, "key").persist()
        for step in [*(s for s in similar.STEPS if s > cutoff), cutoff]:
            pairs = similar.candidates(left, keys, step, "edit").persist()
            met.append(pairs.count())
            near = pairs.where(1 - F.levenshtein("word", "key") / F.greatest(F.length("word"), F.length("key")) >= step)
            left = left.join(near.select("word").distinct(), "word", "left_anti").persist()
        assert sum(met) < 0.05 * words.count() * vocab.count()


def overlap(demand, course):
    total, both = max(sum(demand.values()), 1e-8), [w for s, w in demand.items() if s in course]
    union = len(demand) + len(course) - len(both)
    return (sum(both) / total + (len(both) / union if union else 0) + (len(both) / len(course) if course else 0)) / 3


@pytest.mark.parametrize("seed,per_shard", [(1, 1000), (2, 7)])
def test_best_courses_equal_all_pairs(spark, monkeypatch, seed, per_shard):
    monkeypatch.setattr(topk, "COURSES", per_shard)
    monkeypatch.setattr(topk, "DEMANDS", 9)
    draw = random.Random(seed)
    skills = [f"s{i}" for i in range(60)]
    courses = [(i, f"u{i // 2}", f"c{draw.randrange(6)}") for i in range(120)]
    taught = {i: set(draw.sample(skills, draw.choice([0, 1, 5, 20]))) for i, _, _ in courses}
    weights = {s: float(draw.randint(1, 9)) for s in skills[:50]}
    affinity = {(r, f"c{c}"): round(draw.random(), 2) for r in "ab" for c in range(5)}
    lacking = {p: (draw.choice("abz"), draw.sample(skills, draw.randint(0, 8))) for p in range(40)}
    lacking[40] = lacking[41] = ("a", skills[:5])
    missing = [(p, r, s) for p, (r, ss) in lacking.items() for s in ss] + [(50, "a", "unknown")]

    def rows(data, schema):
        return spark.createDataFrame(data, schema)

    args = (rows(missing, "profile_id long, role string, skill string"),
            rows([(s, s) for s in skills], "skill string, equivalent string"),
            rows(courses, "course_id long, url string, category string"),
            rows([(i, s) for i, ss in taught.items() for s in ss], "course_id long, skill string"),
            rows(list(weights.items()), "skill string, weight double"),
            rows([(*k, a) for k, a in affinity.items()], "role string, category string, affinity double"))
    got = {}
    for r in gap.recommend_courses(*args, n=5).collect():
        got.setdefault(r.profile_id, []).append((r["rank"], r.course_id, round(r.match, 9)))
    known = set().union(*taught.values())
    for p in {m[0] for m in missing}:
        role = next(m[1] for m in missing if m[0] == p)
        demand = {m[2]: weights.get(m[2], 1.0) for m in missing if m[0] == p and m[2] in known}
        over = {i: overlap(demand, taught[i]) for i, _, _ in courses}
        most, best = max(max(over.values()), 1e-8), {}
        for i, url, category in courses:
            a = affinity.get((role, category), 0.0)
            match = over[i] * (0.4 + 0.6 * a) / most
            row = (-round(0.6 * match + 0.4 * a, 7), i, match)
            best[url] = min(best.get(url, row), row)
        want = [(n, i, round(m, 9)) for n, (_, i, m) in enumerate(sorted(best.values())[:5], 1)]
        assert sorted(got[p]) == want, p
    assert set(got) == {m[0] for m in missing}


def test_few_courses_are_scored(spark, small):
    """Pairs scored to the end stay below a tenth of profiles times courses."""
    from talentgrid.operators import market
    from talentgrid.plans import vector_queries as V

    t = Tables(spark, small.replace("sf0.001", "sf0.1"))
    missing = V.missing_long(t).select("profile_id", F.col("target_role").alias("role"), "skill")
    wanted = gap.equivalents(missing.select("profile_id", "skill"), V.skill_map(t), t.course_skills)
    lists = topk.demand_lists(wanted, market.skill_weights(t.course_skills, t.job_links), missing)
    courses = t.courses.withColumn("url", F.col("course_id").cast("string"))
    found = topk.search_courses(lists.dropDuplicates(["demand"]), topk.course_shards(courses, t.course_skills), V.affinity_table(t))
    scored = found.agg(F.sum("scored")).first()[0]
    assert 0 < scored < 0.1 * missing.select("profile_id").distinct().count() * courses.count()


def test_skills_meet_courses_once_a_demand(spark):
    """Profiles of one demand get what its first profile gets; a profile of two roles has a course once."""
    recommended = spark.createDataFrame(
        [(p, "a", "x", c, k) for p in (1, 2) for k, c in enumerate((10, 11), 1)] + [(3, "a", "y", 10, 1), (3, "b", "z", 10, 1),
         (3, "b", "z", 12, 2), (4, "b", "w", 12, 1)], "profile_id long, role string, demand string, course_id long, rank int")
    demand = spark.createDataFrame([(1, "s"), (1, "r"), (3, "t"), (3, "s"), (4, "q")], "profile_id long, skill string")
    taught = spark.createDataFrame([(10, "s"), (10, "r"), (10, "t"), (11, "s"), (12, "t"), (12, "u")], "course_id long, skill string")
    got = sorted(tuple(r) for r in gap.covered_skills(recommended, demand, taught).collect())
    assert got == [(1, 10, ["r", "s"]), (1, 11, ["s"]), (2, 10, ["r", "s"]), (2, 11, ["s"]), (3, 10, ["s", "t"]), (3, 12, ["t"])]


def test_missing_skills_look_at_the_head_of_a_role(spark):
    """As many skills as are owned can fall out before the cut, so the rest of a role's list is left alone."""
    names = [f"s{i:03}" for i in range(200)]
    draw = random.Random(3)
    owned = {0: [], 1: names[:30], 2: names, 3: draw.sample(names, 90), 4: names[1::2], 5: ["other"]}
    profiles = spark.createDataFrame([(p, "a", o) for p, o in owned.items()], "profile_id long, target_role string, owned array<string>")
    ranked = spark.createDataFrame([("a", names, [float(195 - i) for i in range(200)])],
                                   "role string, role_skills array<string>, role_scores array<double>")
    rows = gap.missing_skills(profiles, ranked)
    for r in rows.collect():
        left = [s for s in names if s not in owned[r.profile_id]][:20]
        assert [m.skill for m in r.missing] == [s for s in left if names.index(s) < 195][:15]
    assert "array_except(slice(role_skills" in rows._jdf.queryExecution().optimizedPlan().toString()
