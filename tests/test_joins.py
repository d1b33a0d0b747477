"""Containment and pivot joins against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import pivots
from talentgrid.operators.containment import contained
from talentgrid.operators.lookups import containment_category, courses_for_role
from talentgrid.operators.roles import keyword_hits


def words(draw, n, longest, letters="ab c\né😀"):
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, longest))) for _ in range(n)]


def test_contained_equals_all_pairs(spark):
    draw = random.Random(3)
    texts = [*words(draw, 60, 30), "", "x" * 5000 + "rare" + "x" * 5000]
    keys = [*words(draw, 80, 7), "rare", "xxxx", "", "rare", "absent gram", None]
    hosts = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "id int, text string")
    got = contained(hosts, spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    want = {(i, k) for i, t in enumerate(texts) for k in keys if k and k in t}
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_contained_without_rows(spark):
    hosts = spark.createDataFrame([(1, "abc")], "id int, text string")
    keys = spark.createDataFrame([("ab",)], "key string")
    assert contained(hosts.where("false"), keys).count() == 0
    assert contained(hosts, keys.where("false")).count() == 0


def first_category(text, taxonomy):
    """The rule stated over all keys."""
    best = min(((0 if k == text else 1, o, c) for k, o, c in taxonomy if k is not None and (k in text or text in k)), default=None)
    return best[2] if best else "none"


@pytest.mark.parametrize("blank", [False, True])
def test_containment_category_equals_all_pairs(spark, blank):
    draw = random.Random(5)
    keys = sorted({k for k in words(draw, 60, 6, "abc d") if k.strip() == k and k})
    taxonomy = [(k, i, f"c{i % 7}") for i, k in enumerate(keys)] + [(None, 900, "null")] + ([("", 20, "blank")] if blank else [])
    rows = [(i, w) for i, w in enumerate([*words(draw, 80, 9, "abc dz"), "zzz", "", None])]
    got = containment_category(spark.createDataFrame(rows, "id int, word string"), "word",
                               spark.createDataFrame(taxonomy, "key string, key_order int, category string"), "none")
    want = {i: "none" if w is None else first_category(w.strip().lower(), taxonomy) for i, w in rows}
    assert {r.id: r.category for r in got.collect()} == want


def test_keyword_hits_equal_a_scan(spark):
    draw = random.Random(9)
    rules = [(f"r{i % 6}", i % 6, k, i // 6) for i, k in enumerate(words(draw, 48, 4, "abc"))]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(words(draw, 40, 12, "abcd"), words(draw, 40, 12, "abcd"), strict=True))] + [(40, None, "abc")]
    table = spark.createDataFrame(rows, "id int, one string, two string")
    got = keyword_hits(table, ["one", "two"], spark.createDataFrame(rules, "role string, role_order int, keyword string, keyword_order int"))
    for r in got.collect():
        texts = [t.strip() if t else t for t in rows[r.id][1:]]
        for h in r.hits:
            ordered = [k for role, _, k, _ in sorted(rules, key=lambda x: (x[3], x[2])) if role == h.role]
            want = [next((k for k in ordered if t is not None and k in t), None) for t in texts]
            have = [w for t, w in zip(texts, h.words, strict=True)]
            assert have == want or any(t is None for t in texts)
        assert len(r.hits) == 6


def test_courses_of_a_role_with_an_empty_word(spark):
    roles = spark.createDataFrame([("Data Engineer",), ("",), ("Ops",)], "role string")
    courses = spark.createDataFrame([("Big data", 1), ("Ops", 2), (None, 3)], "category string, course_id int")
    got = {(r.role, r.course_id) for r in courses_for_role(roles, courses).collect()}
    assert got == {("Data Engineer", 1), ("", 1), ("", 2), ("Ops", 2)}


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / ((math.hypot(*a) + 1e-9) * (math.hypot(*b) + 1e-9))


def vectors(draw, n, centers, spread):
    out = []
    for _ in range(n):
        c = draw.choice(centers)
        out.append([x + draw.gauss(0, spread) for x in c])
    return out


@pytest.fixture(scope="module")
def clustered():
    draw = random.Random(11)
    centers = [[draw.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    return vectors(draw, 150, centers, 0.25), vectors(draw, 400, centers, 0.25)


@pytest.mark.parametrize("least,floor,block", [(0.6, 0.3, 512), (0.95, 0.9, 7), (1.0, 0.0, 512)])
def test_threshold_links_equal_all_pairs(spark, clustered, monkeypatch, least, floor, block):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", block)
    monkeypatch.setattr(pivots, "PIVOTS", 8)
    left, right = clustered
    left = [*left, [0.0] * 12, None, [float("nan")] * 12, [1e-12] * 12]
    right = [*right, [0.0] * 12, None, [float("inf")] * 12]
    lt = spark.createDataFrame(list(enumerate(left)), "a int, vector array<double>")
    rt = spark.createDataFrame(list(enumerate(right)), "b int, vector array<double>")
    got = {(r.a, r.b): r.sim for r in pivots.threshold_links(lt, rt, "a", "b", least, floor).collect()}
    want = {}
    for i in [*range(150), 153]:  # the others have no direction
        sims = [(cosine(left[i], v), j) for j, v in enumerate(right[:400])]
        hits = [x for x in sims if x[0] >= least]
        best = max(sims)
        want.update({(i, j): s for s, j in (hits or ([best] if best[0] > floor else []))})
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bounds_leave_out_most_pairs_of_clusters(spark, clustered):
    left, right = clustered
    lt = spark.createDataFrame(list(enumerate(left)), "a int, vector array<double>")
    rt = spark.createDataFrame(list(enumerate(right)), "b int, vector array<double>")
    row = pivots.pairs_scored(lt, rt, "a", "b", 0.95).first()
    assert row.pairs == 150 * 400
    assert 0 < row.scored < row.pairs / 4


def test_repeated_rows_and_null_ids_keep_their_links(spark):
    lt = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.6, 0.8]), (2, [0.6, 0.8])], "a int, vector array<double>")
    rt = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0])], "b int, vector array<double>")
    got = sorted((r.a or 0, r.b, round(r.sim, 6)) for r in pivots.threshold_links(lt, rt, "a", "b", 0.9, 0.3).collect())
    assert got == [(0, 1, 1.0)] * 4 + [(2, 1, 0.6)] * 2
    assert pivots.threshold_links(lt, rt.where("false"), "a", "b").count() == 0
    with pytest.raises(ValueError):
        pivots.threshold_links(lt, rt, "a", "b", 0.2, 0.3)
