"""Co-occurrence by bit rows against counting postings."""

import random
from pathlib import Path

import pytest

from talentgrid.operators import cooccurrence
from talentgrid.session import shared_dir


@pytest.mark.parametrize("patterns,needs", [(32768, 1024), (3, 2)])
def test_equals_counting(spark, monkeypatch, patterns, needs):
    monkeypatch.setattr(cooccurrence, "PATTERNS", patterns)
    monkeypatch.setattr(cooccurrence, "NEEDS", needs)
    draw = random.Random(4)
    skills = [f"s{i}" for i in range(12)]
    jobs = {j: (draw.choice("abc"), set(draw.sample(skills, draw.randint(1, 3)))) for j in range(150)}
    owned = {p: (draw.choice("abz"), set(draw.sample([*skills, "none"], draw.randint(1, 4)))) for p in range(25)}
    posting = [(j, r, s) for j, (r, ss) in jobs.items() for s in ss] + [(999, None, "s1"), (1, jobs[1][0], None)]
    profile = [(p, r, s) for p, (r, ss) in owned.items() for s in ss] + [(50, None, "s1"), (51, "a", None)]
    profile += profile[:3]
    got = cooccurrence.conditional_cooccurrence(
        spark.createDataFrame(profile, "profile_id long, target_role string, skill string"),
        spark.createDataFrame(posting, "job_id long, role string, skill string")).collect()
    want = {}
    for p, (role, mine) in owned.items():
        near = [ss for r, ss in jobs.values() if r == role and ss & mine]
        for s in set().union(*near) - mine:
            want[p, role, s] = sum(s in ss for ss in near) / len(near)
    assert {(r.profile_id, r.target_role, r.skill): r.cooccurrence for r in got} == want and len(got) == len(want)
    empty = spark.createDataFrame([], "profile_id long, target_role string, skill string")
    assert cooccurrence.conditional_cooccurrence(empty, spark.createDataFrame(posting, "job_id long, role string, skill string")).collect() == []


def _bytes(folder):
    return sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*") if f.is_file())


def test_counts_are_not_kept(spark):
    """What is written grows with the lists and postings, not with profiles times co-occurring skills."""
    names = [f"a skill with a long name {i}" for i in range(600)]
    profile = [(p, "a", s) for p in range(400) for s in (names[0], names[p % 200 + 1])]
    posting = [(j, "a", s) for j in range(3) for s in names]
    folder = shared_dir(spark)
    before = _bytes(folder)
    got = cooccurrence.conditional_cooccurrence(
        spark.createDataFrame(profile, "profile_id long, target_role string, skill string"),
        spark.createDataFrame(posting, "job_id long, role string, skill string"))
    assert got.count() == 400 * 598 and got.where("cooccurrence <> 1").isEmpty()
    assert _bytes(folder) - before < 400 * 598


def test_list_of_many_profiles(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "OWNERS", 3, raising=False)
    monkeypatch.setattr(cooccurrence, "ROWS", 7, raising=False)
    profile = [(p, "a", s) for p in [*range(40), None] for s in ("x", "y")]
    posting = [(1, "a", "x"), (1, "a", "z"), (2, "a", "y"), (3, "a", "z"), (4, "b", "x")]
    got = cooccurrence.conditional_cooccurrence(
        spark.createDataFrame(profile, "profile_id long, target_role string, skill string"),
        spark.createDataFrame(posting, "job_id long, role string, skill string")).collect()
    assert sorted(((r.profile_id, r.skill, r.cooccurrence) for r in got), key=str) == sorted(
        ((p, "z", 0.5) for p in [*range(40), None]), key=str)


def test_few_entries_are_read_as_lists(monkeypatch):
    """Both ways count the same; with few skills in a pattern of many, no rows of bits are formed."""
    import numpy as np

    draw = random.Random(6)
    for size, formed in ((600, False), (6, True)):
        names = [f"s{i}" for i in range(size)]
        lists = [sorted(draw.sample(range(size), draw.randint(1, 5))) for _ in range(900)]
        for weights in ([1] * 900, [draw.randint(1, 9) for _ in lists], [(1 << 52) + i for i in range(900)]):
            bucket = cooccurrence._Bucket(names, np.array(sum(lists, []), np.int32).tobytes(), np.array([len(x) for x in lists], np.int32).tobytes(),
                                          np.array(weights, np.int64).tobytes())
            for rows in (draw.sample(range(size), 4) for _ in range(5)):
                chosen = bucket.counts(rows)
                if weights == [1] * 900:
                    assert ("bits" in vars(bucket)) == formed
                hit = [(x, w) for x, w in zip(lists, weights) if set(x) & set(rows)]
                want = [sum(w for x, w in hit if i in x) for i in range(size)]
                for relevant, count in (chosen, bucket._by_lists(rows)):
                    assert relevant == sum(w for _, w in hit) and count.tolist() == want
            if weights[0] != 1 << 52:
                relevant, count = bucket._by_bits(rows)
                assert relevant == sum(w for _, w in hit) and count.tolist() == want


def test_rounded_as_round(spark):
    from pyspark.sql import functions as F

    from talentgrid.functions.numeric import rounded

    draw = random.Random(7)
    values = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1e300, 123456789.1234565, 5e-7, -5e-7, 4.9999999e-7]
    values += [k / 2e6 * s for k in range(1, 400, 2) for s in (1, -1)] + [a / b for b in (128, 200000, 2000000, 3, 7, 97) for a in range(1, 60)]
    values += [draw.uniform(-2, 2) for _ in range(2000)] + [draw.randint(-10 ** 7, 10 ** 7) / 10 ** 7 for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(
        rounded(F.col("x")).alias("a"), F.round("x", 6).alias("b")).collect()
    assert [str(r.a) for r in rows] == [str(r.b) for r in rows]
