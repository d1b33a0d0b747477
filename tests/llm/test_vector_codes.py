"""Vector codes against plain integer rounds, and the tree of entries against all pairs."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from talentgrid.llm.queries import QUERIES, SQL
from talentgrid.llm.vector_codes import Gnat, compress, squared
from tools.check import rows_of

MOST = 2**63 - 1


def by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The definition on lists of Python integers."""
    kept = [(i, label, [math.floor(Fraction(x) * scale) for x in v]) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, len(r[2])))
    if not order:
        return []
    width = len(order[0][2])
    kept, order = [r for r in kept if len(r[2]) == width], [r for r in order if len(r[2]) == width]
    cuts = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    books = [[r[2][a:b] for r in order[:entries]] for a, b in cuts]

    def nearest(p, q):
        return min((sum((x - y) ** 2 for x, y in zip(q, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p, (a, b) in enumerate(cuts):
            groups = [[] for _ in books[p]]
            for r in kept:
                groups[nearest(p, r[2][a:b])[1]].append(r[2][a:b])
            new.append([[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(groups, books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(r[0], r[1], [nearest(p, r[2][a:b]) for p, (a, b) in enumerate(cuts)]) for r in kept]
    sums = {}
    for _, label, n in found:
        sums[label] = sums.get(label, 0) + min(sum(d for d, _ in n), MOST)
    return [(i, label, "".join(f"{k:02x}" for _, k in n), min(sum(d for d, _ in n), MOST), min(sums[label], MOST), digest)
            for i, label, n in found]


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<double>, label int, code string, part int")
    got = compress(df, **options).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, by_hand(rows, **options)))
    return got


@pytest.mark.parametrize("kind", [np.int64, object])
@pytest.mark.parametrize("n,width,spread", [(16, 8, 3), (1, 4, 5), (40, 2, 2), (100, 3, 1000), (16, 1, 1), (30, 5, 10**6)])
def test_tree_finds_the_nearest(kind, n, width, spread):
    draw = np.random.default_rng(n)
    entries = draw.integers(-spread, spread + 1, (n, width)).astype(kind)
    queries = draw.integers(-spread, spread + 1, (500, width)).astype(kind)
    tree = Gnat(entries)
    index, best = tree.nearest(queries)
    every = np.array([squared(queries, e) for e in entries])
    assert index.tolist() == every.argmin(axis=0).tolist()  # the first of equal distances
    assert best.tolist() == every.min(axis=0).tolist()


def test_tree_leaves_subtrees_out():
    draw = np.random.default_rng(0)
    centres = draw.integers(-10**6, 10**6, (8, 4))
    entries = np.concatenate([centres + draw.integers(-50, 50, centres.shape) for _ in range(4)])
    tree = Gnat(entries)
    tree.nearest(entries.repeat(10, axis=0))
    assert tree.pairs < 0.6 * len(entries) ** 2 * 10


def test_codes_by_definition(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(16)], draw.choice([None, 1, 2])) for i in range(-20, 60)]
    check(spark, rows)
    check(spark, rows[:5])
    check(spark, rows, parts=4, entries=5, rounds=2, scale=10)
    check(spark, [(i, v[:11], k) for i, v, k in rows], parts=4)


def test_odd_vectors(spark):
    good = [0.5, -0.25, 1 / 3, 2.0, -1e-9, 0.0, 7.0, 1.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [None, *good[1:]], 1), (4, [nan, *good[1:]], 1), (5, [inf, *good[1:]], None),
            (6, good, None), (7, good, 1), (7, good, 1), (None, [x + 1 for x in good], None), (8, good[:7], 2),
            (9, [-x for x in good], 2), (10, [1e9, -1e9, *good[2:]], 3), (11, [3e12, *good[1:]], 3)]
    assert len(check(spark, rows)) == 7
    huge = check(spark, [*rows, (12, [1e14] * 8, 3), (0, [-1e14] * 8, 3)], entries=2)
    assert max(r.error for r in huge) == MOST
    assert check(spark, rows[:2]) == []
    assert compress(spark.createDataFrame([(1, [1e300] * 8, 1)], "vec_id long, embedding array<double>, label int")).count() == 1
    assert compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    df = QUERIES["op13_vector_codes"](spark, small)
    want = con.execute(SQL["op13_vector_codes"])
    cols = [d[0] for d in want.description]
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(cols, want.fetchall()) and len(got) > 100 and sorted(df.columns) == sorted(cols)
