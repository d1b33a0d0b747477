"""Greedy string tiling against its definition, and planted passages."""

import random

import numpy as np

from talentgrid.llm.tiling import contaminations, drop_contaminated, tile


def plain_tiling(a, b, least):
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        longest, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > longest:
                    longest, found = k, []
                if k == longest:
                    found.append((i, j))
        marked = False
        for i, j in found:
            if all(free_a[i:i + longest]) and all(free_b[j:j + longest]):
                free_a[i:i + longest] = free_b[j:j + longest] = [False] * longest
                tiles.append(longest)
                marked = True
        if not marked:
            return tiles


def test_tiles_are_those_of_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randint(1, 3) for _ in range(rng.randint(1, 25))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(1, 50))]
        got = [n for _, _, n in tile(np.array(a), np.array(b), 3)]
        assert sorted(got) == sorted(plain_tiling(a, b, 3))


def test_reordered_and_partial_passages(spark, odd, none):
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    item = " ".join(words)
    parts = [" ".join(words[k:k + 10]) for k in range(0, 60, 10)]
    noise = " ".join(f"n{rng.randint(0, 400)}" for _ in range(3000))
    docs = spark.createDataFrame([
        (1, f"{noise} {item} {noise}"), (2, f"{noise} {'! '.join(reversed(parts))} {noise}".upper()),
        (3, f"{parts[0]} {noise} {parts[1]}"), (4, noise), (5, None), (6, ""), (7, " and ".join(words)),
    ], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (9, item), (8, None), (7, "?!"), (6, "w0q")], "item_id long, text string")
    got = {(r.id, r.item_id): r for r in contaminations(docs, bench).collect()}
    assert set(got) == {(1, 9), (2, 9)}
    assert got[1, 9].coverage == 1 and got[2, 9].tiles >= 6
    kept = drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7] and kept.columns == docs.columns
    assert drop_contaminated(odd, bench).count() == odd.count()
    assert contaminations(none, bench, "id").collect() == [] and drop_contaminated(odd, bench.limit(0)).count() == odd.count()


def test_query_finds_the_planted_passages(spark, small):
    from talentgrid.llm.queries import QUERIES

    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, small).collect()}
    assert whole and whole <= got and len({d for d, _ in got}) <= len({d for d, _ in whole}) + 2
