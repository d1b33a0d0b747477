"""SimHash: fingerprints by their definition, trees and shards against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from talentgrid.llm import simhash
from talentgrid.llm.components import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius=2):
    first = list(range(len(values)))

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                first[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "Two WORDS", "a b c", "a b c d e  f", "ÄB c " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_spark_hash_is_the_named_one(spark):
    got = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_tree_finds_all_within_the_radius():
    random.seed(5)
    values = [random.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 7):
        assert sorted(tree.near(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


@pytest.mark.parametrize("largest", [2, 2000])
def test_links_join_what_all_pairs_join(spark, monkeypatch, largest):
    monkeypatch.setattr(simhash, "LARGEST", largest)
    rng = random.Random(11)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:12]:
        for _ in range(6):
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.append(v)
    values = sorted(set(values))
    signed = [simhash._signed(v) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    root = {r.node: r.root for r in components(edges).collect()}
    got = [root.get(v, v) for v in signed]
    want = groups(values)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == 61 + 80 and len({r.root for r in got}) == 2
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query_equals_all_pairs(spark, small):
    from talentgrid.llm.queries import QUERIES

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    prints = [plain(t) for _, t in docs]
    want = {(d, f"{f:016x}", docs[g][0]) for (d, _), f, g in zip(docs, prints, groups(prints), strict=True)}
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, small).collect()}
    assert got == want


def test_odd_rows(odd, none):
    got = simhash.near_groups(odd, "id").collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.fp == 0} == {3}
    kept = simhash.drop_near(odd, "id")
    assert kept.columns == odd.columns
    assert sorted(r.id for r in kept.collect()) == [1, 3, 5, 5, 7, 8, 10]
    assert simhash.near_groups(none, "id").collect() == [] and simhash.drop_near(none, "id").collect() == []


def test_mask_blocks_cover_every_bit_once():
    parts = [m & (1 << 64) - 1 for m in simhash.submasks(0)]
    assert sum(parts) == (1 << 64) - 1 and np.bitwise_or.reduce(np.array(parts, np.uint64)) == (1 << 64) - 1
