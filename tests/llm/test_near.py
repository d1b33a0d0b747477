"""Near copies against brute-force Jaccard similarity of five-word shingles."""

import random
import re

import pytest

import corpus_pipeline
from talentgrid.llm import lines, near


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def kept(rows):
    """Ids that stay: the smallest of each component of the pairs of similarity 0.8 or more."""
    sets, first = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                first[max(a, b)] = min(a, b)
    return sorted(min(rows[j][0] for j in range(len(rows)) if top(j) == g) for g in {top(i) for i in range(len(rows))})


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10 ** 6)}"
    return words


@pytest.mark.parametrize("largest", [3, 1000])
def test_stage_drops_what_brute_force_finds(spark, small, monkeypatch, largest):
    monkeypatch.setattr(lines, "LARGEST", largest)
    rng, rows = random.Random(7), []
    for n in (20, 60, 120, 300):
        for _ in range(6):
            words = [f"w{rng.randrange(3000)}" for _ in range(n)]
            rows.append(" ".join(words))
            rows += [" ".join(changed(rng, words, k)) for k in (1, max(1, n // 60), n // 50 + 1, n // 25 + 1, n // 8)]
    rows += [rows[0].replace(" ", "\n\t"), rows[0].upper(), "a b", "A  b", ""]
    docs = [(i, t) for i, t in enumerate(rows)]
    want = kept(docs)
    got = near.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < len(rows) - 40


def test_stage_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, small).collect())
    assert got == kept(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_stage_follows_links_of_both_methods(spark, small):
    # repeats weigh in a fingerprint and not in a set of shingles: 0 and 1 have one fingerprint, 21 of 56 shingles in common
    block, rng = [f"b{i}" for i in range(21)], random.Random(3)
    first = block * 40
    second = first + [f"n{i}" for i in range(30)]
    words = [f"w{i}" for i in range(300)]
    rows = [" ".join(x) for x in (first, second, second[:-1] + ["n"], words, changed(rng, words, 3), words[:150])]
    docs = list(enumerate(rows))
    assert kept(docs) == [0, 1, 3, 5]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, small).collect()) == [0, 3, 5]


def test_odd_rows(odd, none):
    got = near.drop_near_copies(odd, "id")
    assert got.columns == odd.columns
    assert sorted(r.id for r in got.collect()) == [1, 3, 5, 5, 7, 8, 10]
    assert near.drop_near_copies(none, "id").collect() == []
