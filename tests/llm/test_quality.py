"""Quality classifier: held-out accuracy, trees against a plain walk, odd rows."""

import numpy as np

from talentgrid.llm.boosting import fit
from talentgrid.llm.quality import FEATURES, features, keep_good, score, train


def test_flat_walk_equals_a_walk_node_by_node():
    rng = np.random.RandomState(1)
    x = rng.rand(600, 5)
    y = ((x[:, 0] > 0.4) ^ (x[:, 3] > 0.7)).astype(float)
    trees = fit(x, y, trees=20, depth=3)
    want = []
    for row in x:
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        want.append(1 / (1 + np.exp(-total)))
    got = trees.scores(x)
    assert np.allclose(got, want)
    assert ((got >= 0.5) == y).mean() > 0.97


def test_one_class_and_no_rows_are_constant():
    assert np.allclose(fit(np.zeros((0, 3)), np.zeros(0)).scores(np.ones((2, 3))), 0.5)
    assert (fit(np.ones((9, 3)), np.ones(9)).scores(np.ones((2, 3))) > 0.8).all()


def test_features_of_odd_texts():
    for text in (None, "", " ", "\n", "x" * 300_000, "é" * 10, "a a a"):
        f = features(text)
        assert f.shape == (len(FEATURES),) and np.isfinite(f).all()


def test_held_out_accuracy(spark):
    from talentgrid.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (None, 0), (7, None), (8, 0), (8, 3)], "doc_id long, quality int")
    trees = train(odd.withColumnRenamed("id", "doc_id"), labels)
    assert score(odd, trees, "id").count() == odd.count()
    assert keep_good(odd, trees, at_least=0.0).collect() == odd.collect()
    assert score(none, trees, "id").collect() == [] and keep_good(none, trees).collect() == []
    assert train(none.withColumnRenamed("id", "doc_id"), labels.limit(0)).base == 0
