"""Exact dedup: equal to SQL on the tables, hand cases, rows kept whole."""

from collections import Counter

from talentgrid.llm.exact import drop_copies, exact_groups


def test_groups_of_odd_rows(odd):
    got = Counter(tuple(r) for r in exact_groups(odd, "id").collect())
    assert sum(got.values()) == odd.count()
    assert got[(1, 1, 4, True)] == 1 and got[(2, 1, 4, False)] == 2 and got[(None, 1, 4, False)] == 1
    assert got[(3, 3, 3, True)] == 1 and got[(4, 3, 3, False)] == 1 and got[(None, 3, 3, False)] == 1
    assert got[(5, 5, 2, True)] == 1 and got[(6, 5, 2, False)] == 1
    assert got[(5, 5, 1, True)] == 1 and got[(9, 9, 1, True)] == 1


def test_one_row_of_each_group_with_all_columns(odd):
    kept = drop_copies(odd, "id")
    assert kept.columns == odd.columns
    assert sorted(r.id for r in kept.collect()) == [1, 3, 5, 5, 7, 8, 9, 10]


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (2, "same"), (None, "n"), (None, "n")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in drop_copies(df).collect()) == [(0, "n"), (1, "same")]


def test_no_rows(none):
    assert exact_groups(none, "id").collect() == [] and drop_copies(none, "id").collect() == []


def test_no_python_on_the_path(spark, small):
    from talentgrid.llm.queries import QUERIES

    plan = QUERIES["op7_exact_dedup"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
