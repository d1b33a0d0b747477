"""Views of chosen profiles and of the vocabulary against the whole views."""

from talentgrid.plans import vector_queries as VQ
from talentgrid.plans.views import Tables


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_views_of_chosen_profiles(spark, tmp_path):
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    make("nation", [(0, "A"), (1, "B")], "n_nationkey long, n_name string")
    make("customer", [(c, c and c % 3, "S") for c in (1, 2, 3, 4, 4, 5, None)], "c_custkey long, c_nationkey long, c_mktsegment string")
    make("orders", [(o, c, None, 1.0, "O", "P") for o, c in ((10, 1), (11, 1), (12, 2), (13, 4), (14, 9), (None, 3), (15, None), (16, 3))],
         "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string, o_orderpriority string")
    make("lineitem", [(o, p) for o in (10, 11, 12, 13, 14, 15, 16, None) for p in (o and o % 4, 7, None)] + [(10, 7)], "l_orderkey long, l_partkey long")
    make("part", [(0, "b0", "n0"), (1, "b1", None), (2, "b2", "n2"), (3, "b0", "n0"), (7, "b7", "n7"), (8, "x", "y"), (None, "z", "z")],
         "p_partkey long, p_brand string, p_name string")
    t = Tables(spark, str(tmp_path))
    chosen = spark.createDataFrame([(1,), (4,), (4,), (9,), (None,)], "profile_id long")
    want = [r for r in _rows(t.profile_skills) if r[0] in (1, 4)]
    assert _rows(t.profile_skills_of(chosen)) == want and want
    assert _rows(t.posting_vocabulary) == _rows(t.posting_skills.select("skill").distinct())
    spelled = [r for r in _rows(VQ.spelled(t)) if r[0] in (1, 4)]
    assert _rows(VQ.spelled(t, chosen)) == spelled
