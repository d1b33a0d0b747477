"""Registered queries beside their SQL on the smallest tables (all of them: tools/check.py)."""

import duckdb
import pytest

from talentgrid.plans.catalog import QUERIES, SQL
from tools.check import TABLES, rows_of

SAMPLE = [
    "agg_5_competition", "agg_8_collapse_rare", "agg_16_tfidf", "agg_28_skill_correlation",
    "agg_37_vocabulary_index", "agg_41_quartiles", "cls_1_role_labels", "cls_2_dictionary_skills",
    "cls_11_readiness", "flt_8_postings_with_skills", "flt_11_valid_skills", "fun_3_clean_skill_list",
    "fun_8_spans_to_tags", "fun_20_normalized_answers", "his_1_current_state", "jon_6_threshold_links",
    "jon_7_fuzzy_native", "prf_1_sections", "prf_4_experience_records", "rnk_8_decode_spans",
    "rnk_9_token_windows", "smp_1_stratified_split", "src_2_courses_csv", "src_5_annotated_documents",
    "str_1_incremental_ingest", "str_2_incremental_trend", "top_2_missing_top_k",
]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    rel = duck.execute(SQL[name])
    cols, want = [d[0] for d in rel.description], rel.fetchall()
    assert sorted(df.columns) == sorted(cols)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(cols, want)
    assert got


def test_every_query_is_named_and_known():
    assert len(QUERIES) > 190
    assert set(SQL) <= set(QUERIES)
