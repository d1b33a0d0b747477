"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: input folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import time

from talentgrid.plans.catalog import QUERIES
from talentgrid.session import local_session

HEADLINE = [
    "rnk_1_top_priority_skills", "agg_2_skill_counts", "agg_5_competition", "agg_9_penetration",
    "agg_16_tfidf", "agg_18_top_skill_trend", "agg_22_centroids", "agg_33_entity_scores",
    "cls_2_dictionary_skills", "cls_6_profile_predictor", "cls_8_skill_gap", "cls_11_readiness",
    "flt_7_min_support", "fun_7_whitespace_tokens", "his_1_current_state", "prf_4_experience_records",
    "smp_1_stratified_split", "cls_9_course_recommendation", "agg_24_conditional_cooccurrence", "jon_7_fuzzy_native",
    "prf_7_assembled_profile",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "talentgrid-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["agg_1_value_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
