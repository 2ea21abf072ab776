"""Times headline queries; prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
$BENCH_QUERIES may name other queries, or ``all``. Every query runs once to warm
up and then twice; the better of both counts. Results go to a sink that drops
them, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from surveyloom import queries as registry  # noqa: E402
from surveyloom.session import local_session  # noqa: E402

HEADLINE = [
    "response_count", "option_summary", "numeric_summary", "upload_summary", "matrix_summary",
    "indicator_scale_score", "indicator_coverage", "metrics_summary", "provenance_lists", "scope_filter",
    "split_to_facts", "wide_to_facts", "component_lookup", "two_source_full_join",
    "value_share_total", "crosstab_column_pct", "option_rate_dedup", "unit_option_heatmap", "target_ratio_matrix",
    "mean_vs_overall", "user_cross_tab", "box_summary", "zscore_outliers", "corr_matrix", "anova_f", "cronbach_alpha",
    "recode_bands", "reverse_score", "choice_codes", "dimension_scores", "dimension_classes",
    "segment_blocks", "component_order", "text_key", "char_ngrams", "exact_question_groups", "near_matches",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    registry.load_all()
    names = list(registry.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    spark = local_session(cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        best = None
        for attempt in range(rounds + 1):
            started = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - started
            if attempt > 0 or rounds == 0:
                best = seconds if best is None else min(best, seconds)
        timings[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(os.path.normpath(sf)), "cores": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
