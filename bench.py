"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data
and cores. Each query is run to completion into a sink that drops its rows; the best
of two runs counts, so that the first start of workers and code generation does not.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatterlake.plans.queries import registered  # noqa: E402
from chatterlake.session import build_session  # noqa: E402

HEADLINE = [
    "spam_repeat_letters", "spam_repeat_words", "spam_repeat_sentences", "clean_comments", "removal_stats",
    "topics_by_language", "clean_topics", "word_cloud", "word_counts", "language_distribution",
    "label_tourism", "label_summary", "sample_exact", "sample_ranges", "daily_counts", "coerce_fractional",
    "csv_roundtrip", "json_to_csv", "convert_folder", "split_by_year", "yearly_trends", "compare_tables",
    "profile_table", "language_scores", "sentiment_scores", "score_hook", "job_analyze", "job_label", "job_sentiment",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(2):
            start = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.time() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(folder.rsplit("sf", 1)[-1]) if "sf" in folder else None,
    }))


if __name__ == "__main__":
    main()
