"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The staging entries are the passes over lineitem that derive the warehouse tables, and the gram dictionary of searches; the raw_* entries repeat those
passes as plain queries; all others read the derived tables or the text tables.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from boardstat.plans import bindings, catalog

HEADLINE = """national_counts school_counts exam_summary exam_difficulty compare_exams trend_analytics volume_analytics
combined_analytics enriched_history headline_extremes school_history school_summary consistency_scores
school_rank_history school_trend rankings aggregate_rankings program_leaderboard rate_distribution regional_analytics
school_topnotchers global_search audit_national verification_report bad_rows html_to_text extract_summary infer_exam
html_tables parse_lines_table parse_school_reports ingest_announcements upsert_national merge_index
throttle_events""".split()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {"stage_national": timed(lambda: (bindings.national(spark, sf_dir), bindings.registered(spark, sf_dir))),
               "stage_schools": timed(lambda: bindings.schools(spark, sf_dir)),
               "stage_search": timed(lambda: bindings.search_index(spark, sf_dir))}
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        seconds[name] = timed(lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
