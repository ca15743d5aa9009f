"""Registered queries of schools, rankings, search and logs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import logs, national, rankings, schools, search
from . import bindings as b


def search_texts(spark, sf: str) -> DataFrame:
    """Two search texts per school: its first word with its number, and one of the odd cases."""
    rows = b.read(spark, sf, "supplier").join(b.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    odd = F.element_at(F.array(*[F.lit(x) for x in ("plv", " UST ", "up", "", "x", "State  University", "civil", "9")]),
                       (key % 8 + 1).cast("int"))
    texts = F.array(F.concat("n_name", F.lit(" "), key.cast("string")), odd)
    return (rows.select(key, F.posexplode(texts).alias("at", "query"))
            .select((key * 10 + F.col("at")).cast("long").alias("query_id"), "query"))


def _school_search_count(spark, sf: str) -> DataFrame:
    texts = search_texts(spark, sf).where(F.trim("query") != "")
    tokens = names.search_tokens(F.col("query"))
    asked = texts.select("query_id", F.when(F.size(tokens) > 0, tokens).otherwise(
        F.array(F.lower(F.trim("query")))).alias("tokens"))
    return search.search_counts(b.schools(spark, sf).schools, asked, b.search_index(spark, sf))


def _cycle_texts(spark, sf: str) -> DataFrame:
    """Search texts with year and month words, one per registered cycle."""
    rows = national.with_order(national.with_program(b.registered(spark, sf)))
    mark, year = F.expr("id div 10") % 3, F.col("year").cast("string")
    month = F.element_at(F.split("month", " "), 1)
    text = (F.when(mark == 0, F.concat(F.lower("exam_code"), F.lit(" "), year))
            .when(mark == 1, F.concat(F.substring(month, 1, 3), F.lit("  "), year))
            .otherwise(F.concat(month, F.lit(" "), "exam_code")))
    return rows.select(F.col("id").alias("query_id"), text.alias("query"))


def _consistency_table(spark, sf: str) -> DataFrame:
    """Stored scores, some of schools that are gone, after new ones were computed."""
    t = b.schools(spark, sf)
    now = schools.consistency_scores(t)
    old = now.where("school_id % 4 = 0").select(
        F.explode(F.array("school_id", -F.col("school_id"))).alias("school_id"), "program_id")
    stored = old.select(
        (F.col("school_id") * 100 + F.col("program_id")).alias("id"), "school_id", "program_id", F.lit(1.0).alias("avg_rate"),
        F.lit(0.0).alias("volatility"), F.lit(0.0).alias("score"), F.lit("old").alias("label"), F.lit(9).alias("years"),
        F.lit("2020-01-01").cast("timestamp").alias("computed_at"))
    done = schools.store_consistency(replace(t, consistency_scores=stored), "2026-01-02").consistency_scores
    return done.select("school_id", "program_id", "avg_rate", "label", "years",
                       F.date_format("computed_at", "yyyy-MM-dd").alias("computed_on"))


def _program_search(spark, sf: str) -> DataFrame:
    t = b.registered(spark, sf)
    counts = t.exam_results.groupBy("exam_code").agg(F.count("*").alias("cycles"))
    return (national.program_search(t.programs, "Engineer").join(counts, "exam_code")
            .select("exam_code", F.col("name").alias("exam_fullname"), "slug", "cycles"))


QUERIES = {
    "school_counts": lambda spark, sf: b.school_counts(spark, sf),
    "school_performance": lambda spark, sf: b.schools(spark, sf).school_performance,
    "topnotchers": lambda spark, sf: b.schools(spark, sf).topnotchers,
    "latest_topnotchers": lambda spark, sf: national.latest_topnotchers(b.schools(spark, sf)),
    "top_schools": lambda spark, sf: rankings.top_schools(b.schools(spark, sf)),
    "top_schools_in_month": lambda spark, sf: rankings.top_schools(b.schools(spark, sf), year=2019, month="nov",
                                                                   limit=50),
    "school_list": lambda spark, sf: schools.school_list(b.schools(spark, sf), search="state NATION_1", page=2,
                                                         per_page=15),
    "school_page": lambda spark, sf: schools.school_page(b.schools(spark, sf), b.school_directory(spark, sf), page=4),
    "school_page_found": lambda spark, sf: schools.school_page(
        b.schools(spark, sf), b.school_directory(spark, sf), search="state NATION_1", region="as", page=2, per_page=7),
    "school_list_region": lambda spark, sf: schools.school_list(b.schools(spark, sf), region="as"),
    "school_list_embedded": lambda spark, sf: schools.school_list(b.schools(spark, sf), region="as", per_page=500,
                                                                  region_mode="embed"),
    "school_history": lambda spark, sf: schools.school_history(b.schools(spark, sf)).drop("cycle_no"),
    "school_summary": lambda spark, sf: schools.school_summary(b.schools(spark, sf)),
    "consistency_pooled": lambda spark, sf: schools.consistency_pooled(schools.school_history(b.schools(spark, sf))),
    "consistency_scores": lambda spark, sf: schools.consistency_scores(b.schools(spark, sf)),
    "school_rank_history": lambda spark, sf: schools.school_rank_history(schools.school_history(b.schools(spark, sf))),
    "school_vs_national": lambda spark, sf: schools.school_vs_national_series(
        schools.school_history(b.schools(spark, sf))),
    "school_trend": lambda spark, sf: schools.school_trend(b.schools(spark, sf)),
    "school_trend_series": lambda spark, sf: schools.school_trend_series(b.schools(spark, sf)),
    "consistency_table": _consistency_table,
    "school_filter_province": lambda spark, sf: schools.school_filter(b.schools(spark, sf), province="Nation_3"),
    "sorted_cycles": lambda spark, sf: logs.apply_sort(
        b.registered(spark, sf).exam_results.where("total_takers is not null"), "total_takers.desc",
        ["year", "total_takers"], F.asc("id")).select("exam_code", "year", "month", "total_takers", "id"),
    "search_cycles": lambda spark, sf: search.search_cycles(b.registered(spark, sf), _cycle_texts(spark, sf)),
    "school_topnotchers": lambda spark, sf: search.school_topnotchers(b.schools(spark, sf), b.search_index(spark, sf)),
    "compare_schools": lambda spark, sf: schools.compare_schools(
        b.schools(spark, sf), b.schools(spark, sf).schools.select(F.col("id").alias("school_id")), "building"),
    "regional_analytics": lambda spark, sf: schools.regional_analytics(b.schools(spark, sf)),
    "regional_analytics_exam": lambda spark, sf: schools.regional_analytics(b.schools(spark, sf), "machinery"),
    "rankings": lambda spark, sf: rankings.rankings(b.schools(spark, sf)),
    "rankings_filtered": lambda spark, sf: rankings.rankings(
        b.schools(spark, sf), region="america", school="Nation University", min_takers=5, limit=200),
    "aggregate_rankings": lambda spark, sf: rankings.aggregate_rankings(b.schools(spark, sf)),
    "aggregate_rankings_region": lambda spark, sf: rankings.aggregate_rankings(
        b.schools(spark, sf), region="Europe", min_takers=40, min_years=3),
    "program_leaderboard": lambda spark, sf: rankings.program_leaderboard(b.schools(spark, sf)),
    "leaderboard_flat": lambda spark, sf: rankings.leaderboard_flat(rankings.program_leaderboard(b.schools(spark, sf))),
    "rate_distribution": lambda spark, sf: rankings.rate_distribution(b.schools(spark, sf)),
    "topnotcher_list": lambda spark, sf: rankings.topnotcher_list(b.schools(spark, sf)),
    "topnotcher_list_school": lambda spark, sf: rankings.topnotcher_list(b.schools(spark, sf), school="University 1",
                                                                         limit=500),
    "reconcile_takers": lambda spark, sf: schools.reconcile_takers(b.schools(spark, sf)),
    "rank_movement": lambda spark, sf: schools.rank_movement(b.schools(spark, sf)),
    "participation_growth": lambda spark, sf: schools.participation_growth(b.schools(spark, sf)),
    "decade_view": lambda spark, sf: schools.decade_view(b.schools(spark, sf), b.AS_OF_YEAR),
    "school_filter": lambda spark, sf: schools.school_filter(b.schools(spark, sf), rates=(60, 90), ranks=(1, 50)),
    "ranking_with_consistency": lambda spark, sf: rankings.ranking_with_consistency(b.schools(spark, sf)),
    "global_search": lambda spark, sf: search.global_search(b.schools(spark, sf), search_texts(spark, sf),
                                                            index=b.search_index(spark, sf)),
    "search_tokens": lambda spark, sf: search_texts(spark, sf).withColumn(
        "tokens", F.array_join(names.search_tokens(F.col("query")), " ")),
    "school_search_count": _school_search_count,
    "job_log": lambda spark, sf: logs.job_log(b.logs(spark, sf)),
    "audit_log": lambda spark, sf: logs.audit_log(b.logs(spark, sf)),
    "feedback_log": lambda spark, sf: logs.feedback_log(b.logs(spark, sf)),
    "check_feedback": lambda spark, sf: logs.check_feedback(b.logs(spark, sf).creator_feedback),
    "status_counts": lambda spark, sf: logs.status_counts(b.logs(spark, sf).import_jobs),
    "program_search": _program_search,
}
