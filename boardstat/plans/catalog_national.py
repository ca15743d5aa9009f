"""Registered queries of the national series."""

from __future__ import annotations

from ..operators import national as nat
from ..operators import series as ser
from . import bindings as b


def _cycles(spark, sf):
    return ser.series(b.national(spark, sf), b.AS_OF_YEAR)


QUERIES = {
    "national_counts": lambda spark, sf: b.national_counts(spark, sf),
    "exam_summary": lambda spark, sf: nat.exam_summary(b.national(spark, sf), b.AS_OF_YEAR),
    "exam_cycles": lambda spark, sf: nat.exam_cycles(b.national(spark, sf)),
    "exam_history": lambda spark, sf: nat.exam_cycles(b.national(spark, sf), complete_only=True),
    "exam_cycles_in_month": lambda spark, sf: nat.exam_cycles(b.national(spark, sf), month="may"),
    "list_cycles": lambda spark, sf: nat.list_cycles(b.national(spark, sf), 2016, 2020),
    "exam_difficulty": lambda spark, sf: nat.exam_difficulty(b.national(spark, sf), b.AS_OF_YEAR),
    "compare_exams": lambda spark, sf: nat.compare_exams(
        b.registered(spark, sf), b.registered(spark, sf).exam_results.select("exam_code"), b.AS_OF_YEAR),
    "exam_popularity": lambda spark, sf: nat.exam_popularity(b.national(spark, sf), b.AS_OF_YEAR),
    "hardest_easiest": lambda spark, sf: nat.hardest_easiest(b.national(spark, sf), b.AS_OF_YEAR),
    "catalog_browse": lambda spark, sf: nat.catalog_browse(b.registered(spark, sf), b.AS_OF_YEAR),
    "enriched_history": lambda spark, sf: ser.enriched_history(_cycles(spark, sf)),
    "history_report": lambda spark, sf: ser.history_report(_cycles(spark, sf)),
    "highlights": lambda spark, sf: ser.highlights(_cycles(spark, sf)),
    "coverage": lambda spark, sf: ser.coverage(_cycles(spark, sf)),
    "national_totals": lambda spark, sf: ser.national_totals(_cycles(spark, sf)),
    "trend_analytics": lambda spark, sf: ser.trend_analytics(_cycles(spark, sf)),
    "volume_analytics": lambda spark, sf: ser.volume_analytics(_cycles(spark, sf)),
    "combined_analytics": lambda spark, sf: ser.combined_analytics(_cycles(spark, sf)),
    "rate_insight": lambda spark, sf: ser.rate_insight(_cycles(spark, sf)),
    "volume_insight": lambda spark, sf: ser.volume_insight(_cycles(spark, sf)),
    "combined_insight": lambda spark, sf: ser.combined_insight(_cycles(spark, sf)),
    "chart_series": lambda spark, sf: ser.chart_series(_cycles(spark, sf)),
    "headline_extremes": lambda spark, sf: ser.headline_extremes(_cycles(spark, sf)),
}
