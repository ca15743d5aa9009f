"""Registered queries of the quality checks."""

from __future__ import annotations

from ..operators import audit
from . import bindings as b

START, END = b.START_YEAR, b.END_YEAR


def _cycles(spark, sf):
    return audit.cycles_in_range(b.registered(spark, sf), START, END)


def _codes(spark, sf):
    return b.registered(spark, sf).programs.select("exam_code")


def _national(spark, sf):
    return audit.audit_national(b.registered(spark, sf), START, END, index=b.link_index(spark, sf))


QUERIES = {
    "check_url_year_mismatch": lambda s, sf: audit.check_url_year_mismatch(_cycles(s, sf)),
    "check_rate_mismatch": lambda s, sf: audit.check_rate_mismatch(_cycles(s, sf)),
    "check_placeholder_row": lambda s, sf: audit.check_placeholder_row(_cycles(s, sf)),
    "check_exam_content_mismatch": lambda s, sf: audit.check_exam_content_mismatch(_cycles(s, sf)),
    "check_slug_mismatch": lambda s, sf: audit.check_slug_mismatch(_cycles(s, sf)),
    "check_unexpected_month": lambda s, sf: audit.check_unexpected_month(_cycles(s, sf)),
    "check_duplicate_stats": lambda s, sf: audit.check_duplicate_stats(_cycles(s, sf)),
    "check_rate_outlier": lambda s, sf: audit.check_rate_outlier(_cycles(s, sf)),
    "check_mirror_only_program": lambda s, sf: audit.check_mirror_only_program(_cycles(s, sf), START, END),
    "check_hard_coverage_gap": lambda s, sf: audit.check_hard_coverage_gap(_codes(s, sf), _cycles(s, sf), START, END),
    "check_soft_coverage_gap": lambda s, sf: audit.check_soft_coverage_gap(_codes(s, sf), _cycles(s, sf), START, END),
    "check_index_not_ingested": lambda s, sf: audit.check_index_not_ingested(b.link_index(s, sf), b.registered(s, sf)),
    "check_dup_school_name": lambda s, sf: audit.check_dup_school_name(b.defective_schools(s, sf).schools),
    "check_dup_school_performance": lambda s, sf: audit.check_dup_school_performance(b.defective_schools(s, sf)),
    "check_exam_no_schools": lambda s, sf: audit.check_exam_no_schools(b.defective_schools(s, sf)),
    "check_perf_missing_rate": lambda s, sf: audit.check_perf_missing_rate(b.defective_schools(s, sf)),
    "check_perf_rate_out_of_range": lambda s, sf: audit.check_perf_rate_out_of_range(b.defective_schools(s, sf)),
    "check_perf_passers_gt_takers": lambda s, sf: audit.check_perf_passers_gt_takers(b.defective_schools(s, sf)),
    "audit_national": _national,
    "audit_full": lambda s, sf: audit.in_report_order(audit.audit(
        b.registered(s, sf), START, END, "full", index=b.link_index(s, sf), platform=b.defective_schools(s, sf))),
    "duplicate_performance": lambda s, sf: audit.duplicate_performance(b.defective_schools(s, sf)),
    "findings_summary": lambda s, sf: audit.findings_summary(_national(s, sf)),
    "coverage_by_program": lambda s, sf: audit.coverage_by_program(b.registered(s, sf), START, END),
    "gap_report": lambda s, sf: audit.gap_report(b.registered(s, sf), START, END),
    "missing_from_index": lambda s, sf: audit.missing_from_index(b.link_index(s, sf), b.registered(s, sf)),
    "duplicate_schools": lambda s, sf: audit.duplicate_schools(b.defective_schools(s, sf).schools),
    "duplicate_losers": lambda s, sf: audit.duplicate_losers(_cycles(s, sf)).select(
        "exam_code", "id", "month", "year", "reason"),
    "bad_rows": lambda s, sf: audit.bad_rows(b.registered(s, sf), START, END, placeholders=True, mismatches=True,
                                             duplicates=True, rate_year=True),
    "verification_report": lambda s, sf: audit.verification_report(b.defective_schools(s, sf)),
}
