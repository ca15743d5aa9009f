"""The tables of the exam warehouse. Rates are doubles so that two-decimal values survive unchanged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

COLUMNS: dict[str, str] = {
    "programs": "id long, exam_code string, name string, level string, slug string, is_active boolean, "
                "created_at timestamp",
    "regions": "id long, name string, code string",
    "provinces": "id long, region_id long, name string",
    "schools": "id long, name string, slug string, region_id long, province_id long, school_type string, "
               "created_at timestamp",
    "exam_results": "id long, program_id long, month string, year int, total_takers int, total_passers int, "
                    "pass_rate double, source_url string, scraped_at timestamp",
    "school_performance": "id long, exam_result_id long, school_id long, takers int, passers int, pass_rate double, "
                          "rank int, scraped_at timestamp",
    "topnotchers": "id long, exam_result_id long, rank int, name string, school string, rating double, "
                   "scraped_at timestamp",
    "consistency_scores": "id long, school_id long, program_id long, avg_rate double, volatility double, "
                          "score double, label string, years int, computed_at timestamp",
    "import_jobs": "id long, program_id long, year int, status string, rows_affected int, started_at timestamp, "
                   "finished_at timestamp, notes string",
    "audit_logs": "id long, actor string, action string, entity string, entity_id long, detail string, "
                  "created_at timestamp",
    "creator_feedback": "id long, name string, email string, message string, created_at timestamp",
    "national_csv": "exam_code string, month string, year string, total_passers string, total_takers string, "
                    "pass_rate string, source_url string",
    "link_index": "exam_code string, year int, month string, url string, source string, discovered_via string, "
                  "post_id long, title string",
}


@dataclass(frozen=True)
class Tables:
    """One frame per table; an operator touches only those it names."""

    programs: DataFrame | None = None
    regions: DataFrame | None = None
    provinces: DataFrame | None = None
    schools: DataFrame | None = None
    exam_results: DataFrame | None = None
    school_performance: DataFrame | None = None
    topnotchers: DataFrame | None = None
    consistency_scores: DataFrame | None = None
    import_jobs: DataFrame | None = None
    audit_logs: DataFrame | None = None
    creator_feedback: DataFrame | None = None
