"""Administration logs, feedback checks, sorting and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Tables

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def job_log(tables: Tables, limit: int = 25) -> DataFrame:
    """The newest import jobs with their program; jobs without one stay."""
    newest = tables.import_jobs.orderBy(F.desc_nulls_first("started_at"), F.desc("id")).limit(limit)
    programs = tables.programs.select(F.col("id").alias("program_id"), "exam_code", F.col("name").alias("exam_fullname"))
    return newest.join(programs, "program_id", "left")


def audit_log(tables: Tables, limit: int = 50) -> DataFrame:
    return tables.audit_logs.orderBy(F.desc_nulls_first("created_at"), F.desc("id")).limit(limit)


def feedback_log(tables: Tables, limit: int = 100) -> DataFrame:
    order = [F.desc_nulls_first("created_at")] if "created_at" in tables.creator_feedback.columns else []
    return tables.creator_feedback.orderBy(*order, F.desc("id")).limit(limit)


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """How a run ended, by status."""
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("rows"))


def check_feedback(messages: DataFrame) -> DataFrame:
    """Feedback as it would be stored, with the error code of what is refused.

    Name and email are trimmed and cut, blank ones become null; the message is trimmed.
    """
    message = F.trim(F.coalesce("message", F.lit("")))
    name = F.nullif(F.substring(F.trim(F.coalesce("name", F.lit(""))), 1, 120), F.lit(""))
    email = F.nullif(F.substring(F.trim(F.coalesce("email", F.lit(""))), 1, 200), F.lit(""))
    error = (F.when(~F.length(message).between(10, 4000), "bad_message")
             .when(email.isNotNull() & ~email.rlike(EMAIL), "bad_email"))
    return messages.select("id", name.alias("name"), email.alias("email"), message.alias("message"),
                           error.alias("error"), error.isNull().alias("accepted"))


def sort_order(spec: str | None, allowed: list[str], fallback: Column) -> Column:
    """Order column from a `field.dir` text checked against the allowed fields."""
    field, _, direction = (spec or "").partition(".")
    if field not in allowed:
        return fallback
    return F.desc(field) if direction == "desc" else F.asc(field)


def apply_sort(df: DataFrame, spec: str | None, allowed: list[str], fallback: Column) -> DataFrame:
    return df.orderBy(sort_order(spec, allowed, fallback))
