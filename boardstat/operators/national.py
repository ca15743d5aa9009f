"""National series per program: summaries, histories, difficulty, popularity, comparison, catalog."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import literal_array, literal_frame, top_per_key
from ..functions import cycles as cy
from ..functions import names, numbers
from ..registry import CATEGORY_ORDER
from ..schemas import Tables


def with_program(tables: Tables) -> DataFrame:
    """Cycles with exam_code, exam_fullname and slug."""
    programs = tables.programs.select(F.col("id").alias("program_id"), "exam_code", F.col("name").alias("exam_fullname"),
                                      "slug")
    return tables.exam_results.drop("exam_code").join(programs, "program_id")


def filter_cycles(cycles: DataFrame, exam_code: str | None = None, year: int | None = None,
                  month: str | None = None) -> DataFrame:
    """Cycle resolution: code regardless of case, exact year, month as a case-insensitive part of the label."""
    if exam_code:
        cycles = cycles.where(F.upper("exam_code") == exam_code.upper())
    if year:
        cycles = cycles.where(F.col("year") == year)
    if month:
        cycles = cycles.where(F.contains(F.lower("month"), F.lit(month.lower())))
    return cycles


def newest_first() -> list[Column]:
    return [F.desc("year"), F.desc("month_no"), F.desc("phase"), F.desc("id")]


def with_order(cycles: DataFrame) -> DataFrame:
    return (cycles.withColumn("month_no", cy.month_number(F.col("month")))
            .withColumn("phase", F.coalesce(cy.phase_number(F.col("month")), F.lit(0))))


def exam_summary(tables: Tables, as_of_year: int) -> DataFrame:
    """Per program over the tracker window: cycle counts, year span, mean rate and totals of complete cycles."""
    done = numbers.complete()
    return (with_program(tables).where(cy.in_window(F.col("year"), as_of_year))
            .groupBy("exam_code", "exam_fullname", "slug")
            .agg(F.count("*").alias("total_cycles"), F.count_if(done).alias("complete_cycles"),
                 F.max("year").alias("latest_year"), F.min("year").alias("earliest_year"),
                 numbers.mean_rate(F.when(done, F.col("pass_rate"))).alias("avg_national_pass_rate"),
                 F.coalesce(F.sum(F.when(done, F.col("total_takers"))), F.lit(0)).alias("total_takers"),
                 F.coalesce(F.sum(F.when(done, F.col("total_passers"))), F.lit(0)).alias("total_passers")))


def exam_cycles(tables: Tables, exam_code: str | None = None, year: int | None = None, month: str | None = None,
                complete_only: bool = False) -> DataFrame:
    """Cycles of every (or one) exam, newest first inside an exam; the history keeps complete cycles only."""
    rows = with_order(filter_cycles(with_program(tables), exam_code, year, month))
    if complete_only:
        rows = rows.where(numbers.complete())
    return (rows.select("id", "exam_code", "exam_fullname", "slug", "year", "month", "total_takers", "total_passers",
                        "pass_rate", "source_url", "month_no", "phase")
            .orderBy("exam_code", *newest_first()))


def latest_topnotchers(tables: Tables, limit: int = 10) -> DataFrame:
    """Top examinees of the newest complete cycle of each exam."""
    cycles = with_order(with_program(tables).where(numbers.complete()))
    latest = top_per_key(cycles, ["exam_code"], newest_first(), 1).select(
        F.col("id").alias("exam_result_id"), "exam_code", "year", "month",
        cy.cycle_label(F.col("month"), F.col("year")).alias("cycle_label"))
    people = tables.topnotchers.select("id", "exam_result_id", "rank", "name", "school", "rating")
    rows = top_per_key(people.join(latest, "exam_result_id"), ["exam_code"], [F.asc_nulls_last("rank"), F.asc("id")],
                       limit)
    return rows.drop("id", "exam_result_id", "position")


def exam_difficulty(tables: Tables, as_of_year: int) -> DataFrame:
    """Mean, extremes and trend of complete windowed cycles; programs without any keep nulls."""
    rows = with_program(tables)
    order = cy.cycle_order(F.col("year"), F.col("month"), F.col("id"))
    rate = F.when(cy.in_window(F.col("year"), as_of_year) & numbers.complete(), F.col("pass_rate"))
    known = F.when(rate.isNotNull(), order)
    stats = rows.groupBy("exam_code").agg(
        numbers.mean_rate(rate).alias("avg_rate"), F.max(rate).alias("highest_rate"), F.min(rate).alias("lowest_rate"),
        F.count(rate).alias("n"), F.min_by(rate, known).alias("first"), F.max_by(rate, known).alias("last"))
    return stats.select("exam_code", "avg_rate", "highest_rate", "lowest_rate", F.col("n").alias("cycles"),
                        numbers.trend_label(F.col("n"), F.col("first"), F.col("last")).alias("trend"))


def compare_exams(tables: Tables, codes: Iterable[str] | DataFrame, as_of_year: int, recent: int = 3) -> DataFrame:
    """Side-by-side exams: latest cycle, ten-year mean, trend and the most recent complete cycles, one row each.

    `codes` is a list or a frame with an exam_code column; repeated spellings count once, unknown codes drop out.
    """
    if not isinstance(codes, DataFrame):
        codes = literal_frame(tables.programs.sparkSession, {"exam_code": "string"}, [(c,) for c in codes])
    wanted = codes.select(F.upper(F.trim("exam_code")).alias("code")).where("code <> ''").dropDuplicates()
    programs = (tables.programs.join(wanted, F.upper("exam_code") == F.col("code"), "left_semi")
                .select("exam_code", F.col("name").alias("exam_fullname"), "slug"))
    cycles = with_order(with_program(tables).where(cy.in_window(F.col("year"), as_of_year) & numbers.complete()))
    label = cy.cycle_label(F.col("month"), F.col("year"))
    newest = top_per_key(cycles, ["exam_code"], newest_first(), recent).select(
        "exam_code", F.col("position").cast("int").alias("recent_no"), label.alias("recent_label"),
        F.col("pass_rate").alias("recent_rate"), F.col("total_takers").alias("recent_takers"))
    first = newest.where("recent_no = 1").select("exam_code", F.col("recent_label").alias("latest_cycle"),
                                                 F.col("recent_rate").alias("latest_rate"))
    stats = exam_difficulty(tables, as_of_year).select("exam_code", F.col("avg_rate").alias("avg_10yr"), "trend")
    return (programs.join(stats, "exam_code", "left").join(first, "exam_code", "left")
            .join(newest, "exam_code", "left")
            .withColumn("trend", F.coalesce("trend", F.lit("Insufficient data"))))


def exam_popularity(tables: Tables, as_of_year: int) -> DataFrame:
    return (exam_summary(tables, as_of_year)
            .select("exam_code", "exam_fullname", "slug", "total_takers", F.col("total_cycles").alias("cycles"))
            .orderBy(F.desc("total_takers"), "exam_code"))


def hardest_easiest(tables: Tables, as_of_year: int, hardest: int = 5, easiest: int = 3) -> DataFrame:
    """The programs with the lowest and with the highest mean rate."""
    rated = exam_summary(tables, as_of_year).where("complete_cycles > 0 AND avg_national_pass_rate IS NOT NULL").select(
        "exam_code", names.short_exam_name(F.col("exam_fullname")).alias("short_name"), "avg_national_pass_rate")
    low = rated.orderBy("avg_national_pass_rate", "exam_code").limit(hardest).withColumn("list", F.lit("hardest"))
    high = rated.orderBy(F.desc("avg_national_pass_rate"), "exam_code").limit(easiest).withColumn(
        "list", F.lit("easiest"))
    return low.unionByName(high)


def catalog_browse(tables: Tables, as_of_year: int, category: str | None = None) -> DataFrame:
    """The program catalog by category order and name, with its statistics and shown/total counts."""
    everything = Window.partitionBy()  # the catalog is a fixed short list
    order = F.array_position(literal_array(CATEGORY_ORDER), F.col("category"))
    shown = tables.programs.withColumn("total", F.count("*").over(everything))
    if category:
        shown = shown.where(F.col("category") == category)
    shown = shown.withColumn("shown", F.count("*").over(everything))
    stats = exam_summary(tables, as_of_year).select("exam_code", "complete_cycles", "avg_national_pass_rate")
    return (shown.join(stats, "exam_code", "left")
            .select("exam_code", F.col("name").alias("exam_fullname"), "slug", "category",
                    F.when(order > 0, order - 1).otherwise(99).cast("int").alias("category_order"),
                    F.coalesce("complete_cycles", F.lit(0)).alias("complete_cycles"), "avg_national_pass_rate",
                    "shown", "total")
            .orderBy("category_order", "exam_fullname"))


def program_search(programs: DataFrame, term: str) -> DataFrame:
    """Programs whose name, code or slug contains the term."""
    low = F.lit(term.lower())
    return programs.where(F.contains(F.lower("name"), low) | F.contains(F.lower("exam_code"), low)
                          | F.contains(F.col("slug"), low))


def list_cycles(tables: Tables, start_year: int, end_year: int, exam_code: str | None = None) -> DataFrame:
    """Range scan: cycles of a program between two years, by year and alphabetical month."""
    rows = filter_cycles(with_program(tables), exam_code).where(F.col("year").between(start_year, end_year))
    return (rows.select("id", "exam_code", "month", "year", "total_takers", "total_passers", "pass_rate", "source_url")
            .orderBy("exam_code", "year", F.asc_nulls_last("month")))
