"""Rankings, leaderboards, distributions: top-k per exam.

The rank limit is part of the plan, so each task keeps its own best k rows of an exam before the shuffle: an exam with a
third of all results costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import literal_frame, number_rows, top_per_key
from ..functions import cycles as cy
from ..functions import names, numbers
from ..schemas import Tables
from .national import filter_cycles
from .schools import _school_region, cycle_dimension, consistency_scores


def _school_rows(tables: Tables, cycles: DataFrame, min_takers: int | None = None) -> DataFrame:
    rows = tables.school_performance.select("id", "exam_result_id", "school_id", "takers", "passers", "pass_rate", "rank")
    if min_takers:
        rows = rows.where(F.col("takers") >= min_takers)
    return rows.join(cycles, "exam_result_id")


def _ranked_rows(tables: Tables, cycles: DataFrame, min_takers: int | None, limit: int | None) -> DataFrame:
    """The first `limit` school rows of each exam by published rank, all of them without a limit."""
    rows, order = _school_rows(tables, cycles, min_takers), [F.asc_nulls_last("rank"), F.asc("id")]
    best = (number_rows(rows, ["exam_code"], order, "position").withColumn("position", F.col("position").cast("int"))
            if limit is None else top_per_key(rows, ["exam_code"], order, limit, spread="id"))
    return best.join(_school_region(tables), "school_id")


def _year_cycles(tables: Tables, exam_code: str | None, year: int | None, month: str | None = None) -> DataFrame:
    """Cycles of a year, or of the newest year of each exam."""
    cycles = cycle_dimension(tables, exam_code, year)
    if not year:
        newest = cycles.groupBy("exam_code").agg(F.max("year").alias("year"))
        cycles = cycles.join(newest, ["exam_code", "year"])
    return filter_cycles(cycles, month=month)


def top_schools(tables: Tables, exam_code: str | None = None, year: int | None = None, month: str | None = None,
                limit: int | None = 20) -> DataFrame:
    """Best-ranked schools of a year (the newest with any cycle), over all cycles of that year together."""
    return (_ranked_rows(tables, _year_cycles(tables, exam_code, year, month), None, limit)
            .withColumn("gap", numbers.gap(F.col("pass_rate"), F.col("national_rate")))
            .select("exam_code", "position", "rank", "school", "school_id", "slug", "region", "takers", "passers",
                    "pass_rate", "year", "month", "national_rate", "gap"))


def rankings(tables: Tables, exam_code: str | None = None, year: int | None = None, month: str | None = None,
             region: str | None = None, school: str | None = None, min_takers: int | None = None,
             limit: int | None = 1000) -> DataFrame:
    """Published ranking rows of each exam. The limit comes before the school and region filters."""
    rows = _ranked_rows(tables, cycle_dimension(tables, exam_code, year, month), min_takers, limit)
    if school:
        rows = rows.where(names.matches_search(F.col("school"), F.lit(school)))
    if region:
        rows = rows.where(F.contains(F.lower("region"), F.lit(region.lower())))
    return rows.select("exam_code", "position", "rank", "school", "school_id", "region", "takers", "passers",
                       "pass_rate", "year", "month", "national_rate")


def aggregate_rankings(tables: Tables, exam_code: str | None = None, region: str | None = None,
                       school: str | None = None, min_takers: int | None = None, min_years: int = 1,
                       limit: int = 1000) -> DataFrame:
    """Schools of each exam over all its cycles, by passers over takers. Results are summed per year first, which leaves
    one row for each year a school took part in."""
    cycles = cycle_dimension(tables, exam_code).select("exam_result_id", "exam_code", "year")
    schools = _school_region(tables)
    if region:
        schools = schools.where(F.contains(F.lower("region"), F.lit(region.lower())))
    if school:
        schools = schools.where(names.matches_search(F.col("school"), F.lit(school)))
    rows = tables.school_performance.select("exam_result_id", "school_id", "takers", "passers", "pass_rate")
    rate = F.col("pass_rate")
    yearly = (rows.join(cycles, "exam_result_id").groupBy("exam_code", "school_id", "year")
              .agg(F.count(rate).alias("rates"), F.max(rate).alias("best"), F.min(rate).alias("worst"),
                   F.sum("takers").alias("takers"), F.sum("passers").alias("passers")))
    sums = yearly.groupBy("exam_code", "school_id").agg(
        F.sum("rates").alias("rates"), F.max("best").alias("best"), F.min("worst").alias("worst"),
        F.coalesce(F.sum("takers"), F.lit(0)).alias("total_takers"),
        F.coalesce(F.sum("passers"), F.lit(0)).alias("total_passers"),
        F.count("year").cast("int").alias("years_participated"))
    sums = sums.where((F.col("rates") > 0) & (F.col("years_participated") >= min_years))
    if min_takers:
        sums = sums.where(F.col("total_takers") >= min_takers)
    weighted = F.when(F.col("total_takers") > 0, F.floor(
        F.try_divide(F.col("total_passers"), F.col("total_takers")) * 10000.0 + F.lit(0.5)) / 100.0).otherwise(0.0)
    scored = sums.withColumn("pass_rate", weighted)
    if region or school:
        scored = scored.join(schools.select("school_id"), "school_id", "left_semi")
    best = top_per_key(scored, ["exam_code"], [F.desc("pass_rate"), F.desc("total_takers"), F.desc("total_passers"),
                                               F.asc("school_id")], limit, "rank", spread="school_id")
    return best.join(schools, "school_id").select(
        "exam_code", "rank", "school_id", "school", "slug", "region", "pass_rate",
        F.col("pass_rate").alias("avg_pass_rate"), numbers.js_round(F.col("best"), 2).alias("best_pass_rate"),
        numbers.js_round(F.col("worst"), 2).alias("worst_pass_rate"), "total_takers", "total_passers",
        "years_participated")


def program_leaderboard(tables: Tables, limit: int = 15, min_takers: int = 10) -> DataFrame:
    """Leaders of every program; one without aggregate leaders falls back to its newest year."""
    programs = tables.programs.select("exam_code", F.col("name").alias("exam_name"), F.col("id").alias("program_no"))
    whole = aggregate_rankings(tables, min_takers=min_takers).where(F.col("rank") <= limit).select(
        "exam_code", "rank", "school", "school_id", "region", "pass_rate", "total_takers", "total_passers",
        F.col("years_participated").alias("cycles"), F.lit(None).cast("string").alias("cycle_label"))
    latest = _school_rows(tables, _year_cycles(tables, None, None)).where(F.coalesce("takers", F.lit(0)) >= min_takers)
    latest = latest.join(whole.select("exam_code"), "exam_code", "left_anti").drop("rank")
    latest = top_per_key(latest, ["exam_code"], [F.desc(F.coalesce("pass_rate", F.lit(0.0))),
                                                 F.desc(F.coalesce("takers", F.lit(0))), F.asc("school_id")],
                         limit, "rank", spread="id").join(_school_region(tables), "school_id")
    fallback = latest.select(
        "exam_code", "rank", "school", "school_id", "region", "pass_rate", F.col("takers").alias("total_takers"),
        F.coalesce("passers", F.lit(0)).alias("total_passers"), F.lit(1).alias("cycles"),
        cy.cycle_label(F.col("month"), F.col("year")).alias("cycle_label"))
    return whole.unionByName(fallback).join(programs, "exam_code")


def leaderboard_flat(board: DataFrame, limit: int = 25) -> DataFrame:
    """The first leaders in program order."""
    return board.orderBy("program_no", "rank").limit(limit)


def rate_distribution(tables: Tables, exam_code: str | None = None, year: int | None = None) -> DataFrame:
    """Schools per pass-rate band of each exam's newest (or given) year; empty bands are listed with zero."""
    spark = tables.programs.sparkSession
    rows = _school_rows(tables, _year_cycles(tables, exam_code, year)).join(
        tables.schools.select(F.col("id").alias("school_id")), "school_id", "left_semi")
    bands = literal_frame(spark, {"band_no": "int", "band": "string"}, list(enumerate(numbers.RATE_BANDS, 1)))
    exams = filter_cycles(tables.programs.select("exam_code"), exam_code)
    grid = exams.withColumn("band", F.explode(F.array(*[F.lit(b) for b in numbers.RATE_BANDS])))
    counts = (rows.where("pass_rate IS NOT NULL").withColumn("band", numbers.rate_band(F.col("pass_rate")))
              .groupBy("exam_code", "band").agg(F.count("*").alias("schools")))
    return (grid.join(bands, "band").join(counts, ["exam_code", "band"], "left")
            .select("exam_code", "band_no", "band", F.coalesce("schools", F.lit(0)).alias("schools")))


def topnotcher_list(tables: Tables, exam_code: str | None = None, year: int | None = None, school: str | None = None,
                    limit: int = 50) -> DataFrame:
    """Top examinees, newest year first, then by rank."""
    cycles = cycle_dimension(tables, exam_code, year).select("exam_result_id", "exam_code", "exam_fullname", "year",
                                                             "month")
    rows = tables.topnotchers.select("id", "exam_result_id", "rank", "name", "school", "rating")
    if school:
        rows = rows.where(F.contains(F.lower("school"), F.lit(school.lower())))
    return (rows.join(cycles, "exam_result_id")
            .orderBy(F.desc("year"), F.asc_nulls_last("rank"), F.asc("id")).limit(min(limit, 200))
            .drop("exam_result_id"))


def ranking_with_consistency(tables: Tables, limit: int | None = None) -> DataFrame:
    """All ranking rows (or the first ones of each exam) with the gap to the national rate and the school's consistency label for that program."""
    labels = (consistency_scores(tables).join(tables.programs.select(F.col("id").alias("program_id"), "exam_code"),
                                              "program_id")
              .select("school_id", "exam_code", F.col("label").alias("consistency_label")))
    return (rankings(tables, limit=limit)
            .withColumn("gap", numbers.gap(F.col("pass_rate"), F.col("national_rate")))
            .join(labels, ["school_id", "exam_code"], "left")
            .withColumn("consistency_label", F.coalesce("consistency_label", F.lit("Insufficient data"))))
