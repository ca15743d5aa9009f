"""School profiles, histories, consistency, regions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import fresh_path, literal_frame, number_rows
from ..functions import cycles as cy
from ..functions import names, numbers
from ..schemas import Tables
from .national import filter_cycles, with_order, with_program
from .writes import upsert_keeping_ids


def _school_region(tables: Tables) -> DataFrame:
    """Schools with their region name; a school without region keeps a null."""
    regions = tables.regions.select(F.col("id").alias("region_id"), F.col("name").alias("region"))
    return (tables.schools.join(regions, "region_id", "left")
            .select(F.col("id").alias("school_id"), F.col("name").alias("school"), "slug", "region"))


def cycle_dimension(tables: Tables, exam_code: str | None = None, year: int | None = None,
                    month: str | None = None) -> DataFrame:
    """Cycles as the small side of joins with school rows."""
    rows = with_order(filter_cycles(with_program(tables), exam_code, year, month))
    return rows.select(F.col("id").alias("exam_result_id"), "exam_code", "exam_fullname",
                       F.col("slug").alias("exam_slug"), "year", "month", "month_no", "phase",
                       F.col("pass_rate").alias("national_rate"), F.col("program_id"))


def with_cycle_no(cycles: DataFrame) -> DataFrame:
    """Cycles with their place in time over all programs as one number, computed row by row: year, month, phase and id
    as the digits of a decimal. A plain number keeps the aggregations of school rows by latest or first cycle
    hash-based."""
    place = ((F.col("year") * 100 + F.col("month_no")) * 10 + F.col("phase")).cast("decimal(18, 0)")
    number = place * F.lit("10000000000000000000").cast("decimal(20, 0)") + F.col("exam_result_id")
    return cycles.withColumn("cycle_no", number.cast("decimal(38, 0)"))


#: Blocks of a stored directory; also the most counts that a page collects.
DIRECTORY_BLOCKS = 1024


def school_directory(tables: Tables, blocks: int = DIRECTORY_BLOCKS) -> DataFrame:
    """The schools in order of name and id, stored in at most `blocks` blocks of equal size, one partition each."""
    rows = tables.schools.select("id", "name", "slug", "school_type", "region_id")
    numbered = number_rows(rows, [], [F.asc("name"), F.asc("id")], "position")
    total = rows.count()
    block = F.floor((F.col("position") - 1) * blocks / max(total, 1)).cast("int")
    numbered = numbered.withColumn("block", block).drop("position")
    path = fresh_path(rows.sparkSession, "directory")
    numbered.repartitionByRange("block", "name", "id").write.partitionBy("block").parquet(path)
    return rows.sparkSession.read.schema(numbered.schema).parquet(path)


def school_page(tables: Tables, directory: DataFrame, search: str | None = None, region: str | None = None, page: int = 1,
                per_page: int = 20, region_mode: str = "filter") -> DataFrame:
    """The page that `school_list` gives, from a stored directory: the schools that the filters leave are counted by block,
    and only the blocks that the page lies in are read and put in order, however late it is."""
    page, per_page = max(1, page), min(100, max(1, per_page))
    rows = _listed(tables, directory, search, region, region_mode)
    counts = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}  # DIRECTORY_BLOCKS at most
    low, before, wanted, total = (page - 1) * per_page, 0, {}, sum(counts.values())
    for block in sorted(counts):
        if before + counts[block] > low and before < low + per_page:
            wanted[block] = before
        before += counts[block]
    shown = rows.where(F.col("block").isin(sorted(wanted))).orderBy("name", "id").offset(
        low - min(wanted.values(), default=low)).limit(per_page)
    return shown.select("id", "name", "slug", "school_type", "region", "region_code", F.lit(total).cast("long").alias("total"),
                        F.lit(page).alias("page"), F.lit(-(-total // per_page)).cast("int").alias("pages"))


def school_list(tables: Tables, search: str | None = None, region: str | None = None, page: int = 1,
                per_page: int = 20, region_mode: str = "filter") -> DataFrame:
    """One page of the school directory by name, with the total and the number of pages.

    `region_mode="embed"` keeps schools outside the region and only blanks the region columns.
    """
    page, per_page = max(1, page), min(100, max(1, per_page))
    rows = _listed(tables, tables.schools.select("id", "name", "slug", "school_type", "region_id"), search, region, region_mode)
    total = rows.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    shown = rows.orderBy("name", "id").offset((page - 1) * per_page).limit(per_page).withColumn("_one", F.lit(1))
    return (shown.join(total, "_one")
            .select("id", "name", "slug", "school_type", "region", "region_code", "total", F.lit(page).alias("page"),
                    F.ceil(F.col("total") / per_page).cast("int").alias("pages")))


def _listed(tables: Tables, schools: DataFrame, search: str | None, region: str | None, region_mode: str) -> DataFrame:
    """The schools of the directory that the filters leave, with their regions."""
    regions = tables.regions.select(F.col("id").alias("region_id"), F.col("name").alias("region"),
                                    F.col("code").alias("region_code"))
    how = "left"
    if region:
        regions = regions.where(F.contains(F.lower("region"), F.lit(region.lower())))
        how = "inner" if region_mode == "filter" else "left"
    rows = schools.join(regions, "region_id", how)
    if search and search.strip():
        # The directory filters by tokens only: a query without tokens does not restrict it.
        rows = rows.where(F.forall(names.search_tokens(F.lit(search)), lambda t: F.contains(F.lower("name"), t)))
    return rows


def school_history(tables: Tables, exam_code: str | None = None) -> DataFrame:
    """Every result of every school with the national rate of its cycle and the gap to it."""
    rows = tables.school_performance.select("id", "school_id", "exam_result_id", "takers", "passers", "pass_rate", "rank")
    return (rows.join(with_cycle_no(cycle_dimension(tables, exam_code)), "exam_result_id")
            .select("id", "school_id", "exam_result_id", "program_id", "exam_code", "exam_fullname", "exam_slug",
                    "month", "year", "takers", "passers", "pass_rate", "rank", "national_rate",
                    numbers.gap(F.col("pass_rate"), F.col("national_rate")).alias("gap_from_national"),
                    "month_no", "phase", "cycle_no"))


def _consistency() -> list[Column]:
    return [numbers.consistency_score(F.col("pass_rate"), F.col("national_rate")).alias("consistency_score")]


def school_summary(tables: Tables, exam_code: str | None = None) -> DataFrame:
    """Per school over all its exams: participation, mean, extremes, wins against the national rate, consistency."""
    rate = F.col("pass_rate")
    rows = school_history(tables, exam_code).groupBy("school_id").agg(
        F.count("*").alias("exams_participated"), numbers.mean_rate(rate).alias("avg_pass_rate"), *_consistency(),
        F.count_if(rate > F.col("national_rate")).alias("times_above_national"),
        F.max(rate).alias("best_pass_rate"), F.min(rate).alias("worst_pass_rate"))
    return (rows.withColumn("consistency_label", numbers.consistency_label(F.col("consistency_score")))
            .join(tables.schools.select(F.col("id").alias("school_id"), F.col("name").alias("school")), "school_id"))


def consistency_pooled(history: DataFrame) -> DataFrame:
    """Consistency of a school over all programs together."""
    rows = history.groupBy("school_id").agg(*_consistency())
    return rows.withColumn("consistency_label", numbers.consistency_label(F.col("consistency_score")))


def consistency_scores(tables: Tables) -> DataFrame:
    """Consistency per school and program, for pairs with two rates or more; ready for upsert by that key."""
    cycles = tables.exam_results.select(F.col("id").alias("exam_result_id"), "program_id",
                                        F.col("pass_rate").alias("national_rate"))
    rate = F.col("pass_rate")
    rows = (tables.school_performance.where(rate.isNotNull()).select("exam_result_id", "school_id", "pass_rate")
            .join(cycles, "exam_result_id").groupBy("school_id", "program_id")
            .agg(numbers.mean_rate(rate).alias("avg_rate"),
                 numbers.js_round(F.stddev_samp(rate), 2).alias("volatility"),
                 numbers.consistency_score(rate, F.col("national_rate")).alias("score"),
                 F.count("*").cast("int").alias("years")))
    return (rows.where("years >= 2").withColumn("label", numbers.consistency_label(F.col("score"))))


def store_consistency(tables: Tables, computed_at: str) -> Tables:
    """The next snapshot of the stored scores: those computed now replace the rows of their school and program."""
    now = consistency_scores(tables).select(
        F.lit(None).cast("long").alias("id"), "school_id", "program_id", "avg_rate", "volatility", "score", "label", "years",
        F.lit(computed_at).cast("timestamp").alias("computed_at"),
        (F.col("school_id") * 1_000_000 + F.col("program_id")).alias("arrival"))
    return replace(tables, consistency_scores=upsert_keeping_ids(
        tables.consistency_scores, now, ["school_id", "program_id"]))


def school_rank_history(history: DataFrame) -> DataFrame:
    """Best, lowest and latest rank, cycles ranked, and the latest pass rate of each school."""
    return history.groupBy("school_id").agg(
        F.min("rank").alias("best_rank"), F.max("rank").alias("lowest_rank"), F.count("rank").alias("cycles_ranked"),
        F.max_by("rank", "cycle_no").alias("latest_rank"), F.max_by("pass_rate", "cycle_no").alias("latest_pass_rate"))


def school_vs_national_series(history: DataFrame) -> DataFrame:
    """Chart points of a school against the national rate; results without a rate are left out."""
    month, year = F.col("month"), F.col("year")
    return (history.where("pass_rate IS NOT NULL")
            .select("school_id", "exam_code", cy.short_label(month, year).alias("label"),
                    cy.cycle_label(month, year).alias("full_label"), cy.axis_month(month).alias("cycle_month"),
                    cy.short_year(year).alias("cycle_year"), F.col("pass_rate").alias("school"),
                    F.col("national_rate").alias("national"), "year", "month_no", "phase"))


def school_trend(tables: Tables, exam_code: str | None = None) -> DataFrame:
    """Trend class of each school over its known rates in chronological order."""
    known = school_history(tables, exam_code)
    order = F.when(F.col("pass_rate").isNotNull(), F.col("cycle_no"))
    rows = known.groupBy("school_id").agg(
        F.count("*").alias("results"), F.count("pass_rate").alias("n"),
        F.min_by("pass_rate", order).alias("first_rate"), F.max_by("pass_rate", order).alias("last_rate"))
    return rows.select("school_id", "results", "first_rate", "last_rate",
                       numbers.trend_label(F.col("n"), F.col("first_rate"), F.col("last_rate")).alias("trend"))


def school_trend_series(tables: Tables, exam_code: str | None = None) -> DataFrame:
    """The results behind `school_trend`, each beside the class of its school."""
    classes = school_trend(tables, exam_code).select("school_id", "trend")
    rows = school_history(tables, exam_code).select(
        "school_id", "year", "month", "exam_code", F.col("pass_rate").alias("school_rate"), "national_rate", "rank")
    return rows.join(classes, "school_id")


def compare_schools(tables: Tables, ids: Iterable[int] | DataFrame, exam_code: str | None = None) -> DataFrame:
    """Histories of chosen schools (of one exam if given) beside their summaries over all exams."""
    if not isinstance(ids, DataFrame):
        ids = literal_frame(tables.schools.sparkSession, {"school_id": "long"}, [(i,) for i in ids])
    chosen = Tables(programs=tables.programs, exam_results=tables.exam_results,
                    schools=tables.schools.join(ids, tables.schools["id"] == ids["school_id"], "left_semi"),
                    school_performance=tables.school_performance.join(ids, "school_id", "left_semi"))
    history = filter_cycles(school_history(chosen), exam_code).select(
        "school_id", "exam_code", "year", "month", "takers", "passers", "pass_rate", "rank", "national_rate",
        "gap_from_national")
    summary = school_summary(chosen).select("school_id", "school", "exams_participated", "avg_pass_rate",
                                            "consistency_score", "consistency_label", "times_above_national",
                                            "best_pass_rate", "worst_pass_rate")
    return summary.join(history, "school_id", "left")


def regional_analytics(tables: Tables, exam_code: str | None = None, year: int | None = None) -> DataFrame:
    """Schools, mean rate and totals per region. Results are first summed per school, so a populous region
    sends its schools, not its results, to the final step."""
    rows = tables.school_performance.select("exam_result_id", "school_id", "takers", "passers", "pass_rate")
    if exam_code:
        rows = rows.join(cycle_dimension(tables, exam_code, year).select("exam_result_id"), "exam_result_id",
                         "left_semi")
    per_school = rows.groupBy("school_id").agg(
        numbers.rate_sum(F.col("pass_rate")).alias("rates"), F.count("pass_rate").alias("n"),
        F.sum("passers").alias("passers"), F.sum("takers").alias("takers"))
    located = (tables.schools.select(F.col("id").alias("school_id"), "region_id")
               .join(tables.regions.select(F.col("id").alias("region_id"), F.col("name").alias("region")),
                     "region_id").select("school_id", "region"))
    mean = numbers.js_round(F.sum("rates").cast("double") / F.sum("n"), 2)
    return (per_school.join(located, "school_id").groupBy("region")
            .agg(F.count("*").alias("schools"), F.when(F.sum("n") > 0, mean).alias("avg_pass_rate"),
                 F.coalesce(F.sum("passers"), F.lit(0)).alias("total_passers"),
                 F.coalesce(F.sum("takers"), F.lit(0)).alias("total_takers"))
            .orderBy(F.desc(F.coalesce("avg_pass_rate", F.lit(0.0))), "region"))


def reconcile_takers(tables: Tables) -> DataFrame:
    """Share of a cycle's national examinees that its school rows account for."""
    sums = tables.school_performance.groupBy("exam_result_id").agg(
        F.sum("takers").alias("school_takers"), F.sum("passers").alias("school_passers"))
    rows = with_program(tables).select(F.col("id").alias("exam_result_id"), "exam_code", "year", "month", "total_takers",
                                       "total_passers")
    share = numbers.js_round(F.col("school_takers") * 100.0 / F.col("total_takers"), 1)
    return (rows.join(sums, "exam_result_id", "left")
            .withColumn("school_takers", F.coalesce("school_takers", F.lit(0)))
            .withColumn("school_passers", F.coalesce("school_passers", F.lit(0)))
            .withColumn("taker_coverage_pct", F.when(F.col("total_takers") > 0, share).otherwise(0.0)))


def rank_movement(tables: Tables) -> DataFrame:
    """Change of rank of a school between consecutive cycles of the same exam; positive is an improvement."""
    previous = F.lag("rank").over(Window.partitionBy("school_id", "exam_code").orderBy("year", "month_no", "phase", "id"))
    rows = school_history(tables).where("rank IS NOT NULL").withColumn("previous_rank", previous)
    return rows.select("school_id", "exam_code", "year", "month", "rank", "previous_rank",
                       (F.col("previous_rank") - F.col("rank")).alias("movement"))


def participation_growth(tables: Tables) -> DataFrame:
    """Participating schools per cycle and the change from the previous cycle of the exam."""
    counts = tables.school_performance.groupBy("exam_result_id").agg(F.count_distinct("school_id").alias("schools"))
    order = Window.partitionBy("exam_code").orderBy("year", "month_no", "phase", "exam_result_id")
    return (cycle_dimension(tables).join(counts, "exam_result_id")
            .withColumn("growth", F.col("schools") - F.lag("schools").over(order))
            .select("exam_code", "year", "month", "schools", "growth"))


def decade_view(tables: Tables, as_of_year: int) -> DataFrame:
    """Years in which a school was ranked inside the tracker window, per exam."""
    rows = school_history(tables).where(cy.in_window(F.col("year"), as_of_year) & F.col("rank").isNotNull())
    return rows.groupBy("school_id", "exam_code").agg(
        F.size(F.collect_set("year")).alias("years_ranked"), F.min("rank").alias("best_rank"),
        numbers.mean_rate(F.col("pass_rate")).alias("avg_pass_rate"))


def school_filter(tables: Tables, province: str | None = None, rates: tuple[float, float] | None = None,
                  ranks: tuple[int, int] | None = None) -> DataFrame:
    """School results by province, pass-rate range and rank range."""
    provinces = tables.provinces.select(F.col("id").alias("province_id"), F.col("name").alias("province"))
    if province:
        provinces = provinces.where(F.lower("province") == province.lower())
    located = (tables.schools.select(F.col("id").alias("school_id"), F.col("name").alias("school"), "province_id")
               .join(provinces, "province_id"))
    rows = school_history(tables)
    if rates:
        rows = rows.where(F.col("pass_rate").between(*rates))
    if ranks:
        rows = rows.where(F.col("rank").between(*ranks))
    return rows.join(located, "school_id").select("school_id", "school", "province", "exam_code", "year", "month",
                                                  "pass_rate", "rank")
