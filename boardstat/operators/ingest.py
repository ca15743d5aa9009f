"""From announcements to the next snapshot of national cycles: extraction, validation, precedence, gaps, placeholders."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import first_per_key, literal_array, materialize, number_rows
from ..functions import links, numbers
from ..registry import CALENDAR, DEFAULT_MONTHS, MONTHS
from ..schemas import Tables
from . import text as tx
from .audit import calendar_frame, years_without_stats
from .national import with_program
from .writes import (CYCLE_KEY, assign_ids, merge_index, placeholder_cycles, stats_error, upsert_national,
                     validate_rows)

STATS = ("total_takers", "total_passers", "pass_rate")


@dataclass(frozen=True)
class IngestResult:
    tables: Tables
    status: DataFrame
    audit: DataFrame


def read_announcements(pages: DataFrame) -> DataFrame:
    """Statistics, date and exam read from announcement pages (url, title, html beside the indexed cycle)."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("url"))
    rows = pages.withColumn("title", title).withColumn("text", tx.plain_text(F.col("html"))).drop("html")
    rows = tx.infer_exam(tx.extract_summary(rows))
    date = links.announced_date(F.col("title"), F.col("text"))
    return (rows.withColumn("_date", date)
            .withColumn("parsed_year", F.coalesce("_date.year", "year"))
            .withColumn("parsed_month", F.coalesce("_date.month", F.nullif("month", F.lit(""))))
            .withColumn("exam_score", links.score_of(F.col("scores"), F.col("exam_code")))
            .drop("_date", "text", "scores"))


def checked_announcements(pages: DataFrame, calendar: dict[str, tuple[str, ...]] = CALENDAR) -> DataFrame:
    rows = validate_rows(read_announcements(pages), calendar)
    return rows.withColumn("reason", F.when(F.col("total_takers").isNull(), "no summary stats")
                           .otherwise(F.col("reason")))


def _with_precedence(rows: DataFrame, current: DataFrame, compat: bool) -> DataFrame:
    """Adds `accepted`: would a loader reading rows in order of arrival store this one over what it then finds?

    Manual rows stay for good; official rows give way to official ones only; a mirror row replaces mirror and other
    rows; a direct mirror row only other rows; a stored placeholder never stands in the way. Decided from the first
    arrival of each source class per cycle, so no task replays the rows of a cycle.
    """
    keep_shell = F.lit(compat) & links.is_manual(F.col("source_url"))
    stored = (current.where((F.coalesce("total_takers", F.lit(0)) > 0) | keep_shell)
              .select(*CYCLE_KEY, F.lit(-1).cast("long").alias("arrival"),
                      F.when(links.is_manual(F.col("source_url")), 5)
                      .otherwise(links.stored_priority(F.coalesce("source_url", F.lit("")))).cast("int").alias("cls")))
    # Source classes: 5 manual, 3 official, 2 mirror, 1 direct mirror, 0 other.
    rows = rows.withColumn("cls", links.source_priority(F.col("source")).cast("int"))
    seen = stored.unionByName(rows.select(*CYCLE_KEY, "arrival", "cls"))
    at, cls = F.col("arrival"), F.col("cls")
    firsts = seen.groupBy(*CYCLE_KEY).agg(
        F.min(F.when(cls == 5, at)).alias("manual_at"), F.min(F.when(cls == 3, at)).alias("official_at"),
        F.min(F.when(cls.isin(1, 2), at)).alias("mirror_at"))
    on = ((rows["program_id"] == firsts["program_id"]) & rows["month"].eqNullSafe(firsts["month"])
          & (rows["year"] == firsts["year"]))
    joined = rows.join(firsts, on).select("manual_at", "official_at", "mirror_at", *[rows[c] for c in rows.columns])

    def before(name: str) -> Column:
        return F.coalesce(F.col(name) < F.col("arrival"), F.lit(False))

    frozen = F.when(F.coalesce(F.col("manual_at") < F.col("official_at"), F.col("manual_at").isNotNull()),
                    F.col("manual_at"))
    open_ = ~F.coalesce(frozen < F.col("arrival"), F.lit(False))
    rule = (F.when(F.col("cls") == 5, F.coalesce(frozen == F.col("arrival"), F.lit(False)))
            .when(F.col("cls") == 3, True)
            .when(F.col("cls") == 2, ~before("official_at"))
            .when(F.col("cls") == 1, ~before("official_at") & (F.col("mirror_at") == F.col("arrival")))
            .otherwise(~before("official_at") & ~before("mirror_at")))
    return joined.withColumn("accepted", open_ & rule).drop("cls", "manual_at", "official_at", "mirror_at")


def ingest_announcements(pages: DataFrame, tables: Tables, compat: bool = False,
                         mode: str = "national_index") -> IngestResult:
    """Announcement pages into the cycles: next tables, one status row per page, audit rows of what was saved.

    `pages` has exam_code, year, month, url, source, title, html and a unique `arrival`.
    """
    # Read once, used for the next tables, the status rows and the audit rows alike.
    checked = materialize(checked_announcements(pages), "checked")
    programs = tables.programs.select(F.col("id").alias("program_id"), "exam_code")
    valid = (checked.where("reason IS NULL").join(programs, "exam_code")
             .select("program_id", F.col("final_month").alias("month"), "year", "exam_code", "url", "source", *STATS,
                     "arrival"))
    decided = materialize(_with_precedence(valid, tables.exam_results, compat), "decided")
    accepted = decided.where("accepted")
    row = F.struct(*STATS, F.col("url").alias("source_url"))
    last = accepted.groupBy(*CYCLE_KEY).agg(F.max_by(row, "arrival").alias("row"), F.min("arrival").alias("arrival"))
    incoming = last.select(*CYCLE_KEY, *[F.col(f"row.{c}").alias(c) for c in (*STATS, "source_url")], "arrival")
    # Precedence is settled above: what was accepted replaces the stored row.
    cycles = upsert_national(tables.exam_results, incoming, force=True)
    text = F.concat(numbers.grouped_text(F.col("total_passers")), F.lit("/"), numbers.grouped_text(F.col("total_takers")),
                    F.lit(" ("), F.col("pass_rate").cast("string"), F.lit("%) "), F.col("month"), F.lit(" "),
                    F.col("year").cast("string"), F.lit(" ["), F.col("source"), F.lit("]"))
    taken = decided.select("arrival", "exam_code", "year", "month",
                           F.when(F.col("accepted"), "saved").otherwise("skipped").alias("status"),
                           F.when(F.col("accepted"), text).otherwise("existing official row (no overwrite)")
                           .alias("detail"))
    refused = checked.where("reason IS NOT NULL").select(
        "arrival", "exam_code", "year", "month", F.lit("skipped").alias("status"), F.col("reason").alias("detail"))
    audit = accepted.select(
        F.lit("scraper").alias("actor"), F.lit("import").alias("action"), F.lit("exam_results").alias("entity"),
        F.to_json(F.struct("exam_code", "year", "month", "source", F.lit(mode).alias("mode"))).alias("detail"), "arrival")
    return IngestResult(replace(tables, exam_results=cycles), taken.unionByName(refused), audit)


def append_log(current: DataFrame, rows: DataFrame, order: str = "arrival") -> DataFrame:
    """A log table with new rows under the next ids, in a given order."""
    old = current.withColumn(order, F.lit(-1).cast("long"))
    new = rows.withColumn("id", F.lit(None).cast("long")).withColumn(order, F.col(order).cast("long"))
    return assign_ids(old.unionByName(new, allowMissingColumns=True), order)


def job_log_rows(index_rows: DataFrame, status: DataFrame) -> DataFrame:
    """Index rows in file order with consecutive line numbers and the status each one got."""
    numbered = number_rows(index_rows.select("arrival", "exam_code", "year"), [], [F.asc("arrival")], "line_no")
    return numbered.join(status.select("arrival", "status"), "arrival", "left")


def gap_candidates(tables: Tables, candidates: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Links for program years without any examinees on record, the strongest source per cycle."""
    gaps = years_without_stats(tables.programs.select("exam_code"), with_program(tables), start_year, end_year,
                               need_rate=False)
    wanted = candidates.join(gaps, ["exam_code", "year"], "left_semi")
    return merge_index(wanted.limit(0), wanted).orderBy("exam_code", "year", F.asc_nulls_first("month"))


def reingest_placeholders(tables: Tables, pages: DataFrame) -> IngestResult:
    """Placeholder cycles filled from announcements of the same cycle; a dual announcement fills both teacher exams."""
    programs = tables.programs.select(F.col("id").alias("program_id"), "exam_code")
    shells = placeholder_cycles(with_program(tables)).select("exam_code", "year", "month")
    wanted = ["exam_code", "year", "month"]
    dual = (tx.extract_dual(pages.withColumn("text", tx.plain_text(F.col("html"))))
            .join(shells, wanted, "left_semi").withColumn("reason", _stats_reason()))
    single = (checked_announcements(pages.join(shells, wanted, "left_semi"))
              .join(dual.select("exam_code", "year", "month"), wanted, "left_anti")
              .withColumn("month", F.coalesce("final_month", "month")))
    columns = ["arrival", "exam_code", "year", "month", "url", "source", *STATS, "reason"]
    rows = materialize(dual.select(*columns).unionByName(single.select(*columns)), "refilled")
    good = first_per_key(rows.where("reason IS NULL"), wanted, [F.asc("arrival"), F.asc("url")])
    incoming = good.join(programs, "exam_code").select(*CYCLE_KEY, *STATS, F.col("url").alias("source_url"), "arrival")
    # Two programs may come from one page and so share its arrival; the keys of the cycles settle the order of their ids.
    cycles = upsert_national(tables.exam_results, incoming)
    status = rows.select("arrival", "exam_code", "year", "month",
                         F.when(F.col("reason").isNull(), "saved").otherwise("skipped").alias("status"),
                         F.coalesce("reason", F.lit("filled placeholder")).alias("detail"))
    audit = good.select(F.lit("scraper").alias("actor"), F.lit("import").alias("action"),
                        F.lit("exam_results").alias("entity"), F.to_json(F.struct(
                            "exam_code", "year", "month", F.col("url").alias("source_url"))).alias("detail"), "arrival")
    return IngestResult(replace(tables, exam_results=cycles), status, audit)


def _stats_reason() -> Column:
    return stats_error(F.col("total_takers"), F.col("total_passers"), F.col("pass_rate"))


def missing_dual_cycles(tables: Tables, start_year: int, end_year: int) -> DataFrame:
    """Teacher-exam cycles of the calendar for which either program has no examinees on record."""
    codes = tables.programs.select("exam_code").where(F.col("exam_code").isin("LET-E", "LET-S"))
    grid = (codes.withColumn("month", F.explode(literal_array(CALENDAR["LET-E"])))
            .withColumn("year", F.explode(F.sequence(F.lit(start_year), F.lit(end_year)))))
    present = with_program(tables).where(F.coalesce("total_takers", F.lit(0)) > 0)
    return grid.join(present, ["exam_code", "year", "month"], "left_anti").select("year", "month").distinct()


def probe_grid(programs: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Every address at which a mirror may keep a result list, in order of preference per program and year:
    months of the calendar first, then the others; the long form of an address before the short one."""
    default = literal_array(DEFAULT_MONTHS)
    months = F.coalesce("months", default)
    ordered = F.concat(months, F.filter(literal_array(MONTHS), lambda m: ~F.array_contains(months, m)))
    grid = (programs.select("exam_code", "name", "site_slug")
            .join(calendar_frame(programs.sparkSession), "exam_code", "left")
            .select("exam_code", "name", "site_slug", F.posexplode(ordered).alias("month_pos", "month"))
            .withColumn("year", F.explode(F.sequence(F.lit(start_year), F.lit(end_year)))))
    urls = links.direct_result_urls(F.col("site_slug"), F.col("name"), F.col("month"), F.col("year"))
    return grid.select("exam_code", "year", "month", "month_pos", F.posexplode(urls).alias("url_pos", "url"))


def pick_direct_links(programs: DataFrame, probes: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """One direct link per program and year: the most preferred probed address (url, status, title) that answered and
    belongs to the program."""
    answered = probes.where("status = 200").select("url", "title")
    scores = links.exam_scores(links.inference_text(F.col("url"), F.col("title")))
    hits = (probe_grid(programs, start_year, end_year).join(answered, "url")
            .where(links.inferred_exam(scores) == F.col("exam_code")))
    order = Window.partitionBy("exam_code", "year").orderBy("month_pos", "url_pos", "title")  # at most 24 addresses
    return (hits.withColumn("_n", F.row_number().over(order)).where("_n = 1")
            .select("exam_code", "year", "month", "url", F.lit("prcboard.com/direct").alias("source"),
                    F.lit("direct_url").alias("discovered_via"), "title"))
