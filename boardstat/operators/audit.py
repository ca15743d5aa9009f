"""Data-quality checks. Every check returns findings of one shape; the audit is their union.

Checks of single rows are made together in one pass over the cycles and one over the school rows; the others are groupings
with partial aggregation, so a school or cycle with a third of all rows is no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import literal_array, literal_frame
from ..functions import links, numbers
from ..registry import CALENDAR, DEFAULT_MONTHS, MIRROR, OFFICIAL
from ..schemas import Tables
from .national import filter_cycles, with_program

FINDING = "check_id string, severity string, exam_code string, month string, year int, id long, detail string, " \
          "source_url string, action string"

# Severity order.
SEVERITY = ("critical", "warning", "check", "info")

# Check -> (severity, label, default action).
CHECKS: dict[str, tuple[str, str, str]] = {
    "rate_mismatch": ("critical", "National rate mismatch", "Delete or re-ingest from official source"),
    "url_year_mismatch": ("critical", "URL year ≠ stored year", "Delete row; re-ingest with correct cycle"),
    "exam_content_mismatch": ("critical", "Exam content mismatch", "Delete row; fix index and re-ingest"),
    "slug_mismatch": ("warning", "URL slug mismatch", "Verify source URL matches program; delete if wrong exam"),
    "duplicate_stats": ("warning", "Duplicate stats across cycles",
                        "Spot-check both cycles; delete duplicate if same exam mislabeled"),
    "placeholder_row": ("warning", "Placeholder row (0 takers)",
                        "Delete placeholder or re-ingest with summary stats"),
    "unexpected_month": ("info", "Unexpected exam month", "Confirm exam was held that month; fix month label if wrong"),
    "mirror_only_program": ("info", "Mirror-only program", "Prefer prc.gov.ph source when available"),
    "soft_coverage_gap": ("check", "Soft coverage gap", "Fill the gap if the exam was held"),
    "hard_coverage_gap": ("warning", "Hard coverage gap (year with no data)", "Fill the gap for this program/year"),
    "index_not_ingested": ("check", "Index not ingested", "Ingest the indexed announcement"),
    "rate_outlier": ("warning", "Pass rate outlier", "Verify against official PRC announcement"),
    "dup_school_name": ("warning", "Duplicate school name", "Merge or dedupe schools in DB manually"),
    "dup_school_performance": ("critical", "Duplicate school performance", "Delete duplicate performance row"),
    "exam_no_schools": ("info", "Exam cycle without schools", "Load school results for this cycle if data exists"),
    "perf_passers_gt_takers": ("critical", "Passers > takers (school)", "Re-scrape or fix performance row"),
    "perf_rate_out_of_range": ("critical", "Pass rate out of range (school)", "Re-scrape or fix performance row"),
    "perf_missing_rate": ("warning", "Missing pass rate (school)", "Re-scrape or recompute pass_rate"),
}


def _shaped(rows: DataFrame, check: Column, severity: Column, detail: Column, action: Column, *, exam_code="exam_code",
            month="month", year="year", row_id="id", url="source_url") -> DataFrame:
    def column(name: str | None, kind: str) -> Column:
        return F.lit(None).cast(kind) if name is None else F.col(name).cast(kind)

    return rows.select(
        check.alias("check_id"), severity.alias("severity"), column(exam_code, "string").alias("exam_code"),
        column(month, "string").alias("month"), column(year, "int").alias("year"), column(row_id, "long").alias("id"),
        detail.alias("detail"), column(url, "string").alias("source_url"), action.alias("action"))


def _findings(rows: DataFrame, check: str, detail: Column, **columns) -> DataFrame:
    severity, _, action = CHECKS[check]
    return _shaped(rows, F.lit(check), F.lit(severity), detail, F.lit(action), **columns)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def cycles_in_range(tables: Tables, start_year: int, end_year: int, program: str | None = None) -> DataFrame:
    rows = filter_cycles(with_program(tables), program).where(F.col("year").between(start_year, end_year))
    return rows.select("id", "exam_code", "month", "year", "total_takers", "total_passers", "pass_rate", "source_url")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _shell() -> Column:
    return F.coalesce(F.col("total_takers"), F.lit(0)) == 0


def _codes(tables: Tables, program: str | None = None) -> DataFrame:
    return filter_cycles(tables.programs.select("exam_code"), program)


RowCheck = tuple[str, Column, Column]


def _row_findings(rows: DataFrame, checks: list[RowCheck], **columns) -> DataFrame:
    """Findings of checks (name, condition, detail) that look at single rows, all in one pass over them."""
    found = F.array(*[F.when(condition, F.struct(
        F.lit(check).alias("check_id"), F.lit(CHECKS[check][0]).alias("severity"), detail.alias("detail"),
        F.lit(CHECKS[check][2]).alias("action"))) for check, condition, detail in checks])
    each = rows.select("*", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("_found"))
    return _shaped(each, F.col("_found.check_id"), F.col("_found.severity"), F.col("_found.detail"),
                   F.col("_found.action"), **columns)


def _url_year() -> RowCheck:
    found = links.url_year(F.col("source_url"))
    return "url_year_mismatch", found != F.col("year"), _text("url_year=", found, " != stored=", F.col("year"))


def _rate_mismatch() -> RowCheck:
    expected = numbers.pass_rate(F.coalesce(F.col("total_passers"), F.lit(0)), F.col("total_takers"))
    off = (F.col("total_takers") > 0) & F.col("pass_rate").isNotNull() & (F.abs(F.col("pass_rate") - expected) > 1.0)
    return "rate_mismatch", off, _text("stored rate ", F.col("pass_rate"), "% vs computed ", expected, "%")


def _placeholder() -> RowCheck:
    return "placeholder_row", _shell(), F.lit("total_takers=0 (list-of-passers shell; may pollute charts)")


def _content_mismatch() -> RowCheck:
    url = F.col("source_url")
    inferred = links.inferred_exam(links.exam_scores(links.inference_text(url, url)))
    other = ~_shell() & url.contains(MIRROR) & (inferred != "UNKNOWN") & (inferred != F.col("exam_code"))
    return "exam_content_mismatch", other, _text("URL/content infers ", inferred, ", stored as ", F.col("exam_code"))


def _slug_mismatch() -> RowCheck:
    url = F.col("source_url")
    owner = links.slug_owner(url)
    return ("slug_mismatch", ~_shell() & url.contains(MIRROR) & (owner != F.col("exam_code")),
            _text("URL slug matches ", owner, ", stored as ", F.col("exam_code")))


def _unexpected_month(calendar: dict[str, tuple[str, ...]]) -> RowCheck:
    code, month = F.col("exam_code"), F.col("month")
    months = links.expected_months(code, calendar)
    return ("unexpected_month", ~_shell() & (month != "") & months.isNotNull() & ~links.expected_month(code, month, calendar),
            _text(month, " not in EXAM_CYCLES (", F.array_join(months, ", "), ")"))


def check_url_year_mismatch(cycles: DataFrame) -> DataFrame:
    return _row_findings(cycles, [_url_year()])


def check_rate_mismatch(cycles: DataFrame) -> DataFrame:
    return _row_findings(cycles, [_rate_mismatch()])


def check_placeholder_row(cycles: DataFrame) -> DataFrame:
    return _row_findings(cycles, [_placeholder()])


def check_exam_content_mismatch(cycles: DataFrame) -> DataFrame:
    return _row_findings(cycles, [_content_mismatch()])


def check_slug_mismatch(cycles: DataFrame) -> DataFrame:
    return _row_findings(cycles, [_slug_mismatch()])


def check_unexpected_month(cycles: DataFrame, calendar: dict[str, tuple[str, ...]] = CALENDAR) -> DataFrame:
    return _row_findings(cycles, [_unexpected_month(calendar)])


def check_duplicate_stats(cycles: DataFrame) -> DataFrame:
    """Equal statistics on several cycles of a program; a group is bounded by the program's calendar."""
    groups = (cycles.where(numbers.complete())
              .groupBy("exam_code", "total_takers", "total_passers", numbers.js_round(F.col("pass_rate"), 2).alias("rate"))
              .agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("year", "month"))).alias("members"))
              .where("n > 1"))
    listed = F.array_join(F.transform("members", lambda m: F.concat_ws(" ", m["month"], m["year"].cast("string"))), ", ")
    return _findings(groups, "duplicate_stats",
                     _text("Same stats ", F.col("total_passers"), "/", F.col("total_takers"), " (", F.col("rate"),
                           "%) on cycles: ", listed), month=None, year=None, row_id=None, url=None)


def check_rate_outlier(cycles: DataFrame) -> DataFrame:
    """Jumps above 30 points; the reading order has months alphabetically."""
    order = Window.partitionBy("exam_code").orderBy("year", F.coalesce("month", F.lit("")), "id")
    rows = (cycles.where(numbers.complete())
            .withColumn("prior", F.lag(F.struct("pass_rate", "month", "year")).over(order))
            .withColumn("delta", F.abs(F.col("pass_rate") - F.col("prior.pass_rate"))).where("delta > 30"))
    return _findings(rows, "rate_outlier", _text(
        "Pass rate ", F.col("pass_rate"), "% vs prior ", F.col("prior.pass_rate"), "% (change ",
        numbers.js_round(F.col("delta"), 1), "pp) at ", F.col("prior.month"), " ", F.col("prior.year")))


def check_mirror_only_program(cycles: DataFrame, start_year: int, end_year: int) -> DataFrame:
    rows = (cycles.where(numbers.complete()).groupBy("exam_code")
            .agg(F.count("*").alias("n"), F.count_if(links.is_official(F.col("source_url"))).alias("official"))
            .where("official = 0"))
    return _findings(rows, "mirror_only_program",
                     _text(F.col("n"), f" cycles with stats, 0 from {OFFICIAL} ({start_year}-{end_year})"),
                     month=None, year=None, row_id=None, url=None)


def years_without_stats(codes: DataFrame, cycles: DataFrame, start_year: int, end_year: int,
                        need_rate: bool = True) -> DataFrame:
    """(exam_code, year) in range without a cycle that has statistics."""
    present = cycles.where(numbers.complete() if need_rate else F.coalesce("total_takers", F.lit(0)) > 0)
    grid = codes.withColumn("year", F.explode(F.sequence(F.lit(start_year), F.lit(end_year))))
    return grid.join(present, ["exam_code", "year"], "left_anti")


def calendar_frame(spark: SparkSession, calendar: dict[str, tuple[str, ...]] = CALENDAR) -> DataFrame:
    return literal_frame(spark, {"exam_code": "string", "months": "array<string>"}, list(calendar.items()))


def missing_cycles(codes: DataFrame, cycles: DataFrame, start_year: int, end_year: int,
                   calendar: dict[str, tuple[str, ...]] = CALENDAR) -> DataFrame:
    """Expected (exam_code, year, month) without examinees on record; uncalendared programs get the default months."""
    default = literal_array(DEFAULT_MONTHS)
    grid = (codes.join(calendar_frame(codes.sparkSession, calendar), "exam_code", "left")
            .select("exam_code", F.posexplode(F.coalesce("months", default)).alias("month_pos", "month"))
            .withColumn("year", F.explode(F.sequence(F.lit(start_year), F.lit(end_year)))))
    present = cycles.where(F.coalesce("total_takers", F.lit(0)) != 0)
    return grid.join(present, ["exam_code", "year", "month"], "left_anti").select("exam_code", "year", "month",
                                                                                  "month_pos")


def check_hard_coverage_gap(codes: DataFrame, cycles: DataFrame, start_year: int, end_year: int) -> DataFrame:
    rows = years_without_stats(codes, cycles, start_year, end_year)
    return _findings(rows, "hard_coverage_gap", _text("No national stats for any cycle in ", F.col("year")),
                     month=None, row_id=None, url=None)


def check_soft_coverage_gap(codes: DataFrame, cycles: DataFrame, start_year: int, end_year: int,
                            calendar: dict[str, tuple[str, ...]] = CALENDAR) -> DataFrame:
    rows = missing_cycles(codes, cycles, start_year, end_year, calendar)
    return _findings(rows, "soft_coverage_gap", F.lit("Expected cycle missing real stats in DB"), row_id=None, url=None)


def index_beside_cycles(index: DataFrame, tables: Tables) -> DataFrame:
    """Link rows with the stored cycle of the same program, month (null matches null) and year."""
    stored = with_program(tables).select(
        F.col("exam_code").alias("s_code"), F.col("month").alias("s_month"), F.col("year").alias("s_year"),
        F.col("id").alias("stored_id"), F.col("total_takers").alias("stored_takers"),
        F.col("pass_rate").alias("stored_rate"))
    on = ((F.col("exam_code") == F.col("s_code")) & (F.col("year") == F.col("s_year"))
          & F.col("month").eqNullSafe(F.col("s_month")))
    return index.join(stored, on, "left").drop("s_code", "s_month", "s_year")


def check_index_not_ingested(index: DataFrame, tables: Tables) -> DataFrame:
    known = index.join(tables.programs.select("exam_code"), "exam_code", "left_semi")
    rows = index_beside_cycles(known, tables).where(~numbers.complete("stored_takers", "stored_rate"))
    title = F.substring(F.coalesce("title", "url", F.lit("")), 1, 80)
    return _findings(rows, "index_not_ingested", _text("Indexed but not ingested: ", title), row_id=None, url="url")


def missing_from_index(index: DataFrame, tables: Tables) -> DataFrame:
    """Link rows whose cycle is absent or lacks takers or rate; zero takers count as present."""
    rows = index_beside_cycles(index, tables)
    return rows.where("stored_takers IS NULL OR stored_rate IS NULL").drop("stored_id", "stored_takers", "stored_rate")


def _school_key() -> Column:
    return F.lower(F.trim(F.coalesce("name", F.lit(""))))


def check_dup_school_name(schools: DataFrame) -> DataFrame:
    """One finding per repeated name; the members are listed by `duplicate_schools`, one row each."""
    rows = (schools.groupBy(_school_key().alias("key")).agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("n > 1 AND key <> ''"))
    return _findings(rows, "dup_school_name",
                     _text("'", F.col("key"), "' appears on ", F.col("n"), " school ids: ", F.col("first"), " to ",
                           F.col("last")), exam_code=None, month=None, year=None, row_id=None, url=None)


def duplicate_schools(schools: DataFrame) -> DataFrame:
    keyed = schools.select("id", "name", _school_key().alias("key")).where("key <> ''")
    repeated = keyed.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(repeated, "key").select("id", "name", "copies")


def duplicate_performance(tables: Tables) -> DataFrame:
    """All rows of school results that repeat a school in a cycle, with the number of copies."""
    key = ["exam_result_id", "school_id"]
    repeated = tables.school_performance.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
    return tables.school_performance.join(repeated, key).select("id", *key, "copies")


def _cycle_labels(tables: Tables) -> DataFrame:
    return with_program(tables).select(F.col("id").alias("exam_result_id"), "exam_code", "month", "year")


def _with_school_and_cycle(rows: DataFrame, tables: Tables) -> DataFrame:
    named = tables.schools.select(F.col("id").alias("school_id"), F.col("name").alias("school"))
    return (rows.join(_cycle_labels(tables), "exam_result_id", "left").join(named, "school_id", "left")
            .withColumn("school", F.coalesce("school", _text("id=", F.col("school_id")))))


def check_dup_school_performance(tables: Tables) -> DataFrame:
    groups = (tables.school_performance.groupBy("exam_result_id", "school_id")
              .agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("n > 1"))
    return _findings(_with_school_and_cycle(groups, tables), "dup_school_performance",
                     _text("Duplicate perf for ", F.col("school"), " in cycle (", F.col("n"), " rows, ids ",
                           F.col("first"), " to ", F.col("last"), ")"), row_id=None, url=None)


def check_exam_no_schools(tables: Tables) -> DataFrame:
    rows = (tables.exam_results.where("total_takers > 0").select(F.col("id").alias("exam_result_id"))
            .join(tables.school_performance.select("exam_result_id"), "exam_result_id", "left_anti")
            .join(_cycle_labels(tables), "exam_result_id"))
    return _findings(rows, "exam_no_schools", F.lit("National stats present but no per-school performance rows"),
                     row_id="exam_result_id", url=None)


def _missing_rate() -> RowCheck:
    return "perf_missing_rate", F.col("pass_rate").isNull(), _text("Missing pass_rate for ", F.col("school"))


def _rate_out_of_range() -> RowCheck:
    rate = F.col("pass_rate")
    return "perf_rate_out_of_range", (rate < 0) | (rate > 100), _text(F.col("school"), ": pass_rate=", rate, " out of 0-100")


def _more_passers() -> RowCheck:
    return ("perf_passers_gt_takers", F.col("passers") > F.col("takers"), _text(
        F.col("school"), ": passers (", F.col("passers"), ") > takers (", F.col("takers"), ")"))


def _performance_checks(tables: Tables, checks: list[RowCheck]) -> DataFrame:
    """Row checks of school results; only rows that some check objects to are joined with their names."""
    wrong = checks[0][1]
    for _, condition, _ in checks[1:]:
        wrong = wrong | condition
    rows = _with_school_and_cycle(tables.school_performance.where(F.coalesce(wrong, F.lit(False))), tables)
    return _row_findings(rows, checks, url=None)


def check_perf_missing_rate(tables: Tables) -> DataFrame:
    return _performance_checks(tables, [_missing_rate()])


def check_perf_rate_out_of_range(tables: Tables) -> DataFrame:
    return _performance_checks(tables, [_rate_out_of_range()])


def check_perf_passers_gt_takers(tables: Tables) -> DataFrame:
    return _performance_checks(tables, [_more_passers()])


def audit_national(tables: Tables, start_year: int, end_year: int, program: str | None = None,
                   index: DataFrame | None = None, calendar: dict[str, tuple[str, ...]] = CALENDAR) -> DataFrame:
    cycles, codes = cycles_in_range(tables, start_year, end_year, program), _codes(tables, program)
    frames = [
        _row_findings(cycles, [_url_year(), _rate_mismatch(), _placeholder(), _content_mismatch(), _slug_mismatch(),
                               _unexpected_month(calendar)]),
        check_duplicate_stats(cycles), check_rate_outlier(cycles),
        check_mirror_only_program(cycles, start_year, end_year),
        check_hard_coverage_gap(codes, cycles, start_year, end_year),
        check_soft_coverage_gap(codes, cycles, start_year, end_year, calendar)]
    if index is not None:
        frames.append(check_index_not_ingested(filter_cycles(index, program), tables))
    return _union(frames)


def audit_platform(tables: Tables) -> DataFrame:
    return _union([check_dup_school_name(tables.schools), check_dup_school_performance(tables),
                   check_exam_no_schools(tables),
                   _performance_checks(tables, [_missing_rate(), _rate_out_of_range(), _more_passers()])])


def audit(tables: Tables, start_year: int, end_year: int, scope: str = "national", program: str | None = None,
          index: DataFrame | None = None, platform: Tables | None = None,
          calendar: dict[str, tuple[str, ...]] = CALENDAR) -> DataFrame:
    """All findings of a scope; `full` adds the school checks (of `platform` when those tables are kept apart)."""
    if scope not in ("national", "full"):
        raise ValueError(f"unknown scope {scope!r}")
    findings = audit_national(tables, start_year, end_year, program, index, calendar)
    return findings.unionByName(audit_platform(platform or tables)) if scope == "full" else findings


def _severity_rank(severity: Column) -> Column:
    return F.array_position(literal_array(SEVERITY), severity)


def in_report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(_severity_rank(F.col("severity")), F.coalesce("exam_code", F.lit("")),
                            F.coalesce("year", F.lit(0)), F.coalesce("month", F.lit("")), "check_id", "id", "detail")


def findings_summary(findings: DataFrame) -> DataFrame:
    """Findings per check with the worst severity and the label, worst first."""
    labels = literal_frame(findings.sparkSession, {"check_id": "string", "label": "string"},
                           [(c, label) for c, (_, label, _) in CHECKS.items()])
    worst = F.min(_severity_rank(F.col("severity")))
    counts = findings.groupBy("check_id").agg(F.count("*").alias("findings"), worst.cast("int").alias("severity_rank"))
    return (counts.join(labels, "check_id", "left")
            .select("check_id", "label", "findings", F.element_at(literal_array(SEVERITY),
                                                                  F.col("severity_rank")).alias("highest_severity"),
                    "severity_rank").orderBy("severity_rank", "check_id"))


def coverage_by_program(tables: Tables, start_year: int, end_year: int, program: str | None = None,
                        calendar: dict[str, tuple[str, ...]] = CALENDAR) -> DataFrame:
    cycles, codes = cycles_in_range(tables, start_year, end_year, program), _codes(tables, program)
    done, url = numbers.complete(), F.col("source_url")
    counts = cycles.groupBy("exam_code").agg(
        F.count("*").alias("rows"), F.count_if(done).alias("with_stats"),
        F.min(F.when(done, F.col("year"))).alias("first"), F.max(F.when(done, F.col("year"))).alias("last"),
        F.count_if(done & links.is_official(url)).alias("official"),
        F.count_if(done & F.coalesce(url.contains(MIRROR), F.lit(False))).alias("mirror"))
    soft = missing_cycles(codes, cycles, start_year, end_year, calendar).groupBy("exam_code").agg(
        F.count("*").alias("soft_gaps"))
    hard = years_without_stats(codes, cycles, start_year, end_year).groupBy("exam_code").agg(
        F.count("*").alias("hard_gap_years"))
    joined = codes.join(counts, "exam_code", "left").join(soft, "exam_code", "left").join(hard, "exam_code", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "with_stats", "official", "mirror", "soft_gaps",
                                                       "hard_gap_years")]
    span = F.coalesce(_text(F.col("first"), "-", F.col("last")), F.lit("—"))
    return joined.select("exam_code", *zero, span.alias("year_span"))


def gap_report(tables: Tables, start_year: int, end_year: int, program: str | None = None,
               calendar: dict[str, tuple[str, ...]] = CALENDAR) -> DataFrame:
    """Hard gap years and soft gap cycles per program, as lists bounded by years times calendar months."""
    cycles, codes = cycles_in_range(tables, start_year, end_year, program), _codes(tables, program)
    counts = cycles.groupBy("exam_code").agg(F.count_if(F.col("total_takers") > 0).alias("cycles_with_stats"))
    hard = years_without_stats(codes, cycles, start_year, end_year, need_rate=False).groupBy("exam_code").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("year")), lambda y: y.cast("string")), ", ").alias(
            "hard_gap_years"))
    ordered = F.sort_array(F.collect_list(F.struct("year", "month_pos", "month")))
    soft = missing_cycles(codes, cycles, start_year, end_year, calendar).groupBy("exam_code").agg(
        F.array_join(F.transform(ordered, lambda g: F.concat_ws(" ", g["month"], g["year"].cast("string"))), ", ").alias(
            "soft_gap_cycles"))
    joined = codes.join(counts, "exam_code", "left").join(hard, "exam_code", "left").join(soft, "exam_code", "left")
    return joined.select("exam_code", F.coalesce("cycles_with_stats", F.lit(0)).alias("cycles_with_stats"),
                         F.coalesce("hard_gap_years", F.lit("")).alias("hard_gap_years"),
                         F.coalesce("soft_gap_cycles", F.lit("")).alias("soft_gap_cycles"))


def _counters(row: DataFrame, entries: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row of counts turned into report rows (section, type, count, detail)."""
    cells = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(t).alias("type"),
                               F.col(c).cast("long").alias("count"), F.lit(d).alias("detail"))
                      for s, t, c, d in entries])
    return row.select(F.inline(cells))


def verification_report(tables: Tables) -> DataFrame:
    """Eight counters over the whole platform."""
    names = tables.schools.groupBy(_school_key().alias("key")).agg(F.count("*").alias("n"))
    per_school = tables.school_performance.groupBy("exam_result_id", "school_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("pass_rate").isNull()).alias("missing"),
        F.count_if((F.col("pass_rate") < 0) | (F.col("pass_rate") > 100)).alias("range"),
        F.count_if(F.col("passers") > F.col("takers")).alias("over"))
    perf = per_school.agg(F.count_if(F.col("n") > 1).alias("dup"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
                          F.coalesce(F.sum("range"), F.lit(0)).alias("range"),
                          F.coalesce(F.sum("over"), F.lit(0)).alias("over"))
    empty = tables.exam_results.join(tables.school_performance.select(F.col("exam_result_id").alias("id")), "id",
                                     "left_anti").agg(F.count("*").alias("empty"))
    expected = F.try_divide(F.col("total_passers"), F.col("total_takers")) * 100.0
    both = (F.col("total_takers") != 0) & (F.col("total_passers") != 0)
    exams = tables.exam_results.agg(
        F.count_if(F.col("total_takers").isNull() | F.col("total_passers").isNull()).alias("totals"),
        F.count_if(both & (F.abs(expected - F.col("pass_rate")) > 1)).alias("rate"))
    return _union([
        _counters(names.agg(F.count_if(F.col("n") > 1).alias("names")),
                  [("duplicates", "Duplicate school names", "names", "Schools sharing a normalized name")]),
        _counters(perf, [
            ("duplicates", "Duplicate performance rows", "dup", "Same school in the same exam cycle"),
            ("missing", "Performance rows missing pass rate", "missing", "Null pass_rate"),
            ("validation", "Pass rate out of range", "range", "pass_rate < 0 or > 100"),
            ("validation", "Passers exceed examinees", "over", "passers > takers")]),
        _counters(empty, [("missing", "Exam cycles without schools", "empty",
                           "National stats present but no per-school rows")]),
        _counters(exams, [
            ("missing", "Exam cycles missing national totals", "totals", "Null total_takers/total_passers"),
            ("validation", "National rate mismatch", "rate", "Stored rate differs from passers/takers by >1%")])])


def duplicate_losers(cycles: DataFrame) -> DataFrame:
    """Among cycles of a program with equal statistics, all but the most trustworthy one, with the one kept."""
    key = ["exam_code", "total_takers", "total_passers", "rate"]
    rows = (cycles.where(numbers.complete()).withColumn("rate", numbers.js_round(F.col("pass_rate"), 2))
            .withColumn("score", links.keep_score(F.col("exam_code"), F.col("month"), F.col("year"), F.col("source_url"))))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc("year"), F.asc_nulls_first("month"), F.asc("id"))
    return (rows.withColumn("place", F.row_number().over(order))
            .withColumn("kept", F.first(F.struct("month", "year")).over(order)).where("place > 1")
            .withColumn("reason", _text("duplicate_stats (keeping ", F.col("kept.month"), " ", F.col("kept.year"), ")")))


def bad_rows(tables: Tables, start_year: int, end_year: int, placeholders: bool = False, mismatches: bool = False,
             duplicates: bool = False, rate_year: bool = False) -> DataFrame:
    """Cycles to delete by the chosen reasons; a cycle chosen twice keeps the first reason."""
    cycles = cycles_in_range(tables, start_year, end_year)
    keep = ["exam_code", "id", "month", "year", "source_url"]
    frames: list[DataFrame] = []

    def add(rows: DataFrame, reason: Column) -> None:
        frames.append(rows.select(*keep, reason.alias("reason"), F.lit(len(frames)).alias("seq")))

    if rate_year:
        wrong_year = check_url_year_mismatch(cycles)
        mark = F.when(F.col("source_url").contains(MIRROR), ", prcboard_wrong_year").otherwise("")
        add(wrong_year, F.concat("detail", mark))
        add(check_rate_mismatch(cycles), F.col("detail"))
    if placeholders:
        add(cycles.where(_shell()), F.lit("placeholder_row (total_takers=0)"))
    if mismatches:
        add(check_exam_content_mismatch(cycles), F.col("detail"))
    if duplicates:
        add(duplicate_losers(cycles), F.col("reason"))
    if not frames:
        return cycles.select(*keep, F.lit("").alias("reason")).limit(0)
    rows = _union(frames).withColumn("source_url", F.coalesce("source_url", F.lit("")))
    first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "seq")
