"""Validation, precedence and snapshot upserts.

A Parquet table is a snapshot: an upsert reads the current rows, unites them with the incoming ones and gives the next
snapshot. What a row-at-a-time loader would decide in arrival order is expressed as aggregates over arrival positions,
so a key with a third of all incoming rows is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import materialize, number_rows, top_per_key
from ..functions import links, names, numbers
from ..registry import CALENDAR, SCHOOL_CSV_TAG
from ..schemas import Tables

CYCLE_KEY = ("program_id", "month", "year")


def stats_error(takers: Column, passers: Column, rate: Column) -> Column:
    """First reason why national statistics are refused; null when they are sound."""
    takers_, passers_ = F.coalesce(takers, F.lit(0)), F.coalesce(passers, F.lit(0))
    expected = numbers.pass_rate(passers_, F.nullif(takers_, F.lit(0)))
    return (F.when(takers_ <= 0, "total_takers <= 0")
            .when(passers_ > takers_, "passers > takers")
            .when(rate.isNull(), "missing pass_rate")
            .when(F.abs(rate - expected) > 1.0, F.concat(
                F.lit("pass_rate mismatch ("), rate.cast("string"), F.lit(" vs "), expected.cast("string"), F.lit(")"))))


def validate_rows(candidates: DataFrame, calendar: dict[str, tuple[str, ...]] = CALENDAR) -> DataFrame:
    """Ordered checks of extracted announcements; adds final_month and the first reason of refusal.

    Reads exam_code, year, month, title, url, parsed_year, parsed_month, parsed_exam, exam_score and the statistics.
    """
    code, title = F.col("exam_code"), F.col("title")
    month = F.coalesce("parsed_month", F.nullif("month", F.lit("")), links.calendar_month(
        code, F.concat_ws(" ", "title", "url"), calendar))
    no_stats = F.col("total_takers").isNull() & F.col("total_passers").isNull() & F.col("pass_rate").isNull()
    reason = (
        F.when(links.excluded_title(title), "excluded title pattern")
        .when(~links.title_fits(code, title), "program-specific title rules failed")
        .when(F.col("parsed_year").isNull(), "no parsed year")
        .when(F.col("parsed_year") != F.col("year"), F.concat(
            F.lit("year mismatch (parsed="), F.col("parsed_year").cast("string"), F.lit(", index="),
            F.col("year").cast("string"), F.lit(")")))
        .when((F.col("exam_score") < 5) | (F.col("parsed_exam") != code), F.concat(
            F.lit("exam mismatch (parsed="), "parsed_exam", F.lit(", index="), code, F.lit(")")))
        .when(F.col("final_month").isNull(), "month not present or inferable")
        .when(no_stats, "no summary stats")
        .otherwise(stats_error(F.col("total_takers"), F.col("total_passers"), F.col("pass_rate"))))
    return candidates.withColumn("final_month", month).withColumn("reason", reason)


def should_overwrite(existing_url: Column, new_source: Column) -> Column:
    """May a row of a source replace a stored one? Manual rows stay; official rows give way to official ones only."""
    official_guard = links.is_official(existing_url) & ~links.is_official(new_source)
    return (F.when(F.coalesce(existing_url, F.lit("")) == "", True)
            .when(links.is_manual(existing_url) | official_guard, False)
            .otherwise(links.source_priority(new_source) >= links.stored_priority(existing_url)))


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], mode: str = "update",
           arrival: str = "arrival") -> DataFrame:
    """Next snapshot by key (nulls match): `update` takes the last arrival, `ignore` keeps the first row there is."""
    if mode not in ("update", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    both = (current.withColumn(arrival, F.lit(-1).cast("long"))
            .unionByName(incoming.withColumn(arrival, F.col(arrival).cast("long")), allowMissingColumns=True))
    order = F.desc(arrival) if mode == "update" else F.asc(arrival)
    return top_per_key(both, keys, [order], 1).drop("position", arrival)


def _row(columns: Sequence[str]) -> Column:
    return F.struct(*columns)


def upsert_national(current: DataFrame, incoming: DataFrame, force: bool = False, compat: bool = False) -> DataFrame:
    """Next snapshot of national cycles under the loader's guards.

    Arrivals of one key, in order: a manual row with statistics stays for good, a placeholder never replaces
    statistics, otherwise the last row wins. A manual placeholder yields to statistics unless `compat` is set.
    `incoming` has the cycle columns and an `arrival` that is unique per key; new cycles get the next free ids in order of arrival.
    """
    columns = ["total_takers", "total_passers", "pass_rate", "source_url"]
    old = current.select(*CYCLE_KEY, "id", *columns, F.lit(-1).cast("long").alias("arrival"))
    new = incoming.select(*CYCLE_KEY, F.lit(None).cast("long").alias("id"), *columns, F.col("arrival").cast("long"))
    real = F.coalesce("total_takers", F.lit(0)) > 0
    manual = links.is_manual(F.col("source_url"))
    row, at = _row([*columns, "arrival"]), F.col("arrival")
    picked = old.unionByName(new).groupBy(*CYCLE_KEY).agg(
        F.max("id").alias("id"), F.min(F.when(at >= 0, at)).alias("first_arrival"),
        F.max_by(row, at).alias("last"),
        F.max_by(row, F.when(real, at)).alias("last_real"), F.min(F.when(real, at)).alias("first_real"),
        F.min_by(row, F.when(real & manual, at)).alias("manual_real"),
        F.min_by(row, F.when(~real & manual, at)).alias("manual_shell"))
    shell_first = F.col("manual_shell").isNotNull() & (
        F.col("first_real").isNull() | (F.lit(compat) & (F.col("manual_shell.arrival") < F.col("first_real"))))
    chosen = F.col("last") if force else (
        F.when(shell_first, F.col("manual_shell"))
        .otherwise(F.coalesce("manual_real", "last_real", "last")))
    rows = picked.select(*CYCLE_KEY, "id", "first_arrival", chosen.alias("row")).select(
        *CYCLE_KEY, "id", "first_arrival", *[F.col(f"row.{c}").alias(c) for c in columns])
    return assign_ids(rows, "first_arrival", CYCLE_KEY)


def assign_ids(rows: DataFrame, order: str, ties: Sequence[str] = ()) -> DataFrame:
    """Rows without id get the numbers after the greatest one, in a given order; the order column is dropped.

    The rows are stored first: the known ones, the greatest id and the new ones are then read from that table instead of
    computing the rows three times. `ties` settle equal places in the order.
    """
    columns = [c for c in rows.columns if c != order]
    rows = materialize(rows, "grouped")
    known = rows.where("id IS NOT NULL")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).withColumn("_one", F.lit(1))
    fresh = number_rows(rows.where("id IS NULL"), [], [F.asc(order), *map(F.asc, ties)], "n").withColumn("_one", F.lit(1))
    numbered = fresh.join(top, "_one").withColumn("id", F.col("top") + F.col("n"))
    return known.select(*columns).unionByName(numbered.select(*columns))


def placeholder_cycles(cycles: DataFrame) -> DataFrame:
    """Shell rows without examinees."""
    return cycles.where(F.coalesce("total_takers", F.lit(0)) <= 0)


# ── schools ──────────────────────────────────────────────────────────────────────────────────────────────────────────

def region_ids(regions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(region_text, region_id): exact code or name first, else the first region that contains the text."""
    asked = wanted.select("region_text").where("region_text IS NOT NULL").distinct()
    text = F.lower("region_text")
    # The regions are a short list: matched as one row of it, so texts are not paired with regions across tasks.
    listed = regions.agg(F.sort_array(F.collect_list(F.struct("id", "name", "code"))).alias("regions"))

    def first(test) -> Column:
        return F.get(F.filter("regions", test), F.lit(0))["id"]

    keyed = asked.withColumn("_one", F.lit(1)).join(listed.withColumn("_one", F.lit(1)), "_one")
    return keyed.select("region_text", F.coalesce(
        first(lambda r: (F.lower(r["code"]) == text) | (F.lower(r["name"]) == text)),
        first(lambda r: F.contains(F.lower(r["code"]), text) | F.contains(F.lower(r["name"]), text))).alias("region_id"))


def resolve_schools(schools: DataFrame, regions: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Find or create the schools of incoming rows (school, region, arrival).

    Returns (next school dimension, map of clean_name to school_id). A name is found as it is, else by its slug; unknown
    spellings that share a slug become one school, named as the earliest of them.
    """
    clean = names.normalize_school(F.col("school"))
    named = (rows.withColumn("clean_name", clean).where("clean_name <> ''")
             .groupBy("clean_name").agg(F.min("arrival").alias("arrival"), F.min_by("region", "arrival").alias("region")))
    named = named.withColumn("slug", names.slugify(F.col("clean_name")))
    by_name = schools.groupBy(F.col("name").alias("clean_name")).agg(F.min("id").alias("name_id"))
    by_slug = schools.groupBy("slug").agg(F.min("id").alias("slug_id"))
    # One row per spelling, read twice below.
    matched = materialize(named.join(by_name, "clean_name", "left").join(by_slug, "slug", "left")
                          .withColumn("id", F.coalesce("name_id", "slug_id")), "spellings")
    unknown = matched.where("id IS NULL").groupBy("slug").agg(
        F.min("arrival").alias("arrival"), F.min_by("clean_name", "arrival").alias("name"),
        F.min_by("region", "arrival").alias("region_text"))
    placed = unknown.join(region_ids(regions, unknown), "region_text", "left").select(
        F.lit(None).cast("long").alias("id"), "name", "slug", "region_id", "arrival")
    known = schools.withColumn("arrival", F.lit(-1).cast("long"))
    dimension = assign_ids(known.unionByName(placed, allowMissingColumns=True), "arrival")
    by_new_slug = dimension.groupBy("slug").agg(F.min("id").alias("new_id"))
    mapping = (matched.join(by_new_slug, "slug", "left")
               .select("clean_name", F.coalesce("id", "new_id").alias("school_id")))
    return dimension, mapping


def school_row_error(rows: DataFrame) -> Column:
    """Reason why a parsed school row is left out; null when it is kept."""
    takers, passers = numbers.to_int(F.col("takers").cast("string")), numbers.to_int(F.col("passers").cast("string"))
    name = F.trim(F.coalesce("school", F.lit("")))
    return (F.when(name == "", "skipped empty school name")
            .when(takers.isNull() | passers.isNull(), F.concat(F.lit("skipped invalid numbers: "), name))
            .when((passers > takers) | (takers <= 0), F.concat(F.lit("skipped passers>takers: "), name)))


def check_school_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reject_reason", school_row_error(rows))


def upsert_school_rows(tables: Tables, rows: DataFrame) -> Tables:
    """School results by (cycle, school), last row wins; unknown schools are created.

    `rows` has exam_result_id, school, region, takers, passers, pass_rate, rank as report text, and arrival.
    """
    dimension, mapping = resolve_schools(tables.schools, tables.regions, rows)
    text = {c: F.col(c).cast("string") for c in ("takers", "passers", "pass_rate", "rank")}
    # Texts are read before the rows move to their schools.
    coded = rows.select(
        names.normalize_school(F.col("school")).alias("clean_name"), "exam_result_id",
        numbers.to_int(text["takers"]).alias("takers"), numbers.to_int(text["passers"]).alias("passers"),
        numbers.to_rate(text["pass_rate"]).alias("pass_rate"), numbers.to_int(text["rank"]).alias("rank"), "arrival")
    incoming = coded.join(mapping, "clean_name").select(
        F.lit(None).cast("long").alias("id"), "exam_result_id", "school_id", "takers", "passers", "pass_rate", "rank",
        "arrival")
    return replace(tables, schools=dimension, school_performance=upsert_keeping_ids(
        tables.school_performance, incoming, ["exam_result_id", "school_id"]))


def upsert_keeping_ids(current: DataFrame, incoming: DataFrame, keys: Sequence[str],
                       mode: str = "update") -> DataFrame:
    """`upsert` for tables with ids: a key keeps the id it has, a new one gets the next free id."""
    columns = [c for c in incoming.columns if c not in ("arrival", "id", *keys)]
    both = current.select(*keys, "id", *columns, F.lit(-1).cast("long").alias("arrival")).unionByName(
        incoming.select(*keys, F.lit(None).cast("long").alias("id"), *columns, F.col("arrival").cast("long")))
    pick = F.max_by if mode == "update" else F.min_by
    rows = both.groupBy(*keys).agg(
        F.max("id").alias("id"), F.min(F.when(F.col("arrival") >= 0, F.col("arrival"))).alias("first_arrival"),
        pick(_row(columns), F.col("arrival")).alias("row"))
    rows = rows.select(*keys, "id", "first_arrival", *[F.col(f"row.{c}").alias(c) for c in columns])
    return assign_ids(rows, "first_arrival")


def upsert_topnotchers(tables: Tables, rows: DataFrame) -> Tables:
    """Top examinees by (cycle, rank): the first ten incoming rows of a cycle, last one per rank wins."""
    first_ten = top_per_key(rows, ["exam_result_id"], [F.asc("arrival")], 10).select(
        F.lit(None).cast("long").alias("id"), "exam_result_id", "rank", "name", "school", "rating", "arrival")
    return replace(tables, topnotchers=upsert_keeping_ids(tables.topnotchers, first_ten, ["exam_result_id", "rank"]))


def delete_cycles(tables: Tables, doomed: DataFrame, dry_run: bool = False) -> tuple[Tables, DataFrame]:
    """Remove cycles (id, exam_code, reason, source_url) with their school rows and top examinees; audit rows beside."""
    detail = F.to_json(F.struct("exam_code", F.array("reason").alias("reasons"), "source_url"))
    trail = doomed.select(F.lit("scraper").alias("actor"), F.lit("delete").alias("action"),
                          F.lit("exam_results").alias("entity"), F.col("id").alias("entity_id"), detail.alias("detail"))
    if dry_run:
        return tables, trail
    ids = doomed.select("id").distinct()
    children = ids.withColumnRenamed("id", "exam_result_id")

    def without(frame: DataFrame | None) -> DataFrame | None:
        return None if frame is None else frame.join(children, "exam_result_id", "left_anti")

    return replace(tables, exam_results=tables.exam_results.join(ids, "id", "left_anti"),
                   school_performance=without(tables.school_performance),
                   topnotchers=without(tables.topnotchers)), trail


def program_cycles(tables: Tables, exam_code: str) -> DataFrame:
    """All cycles of a program, ready for `delete_cycles`."""
    code = tables.programs.where(F.upper("exam_code") == exam_code.upper()).select(
        F.col("id").alias("program_id"), F.col("exam_code"))
    return tables.exam_results.drop("exam_code").join(code, "program_id").select(
        "id", "exam_code", F.lit("program cleanup").alias("reason"), "source_url")


# ── link index and import jobs ───────────────────────────────────────────────────────────────────────────────────────

def merge_index(existing: DataFrame, incoming: DataFrame, arrival: str = "post_id",
                keep_blank_months: bool = True) -> DataFrame:
    """One link per (exam, month, year): only a strictly stronger source replaces; equal ones keep the earlier row."""
    if not keep_blank_months:
        incoming = incoming.where(F.coalesce("month", F.lit("")) != "")
    both = existing.withColumn("seq", F.lit(0)).unionByName(incoming.withColumn("seq", F.lit(1)))
    # What is stored comes first; incoming rows of equal rank count in order of discovery.
    order = [F.desc(links.source_priority(F.col("source"))), F.asc("seq"), F.asc_nulls_first(arrival), F.asc("url")]
    return top_per_key(both, ["exam_code", "month", "year"], order, 1).drop("seq", "position")


def fill_ranks(rows: DataFrame, group: str = "doc_id", line: str = "line_no") -> DataFrame:
    """Missing or zero ranks become the position of the row in its document, however long the document."""
    placed = number_rows(rows, [group], [F.asc(line), F.asc("arrival")], "_place")
    return placed.withColumn("rank", F.coalesce(F.nullif("rank", F.lit(0)), F.col("_place").cast("int"))).drop("_place")


def import_job_islands(rows: DataFrame, block: int = 100_000) -> DataFrame:
    """Import jobs: a new one whenever (exam_code, year) changes along the input; rows and rows saved of each.

    `rows` has line_no (consecutive numbers), exam_code, year, status. The predecessor of a line is found by its number,
    and starts are counted per block of lines first and then per block of blocks, so no task sees the whole input.
    """
    prior = rows.select((F.col("line_no") + 1).alias("line_no"), F.col("exam_code").alias("prior_code"),
                        F.col("year").alias("prior_year"))
    same = F.col("prior_code").eqNullSafe(F.col("exam_code")) & F.col("prior_year").eqNullSafe(F.col("year"))
    marked = (rows.join(prior, "line_no", "left").withColumn("start", F.when(same, 0).otherwise(1))
              .withColumn("block", F.floor(F.col("line_no") / block)))
    starts = marked.groupBy("block", F.floor(F.col("block") / block).alias("part")).agg(F.sum("start").alias("starts"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per block of blocks
    parts = starts.groupBy("part").agg(F.sum("starts").alias("starts")).select(
        "part", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("_before"))
    offsets = starts.join(parts, "part").select(
        "block", (F.col("_before") + F.coalesce(F.sum(starts["starts"]).over(before), F.lit(0))).alias("offset"))
    inside = Window.partitionBy("block").orderBy("line_no")
    jobs = (marked.join(offsets, "block")
            .withColumn("job_no", F.col("offset") + F.sum("start").over(inside)))
    return jobs.groupBy("job_no", "exam_code", "year").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("rows"),
        F.count_if(F.col("status") == "saved").alias("rows_affected"))


def finish_jobs(jobs: DataFrame, tables: Tables, started_at: str, finished_at: str) -> DataFrame:
    """Import-job rows for the log of one run, with the program resolved: `failed` without any saved row or program,
    `partial` if rows were left out, else `success`; the notes say how many rows were saved."""
    programs = tables.programs.select(F.col("id").alias("program_id"), "exam_code")
    saved, total = F.col("rows_affected"), F.col("rows")
    status = (F.when((saved == 0) | F.col("program_id").isNull(), "failed").when(saved < total, "partial")
              .otherwise("success"))
    return jobs.join(programs, "exam_code", "left").select(
        F.col("job_no").alias("id"), "program_id", "year", status.alias("status"),
        saved.cast("int").alias("rows_affected"), F.lit(started_at).cast("timestamp").alias("started_at"),
        F.lit(finished_at).cast("timestamp").alias("finished_at"),
        F.concat(saved.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" rows saved")).alias("notes"))


def saved_counts(rows: DataFrame) -> DataFrame:
    """Per cycle, how many incoming school rows are saved and how many fail for want of a school name."""
    known = F.coalesce(names.normalize_school(F.col("school")), F.lit("")) != ""
    return rows.groupBy("exam_result_id").agg(F.count_if(known).alias("saved"), F.count_if(~known).alias("failed"))


def ingest_school_rows(tables: Tables, rows: DataFrame) -> tuple[Tables, DataFrame]:
    """School files into the warehouse: check rows, fill ranks, open missing cycles as placeholders, upsert.

    `rows` has doc_id (file), program_id, month, year, line_no, school, region, takers, passers, pass_rate, rank and a
    unique arrival. National statistics already stored are never replaced. Returns the next tables and one status row
    per file.
    """
    checked = check_school_rows(rows)
    good = fill_ranks(checked.where("reject_reason IS NULL").withColumn("rank", F.col("rank").cast("int")))
    shells = good.groupBy(*CYCLE_KEY).agg(F.min("arrival").alias("arrival")).select(
        *CYCLE_KEY, F.lit(0).alias("total_takers"), F.lit(0).alias("total_passers"), F.lit(0.0).alias("pass_rate"),
        F.lit(SCHOOL_CSV_TAG).alias("source_url"), "arrival")
    stored = tables.exam_results.select(*CYCLE_KEY).withColumn("_stored", F.lit(True))
    absent = shells.join(stored, (shells["program_id"] == stored["program_id"])
                         & shells["month"].eqNullSafe(stored["month"]) & (shells["year"] == stored["year"]), "left_anti")
    cycles = upsert_national(tables.exam_results, absent)
    ids = cycles.select(F.col("id").alias("exam_result_id"), *CYCLE_KEY)
    with_ids = good.join(ids, list(CYCLE_KEY))
    done = upsert_school_rows(replace(tables, exam_results=cycles), with_ids)
    parsed = checked.groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("reject_reason").isNull()).alias("schools_parsed"))
    saved = with_ids.where(names.normalize_school(F.col("school")) != "").groupBy("doc_id").agg(
        F.count("*").alias("schools_saved"))
    status = (parsed.join(saved, "doc_id", "left").withColumn("schools_saved", F.coalesce("schools_saved", F.lit(0)))
              .withColumn("status", F.when(F.col("schools_parsed") == 0, "failed")
                          .when(F.col("schools_saved") < F.col("schools_parsed") * 0.9, "partial").otherwise("saved")))
    return done, status
