"""Registered queries of text extraction, files, writes, ingest and throttling.

Their inputs are derived from the given tables: announcements and report lines are worded from cycles and school
results, so what is read back must equal what was written; pages and documents are read as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import fresh_path, literal_array, literal_frame, number_rows
from ..functions import cycles as cy
from ..functions import links, names, numbers
from ..operators import audit, ingest, writes
from ..operators import text as tx
from ..operators.national import with_program
from ..registry import PROGRAMS
from ..schemas import Tables
from ..sources import files
from ..streaming import ingest as stream
from ..streaming.throttle import throttle_events, throttle_stream
from . import bindings as b


def school_rows(spark, sf: str) -> DataFrame:
    """School results with names and programs, as a report would print them: a result whose rate and rank are not on record
    has its computed rate and rank 0."""
    t = b.schools(spark, sf, people=False)
    named = t.schools.select(F.col("id").alias("school_id"), F.upper("name").alias("school"))
    cycles = t.exam_results.select(F.col("id").alias("exam_result_id"), "program_id", "year", "month")
    rows = t.school_performance.withColumn("rank", F.coalesce("rank", F.lit(0))).withColumn("pass_rate", F.coalesce(
        "pass_rate", numbers.pass_rate(F.col("passers"), F.col("takers"))))
    rows = rows.join(named, "school_id").join(cycles, "exam_result_id")
    # The texts made of these rows cost far more to read than the rows cost to move: use all cores.
    return rows.repartition(spark.sparkContext.defaultParallelism, "id")


def report_texts(spark, sf: str, kind: str) -> DataFrame:
    """One short report per school result in a given layout, and every document of the corpus."""
    rows = school_rows(spark, sf)
    rank, school = F.col("rank").cast("string"), F.col("school")
    takers, passers = F.col("takers").cast("string"), F.col("passers").cast("string")
    failed = (F.col("takers") - F.col("passers")).cast("string")
    rate = F.format_string("%.2f", "pass_rate")
    group = F.concat(passers, F.lit(" "), failed, F.lit(" "), takers, F.lit(" "), rate, F.lit("%"))
    line = {
        "table": F.when(F.col("rank") % 2 == 0, F.concat(
            F.lit("| "), rank, F.lit(" | "), school, F.lit(" | "), takers, F.lit(" | "), passers, F.lit(" | "), rate,
            F.lit("% |"))).otherwise(F.concat_ws(" ", rank, school, takers, passers, rate)),
        "official": F.concat(F.translate(school, "0123456789", "ABCDEFGHIJ"), F.lit("  "), group, F.lit(" 0 0 0 0.00% "),
                             group),
        "simple": F.concat_ws(" ", rank, F.translate(school, "0123456789", "ABCDEFGHIJ"), passers, failed, takers, rate),
        "merged": F.concat(F.translate(school, "0123456789", "ABCDEFGHIJ"), F.lit(" | "), passers, F.lit(" "), failed,
                           F.lit(" "), takers, F.lit(" "), rate, F.lit("%")),
    }[kind]
    header = {"table": "| RANK | SCHOOL | TAKERS | PASSERS | RATE |"}.get(kind, "SCHOOL PASSED FAILED TOTAL RATE")
    reports = rows.select(F.col("id").alias("doc_id"), F.concat(
        F.lit(header + "\n---\n"), line, F.lit("\nnothing to see here")).alias("text"))
    corpus = b.read(spark, sf, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return reports.unionByName(corpus)


def report_blocks(spark, sf: str) -> DataFrame:
    """Reports of up to 25 schools of a cycle in the official layout, every fourth school again in lower case, and every
    document of the corpus."""
    rows = school_rows(spark, sf)
    passers, takers = F.col("passers").cast("string"), F.col("takers").cast("string")
    group = F.concat_ws(" ", passers, (F.col("takers") - F.col("passers")).cast("string"), takers,
                        F.format_string("%.2f%%", "pass_rate"))
    school = F.translate("school", "0123456789", "ABCDEFGHIJ")
    again = F.explode(F.when(F.col("school_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    lines = rows.select("*", again.alias("copy")).select(
        "exam_result_id", F.expr("school_id div 25").alias("block"), F.struct(
            "school_id", "copy", F.concat(F.when(F.col("copy") == 1, F.lower(school)).otherwise(school), F.lit("  "), group,
                                          F.lit(" 0 0 0 0.00% "), group).alias("line")).alias("row"))
    # Grouped by cycle and block: from the 25,000th school on, the numbers of documents of two cycles meet.
    made = lines.groupBy((F.col("exam_result_id") * 1000 + F.col("block")).alias("doc_id"), "exam_result_id", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    reports = made.select("doc_id", F.concat(F.lit("SCHOOL PASSED FAILED TOTAL RATE\n---\n"), text, F.lit("\nend")).alias("text"))
    corpus = b.read(spark, sf, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return reports.unionByName(corpus)


def result_pages(spark, sf: str) -> DataFrame:
    """One page per school result with a table in the narrow or the wide layout, and every page of the corpus."""
    rows = school_rows(spark, sf)
    takers, passers = numbers.grouped_text(F.col("takers")), numbers.grouped_text(F.col("passers"))
    failed = numbers.grouped_text(F.col("takers") - F.col("passers"))
    rate = F.format_string("%.2f%%", "pass_rate")

    def cells(*values) -> object:
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), v, F.lit("</td>")) for v in values], F.lit("</tr>"))

    zero = F.lit("0")
    narrow = F.concat(cells(F.lit("Total"), takers, passers, rate), cells(F.col("school"), takers, passers, rate))
    wide = F.concat(cells(F.lit("7"), F.lit("School"), passers, failed, takers, rate),
                    cells(F.lit("8"), F.col("school"), zero, zero, passers, failed, takers, rate))
    table = F.concat(F.lit("<table><tr><th>School</th></tr>"),
                     F.when(F.col("school_id") % 2 == 0, narrow).otherwise(wide), F.lit("</table>"))
    made = rows.select(F.col("id").alias("page_id"), F.concat(
        F.lit("<html><body><table><tr><td>x</td></tr></table><p>Results</p>"), table, F.lit("</body></html>"))
        .alias("html"))
    return made.unionByName(b.read(spark, sf, "pages").select((-F.col("page_id") - 1).alias("page_id"), "html"))


def link_pages(spark, sf: str) -> DataFrame:
    """Announcement pages with Drive, PDF and image links beside the pages of the corpus."""
    made = b.announcements(spark, sf)
    key = F.col("id").cast("string")
    html = F.concat(
        F.lit('<a href="#top">Top</a> <a class="x" href="/uploaded/documents/'), key,
        F.lit('.pdf">Performance <b>of Schools</b></a><iframe src="https://drive.google.com/file/d/ID_'), key,
        F.lit('/preview"></iframe><a href="https://drive.google.com/uc?export=download&id=ALT_'), key,
        F.lit('">Copy</a><a href="files/list.PDF">List</a><img src="/logo-result.png"><img src="img/result-'), key,
        F.lit('.png"><img alt="b" src="https://cdn.example.org/banner.jpg">'))
    rows = made.select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.example.org/a/"), key).alias("url"),
                       html.alias("html"))
    return rows.unionByName(b.read(spark, sf, "pages").select((-F.col("page_id") - 1).alias("page_id"), "url", "html"))


def arrivals(spark, sf: str) -> DataFrame:
    """Announcements in order of arrival. Pages without a public address get one."""
    rows = b.announcements(spark, sf)
    url = F.when(F.col("url").startswith("manual://"), F.concat(F.lit("https://example.org/"), F.col("id").cast("string"))
                 ).otherwise(F.col("url"))
    return rows.withColumn("url", url).withColumn("arrival", F.col("id"))


def posts(spark, sf: str) -> DataFrame:
    """Posts of all kinds about the registered cycles, some repeated."""
    rows = b.announcements(spark, sf)
    key = F.col("id")
    kinds = F.array(F.lit("Results"), F.lit("List of Passers"), F.lit("Top Schools and Results"),
                    F.lit("Performance of Schools"), F.lit("Room Assignment"), F.lit("Licensure Examination Results"))
    mark = F.expr("id div 10")
    title = F.concat(F.replace("title", F.lit(" Results "), F.lit(" ")), F.lit(" "),
                     F.element_at(kinds, (mark % 6 + 1).cast("int")))
    base = rows.select(key.alias("post_id"), title.alias("title"), F.concat(
        F.col("url"), F.lit("/"), (mark % 97).cast("string")).alias("url"))
    copies = F.explode(F.when(F.col("post_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return base.withColumn("copy", copies).select(
        "url", F.concat("title", F.repeat(F.lit(" again"), F.col("copy"))).alias("title"),
        (F.col("post_id") * 2 + F.col("copy")).alias("arrival"))


def national_csv(spark, sf: str) -> DataFrame:
    """The registered cycles written as a folder of loosely formatted CSV files in three orders of columns and read back."""
    def build() -> str:
        rows = b.registered(spark, sf).exam_results
        code = (F.when(F.col("id") % 97 == 0, "NOPE").when(F.col("year") % 2 == 0, F.lower("exam_code"))
                .otherwise(F.col("exam_code")))
        text = rows.select(code.alias("exam_code"), F.concat(F.lit(" "), F.col("month"), F.lit(" ")).alias("month"),
                           F.col("year").cast("string").alias("year"),
                           numbers.grouped_text(F.col("total_passers")).alias("total_passers"),
                           numbers.grouped_text(F.col("total_takers")).alias("total_takers"),
                           F.concat(F.col("pass_rate").cast("string"), F.lit("%")).alias("pass_rate"),
                           F.when(F.col("id") % 3 == 0, F.col("source_url")).otherwise("").alias("source_url"))
        path = fresh_path(spark, "national-csv")
        columns = text.columns
        for k, order in enumerate((columns, columns[::-1], columns[3:] + columns[:3])):
            text.where(F.pmod(F.col("year").cast("int"), F.lit(3)) == k).select(order).write.option("header", True).mode(
                "append").csv(path)
        return path
    return files.read_national_csv(spark, _written(spark, "national_csv", sf, build))


_paths: dict[tuple[str, str, str], str] = {}


def _written(spark, name: str, sf: str, build) -> str:
    key = (spark.sparkContext.applicationId, name, sf)
    if key not in _paths:
        _paths[key] = build()
    return _paths[key]


def school_files(spark, sf: str) -> DataFrame:
    """One small CSV file per school result, under five spellings of the header; one is wide, one has quoted commas."""
    rows = school_rows(spark, sf)
    filler = ",".join(f"note {i}" for i in range(40))
    styles = F.array(F.lit("Rank,School Name,No. of Examinees,No. of Passers,Passing Rate"),
                     F.lit("#,Institution,Examinees,Passed,%"), F.lit("pass_rate,passers,takers,school,rank"),
                     F.lit(filler + ",Rank,School,Takers,Passers,Rate"),
                     F.lit('"Notes, national",Rank,"School",Takers,Passers,"Pass ""Rate"""'))
    at = (F.col("school_id") % 7 % 5 + 1).cast("int")
    t, p = F.col("takers").cast("string"), F.col("passers").cast("string")
    rate, name = F.format_string("%.2f%%", "pass_rate"), F.concat(F.lit('"'), "school", F.lit(', Inc"'))
    rank = F.col("rank").cast("string")
    plain = F.concat_ws(",", rank, name, t, p, rate)
    body = (F.when(at == 3, F.concat_ws(",", rate, p, t, name, rank))
            .when(at == 4, F.concat(F.lit("," * 40), plain))
            .when(at == 5, F.concat(F.lit('"a, ""b""\r\nc",'), plain)).otherwise(plain))
    # Every tenth school's file lacks the passers and is refused.
    header = F.when(F.col("school_id") % 10 == 0, "Rank,School,Takers,Rate").otherwise(F.element_at(styles, at))
    return rows.select(F.concat(F.when(F.col("school_id") % 2 == 0, "CELE_").otherwise(""), F.when(
        F.col("month") == "May", "May").otherwise("nov"), F.lit("_"), F.col("year").cast("string"),
        F.when(F.col("school_id") % 5 == 0, "_final").otherwise(""), F.lit(".csv")).alias("file_name"), "id",
        F.concat(header, F.lit("\r\n"), body, F.lit("\r\n,,,,\r\n")).alias("content"))


def school_folder(spark, sf: str) -> str:
    """A folder of CSV files of many schools, one per program and half-year: five spellings of the header in turn, every
    sixth file lacks the passers. One spelling has quoted cells with line ends. The folders below it hold the names."""
    def build() -> str:
        rows = school_rows(spark, sf).withColumn("style", (F.col("program_id") + F.col("year") + F.when(
            F.col("month") == "May", 1).otherwise(2)) % 6)
        t, p, rank = F.col("takers").cast("string"), F.col("passers").cast("string"), F.col("rank").cast("string")
        rate, name = F.format_string("%.2f%%", "pass_rate"), F.concat(F.lit('"'), "school", F.lit(', Inc"'))
        plain, style = F.concat_ws(",", rank, name, t, p, rate), F.col("style")
        note = F.when(F.col("school_id") % 3 == 0, '"a, ""b""\r\n\r\nc"').otherwise('""')
        body = (F.when(style == 2, F.concat_ws(",", rate, p, t, name, rank)).when(style == 3, F.concat_ws(",", note, plain))
                .when(style == 5, F.concat_ws(",", rank, name, t, rate)).otherwise(plain))
        heads = F.array(*map(F.lit, ("Rank,School Name,No. of Examinees,No. of Passers,Passing Rate", "#,Institution,Examinees,Passed,%",
                                     "pass_rate,passers,takers,school,rank", 'Note,Rank,School,Takers,Passers,"Pass ""Rate"""',
                                     "Ranking,Name,Examinees,No. Passers,Percentage", "Rank,School,Takers,Rate")))
        named = rows.select(F.concat(F.col("program_id").cast("string"), F.lit("_"), F.lower("month"), F.lit("_"), F.col("year").cast(
            "string"), F.lit(".csv")).alias("file_name"), "school_id", "style", body.alias("value"))
        header = named.select("file_name", "style").distinct().select(
            "file_name", F.lit(-1).cast("long").alias("school_id"), F.get(heads, F.col("style").cast("int")).alias("value"))
        lines = named.drop("style").unionByName(header).withColumn("value", F.concat("value", F.lit("\r")))
        path = fresh_path(spark, "school-folder")
        lines.repartition("file_name").sortWithinPartitions("file_name", "school_id").select("file_name", "value").write.partitionBy(
            "file_name").text(path)
        return path

    return _written(spark, "school_folder", sf, build)


def _folder_records(spark, sf: str) -> DataFrame:
    name = F.regexp_extract("file", "file_name=([^/]+)/", 1)
    return files.read_csv_records(spark, school_folder(spark, sf), "part-*", name)


def _school_csv(spark, sf: str) -> DataFrame:
    made = school_files(spark, sf)
    keyed = made.select(F.col("id").cast("string").alias("file_name"), "content")
    return files.school_csv_rows(keyed)


def _school_file_errors(spark, sf: str) -> DataFrame:
    made = school_files(spark, sf)
    return files.school_file_errors(made.select(F.col("id").cast("string").alias("file_name"), "content"))


def _folder_cycles(spark, sf: str) -> DataFrame:
    return files.folder_cycles(school_files(spark, sf)).groupBy("file_name", "status", "month", "year").agg(
        F.count("*").alias("files"))


def incoming_school_rows(spark, sf: str) -> DataFrame:
    """School results re-submitted as report text under other spellings, with new schools and repeats."""
    t = b.schools(spark, sf, people=False)
    named = t.schools.select(F.col("id").alias("school_id"), "name")
    key = F.col("school_id")
    school = (F.when(key % 5 == 0, F.concat(F.upper("name"), F.lit(" - Main Campus")))
              .when(key % 5 == 1, F.replace("name", F.lit(" "), F.lit("  ")))
              .when(key % 5 == 2, F.concat(F.lit("UST Annex "), key.cast("string")))
              .when(key % 5 == 3, F.replace("name", F.lit(" "), F.lit("-"))).otherwise(F.col("name")))
    rows = t.school_performance.join(named, "school_id")
    copies = F.explode(F.when((key + F.col("exam_result_id")) % 11 == 0, F.array(F.lit(0), F.lit(1)))
                       .otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).select(
        "exam_result_id", school.alias("school"), F.lit(None).cast("string").alias("region"),
        (F.col("takers") + F.col("copy")).cast("string").alias("takers"), F.col("passers").cast("string").alias("passers"),
        F.concat(F.col("pass_rate").cast("string"), F.lit("%")).alias("pass_rate"),
        F.col("rank").cast("string").alias("rank"), (F.col("id") * 2 + F.col("copy")).alias("arrival"))


def _upsert_school_rows(spark, sf: str) -> Tables:
    t = b.schools(spark, sf, people=False)
    # Half of the warehouse is known beforehand; the re-submission brings the rest.
    known = t.school_performance.where(F.col("exam_result_id") % 2 == 0)
    return writes.upsert_school_rows(
        Tables(programs=t.programs, regions=t.regions, schools=t.schools.where(F.col("id") % 4 != 0),
               exam_results=t.exam_results, school_performance=known), incoming_school_rows(spark, sf))


def _named_results(spark, sf: str) -> DataFrame:
    done = _upsert_school_rows(spark, sf)
    return done.school_performance.join(done.schools.select(F.col("id").alias("school_id"), F.col("name").alias(
        "school"), F.col("slug")), "school_id").select("exam_result_id", "school", "slug", "takers", "passers",
                                                       "pass_rate", "rank")


def incoming_cycles(spark, sf: str) -> DataFrame:
    """Three waves of rows for the registered cycles: real, placeholder and manual ones, in a fixed order."""
    rows = b.registered(spark, sf).exam_results
    mark = F.expr("id div 10") % 7
    wave = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    waves = rows.withColumn("wave", wave)
    kind = (mark + F.col("wave")) % 7
    shell = kind.isin(1, 4)
    return waves.where(kind != 6).select(
        "program_id", "month", (F.col("year") + F.when(mark == 5, 1).otherwise(0)).alias("year"),
        F.when(shell, 0).otherwise(F.col("wave") + 100).alias("total_takers"),
        F.when(shell, 0).otherwise(50).alias("total_passers"), F.when(shell, 0.0).otherwise(50.0).alias("pass_rate"),
        F.when(kind.isin(3, 4), "manual://user-csv-national").otherwise(F.concat(
            F.lit("https://www.prc.gov.ph/w"), F.col("wave").cast("string"))).alias("source_url"),
        (F.col("id") * 10 + F.col("wave")).alias("arrival"))


def _upserted(spark, sf: str, **options) -> DataFrame:
    t = b.registered(spark, sf)
    return writes.upsert_national(t.exam_results, incoming_cycles(spark, sf), **options)


def validation_candidates(spark, sf: str) -> DataFrame:
    """Announcements with planted faults of title, year, exam and statistics."""
    rows = ingest.read_announcements(arrivals(spark, sf))
    mark = F.expr("id div 10") % 13
    return rows.withColumn("title", F.when(mark == 1, F.concat(F.lit("Room Assignment "), "title"))
                           .when(mark == 2, F.lit("Some title 2019")).otherwise(F.col("title"))).withColumn(
        "parsed_year", F.when(mark == 3, None).when(mark == 4, F.col("parsed_year") + 1).otherwise(
            F.col("parsed_year"))).withColumn(
        "total_passers", F.when(mark == 5, F.col("total_takers") + 1).otherwise(F.col("total_passers"))).withColumn(
        "pass_rate", F.when(mark == 6, F.col("pass_rate") + 5).otherwise(F.col("pass_rate")))


def _ingest(spark, sf: str) -> ingest.IngestResult:
    t = b.registered(spark, sf)
    return ingest.ingest_announcements(arrivals(spark, sf), Tables(programs=t.programs, exam_results=t.exam_results))


def _delete(spark, sf: str):
    t = b.registered(spark, sf)
    bad = audit.bad_rows(t, b.START_YEAR, b.END_YEAR, placeholders=True, mismatches=True, duplicates=True,
                         rate_year=True)
    return writes.delete_cycles(Tables(programs=t.programs, exam_results=t.exam_results), bad)


def _clean_audit(spark, sf: str) -> DataFrame:
    left, _ = _delete(spark, sf)
    t = b.registered(spark, sf)
    kept = Tables(programs=t.programs, exam_results=left.exam_results)
    return audit.audit_national(kept, b.START_YEAR, b.END_YEAR).where(
        F.col("check_id").isin("url_year_mismatch", "rate_mismatch", "placeholder_row", "exam_content_mismatch"))


def _cascade(spark, sf: str) -> DataFrame:
    """Rows left in the three tables after one whole program is removed."""
    t = b.schools(spark, sf)
    left, _ = writes.delete_cycles(t, writes.program_cycles(t, "building"))
    def count(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.count("*").alias("rows")).withColumn("table", F.lit(name))
    return (count(left.exam_results, "exam_results").unionByName(count(left.school_performance, "school_performance"))
            .unionByName(count(left.topnotchers, "topnotchers")))


def _jobs(spark, sf: str) -> DataFrame:
    t = b.registered(spark, sf)
    rows = with_program(t).withColumn("arrival", F.col("id")).withColumn(
        "status", F.when(numbers.complete(), "saved").otherwise("skipped"))
    numbered = number_rows(rows.select("arrival", "exam_code", "year", "status"), [], [F.asc("arrival")], "line_no")
    return writes.import_job_islands(numbered, block=100)


def _job_rows(spark, sf: str) -> DataFrame:
    """The job log of a run over the link index: one job per run of rows of an exam and year."""
    t = b.registered(spark, sf)
    rows = with_program(t).withColumn("arrival", F.col("id"))
    status = rows.select("arrival", F.when(numbers.complete(), "saved").otherwise("skipped").alias("status"))
    known = Tables(programs=t.programs.where("exam_code <> 'CPALE'"))
    jobs = writes.import_job_islands(ingest.job_log_rows(rows, status), block=100)
    return writes.finish_jobs(jobs, known, "2026-01-02 03:04:05", "2026-01-02 04:05:06").select(
        "id", "program_id", "year", "status", "rows_affected", "notes",
        F.date_format("finished_at", "yyyy-MM-dd HH:mm").alias("finished"))


def _saved_counts(spark, sf: str) -> DataFrame:
    rows = incoming_school_rows(spark, sf)
    return writes.saved_counts(rows.withColumn("school", F.when(F.col("takers").cast("int") % 7 == 0, " ").otherwise(
        F.col("school"))))


#: About as many links as one array of a written index holds.
ARRAY_LINKS = 10_000


def link_arrays(links: DataFrame, most: int = ARRAY_LINKS) -> DataFrame:
    """JSON arrays (value) of the links of a program, dealt by a hash of the link into arrays of about `most` links."""
    rows = links.withColumn("row", F.to_json(F.struct(*links.columns)))
    sizes = links.groupBy("exam_code").agg(F.ceil(F.count("*") / most).alias("arrays")).withColumnRenamed("exam_code", "of")
    dealt = rows.join(sizes, F.col("exam_code").eqNullSafe(F.col("of"))).withColumn(
        "array", F.pmod(F.xxhash64("row"), F.col("arrays")))
    return dealt.groupBy("exam_code", "array").agg(F.concat(
        F.lit("[\n"), F.array_join(F.collect_list("row"), ",\n"), F.lit("\n]")).alias("value")).select("value")


def _link_index_path(spark, sf: str) -> str:
    def build() -> str:
        path = fresh_path(spark, "link-index")
        link_arrays(_index(spark, sf)).write.option("maxRecordsPerFile", 1).text(path)
        return path
    return _written(spark, "link_index", sf, build)


def _link_index_file(spark, sf: str) -> DataFrame:
    """The link index written as JSON arrays per program and read back for one program."""
    return files.read_link_index(spark, _link_index_path(spark, sf), "CPALE").select(
        "exam_code", "year", "month", "url", "source", "post_id")


def _link_index_files(spark, sf: str) -> DataFrame:
    """The link index written as JSON arrays per program and read back whole."""
    return files.read_link_index(spark, _link_index_path(spark, sf)).select(
        "exam_code", "year", "month", "url", "source", "post_id")


def _written_index(spark, sf: str) -> DataFrame:
    """What the written index files hold: links per program, read back from the CSV and the JSON lines."""
    folder = _written(spark, "index_out", sf, lambda: _sink(fresh_path(spark, "index"), lambda at: files.write_link_index(
        _index(spark, sf), at)))
    csv = spark.read.option("header", True).csv(f"{folder}/national_links_csv").groupBy("exam_code").agg(
        F.count("*").alias("csv_links"))
    lines = spark.read.json(f"{folder}/national_links_json").groupBy("exam_code").agg(F.count("*").alias("json_links"))
    return csv.join(lines, "exam_code", "full")


def _sink(folder: str, write) -> str:
    write(folder)
    return folder


def _written_drive_links(spark, sf: str) -> DataFrame:
    """Drive links of the announcement pages as written to files, read back."""
    folder = _written(spark, "drive_out", sf, lambda: _sink(fresh_path(spark, "drive"), lambda at: files.write_drive_links(
        _drive_links(spark, sf), at)))
    return spark.read.option("header", True).schema("year int, drive_file_id string").csv(f"{folder}/drive_links_csv")


def _streamed(spark, sf: str) -> DataFrame:
    """The announcements replayed as files through the continuous ingest; its last snapshot."""
    def build() -> str:
        root = fresh_path(spark, "stream")
        pages = arrivals(spark, sf).select("exam_code", "year", "month", "url", "source", "title", "html", "arrival")
        pages.repartitionByRange(3, "arrival").write.json(f"{root}/in")
        t = b.registered(spark, sf)
        stream.start_snapshots(t.exam_results, f"{root}/cycles")
        run = stream.stream_ingest(spark, f"{root}/in", t.programs, f"{root}/cycles", f"{root}/checkpoint",
                                   files_per_batch=1)
        run.awaitTermination()
        return f"{root}/cycles"
    return stream.snapshot(spark, _written(spark, "stream", sf, build)).select(
        "program_id", "month", "year", "total_takers", "total_passers", "pass_rate", "source_url")


def _topnotcher_upsert(spark, sf: str) -> DataFrame:
    t = b.schools(spark, sf)
    rows = t.topnotchers.select("exam_result_id", (F.col("rank") % 6 + 1).cast("int").alias("rank"), F.upper("name").alias(
        "name"), "school", "rating", F.col("id").alias("arrival"))
    done = writes.upsert_topnotchers(Tables(topnotchers=t.topnotchers.where("rank <= 4")), rows)
    return done.topnotchers.select("exam_result_id", "rank", "name", "school", "rating")


def dual_pages(spark, sf: str) -> DataFrame:
    """One announcement of both teacher exams per cycle of the elementary one, worded from its numbers."""
    rows = b.registered(spark, sf).exam_results.where("program_id = 1").where(numbers.complete())
    p, t = numbers.grouped_text(F.col("total_passers")), numbers.grouped_text(F.col("total_takers"))
    p2, t2 = numbers.grouped_text(F.col("total_passers") * 2), numbers.grouped_text(F.col("total_takers") * 2)
    r = F.format_string("%.2f", "pass_rate")
    text = F.concat(F.lit("<p>PRC: "), p, F.lit(" elementary teachers out of "), t, F.lit(" examinees ("), r,
                    F.lit("%) and\n"), p2, F.lit(" secondary teachers out of "), t2, F.lit(" examinees ("), r,
                    F.lit("%) passed</p>"))
    return rows.select("id", "year", "month", F.col("source_url").alias("url"), F.lit("prc.gov.ph").alias("source"),
                       cy.cycle_label(F.col("month"), F.col("year")).alias("title"), text.alias("html"))


def _reingest(spark, sf: str) -> DataFrame:
    """Registered cycles turned into placeholders are filled again from their announcements."""
    t = b.registered(spark, sf)
    hollow = F.expr("id div 10") % 2 == 0
    emptied = t.exam_results.withColumn("total_takers", F.when(hollow, 0).otherwise(F.col("total_takers"))).withColumn(
        "total_passers", F.when(hollow, 0).otherwise(F.col("total_passers"))).withColumn(
        "pass_rate", F.when(hollow, 0.0).otherwise(F.col("pass_rate"))).withColumn(
        "source_url", F.when(hollow, None).otherwise(F.col("source_url")))
    pages = arrivals(spark, sf).select("arrival", "exam_code", "year", "month", "url", "source", "title", "html")
    dual = dual_pages(spark, sf).select(
        (F.col("id") + 500_000_000_000).alias("arrival"), F.lit("LET-E").alias("exam_code"), "year", "month", "url",
        "source", "title", "html")
    done = ingest.reingest_placeholders(Tables(programs=t.programs, exam_results=emptied), pages.unionByName(dual))
    return done.tables.exam_results.select("program_id", "month", "year", "total_takers", "total_passers", "pass_rate",
                                           "source_url")


def _direct_links(spark, sf: str) -> DataFrame:
    """Probed addresses of the mirror: two months a year answer for each program."""
    programs = b.registry_programs(spark)
    cycles = b.registered(spark, sf).exam_results.where(numbers.complete()).select("exam_code", "year", "month")
    grid = ingest.probe_grid(programs, b.START_YEAR, b.END_YEAR)
    probes = (grid.join(cycles, ["exam_code", "year", "month"]).join(programs.select("exam_code", "name"), "exam_code")
              .select("url", F.when(F.col("year") % 5 == 0, 404).otherwise(200).alias("status"),
                      F.concat("name", F.lit(" results "), "month").alias("title")))
    return ingest.pick_direct_links(programs, probes, b.START_YEAR, b.END_YEAR)


def _notcher_lines(spark, sf: str) -> DataFrame:
    t = b.schools(spark, sf).topnotchers
    name = F.upper(F.translate("name", "#0123456789", "-ABCDEFGHIJ"))
    school = F.translate(F.upper("school"), "_0123456789", " ABCDEFGHIJ")
    text = F.concat(F.lit("RANK NAME SCHOOL RATING\n"), F.col("rank").cast("string"), F.lit(" "), name, F.lit(", "), school,
                    F.lit(" "), F.format_string("%.2f", "rating"), F.lit("\nend"))
    return tx.parse_topnotchers(t.select(F.col("id").alias("doc_id"), text.alias("text")))


def _notcher_items(spark, sf: str) -> DataFrame:
    t = b.schools(spark, sf).topnotchers
    name = F.upper(F.translate("name", "#0123456789", " ABCDEFGHIJ"))
    school = F.replace("school", F.lit(" - Main"), F.lit(" Main"))
    text = F.concat(*[F.concat(F.lit(f"{i}. "), name, F.lit(f" {chr(64 + i)} - "), school, F.lit(" - "),
                               F.format_string("%.2f", "rating"), F.lit("%\n")) for i in range(1, 13)])
    return tx.parse_topnotchers(t.select(F.col("id").alias("doc_id"), text.alias("text")), "items")


def _json_rows(spark, sf: str) -> DataFrame:
    rows = school_rows(spark, sf)
    one = F.to_json(F.struct("school", "takers", F.col("passers").cast("string").alias("passers"),
                             F.format_string("%.2f%%", "pass_rate").alias("pass_rate"), "rank"))
    bad = F.lit('{"school":"Overall total","takers":1,"passers":1,"pass_rate":100}')
    array = F.concat(F.lit("["), one, F.lit(","), bad, F.lit("]"))
    text = (F.when(F.col("school_id") % 3 == 0, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
            .when(F.col("school_id") % 3 == 1, F.concat(F.lit('{"schools":'), array, F.lit("}")))
            .otherwise(F.concat(F.lit("Here you are: "), array, F.lit(" done"))))
    return tx.json_rows(rows.select(F.col("id").alias("doc_id"), text.alias("text")))


def _string_lists(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, F.array_join(c, " "))
    return rows


def _pages_text(spark, sf: str, *extra: str) -> DataFrame:
    pages = b.read(spark, sf, "pages")
    return tx.html_to_text(pages).select("page_id", *extra, tx.page_title(F.col("html")).alias("title"), "text")


def planted_summaries(spark, sf: str) -> DataFrame:
    """Documents with a summary in one of the six wordings at their end, its parts far apart in some, unsound in others."""
    d = b.read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    p, more = F.col("doc_id") % 900 + 100, F.col("doc_id") % 301
    said = {"p": p.cast("string"), "t": (p + more).cast("string"), "f": more.cast("string"), "body": F.col("body"),
            "r": F.format_string("%.1f", (F.col("doc_id") % 1000) / 10.0)}
    wordings = (("p", " out of ", "t", " (", "r", "%)"), ("p", " out  of ", "t", " passed"),
                ("p", " passed and ", "f", " failed out of ", "t"),
                ("A passing rate of ", "r", "%. ", "body", " ", "p", " out of ", "t", " sat"),
                ("t", " examinees. ", "body", " ", "p", " passers. ", "body", " ", "r", "%"),
                ("Total number of passers: ", "p", ". ", "body", " Examinees: ", "t"),
                ("t", " out of ", "p", " passed, total passers ", "p", ", examinees ", "t"))
    end = F.lit("")
    for k, wording in enumerate(wordings):
        end = F.when(F.col("doc_id") % 8 == k, F.concat(*[said.get(w, F.lit(w)) for w in wording])).otherwise(end)
    return d.select("doc_id", F.concat("body", F.lit(" 7 examinees, 8,9 out of. "), end).alias("text"))


def titled_pages(spark, sf: str) -> DataFrame:
    """Pages, every second one with the name of a registered program in its title."""
    name = F.element_at(literal_array([p.name for p in PROGRAMS]), (F.col("page_id") % len(PROGRAMS) + 1).cast("int"))
    title = F.concat(F.coalesce("title", F.lit("")), F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit(" "), name)))
    return _pages_text(spark, sf, "url").withColumn("title", title)


def _cycle_labels(spark, sf: str) -> DataFrame:
    rows = b.national(spark, sf).exam_results
    label = cy.cycle_label(F.col("month"), F.col("year"))
    takers, passers, rate = F.col("total_takers"), F.col("total_passers"), F.col("pass_rate")
    return rows.select("id", label.alias("label"), cy.short_label(F.col("month"), F.col("year")).alias("short"),
                       cy.axis_month(F.col("month")).alias("axis_month"), cy.label_month(label).alias("label_month"),
                       cy.label_year(label).alias("label_year"), cy.label_line(label).alias("label_line"),
                       numbers.failed_count(takers, passers).alias("failed"),
                       numbers.failed_rate(takers, rate).alias("failed_rate"),
                       numbers.delta_text(numbers.js_round(rate - 50, 2)).alias("delta"))


def _link_rules(spark, sf: str) -> DataFrame:
    rows = b.registered(spark, sf).exam_results
    url, code, month, year = F.col("source_url"), F.col("exam_code"), F.col("month"), F.col("year")
    title = cy.cycle_label(month, year)
    return rows.select(
        "id", links.url_year(url).alias("url_year"), links.slug_owner(url).alias("owner"),
        links.stored_priority(url).alias("priority"), links.keep_score(code, month, year, url).alias("keep_score"),
        links.month_in_order(F.concat_ws(" ", title, url)).alias("month_in_order"),
        links.first_month(F.concat_ws(" ", title, url)).alias("first_month"),
        links.inferred_month(code, F.concat_ws(" ", title, url)).alias("inferred_month"),
        writes.should_overwrite(url, F.lit("prcboard.com")).alias("mirror_may_overwrite"),
        writes.should_overwrite(url, F.lit("prc.gov.ph")).alias("official_may_overwrite"))


def _school_names(spark, sf: str) -> DataFrame:
    raw = incoming_school_rows(spark, sf).select("school").distinct()
    clean = names.normalize_school(F.col("school"))
    return raw.select("school", clean.alias("clean"), names.slugify(clean).alias("slug"),
                      names.clean_report_school(F.concat("school", F.lit(" 12"))).alias("report_name"),
                      names.clean_scanned_school(F.concat(F.lit("7 "), "school", F.lit(" *"))).alias("scanned_name"))


def _regions(spark, sf: str) -> DataFrame:
    hints = literal_frame(spark, {"at": "int", "city": "string"}, [
        (0, "Manila"), (1, "QUEZON CITY"), (2, "Cebu"), (3, "Davao"), (4, "Nowhere"), (5, "Cagayan de Oro"),
        (6, "Iloilo")])
    named = b.schools(spark, sf).schools.select("id", (F.col("id") % 7).cast("int").alias("at"), "name")
    return named.join(hints, "at").select("id", names.infer_region(F.concat_ws(" ", "name", "city")).alias("region"))


def _throttle(spark, sf: str) -> DataFrame:
    events = b.read(spark, sf, "events").select(F.col("user_id").alias("key"), "ts")
    return throttle_events(events, limit=3, window_ms=6 * 3600 * 1000, partners=[7])


def _throttle_streamed(spark, sf: str) -> DataFrame:
    """The same log replayed in four files, in order of time, through the stream; its last file also holds rows that come
    more than a window too late and are left out."""
    hours = 3600 * 1000

    def build() -> str:
        root = fresh_path(spark, "throttle")
        log = b.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
        low, high = log.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
        parts = log.withColumn("part", F.floor((F.unix_millis("ts") - low) * 4 / (high - low + 1)).cast("int"))
        for part in range(4):
            rows = parts.where(F.col("part") == part).select("key", "ts")
            if part == 3:
                late = parts.where("part = 0 and key % 5 = 0").select("key", (F.col("ts") - F.expr("interval 1 day")).alias("ts"))
                rows = rows.unionByName(late)
            rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
        live = throttle_stream(spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in"),
                               limit=3, window_ms=6 * hours, partners=[7])
        run = (live.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
               .trigger(availableNow=True).start())
        run.awaitTermination()
        return f"{root}/out"

    return spark.read.parquet(_written(spark, "throttle", sf, build))


def _index(spark, sf: str) -> DataFrame:
    return b.link_index(spark, sf)


def _merge_index(spark, sf: str) -> DataFrame:
    rows = _index(spark, sf)
    old = rows.where(F.col("post_id") % 4 == 0)
    return writes.merge_index(old, rows.where(F.col("post_id") % 4 != 0))


def _gap_candidates(spark, sf: str) -> DataFrame:
    t = b.registered(spark, sf)
    left = Tables(programs=t.programs, exam_results=t.exam_results.where((F.col("year") + F.col("program_id")) % 3 != 0))
    return ingest.gap_candidates(left, _index(spark, sf), b.START_YEAR, b.END_YEAR)


def _articles(spark, sf: str) -> DataFrame:
    rows = b.announcements(spark, sf).withColumn("page_id", F.col("id"))
    report = tx.article_report(rows.select("page_id", "exam_code", "year", "month", "url", "title", F.concat(
        "html", F.lit('<a href="/uploaded/documents/x.pdf">Performance of Schools</a>')).alias("html")))
    return report.drop("source")


def _drive_links(spark, sf: str) -> DataFrame:
    mined = tx.mine_links(link_pages(spark, sf))
    cycles = b.registered(spark, sf).exam_results.select(F.col("id").alias("page_id"), "year")
    return mined.join(cycles, "page_id").select(
        "year", F.coalesce(F.get("drive_ids", F.lit(0)), F.lit("")).alias("drive_file_id"))


def _drive_counts(spark, sf: str) -> DataFrame:
    return files.drive_counts(_drive_links(spark, sf))


def _seed(spark, sf: str) -> DataFrame:
    """The registry seeded over the regions and provinces at hand."""
    t = b.schools(spark, sf)
    programs = b.registered(spark, sf).exam_results.select("program_id", "exam_code").distinct().select(
        F.col("program_id").alias("id"), "exam_code", F.lit("old name").alias("name"), F.lit(None).cast("string").alias(
            "level"), F.lit("old").alias("slug"))
    done = files.seed(spark, Tables(programs=programs, regions=t.regions, provinces=t.provinces))
    return done.provinces.join(done.regions.select(F.col("id").alias("region_id"), F.col("name").alias("region"),
                                                   F.col("code")), "region_id").select("id", "name", "region", "code")


def _ingest_school_files(spark, sf: str) -> DataFrame:
    """School files into a warehouse that lacks every other cycle."""
    t = b.schools(spark, sf)
    rows = school_rows(spark, sf).select(
        F.col("exam_result_id").cast("string").alias("doc_id"), "program_id", "month", "year", F.col("rank").alias(
            "line_no"), "school", F.lit(None).cast("string").alias("region"), F.col("takers").cast("string").alias("takers"),
        F.when(F.col("rank") % 9 == 0, "?").otherwise(F.col("passers").cast("string")).alias("passers"),
        F.col("pass_rate").cast("string").alias("pass_rate"), F.lit(0).alias("rank"), F.col("id").alias("arrival"))
    half = Tables(programs=t.programs, regions=t.regions, schools=t.schools,
                  exam_results=t.exam_results.where(F.col("id") % 2 == 0),
                  school_performance=t.school_performance.where("false"))
    done, _ = writes.ingest_school_rows(half, rows)
    cycles = done.exam_results.select(F.col("id").alias("exam_result_id"), "program_id", "month", "year", "source_url")
    return (done.school_performance.join(cycles, "exam_result_id").groupBy("program_id", "month", "year", "source_url")
            .agg(F.count("*").alias("schools"), F.sum("takers").alias("takers"), F.max("rank").alias("last_rank")))


QUERIES = {
    "cycle_labels": _cycle_labels,
    "link_rules": _link_rules,
    "school_names": _school_names,
    "region_hints": _regions,
    "html_to_text": _pages_text,
    "infer_exam": lambda s, sf: tx.infer_exam(tx.html_to_text(arrivals(s, sf))).select(
        "id", "exam_code", "parsed_exam", F.array_join(F.transform("scores", lambda x: x.cast("string")), " ").alias(
            "scores")),
    "infer_exam_titled": lambda s, sf: tx.infer_exam(titled_pages(s, sf)).select("page_id", "parsed_exam"),
    "infer_exam_pages": lambda s, sf: tx.infer_exam(_pages_text(s, sf).join(
        b.read(s, sf, "pages").select("page_id", "url"), "page_id")).groupBy("parsed_exam").agg(F.count("*").alias("n")),
    "extract_summary": lambda s, sf: tx.extract_summary(tx.html_to_text(b.announcements(s, sf))).select(
        "id", "total_passers", "total_takers", "pass_rate"),
    "extract_summary_planted": lambda s, sf: tx.extract_summary(planted_summaries(s, sf)).select(
        "doc_id", "total_passers", "total_takers", "pass_rate"),
    "extract_summary_corpus": lambda s, sf: tx.extract_summary(b.read(s, sf, "documents").select("doc_id", "text")
                                                              ).select("doc_id", "total_passers", "total_takers",
                                                                       "pass_rate"),
    "extract_dual": lambda s, sf: tx.extract_dual(tx.html_to_text(dual_pages(s, sf)).drop("html")).select(
        "id", "exam_code", "total_passers", "total_takers", "pass_rate"),
    "announced_dates": lambda s, sf: tx.html_to_text(b.announcements(s, sf)).select("id", links.announced_date(
        F.when(F.col("id") % 2 == 0, F.col("title")).otherwise("Results"), F.col("text")).alias("d")).select(
        "id", "d.month", "d.year"),
    "html_tables": lambda s, sf: tx.html_tables(result_pages(s, sf)),
    "mine_links": lambda s, sf: _string_lists(tx.mine_links(link_pages(s, sf)), "drive_ids", "documents", "images"),
    "parse_lines_table": lambda s, sf: tx.parse_lines(report_texts(s, sf, "table"), "table"),
    "parse_lines_official": lambda s, sf: tx.parse_lines(report_texts(s, sf, "official"), "official"),
    "parse_lines_simple": lambda s, sf: tx.parse_lines(report_texts(s, sf, "simple"), "simple"),
    "parse_lines_merged": lambda s, sf: tx.parse_lines(report_texts(s, sf, "merged"), "merged"),
    "parse_school_reports": lambda s, sf: tx.parse_school_reports(report_blocks(s, sf)),
    "parse_topnotcher_lines": _notcher_lines,
    "parse_topnotcher_items": _notcher_items,
    "json_rows": _json_rows,
    "discover_school_pages": lambda s, sf: tx.discover_school_pages(posts(s, sf), 2016, 2020),
    "discover_result_pages": lambda s, sf: tx.discover_result_pages(posts(s, sf), 2016, 2020),
    "discover_articles": lambda s, sf: tx.discover_articles(posts(s, sf), 2016, 2020),
    "article_report": _articles,
    "drive_counts": _drive_counts,
    "import_job_rows": _job_rows,
    "school_rows_saved": _saved_counts,
    "link_index_file": _link_index_file,
    "link_index_files": _link_index_files,
    "written_index": _written_index,
    "written_drive_links": _written_drive_links,
    "streamed_announcements": _streamed,
    "index_counts": lambda s, sf: files.index_counts(_index(s, sf)),
    "national_csv": lambda s, sf: files.check_national_rows(national_csv(s, sf)),
    "school_csv_rows": _school_csv,
    "school_file_errors": _school_file_errors,
    "school_folder_rows": lambda s, sf: files.school_csv_rows(_folder_records(s, sf)),
    "school_folder_errors": lambda s, sf: files.school_file_errors(_folder_records(s, sf)),
    "folder_cycles": _folder_cycles,
    "seed_provinces": _seed,
    "validate_rows": lambda s, sf: writes.validate_rows(validation_candidates(s, sf)).select(
        "id", "exam_code", "final_month", "reason"),
    "upsert_national": lambda s, sf: _upserted(s, sf),
    "upsert_national_forced": lambda s, sf: _upserted(s, sf, force=True),
    "upsert_national_compat": lambda s, sf: _upserted(s, sf, compat=True),
    "upsert_school_rows": _named_results,
    "upsert_topnotchers": _topnotcher_upsert,
    "ingest_school_rows": _ingest_school_files,
    "merge_index": _merge_index,
    "import_job_islands": _jobs,
    "delete_cycles": lambda s, sf: _delete(s, sf)[0].exam_results.select("id"),
    "delete_audit": lambda s, sf: _delete(s, sf)[1].select("entity_id", "action"),
    "clean_after_delete": _clean_audit,
    "delete_program": _cascade,
    "gap_candidates": _gap_candidates,
    "missing_dual_cycles": lambda s, sf: ingest.missing_dual_cycles(b.registered(s, sf), b.START_YEAR, b.END_YEAR),
    "ingest_status": lambda s, sf: _ingest(s, sf).status,
    "ingest_announcements": lambda s, sf: _ingest(s, sf).tables.exam_results.select(
        "program_id", "month", "year", "total_takers", "total_passers", "pass_rate", "source_url"),
    "reingest_placeholders": _reingest,
    "direct_links": _direct_links,
    "throttle_events": _throttle,
    "throttle_streamed": _throttle_streamed,
}

