"""Files in and out: national CSV, school CSV folders, link indexes, reports, seed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import literal_array, literal_frame, materialize
from ..functions import links, names, numbers
from ..operators import national, rankings, schools, series
from ..operators.writes import stats_error, upsert_keeping_ids
from ..registry import NATIONAL_CSV_TAG, PROGRAMS, PROVINCES, REGIONS, WINDOW_YEARS
from ..schemas import COLUMNS, Tables

NATIONAL_COLUMNS = ("exam_code", "month", "year", "total_passers", "total_takers", "pass_rate")


def read_national_csv(spark: SparkSession, path: str) -> DataFrame:
    """A national CSV, or a folder of them, as text columns; every file is read by its own header, so the order and the
    number of columns may differ from file to file. A file without the required ones is refused."""
    records = read_csv_records(spark, path)
    wanted = (*NATIONAL_COLUMNS, "source_url")
    heads = csv_heads(records).select("file", F.transform(literal_array(wanted), lambda c: F.coalesce(
        F.array_position(F.transform("header", lambda h: F.trim(h)), c), F.lit(0).cast("long"))).alias("at"))
    required = literal_array(NATIONAL_COLUMNS)
    lacking = heads.select("file", F.filter(required, lambda c, i: F.get(F.col("at"), i) == 0).alias("missing"))
    refused = lacking.where(F.size("missing") > 0).orderBy("file").first()
    if refused:
        raise ValueError(f"missing columns {refused['missing']} in {refused['file']}")
    body = records.where((F.col("record_no") > 1) & (F.col("text") != "")).select("file", csv_cells(F.col("text")).alias("cells"))
    value = lambda i: F.nullif(F.get("cells", (F.get("at", F.lit(i)) - 1).cast("int")), F.lit(""))
    return body.join(heads, "file").select(*[value(i).alias(c) for i, c in enumerate(wanted)])


def check_national_rows(rows: DataFrame) -> DataFrame:
    """Typed rows with the reason of refusal: unknown code, unreadable number, or unsound statistics."""
    takers, passers = numbers.to_int(F.col("total_takers")), numbers.to_int(F.col("total_passers"))
    rate, year = numbers.to_rate(F.col("pass_rate")), numbers.to_int(F.col("year"))
    typed = rows.select(
        names.resolve_code(F.trim("exam_code")).alias("exam_code"), F.trim("month").alias("month"), year.alias("year"),
        passers.alias("total_passers"), takers.alias("total_takers"), rate.alias("pass_rate"),
        F.coalesce(F.nullif(F.trim("source_url"), F.lit("")), F.lit(NATIONAL_CSV_TAG)).alias("source_url"))
    unreadable = (F.col("year").isNull() | F.col("total_passers").isNull() | F.col("total_takers").isNull()
                  | F.col("pass_rate").isNull())
    reason = F.when(F.col("exam_code").isNull(), "unknown exam_code").when(unreadable, "bad_number").otherwise(
        stats_error(F.col("total_takers"), F.col("total_passers"), F.col("pass_rate")))
    return typed.withColumn("reason", reason)


# Accepted header spellings of school files, by canonical column, in order of preference.
HEADERS: dict[str, tuple[str, ...]] = {
    "rank": ("rank", "ranking", "#"),
    "school": ("school", "school_name", "name", "institution"),
    "takers": ("takers", "no_of_examinees", "examinees", "no_examinees"),
    "passers": ("passers", "no_of_passers", "passed", "no_passers"),
    "pass_rate": ("pass_rate", "passing_rate", "rate", "percentage", "%"),
}
# A record runs to a line end outside quotes; a cell is quoted or free of commas.
_RECORD = r'((?:[^"\r\n]++|"[^"]*+"|")*+)(\r\n|\n|\r|$)'
_CELL = r'(\s*"[^"]*+(?:""[^"]*+)*+"\s*|[^,]*+),'


def csv_records(text: Column) -> Column:
    """Records of a CSV text; quoted cells may hold line ends."""
    return F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))


def csv_cells(record: Column) -> Column:
    """Cells of a record of any width, unquoted."""
    def plain(cell: Column) -> Column:
        bare = F.trim(cell)
        quoted = bare.startswith('"') & bare.endswith('"') & (F.length(bare) >= 2)
        return F.when(quoted, F.replace(F.substr(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)

    return F.transform(F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_CELL), F.lit(1)), plain)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, file_name, size) of every file of a folder; no content is read. Spark's readers leave empty files out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("file"), _last_part(F.col("path")).alias("file_name"), F.col("length").alias("size"))


def _last_part(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def read_csv_records(spark: SparkSession, path: str, pattern: str = "*", name: Column | None = None) -> DataFrame:
    """(file, file_name, record_no, text) of CSV files of any size; records are numbered from 1 in each file.

    Files are read in splits. A line begins a record if the quotes before it in its file are even in number: each block
    (the part of a file in one split) counts its quotes, the counts are added up over the blocks before, and the lines
    of a block add to that. So a quoted line end is known as such wherever a split falls; it is read as a line feed.
    A last quote without a partner is a plain character. `name` gives the file name if it is not the last part of the
    path. Blank lines are records, empty files have none.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path, pathGlobFilter=pattern).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long").alias("quotes"))
    in_file, before = Window.partitionBy("file"), Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("held"), F.max(F.when(F.col("quotes") > 0, F.col("line"))).alias("last"))
    blocks = blocks.select(
        "file", "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"),
        # the line whose last quote has no partner
        F.when((F.sum("held").over(in_file) % 2 == 1) & (F.col("block") == F.max(F.when(F.col("held") > 0, F.col("block"))).over(in_file)),
               F.col("last")).alias("stray"))
    so_far = Window.partitionBy("file", "block").orderBy("line")
    own = F.col("quotes") - F.coalesce(F.col("line") == F.col("stray"), F.lit(False)).cast("long")
    lines = lines.join(blocks, ["file", "block"]).withColumn("own", own)
    begins = (F.col("before") + F.sum("own").over(so_far) - F.col("own")) % 2 == 0
    lines = materialize(lines.select("file", "block", "line", "text", "own", begins.alias("begins")), "lines")
    starts = lines.groupBy("file", "block").agg(F.count_if("begins").alias("starts"))
    starts = starts.select("file", "block", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("before"))
    numbered = lines.join(starts, ["file", "block"]).withColumn(
        "record_no", F.col("before") + F.sum(F.col("begins").cast("long")).over(so_far))
    whole = F.col("begins") & (F.col("own") % 2 == 0)
    parts = numbered.where(~whole).groupBy("file", "record_no").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("lines"))
    records = numbered.where(whole).select("file", "record_no", "text").unionByName(parts.select(
        "file", "record_no", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text")))
    first = F.regexp_replace("text", "^\ufeff", "")
    return records.select("file", (name if name is not None else _last_part(F.col("file"))).alias("file_name"), "record_no",
                          F.when(F.col("record_no") == 1, first).otherwise(F.col("text")).alias("text"))


def text_records(files: DataFrame) -> DataFrame:
    """The records of small CSV texts that are rows already (file_name, content), in the form of `read_csv_records`."""
    named = files.select(F.monotonically_increasing_id().cast("string").alias("file"), "file_name",
                         csv_records(F.regexp_replace("content", "^\ufeff", "")).alias("lines"))
    return named.select("file", "file_name", F.posexplode("lines").alias("at", "text")).select(
        "file", "file_name", (F.col("at") + 1).cast("long").alias("record_no"), "text")


def csv_heads(records: DataFrame) -> DataFrame:
    """(file, file_name, header): the cells of the first record of each file."""
    return records.where("record_no = 1").select("file", "file_name", csv_cells(F.col("text")).alias("header"))


def file_cycle(name: Column) -> Column:
    """struct(month, year) from `CELE_May_2019.csv` or `May_2019.csv`; null for any other name."""
    pattern = r"(?i)^(?:cele_)?(march|may|nov|november|april)_(\d{4})(?:\.(?:csv|xlsx|xls))*$"
    return _cycle_of(name, pattern)


def _cycle_of(name: Column, pattern: str) -> Column:
    month = F.initcap(F.regexp_extract(name, pattern, 1))
    month = F.when(month == "Nov", "November").otherwise(month)
    return F.when(month != "", F.struct(month.alias("month"), F.regexp_extract(name, pattern, 2).cast("int").alias(
        "year")))


def _normal_header(text: Column) -> Column:
    """Header in lower case with single underscores; a header of symbols only (`#`, `%`) stays as it is."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", F.trim(text)).otherwise(plain)


def _positions(heads: DataFrame) -> DataFrame:
    """Per file and canonical column, the 1-based position of its first accepted header; 0 if absent."""
    aliases = F.transform(literal_array(list(HEADERS.values())), lambda names_: F.transform(names_, _normal_header))

    def positions(h: Column) -> Column:
        return F.transform(aliases, lambda options: F.coalesce(F.get(F.filter(F.transform(
            options, lambda a: F.array_position(h, a)), lambda p: p > 0), F.lit(0)), F.lit(0).cast("long")))

    kept = [c for c in heads.columns if c != "header"]
    return heads.select(*kept, links.once(F.transform("header", _normal_header), positions).alias("at"))


def _records(files: DataFrame) -> DataFrame:
    return text_records(files) if "content" in files.columns else files


def school_file_errors(files: DataFrame) -> DataFrame:
    """Files that lack required columns, with the missing ones. `files` are records or texts."""
    names_ = literal_array(list(HEADERS))
    missing = F.filter(names_, lambda c, i: F.get(F.col("at"), i) == 0)
    # An exploded constant keeps the header reading from being repeated in filter and projection.
    heads = _positions(csv_heads(_records(files)))
    return heads.select("file_name", F.explode(F.array(F.array_join(missing, ", "))).alias("missing")).where("missing <> ''")


_BODY = "record_no > 1 AND trim(text) <> ''"


def _file_bodies(records: DataFrame) -> DataFrame:
    """Records below a usable header, with the places of its columns."""
    usable = _positions(csv_heads(records)).where(F.forall("at", lambda p: p > 0)).select("file", "at")
    return records.where(_BODY).join(usable, "file")


def _text_bodies(files: DataFrame) -> DataFrame:
    """The same of texts that are rows already. A text brings its header along: nothing names its row, and rows counted in
    two readings of a shuffle need not come in the same order."""
    cut = files.select("file_name", csv_records(F.regexp_replace("content", "^\ufeff", "")).alias("lines"))
    usable = _positions(cut.withColumn("header", csv_cells(F.get("lines", F.lit(0))))).where(F.forall("at", lambda p: p > 0))
    return usable.select("file_name", "at", F.posexplode("lines").alias("_at", "text")).withColumn(
        "record_no", (F.col("_at") + 1).cast("long")).where(_BODY)


def school_csv_rows(files: DataFrame) -> DataFrame:
    """School rows of CSV files whose headers may differ from file to file, with the region read off the name. `files`
    are records of `read_csv_records` or texts (file_name, content)."""
    rows = (_text_bodies(files) if "content" in files.columns else _file_bodies(files)).withColumn("cells", csv_cells(F.col("text")))
    order = list(HEADERS)

    def cell(name: str) -> Column:
        return F.get("cells", (F.get("at", F.lit(order.index(name))) - 1).cast("int"))

    school = F.trim(cell("school"))
    return rows.where(school != "").select(
        F.col("file_name").alias("doc_id"), F.col("record_no").cast("int").alias("line_no"), school.alias("school"),
        numbers.to_int(cell("rank")).alias("rank"), numbers.to_int(cell("takers")).alias("takers"),
        numbers.to_int(cell("passers")).alias("passers"), numbers.to_rate(cell("pass_rate")).alias("pass_rate"),
        names.infer_region(school).alias("region"))


def folder_cycles(files: DataFrame) -> DataFrame:
    """Files of a folder with the cycle in their name; the others are marked skipped."""
    cycle = file_cycle(F.col("file_name"))
    return files.select("file_name", F.when(cycle.isNull(), "skipped").otherwise("matched").alias("status"),
                        cycle["month"].alias("month"), cycle["year"].alias("year"))


def read_link_index(spark: SparkSession, path: str, exam_code: str | None = None) -> DataFrame:
    """A link index: files that are JSON arrays of announcements; anything else is refused."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.ltrim("value").alias("line"),
                                         F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    start = lines.where("line <> ''").groupBy("file").agg(F.min_by(F.substring("line", 1, 1), "at").alias("c"))
    if start.where("c <> '['").take(1):
        raise ValueError("index must be a JSON array")
    rows = spark.read.schema(COLUMNS["link_index"]).json(path, multiLine=True)
    return rows.where(F.col("exam_code") == exam_code) if exam_code else rows


def write_link_index(rows: DataFrame, folder: str) -> DataFrame:
    """Index as CSV and JSON lines in order of program and cycle; returns the rows per program."""
    ordered = rows.orderBy("exam_code", "year", "month")
    ordered.write.mode("overwrite").option("header", True).csv(f"{folder}/national_links_csv")
    ordered.write.mode("overwrite").json(f"{folder}/national_links_json")
    return index_counts(rows)


def index_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("exam_code").agg(F.count("*").alias("links"))


def write_drive_links(rows: DataFrame, folder: str) -> DataFrame:
    """Drive links as CSV and JSON lines; returns the number found per year."""
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/drive_links_csv")
    rows.write.mode("overwrite").json(f"{folder}/drive_links_json")
    return drive_counts(rows)


def drive_counts(rows: DataFrame) -> DataFrame:
    return rows.where("drive_file_id <> ''").groupBy("year").agg(F.count("*").alias("found"))


def report(kind: str, tables: Tables, as_of_year: int, exam_code: str | None = None, year: int | None = None,
           region: str | None = None, min_takers: int | None = None, years: int = WINDOW_YEARS,
           limit: int | None = None) -> DataFrame:
    """The five export reports by name; rankings and top schools are whole unless a limit is given."""
    if kind in ("rankings", "exam_top", "exam_history") and exam_code is None:
        raise ValueError("exam_code is required")
    if kind == "rankings":
        return rankings.rankings(tables, exam_code, year, region=region, min_takers=min_takers, limit=limit)
    if kind == "exam_top":
        return rankings.top_schools(tables, exam_code, year, limit=limit)
    if kind == "regions":
        return schools.regional_analytics(tables, exam_code)
    if kind == "exams":
        return national.exam_summary(tables, as_of_year)
    if kind == "exam_history":
        span = min(WINDOW_YEARS, max(1, years))
        rows = series.series(tables, as_of_year, span)
        return series.history_report(rows.where(F.upper("exam_code") == exam_code.upper()))
    raise ValueError(f"unknown report {kind!r}")


def write_report(rows: DataFrame, path: str) -> None:
    if not rows.take(1):
        raise ValueError("nothing to export")
    rows.write.mode("overwrite").option("header", True).csv(path)


def seed(spark: SparkSession, tables: Tables) -> Tables:
    """Registry rows on top of existing tables: programs are updated, regions and provinces kept as they are."""
    programs = literal_frame(spark, {"arrival": "long", "exam_code": "string", "name": "string", "level": "string",
                                     "slug": "string"},
                             [(i, p.exam_code, p.name, p.level, p.slug) for i, p in enumerate(PROGRAMS, 1)])
    regions = literal_frame(spark, {"arrival": "long", "name": "string", "code": "string"},
                            [(i, *r) for i, r in enumerate(REGIONS, 1)])
    provinces = literal_frame(spark, {"arrival": "long", "region_name": "string", "name": "string"},
                              [(i, *p) for i, p in enumerate(PROVINCES, 1)])
    all_regions = upsert_keeping_ids(tables.regions, regions, ["name"], "ignore")
    located = provinces.join(all_regions.select(F.col("id").alias("region_id"), F.col("name").alias("region_name")),
                             "region_name").select("arrival", "region_id", "name")
    return Tables(programs=upsert_keeping_ids(tables.programs, programs, ["exam_code"]), regions=all_regions,
                  provinces=upsert_keeping_ids(tables.provinces, located, ["region_id", "name"], "ignore"))
