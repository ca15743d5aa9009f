"""The given trade tables read as the exam warehouse.

National series: brands (or registry programs) by month. Schools: market segments by half-year, suppliers as schools.
The expensive part, one pass over lineitem with its joins, is derived once per application into the shared folder
(`frames.staged`); every query then reads the small derived tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import literal_array, literal_frame, number_rows, staged, top_per_key
from ..functions import cycles as cy
from ..functions import names, numbers
from ..operators import schools as school_operators
from ..operators import search
from ..registry import MONTHS, NATIONAL_CSV_TAG, OFFICIAL_SITE, MIRROR_SITE, PROGRAMS
from ..schemas import Tables

AS_OF_YEAR = 2026
START_YEAR, END_YEAR = 2015, 2023


_sources: dict[tuple[str, str], DataFrame] = {}
_indexes: dict[tuple[str, str], search.TextIndex] = {}
_directories: dict[tuple[str, str], DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A source table; its file listing and schema are looked up once per application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{table}.parquet")
    if key not in _sources:
        _sources[key] = spark.read.parquet(key[1])
    return _sources[key]


def month_name(number: Column) -> Column:
    return F.element_at(literal_array(MONTHS), number)


def _passer() -> Column:
    return F.count_if(F.col("l_returnflag") != "R").alias("passers")


def national_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takers and passers by brand, month and line status: the only pass over lineitem of the national series."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("p_brand", (F.year("o_orderdate") + 20).alias("year"),
                     F.month("o_orderdate").alias("month_no"), "l_linestatus")
            .agg(F.count("*").alias("takers"), _passer()))


def _cycle_rows(counts: DataFrame) -> DataFrame:
    """Counts with program_id, exam_code, site_slug, wrong_slug turned into exam_results rows with known defects."""
    split = (F.col("program_id") % 5 == 0) & (F.col("month_no") == 5)
    phase = F.when(split & (F.col("l_linestatus") == "O"), 1).when(split, 2).otherwise(0)
    rows = (counts.withColumn("phase", phase)
            .groupBy("program_id", "exam_code", "site_slug", "wrong_slug", "year", "month_no", "phase")
            .agg(F.sum("takers").cast("int").alias("t"), F.sum("passers").cast("int").alias("p")))
    stamp = F.col("year") * 12 + F.col("month_no")
    placeholder, hidden = stamp % 11 == 0, stamp % 13 == 0
    rate = numbers.pass_rate(F.col("p"), F.col("t"))
    inflated = (F.col("program_id") % 8 == 0) & (F.col("month_no") == 7)
    kind = (F.col("program_id") + F.col("year")) % 4
    url_year = F.col("year") - F.when((F.col("program_id") % 9 == 0) & (F.col("month_no") == 3), 1).otherwise(0)
    slug = F.when((F.col("program_id") % 6 == 0) & (F.col("month_no") == 9), F.col("wrong_slug")).otherwise(
        F.col("site_slug"))
    month = month_name(F.col("month_no"))
    tail = F.concat(slug, F.lit("-results-"), F.lower(month), F.lit("-"), url_year.cast("string"))
    official = F.concat(F.lit(OFFICIAL_SITE + "/article/"), tail)
    mirror = F.concat(F.lit(MIRROR_SITE + "/"), tail, F.lit("-list-of-passers"))
    return rows.select(
        (((F.col("program_id") * 10000 + F.col("year")) * 100 + F.col("month_no")) * 10 + F.col("phase"))
        .cast("long").alias("id"),
        F.col("program_id").cast("long").alias("program_id"), "exam_code",
        F.concat(month, F.when(F.col("phase") == 1, " (Written)").when(F.col("phase") == 2, " (Practical)")
                 .otherwise("")).alias("month"),
        F.col("year").cast("int").alias("year"),
        F.when(placeholder, 0).when(hidden, None).otherwise(F.col("t")).cast("int").alias("total_takers"),
        F.when(placeholder, 0).otherwise(F.col("p")).cast("int").alias("total_passers"),
        F.when(placeholder, 0.0).when(hidden, None)
        .when(inflated, F.least(numbers.js_round(rate + 5, 2), F.lit(100.0))).otherwise(rate).alias("pass_rate"),
        F.when(F.col("program_id") % 7 == 0, mirror).when(kind.isin(0, 1), official).when(kind == 2, mirror)
        .otherwise(NATIONAL_CSV_TAG).alias("source_url"))


def _national_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "national_counts", sf_dir, lambda: national_counts(spark, sf_dir))


def brand_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        brands = read(spark, sf_dir, "part").select("p_brand").distinct()
        slug = names.slugify(F.col("p_brand"))
        number = F.dense_rank().over(Window.orderBy("p_brand"))  # one row per brand: the program list
        return brands.select(number.cast("long").alias("id"), F.col("p_brand").alias("exam_code"),
                             F.concat("p_brand", F.lit(" Licensure Examination")).alias("name"), slug.alias("slug"))
    return staged(spark, "brand_programs", sf_dir, build)


def registry_programs(spark: SparkSession) -> DataFrame:
    return literal_frame(
        spark, {"id": "long", "exam_code": "string", "name": "string", "level": "string", "slug": "string",
                "category": "string", "site_slug": "string"},
        [(i, p.exam_code, p.name, p.level, p.slug, p.category, p.site_slug) for i, p in enumerate(PROGRAMS, 1)])


def national(spark: SparkSession, sf_dir: str) -> Tables:
    """Brands as programs: 25 series."""
    programs = brand_programs(spark, sf_dir)

    def build() -> DataFrame:
        keyed = programs.select(F.col("id").alias("program_id"), F.col("exam_code"), F.col("slug").alias("site_slug"),
                                F.col("slug").alias("wrong_slug"))
        counts = _national_counts(spark, sf_dir)
        return _cycle_rows(counts.join(keyed, counts["p_brand"] == keyed["exam_code"]))

    return Tables(programs=programs, exam_results=staged(spark, "brand_cycles", sf_dir, build, ["year"]))


def registered(spark: SparkSession, sf_dir: str) -> Tables:
    """Brands folded onto the 15 registered programs, for everything that needs real codes, months and slugs."""
    programs = registry_programs(spark)

    def build() -> DataFrame:
        brands = brand_programs(spark, sf_dir).select(
            F.col("exam_code").alias("p_brand"), ((F.col("id") - 1) % len(PROGRAMS) + 1).alias("program_id"))
        following = programs.select((F.col("id") - 1).alias("program_id"), F.col("site_slug").alias("wrong_slug"))
        keyed = (programs.select(F.col("id").alias("program_id"), "exam_code", "site_slug")
                 .join(following, "program_id", "left"))
        return _cycle_rows(_national_counts(spark, sf_dir).join(brands, "p_brand").join(keyed, "program_id"))

    return Tables(programs=programs, exam_results=staged(spark, "registry_cycles", sf_dir, build, ["year"]))


def _segment_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", *extra)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("year", F.year("o_orderdate") + 20)
            .withColumn("half", F.when(F.month("o_orderdate") <= 6, 1).otherwise(2)))


CYCLE = ["c_mktsegment", "year", "half"]
TOP = 10
NO_DATE = -1 << 29  # half-year of an order without a date, beyond any timestamp


def school_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takers and passers of a school in a cycle: the only pass over all of lineitem for the school tables.

    Orders get their segment before they meet the lines, which move once by order and once by school. Most lines of a task
    are of different schools, so they are not added up beside the sorted join, where the sums of many groups would be held
    together with the rows being sorted, but after their exchange. What moves is kept narrow: an order's date is its
    half-year, and past their orders the half-year and the outcome of a line are one number."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_returnflag") != "R").alias("passed"))
    later = F.when(F.month("o_orderdate") <= 6, 0).otherwise(1)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                                  ((F.year("o_orderdate") + 20) * 2 + later).alias("halves"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "halves")
    mark = F.coalesce("halves", F.lit(NO_DATE)) * 2 + F.coalesce(F.col("passed").cast("int"), F.lit(0))
    rows = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select("c_mktsegment", "l_suppkey", mark.alias("mark"))
    halves, passed = F.shiftright("mark", 1), F.col("mark").bitwiseAND(1) == 1
    moved = rows.repartition("c_mktsegment", halves, "l_suppkey").select(
        "c_mktsegment", halves.alias("halves"), "l_suppkey", passed.alias("passed"))
    dated = F.col("halves") != NO_DATE
    year = F.when(dated, F.shiftright("halves", 1))
    half = F.when(dated & (F.col("halves") % 2 == 0), 1).otherwise(2)
    return (moved.groupBy("c_mktsegment", "halves", "l_suppkey")
            .agg(F.count("*").alias("takers"), F.count_if("passed").alias("passers"))
            .select("c_mktsegment", year.alias("year"), half.alias("half"), "l_suppkey", "takers", "passers"))


def _school_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, "school_counts", sf_dir, lambda: school_counts(spark, sf_dir))


PROBED = 64


def _dearest_known(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """The highest price of each school in a cycle among every `PROBED`-th order, and a row without a price for each cycle
    at all: a floor under a cycle's dearest lines holds, whatever lines it is taken from, if that cycle has enough of them."""
    some = lines.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(PROBED)) == 0)
    best = some.groupBy(*CYCLE, "l_suppkey").agg(F.max("l_extendedprice").alias("best"))
    return best.unionByName(counts.select(*CYCLE).distinct(), allowMissingColumns=True)


def _least_price(counts: DataFrame) -> float | None:
    """A price that no line among the `TOP` dearest of any cycle is below: the lines that are the dearest of their schools
    are as many different lines, so a cycle's `TOP`-th line costs at least what its `TOP`-th school's dearest does. None
    if a cycle has fewer schools with a price."""
    schools = top_per_key(counts, CYCLE, [F.desc_nulls_last("best"), F.asc("l_suppkey")], TOP, "place")
    floors = schools.groupBy(*CYCLE).agg(F.count("best").alias("n"), F.min("best").alias("floor"))
    least = floors.agg(F.min("floor").alias("floor"), F.min("n").alias("n")).first()
    return least["floor"] if least["n"] == TOP else None


def segment_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        segments = read(spark, sf_dir, "customer").select("c_mktsegment").distinct()
        number = F.row_number().over(Window.orderBy("c_mktsegment"))  # one row per segment: the program list
        return segments.select(number.cast("long").alias("id"), F.col("c_mktsegment").alias("exam_code"),
                               F.concat("c_mktsegment", F.lit(" Licensure Examination")).alias("name"),
                               names.slugify(F.col("c_mktsegment")).alias("slug"))
    return staged(spark, "segment_programs", sf_dir, build)


def _segment_cycles(counts: DataFrame, programs: DataFrame) -> DataFrame:
    keyed = programs.select(F.col("id").alias("program_id"), F.col("exam_code").alias("c_mktsegment"), "slug")
    return (counts.join(keyed, "c_mktsegment")
            .withColumn("cycle_id", ((F.col("program_id") * 10000 + F.col("year")) * 10 + F.col("half")).cast("long")))


def _school_tables(spark: SparkSession, sf_dir: str, people: bool) -> Tables:
    programs = segment_programs(spark, sf_dir)
    counts = _school_counts(spark, sf_dir)

    def results() -> DataFrame:
        sums = (_segment_cycles(counts, programs).groupBy("cycle_id", "program_id", "slug", "year", "half")
                .agg(F.sum("takers").cast("int").alias("t"), F.sum("passers").cast("int").alias("p")))
        placeholder = (F.col("program_id") + F.col("year") * 2 + F.col("half")) % 11 == 0
        month = F.when(F.col("half") == 1, "May").otherwise("November")
        return sums.select(
            F.col("cycle_id").alias("id"), "program_id", month.alias("month"), F.col("year").cast("int").alias("year"),
            F.when(placeholder, 0).otherwise(F.col("t")).alias("total_takers"),
            F.when(placeholder, 0).otherwise(F.col("p")).alias("total_passers"),
            F.when(placeholder, 0.0).otherwise(numbers.pass_rate(F.col("p"), F.col("t"))).alias("pass_rate"),
            F.concat(F.lit(OFFICIAL_SITE + "/article/"), "slug", F.lit("-results-"), F.lower(month), F.lit("-"),
                     F.col("year").cast("string")).alias("source_url"))

    def performance() -> DataFrame:
        rows = _segment_cycles(counts, programs).select(
            F.col("cycle_id").alias("exam_result_id"), F.col("l_suppkey").cast("long").alias("school_id"),
            F.col("takers").cast("int").alias("takers"), F.col("passers").cast("int").alias("passers"),
            numbers.pass_rate(F.col("passers"), F.col("takers")).alias("pass_rate"))
        ranked = number_rows(rows, ["exam_result_id"],
                             [F.desc("pass_rate"), F.desc("takers"), F.asc("school_id")], "rank")
        unknown = (F.col("school_id") + F.col("exam_result_id")) % 17 == 0
        return ranked.select(
            (F.col("exam_result_id") * 10_000_000_000 + F.col("school_id")).alias("id"), "exam_result_id", "school_id",
            "takers", "passers", F.when(~unknown, F.col("pass_rate")).alias("pass_rate"),
            F.when(~unknown, F.col("rank").cast("int")).alias("rank"))

    def topnotchers() -> DataFrame:
        lines = _segment_lines(spark, sf_dir, "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
        least = _least_price(_dearest_known(lines, counts))
        if least is not None:  # reaches the scan: few lines are joined at all
            lines = lines.where(F.col("l_extendedprice") >= least)
        best = top_per_key(lines, CYCLE,
                           [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"),
                            F.asc("l_partkey"), F.asc("l_suppkey")], TOP, "rank")
        schools = _schools(spark, sf_dir).select(F.col("id").alias("l_suppkey"), F.col("name").alias("school"))
        people = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
        return (_segment_cycles(best, programs).join(schools, "l_suppkey").join(people, "c_custkey")
                .select((F.col("cycle_id") * 100 + F.col("rank")).alias("id"),
                        F.col("cycle_id").alias("exam_result_id"), F.col("rank").cast("int").alias("rank"),
                        F.col("c_name").alias("name"), F.concat("school", F.lit(" - Main")).alias("school"),
                        numbers.js_round(F.lit(75.0) + F.col("l_discount") * 200, 2).alias("rating")))

    return Tables(
        programs=programs,
        exam_results=staged(spark, "segment_cycles", sf_dir, results, ["year"]),
        school_performance=staged(spark, "school_performance", sf_dir, performance, ["exam_result_id"]),
        topnotchers=staged(spark, "topnotchers", sf_dir, topnotchers) if people else None,
    )


def _schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = read(spark, sf_dir, "nation")
    name = F.concat("n_name", F.lit(" State University "), F.col("s_suppkey").cast("string"))
    return (suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").cast("long").alias("id"), name.alias("name"), names.slugify(name).alias("slug"),
                    F.when(F.col("s_suppkey") % 10 != 9, F.col("n_regionkey")).cast("long").alias("region_id"),
                    F.col("n_nationkey").cast("long").alias("province_id"),
                    F.element_at(F.array(F.lit("Public"), F.lit("Private"), F.lit("Local")),
                                 (F.col("s_suppkey") % 3 + 1).cast("int")).alias("school_type")))


def schools(spark: SparkSession, sf_dir: str, people: bool = True) -> Tables:
    """Market segments as programs, suppliers as schools; top examinees, which take a pass of their own, if asked for."""
    made = _school_tables(spark, sf_dir, people)
    regions = read(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"),
        F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("code"))
    provinces = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region_id"),
        F.col("n_name").alias("name"))
    return Tables(programs=made.programs, regions=regions, provinces=provinces, schools=_schools(spark, sf_dir),
                  exam_results=made.exam_results, school_performance=made.school_performance,
                  topnotchers=made.topnotchers)


def search_index(spark: SparkSession, sf_dir: str) -> search.TextIndex:
    """The gram dictionary of schools, top examinees and programs, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = search.search_index(schools(spark, sf_dir))
    return _indexes[key]



def defective_schools(spark: SparkSession, sf_dir: str) -> Tables:
    """The school tables with planted defects for the quality checks."""
    t = schools(spark, sf_dir)
    mark = F.col("school_id") + F.col("exam_result_id")
    rows = (t.school_performance.where(F.col("exam_result_id") % 23 != 0)
            .withColumn("pass_rate", F.when(mark % 103 == 0, 120.0).otherwise(F.col("pass_rate")))
            .withColumn("passers", F.when(mark % 107 == 0, F.col("takers") + 1).otherwise(F.col("passers"))))
    copies = F.when(mark % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = (rows.withColumn("_copy", F.explode(copies))
            .withColumn("id", F.when(F.col("_copy") == 1, -F.col("id")).otherwise(F.col("id"))).drop("_copy"))
    stem = F.regexp_replace("name", r" \d+$", "")
    name = (F.when(F.col("id") % 14 == 3, F.concat(F.lit(" "), F.upper(stem)))
            .when(F.col("id") % 7 == 3, stem).otherwise(F.col("name")))
    return Tables(programs=t.programs, regions=t.regions, provinces=t.provinces,
                  schools=t.schools.withColumn("name", name), exam_results=t.exam_results, school_performance=rows,
                  topnotchers=t.topnotchers)


def logs(spark: SparkSession, sf_dir: str) -> Tables:
    events = read(spark, sf_dir, "events")
    talk = read(spark, sf_dir, "conversations")
    return Tables(
        programs=segment_programs(spark, sf_dir),
        import_jobs=events.select(
            F.col("event_id").alias("id"), (F.col("user_id") % 5 + 1).alias("program_id"),
            F.col("event_type").alias("status"), F.floor("value").cast("int").alias("rows_affected"),
            F.col("ts").alias("started_at"), F.col("props").alias("notes")),
        audit_logs=events.select(
            F.col("event_id").alias("id"), F.lit("scraper").alias("actor"), F.col("event_type").alias("action"),
            F.lit("exam_results").alias("entity"), F.col("user_id").alias("entity_id"), F.col("props").alias("detail"),
            F.col("ts").alias("created_at")),
        creator_feedback=talk.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("name"),
            F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("invalid "), F.col("conv_id").cast("string")))
            .otherwise(F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@example.com"))).alias("email"),
            F.col("text").alias("message")))


def link_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered announcements: two thirds of the cycles, some absent ones, some repeats of lower or equal rank."""
    t = registered(spark, sf_dir)
    rows = t.exam_results.join(t.programs.select(F.col("id").alias("program_id"), "name"), "program_id")
    mark = F.expr("id div 10")
    base = rows.where(mark % 3 != 0).select(
        "exam_code", F.when(mark % 20 == 1, F.col("year") + 10).otherwise(F.col("year")).cast("int").alias("year"),
        "month", F.col("source_url").alias("url"),
        F.when(mark % 3 == 1, "prc.gov.ph").otherwise("prcboard.com").alias("source"),
        F.lit("search").alias("discovered_via"), F.col("id").alias("post_id"),
        F.concat("name", F.lit(" Results "), F.col("month"), F.lit(" "), F.col("year").cast("string"),
                 F.lit(" List of Passers")).alias("title"), mark.alias("mark"))
    lower = base.where(F.col("mark") % 5 == 0).select(
        "exam_code", "year", "month", "url", F.lit("prcboard.com/direct").alias("source"),
        F.lit("direct_url").alias("discovered_via"), (F.col("post_id") + 1).alias("post_id"), "title", "mark")
    equal = base.where(F.col("mark") % 7 == 0).select(
        "exam_code", "year", "month", "url", "source", F.lit("search_again").alias("discovered_via"),
        (F.col("post_id") + 2).alias("post_id"), "title", "mark")
    return base.unionByName(lower).unionByName(equal).drop("mark")


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result page per registered cycle, worded in one of the six usual ways."""
    t = registered(spark, sf_dir)
    rows = t.exam_results.join(t.programs.select(F.col("id").alias("program_id"), "name"), "program_id")
    p, k = numbers.grouped_text(F.col("total_passers")), numbers.grouped_text(F.col("total_takers"))
    f = numbers.grouped_text(F.col("total_takers") - F.col("total_passers"))
    r = F.format_string("%.2f", F.col("pass_rate"))
    style = (F.col("program_id") + F.col("year") + cy.month_number(F.col("month"))) % 6
    sentence = (
        F.when(~numbers.complete(), F.lit("The list of passers will follow."))
        .when(style == 0, F.concat(p, F.lit(" out of "), k, F.lit(" ("), r, F.lit("%) made it.")))
        .when(style == 1, F.concat(p, F.lit(" out of "), k, F.lit(" passed the exam.")))
        .when(style == 2, F.concat(p, F.lit(" passed and "), f, F.lit(" failed out of "), k, F.lit(" who sat.")))
        .when(style == 3, F.concat(F.lit("A passing rate of "), r, F.lit("% with "), p, F.lit(" out of "), k,
                                   F.lit(" examinees.")))
        .when(style == 4, F.concat(k, F.lit(" examinees gave "), p, F.lit(" passers, or "), r, F.lit("%.")))
        .otherwise(F.concat(F.lit("Total number of passers: "), p, F.lit("; examinees: "), k, F.lit("."))))
    title = F.concat("name", F.lit(" Results "), F.col("month"), F.lit(" "), F.col("year").cast("string"))
    return rows.select(
        "id", "exam_code", "year", "month", F.col("source_url").alias("url"),
        F.when(F.col("source_url").contains("prc.gov.ph"), "prc.gov.ph")
        .when(F.col("source_url").contains("prcboard"), "prcboard.com").otherwise("unknown").alias("source"),
        title.alias("title"),
        F.concat(F.lit("<html><head><title>"), title, F.lit("</title><script>x(1);</script></head><body><p>The "),
                 "name", F.lit(" of "), F.col("month"), F.lit(" "), F.col("year").cast("string"),
                 F.lit(" is over.</p>\n<p>"), sentence, F.lit("</p></body></html>")).alias("html"))


def school_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored directory of schools, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _directories:
        _directories[key] = school_operators.school_directory(schools(spark, sf_dir), blocks=16)
    return _directories[key]
