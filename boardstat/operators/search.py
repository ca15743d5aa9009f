"""Substring search at scale: school directory search for many queries, top examinees of a school, year and month words.

Containment is looked up in the stored gram dictionary of `gram_index`: an equi join on grams, then the exact test. Equal
searches are answered once; no side is broadcast by force and no pair is formed that does not share a gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import literal_array, top_per_key
from ..functions import names
from ..registry import MONTHS
from ..schemas import Tables
from .gram_index import TextIndex, build_index, containing_all, one_entity
from .national import with_order, with_program


SCHOOL, PERSON, ALMA_MATER, PROGRAM = "school", "topnotcher", "topnotcher_school", "exam"


def search_index(tables: Tables) -> TextIndex:
    """The stored dictionary of everything that can be searched: school names, top examinees and their schools, and
    the names, codes and slugs of programs."""
    people, programs = tables.topnotchers, tables.programs
    fields = F.explode(F.array(F.lower("name"), F.lower("exam_code"), F.col("slug")))
    rows = one_entity(tables.schools.select(F.lower("name").alias("text")), SCHOOL)
    for frame, entity in ((people.select(F.lower("name").alias("text")), PERSON),
                          (people.select(F.lower("school").alias("text")), ALMA_MATER),
                          (programs.select(fields.alias("text")), PROGRAM)):
        rows = rows.union(one_entity(frame, entity))
    return build_index(rows)


def containing_pairs(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """All (pattern, text) with the pattern inside the text. Both frames hold distinct lower-cased strings."""
    index = build_index(one_entity(texts))
    sets = patterns.select(F.lit("text").alias("entity"), F.array("pattern").alias("tokens"))
    return containing_all(sets, index).select(F.get("tokens", F.lit(0)).alias("pattern"), "text")


def school_topnotchers(tables: Tables, index: TextIndex | None = None) -> DataFrame:
    """Top examinees whose school text contains the name of a school."""
    schools = tables.schools.select(F.col("id").alias("school_id"), F.array(F.lower("name")).alias("tokens"))
    people = tables.topnotchers.select("id", "exam_result_id", "rank", "name", "rating", F.lower("school").alias("text"))
    pairs = containing_all(schools.select(F.lit(ALMA_MATER).alias("entity"), "tokens"),
                           index or build_index(one_entity(people, ALMA_MATER))).drop("entity")
    cycles = with_program(tables).select(F.col("id").alias("exam_result_id"), "exam_code", "exam_fullname", "year",
                                         "month")
    found = people.join(pairs, "text").join(schools, "tokens").drop("text", "tokens")
    return found.join(cycles, "exam_result_id").drop("exam_result_id")


def match_schools(schools: DataFrame, sets: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """(tokens, school_id, name) where the school name holds every token; `sets` has distinct token arrays, not empty."""
    named = schools.select(F.col("id").alias("school_id"), "name", F.lower("name").alias("text"))
    found = containing_all(sets.select(F.lit(SCHOOL).alias("entity"), "tokens"), index or build_index(one_entity(named, SCHOOL)))
    return found.join(named, "text").select("tokens", "school_id", "name")


def search_counts(schools: DataFrame, queries: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """Schools found by each query (query_id, tokens); every distinct set of tokens is counted once."""
    counts = match_schools(schools, queries.select("tokens").distinct(), index).groupBy("tokens").agg(
        F.count("*").alias("schools"))
    return queries.join(counts, "tokens").select("query_id", "schools")


def search_cycles(tables: Tables, queries: DataFrame) -> DataFrame:
    """Cycles asked for by year and month words in a search text (query_id, query); the other words must all be in the
    program's code, name or slug. Texts without a year or month ask for no cycle."""
    lists = F.split(F.lower(F.trim("query")), r"\s+")
    months = literal_array([m.lower() for m in MONTHS])

    def month(word: Column) -> Column:
        return F.array_position(F.transform(months, lambda m: (m == word) | (F.substring(m, 1, 3) == word)), F.lit(True))

    is_year = lambda w: w.rlike(r"^(19|20)\d{2}$")
    asked = queries.select("query_id", lists.alias("words")).select(
        "query_id", F.coalesce(F.get(F.filter("words", is_year), F.lit(0)).cast("int"), F.lit(0)).alias("asked_year"),
        F.coalesce(F.array_max(F.transform("words", month)), F.lit(0)).cast("int").alias("asked_month"),
        F.filter("words", lambda w: ~is_year(w) & (month(w) == 0)).alias("rest"))
    cycles = with_order(with_program(tables)).select(
        F.col("id").alias("exam_result_id"), "exam_code", "year", "month", F.lower(F.concat_ws(
            " ", "exam_code", "exam_fullname", "slug")).alias("text"),
        F.explode(F.array(F.struct(F.col("year").alias("asked_year"), F.col("month_no").alias("asked_month")),
                          F.struct(F.col("year").alias("asked_year"), F.lit(0).alias("asked_month")),
                          F.struct(F.lit(0).alias("asked_year"), F.col("month_no").alias("asked_month")))).alias("key"))
    rows = cycles.select("*", "key.*").drop("key").join(asked.where("asked_year > 0 or asked_month > 0"),
                                                        ["asked_year", "asked_month"])
    return rows.where(F.forall("rest", lambda w: F.contains(F.col("text"), w))).select(
        "query_id", "exam_result_id", "exam_code", "year", "month")


def global_search(tables: Tables, queries: DataFrame, school_limit: int = 25, person_limit: int = 5,
                  index: TextIndex | None = None) -> DataFrame:
    """Answers to a table of search texts (query_id, query): schools, top examinees and programs, tagged by entity.

    All three are looked up together in the stored dictionary of `search_index`; without one it is written first. Equal
    sets of words are matched once and cut to their first rows before the queries are attached.
    """
    index = index or search_index(tables)
    text = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    tokens = names.search_tokens(F.col("query"))
    trimmed, whole = F.trim("query"), F.lower("query")
    nothing = F.array().cast("array<string>")
    # A text without tokens but of two letters or more is looked up whole; anything shorter restricts nothing.
    by_school = F.when(F.size(tokens) > 0, tokens).when(F.length(trimmed) >= 2, F.array(F.lower(trimmed))).otherwise(nothing)
    by_person = F.when(whole != "", F.array(whole)).otherwise(nothing)
    by_program = F.when(trimmed != "", F.array(whole)).otherwise(nothing)
    asked = text.select("query_id", F.explode(F.array(*[
        F.struct(F.lit(entity).alias("entity"), sets.alias("tokens"))
        for entity, sets in ((SCHOOL, by_school), (PERSON, by_person), (PROGRAM, by_program))])).alias("a")).select("query_id", "a.*")

    people, programs = tables.topnotchers, tables.programs
    fields = F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("exam_code"), F.col("slug"))))
    person_order = [F.asc("name"), F.asc("id")]
    # A name met by many rows: the best few rows per name are enough.
    few = top_per_key(people.select("id", "name", F.lower("name").alias("text")), ["text"], person_order, person_limit)
    rows = tables.schools.select(F.lit(SCHOOL).alias("entity"), "id", F.col("id").cast("string").alias("entity_id"), "name",
                                 F.lower("name").alias("text")).unionByName(
        few.select(F.lit(PERSON).alias("entity"), "id", F.col("id").cast("string").alias("entity_id"), "name", "text")).unionByName(
        programs.select(F.lit(PROGRAM).alias("entity"), "id", F.col("exam_code").alias("entity_id"), "name", fields.alias("text")))
    hits = (containing_all(asked.where(F.size("tokens") > 0), index).join(rows, ["entity", "text"])
            .select("entity", "tokens", "id", "entity_id", "name").distinct())
    # schools and people come by name, programs by id
    order = [F.when(F.col("entity") == PROGRAM, "").otherwise(F.col("name")).asc(), F.asc("id")]
    limit = F.when(F.col("entity") == SCHOOL, school_limit).when(F.col("entity") == PERSON, person_limit)
    most = max(school_limit, person_limit)
    place = F.row_number().over(Window.partitionBy("entity", "tokens").orderBy(*order))
    ranked = top_per_key(hits.where(F.col("entity") != PROGRAM), ["entity", "tokens"], order, most).where(F.col("position") <= limit)
    catalog = hits.where(F.col("entity") == PROGRAM).withColumn("position", place)  # at most the catalog per set of words
    found = ranked.unionByName(catalog).join(asked, ["entity", "tokens"])

    # what restricts nothing gets the first page
    first = _numbered_page(tables.schools.select("id", "name"), school_limit).withColumn("entity", F.lit(SCHOOL)).unionByName(
        _numbered_page(people.select("id", "name"), person_limit).withColumn("entity", F.lit(PERSON)))
    blank = asked.where(F.size("tokens") == 0).join(first.withColumn("entity_id", F.col("id").cast("string")), "entity")
    columns = ["query_id", "entity", "position", "entity_id", "name"]
    return found.select(columns).unionByName(blank.select(columns))


def _numbered_page(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows by name with their positions; the window sees at most `limit` rows."""
    return rows.orderBy("name", "id").limit(limit).withColumn(
        "position", F.row_number().over(Window.orderBy("name", "id")))
