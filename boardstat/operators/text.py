"""Tables out of page and report texts.

Whatever a document yields is computed inside its own row with array expressions and exploded at the end, so these jobs
are narrow: no shuffle, one pass over the texts, whatever their size or number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from sys import modules

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import first_per_key
from ..functions import links, names, numbers
from ..functions.markup import END, TEXT, events
from ..registry import OFFICIAL_SITE, PROGRAMS, Program

# The table reader travels with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(modules[__name__])

# A run of digits is read from its start only, so a text of long runs costs no more than one of short ones.
NUMBER = r"(?<![\d,])([\d,]+)"
RATE = r"(?<![\d.])([\d.]+)"


def plain_text(html: Column) -> Column:
    """Visible text of a page: comments, scripts, styles and tags out, entities decoded, spaces collapsed."""
    text = html
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_title(html: Column) -> Column:
    return plain_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_to_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", plain_text(F.col("html")))


def _count(text: Column) -> Column:
    return numbers.to_int(text)


def _stats(passers: Column, takers: Column, rate: Column | None) -> Column:
    """Statistics of one wording; null unless 0 < takers and passers <= takers and a stated rate is readable."""
    read = F.struct(passers.alias("p"), takers.alias("t"), (F.lit(None) if rate is None else rate).cast("double")
                    .alias("r"))

    def sound(s: Column) -> Column:
        value = numbers.js_round(F.try_divide(s["p"], s["t"]) * 100.0, 2) if rate is None else s["r"]
        return F.when((s["t"] > 0) & (s["p"] <= s["t"]) & value.isNotNull(), F.struct(
            s["p"].alias("total_passers"), s["t"].alias("total_takers"), value.alias("pass_rate")))

    return links.once(read, sound)


# The usual wordings as parts that follow one another, however far apart, and where the parts hold passers,
# takers and rate: (part, group).
WORDINGS = (
    ((rf"(?is){NUMBER}\s+out\s+of\s+{NUMBER}\s+\({RATE}%?\)",), (0, 1), (0, 2), (0, 3)),
    ((rf"(?is){NUMBER}\s+out\s+of\s+{NUMBER}\s+passed",), (0, 1), (0, 2), None),
    ((rf"(?is){NUMBER}\s+passed\s+and\s+{NUMBER}\s+failed\s+out\s+of\s+{NUMBER}",), (0, 1), (0, 3), None),
    ((rf"(?is)passing\s+rate\s+of\s+{RATE}%", rf"(?is){NUMBER}\s+out\s+of\s+{NUMBER}"), (1, 1), (1, 2), (0, 1)),
    ((rf"(?is){NUMBER}\s+examinees", rf"(?is){NUMBER}\s+passers", rf"(?is){RATE}%"), (1, 1), (0, 1), (2, 1)),
    ((rf"(?is)total\s+(?:number\s+of\s+)?passers[:\s]+{NUMBER}", rf"(?is)examinees[:\s]+{NUMBER}"), (0, 1), (1, 1), None),
)


def _following(text: Column, parts: tuple[str, ...], use: Callable[..., Column], *found: Column) -> Column:
    """`use` of the first hit of each part after the hit of the part before; null if a part is missing.

    What stands between is free, so if any hits of the parts follow one another, the first hit of each does: the text is
    read once per part, where one pattern for the whole would start over at every first hit.
    """
    if not parts:
        return use(*found)
    rest = F.get(F.split(text, parts[0], 2), F.lit(1))
    hit = F.regexp_extract(text, parts[0], 0)
    read = F.struct(hit.alias("hit"), *([rest.alias("rest")] if parts[1:] else []))
    return F.when(text.rlike(parts[0]), links.once(
        read, lambda r: _following(r["rest"] if parts[1:] else r["hit"], parts[1:], use, *found, r["hit"])))


def summary_stats(text: Column) -> Column:
    """National statistics from the first of six usual wordings that gives sound numbers."""
    def worded(parts: tuple[str, ...], passers: tuple, takers: tuple, rate: tuple | None) -> Column:
        def stats(*hits: Column) -> Column:
            def group(at: tuple) -> Column:
                return F.regexp_extract(hits[at[0]], parts[at[0]], at[1])
            return _stats(_count(group(passers)), _count(group(takers)), None if rate is None else numbers.to_rate(group(rate)))
        return _following(text, parts, stats)

    return F.coalesce(*[worded(*w) for w in WORDINGS])


def extract_summary(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("_stats", summary_stats(F.col(text))).select("*", "_stats.*").drop("_stats")


# The wording for both teacher exams, one after the other.
DUAL = tuple(rf"(?is){NUMBER}\s+{level} teachers?\s+out\s+of\s+{NUMBER}\s+examinees?\s*\({RATE}%?\)"
             for level in ("elementary", "secondary"))


def dual_stats(text: Column) -> Column:
    """Two (exam_code, statistics) from an announcement of both teacher exams; null unless both are sound."""
    def part(hit: Column, pattern: str, code: str) -> Column:
        return F.struct(F.lit(code).alias("exam_code"), _stats(
            _count(F.regexp_extract(hit, pattern, 1)), _count(F.regexp_extract(hit, pattern, 2)),
            numbers.to_rate(F.regexp_extract(hit, pattern, 3))).alias("stats"))

    both = _following(text, DUAL, lambda first, second: F.array(part(first, DUAL[0], "LET-E"),
                                                                part(second, DUAL[1], "LET-S")))
    return links.once(both, lambda b: F.when(F.forall(b, lambda x: x["stats"].isNotNull()), b))


def extract_dual(texts: DataFrame, text: str = "text") -> DataFrame:
    """Two rows for every dual announcement."""
    pair = F.explode(dual_stats(F.col(text))).alias("_pair")
    kept = [c for c in texts.columns if c not in (text, "exam_code")]
    return texts.select(*kept, pair).select(*kept, "_pair.exam_code", "_pair.stats.*")


def infer_exam(pages: DataFrame, programs: tuple[Program, ...] = PROGRAMS) -> DataFrame:
    """Adds the scores of all programs and the inferred exam to pages with url, title, text."""
    text = links.inference_text(F.col("url"), F.col("title"), F.col("text"))
    return (pages.withColumn("scores", links.exam_scores(text, programs))
            .withColumn("parsed_exam", links.inferred_exam(F.col("scores"), programs)))


# ── links ────────────────────────────────────────────────────────────────────────────────────────────────────────────

def absolute_url(base: Column, href: Column) -> Column:
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z]+://[^?#]*/)[^/?#]*", 1)
    return (F.when(href.rlike(r"^[a-zA-Z]+://"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .otherwise(F.concat(F.when(folder.endswith("://") | (folder == ""), F.concat(origin, F.lit("/")))
                                .otherwise(folder), href)))


def _is_document(href: Column) -> Column:
    low = F.lower(href)
    return low.endswith(".pdf") | low.contains("uploaded/documents")


ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
IMAGE = r"(?is)<img\b[^>]*\bsrc\s*=\s*[\"']([^\"']*)[\"']"
DRIVE_FILE = r"drive\.google\.com/file/d/([A-Za-z0-9_-]+)"
DRIVE_OPEN = r"drive\.google\.com/uc\?[^\"']*id=([A-Za-z0-9_-]+)"


def drive_ids(html: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(html, F.lit(DRIVE_FILE), F.lit(1)),
                                     F.regexp_extract_all(html, F.lit(DRIVE_OPEN), F.lit(1))))


def anchors(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), lambda a: F.struct(
        F.trim(F.regexp_extract(a, ANCHOR, 1)).alias("href"),
        F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(a, ANCHOR, 2), "<[^>]*>", " "), r"\s+", " "))
        .alias("label")))


def mine_links(pages: DataFrame) -> DataFrame:
    """Per page: drive files, documents, the performance-of-schools link and up to three statistics images."""
    url, html = F.col("url"), F.col("html")
    usable = F.filter("anchors", lambda a: (a["href"] != "") & ~a["href"].startswith("#"))
    documents = F.transform(F.filter(usable, lambda a: _is_document(a["href"])), lambda a: absolute_url(url, a["href"]))
    schools = F.transform(
        F.filter(usable, lambda a: a["label"].rlike(r"(?i)performance\s+of\s+schools?")),
        lambda a: F.struct(a["href"].alias("href"), F.regexp_extract(a["href"], DRIVE_FILE, 1).alias("drive_id")))
    report = F.get(F.filter(schools, lambda s: (s["drive_id"] != "") | _is_document(s["href"])), F.lit(0))
    images = F.filter(F.regexp_extract_all(html, F.lit(IMAGE), F.lit(1)), lambda i: (
        (i != "") & ~links.contains_any(F.lower(i), ("logo", "icon"))
        & links.contains_any(F.lower(i), ("upload", "result", "passer", "banner", "wp-content"))))
    return (pages.select("page_id", "url", drive_ids(html).alias("drive_ids"), anchors(html).alias("anchors"),
                         F.slice(F.transform(images, lambda i: absolute_url(url, i)), 1, 3).alias("images"))
            .withColumn("documents", F.array_distinct(documents)).withColumn("_report", report)
            .select("page_id", "url", "drive_ids", "documents", "images",
                    F.size("anchors").alias("anchors"),
                    F.when(F.col("_report.drive_id") != "", "drive").when(F.col("_report").isNotNull(), "pdf")
                    .alias("report_type"),
                    F.when(F.col("_report.drive_id") != "", F.col("_report.href"))
                    .otherwise(absolute_url(F.lit(OFFICIAL_SITE + "/"), F.col("_report.href"))).alias("report_url"),
                    F.nullif(F.col("_report.drive_id"), F.lit("")).alias("report_drive_id")))


# ── line reports ─────────────────────────────────────────────────────────────────────────────────────────────────────

def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def _numbered(lines: Column, parse) -> Column:
    """Parsed lines with their line numbers, unreadable ones left out."""
    rows = F.transform(lines, lambda line, at: F.struct((at + 1).alias("line_no"), parse(line).alias("row")))
    return F.filter(rows, lambda r: r["row"].isNotNull())


def _school_row(rank: Column, school: Column, takers: Column, passers: Column, rate: Column) -> Column:
    return F.struct(rank.alias("rank"), school.alias("school"), takers.alias("takers"), passers.alias("passers"),
                    rate.alias("pass_rate"))


# Line layouts of reports.
SPACED = rf"(?i)^\s*(\d+)\s+(.+?)\s+{NUMBER}\s+{NUMBER}\s+([\d.]+)\s*%?\s*$"
OFFICIAL_LINE = (r"(?i)^(.+?)\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d.]+)%?\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d.]+)%?\s+"
                 r"(\d+)\s+(\d+)\s+(\d+)\s+([\d.]+)%?\s*$")
SIMPLE_LINE = rf"(?i)^\s*(\d+)?\s*(.+?)\s+{NUMBER}\s+{NUMBER}\s+{NUMBER}\s+([\d.]+)\s*%?\s*$"


GROUP_MARK = "\u0001"


def _groups(text: Column, pattern: str, *wanted: int) -> Column:
    """Groups of a pattern that spans the whole text, two or more, from a single match; null if it does not match."""
    marked = F.regexp_replace(F.translate(text, GROUP_MARK, " "), F.lit(pattern),
                              F.lit(GROUP_MARK.join(f"${g}" for g in wanted)))
    return links.once(F.split(marked, GROUP_MARK), lambda g: F.when(F.size(g) == len(wanted), g))


def _known(row: Column) -> Column:
    """The row if all its numbers could be read."""
    return F.when(row["takers"].isNotNull() & row["passers"].isNotNull() & row["pass_rate"].isNotNull(), row)


def _table_line(line: Column) -> Column:
    """`| 1 | NAME | 139 | 113 | 81.29% |` or `1 NAME 139 113 81.29`."""
    def piped(c: Column) -> Column:
        header = F.upper(F.get(c, F.lit(0))).isin("RANK", "---", "---|") | F.contains(
            F.upper(F.get(c, F.lit(1))), F.lit("SCHOOL"))
        row = _school_row(_count(F.get(c, F.lit(0))), F.get(c, F.lit(1)), _count(F.get(c, F.lit(2))),
                          _count(F.get(c, F.lit(3))), numbers.to_rate(F.get(c, F.lit(4))))
        return F.struct(header.alias("header"),
                        links.once(row, lambda r: F.when(r["rank"].isNotNull(), _known(r))).alias("row"))

    def read(text: Column) -> Column:
        spaced = links.once(_groups(text, SPACED, 1, 2, 3, 4, 5), lambda g: F.when(g.isNotNull(), links.once(_school_row(
            numbers.digits(g[0]), F.trim(g[1]), numbers.digits(g[2]), numbers.digits(g[3]),
            numbers.decimal(g[4])), lambda r: F.when(r["rank"].isNotNull(), _known(r)))))
        cells = F.filter(F.transform(F.split(text, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
        bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
        tabular = F.when(bars >= 5, links.once(cells, lambda c: F.when(F.size(c) >= 5, piped(c))))
        return links.once(tabular, lambda t: F.when(F.coalesce(t["header"], F.lit(False)), None).otherwise(
            F.coalesce(t["row"], spaced)))

    return links.once(F.trim(line), read)


def _collapsed(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def _ends_in_number(line: Column) -> Column:
    """Cheap test before a layout pattern: after the last digit at most `. %` may follow."""
    return F.right(line, F.lit(4)).rlike(r"\d")


def _official_line(raw: Column) -> Column:
    """School and its overall group from a line of first-timers, repeaters and overall."""
    def read(line: Column) -> Column:
        header = line.rlike(r"(?i)^(seq|school|first timers|repeaters|overall|performance|pos\s*-)")
        found = F.when((F.length(line) >= 20) & _ends_in_number(line) & ~header,
                       _groups(line, OFFICIAL_LINE, 1, 10, 11, 12, 13))
        return links.once(found, lambda g: F.when(g.isNotNull(), links.once(group(g), keep)))

    def group(g: Column) -> Column:
        number = [numbers.digits(g[i]) for i in (1, 2, 3)]
        return F.struct(_school_row(F.lit(None).cast("int"), names.clean_report_school(g[0]), number[2], number[0],
                                    numbers.decimal(g[4])).alias("row"), number[1].alias("failed"))

    def keep(g: Column) -> Column:
        row = g["row"]
        off = F.abs(F.try_divide(row["passers"], row["takers"]) * 100 - row["pass_rate"]) > 2
        broken = (row["passers"] + g["failed"] != row["takers"]) & off & (row["passers"] > row["takers"])
        return F.when((F.length(row["school"]) >= 4) & (row["takers"] > 0) & row["pass_rate"].isNotNull() & ~broken, row)

    return links.once(_collapsed(raw), read)


def _simple_line(raw: Column) -> Column:
    """Fallback of six fields, where only takers and rate can be trusted."""
    def read(line: Column) -> Column:
        header = line.rlike(r"(?i)^(seq|school|first timers|repeaters|overall|performance)\b")
        found = F.when((F.length(line) >= 15) & _ends_in_number(line) & ~header, _groups(line, SIMPLE_LINE, 1, 2, 5, 6))
        return links.once(found, lambda g: F.when(g.isNotNull(), row(g)))

    def row(g: Column) -> Column:
        takers, rate = numbers.digits(g[2]), numbers.decimal(g[3])
        passers = F.floor(takers * rate / 100 + F.lit(0.5)).cast("int")
        return F.when((takers > 0) & rate.isNotNull(), _school_row(_count(g[0]), F.trim(g[1]), takers, passers, rate))

    return links.once(_collapsed(raw), read)


def _merged_line(raw: Column) -> Column:
    """`SCHOOL … numbers … rate%`: the last percentage, and the last whole numbers as passers, failed, takers."""
    def read(line: Column) -> Column:
        rates = F.regexp_extract_all(line, F.lit(r"([\d.]+)\s*%"), F.lit(1))
        found = F.regexp_extract_all(F.replace(line, F.lit("%"), F.lit(" ")), F.lit(r"[\d,]+\.?\d*"), F.lit(0))
        whole = F.transform(F.filter(found, lambda n: n.rlike(r"^[\d,]*\d[\d,]*$")), numbers.digits)
        lead = F.regexp_extract(line, r"^(.+?)\s+[\d,]", 1)
        parts = F.struct(
            numbers.decimal(F.get(F.reverse(rates), F.lit(0))).alias("rate"), F.reverse(whole).alias("n"),
            links.once(lead, lambda x: names.clean_scanned_school(
                F.when(x != "", x).otherwise(F.get(F.split(line, " "), F.lit(0))))).alias("school"))
        return F.when(F.contains(line, F.lit("%")), links.once(parts, row))

    def row(p: Column) -> Column:
        takers = F.get(p["n"], F.lit(0))
        passers = (F.when(F.size(p["n"]) >= 3, F.get(p["n"], F.lit(2))).when(F.size(p["n"]) == 2, F.get(p["n"], F.lit(1)))
                   .otherwise(F.floor(takers * p["rate"] / 100 + F.lit(0.5)).cast("int")))
        keep = p["rate"].isNotNull() & (takers > 0) & (passers <= takers) & (F.length(p["school"]) >= 4)
        return F.when(keep, _school_row(F.lit(None).cast("int"), p["school"], takers, passers, p["rate"]))

    return links.once(_collapsed(raw), read)


_PARSERS = {"table": _table_line, "official": _official_line, "simple": _simple_line, "merged": _merged_line}


def school_lines(text: Column, kind: str) -> Column:
    return _numbered(_lines(text), _PARSERS[kind])


def _exploded(texts: DataFrame, rows: Column) -> DataFrame:
    """Parsed rows of documents; a missing rank is the position among the parsed rows."""
    flat = texts.select("doc_id", F.posexplode(rows).alias("_at", "_row"))
    rank = F.coalesce(F.col("_row.row.rank"), F.col("_at") + 1)
    return flat.select("doc_id", F.col("_row.line_no").alias("line_no"), rank.alias("rank"),
                       F.col("_row.row.school").alias("school"), F.col("_row.row.takers").alias("takers"),
                       F.col("_row.row.passers").alias("passers"), F.col("_row.row.pass_rate").alias("pass_rate"),
                       names.infer_region(F.col("_row.row.school")).alias("region"))


def parse_lines(texts: DataFrame, kind: str) -> DataFrame:
    """School rows of (doc_id, text) in one of the layouts table, official, simple, merged."""
    return _exploded(texts, school_lines(F.col("text"), kind))


def parse_school_reports(texts: DataFrame, enough: int = 20) -> DataFrame:
    """Official rows, completed by the fallback layout in documents with fewer than `enough` schools.

    Rows of one school (upper-cased name) merge, the last one wins.
    """
    def tagged(rows: Column, source: int) -> Column:
        return F.transform(rows, lambda r, at: F.struct(
            F.lit(source).alias("source_no"), F.coalesce(r["row"]["rank"], at + 1).alias("rank"), r["line_no"]
            .alias("line_no"), r["row"].alias("row")))

    def completed(official: Column) -> Column:
        schools = F.size(F.array_distinct(F.transform(official, lambda r: F.upper(r["row"]["school"]))))
        return F.when(schools >= enough, tagged(official, 0)).otherwise(
            F.concat(tagged(official, 0), tagged(school_lines(F.col("text"), "simple"), 1)))

    found = links.once(school_lines(F.col("text"), "official"), completed)
    rows = texts.select("doc_id", F.explode(found).alias("r")).select(
        "doc_id", "r.line_no", "r.rank", "r.row.school", "r.row.takers", "r.row.passers", "r.row.pass_rate",
        names.infer_region(F.col("r.row.school")).alias("region"), "r.source_no")
    keyed = rows.withColumn("key", F.upper(F.trim("school"))).where("key <> ''")
    return first_per_key(keyed, ["doc_id", "key"], [F.desc("source_no"), F.desc("line_no")]).drop("key")


# Layouts of lists of top examinees.
NOTCHER_LINE = r"^\s*(\d+)\s+([A-Z\s,.-]+?)\s+([A-Z\s.-]+?)\s+([\d.]+)"
NOTCHER_ITEM = r"(\d+)[.)]\s*([A-Z][A-Z\s,.']+?)\s*[-–]\s*(.+?)\s*[-–]\s*([\d.]+)\s*%"


def _person(text: Column, pattern: str) -> Column:
    rank, rating = _count(F.regexp_extract(text, pattern, 1)), numbers.to_rate(F.regexp_extract(text, pattern, 4))
    return F.when(rank.isNotNull() & rating.isNotNull(), F.struct(
        rank.alias("rank"), F.trim(F.regexp_extract(text, pattern, 2)).alias("name"),
        F.trim(F.regexp_extract(text, pattern, 3)).alias("school"), rating.alias("rating")))


def parse_topnotchers(texts: DataFrame, kind: str = "lines") -> DataFrame:
    """Top examinees from lines `rank NAME SCHOOL rating` or, up to ten, from items `1. NAME - School - 92.5%`."""
    if kind == "lines":
        rows = F.filter(F.transform(_lines(F.col("text")), lambda x: _person(F.trim(x), NOTCHER_LINE)),
                        lambda r: r.isNotNull())
    else:
        items = F.regexp_extract_all(F.col("text"), F.lit(NOTCHER_ITEM), F.lit(0))
        rows = F.slice(F.filter(F.transform(items, lambda x: _person(x, NOTCHER_ITEM)), lambda r: r.isNotNull()), 1, 10)
    return texts.select("doc_id", F.posexplode(rows).alias("at", "row")).select(
        "doc_id", (F.col("at") + 1).alias("position"), "row.*")


JSON_ROWS = "array<struct<rank:string,school:string,takers:string,passers:string,pass_rate:string>>"


def json_rows(texts: DataFrame) -> DataFrame:
    """Rows of a JSON array inside a text: fenced, under `schools`, or the first bracketed part; bad rows drop out."""
    bare = F.trim(F.regexp_replace(F.trim("text"), "```json|```", ""))
    whole = F.when(bare.startswith("["), F.from_json(bare, JSON_ROWS))
    wrapped = F.when(bare.startswith("{"), F.from_json(bare, f"struct<schools:{JSON_ROWS}>")["schools"])
    inside = F.from_json(F.regexp_substr(bare, F.lit(r"(?s)\[.*\]")), JSON_ROWS)
    rows = texts.select("doc_id", F.posexplode(F.coalesce(whole, wrapped, inside)).alias("at", "r"))
    name = F.trim("r.school")
    takers, passers, rate = _count(F.col("r.takers")), _count(F.col("r.passers")), numbers.to_rate(F.col("r.pass_rate"))
    header = name.rlike(r"(?i)^(school|performance|overall|first timers|repeaters)\b")
    keep = (F.length(name) >= 3) & ~header & (takers > 0) & (passers <= takers) & rate.between(0, 100)
    return rows.where(keep).select(
        "doc_id", F.col("at").alias("row_no"), _count(F.col("r.rank")).alias("rank"), name.alias("school"),
        takers.alias("takers"), passers.alias("passers"), numbers.js_round(rate, 4).alias("pass_rate"),
        names.infer_region(name).alias("region"))


# ── HTML tables ──────────────────────────────────────────────────────────────────────────────────────────────────────

def _page_tables(html: str) -> list[list[list[str]]]:
    """Tables of a page as rows of cell texts; a new row or cell closes the one before it. Any string is a page."""
    tables: list[list[list[str]]] = []
    open_tables: list[list[list[str]]] = []
    cell: list[str] | None = None  # the parts of the cell that is being read

    def close() -> None:
        nonlocal cell
        if cell is not None:
            open_row[-1] = "".join(cell)
            cell = None

    for kind, value, *_ in events(html):
        if kind == TEXT:
            if cell is not None:
                cell.append(value.strip())
        elif value not in ("table", "tr", "td"):
            continue
        elif kind == END:
            close()
            if value == "table" and open_tables:
                open_tables.pop()
        elif value == "table":
            close()
            tables.append([])
            open_tables.append(tables[-1])
        elif open_tables and value == "tr":
            close()
            open_tables[-1].append([])
        elif open_tables and open_tables[-1]:
            close()
            open_row = open_tables[-1][-1]
            open_row.append("")
            cell = []
    close()
    return tables


def _read_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.list_(pa.list_(pa.string())))
    for batch in batches:
        for start in range(0, len(batch), 256):  # the tables of few pages at a time
            piece = batch.slice(start, 256)
            tables = [_page_tables(html or "") for html in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(tables, kind)], ["page_id", "tables"])


# What a cell of a header or another table starts with.
MONTH_START = (r"(?i)^(January|February|March|April|May|June|July|August|September|October|November|December|"
               r"Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b")
HEADER_START = r"(?i)^(School|Institution|Name|Examinee|Passer|Passed|Total|Seq|No\.?)\b"


def _table_rows(table: Column) -> Column:
    """School rows of one table, in the four-column or the numbered wide layout."""
    def cell(c: Column, at: int) -> Column:
        return F.get(c, F.lit(at) if at >= 0 else F.size(c) + at)

    def narrow(c: Column) -> Column:
        rate = F.coalesce(cell(c, 3), cell(c, -1))
        return _cells(F.size(c) >= 3, cell(c, 0), cell(c, 1), cell(c, 2), rate)

    def wide(c: Column) -> Column:
        return _cells(F.size(c) >= 5, cell(c, 1), cell(c, -2), cell(c, -4), cell(c, -1))

    def body(rows: Column, layout) -> Column:
        return F.filter(F.transform(F.slice(rows, 2, F.size(rows)), layout), lambda r: r.isNotNull())

    def read(sample: Column) -> Column:
        numbered = F.size(F.filter(sample, lambda c: F.get(c, F.lit(0)).rlike(r"^\d+$")))
        return F.when(F.size(sample) == 0, F.slice(body(table, narrow), 1, 0)).when(
            numbered >= F.floor(F.size(sample) / 2), body(table, wide)).otherwise(body(table, narrow))

    sample = F.filter(F.slice(table, 2, 5), lambda c: F.size(c) > 0)
    return F.when(F.size(table) >= 3, links.once(sample, read)).otherwise(F.slice(body(table, narrow), 1, 0))


def _cells(enough: Column, name: Column, takers: Column, passers: Column, rate: Column) -> Column:
    """A school row, its numbers kept only if all three can be read; null for headers, dates and numbers."""
    def read(c: Column) -> Column:
        skip = ((c["school"] == "") | c["school"].rlike(MONTH_START) | c["school"].rlike(r"^\d+$")
                | c["school"].rlike(HEADER_START))
        known = c["takers"].isNotNull() & c["passers"].isNotNull() & c["pass_rate"].isNotNull()
        return F.when(~skip, F.struct(c["school"].alias("school"), F.when(known, c["takers"]).alias("takers"),
                                      F.when(known, c["passers"]).alias("passers"),
                                      F.when(known, c["pass_rate"]).alias("pass_rate")))

    parts = F.struct(F.trim(name).alias("school"), _count(takers).alias("takers"), _count(passers).alias("passers"),
                     numbers.to_rate(rate).alias("pass_rate"))
    return F.when(enough, links.once(parts, read))


def html_tables(pages: DataFrame) -> DataFrame:
    """School rows of the largest result table of each page; only the markup itself is read in Python."""
    read = (pages.select("page_id", "html").where(F.contains(F.lower("html"), F.lit("<table")))
            .mapInArrow(_read_tables, "page_id long, tables array<array<array<string>>>"))
    rows = F.transform("tables", _table_rows)
    largest = F.array_max(F.transform(rows, lambda t, at: F.struct(F.size(t).alias("n"), (-at).alias("at"),
                                                                     t.alias("rows"))))["rows"]
    best = read.select("page_id", F.posexplode(largest).alias("at", "row"))
    return best.select("page_id", (F.col("at") + 1).alias("rank"), "row.*",
                       names.infer_region(F.col("row.school")).alias("region"))


# ── discovery ────────────────────────────────────────────────────────────────────────────────────────────────────────

def discover_school_pages(posts: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """School-performance pages among posts (url, title, arrival): one row per address, the first one."""
    url, title = F.col("url"), F.col("title")
    text = F.concat_ws(" ", title, url)
    rows = (posts.where((url != "") & links.school_performance_page(url, title))
            .withColumn("year", links.first_year(text)).where(F.col("year").between(start_year, end_year)))
    first = first_per_key(rows, ["url"], [F.asc("arrival")])
    return first.select("url", "title", "year", F.coalesce(links.first_month(text), F.lit("")).alias("month"),
                        links.collector_exam(F.concat_ws(" ", url, title)).alias("exam_code"))


def discover_result_pages(posts: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Result announcements among posts whose exam is inferred with confidence."""
    url, title = F.col("url"), F.col("title")
    text = F.concat_ws(" ", title, url)
    rows = (posts.where((url != "") & links.main_results_page(url, title))
            .withColumn("year", links.first_year(text)).where(F.col("year").between(start_year, end_year))
            .withColumn("month", links.first_month(text))
            .withColumn("exam_code", links.inferred_exam(links.exam_scores(links.inference_text(url, title))))
            .where("exam_code <> 'UNKNOWN'"))
    return first_per_key(rows, ["url"], [F.asc("arrival")]).select("url", "title", "year", "month", "exam_code")


def discover_articles(posts: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Official articles per program and year: the first per address and per title (letter case and spaces aside)."""
    text = F.concat_ws(" ", "title", "url")
    rows = (posts.withColumn("year", links.first_year(F.lower(text))).where(F.col("year").between(start_year, end_year))
            .withColumn("exam_code", F.explode(links.matching_articles(F.col("title"))))
            .withColumn("title_key", F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))))
    by_url = first_per_key(rows, ["exam_code", "year", "url"], [F.asc("arrival")])
    by_title = first_per_key(by_url, ["exam_code", "year", "title_key"], [F.asc("arrival")])
    return by_title.withColumn("month", links.month_in_order(text)).drop("title_key")


def article_report(articles: DataFrame) -> DataFrame:
    """Per article (page_id, exam_code, year, month, url, title, html): its school report link and national statistics."""
    found = mine_links(articles).select("page_id", "report_type", "report_url", "report_drive_id")
    stats = extract_summary(html_to_text(articles)).drop("html", "text")
    return stats.join(found, "page_id")


