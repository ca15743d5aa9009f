"""School and program names: normalisation, regions, slugs, search tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frames import literal_map
from ..registry import NAME_ABBREVIATIONS, PROGRAMS, REGION_HINTS, SEARCH_ALIASES, Program


# The patterns of the next three functions.
def normalize_school(name: Column) -> Column:
    """Canonical school name: campus suffix off, abbreviations spelled out, all-caps names in title case."""
    out = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"(?i)\s*[-–—]\s*(main|campus|main campus)\s*$", "")
    for short, full in NAME_ABBREVIATIONS:
        out = F.regexp_replace(out, rf"(?i)\b{short}\b", full)
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    shouting = (F.upper(out) == out) & (F.lower(out) != out)
    return F.when(shouting, F.initcap(out)).otherwise(out)


def infer_region(name: Column) -> Column:
    text = F.lower(name)
    out = F.lit(None).cast("string")
    for hint, region in reversed(REGION_HINTS):
        out = F.when(text.contains(hint), region).otherwise(out)
    return out


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def resolve_code(code: Column, programs: tuple[Program, ...] = PROGRAMS) -> Column:
    """Registered spelling of an exam code, whatever its case; null when unknown."""
    return F.element_at(literal_map({p.exam_code.upper(): p.exam_code for p in programs}), F.upper(code))


def search_tokens(query: Column) -> Column:
    """Words a search must find: an alias gives its words, other text its words of two letters or more."""
    text = F.lower(F.trim(query))
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= 2)
    return F.coalesce(F.element_at(literal_map(SEARCH_ALIASES), text), words)


def matches_search(name: Column, query: Column) -> Column:
    """Every token is in the name; a query without tokens is looked up whole; a blank one matches all."""
    tokens = search_tokens(query)
    low = F.lower(name)
    return (F.when(F.trim(F.coalesce(query, F.lit(""))) == "", True)
            .when(F.size(tokens) == 0, F.contains(low, F.lower(F.trim(query))))
            .otherwise(F.forall(tokens, lambda t: F.contains(low, t))))


def short_exam_name(name: Column) -> Column:
    return F.replace(name, F.lit(" Licensure Examination"), F.lit(""))


def clean_report_school(name: Column) -> Column:
    """School cell of an official report: spaces collapsed, trailing sequence number off, headers blanked."""
    text = F.regexp_replace(F.regexp_replace(name, r"\s+", " "), "^[ -]+|[ -]+$", "")
    text = F.trim(F.regexp_replace(text, r"\s+\d{1,4}$", ""))
    header = text.rlike(r"(?i)^(school|seq|no|performance|first timers|repeaters|overall)\b")
    return F.when(header | text.rlike(r"^\d+$"), "").otherwise(text)


def clean_scanned_school(name: Column) -> Column:
    """School cell of scanned text: leading number and stray symbols off."""
    text = F.regexp_replace(F.trim(name), r"^\d+\s+", "")
    text = F.regexp_replace(text, r"[^A-Za-z0-9\s&().,\-/']", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))
