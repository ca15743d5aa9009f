"""Labels and ordering of exam cycles: month text, phase, axis labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frames import literal_array, literal_map
from ..registry import MONTH_ALIASES, MONTHS, WINDOW_YEARS


def base_month(month: Column) -> Column:
    """First month of a label: `Sept-Oct (Written)` gives `Sept`."""
    bare = F.trim(F.regexp_replace(month, r"\s*\([^)]+\)\s*$", ""))
    return F.trim(F.split(bare, "[–-]")[0])


def month_number(month: Column) -> Column:
    """Calendar number of the first month; 0 when unknown or absent."""
    return F.coalesce(F.array_position(literal_array(MONTHS), base_month(month)), F.lit(0)).cast("int")


def phase_number(month: Column) -> Column:
    return F.when(month.contains("Practical"), 2).when(month.contains("Written"), 1).otherwise(0)


def phase_suffix(month: Column) -> Column:
    return F.when(month.contains("Practical"), " P").when(month.contains("Written"), " W").otherwise("")


def cycle_order(year: Column, month: Column, tie: Column) -> Column:
    """Chronological position of a cycle: year, month, phase, then an id."""
    return F.struct(year.alias("year"), month_number(month).alias("month_no"),
                    phase_number(month).alias("phase"), tie.alias("id"))


def month_abbreviation(name: Column) -> Column:
    """Three-letter month; unknown text keeps its first three letters, blank text becomes `?`."""
    pairs = {**{m.lower(): m[:3] for m in MONTHS}, **{a: full[:3] for a, full in MONTH_ALIASES.items()}}
    trimmed = F.trim(name)
    head = F.concat(F.upper(F.substring(trimmed, 1, 1)), F.lower(F.substring(trimmed, 2, 2)))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "?").otherwise(
        F.coalesce(F.element_at(literal_map(pairs), F.lower(trimmed)), head))


def short_year(year: Column) -> Column:
    return F.right(year.cast("string"), F.lit(2))


def cycle_label(month: Column, year: Column) -> Column:
    return F.trim(F.concat(F.coalesce(month, F.lit("")), F.lit(" "), year.cast("string")))


def axis_month(month: Column) -> Column:
    return F.concat(month_abbreviation(base_month(month)), F.coalesce(phase_suffix(month), F.lit("")))


def short_label(month: Column, year: Column) -> Column:
    return F.concat(month_abbreviation(base_month(month)), F.lit(" "), short_year(year),
                    F.coalesce(phase_suffix(month), F.lit("")))


def label_month(label: Column) -> Column:
    """Month part of a cycle label; the whole label when it holds no year."""
    text = F.trim(label)
    month = F.regexp_extract(text, r"^(.+?)\s+(\d{4})", 1)
    return F.when(month == "", text).otherwise(F.trim(F.regexp_replace(month, r"\s*\([^)]+\)\s*$", "")))


def label_year(label: Column) -> Column:
    return F.regexp_extract(F.trim(label), r"^(.+?)\s+(\d{4})", 2)


def label_line(label: Column) -> Column:
    return F.when(label_year(label) == "", F.trim(label)).otherwise(
        F.concat(label_month(label), F.lit(" "), label_year(label)))


def in_window(year: Column, as_of_year: int, years: int = WINDOW_YEARS) -> Column:
    """The tracker window: the current year and the ten before it."""
    return year >= as_of_year - years
