"""Result-page addresses and titles: years, months, owners, source precedence, page classes, exam scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frames import literal, literal_array, literal_map
from ..registry import (CALENDAR, GENERIC_NAME_WORDS, MIRROR_SITE, MONTH_ALIASES, MONTHS, NAME_STOP_WORDS, OFFICIAL,
                        PROGRAMS, SOURCE_PRIORITY, TITLE_RULES, Program, name_words)

MONTH_PATTERN = "|".join(MONTHS)


def _quote(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in text)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value evaluated a single time per row, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_text(text: Column) -> Column:
    """The text as words between single spaces, so that ` word ` finds whole words without a regex per word."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"\W+", " "), F.lit(" "))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def url_year(url: Column) -> Column:
    """Last stand-alone year from 2010 to 2030 in an address."""
    years = F.transform(F.regexp_extract_all(url, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.get(F.reverse(F.filter(years, lambda y: y.between(2010, 2030))), F.lit(0))


def slug_owner(url: Column, programs: tuple[Program, ...] = PROGRAMS) -> Column:
    """Program whose slug is a path segment of the address; the longest slug wins, then registry order."""
    low = F.lower(url)
    out = F.lit(None).cast("string")
    ranked = sorted(enumerate(programs), key=lambda e: (-len(e[1].site_slug), e[0]))
    for _, p in reversed(ranked):
        out = F.when(low.rlike(f"[-/]{_quote(p.site_slug.lower())}([-/]|$)"), p.exam_code).otherwise(out)
    return out


def month_in_order(text: Column) -> Column:
    """The first full month name in calendar order that occurs in the text as a word, else a short spelling."""
    spellings = [(f" {m.lower()} ", m) for m in MONTHS] + [(f" {w} ", m) for w, m in MONTH_ALIASES.items()]
    table = F.expr("array(" + ", ".join(f"named_struct('word', {literal(w)}, 'month', {literal(m)})"
                                        for w, m in spellings) + ")")
    found = once(word_text(F.lower(text)), lambda words: F.filter(table, lambda s: F.contains(words, s["word"])))
    return F.get(found, F.lit(0))["month"]


def first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(20\d{2})\b", 1), F.lit("")).cast("int")


def first_month(text: Column) -> Column:
    """The full month name that occurs first in the text."""
    return F.nullif(F.initcap(F.regexp_extract(text, rf"(?i)\b({MONTH_PATTERN})\b", 1)), F.lit(""))


def announced_date(title: Column, text: Column) -> Column:
    """struct(month, year) from an adjacent `Month 20dd` in title or text, else a bare year in the title."""
    pattern = rf"(?i)({MONTH_PATTERN})\s+(20\d\d)"

    def pair(source: Column) -> Column:
        month = F.regexp_extract(source, pattern, 1)
        return F.when(month != "", F.struct(F.initcap(month).alias("month"),
                                            F.regexp_extract(source, pattern, 2).cast("int").alias("year")))

    bare = F.nullif(F.regexp_extract(title, r"\b(20\d\d)\b", 1), F.lit("")).cast("int")
    return F.coalesce(pair(title), pair(text), F.struct(F.lit(None).cast("string").alias("month"), bare.alias("year")))


def first_contained(text: Column, words: Column) -> Column:
    """The first word of an array that a lower-cased text contains."""
    return F.get(F.filter(words, lambda w: F.contains(text, F.lower(w))), F.lit(0))


def calendar_month(code: Column, text: Column, calendar: dict[str, tuple[str, ...]] = CALENDAR) -> Column:
    """First expected month of the program that the text mentions."""
    return first_contained(F.lower(text), expected_months(code, calendar))


def inferred_month(code: Column, text: Column) -> Column:
    return F.coalesce(calendar_month(code, text), first_contained(F.lower(text), literal_array(MONTHS)))


def source_priority(source: Column) -> Column:
    """Precedence of a source tag, matched whole."""
    out = F.lit(0)
    for tag, priority in SOURCE_PRIORITY:
        out = F.when(source == tag, priority).otherwise(out)
    return out


def stored_priority(url: Column) -> Column:
    """Precedence of a stored address: the first tag, strongest first, that it contains."""
    out = F.lit(0)
    for tag, priority in reversed(SOURCE_PRIORITY):
        out = F.when(url.contains(tag), priority).otherwise(out)
    return out


def is_official(url: Column) -> Column:
    return F.coalesce(url.contains(OFFICIAL), F.lit(False))


def is_manual(url: Column) -> Column:
    return F.coalesce(url.startswith("manual://"), F.lit(False))


def expected_months(code: Column, calendar: dict[str, tuple[str, ...]] = CALENDAR) -> Column:
    return F.element_at(literal_map(calendar), code)


def expected_month(code: Column, month: Column, calendar: dict[str, tuple[str, ...]] = CALENDAR) -> Column:
    months = F.transform(expected_months(code, calendar), lambda m: F.lower(m))
    return F.coalesce(F.array_contains(months, F.lower(month)), F.lit(False))


def keep_score(code: Column, month: Column, year: Column, url: Column) -> Column:
    """Which of several rows with equal statistics to keep: official, then expected month, then matching year."""
    return (F.when(is_official(url), 20).otherwise(0)
            + F.when(expected_month(code, month), 10).otherwise(0)
            + F.when(url_year(url) == year, 5).otherwise(0))


def _feature(token: str, weight: int) -> tuple[str, int, bool]:
    """Short tokens count only as whole words, longer ones anywhere."""
    token = token.lower().strip()
    return (f" {token} ", weight, True) if len(token) <= 4 else (token, weight, False)


def _features(p: Program) -> list[tuple[str, int, bool]]:
    found = [_feature(p.site_slug, 10), (p.slug.replace("-", " "), 8, False), _feature(p.exam_code, 6)]
    found += [_feature(k, 5) for k in p.keywords]
    return found + [(w, 3, False) for w in name_words(p, GENERIC_NAME_WORDS + NAME_STOP_WORDS)]


def _feature_table(rows: list[list[tuple[str, int, bool]]]) -> Column:
    """All features as one literal: array per program of (token, weight, whole)."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(
        f"named_struct('token', {literal(t)}, 'weight', {w}, 'whole', {literal(whole)})" for t, w, whole in row) + ")"
        for row in rows) + ")")


def inference_text(url: Column, title: Column, body: Column | None = None) -> Column:
    body = F.lit("") if body is None else F.substring(F.coalesce(body, F.lit("")), 1, 800)
    return F.lower(F.trim(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), body)))


def exam_scores(text: Column, programs: tuple[Program, ...] = PROGRAMS) -> Column:
    """Evidence for each program in a lower-cased text, in registry order, computed in place: no join, no shuffle."""
    table = _feature_table([_features(p) for p in programs])
    hay = F.struct(text.alias("raw"), word_text(text).alias("words"))

    def total(h: Column) -> Column:
        return F.transform(table, lambda features: F.aggregate(features, F.lit(0), lambda acc, f: acc + F.when(
            F.contains(F.when(f["whole"], h["words"]).otherwise(h["raw"]), f["token"]), f["weight"]).otherwise(0)))

    return once(hay, total)


def inferred_exam(scores: Column, programs: tuple[Program, ...] = PROGRAMS) -> Column:
    """Best program of a score array; UNKNOWN below 5 or when the runner-up is within 3 points."""
    codes = literal_array([p.exam_code for p in programs])

    def decide(s: Column) -> Column:
        best, second = F.array_max(s), F.element_at(F.sort_array(s, asc=False), 2)
        clear = (best >= 5) & ((second < 5) | (best - second >= 3))
        return F.when(clear, F.element_at(codes, F.array_position(s, best).cast("int"))).otherwise("UNKNOWN")

    return once(scores, decide)


def score_of(scores: Column, code: Column, programs: tuple[Program, ...] = PROGRAMS) -> Column:
    codes = literal_array([p.exam_code for p in programs])
    return F.get(scores, (F.array_position(codes, code) - 1).cast("int"))


def collector_exam(text: Column, programs: tuple[Program, ...] = PROGRAMS) -> Column:
    """Looser inference of the link collector: plain containment, best score wins, no margin."""
    table = _feature_table([
        [(p.site_slug.lower(), 10, False), (p.slug.replace("-", " "), 8, False), (p.exam_code.lower(), 6, False)]
        + [(k.lower(), 5, False) for k in p.keywords] for p in programs])
    codes = literal_array([p.exam_code for p in programs])
    scores = once(F.lower(text), lambda low: F.transform(table, lambda features: F.aggregate(
        features, F.lit(0), lambda acc, f: acc + F.when(F.contains(low, f["token"]), f["weight"]).otherwise(0))))
    return once(scores, lambda s: F.when(
        F.array_max(s) > 0, F.element_at(codes, F.array_position(s, F.array_max(s)).cast("int"))).otherwise("UNKNOWN"))


# Titles that are not result announcements, and rolls that list only part of the passers.
EXCLUDED_TITLE = (
    r"(?i)top[\s-]?schools|topnotchers|performance[\s-]?of[\s-]?schools|room\s+assignment|procurement|advisory|"
    r"cancellation|passers\s*\([A-Z]-[A-Z]\)|passers\s*\([A-Z]\s*-\s*[A-Z]\)|^[A-Z]-[A-Z]\s+|master\s+plumber|\bmple\b"
)
PARTIAL_ROLL = r"(?i)passers\s*\([A-Z]-[A-Z]\)|passers\s*\([A-Z]\s*-\s*[A-Z]\)|\([A-Z]-[A-Z]\)\s*$|sple\b"
EXCLUDED_ARTICLE = r"(?i)middle\s+east|special\s+professional|room\s+assignment|advisory|procurement"
SCHOOL_PAGE_MARKERS = ("top-schools", "top schools", "top-performing", "top performing", "performance of schools",
                       "performance-of-schools", "performance-of-school")


def excluded_title(title: Column) -> Column:
    return title.rlike(EXCLUDED_TITLE) | title.rlike(PARTIAL_ROLL)


def main_results_page(url: Column, title: Column) -> Column:
    u, t = F.lower(url), F.lower(title)
    listed = t.contains("list of passers") | u.contains("list-of-passers")
    dated = t.contains("results") & u.rlike(r"-results-[a-z]+-20\d{2}")
    worded = t.rlike(r"results.*20\d{2}") & contains_any(t, ("examination", "licensure", "board", "passers"))
    return ~excluded_title(title) & (listed | dated | worded)


def school_performance_page(url: Column, title: Column) -> Column:
    u, t = F.lower(url), F.lower(title)
    return (contains_any(u, SCHOOL_PAGE_MARKERS) | contains_any(t, SCHOOL_PAGE_MARKERS)
            | u.contains("topnotchers-and-top-schools") | t.contains("topnotchers and top schools")
            | (t.rlike(r"top[\s-]?schools") & F.concat_ws(" ", t, u).rlike(r"\b20\d{2}\b")))


def matching_articles(title: Column, programs: tuple[Program, ...] = PROGRAMS) -> Column:
    """Codes of all programs an official article title is about, in registry order: any strong token, or two words of
    the program's name."""
    rows = []
    for p in programs:
        strong = [p.exam_code.lower(), p.site_slug.lower(), p.slug.replace("-", " ")] + [k.lower() for k in p.keywords]
        words = name_words(p, ("licensure", "examination", "examinations") + NAME_STOP_WORDS)
        rows.append([(t, 2, False) for t in strong if len(t) >= 3] + [(w, 1, False) for w in words])
    table = F.arrays_zip(literal_array([p.exam_code for p in programs]).alias("code"),
                         _feature_table(rows).alias("features"))

    def hits(low: Column) -> Column:
        return F.filter(table, lambda p: F.aggregate(p["features"], F.lit(0), lambda acc, f: acc + F.when(
            F.contains(low, f["token"]), f["weight"]).otherwise(0)) >= 2)

    matched = F.transform(once(F.lower(title), hits), lambda p: p["code"])
    return F.when(title.rlike(EXCLUDED_ARTICLE), F.array().cast("array<string>")).otherwise(matched)


def title_fits(code: Column, title: Column) -> Column:
    """Program-specific title words: none of the refused, at least one of the required."""
    low = F.lower(title)
    out = F.lit(True)
    for exam, (require, exclude) in TITLE_RULES.items():
        fits = ~contains_any(low, exclude)
        if require:
            fits = fits & contains_any(low, require)
        out = F.when(code == exam, fits).otherwise(out)
    return out


def direct_result_urls(site_slug: Column, exam_name: Column, month: Column, year: Column) -> Column:
    """The two addresses a mirror uses for a result list."""
    name = F.replace(F.replace(F.replace(F.lower(exam_name), F.lit(" licensure examination"), F.lit("")),
                               F.lit(" / "), F.lit("-")), F.lit(" "), F.lit("-"))
    stem = F.concat(F.lit(MIRROR_SITE + "/"), site_slug, F.lit("-results-"), F.lower(month), F.lit("-"),
                    year.cast("string"))
    return F.array(F.concat(stem, F.lit("-"), name, F.lit("-list-of-passers")),
                   F.concat(stem, F.lit("-list-of-passers")))


def school_page_url(site_slug: Column, month: Column, year: Column) -> Column:
    return F.concat(F.lit(MIRROR_SITE + "/top-schools-"), F.lower(month), F.lit("-"), year.cast("string"), F.lit("-"),
                    site_slug, F.lit("-results"))
