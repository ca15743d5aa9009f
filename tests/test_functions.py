"""Golden cases of scalar rules."""

import pytest
from pyspark.sql import functions as F

from boardstat.functions import cycles as cy
from boardstat.functions import links, names, numbers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x, digits, want", [(-0.125, 2, -0.12), (0.125, 2, 0.13), (2.5, 0, 3.0), (-2.5, 0, -2.0),
                                             (85.084, 2, 85.08)])
def test_js_round(spark, x, digits, want):
    assert one(spark, numbers.js_round(F.lit(x), digits)) == want


@pytest.mark.parametrize("text, want", [("1,234", 1234), (" 7 ", 7), ("12.0", None), ("", None), ("x", None),
                                        (None, None), ("99999999999", None)])
def test_to_int(spark, text, want):
    assert one(spark, numbers.to_int(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("81.29%", 81.29), ("1.2.3", None), ("NaN", None), (".5", 0.5), ("7.", 7.0),
                                        ("1e3", None)])
def test_to_rate(spark, text, want):
    assert one(spark, numbers.to_rate(F.lit(text))) == want


@pytest.mark.parametrize("delta, want", [(1.25, "+1.3 pts"), (-0.5, "-0.5 pts"), (0.0, "0.0 pts"), (None, "—")])
def test_delta_text(spark, delta, want):
    assert one(spark, numbers.delta_text(F.lit(delta).cast("double"))) == want


@pytest.mark.parametrize("month, number, phase, short", [
    ("May (Written)", 5, 1, "May 26 W"), ("May (Practical)", 5, 2, "May 26 P"), ("September-October", 9, 0, "Sep 26"),
    ("March–April", 3, 0, "Mar 26"), ("Sept", 0, 0, "Sep 26"), ("Foo", 0, 0, "Foo 26"), ("may", 0, 0, "May 26"),
    (None, 0, 0, "? 26")])
def test_cycle_month(spark, month, number, phase, short):
    m = F.lit(month).cast("string")
    assert one(spark, cy.month_number(m)) == number
    assert one(spark, F.coalesce(cy.phase_number(m), F.lit(0))) == phase
    assert one(spark, cy.short_label(m, F.lit(2026))) == short


@pytest.mark.parametrize("label, month, year, line", [
    ("May 2016", "May", "2016", "May 2016"), ("May (Written) 2016", "May", "2016", "May 2016"),
    ("no year", "no year", "", "no year")])
def test_label_parts(spark, label, month, year, line):
    assert one(spark, cy.label_month(F.lit(label))) == month
    assert one(spark, cy.label_year(F.lit(label))) == year
    assert one(spark, cy.label_line(F.lit(label))) == line


def test_consistency(spark):
    def score(rows):
        df = spark.createDataFrame(rows, "r double, n double")
        return df.agg(numbers.consistency_score(F.col("r"), F.col("n")).alias("s")).first()["s"]
    assert score([(90.0, 50.0)]) is None
    assert score([(90.0, 50.0), (90.0, 50.0)]) == 100.0
    assert score([(0.0, 50.0), (100.0, 100.0)]) == 0.0
    assert score([(50.0, None), (60.0, 70.0), (None, 1.0)]) == 85.9
    labels = [one(spark, numbers.consistency_label(F.lit(x).cast("double"))) for x in (85, 70, 55, 40, 39.9, None)]
    assert labels == ["Excellent", "Very Good", "Good", "Fair", "Poor", "Insufficient data"]


@pytest.mark.parametrize("n, first, last, want", [(2, 1, 9, "Insufficient data"), (3, 1, 5, "Improving"),
                                                  (3, 5, 1, "Declining"), (4, 1, 5, "Stable")])
def test_trend(spark, n, first, last, want):
    assert one(spark, numbers.trend_label(F.lit(n), F.lit(float(first)), F.lit(float(last)))) == want


@pytest.mark.parametrize("raw, want", [
    ("UST - Main Campus", "University of Santo Tomas"), ("  MAPUA   UNIVERSITY ", "Mapua University"),
    ("Cup College", "Cup College"), ("De La Salle – main", "De La Salle"), ("", ""), (None, "")])
def test_school_names(spark, raw, want):
    assert one(spark, names.normalize_school(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("query, want", [("plv", ["pamantasan", "valenzuela"]), (" U of  Cebu ", ["of", "cebu"]),
                                         ("x", []), ("", [])])
def test_search_tokens(spark, query, want):
    assert one(spark, names.search_tokens(F.lit(query))) == want


@pytest.mark.parametrize("name, query, want", [("La Salle", "", True), ("La Salle", "s", True), ("La Salle", "z", False),
                                               ("La Salle", "salle la", True), ("La Salle", "la x2", False)])
def test_matches_search(spark, name, query, want):
    assert one(spark, names.matches_search(F.lit(name), F.lit(query))) is want


@pytest.mark.parametrize("url, want", [("https://x/2009/a-2015-2019/", 2019), ("https://x/2031-2012", 2012),
                                       ("https://x/a2015", None), (None, None)])
def test_url_year(spark, url, want):
    assert one(spark, links.url_year(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize("text, want", [
    ("cele results civil engineer licensure", "CELE"), ("nothing here", "UNKNOWN"), ("released today", "UNKNOWN"),
    ("nle results nurse licensure examination", "NLE")])
def test_inferred_exam(spark, text, want):
    assert one(spark, links.inferred_exam(links.exam_scores(F.lit(text)))) == want


@pytest.mark.parametrize("title, want", [("Top Schools", True), ("Passers (A-D)", True), ("Nurse results", False),
                                         ("Master Plumber results", True), ("simple SPLE", True)])
def test_excluded_titles(spark, title, want):
    assert one(spark, links.excluded_title(F.lit(title))) is want


def test_urls(spark):
    urls = one(spark, links.direct_result_urls(F.lit("psychology"), F.lit(
        "Psychologist / Psychometrician Licensure Examination"), F.lit("May"), F.lit(2019)))
    assert urls == ["https://www.prcboard.com/psychology-results-may-2019-psychologist-psychometrician-list-of-passers",
                    "https://www.prcboard.com/psychology-results-may-2019-list-of-passers"]
    assert one(spark, links.school_page_url(F.lit("cele"), F.lit("May"), F.lit(2019))) == (
        "https://www.prcboard.com/top-schools-may-2019-cele-results")
