"""Golden series: every insight branch, tie rules, small series."""

import pytest

from boardstat.operators import series as ser

COLUMNS = "exam_code string, exam_fullname string, id long, year int, month string, month_no int, phase int, " \
          "total_takers int, total_passers int, pass_rate double, source_url string, cycle_label string, " \
          "chart_label string, is_complete boolean"


def cycles(spark, points):
    """points: (rate, takers) by year from 2016 on; None rate is an incomplete cycle."""
    rows = [("X", "X", i, 2016 + i, "May", 5, 0, t, t // 2, r, None, f"May {2016 + i}", f"May {16 + i}",
             r is not None and t > 0) for i, (r, t) in enumerate(points)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("rates, start", [
    ([50.0], None),
    ([60.0, 50.0, 56.0], "Insight: Pass rates declined toward May 2017 (50.00%), then recovered starting May 2018 (56.00%)"),
    ([50.0, 56.0, 58.0], "Insight: Pass rates reached a low of 50.00% in May 2016, then rose to 58.00% by May 2018."),
    ([50.0, 54.0], "Insight: Pass rates rose from 50.00% (May 2016) to 54.00% (May 2017)."),
    ([54.0, 50.0], "Insight: Pass rates fell from 54.00% (May 2016) to 50.00% (May 2017)."),
    ([50.0, 51.0], "Insight: Pass rates stayed relatively stable around 50.50% (σ = 0.71 pts across 2 cycles)."),
    ([50.0, 70.0, 49.0], "Insight: Across 3 complete cycles, pass rates ranged from 49.00% (May 2018) to 70.00%, "
                         "with a 10-year average of 56.33%."),
])
def test_rate_insight(spark, rates, start):
    got = ser.rate_insight(cycles(spark, [(r, 100) for r in rates])).first()["insight"]
    assert got == start if start is None else got.startswith(start)


@pytest.mark.parametrize("takers, want", [
    ([100], None),
    ([1000, 2000], "Insight: Examinee volume ranged from 1,000 (May 2016) to 2,000 (May 2017), with a 10-year average "
                   "of 1,500 per cycle."),
    ([100, 120], "Insight: Examinee volume rose from 100 (May 2016) to 120 (May 2017)."),
    ([120, 100], "Insight: Examinee volume fell from 120 (May 2016) to 100 (May 2017)."),
    ([100, 105], "Insight: The latest cycle (May 2017) also recorded the highest examinee volume in the window (105)."),
    ([105, 100], "Insight: Examinee volume averaged 103 per cycle across 2 complete administrations."),
])
def test_volume_insight(spark, takers, want):
    assert ser.volume_insight(cycles(spark, [(50.0, t) for t in takers])).first()["insight"] == want


@pytest.mark.parametrize("points, want", [
    ([(50.0, 100)], None),
    ([(50.0, 200), (60.0, 100)], "Insight: Peak examinee volume was 200 in May 2016 (pass rate 50.00%), while the highest "
                                 "pass rate was 60.00% in May 2017."),
    ([(50.0, 100), (60.0, 200)], "Insight: Pass rates ranged from 50.00% (May 2016) to 60.00% (May 2017), with a 10-year "
                                 "average of 55.00%."),
])
def test_combined_insight(spark, points, want):
    assert ser.combined_insight(cycles(spark, points)).first()["insight"] == want


def test_ties(spark):
    rows = cycles(spark, [(50.0, 10), (70.0, 20), (70.0, 20), (50.0, 10)])
    trend = ser.trend_analytics(rows).first()
    assert (trend["highest_label"], trend["lowest_label"]) == ("May 2018", "May 2016")
    volume = ser.volume_analytics(rows).first()
    assert (volume["peak_label"], volume["lowest_label"]) == ("May 2018", "May 2016")
    head = ser.headline_extremes(rows).first()
    assert (head["highest_label"], head["lowest_label"]) == ("May 2018", "May 2019")


def test_incomplete_cycles(spark):
    rows = cycles(spark, [(50.0, 10), (None, 0), (53.0, 10), (None, 5)])
    got = {r["year"]: r["delta_pts"] for r in ser.enriched_history(rows).collect()}
    assert got == {2016: None, 2017: None, 2018: 3.0, 2019: None}
    assert ser.headline_extremes(rows).first()["latest_label"] == "May 2018"
    cover = ser.coverage(rows).first()
    assert cover["label"] == "2 cycles · 2016–2019"
    assert cover["incomplete_note"] == "2 incomplete cycles excluded from pass-rate averages"
    none = ser.coverage(cycles(spark, [(None, 0)])).first()
    assert none["label"] == "1 cycle · 2016–2016"
    assert ser.headline_extremes(cycles(spark, [(None, 0), (None, 0)])).first()["latest_label"] == "May 2017"
    flat = ser.highlights(cycles(spark, [(50.0, 1), (50.0, 1), (None, 0)])).collect()
    assert sorted(str(r["highlight"]) for r in flat) == ["None", "highest", "highest"]
