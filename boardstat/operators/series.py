"""Analytics over the cycle series of each program.

A series is bounded by the calendar (a few cycles a year), so windows per program stay small whatever the number of
examinees behind them. Everything is computed for all programs in one pass: one shuffle on program, which the window,
the aggregation and the insights share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cycles as cy
from ..functions import numbers
from ..schemas import Tables
from .national import newest_first, with_order, with_program

KEY = "exam_code"


def series(tables: Tables, as_of_year: int, years: int | None = None) -> DataFrame:
    """Windowed cycles of all programs with labels, order columns and the completeness flag."""
    rows = with_program(tables)
    window = cy.in_window(F.col("year"), as_of_year) if years is None else cy.in_window(F.col("year"), as_of_year, years)
    return (with_order(rows.where(window))
            .select(KEY, "exam_fullname", "id", "year", "month", "month_no", "phase", "total_takers", "total_passers",
                    "pass_rate", "source_url",
                    cy.cycle_label(F.col("month"), F.col("year")).alias("cycle_label"),
                    cy.short_label(F.col("month"), F.col("year")).alias("chart_label"),
                    numbers.complete().alias("is_complete")))


def complete_series(cycles: DataFrame) -> DataFrame:
    return cycles.where("is_complete")


def _chronological() -> list[str]:
    return ["year", "month_no", "phase", "id"]


def _order() -> Column:
    return F.struct(*_chronological())


def enriched_history(cycles: DataFrame) -> DataFrame:
    """All cycles newest first with the change against the previous complete cycle."""
    # Incomplete cycles sort into their own partition of the window, so lag sees complete ones only.
    before = Window.partitionBy(KEY, "is_complete").orderBy(*_chronological())
    delta = numbers.gap(F.col("pass_rate"), F.lag("pass_rate").over(before))
    return (cycles.withColumn("delta_pts", F.when(F.col("is_complete"), delta))
            .select(KEY, "id", "year", "month", "cycle_label", "total_takers", "total_passers", "pass_rate",
                    "source_url", "is_complete", "delta_pts", "month_no", "phase")
            .orderBy(KEY, *newest_first()))


def history_report(cycles: DataFrame) -> DataFrame:
    """The exam-history export: statistics of incomplete cycles are blanked, the rows stay."""
    done = F.col("is_complete")
    rows = enriched_history(cycles)
    return rows.select(
        KEY, "year", "month", F.col("cycle_label").alias("cycle"),
        F.when(done, F.col("total_takers")).alias("total_takers"),
        F.when(done, numbers.failed_count(F.col("total_takers"), F.col("total_passers"))).alias("total_failed"),
        F.when(done, F.col("total_passers")).alias("total_passers"),
        F.when(done, numbers.failed_rate(F.col("total_takers"), F.col("pass_rate"))).alias("failed_rate"),
        F.when(done, F.col("pass_rate")).alias("pass_rate"), "delta_pts", done.alias("complete"), "source_url")


def highlights(cycles: DataFrame) -> DataFrame:
    """Highest and lowest complete cycles of a table; a flat series counts as highest."""
    everything = Window.partitionBy(KEY)
    rate = F.when(F.col("is_complete"), F.col("pass_rate"))
    top, bottom = F.max(rate).over(everything), F.min(rate).over(everything)
    return cycles.select(KEY, "id", "cycle_label", "pass_rate",
                         F.when(rate == top, "highest").when(rate == bottom, "lowest").alias("highlight"))


def _plural(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" cycle"), F.when(n == 1, "").otherwise("s"))


def coverage(cycles: DataFrame) -> DataFrame:
    """Cycle counts, year range and the two coverage sentences per program."""
    counts = cycles.groupBy(KEY).agg(
        F.count("*").alias("cycle_count"), F.count_if("is_complete").alias("complete_count"),
        F.min("year").alias("year_from"), F.max("year").alias("year_to"))
    span = F.concat(F.col("year_from").cast("string"), F.lit("–"), F.col("year_to").cast("string"))
    missing = F.col("cycle_count") - F.col("complete_count")
    shown = F.when(F.col("complete_count") > 0, F.col("complete_count")).otherwise(F.col("cycle_count"))
    return counts.select(
        KEY, "cycle_count", "complete_count", missing.alias("incomplete_count"), "year_from", "year_to",
        F.concat(_plural(shown), F.lit(" · "), span).alias("label"),
        F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" incomplete cycle"),
                                     F.when(missing == 1, "").otherwise("s"),
                                     F.lit(" excluded from pass-rate averages"))).alias("incomplete_note"))


def _totals() -> list[Column]:
    takers, passers = F.col("total_takers"), F.coalesce(F.col("total_passers"), F.lit(0))
    return [F.sum(takers).alias("total_takers"), F.sum(passers).alias("total_passers"),
            F.sum(F.greatest(F.lit(0), takers - passers)).alias("total_failed")]


def national_totals(cycles: DataFrame) -> DataFrame:
    return complete_series(cycles).groupBy(KEY).agg(
        *_totals(), numbers.mean_rate(F.col("pass_rate")).alias("avg_pass_rate"))


def series_stats(cycles: DataFrame) -> DataFrame:
    """Everything the three analytics and their insights need, one row per program with a complete cycle.

    Ties: the latest cycle for a maximum, the earliest for a minimum.
    """
    everything = Window.partitionBy(KEY)
    in_order = Window.partitionBy(KEY).orderBy(*_chronological())
    rate, takers = F.col("pass_rate"), F.col("total_takers")
    rows = (complete_series(cycles)
            .withColumn("prev_rate", F.lag("pass_rate").over(in_order))
            .withColumn("prev_takers", F.lag("total_takers").over(in_order))
            .withColumn("_ord", _order())
            .withColumn("_low", F.min("pass_rate").over(everything)))
    rows = rows.withColumn("_low_ord", F.min(F.when(rate == F.col("_low"), F.col("_ord"))).over(everything))
    cell = F.struct("cycle_label", "chart_label", "pass_rate", "total_takers", "prev_rate", "prev_takers")
    recovered = (F.col("_ord") > F.col("_low_ord")) & (rate >= F.col("_low") + 5)
    return rows.groupBy(KEY).agg(
        F.count("*").alias("cycle_count"), numbers.mean_rate(rate).alias("avg_pass_rate"),
        F.floor(F.sum(takers) / F.count("*") + F.lit(0.5)).alias("avg_takers"),
        F.when(F.count("*") >= 2, numbers.js_round(F.stddev_samp(rate), 2)).alias("volatility_pts"),
        F.min_by(cell, "_ord").alias("first"), F.max_by(cell, "_ord").alias("last"),
        F.max_by(cell, F.struct("pass_rate", "_ord")).alias("high"),
        F.min_by(cell, F.struct("pass_rate", "_ord")).alias("low"),
        F.max_by(cell, F.struct("total_takers", "_ord")).alias("peak"),
        F.min_by(cell, F.struct("total_takers", "_ord")).alias("trough"),
        F.min("_ord").alias("first_ord"), F.first("_low_ord").alias("low_ord"),
        F.min_by(cell, F.when(recovered, F.col("_ord"))).alias("recovery"),
        F.min("year").alias("year_from"), F.max("year").alias("year_to"), *_totals())


# The wording of the sentences below.
def rate_insight_text() -> Column:
    """One sentence on the pass-rate series, from the first rule that applies."""
    n, first, last = F.col("cycle_count"), F.col("first"), F.col("last")
    low, high, recovery = F.col("low"), F.col("high"), F.col("recovery")
    pct, low_rate = numbers.percent_text, F.col("low.pass_rate")
    long_enough = (n >= 3) & recovery.isNotNull()
    declined = long_enough & (F.col("low_ord") > F.col("first_ord")) & (first["pass_rate"] > low_rate + 3)
    rebounded = long_enough & (last["pass_rate"] >= low_rate + 8)
    change = last["pass_rate"] - first["pass_rate"]
    moved = F.concat(pct(first["pass_rate"]), F.lit(" ("), first["cycle_label"], F.lit(") to "),
                     pct(last["pass_rate"]), F.lit(" ("), last["cycle_label"], F.lit(")."))
    return (
        F.when(n < 2, None)
        .when(declined, F.concat(
            F.lit("Insight: Pass rates declined toward "), low["cycle_label"], F.lit(" ("), pct(low_rate),
            F.lit("), then recovered starting "), recovery["cycle_label"], F.lit(" ("), pct(recovery["pass_rate"]),
            F.lit(").")))
        .when(rebounded, F.concat(
            F.lit("Insight: Pass rates reached a low of "), pct(low_rate), F.lit(" in "), low["cycle_label"],
            F.lit(", then rose to "), pct(last["pass_rate"]), F.lit(" by "), last["cycle_label"], F.lit(".")))
        .when(change >= 3, F.concat(F.lit("Insight: Pass rates rose from "), moved))
        .when(change <= -3, F.concat(F.lit("Insight: Pass rates fell from "), moved))
        .when(numbers.volatility_label(F.col("volatility_pts")) == "Low", F.concat(
            F.lit("Insight: Pass rates stayed relatively stable around "), pct(F.col("avg_pass_rate")),
            F.lit(" (σ = "), F.format_string("%.2f", F.col("volatility_pts")), F.lit(" pts across "),
            n.cast("string"), F.lit(" cycles).")))
        .otherwise(F.concat(
            F.lit("Insight: Across "), n.cast("string"), F.lit(" complete cycles, pass rates ranged from "),
            pct(low_rate), F.lit(" ("), low["cycle_label"], F.lit(") to "), pct(high["pass_rate"]),
            F.lit(", with a 10-year average of "), pct(F.col("avg_pass_rate")), F.lit("."))))


def volume_insight_text() -> Column:
    """One sentence on the number of examinees."""
    n, avg = F.col("cycle_count"), F.col("avg_takers")
    first, last, peak, trough = F.col("first"), F.col("last"), F.col("peak"), F.col("trough")
    num = numbers.grouped_text
    change = last["total_takers"] - first["total_takers"]
    ranged = ((peak["cycle_label"] != trough["cycle_label"])
              & (peak["total_takers"] - trough["total_takers"] >= avg * F.lit(0.25)))
    moved = F.concat(num(first["total_takers"]), F.lit(" ("), first["cycle_label"], F.lit(") to "),
                     num(last["total_takers"]), F.lit(" ("), last["cycle_label"], F.lit(")."))
    return (
        F.when(n < 2, None)
        .when(ranged, F.concat(
            F.lit("Insight: Examinee volume ranged from "), num(trough["total_takers"]), F.lit(" ("),
            trough["cycle_label"], F.lit(") to "), num(peak["total_takers"]), F.lit(" ("), peak["cycle_label"],
            F.lit("), with a 10-year average of "), num(avg), F.lit(" per cycle.")))
        .when((F.abs(change) >= avg * F.lit(0.15)) & (change > 0),
              F.concat(F.lit("Insight: Examinee volume rose from "), moved))
        .when(F.abs(change) >= avg * F.lit(0.15), F.concat(F.lit("Insight: Examinee volume fell from "), moved))
        .when(peak["cycle_label"] == last["cycle_label"], F.concat(
            F.lit("Insight: The latest cycle ("), last["cycle_label"],
            F.lit(") also recorded the highest examinee volume in the window ("), num(peak["total_takers"]),
            F.lit(").")))
        .otherwise(F.concat(
            F.lit("Insight: Examinee volume averaged "), num(avg), F.lit(" per cycle across "), n.cast("string"),
            F.lit(" complete administrations."))))


def combined_insight_text() -> Column:
    """One sentence relating volume to pass rate."""
    n, high, low, peak = F.col("cycle_count"), F.col("high"), F.col("low"), F.col("peak")
    pct, num = numbers.percent_text, numbers.grouped_text
    apart = (peak["cycle_label"] != high["cycle_label"]) & (peak["chart_label"] != high["chart_label"])
    return (
        F.when(n < 2, None)
        .when(apart & peak["pass_rate"].isNotNull(), F.concat(
            F.lit("Insight: Peak examinee volume was "), num(peak["total_takers"]), F.lit(" in "),
            peak["cycle_label"], F.lit(" (pass rate "), pct(peak["pass_rate"]),
            F.lit("), while the highest pass rate was "), pct(high["pass_rate"]), F.lit(" in "), high["cycle_label"],
            F.lit(".")))
        .otherwise(F.concat(
            F.lit("Insight: Pass rates ranged from "), pct(low["pass_rate"]), F.lit(" ("), low["cycle_label"],
            F.lit(") to "), pct(high["pass_rate"]), F.lit(" ("), high["cycle_label"],
            F.lit("), with a 10-year average of "), pct(F.col("avg_pass_rate")), F.lit("."))))


def _pick(name: str, fields: dict[str, str]) -> list[Column]:
    return [F.col(f"{name}.{source}").alias(target) for target, source in fields.items()]


def trend_analytics(cycles: DataFrame) -> DataFrame:
    stats = series_stats(cycles)
    badge = numbers.trend_label(F.col("cycle_count"), F.col("first.pass_rate"), F.col("last.pass_rate"))
    change = numbers.gap(F.col("last.pass_rate"), F.col("last.prev_rate"))
    return stats.select(
        KEY, "avg_pass_rate", "volatility_pts", numbers.volatility_label(F.col("volatility_pts")).alias(
            "volatility_label"), badge.alias("trend_badge"), numbers.trend_direction(badge).alias("trend_direction"),
        *_pick("high", {"highest_label": "cycle_label", "highest_rate": "pass_rate"}),
        *_pick("low", {"lowest_label": "cycle_label", "lowest_rate": "pass_rate"}),
        *_pick("last", {"latest_label": "cycle_label", "latest_rate": "pass_rate"}),
        change.alias("change_pts"), F.when(change.isNotNull(), F.col("last.cycle_label")).alias("change_label"),
        numbers.delta_text(change).alias("change_text"), "total_takers", "total_passers", "total_failed", "year_from",
        "year_to", "cycle_count", rate_insight_text().alias("insight"))


def volume_analytics(cycles: DataFrame) -> DataFrame:
    stats = series_stats(cycles)
    change = F.col("last.total_takers") - F.col("last.prev_takers")
    return stats.select(
        KEY, "avg_takers", *_pick("peak", {"peak_label": "cycle_label", "peak_takers": "total_takers"}),
        *_pick("trough", {"lowest_label": "cycle_label", "lowest_takers": "total_takers"}),
        *_pick("last", {"latest_label": "cycle_label", "latest_takers": "total_takers"}),
        change.alias("change_takers"), F.when(change.isNotNull(), F.col("last.cycle_label")).alias("change_label"),
        "total_takers", "total_passers", "total_failed", "year_from", "year_to", "cycle_count",
        volume_insight_text().alias("insight"))


def combined_analytics(cycles: DataFrame) -> DataFrame:
    stats = series_stats(cycles)
    change = numbers.gap(F.col("last.pass_rate"), F.col("last.prev_rate"))
    return stats.select(
        KEY, "avg_pass_rate", *_pick("high", {"highest_label": "cycle_label", "highest_rate": "pass_rate"}),
        *_pick("low", {"lowest_label": "cycle_label", "lowest_rate": "pass_rate"}),
        *_pick("peak", {"peak_label": "cycle_label", "peak_takers": "total_takers"}),
        *_pick("trough", {"trough_label": "cycle_label", "trough_takers": "total_takers"}),
        change.alias("change_pts"), "year_from", "year_to", "cycle_count", combined_insight_text().alias("insight"))


def rate_insight(cycles: DataFrame) -> DataFrame:
    return series_stats(cycles).select(KEY, rate_insight_text().alias("insight"))


def volume_insight(cycles: DataFrame) -> DataFrame:
    return series_stats(cycles).select(KEY, volume_insight_text().alias("insight"))


def combined_insight(cycles: DataFrame) -> DataFrame:
    return series_stats(cycles).select(KEY, combined_insight_text().alias("insight"))


def chart_series(cycles: DataFrame) -> DataFrame:
    """Chronological points of the rate, volume and combined charts with their axis fields."""
    return (complete_series(cycles)
            .select(KEY, "id", F.col("chart_label").alias("label"), F.col("cycle_label").alias("full_label"),
                    cy.axis_month(F.col("month")).alias("cycle_month"), cy.short_year(F.col("year")).alias("cycle_year"),
                    F.col("pass_rate").alias("national"), F.col("total_takers").alias("takers"), *_chronological()[:3])
            .orderBy(KEY, *_chronological()).drop(*_chronological()[:3]))


def headline_extremes(cycles: DataFrame) -> DataFrame:
    """Latest, highest and lowest cycle of a program page; ties go to the newest cycle, also for the lowest."""
    done = F.col("is_complete")
    cell = F.struct("cycle_label", "pass_rate")
    recency = F.struct(done.alias("done"), *_chronological())
    # Negated rate: the greatest is the lowest rate, and among equals the newest cycle.
    lowest_first = F.when(done, F.struct((-F.col("pass_rate")).alias("r"), *_chronological()))
    picked = cycles.groupBy(KEY).agg(
        F.max_by(cell, recency).alias("latest"),
        F.max_by(cell, F.when(done, F.struct("pass_rate", *_chronological()))).alias("highest"),
        F.max_by(cell, lowest_first).alias("lowest"))
    return picked.select(KEY, *_pick("latest", {"latest_label": "cycle_label", "latest_rate": "pass_rate"}),
                         *_pick("highest", {"highest_label": "cycle_label", "highest_rate": "pass_rate"}),
                         *_pick("lowest", {"lowest_label": "cycle_label", "lowest_rate": "pass_rate"}))
