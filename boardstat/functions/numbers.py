"""Rounding, coercion, labels of scores: plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column, digits: int = 0) -> Column:
    """Round half up (towards +infinity), unlike Spark's half-away-from-zero."""
    scale = float(10 ** digits)
    return F.floor(x * scale + F.lit(0.5)) / scale


def mean_rate(rate: Column, digits: int = 2) -> Column:
    """Rounded mean of percentages, see `rate_sum`."""
    return js_round(rate_sum(rate).cast("double") / F.count(rate), digits)


def rate_sum(rate: Column) -> Column:
    """Sum of percentages as exact decimals of 15 places, so the result has no summation order."""
    return F.sum(rate.try_cast("decimal(30, 15)"))


def pass_rate(passers: Column, takers: Column) -> Column:
    """100 * passers / takers to two decimals; null without takers."""
    return js_round(F.try_divide(passers, takers) * F.lit(100.0), 2)


def gap(rate: Column, reference: Column) -> Column:
    return js_round(rate - reference, 2)


def to_int(text: Column) -> Column:
    """Whole number from report text: thousands separators dropped, anything else unreadable is null."""
    cleaned = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(cleaned.rlike(r"^[+-]?[0-9]+$"), cleaned.try_cast("int"))


def to_rate(text: Column) -> Column:
    """Percentage from report text; only plain decimal notation is read."""
    cleaned = F.trim(F.translate(text, "%,", ""))
    return F.when(cleaned.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), cleaned.try_cast("double"))


def digits(group: Column) -> Column:
    """Whole number from a pattern group that holds only digits and commas."""
    return F.replace(group, F.lit(","), F.lit("")).try_cast("int")


def decimal(group: Column) -> Column:
    """Number from a pattern group that holds only digits and dots."""
    return group.try_cast("double")


def complete(takers: Column | str = "total_takers", rate: Column | str = "pass_rate") -> Column:
    """A cycle with real national statistics."""
    takers = F.col(takers) if isinstance(takers, str) else takers
    rate = F.col(rate) if isinstance(rate, str) else rate
    return (F.coalesce(takers, F.lit(0)) > 0) & rate.isNotNull()


def failed_count(takers: Column, passers: Column) -> Column:
    return F.when((takers > 0) & passers.isNotNull(), F.greatest(F.lit(0), takers - passers))


def failed_rate(takers: Column, rate: Column) -> Column:
    return F.when((takers > 0) & rate.isNotNull(), js_round(F.lit(100.0) - rate, 2))


def delta_text(delta: Column) -> Column:
    """`+1.2 pts`, `-0.5 pts`, an em dash for null; the two-decimal delta is rounded half away from zero."""
    tenths = F.floor((F.round(F.abs(delta) * 100).cast("long") + 5) / 10).cast("long")
    sign = F.when(delta > 0, "+").when(delta < 0, "-").otherwise("")
    text = F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"),
                    F.lit(" pts"))
    return F.coalesce(text, F.lit("—"))


def consistency_score(rate: Column, national: Column) -> Column:
    """100 - 2 sd + 20 * share above national, clamped to 0..100; null below two rates. An aggregate."""
    n = F.count(rate)
    above = F.count_if(rate > national)
    raw = F.lit(100.0) - F.stddev_samp(rate) * 2 + above / n * 20
    return F.when(n >= 2, F.greatest(F.lit(0.0), F.least(F.lit(100.0), js_round(raw, 1))))


def consistency_label(score: Column) -> Column:
    return (F.when(score >= 85, "Excellent").when(score >= 70, "Very Good").when(score >= 55, "Good")
            .when(score >= 40, "Fair").when(score.isNotNull(), "Poor").otherwise("Insufficient data"))


def volatility_label(points: Column) -> Column:
    return F.when(points < 8, "Low").when(points <= 15, "Medium").when(points.isNotNull(), "High")


def trend_label(n: Column, first: Column, last: Column) -> Column:
    """End-to-end slope per observation, as the class names used in reports."""
    slope = (last - first) / n
    return (F.when(n < 3, "Insufficient data").when(slope > 1, "Improving").when(slope < -1, "Declining")
            .otherwise("Stable"))


def trend_direction(label: Column) -> Column:
    return (F.when(label == "Improving", "Increasing").when(label == "Declining", "Decreasing")
            .otherwise(label))


# Pass-rate bands, best first.
RATE_BANDS = ("90-100%", "80-89%", "70-79%", "Below 70%")


def rate_band(rate: Column) -> Column:
    return (F.when(rate >= 90, RATE_BANDS[0]).when(rate >= 80, RATE_BANDS[1]).when(rate >= 70, RATE_BANDS[2])
            .when(rate.isNotNull(), RATE_BANDS[3]))


def percent_text(rate: Column) -> Column:
    return F.concat(F.format_string("%.2f", rate), F.lit("%"))


def grouped_text(n: Column) -> Column:
    return F.format_number(n, 0)
