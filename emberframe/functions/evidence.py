"""Small Column helpers of the observation and evidence tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def observed_at(date: Column, hhmm: Column) -> Column:
    """ISO date and an unpadded HHMM whole number as a UTC timestamp; null if either can't be read."""
    return F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), F.lpad(hhmm.cast("string"), 4, "0")), F.lit("yyyy-MM-dd HHmm"))


def confidence_label(value: Column) -> Column:
    """h, n, l spelled out; other values stay."""
    names = F.create_map(*(F.lit(x) for x in ("h", "high", "n", "nominal", "l", "low")))
    return F.coalesce(F.element_at(names, F.lower(value)), value)


def confidence_score(value: Column) -> Column:
    """0 to 1 from a label or a percentage; null if it is neither."""
    label = F.lower(F.trim(value))
    number = F.try_to_number(label, F.lit("999.999")).cast("double")
    number = F.coalesce(label.try_cast("double"), number)
    return (
        F.when(label.isin("h", "high"), 1.0)
        .when(label.isin("n", "nominal"), 0.5)
        .when(label.isin("l", "low"), 0.0)
        .when(number.isNotNull() & ~F.isnan(number), F.least(F.greatest(number / 100.0, F.lit(0.0)), F.lit(1.0)))
    )


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 3600e6


def interval_gap_hours(first1: Column, last1: Column, first2: Column, last2: Column) -> Column:
    """Hours between two intervals, 0 if they touch or overlap."""
    return F.greatest(hours_between(last1, first2), hours_between(last2, first1), F.lit(0.0))


def interval_order(first1: Column, last1: Column, first2: Column, last2: Column) -> Column:
    return F.when(last1 < first2, "A_BEFORE_B").when(last2 < first1, "B_BEFORE_A").otherwise("OVERLAPPING")


def circular_mean(direction: Column, weight: Column) -> Column:
    """Weighted circular mean of directions in degrees (aggregate); null if the vectors cancel."""
    s, c = F.sum(weight * F.sin(F.radians(direction))), F.sum(weight * F.cos(F.radians(direction)))
    return F.when(F.abs(s) + F.abs(c) > 1e-12, F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)))


def plain_text(value: Column) -> Column:
    """Prose on one line without dashes: a spaced dash before a capital ends the sentence, else it is a comma; between digits a dash is a range, elsewhere a colon."""
    x = F.trim(F.regexp_replace(value, r"\s+", " "))
    x = F.regexp_replace(x, r"\s(?:—|–|--)\s(?=\p{Lu})", ". ")
    x = F.regexp_replace(x, r"\s(?:—|–|--)\s", ", ")
    x = F.regexp_replace(x, r"(?<=\d)—(?=\d)", "–")
    x = F.regexp_replace(F.regexp_replace(x, "—", ": "), r"\s+", " ")
    return F.regexp_replace(F.trim(x), "[ :,]+$", "")


def age_hours(observed: Column, now: Column) -> Column:
    """Hours since an observation, never negative; 24 where its time is unknown."""
    return F.when(observed.isNull(), 24.0).otherwise(F.greatest(hours_between(observed, now), F.lit(0.0)))
