"""Calendar features of a date column: school terms, holidays, parts, daylight saving, anniversaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# School starts on Aug 15 and ends on May 31; dates of Mardi Gras.
SCHOOL_START, SCHOOL_END = (8, 15), (5, 31)
EXTRA_HOLIDAYS = {"MardiGras": ["2024-02-13", "2025-03-04", "2026-02-17", "2027-02-09", "2028-02-29", "2029-02-13", "2030-03-05"]}


def in_year(d: Column, month_day: tuple[int, int], add: int = 0) -> Column:
    return F.make_date(F.year(d) + add, F.lit(month_day[0]), F.lit(month_day[1]))


def days_until_annual(d: Column, month_day: tuple[int, int]) -> Column:
    """Days to the next such day of the year, 0 on it."""
    own = in_year(d, month_day)
    return F.datediff(F.when(d <= own, own).otherwise(in_year(d, month_day, 1)), d)


def days_since_annual(d: Column, month_day: tuple[int, int]) -> Column:
    own = in_year(d, month_day)
    return F.datediff(d, F.when(d >= own, own).otherwise(in_year(d, month_day, -1)))


def school_season_index(d: Column) -> Column:
    start, end = in_year(d, SCHOOL_START), in_year(d, SCHOOL_END)
    return F.when(d > end, F.datediff(d, end) / 365).otherwise(-F.datediff(start, d) / 365)


def school_season_index_early(d: Column) -> Column:
    """The other variant: negative for every day before the start of school."""
    start, end = in_year(d, SCHOOL_START), in_year(d, SCHOOL_END)
    return F.when(d < start, -F.datediff(start, d) / 365).otherwise(F.datediff(d, end) / 365)


def is_school_season(d: Column) -> Column:
    return (d >= in_year(d, SCHOOL_START)) | (d <= in_year(d, SCHOOL_END))


def is_dst(d: Column, zone: str) -> Column:
    """1 if local midnight is ahead of the zone's January offset."""
    offset = lambda t: F.unix_timestamp(F.to_utc_timestamp(t, zone)) - F.unix_timestamp(t)
    return (offset(d.cast("timestamp")) < offset(in_year(d, (1, 1)).cast("timestamp"))).cast("int")


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday (Monday is 0) of a month; the last for n = -1."""
    if n < 0:
        day = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
        return day - dt.timedelta((day.weekday() - weekday) % 7)
    day = dt.date(year, month, 1)
    return day + dt.timedelta((weekday - day.weekday()) % 7 + 7 * (n - 1))


def _observed(day: dt.date) -> dt.date:
    return day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


# US federal holidays; (month, day) are observed on the nearest workday, (month, weekday, n) are the n-th such weekday.
FEDERAL = {
    "NewYear": (1, 1),
    "MartinLutherKing": (1, 0, 3),
    "Presidents": (2, 0, 3),
    "Memorial": (5, 0, -1),
    "Juneteenth": (6, 19),
    "Independence": (7, 4),
    "Labor": (9, 0, 1),
    "Columbus": (10, 0, 2),
    "Veterans": (11, 11),
    "Thanksgiving": (11, 3, 4),
    "Christmas": (12, 25),
}


def federal_holidays(first: int, last: int) -> list[tuple[str, dt.date]]:
    """(rule, observed date) of the years from first to last; Juneteenth from 2021."""
    out = []
    for year in range(first, last + 1):
        for name, rule in FEDERAL.items():
            if name != "Juneteenth" or year >= 2021:
                out.append((name, _observed(dt.date(year, *rule)) if len(rule) == 2 else _nth(year, *rule)))
    return sorted(out, key=lambda x: (x[1], x[0]))


def years_of(*columns: tuple[DataFrame, str]) -> DataFrame:
    """(y): all years from the first to the last in the given date columns."""
    ends = None
    for df, c in columns:
        one = df.agg(F.min(F.year(c)).alias("a"), F.max(F.year(c)).alias("b"))
        ends = one if ends is None else ends.unionByName(one)
    return ends.agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("y"))


def holiday_table(years: DataFrame) -> DataFrame:
    """(rule, h) of the federal holidays as observed in the years (y): what federal_holidays gives, as rows that Spark makes."""
    y = F.col("y")
    found = []
    for name, rule in FEDERAL.items():
        if len(rule) == 2:
            day = F.make_date(y, F.lit(rule[0]), F.lit(rule[1]))
            day = F.date_add(day, F.when(F.weekday(day) == 5, -1).when(F.weekday(day) == 6, 1).otherwise(0))
        elif rule[2] < 0:
            end = F.last_day(F.make_date(y, F.lit(rule[0]), F.lit(1)))
            day = F.date_sub(end, F.pmod(F.weekday(end) - rule[1], F.lit(7)))
        else:
            first = F.make_date(y, F.lit(rule[0]), F.lit(1))
            day = F.date_add(first, F.pmod(rule[1] - F.weekday(first), F.lit(7)) + 7 * (rule[2] - 1))
        found.append(F.struct(F.lit(name).alias("rule"), day.alias("h")))
    rows = years.select("y", F.explode(F.array(*found)).alias("x"))
    return rows.where((F.col("x.rule") != "Juneteenth") | (y >= 2021)).select("x.rule", "x.h")


def dates(days: list[dt.date]) -> Column:
    return F.array(*(F.lit(x) for x in sorted(days))).cast("array<date>")


def next_of(d: Column, days: Column) -> Column:
    return F.array_min(F.filter(days, lambda h: h >= d))


def last_of(d: Column, days: Column, strict: bool = False) -> Column:
    return F.array_max(F.filter(days, lambda h: (h < d) if strict else (h <= d)))


def proximity(d: Column, days: Column, scale: int, strict: bool = False) -> Column:
    """1 on the day, falling to 0 over `scale` days before it; negative after the one before if that is nearer. Null where one side is missing."""
    before, after = F.datediff(next_of(d, days), d), F.datediff(d, last_of(d, days, strict))
    return F.when(before <= after, F.greatest(F.lit(0.0), (scale - before) / scale)).otherwise(-F.greatest(F.lit(0.0), (scale - after) / scale))


def column_name(rule: str) -> str:
    """A rule's name as part of a column's: letters and digits alone."""
    return "".join(x for x in rule if x.isalnum())


def holiday_flags(d: Column, holidays: list[tuple[str, dt.date]], scale: int = 15) -> list[Column]:
    """Of each rule among the (rule, date) given: is<rule>_holiday_feat, and proximity_<rule>_holiday_feat with the one strictly before."""
    out = []
    for rule in dict.fromkeys(n for n, _ in holidays):
        own = dates([h for n, h in holidays if n == rule])
        out.append(F.array_contains(own, d).cast("int").alias(f"is{column_name(rule)}_holiday_feat"))
        out.append(proximity(d, own, scale, strict=True).alias(f"proximity_{column_name(rule)}_holiday_feat"))
    return out


def near_on_post(d: Column, days: Column, span: int = 7) -> tuple[Column, Column, Column]:
    """Whether a holiday comes within `span` days, is that day, was within `span` days; false where there is none."""
    after = F.array_min(F.filter(days, lambda h: h > d))
    near, post = F.datediff(after, d) <= span, F.datediff(d, last_of(d, days, strict=True)) <= span
    return F.coalesce(near, F.lit(False)), F.array_contains(days, d), F.coalesce(post, F.lit(False))


def is_before_annual(d: Column, month_day: tuple[int, int], span: int) -> Column:
    """1 within the `span` days before such a day of the year, not on it."""
    return days_until_annual(d, month_day).between(1, span).cast("int")


def is_on_annual(d: Column, month_day: tuple[int, int]) -> Column:
    return (days_until_annual(d, month_day) == 0).cast("int")
