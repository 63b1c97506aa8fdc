"""US federal holidays by rule, as a plain expression for any year and as a small dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .calendar import NTZ, col

# The federal holiday rules.  Fixed-date holidays move to Friday
# when they fall on Saturday and to Monday when they fall on Sunday.
FIXED_DATES = [
    ("New Year's Day", 1, 1, None),
    ("Juneteenth", 6, 19, 2021),
    ("Independence Day", 7, 4, None),
    ("Veterans Day", 11, 11, None),
    ("Christmas Day", 12, 25, None),
]
# (name, month, weekday Monday=0, which; -1 is the last one of the month)
NTH_WEEKDAYS = [
    ("Martin Luther King Jr. Day", 1, 0, 3),
    ("Washington's Birthday", 2, 0, 3),
    ("Memorial Day", 5, 0, -1),
    ("Labor Day", 9, 0, 1),
    ("Columbus Day", 10, 0, 2),
    ("Thanksgiving Day", 11, 3, 4),
]


def _observed(day: dt.date) -> dt.date:
    return day + dt.timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0))


def _nth(year: int, month: int, weekday: int, which: int) -> dt.date:
    if which > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (which - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return last - dt.timedelta(days=(last.weekday() - weekday) % 7)


def federal_holidays(first_year: int = 2019, last_year: int = 2030) -> list[tuple[dt.date, str]]:
    """Observed dates inside the year range, in order; about eleven per year."""
    lo, hi = dt.date(first_year, 1, 1), dt.date(last_year, 12, 31)
    days = []
    for year in range(first_year - 1, last_year + 2):
        days += [(_observed(dt.date(year, m, d)), name) for name, m, d, since in FIXED_DATES if not since or year >= since]
        days += [(_nth(year, m, wd, k), name) for name, m, wd, k in NTH_WEEKDAYS]
    return sorted((d, n) for d, n in days if lo <= d <= hi)


def holiday_dimension(spark: SparkSession, first_year: int = 2019, last_year: int = 2030) -> DataFrame:
    rows = federal_holidays(first_year, last_year)
    return spark.createDataFrame(rows, "holiday_date date, holiday string").withColumn(
        "ds", F.col("holiday_date").cast(NTZ)
    )


def _fixed_on(day: Column) -> Column:
    """Whether ``day`` itself is one of the fixed dates."""
    hit = F.lit(False)
    for _, month, dom, since in FIXED_DATES:
        same = (F.month(day) == month) & (F.dayofmonth(day) == dom)
        hit = hit | (same & (F.year(day) >= since) if since else same)
    return hit


def is_federal_holiday(day: Column) -> Column:
    """Whether a date is an observed federal holiday, in any year, from its parts alone."""
    weekday, dom = F.weekday(day), F.dayofmonth(day)
    hit = (_fixed_on(day) & (weekday < 5)) | (_fixed_on(F.date_add(day, 1)) & (weekday == 4)) | (_fixed_on(F.date_sub(day, 1)) & (weekday == 0))
    for _, month, wd, which in NTH_WEEKDAYS:
        place = F.ceil(dom / 7) == which if which > 0 else F.month(F.date_add(day, 7)) != month
        hit = hit | ((F.month(day) == month) & (weekday == wd) & place)
    return hit


def holiday_flags(ts) -> dict[str, Column]:
    """Holiday and holiday-eve flags, evaluated inside whole-stage codegen; no join and no range of years."""
    day = col(ts).cast("date")
    return {"is_holiday": is_federal_holiday(day), "is_holiday_eve": is_federal_holiday(F.date_add(day, 1))}
