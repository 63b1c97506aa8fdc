"""Wall-clock calendar expressions on TIMESTAMP_NTZ columns.

None of them depends on the session time zone: every step goes through DATE or
field extraction, which are defined on wall-clock values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"
LOCAL_ZONE = "America/Los_Angeles"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(text: str) -> Column:
    return F.lit(text).cast(NTZ)


def wall_clock(ts, zone: str = LOCAL_ZONE, source: str | None = None) -> Column:
    """Local wall clock of an instant, or of a wall clock in the ``source`` zone.

    An instant (TIMESTAMP) is first read in the session zone, whatever it is, so
    the result does not depend on it.
    """
    origin = F.current_timezone() if source is None else F.lit(source)
    return F.convert_timezone(origin, F.lit(zone), col(ts).cast(NTZ))


def month_start(ts) -> Column:
    return F.trunc(col(ts).cast("date"), "month").cast(NTZ)


def month_end(ts) -> Column:
    return F.last_day(col(ts).cast("date")).cast(NTZ)


def day_start(ts) -> Column:
    return col(ts).cast("date").cast(NTZ)


def hour_start(ts) -> Column:
    return day_start(ts) + F.make_dt_interval(F.lit(0), F.hour(col(ts)))


def plus_months(ts, n) -> Column:
    """Date part moved by calendar months, clipped to the month's last day."""
    return F.add_months(col(ts).cast("date"), n).cast(NTZ)


def plus_hours(ts, hours: float) -> Column:
    return col(ts) + F.expr(f"make_dt_interval(0, 0, 0, {float(hours) * 3600.0!r})")


def month_index(ts) -> Column:
    """year * 12 + month: integer month arithmetic, exact over gaps."""
    return F.year(col(ts)) * 12 + F.month(col(ts))


def months_between(start, end) -> Column:
    """Whole calendar months from start to end, ignoring the day of month."""
    return month_index(end) - month_index(start)


def epoch_seconds(ts) -> Column:
    """Seconds since 1970-01-01 on the wall clock, as DOUBLE with microseconds."""
    c = col(ts)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    return days * 86400.0 + F.hour(c) * 3600.0 + F.minute(c) * 60.0 + F.extract(F.lit("SECOND"), c).cast("double")


def hours_between(start, end) -> Column:
    return (epoch_seconds(end) - epoch_seconds(start)) / 3600.0


def last_closed_month_end(today, lag_days: int = 7) -> Column:
    """Latest month end that lies at least ``lag_days`` before ``today``."""
    limit = F.date_sub(col(today).cast("date"), lag_days)
    return F.when(F.last_day(limit) == limit, limit).otherwise(F.last_day(F.add_months(limit, -1)))


def calendar_columns(ts) -> dict[str, Column]:
    c = col(ts)
    return {
        "hour_of_day": F.hour(c),
        "day_of_week": F.weekday(c),
        "month": F.month(c),
        "week_of_year": F.weekofyear(c),
        "quarter": F.quarter(c),
        "year": F.year(c),
        "is_weekend": F.weekday(c) >= 5,
        "is_monday": F.weekday(c) == 0,
        "is_friday": F.weekday(c) == 4,
    }


def cyclic_columns(ts) -> dict[str, Column]:
    c = col(ts)
    out = {}
    for name, value, period in (
        ("hour", F.hour(c), 24),
        ("dow", F.weekday(c), 7),
        ("month", F.month(c) - 1, 12),
    ):
        angle = value * (2 * math.pi / period)
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    return out


def peak_columns(ts) -> dict[str, Column]:
    h = F.hour(col(ts))
    return {
        "is_am_peak": h.between(7, 9),
        "is_pm_peak": h.between(16, 19),
        "is_midday": h.between(10, 15),
        "is_late_night": (h >= 22) | (h <= 5),
    }


def as_times(days: Column) -> Column:
    """ARRAY<DATE> -> ARRAY<TIMESTAMP_NTZ>, ready to explode."""
    return days.cast("array<timestamp_ntz>")


def month_list(first, last) -> Column:
    """Month starts from first to last (DATE expressions), as time stamps."""
    return as_times(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))
