"""Raw tables -> feature store -> enriched panel -> splits, as plain compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, peak_columns
from ..functions.holidays import holiday_flags
from ..functions.scalars import weather_flag_columns
from ..operators import events as E
from ..operators import joins as J
from ..operators import panel as P
from ..operators.features import add_station_features, add_time_features, add_weather_features
from ..sources import od as O
from ..sources.files import write_parquet


def refused_months(od: DataFrame) -> DataFrame:
    """Months that the store refuses: (period, n_total_blocks), the number being other than one."""
    return O.total_blocks(od)


def build_feature_store(
    od: DataFrame, weather: DataFrame | None, events: DataFrame | None, mapping: DataFrame | None = None,
    spans: DataFrame | None = None, start: str | None = None, end: str | None = None, sub_daily: bool = False, ambiguous: str = "raise",
) -> DataFrame:
    """OD rows, hourly weather and an event archive to one row per (series, ts).

    ``od``: period, day_type, origin, riders.  ``weather``: station, ts, measures.
    ``mapping``: (series, weather_station); without it every series takes the
    regional weather.  Without an archive event columns are unknown for every row.

    A month without exactly one Total block has no defined target.  With
    ``ambiguous="raise"`` such months end the build (one small job over the months and
    day types); with ``"drop"`` they are left out and ``refused_months`` lists them.
    """
    refused = refused_months(od)
    if ambiguous == "raise":
        O.require_one_total_block(refused)
    elif ambiguous == "drop":
        od = od.join(refused.select("period"), "period", "left_anti")
    else:
        raise ValueError(f"ambiguous is 'raise' or 'drop', not {ambiguous!r}")
    total = O.drop_aggregate_codes(O.total_rows(od), "origin")
    base = O.boardings(total).select(F.col("origin").alias("series"), F.col("period").alias("ts"), F.col("ridership").alias("y"), "ridership_daily")
    base = J.between_dates(base, start, end)
    if weather is not None:
        base = J.weather_or_region(base, J.monthly_weather(weather), mapping)
    if events is not None:
        base = E.add_monthly_events(base, events, spans)
    else:
        unknown = {c: F.lit(None).cast("boolean") for c in ("is_game_day", "is_sharks_game", "is_playoff")}
        base = base.withColumns(unknown | {c: F.lit(None).cast("double") for c in ("hours_to_event", "game_start_hour")})
    cal = {k: v for k, v in calendar_columns("ts").items() if k in ("hour_of_day", "day_of_week", "is_weekend", "month", "week_of_year")}
    cal |= {"is_holiday": holiday_flags("ts")["is_holiday"]}
    if sub_daily:
        cal |= {k: v for k, v in peak_columns("ts").items() if k in ("is_am_peak", "is_pm_peak")}
    return base.withColumns(cal)


def build_features(df: DataFrame, events: DataFrame | None = None, spans: DataFrame | None = None, cadence: str = "monthly", lags: bool = True, strict: bool = False) -> DataFrame:
    """Time, weather, event, station and lag features in sequence."""
    sub_daily = cadence != "monthly"
    lagged = lags and "y" in df.columns
    out = add_time_features(df, "ts", sub_daily)
    if not sub_daily:
        out = add_weather_features(out, "series", "ts")
        out = E.add_monthly_event_features(out, events, spans) if events is not None else out
        return P.add_lags(add_station_features(out), cadence=cadence, strict=strict) if lagged else add_station_features(out)
    wet = "precip_mm" in df.columns
    out = out.withColumns(weather_flag_columns(df.columns)) if wet else out
    # Everything that looks back over rows, in one pass, before the events' joins are added to the plan.
    out = P.row_features(out, "series", "ts", "y" if lagged else None, "precip_mm" if wet else None, F.trunc(F.col("ts").cast("date"), "month"))
    return add_station_features(E.add_event_features(out, events, spans) if events is not None else out)


def write_splits(df: DataFrame, root: str, train_end: str, val_end: str, test_end: str, train_start: str | None = None) -> dict[str, str]:
    """One folder per split in a single pass over the panel."""
    split = J.chronological_split(df, train_end, val_end, test_end, train_start)
    write_parquet(split, f"{root}/splits", ["split"])
    return {s: f"{root}/splits/split={s}" for s in ("train", "val", "test")}
