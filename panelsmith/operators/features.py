"""Feature groups added to a panel in one call each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import scalars as S
from ..functions.holidays import holiday_flags
from . import panel as P

# Transfer hubs.
HUB_STATIONS = ["EM", "MT", "PL", "CC", "19", "MA", "MB", "SO", "BE", "ML"]


def add_time_features(df: DataFrame, ts: str = "ts", sub_daily: bool | None = None) -> DataFrame:
    """Calendar, cyclic and holiday columns; peak flags only when hours vary.

    ``sub_daily=None`` asks the data (one small job).
    """
    sub_daily = P.is_sub_daily(df, ts) if sub_daily is None else sub_daily
    cols = C.calendar_columns(ts) | C.cyclic_columns(ts) | holiday_flags(ts)
    return df.withColumns(cols | (C.peak_columns(ts) if sub_daily else {}))


def add_weather_features(df: DataFrame, series: str = "series", ts: str = "ts", sub_daily: bool = False) -> DataFrame:
    """Weather flags, onset and trailing sums; without precipitation nothing is added."""
    if "precip_mm" not in df.columns:
        return df
    out = df.withColumns(S.weather_flag_columns(df.columns))
    if sub_daily:
        return P.row_features(out, series, ts, None, "precip_mm", F.trunc(F.col(ts).cast("date"), "month"))
    return P.rain_onset(out, series, ts)


def add_station_features(df: DataFrame, series: str = "series", hubs: list | None = None) -> DataFrame:
    """Hub flag; mode and capacity where an agency column exists; distance where coordinates exist."""
    out = df.withColumn("is_hub_station", F.col(series).cast("string").isin(hubs or HUB_STATIONS))
    if "agency_id" in df.columns:
        mode = F.coalesce(S.map_lookup(S.AGENCY_MODES, "agency_id"), F.lit("unknown"))
        out = out.withColumn("transit_mode", mode).withColumn("capacity_tier", S.map_lookup(S.MODE_TIERS, "transit_mode"))
    if {"lat", "lng"} <= set(df.columns):
        out = out.withColumn("dist_hub_km", S.planar_km("lat", "lng")).withColumn("in_event_catchment", F.col("dist_hub_km") <= 5.0)
    return out
