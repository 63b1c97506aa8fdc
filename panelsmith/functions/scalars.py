"""Null-aware scalar expressions: buckets, weather flags, ratios, codes, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import col

INF = float("inf")


def inf() -> Column:
    return F.lit(INF)


def null_double() -> Column:
    return F.lit(None).cast("double")


def no_nan(c) -> Column:
    """NaN becomes NULL: NaN is a value in Spark and would poison aggregates."""
    return F.nanvl(col(c).cast("double"), null_double())


def finite(c) -> Column:
    """TRUE only for a present, finite number (never NULL)."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) != INF), F.lit(False))


def at_least(c, floor: float) -> Column:
    """max(c, floor) that keeps NULL (``greatest`` alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(floor))))


def unless_null(condition, value) -> Column:
    """Value where the condition holds, else unknown (NULL)."""
    return F.when(col(condition), col(value))


def known(flag, default: bool = False) -> Column:
    """A nullable flag as a mask: unknown rows are not selected."""
    return F.coalesce(col(flag), F.lit(default))


def safe_ratio(num, den) -> Column:
    """num / den with 0/0 = 0 and x/0 = +-infinity."""
    n, d = col(num), col(den)
    return F.when(d != 0, n / d).when(n == 0, F.lit(0.0)).when(n > 0, inf()).when(n < 0, -inf())


def cut_right_closed(c, edges: list[float], labels: list) -> Column:
    """Bucket by right-closed bins; the last label takes everything above."""
    c = col(c)
    chain = reduce(lambda acc, el: acc.when(c <= el[0], F.lit(el[1])), zip(edges, labels), F.when(c.isNull(), None))
    return chain.otherwise(F.lit(labels[-1]))


# Precipitation bins (mm per hour) and speed bins (mph).
PRECIP_EDGES = [0.1, 2.5, 7.6, 15.0]
SPEED_EDGES = [15.0, 35.0, 55.0, 999.0]
SPEED_LABELS = ["stop_and_go", "slow", "moderate", "free_flow"]


def precip_intensity(c) -> Column:
    return cut_right_closed(c, PRECIP_EDGES, [0.0, 1.0, 2.0, 3.0, 4.0])


def congestion_level(c) -> Column:
    c = col(c)
    return F.when((c >= 0) & (c <= SPEED_EDGES[-1]), cut_right_closed(c, SPEED_EDGES[:-1], SPEED_LABELS)).otherwise("nan")


def weather_flag_columns(columns: list[str]) -> dict[str, Column]:
    """Flags for the measures present; NULL in, NULL out.

    A measure that is NULL makes the discomfort index NULL; a measure whose
    column does not exist adds nothing to it.
    """
    out: dict[str, Column] = {}
    terms = []
    if "precip_mm" in columns:
        out["is_raining"] = F.col("precip_mm") > 0.1
        out["precip_intensity"] = precip_intensity("precip_mm")
        terms.append(out["precip_intensity"] * 2.0)
    if "temp_f" in columns:
        out["is_very_cold"] = F.col("temp_f") < 40
        out["is_very_hot"] = F.col("temp_f") > 90
        out["temp_deviation"] = F.col("temp_f") - 65.0
        terms += [out["is_very_cold"].cast("double") * 1.5, out["is_very_hot"].cast("double") * 1.0]
    if "windspeed_mph" in columns:
        out["is_windy"] = F.col("windspeed_mph") > 20
        terms.append(out["is_windy"].cast("double") * 0.5)
    if terms:
        out["weather_discomfort"] = reduce(lambda a, b: a + b, terms)
    return out


# Operator code to mode, mode to capacity tier, and the event hub.
AGENCY_MODES = {
    "BA": "heavy_rail", "CT": "commuter_rail", "VTA": "light_rail", "SF": "bus",
    "AC": "bus", "SM": "bus", "WTA": "ferry", "GF": "bus",
}
MODE_TIERS = {"ferry": 4, "heavy_rail": 3, "commuter_rail": 2, "light_rail": 1, "bus": 0, "unknown": 0}
EVENT_HUB = (37.3294, -121.9022)


def map_lookup(mapping: dict, key) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(key))


def planar_km(lat, lng, origin: tuple[float, float] = EVENT_HUB) -> Column:
    """Flat-earth distance with 111 km per degree, good to a few kilometres."""
    import math

    dy = (col(lat) - origin[0]) * 111.0
    dx = (col(lng) - origin[1]) * (111.0 * math.cos(math.radians(origin[0])))
    return F.sqrt(dy * dy + dx * dx)


def haversine_km(lat1, lng1, lat2, lng2, radius: float = 6371.0088) -> Column:
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.asin(F.sqrt(h)) * (2 * radius)


# Numeric station codes and labels of total rows.
NUMERIC_CODES = ["12", "16", "19", "24"]
AGGREGATE_LABELS = ["EXITS", "ENTRIES", "TOTAL", "TOTALS", "GRAND TOTAL", "NAN"]


def clean_code(c) -> Column:
    """Trim, upper-case, drop a trailing '.0'; blank and aggregate labels -> NULL."""
    code = F.regexp_replace(F.upper(F.trim(col(c))), r"\.0$", "")
    return F.when((code != "") & ~code.isin(AGGREGATE_LABELS), code)


def is_station_code(c, pattern: str = "^[A-Z]{2}$") -> Column:
    """Two capital letters (or another pattern) or one of the numeric codes; never NULL."""
    c = col(c)
    return F.coalesce(c.rlike(pattern) | c.isin(NUMERIC_CODES), F.lit(False))


def contains_ci(c, word: str) -> Column:
    return F.coalesce(F.lower(col(c)).contains(word.lower()), F.lit(False))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def month_text(ts) -> Column:
    c = col(ts)
    return F.concat_ws("-", F.lpad(F.year(c).cast("string"), 4, "0"), F.lpad(F.month(c).cast("string"), 2, "0"))


def close_or_both_null(a, b, rtol: float | None) -> Column:
    """Equal, both missing, or within rtol * |b|; rtol None means exactly."""
    a, b = col(a), col(b)
    same = a.eqNullSafe(b)
    if rtol is None:
        return same
    return same | F.coalesce(F.abs(a - b) <= F.abs(b) * rtol, F.lit(False))


# WMO weather interpretation codes -> (description, counts as rain).
WMO_CODES = {
    0: ("Clear sky", False), 1: ("Mainly clear", False), 2: ("Partly cloudy", False), 3: ("Overcast", False),
    45: ("Foggy", False), 48: ("Icy fog", False),
    51: ("Light drizzle", True), 53: ("Moderate drizzle", True), 55: ("Dense drizzle", True),
    61: ("Slight rain", True), 63: ("Moderate rain", True), 65: ("Heavy rain", True),
    71: ("Slight snow", False), 73: ("Moderate snow", False), 75: ("Heavy snow", False), 77: ("Snow grains", False),
    80: ("Slight showers", True), 81: ("Moderate showers", True), 82: ("Violent showers", True),
    85: ("Slight snow shower", False), 86: ("Heavy snow shower", False),
    95: ("Thunderstorm", True), 96: ("Thunderstorm/hail", True), 99: ("Heavy thunderstorm", True),
}
