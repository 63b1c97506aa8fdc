"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import scalars as S
from ..functions.holidays import holiday_dimension, holiday_flags
from ..operators import features as FE
from . import fixtures as X
from .common import flag, rnd
from .fixtures import with_
from .registry import query


@query("wall_clock", "SELECT event_id, timezone('America/Los_Angeles', timezone('UTC', ts + to_days(CAST(event_id % 365 AS INTEGER)))) AS local_ts FROM events")
def _(t):
    at = F.col("ts") + F.make_dt_interval((F.col("event_id") % 365).cast("int"))
    return t.events.select("event_id", C.wall_clock(at, source="UTC").alias("local_ts"))


_CAL = f"""hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, month(ts) AS month, weekofyear(ts) AS week_of_year, quarter(ts) AS quarter, year(ts) AS year,
  {flag('isodow(ts) >= 6', 'is_weekend')}, {flag('isodow(ts) = 1', 'is_monday')}, {flag('isodow(ts) = 5', 'is_friday')}"""


@query("calendar", f"SELECT o_orderkey, {_CAL} FROM (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_custkey % 24 AS INTEGER)) AS ts FROM orders)")
def _(t):
    df = t.orders.select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_custkey") % 24).cast("int"))).alias("ts"))
    return df.select("o_orderkey", *[c.alias(n) for n, c in C.calendar_columns("ts").items()])


@query("cyclic", "SELECT event_id, " + ", ".join(f"round({f}(2 * pi() * {e} / {n}), 8) + 0.0 AS {k}_{f}" for k, e, n in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "(month(ts) - 1)", 12)) for f in ("sin", "cos")) + " FROM events")
def _(t):
    # + 0.0 folds the sign of a rounded zero.
    return t.events.select("event_id", *[(F.round(c, 8) + 0.0).alias(n) for n, c in C.cyclic_columns("ts").items()])


@query("peaks", f"SELECT event_id, {flag('hour(ts) BETWEEN 7 AND 9', 'is_am_peak')}, {flag('hour(ts) BETWEEN 16 AND 19', 'is_pm_peak')}, {flag('hour(ts) BETWEEN 10 AND 15', 'is_midday')}, {flag('hour(ts) >= 22 OR hour(ts) <= 5', 'is_late_night')} FROM events")
def _(t):
    return FE.add_time_features(t.events.select("event_id", "ts"), "ts", True).select("event_id", "is_am_peak", "is_pm_peak", "is_midday", "is_late_night")


# The same rules in SQL: nth weekdays by arithmetic on the month's first day, fixed dates shifted off weekends.
_NTH = "d = date_trunc('month', d) + to_days(CAST(({wd} - isodow(date_trunc('month', d)) + 7) % 7 + 7 * {k} AS INTEGER))"
_FIX = "(({m} AND isodow(d) <= 5) OR ({fri} AND isodow(d) = 5) OR ({mon} AND isodow(d) = 1))"


def _fixed(month, day):
    md = f"(month(d) = {month} AND day(d) = {day})"
    nxt = f"(month(d + INTERVAL 1 DAY) = {month} AND day(d + INTERVAL 1 DAY) = {day})"
    prv = f"(month(d - INTERVAL 1 DAY) = {month} AND day(d - INTERVAL 1 DAY) = {day})"
    return _FIX.format(m=md, fri=nxt, mon=prv)


HOLIDAY_SQL = " OR ".join([
    _fixed(1, 1), _fixed(7, 4), _fixed(11, 11), _fixed(12, 25), "(year(d) >= 2021 AND " + _fixed(6, 19) + ")",
    f"(month(d) = 1 AND {_NTH.format(wd=1, k=2)})", f"(month(d) = 2 AND {_NTH.format(wd=1, k=2)})", f"(month(d) = 9 AND {_NTH.format(wd=1, k=0)})",
    f"(month(d) = 10 AND {_NTH.format(wd=1, k=1)})", f"(month(d) = 11 AND {_NTH.format(wd=4, k=3)})", "(month(d) = 5 AND isodow(d) = 1 AND month(d + INTERVAL 7 DAY) = 6)",
])


@query("holidays", f"""SELECT o_orderkey, {flag(f'({HOLIDAY_SQL})', 'is_holiday')}, CAST(CAST(({HOLIDAY_SQL.replace('d ', 'e ').replace('d)', 'e)')}) AS INTEGER) AS DOUBLE) AS is_holiday_eve
  FROM (SELECT o_orderkey, d, d + INTERVAL 1 DAY AS e FROM (SELECT o_orderkey, o_orderdate + INTERVAL 24 YEAR + to_days(CAST(o_custkey % 365 AS INTEGER)) AS d FROM orders)) WHERE year(d) BETWEEN 2019 AND 2029""")
def _(t):
    day = F.add_months(F.col("o_orderdate").cast("date"), 288).cast(C.NTZ) + F.make_dt_interval((F.col("o_custkey") % 365).cast("int"))
    df = t.orders.select("o_orderkey", day.alias("d")).where(F.year("d").between(2019, 2029))
    return df.select("o_orderkey", *[c.alias(n) for n, c in holiday_flags("d").items()])


@query("holiday_frame", f"SELECT CAST(d AS TIMESTAMP) AS ds, count(o_orderkey) AS n_orders FROM (SELECT unnest(generate_series(TIMESTAMP '2019-01-01', TIMESTAMP '2030-12-31', INTERVAL 1 DAY)) AS d) LEFT JOIN orders ON o_orderdate + INTERVAL 24 YEAR = d WHERE {HOLIDAY_SQL} GROUP BY 1")
def _(t):
    o = t.orders.select(F.add_months(F.col("o_orderdate").cast("date"), 288).cast(C.NTZ).alias("ds"), "o_orderkey")
    return holiday_dimension(t.spark).select("ds").join(o, "ds", "left").groupBy("ds").agg(F.count("o_orderkey").alias("n_orders"))


@query("buckets", "SELECT event_id, CASE WHEN value / 5 <= 0.1 THEN 0.0 WHEN value / 5 <= 2.5 THEN 1.0 WHEN value / 5 <= 7.6 THEN 2.0 WHEN value / 5 <= 15 THEN 3.0 ELSE 4.0 END::DOUBLE AS precip_intensity, CASE WHEN value <= 15 THEN 'stop_and_go' WHEN value <= 35 THEN 'slow' WHEN value <= 55 THEN 'moderate' WHEN value <= 999 THEN 'free_flow' ELSE 'nan' END AS congestion_level FROM events")
def _(t):
    return t.events.select("event_id", S.precip_intensity(F.col("value") / 5).alias("precip_intensity"), S.congestion_level("value").alias("congestion_level"))


@query("weather_flags", f"""SELECT event_id, {flag('precip_mm > 0.1', 'is_raining')}, {flag('temp_f < 40', 'is_very_cold')}, {flag('temp_f > 90', 'is_very_hot')}, round(temp_f - 65, 6) AS temp_deviation, {flag('windspeed_mph > 20', 'is_windy')},
  CASE WHEN precip_mm <= 0.1 THEN 0.0 WHEN precip_mm <= 2.5 THEN 2.0 WHEN precip_mm <= 7.6 THEN 4.0 WHEN precip_mm <= 15 THEN 6.0 WHEN precip_mm IS NOT NULL THEN 8.0 END + 1.5 * CAST(temp_f < 40 AS INTEGER) + CAST(temp_f > 90 AS INTEGER) + 0.5 * CAST(windspeed_mph > 20 AS INTEGER) AS weather_discomfort
  FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value / 10 END AS precip_mm, CASE WHEN user_id % 7 <> 0 THEN value END AS temp_f, CAST(user_id % 40 AS DOUBLE) AS windspeed_mph FROM events)""")
def _(t):
    df = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value") / 10).alias("precip_mm"), F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("temp_f"), (F.col("user_id") % 40).cast("double").alias("windspeed_mph"))
    names = ["is_raining", "is_very_cold", "is_very_hot", "temp_deviation", "is_windy", "weather_discomfort"]
    return rnd(df.withColumns(S.weather_flag_columns(df.columns)), 6, "temp_deviation").select("event_id", *names)


@query("proximity", with_(["p3", "p4"], """SELECT g.ts, round(max(exp(-0.5 * pow(epoch(e.timestamp_start - g.ts) / 10800.0, 2))), 6) AS event_proximity_score FROM (SELECT DISTINCT ts FROM p3) g JOIN p4 e ON e.timestamp_start <= g.ts + INTERVAL 3 HOUR AND e.timestamp_end >= g.ts - INTERVAL 90 MINUTE GROUP BY 1"""))
def _(t):
    from ..operators.events import event_windows

    return rnd(event_windows(X.p3(t), X.p4(t)).select("ts", "event_proximity_score"), 6, "event_proximity_score")


@query("station_static", f"""SELECT c_custkey, {flag("c_mktsegment IN ('BUILDING', 'MACHINERY')", 'is_hub_station')}, coalesce(m, 'unknown') AS transit_mode, coalesce(tier, 0) AS capacity_tier, round(d, 6) AS dist_hub_km, {flag('d <= 5.0', 'in_event_catchment')} FROM (SELECT *,
  sqrt(pow((37.3 + (c_custkey % 11) * 0.01 - 37.3294) * 111.0, 2) + pow((-121.95 + (c_custkey % 7) * 0.01 + 121.9022) * 111.0 * cos(radians(37.3294)), 2)) AS d, CASE c_nationkey % 5 WHEN 0 THEN 'heavy_rail' WHEN 1 THEN 'commuter_rail' WHEN 2 THEN 'bus' WHEN 3 THEN 'ferry' END AS m, CASE c_nationkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 4 ELSE 0 END AS tier FROM customer)""")
def _(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 5
    agency = F.when(n == 0, "BA").when(n == 1, "CT").when(n == 2, "SF").when(n == 3, "WTA").otherwise("??")
    df = t.customer.select("c_custkey", F.col("c_mktsegment").alias("series"), agency.alias("agency_id"), (k % 11 * F.lit(0.01) + 37.3).alias("lat"), (k % 7 * F.lit(0.01) - 121.95).alias("lng"))
    out = FE.add_station_features(df, hubs=["BUILDING", "MACHINERY"])
    return rnd(out, 6, "dist_hub_km").select("c_custkey", "is_hub_station", "transit_mode", "capacity_tier", "dist_hub_km", "in_event_catchment")


@query("month_math", """SELECT o_orderkey, (2001 * 12 + 8) - (year(o_orderdate) * 12 + month(o_orderdate)) AS months_left, CAST(last_day(o_orderdate) AS TIMESTAMP) AS month_end, CAST(o_orderdate + INTERVAL 3 MONTH AS TIMESTAMP) AS plus_three,
  CAST(CASE WHEN last_day(lim) = lim THEN lim ELSE last_day(lim - INTERVAL 1 MONTH) END AS TIMESTAMP) AS last_closed FROM (SELECT *, CAST(o_orderdate - INTERVAL 7 DAY AS DATE) AS lim FROM orders)""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", C.months_between(d, F.lit("2001-08-15").cast(C.NTZ)).alias("months_left"), C.month_end(d).alias("month_end"), C.plus_months(d, 3).alias("plus_three"), C.last_closed_month_end(d).alias("last_closed"))


@query("safe_ratio", "SELECT o_orderkey, CASE WHEN den <> 0 THEN num / den WHEN num = 0 THEN 0.0 WHEN num > 0 THEN 1e300 ELSE -1e300 END AS ratio FROM (SELECT o_orderkey, CAST(o_custkey % 5 - 2 AS DOUBLE) AS num, CAST(o_orderkey % 3 AS DOUBLE) AS den FROM orders)")
def _(t):
    r = S.safe_ratio((F.col("o_custkey") % 5 - 2).cast("double"), (F.col("o_orderkey") % 3).cast("double"))
    return t.orders.select("o_orderkey", F.greatest(F.least(r, F.lit(1e300)), F.lit(-1e300)).alias("ratio"))


@query("clip_floor", "SELECT o_orderkey, CASE WHEN v IS NOT NULL THEN greatest(v, 0) END AS clipped FROM (SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice - 200000 END AS v FROM orders)")
def _(t):
    v = F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice") - 200000)
    return t.orders.select("o_orderkey", S.at_least(v, 0.0).alias("clipped"))


@query("string", """SELECT p_partkey, CASE WHEN code NOT IN ('EXITS', 'TOTAL', '') THEN code END AS code, trim(regexp_replace(lower(p_type || ' & ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, strftime(TIMESTAMP '1998-01-01' + to_months(CAST(p_partkey % 40 AS INTEGER)), '%Y-%m') AS month, CAST(CAST(contains(lower(p_name), 'ring') AS INTEGER) AS DOUBLE) AS has_ring
  FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'TOTAL' WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE upper(trim(split_part(p_name, ' ', 1))) END AS code FROM part)""")
def _(t):
    n = F.col("p_size") % 4
    raw = F.when(n == 0, " total ").when(n == 1, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1))))
    at = F.add_months(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") % 40).cast("int"))
    return t.part.select("p_partkey", S.clean_code(raw).alias("code"), S.slug(F.concat("p_type", F.lit(" & "), "p_name")).alias("slug"), S.month_text(at).alias("month"), S.contains_ci("p_name", "RING").alias("has_ring"))


@query("json", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("event_type", F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("array_map", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'BA' WHEN 'MACHINERY' THEN 'CT' END AS code, (SELECT string_agg(DISTINCT strftime(o_orderdate, '%Y-%m'), ' ' ORDER BY strftime(o_orderdate, '%Y-%m')) FROM orders WHERE o_custkey = c_custkey) AS months FROM customer")
def _(t):
    months = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set(S.month_text("o_orderdate"))), " ").alias("months"))
    return t.customer.select("c_custkey", S.map_lookup({"BUILDING": "BA", "MACHINERY": "CT"}, "c_mktsegment").alias("code")).join(months, "c_custkey", "left")


@query("isclose", f"SELECT o_orderkey, {flag('(a IS NULL AND b IS NULL) OR coalesce(a = b OR abs(a - b) <= 1e-6 * abs(b), false)', 'close')}, {flag('a IS NOT DISTINCT FROM b', 'exact')} FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice * (1 + (o_orderkey % 3) * 9e-7) END AS a, CASE WHEN o_custkey % 10 <> 0 THEN o_totalprice END AS b FROM orders)")
def _(t):
    a = F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice") * (F.col("o_orderkey") % 3 * F.lit(9e-7) + 1))
    b = F.when(F.col("o_custkey") % 10 != 0, F.col("o_totalprice"))
    df = t.orders.select("o_orderkey", a.alias("a"), b.alias("b"))
    return df.select("o_orderkey", S.close_or_both_null("a", "b", 1e-6).alias("close"), S.close_or_both_null("a", "b", None).alias("exact"))
