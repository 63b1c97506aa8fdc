"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import panel as P
from ..operators import places as PL
from ..operators import spans as SP
from ..operators.features import HUB_STATIONS
from ..plans import feature_store as FS
from ..sources import od as O
from . import fixtures as X
from .common import flag, rnd
from .fixtures import TRAIN_END, with_
from .joins import ACTIVE_SQL, HOURLY_SQL, hourly_weather
from .registry import query
from .scalars import HOLIDAY_SQL

VAL_END = "2000-06-30"


@query("total_block_filter", with_(["p2"], "SELECT period, origin, destination, riders FROM p2 WHERE lower(day_type) LIKE '%total%'"))
def _(t):
    return O.total_rows(X.p2(t)).select("period", "origin", "destination", "riders")


@query("total_block_exactly_one", """SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS period, l_linestatus AS line, count(DISTINCT CASE WHEN l_returnflag IN ('N', 'R') THEN l_returnflag END) AS n_total_blocks
  FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN l_returnflag IN ('N', 'R') THEN l_returnflag END) <> 1""")
def _(t):
    # Two of the three flags read as Total blocks here, so that periods with none, one and two all occur.
    name = F.when(F.col("l_returnflag") == "A", "Avg Weekday").otherwise(F.concat(F.lit("Total "), "l_returnflag"))
    from ..functions.calendar import month_start

    df = t.lineitem.select(F.struct(month_start("l_shipdate").alias("period"), F.col("l_linestatus").alias("line")).alias("block"), name.alias("day_type"))
    return O.total_blocks(df, "block").select("block.period", "block.line", "n_total_blocks")


@query("drop_aggregate_codes", "SELECT p_partkey, p_name FROM part WHERE length(p_name) <= 10")
def _(t):
    return O.drop_aggregate_codes(t.part.select("p_partkey", "p_name"), "p_name", longest=10)


_CODES = "upper(trim(substr(p_type, 1, 2))) AS code FROM part"


@query("is_station_code", f"SELECT p_partkey, code, {flag('regexp_full_match(code, $$[A-Z]{2}$$) OR code IN ($$12$$, $$16$$, $$19$$, $$24$$)', 'is_code')} FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE upper(substr(p_type, 1, 2 + p_size % 2)) END AS code FROM part)")
def _(t):
    code = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.upper(F.col("p_type").substr(F.lit(1), F.col("p_size") % 2 + 2)))
    return t.part.select("p_partkey", code.alias("code")).withColumn("is_code", S.is_station_code("code"))


@query("self_loop_filter", with_(["p2"], "SELECT origin, destination, sum(riders) AS riders FROM p2 WHERE origin <> destination GROUP BY 1, 2"))
def _(t):
    return O.without_self_loops(X.p2(t)).groupBy("origin", "destination").agg(F.sum("riders").alias("riders"))


@query("drop_out_of_service", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'")
def _(t):
    return O.drop_out_of_service(t.events.select("event_id", "event_type", "value"), "event_type", ["error"])


@query("date_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-05' AND o_orderdate <= TIMESTAMP '1998-02-10'")
def _(t):
    return J.between_dates(t.orders.select("o_orderkey", "o_orderdate"), "1997-03-05", "1998-02-10", "o_orderdate")


@query("chrono_splits", with_(["p1"], f"""SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum(y) AS y FROM (
  SELECT *, CASE WHEN ts <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN ts <= TIMESTAMP '{VAL_END}' THEN 'val' ELSE 'test' END AS split FROM p1 WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '2000-12-31') GROUP BY split"""))
def _(t):
    s = J.chronological_split(X.p1(t), TRAIN_END, VAL_END, "2000-12-31", "1996-01-01")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("y").alias("y"))


@query("window_frames", with_(["p1"], "SELECT split, count(*) AS n, max(ts) AS last_ts FROM (SELECT *, CASE WHEN ts <= TIMESTAMP '1999-08-31' AND ts >= TIMESTAMP '1996-01-01' THEN 'train' WHEN ts > TIMESTAMP '1999-08-31' AND ts <= TIMESTAMP '2000-02-29' THEN 'test' END AS split FROM p1) WHERE split IS NOT NULL GROUP BY split"))
def _(t):
    J.check_windows([{"name": "w", "as_of": "1999-08", "end": "2000-02"}], 6, "2001-08")
    return J.window_frames(X.p1(t), "1999-08-15", 6, "1996-01-01").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@query("exact_horizon_window", "SELECT o_custkey AS series, count(*) AS n_rows, count(DISTINCT date_trunc('month', o_orderdate)) AS n_months FROM orders WHERE o_orderdate > TIMESTAMP '1999-12-31' AND o_orderdate <= TIMESTAMP '2000-06-30' GROUP BY 1 HAVING count(*) <> 2 OR count(DISTINCT date_trunc('month', o_orderdate)) <> 2")
def _(t):
    df = t.orders.select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("ts"))
    return J.exact_window_violations(X.actuals(t, df), 2)


@query("closed_month_history", with_(["p1"], "SELECT series, ts, y FROM p1 WHERE last_day(ts) <= DATE '1998-05-30'"))
def _(t):
    return J.closed_history(X.p1(t), "1998-05-30")


@query("context_future", with_(["p1"], f"""SELECT series, ts, y, 'context' AS part FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS rn FROM p1 WHERE ts <= TIMESTAMP '{TRAIN_END}') WHERE rn <= 18
  UNION ALL SELECT series, ts, y, 'future' FROM p1 WHERE ts > TIMESTAMP '{TRAIN_END}'"""))
def _(t):
    return J.context_and_future(X.p1(t), TRAIN_END, steps=18)


@query("context_future_hours", with_(["p3"], "SELECT station, ts, temp_f, CASE WHEN ts <= TIMESTAMP '2024-01-20 12:00:00' THEN 'context' ELSE 'future' END AS part FROM p3 WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 100 HOUR"))
def _(t):
    return J.context_and_future(X.p3(t).select("station", "ts", "temp_f"), "2024-01-20 12:00:00", hours=100, series="station")


@query("training_slice", with_(["p1"], "SELECT series, ts, y FROM p1 WHERE ts >= TIMESTAMP '1996-02-01' AND ts <= TIMESTAMP '1999-01-01' AND ts NOT IN (TIMESTAMP '1997-04-01', TIMESTAMP '1998-12-01')"))
def _(t):
    return J.training_slice(X.p1(t), "1996-02-01", "1999-01-01", ["1997-04-01", "1998-12-01"])


@query("uncovered_to_unknown", with_(["p1", "merged_spans"], "SELECT series, ts, CASE WHEN EXISTS (SELECT 1 FROM merged_spans s WHERE s.span_start <= ts AND last_day(ts) <= s.span_end) THEN y END AS y FROM p1"))
def _(t):
    df = SP.with_coverage(X.p1(t), X.spans(t))
    return df.select("series", "ts", S.unless_null("covered", "y").alias("y"))


@query("finite_band_filter", with_(["scored"], f"SELECT series, ts, {flag('p50 IS NOT NULL AND y > 0 AND isfinite(p50 / (y - p50))', 'finite')} FROM (SELECT * FROM scored WHERE y <> p50)"))
def _(t):
    df = X.scored(t).where("y <> p50").withColumns({"p10": F.col("p10"), "p50": F.col("p50") / (F.col("y") - F.col("p50"))})
    return df.select("series", "ts", (S.finite("p50") & S.finite("p10")).alias("finite"))


@query("in_region_boxes", "SELECT c_custkey, CAST(CAST((lat BETWEEN 37.1 AND 38.5 AND lng BETWEEN -123.6 AND -121.55) OR (lat BETWEEN 38.5 AND 38.9 AND lng BETWEEN -123.6 AND -122.0) OR (lat BETWEEN 36.9 AND 37.1 AND lng BETWEEN -121.75 AND -121.4) AS INTEGER) AS DOUBLE) AS inside FROM (SELECT c_custkey, 36.5 + c_nationkey * 0.1 AS lat, -124.0 + (c_custkey % 40) * 0.1 AS lng FROM customer)")
def _(t):
    c = t.customer.select("c_custkey", (F.col("c_nationkey") * F.lit(0.1) + 36.5).alias("lat"), (F.col("c_custkey") % 40 * F.lit(0.1) - 124.0).alias("lng"))
    return c.select("c_custkey", PL.in_region("lat", "lng").alias("inside"))


@query("best_forecast_serving", with_(["p1", "p5", "p7"], """SELECT a.series, p7.name, CAST(round(a.v) AS BIGINT) AS typical_monthly, f.ts AS forecast_month, CAST(round(f.p50) AS BIGINT) AS forecast_p50 FROM
  (SELECT series, avg(y) AS v FROM p1 WHERE ts IN (SELECT DISTINCT ts FROM p1 ORDER BY ts DESC LIMIT 12) GROUP BY series) a JOIN p7 USING (series) JOIN (SELECT * FROM p5 QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) = 1) f USING (series)"""))
def _(t):
    from ..operators.aggregates import recent_average

    return J.latest_forecast(X.p5(t), recent_average(X.p1(t)).select("series", "avg_recent"), X.p7(t).select("series", "name"))


# ---- composed plans --------------------------------------------------------------------------------

_EVENTS_BY_MONTH = """SELECT date_trunc('month', timestamp_start) AS m, CAST(count(*) AS DOUBLE) AS n, bool_or(is_sharks_game) AS big, bool_or(is_playoff) AS play FROM p4m GROUP BY 1"""
_HOUR_MODE = "SELECT m, h FROM (SELECT date_trunc('month', timestamp_start) AS m, game_start_hour AS h, row_number() OVER (PARTITION BY date_trunc('month', timestamp_start) ORDER BY count(*) DESC, game_start_hour) AS rn FROM p4m GROUP BY 1, 2) WHERE rn = 1"
_COVERED = "EXISTS (SELECT 1 FROM merged_spans s WHERE s.span_start <= b.ts AND last_day(b.ts) <= s.span_end)"


def od_panel(t):
    return X.p2(t).withColumn("origin", F.col("origin").cast("string"))


@query("build_feature_store", with_(["p2", "p3", "p4m", "merged_spans", "p7"], f"""SELECT b.series, b.ts, b.y, b.y / 22 AS ridership_daily, CASE WHEN cov THEN coalesce(e.n, 0) END AS hours_to_event,
  CAST(CAST(CASE WHEN cov THEN coalesce(e.n > 0, false) END AS INTEGER) AS DOUBLE) AS is_game_day, CAST(CAST(CASE WHEN cov THEN coalesce(e.big, false) END AS INTEGER) AS DOUBLE) AS is_sharks_game,
  CAST(CASE WHEN cov THEN hm.h END AS DOUBLE) AS game_start_hour, CAST(CAST(CASE WHEN cov THEN coalesce(e.play, false) END AS INTEGER) AS DOUBLE) AS is_playoff,
  hour(b.ts) AS hour_of_day, isodow(b.ts) - 1 AS day_of_week, {flag('isodow(b.ts) >= 6', 'is_weekend')}, month(b.ts) AS month, weekofyear(b.ts) AS week_of_year,
  (SELECT {flag(f'({HOLIDAY_SQL})', 'v')} FROM (SELECT b.ts AS d)) AS is_holiday, coalesce(s.v, r.v) AS temp_f, coalesce(sm.k, rm.k) AS weather_code
  FROM (SELECT *, {_COVERED} AS cov FROM (SELECT CAST(origin AS VARCHAR) AS series, period AS ts, sum(riders) AS y FROM p2 WHERE day_type = 'Total Trips' GROUP BY 1, 2) b) b
  LEFT JOIN ({_EVENTS_BY_MONTH}) e ON e.m = b.ts LEFT JOIN ({_HOUR_MODE}) hm ON hm.m = b.ts LEFT JOIN p7 ON CAST(p7.series AS VARCHAR) = b.series
  LEFT JOIN (SELECT station, mon, sum(v) / count(*) AS v FROM h GROUP BY 1, 2) s ON s.station = p7.weather_station AND s.mon = b.ts LEFT JOIN (SELECT mon, sum(v) / count(*) AS v FROM h GROUP BY 1) r ON r.mon = b.ts
  LEFT JOIN (SELECT station, mon, k, row_number() OVER (PARTITION BY station, mon ORDER BY count(*) DESC, k) AS rn FROM h GROUP BY 1, 2, 3) sm ON sm.rn = 1 AND sm.station = p7.weather_station AND sm.mon = b.ts
  LEFT JOIN (SELECT mon, k, row_number() OVER (PARTITION BY mon ORDER BY count(*) DESC, k) AS rn FROM h GROUP BY 1, 2) rm ON rm.rn = 1 AND rm.mon = b.ts""",
  {"h": f"SELECT station, mon, round(value * 100) AS v, k FROM ({HOURLY_SQL})"}))
def _(t):
    mapping = X.p7(t).select(F.col("series").cast("string").alias("series"), "weather_station")
    return FS.build_feature_store(od_panel(t), hourly_weather(t), X.p4_monthly(t), mapping, X.spans(t), ambiguous="drop")


# Every sixth month has lost its Total block, every sixth other one has two.
@query("store_refused_months", with_(["p2"], """SELECT period, count(DISTINCT CASE WHEN lower(d) LIKE '%total%' THEN d END) AS n_total_blocks FROM
  (SELECT period, CASE WHEN month(period) % 6 = 0 AND day_type = 'Total Trips' THEN 'Trips' WHEN month(period) % 6 = 1 AND day_type = 'Avg Weekday' THEN 'Total Weekday' ELSE day_type END AS d FROM p2)
  GROUP BY 1 HAVING count(DISTINCT CASE WHEN lower(d) LIKE '%total%' THEN d END) <> 1"""))
def _(t):
    sixth, kind = F.month("period") % 6, F.col("day_type")
    changed = F.when((sixth == 0) & (kind == "Total Trips"), "Trips").when((sixth == 1) & (kind == "Avg Weekday"), "Total Weekday").otherwise(kind)
    return FS.refused_months(od_panel(t).withColumn("day_type", changed))


# Every column that the build adds, in SQL; the panel is ``b`` with its day's holidays.
_CYCLIC = ", ".join(f"round({f}(2 * pi() * {e} / {n}), 6) + 0.0 AS {k}_{f}" for k, e, n in (("hour", "hour(b.ts)", 24), ("dow", "(isodow(b.ts) - 1)", 7), ("month", "(month(b.ts) - 1)", 12)) for f in ("sin", "cos"))
_TIME = f"""hour(b.ts) AS hour_of_day, isodow(b.ts) - 1 AS day_of_week, month(b.ts) AS month, weekofyear(b.ts) AS week_of_year, quarter(b.ts) AS quarter, year(b.ts) AS year,
  {flag('isodow(b.ts) >= 6', 'is_weekend')}, {flag('isodow(b.ts) = 1', 'is_monday')}, {flag('isodow(b.ts) = 5', 'is_friday')}, {_CYCLIC}, d.is_holiday, d.is_holiday_eve"""
_HUB = flag("CAST(b.series AS VARCHAR) IN (" + ", ".join(f"'{x}'" for x in HUB_STATIONS) + ")", "is_hub_station")


def _days(panel: str) -> str:
    """Holiday flags of each day of a panel."""
    return f"""SELECT t.day, t.v AS is_holiday, e.v AS is_holiday_eve FROM (SELECT d AS day, {flag(f'({HOLIDAY_SQL})', 'v')} FROM (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM {panel})) t
      JOIN (SELECT d - INTERVAL 1 DAY AS day, {flag(f'({HOLIDAY_SQL})', 'v')} FROM (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS d FROM {panel})) e ON e.day = t.day"""


def _months_back(k: int, least: int, fn: str) -> str:
    frame = "PARTITION BY b.series ORDER BY year(b.ts) * 12 + month(b.ts) RANGE BETWEEN {} PRECEDING AND 1 PRECEDING".format(k)
    return f"round(CASE WHEN count(y) OVER ({frame}) >= {least} THEN {fn}(y) OVER ({frame}) END, 3)"


_LAGS = ", ".join(f"first_value(y) OVER (PARTITION BY b.series ORDER BY year(b.ts) * 12 + month(b.ts) RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING) AS y_lag_{k}" for k in P.MONTHLY_LAGS)
_MONTHLY = f"{_LAGS}, {_months_back(3, 2, 'avg')} AS y_rolling_mean_3mo, {_months_back(3, 2, 'stddev_samp')} AS y_rolling_std_3mo, {_months_back(12, 6, 'avg')} AS y_rolling_mean_12mo"
_CYCLES = [f"{k}_{f}" for k in ("hour", "dow", "month") for f in ("sin", "cos")]


def _plain(df, *names):
    """Rounded to 6 places, with the sign of a rounded zero folded."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in names})


@query("build_features", with_(["p1", "p4m", "merged_spans"], f"""SELECT b.series, b.ts, y, {_TIME}, {flag('CASE WHEN cov THEN coalesce(e.n > 0, false) END', 'is_any_event_day')}, {flag('CASE WHEN cov THEN coalesce(e.big, false) END', 'is_sharks_game_window')},
  {flag('CASE WHEN cov THEN false END', 'is_pre_event_window')}, {flag('CASE WHEN cov THEN false END', 'is_post_event_window')}, CASE WHEN cov THEN coalesce(e.n, 0) / greatest(peak, 1) END AS event_proximity_score,
  CASE WHEN cov THEN CASE WHEN coalesce(e.big, false) THEN 2.0 WHEN coalesce(e.n, 0) > 0 THEN 1.0 ELSE 0.0 END END AS nearest_event_attendance_tier, NULL::DOUBLE AS hours_to_next_event, NULL::DOUBLE AS hours_since_last_event, {_HUB}, {_MONTHLY}
  FROM (SELECT *, {_COVERED} AS cov FROM p1 b) b JOIN days d ON d.day = date_trunc('day', b.ts) LEFT JOIN ({_EVENTS_BY_MONTH}) e ON e.m = b.ts,
  (SELECT max(n) AS peak FROM ({_EVENTS_BY_MONTH}) e2 WHERE EXISTS (SELECT 1 FROM merged_spans s WHERE s.span_start <= e2.m AND last_day(e2.m) <= s.span_end) AND e2.m IN (SELECT ts FROM p1))""", {"days": _days("p1")}))
def _(t):
    out = FS.build_features(X.p1(t), X.p4_monthly(t), X.spans(t))
    return rnd(_plain(out, *_CYCLES), 3, "y_rolling_mean_3mo", "y_rolling_std_3mo", "y_rolling_mean_12mo")


def _rows_back(n: int, least: int, fn: str) -> str:
    frame = f"PARTITION BY b.series ORDER BY b.ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    return f"round(CASE WHEN count(y) OVER ({frame}) >= {least} THEN {fn}(y) OVER ({frame}) END, 6)"


_HOURLY = f"""{", ".join(f"lag(y, {k}) OVER (PARTITION BY b.series ORDER BY b.ts) AS y_lag_{k}" for k in P.ROW_LAGS)}, {_rows_back(96, 24, 'avg')} AS y_rolling_mean_24h, {_rows_back(96, 24, 'stddev_samp')} AS y_rolling_std_24h, {_rows_back(672, 96, 'avg')} AS y_rolling_mean_7d,
  {", ".join(f"round(sum(precip_mm) OVER (PARTITION BY b.series ORDER BY b.ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS precip_{n}hr_sum" for n in (3, 6, 24))}"""
_RAINFALL = "CASE WHEN precip_mm <= 0.1 THEN 0.0 WHEN precip_mm <= 2.5 THEN 1.0 WHEN precip_mm <= 7.6 THEN 2.0 WHEN precip_mm <= 15 THEN 3.0 ELSE 4.0 END"
_WEATHER = f"""{flag('precip_mm > 0.1', 'is_raining')}, {_RAINFALL}::DOUBLE AS precip_intensity, {flag('temp_f < 40', 'is_very_cold')}, {flag('temp_f > 90', 'is_very_hot')}, round(temp_f - 65, 6) AS temp_deviation, {flag('windspeed_mph > 20', 'is_windy')},
  2 * {_RAINFALL} + 1.5 * CAST(temp_f < 40 AS INTEGER) + CAST(temp_f > 90 AS INTEGER) + 0.5 * CAST(windspeed_mph > 20 AS INTEGER) AS weather_discomfort, {flag('precip_mm > 0.1 AND NOT lag(precip_mm > 0.1) OVER (PARTITION BY b.series ORDER BY b.ts)', 'is_rain_onset')}"""
_PEAKS = f"{flag('hour(b.ts) BETWEEN 7 AND 9', 'is_am_peak')}, {flag('hour(b.ts) BETWEEN 16 AND 19', 'is_pm_peak')}, {flag('hour(b.ts) BETWEEN 10 AND 15', 'is_midday')}, {flag('hour(b.ts) >= 22 OR hour(b.ts) <= 5', 'is_late_night')}"


@query("build_features_sub_daily", with_(["p3", "p4"], f"""SELECT b.series, b.ts, b.temp_f, b.precip_mm, b.windspeed_mph, b.y, {_TIME}, {_PEAKS}, {_WEATHER}, {_HUB}, {_HOURLY}, {flag('coalesce(w.pre, false)', 'is_pre_event_window')}, {flag('coalesce(w.post, false)', 'is_post_event_window')},
  {flag('coalesce(w.big, false)', 'is_sharks_game_window')}, round(coalesce(w.prox, 0), 6) AS event_proximity_score, {flag('w.ts IS NOT NULL', 'is_any_event_day')}, CASE WHEN coalesce(w.big, false) THEN 2.0 WHEN w.ts IS NOT NULL THEN 1.0 ELSE 0.0 END AS nearest_event_attendance_tier,
  round(epoch(n.timestamp_start - b.ts) / 3600.0, 6) AS hours_to_next_event, round(epoch(b.ts - l.timestamp_end) / 3600.0, 6) AS hours_since_last_event
  FROM panel b JOIN days d ON d.day = date_trunc('day', b.ts) LEFT JOIN around w ON w.ts = b.ts ASOF LEFT JOIN (SELECT DISTINCT timestamp_start FROM p4) n ON b.ts < n.timestamp_start ASOF LEFT JOIN (SELECT DISTINCT timestamp_end FROM p4) l ON b.ts > l.timestamp_end""",
  {"panel": "SELECT station AS series, ts, temp_f, precip_mm, windspeed_mph, temp_f AS y FROM p3", "days": _days("p3"),
   "around": f"SELECT ts, bool_or(ds >= 0 AND ds <= 3) AS pre, bool_or(de < 0 AND de >= -1.5) AS post, bool_or(is_sharks_game) AS big, max(exp(-0.5 * (ds / 3) * (ds / 3))) AS prox FROM ({ACTIVE_SQL}) GROUP BY ts"}))
def _(t):
    """The whole build of an hourly panel: row lags, peaks, rain sums and events around the hour."""
    panel = X.p3(t).select(F.col("station").alias("series"), "ts", "temp_f", "precip_mm", "windspeed_mph", F.col("temp_f").alias("y"))
    out = FS.build_features(panel, X.p4(t), cadence="rows")
    rounded = ["temp_deviation", "event_proximity_score", "hours_to_next_event", "hours_since_last_event", "y_rolling_mean_24h", "y_rolling_std_24h", "y_rolling_mean_7d", *(f"precip_{n}hr_sum" for n in (3, 6, 24))]
    return rnd(_plain(out, *_CYCLES), 6, *rounded)
