"""Join operators."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import events as E
from ..operators import forecast as FC
from ..operators import gate as G
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import panel as P
from ..operators import places as PL
from ..operators import spans as SP
from . import fixtures as X
from .common import flag, rnd
from .fixtures import HORIZON, ORIGINS, TRAIN_END, with_
from .registry import query

# Four covariate stations on the panel's calendar: the hourly rows moved to twelve months.
HOURLY_SQL = "SELECT event_type AS station, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TIMESTAMP '1999-01-01' + to_months(CAST(event_id % 24 AS INTEGER)) AS mon FROM events"


def hourly_weather(t):
    return t.events.select(
        F.col("event_type").alias("station"), F.add_months(F.lit("1999-01-01").cast("date"), (F.col("event_id") % 24).cast("int")).cast("timestamp_ntz").alias("ts"),
        F.round(F.col("value") * 100).alias("temp_f"), F.get_json_object("props", "$.k").cast("long").alias("weather_code"),
    )


@query("join_weather_station_or_region", with_(["p1", "p7"], """SELECT p.series, p.ts, coalesce(s.v, r.v) AS temp_f, coalesce(sm.k, rm.k) AS weather_code FROM p1 p LEFT JOIN p7 USING (series)
  LEFT JOIN (SELECT station, mon, sum(v) / count(*) AS v FROM h GROUP BY 1, 2) s ON s.station = p7.weather_station AND s.mon = p.ts LEFT JOIN (SELECT mon, sum(v) / count(*) AS v FROM h GROUP BY 1) r ON r.mon = p.ts
  LEFT JOIN (SELECT station, mon, k, row_number() OVER (PARTITION BY station, mon ORDER BY count(*) DESC, k) AS rn FROM h GROUP BY 1, 2, 3) sm ON sm.rn = 1 AND sm.station = p7.weather_station AND sm.mon = p.ts
  LEFT JOIN (SELECT mon, k, row_number() OVER (PARTITION BY mon ORDER BY count(*) DESC, k) AS rn FROM h GROUP BY 1, 2) rm ON rm.rn = 1 AND rm.mon = p.ts""",
  {"h": f"SELECT station, mon, round(value * 100) AS v, k FROM ({HOURLY_SQL})"}))
def _(t):
    w = J.monthly_weather(hourly_weather(t), "station", "ts", ["temp_f"])
    return J.weather_or_region(X.p1(t), w, X.p7(t).select("series", "weather_station")).select("series", "ts", "temp_f", "weather_code")


@query("join_station_dim", "SELECT c_custkey, coalesce(n_name, c_name) AS station_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 4")
def _(t):
    dim = t.nation.where("n_regionkey <> 4").select(F.col("n_nationkey").alias("code"), "n_name")
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("code"), "c_name")
    return J.with_station_name(c, dim, "code", "n_name", "c_name").select("c_custkey", "station_name")


@query("join_station_dim_unknown", "SELECT DISTINCT c_nationkey AS code FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 4)")
def _(t):
    dim = t.nation.where("n_regionkey <> 4").select(F.col("n_nationkey").alias("code"))
    return J.unknown_codes(t.customer.select(F.col("c_nationkey").alias("code")), dim, "code")


_BY_MONTH = "SELECT date_trunc('month', timestamp_start) AS m, CAST(count(*) AS DOUBLE) AS n, bool_or(is_sharks_game) AS big FROM p4m GROUP BY 1"


@query("join_monthly_events", with_(["p1", "p4m"], f"SELECT p.series, p.ts, coalesce(e.n, 0) AS n_events, {flag('coalesce(e.big, false)', 'any_major')} FROM p1 p LEFT JOIN ({_BY_MONTH}) e ON e.m = p.ts"))
def _(t):
    m = E.monthly_events(X.p4_monthly(t)).withColumnRenamed("_month", "ts").select("ts", "n_events", "any_major")
    return X.p1(t).join(m, "ts", "left").select("series", "ts", F.coalesce("n_events", F.lit(0.0)).alias("n_events"), F.coalesce("any_major", F.lit(False)).alias("any_major"))


@query("join_month_coverage", with_(["p1", "merged_spans"], f"SELECT series, ts, {flag('EXISTS (SELECT 1 FROM merged_spans s WHERE s.span_start <= ts AND last_day(ts) <= s.span_end)', 'covered')} FROM p1"))
def _(t):
    return SP.with_coverage(X.p1(t), X.spans(t)).select("series", "ts", "covered")


ACTIVE_SQL = """SELECT g.ts, epoch(e.timestamp_start - g.ts) / 3600.0 AS ds, epoch(e.timestamp_end - g.ts) / 3600.0 AS de, e.is_sharks_game
  FROM (SELECT DISTINCT ts FROM p3) g JOIN p4 e ON e.timestamp_start <= g.ts + INTERVAL 3 HOUR AND e.timestamp_end >= g.ts - INTERVAL 90 MINUTE"""


@query("join_event_window", with_(["p3", "p4"], f"""SELECT ts, {flag('bool_or(ds >= 0 AND ds <= 3)', 'is_pre_event_window')}, {flag('bool_or(de < 0 AND de >= -1.5)', 'is_post_event_window')},
  {flag('bool_or(is_sharks_game)', 'is_sharks_game_window')}, count(*) AS n_active FROM ({ACTIVE_SQL}) GROUP BY ts""", ))
def _(t):
    # Distinct (start, end) pairs; the stream's time stamps are distinct, so each row is one event.
    return E.event_windows(X.p3(t), X.p4(t)).select("ts", "is_pre_event_window", "is_post_event_window", "is_sharks_game_window", "n_active")


@query("join_next_event", with_(["p3", "p4"], "SELECT g.ts, round(epoch(e.timestamp_start - g.ts) / 3600.0, 6) AS hours_to_next_event FROM (SELECT DISTINCT ts FROM p3) g ASOF LEFT JOIN (SELECT DISTINCT timestamp_start FROM p4) e ON g.ts < e.timestamp_start"))
def _(t):
    return rnd(E.hours_to_next(X.p3(t), X.p4(t)), 6, "hours_to_next_event")


@query("join_last_ended_event", with_(["p3", "p4"], "SELECT g.ts, round(epoch(g.ts - e.timestamp_end) / 3600.0, 6) AS hours_since_last_event FROM (SELECT DISTINCT ts FROM p3) g ASOF LEFT JOIN (SELECT DISTINCT timestamp_end FROM p4) e ON g.ts > e.timestamp_end"))
def _(t):
    return rnd(E.hours_since_last(X.p3(t), X.p4(t)), 6, "hours_since_last_event")


@query("add_event_features", with_(["p3", "p4"], f"""SELECT g.station, g.ts, {flag('coalesce(w.pre, false)', 'is_pre_event_window')}, {flag('coalesce(w.post, false)', 'is_post_event_window')}, {flag('coalesce(w.big, false)', 'is_sharks_game_window')}, {flag('w.ts IS NOT NULL', 'is_any_event_day')},
  round(coalesce(w.prox, 0), 6) AS event_proximity_score, CASE WHEN coalesce(w.big, false) THEN 2.0 WHEN w.ts IS NOT NULL THEN 1.0 ELSE 0.0 END AS nearest_event_attendance_tier,
  round(epoch(n.timestamp_start - g.ts) / 3600.0, 6) AS hours_to_next_event, round(epoch(g.ts - l.timestamp_end) / 3600.0, 6) AS hours_since_last_event
  FROM p3 g LEFT JOIN (SELECT ts, bool_or(ds >= 0 AND ds <= 3) AS pre, bool_or(de < 0 AND de >= -1.5) AS post, max(exp(-0.5 * (ds / 3) * (ds / 3))) AS prox, bool_or(is_sharks_game) AS big FROM ({ACTIVE_SQL}) GROUP BY ts) w ON w.ts = g.ts
  ASOF LEFT JOIN (SELECT DISTINCT timestamp_start FROM p4) n ON g.ts < n.timestamp_start ASOF LEFT JOIN (SELECT DISTINCT timestamp_end FROM p4) l ON g.ts > l.timestamp_end"""))
def _(t):
    out = E.add_event_features(X.p3(t).select("station", "ts"), X.p4(t))
    return rnd(out, 6, "event_proximity_score", "hours_to_next_event", "hours_since_last_event")


@query("join_asof_regime", with_(["p1"], "SELECT series, ts, coalesce((SELECT max(p) FROM (VALUES ('1996-03-01'), ('1998-01-01'), ('1999-09-01')) v(p) WHERE CAST(p AS TIMESTAMP) <= ts), '1996-03-01') AS method_period FROM p1"))
def _(t):
    return FC.asof_period(X.p1(t), ["1996-03-01", "1998-01-01", "1999-09-01"]).select("series", "ts", "method_period")


@query("join_actual_forecast_inner", with_(["p1", "p5"], "SELECT series, ts, y, p50 FROM p1 JOIN p5 USING (series, ts)"))
def _(t):
    return J.actual_forecast_inner(X.p1(t), X.p5(t)).select("series", "ts", "y", "p50")


@query("join_actual_forecast_left", with_(["p1", "p5"], f"SELECT p1.series, p1.ts, y, p50, {flag('p5.series IS NOT NULL', 'forecast_present')} FROM p1 LEFT JOIN p5 ON p1.series = p5.series AND p1.ts = p5.ts"))
def _(t):
    return M.drop_unless_overlap(M.actuals_left(X.p1(t), X.p5(t))).select("series", "ts", "y", "p50", "forecast_present")


@query("join_paired_complete", with_(["p1", "p5", "p5r"], """SELECT count(DISTINCT series) AS n_series, CAST(count(*) FILTER (WHERE c.series IS NULL) AS BIGINT) AS without_control, CAST(count(*) FILTER (WHERE a.series IS NULL) AS BIGINT) AS without_arm
  FROM (SELECT * FROM p1 WHERE ts > TIMESTAMP '1999-12-31') p FULL JOIN p5 c USING (series, ts) FULL JOIN p5r a USING (series, ts)"""))
def _(t):
    p = X.p1(t).where(F.col("ts") > F.lit(TRAIN_END).cast("timestamp_ntz"))
    return M.pairing_report(p, X.p5(t), X.p5_recent(t)).select("n_series", "without_control", "without_arm")


@query("join_three_way_forecast", with_(["p1", "p5", "p5r"], "SELECT series, ts, a.p50 AS p50_a, round(b.p50, 6) AS p50_b, y FROM p5 a JOIN p5r b USING (series, ts) JOIN p1 USING (series, ts)"))
def _(t):
    return rnd(J.three_way(X.p5(t), X.p5_recent(t), X.p1(t)), 6, "p50_b").select("series", "ts", "p50_a", "p50_b", "y")


@query("join_backfill_diagnostics", with_(["p1"], f"SELECT series, ts, y, {flag('y > 3000000', 'is_raining')}, month(ts) AS month FROM p1"))
def _(t):
    p = X.p1(t)
    enriched = p.withColumns({"is_raining": F.col("y") > 3_000_000, "month": F.month("ts")})
    return J.backfill_diagnostics(p.withColumn("is_raining", F.lit(0.25)), enriched, ["is_raining", "month", "absent"]).select("series", "ts", "y", "is_raining", "month")


_CAND = "SELECT series, ts, CASE WHEN month(ts) = 7 THEN y + 1 ELSE y END AS y, CASE WHEN series = 5 THEN NULL ELSE y / 2 END AS temp_f FROM p1 WHERE NOT (series = 3 AND month(ts) = 2)"


def candidate(t, p=None):
    """P8: the panel with a changed July, a NULL covariate and missing keys."""
    p = X.p1(t) if p is None else p
    return p.where(~((F.col("series") == 3) & (F.month("ts") == 2))).select(
        "series", "ts", F.when(F.month("ts") == 7, F.col("y") + 1).otherwise(F.col("y")).alias("y"), F.when(F.col("series") != 5, F.col("y") / 2).alias("temp_f")
    )


def tracked(t, p=None):
    return (X.p1(t) if p is None else p).withColumn("temp_f", F.col("y") / 2)


@query("join_tracked_candidate", with_(["p1"], f"SELECT t.series, t.ts, t.y AS y_t, c.y AS y_c, {flag('c.series IS NOT NULL', 'present')} FROM p1 t LEFT JOIN ({_CAND}) c ON t.series = c.series AND t.ts = c.ts"))
def _(t):
    return G.join_tracked(candidate(t), tracked(t), ["series", "ts"]).select("series", "ts", "y_t", "y_c", "present")


@query("join_pool_full_vs_cut", with_(["p6"], f"SELECT count(*) AS rows_compared, CAST(0.0 AS DOUBLE) AS max_abs_diff, CAST(0 AS BIGINT) AS cut_only FROM p6 WHERE p50 IS NOT NULL AND origin + INTERVAL {HORIZON} MONTH > TIMESTAMP '{TRAIN_END}'"))
def _(t):
    p = X.p1(t)
    cut = FC.rolling_pool(p.where(F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz")), ORIGINS, HORIZON, TRAIN_END)
    full = FC.rolling_pool(p, ORIGINS, HORIZON, None)
    return M.cut_check(cut, full, F.lit(TRAIN_END).cast("timestamp_ntz"), HORIZON).select("rows_compared", "max_abs_diff", "cut_only")


@query("anti_missing_keys", with_(["p1"], f"SELECT series, ts FROM p1 EXCEPT SELECT series, ts FROM ({_CAND})"))
def _(t):
    return J.only_in_left(tracked(t), candidate(t), ["series", "ts"])


@query("semi_station_sets", "SELECT s_nationkey AS code, 'supplier only' AS side FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 500) GROUP BY 1 UNION ALL SELECT s_nationkey, 'both' FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 500) GROUP BY 1")
def _(t):
    s = t.supplier.select(F.col("s_nationkey").alias("code"))
    c = t.customer.where("c_acctbal < 500").select(F.col("c_nationkey").alias("code"))
    return J.only_in_left(s, c, ["code"]).withColumn("side", F.lit("supplier only")).unionByName(J.in_both(s, c, ["code"]).withColumn("side", F.lit("both")))


@query("cross_series_grid", with_(["p1"], "SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 MONTH)) AS ts FROM p1 GROUP BY series"))
def _(t):
    return P.month_grid(X.p1(t))


@query("cross_series_grid_shared", "SELECT s.o_custkey AS series, CAST(g.ts AS TIMESTAMP) AS ts FROM (SELECT DISTINCT o_custkey FROM orders) s, (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS ts FROM orders) g")
def _(t):
    return P.shared_grid(t.orders.select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("ts")))


@query("cross_origins_models", with_(["p6"], "SELECT origin, candidate, group_by, count(*) AS n FROM p6, (VALUES ('hl6', 'pooled'), ('hl6', 'horizon'), ('eq', 'pooled')) v(candidate, group_by) GROUP BY ALL"))
def _(t):
    cands = [{"candidate": "hl6", "group_by": "pooled"}, {"candidate": "hl6", "group_by": "horizon"}, {"candidate": "eq", "group_by": "pooled"}]
    return J.evaluation_matrix(X.p6(t), cands).groupBy("origin", "candidate", "group_by").agg(F.count(F.lit(1)).alias("n"))


# Points are suppliers spread over the city and the month, events sit on a coarse lattice of venues.
_PTS = "SELECT s_suppkey, TIMESTAMP '2024-01-01' + to_hours(CAST(s_suppkey * 7 % 700 AS INTEGER)) AS at, 37.3 + (s_suppkey % 17) * 0.01 AS lat, -121.9 + (s_suppkey % 13) * 0.01 AS lng FROM supplier"
_EVS = "SELECT DISTINCT event_type AS event_name, ts AS timestamp_start, 37.3 + (user_id % 19) * 0.01 AS lat, -121.9 + (user_id % 11) * 0.01 AS lng FROM events"
_HAV = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(e.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(e.lat)) * pow(sin(radians(e.lng - p.lng) / 2), 2)))"


@query("near_events", f"""SELECT s_suppkey, event_name, timestamp_start, round(min(km), 6) AS km FROM (SELECT p.s_suppkey, e.event_name, e.timestamp_start, {_HAV} AS km FROM ({_PTS}) p JOIN ({_EVS}) e
  ON e.timestamp_start BETWEEN p.at - INTERVAL 3 HOUR AND p.at + INTERVAL 3 HOUR) WHERE km <= 1.5 GROUP BY 1, 2, 3""")
def _(t):
    s, u = F.col("s_suppkey"), F.col("user_id")
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (s * 7 % 700).cast("int"))
    pts = t.supplier.select("s_suppkey", start.alias("at"), (s % 17 * F.lit(0.01) + 37.3).alias("lat"), (s % 13 * F.lit(0.01) - 121.9).alias("lng"))
    ev = t.events.select(F.col("event_type").alias("event_name"), F.col("ts").alias("timestamp_start"), (u % 19 * F.lit(0.01) + 37.3).alias("lat"), (u % 11 * F.lit(0.01) - 121.9).alias("lng"))
    return E.near_events(pts, ev, "s_suppkey", "at", digits=6)


@query("active_alerts", """SELECT DISTINCT CASE id WHEN 'click' THEN 'BART' WHEN 'error' THEN 'VTA' WHEN 'signup' THEN 'Caltrain' END AS agency, 'user ' || user_id AS header FROM
  (SELECT event_type AS id, user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, event_id FROM events) WHERE id IN ('click', 'signup') AND (event_id % 5 = 0 OR ((event_id % 5 = 1 OR s <= 1705276800) AND (event_id % 5 = 2 OR 1705276800 <= s + 86400)))""")
def _(t):
    from ..functions.calendar import epoch_seconds

    s, i = F.floor(epoch_seconds("ts")).cast("long"), F.col("event_id") % 5
    zero = F.lit(0).cast("long")
    period = F.struct(F.when(i == 1, zero).otherwise(s).alias("start"), F.when(i == 2, zero).otherwise(s + 86400).alias("end"))
    alerts = t.events.select(F.array("event_type").alias("agency_ids"), F.concat(F.lit("user "), "user_id").alias("header"), F.when(i == 0, F.array().cast("array<struct<start: bigint, end: bigint>>")).otherwise(F.array(period)).alias("periods"))
    return E.active_alerts(alerts, 1705276800, {"click": "BART", "error": "VTA", "signup": "Caltrain"}, ["BART", "Caltrain"])


# Names typed by riders: part names in mixed case with filler words, against the distinct two-word names.
_Q = "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' Station' WHEN 1 THEN 'The ' || p_name WHEN 2 THEN split_part(p_name, ' ', 1) ELSE p_name || ' annex ' || p_size END AS q FROM part"
_TOK = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('station', 'bart', 'the'))"
_MATCH = f"""WITH q AS (SELECT q, {_TOK.format(c='q')} AS qt FROM ({_Q})), d AS (SELECT DISTINCT p_name AS station, {_TOK.format(c='p_name')} AS dt FROM part),
  ex AS (SELECT q, min(station) AS station, count(*) AS n FROM q JOIN d ON qt = dt GROUP BY q),
  nest AS (SELECT q, min(station) AS station, count(*) AS n FROM q JOIN d ON list_has_all(dt, qt) OR list_has_all(qt, dt) WHERE q NOT IN (SELECT q FROM ex WHERE n = 1) GROUP BY q)
  SELECT q.q, CASE WHEN ex.n = 1 THEN ex.station WHEN nest.n = 1 THEN nest.station END AS station, CASE WHEN ex.n = 1 THEN 'exact' WHEN nest.n IS NOT NULL THEN 'subset' ELSE 'none' END AS tier
  FROM q LEFT JOIN ex ON q.q = ex.q LEFT JOIN nest ON q.q = nest.q"""


def _place_queries(t):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    return t.part.select(
        F.when(k == 0, F.concat(F.upper(name), F.lit(" Station"))).when(k == 1, F.concat(F.lit("The "), name)).when(k == 2, F.split_part(name, F.lit(" "), F.lit(1)))
        .otherwise(F.concat(name, F.lit(" annex "), F.col("p_size").cast("string"))).alias("q")
    )


@query("match_place_name", _MATCH)
def _(t):
    dim = t.part.select(F.col("p_name").alias("station"), F.col("p_name").alias("label")).distinct()
    return PL.match_places(_place_queries(t), dim, "q", "station", "label", fuzzy=False)


@query("match_place_name_fuzzy")
def _(t):
    # Spelling tier: every distinct part name with its fourth letter dropped.
    dim = t.part.select(F.col("p_name").alias("station"), F.col("p_name").alias("label")).distinct()
    typed = t.part.select(F.concat(F.substring("p_name", 1, 3), F.col("p_name").substr(F.lit(5), F.lit(100))).alias("q"))
    return PL.match_places(typed, dim, "q", "station", "label")


@query("same_place", f"SELECT c_custkey, {flag('upper(c_mktsegment) = upper(s2)', 'same_text')}, {flag('2 * 6371000 * asin(sqrt(pow(sin(radians(d) / 2), 2))) <= 150', 'same_point')} FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'BUILDING' END AS s2, (c_custkey % 7) * 0.0005 AS d FROM customer)")
def _(t):
    k = F.col("c_custkey")
    other = F.when(k % 3 == 0, F.concat(F.lit("  "), F.initcap("c_mktsegment"), F.lit(", San Francisco Bay Area, CA"))).otherwise("building")
    return t.customer.select("c_custkey", PL.same_place_text("c_mktsegment", other).alias("same_text"), PL.same_place_points(F.lit(37.0), F.lit(-122.0), k % 7 * F.lit(0.0005) + 37.0, F.lit(-122.0)).alias("same_point"))
