"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import month_start
from ..operators import aggregates as A
from ..operators import events as E
from ..operators import joins as J
from ..sources import od as O
from . import fixtures as X
from .common import flag, rnd
from .fixtures import with_
from .joins import hourly_weather
from .registry import query
from .scores import interval_sql


@query("agg_boardings", with_(["p2"], "SELECT period, origin, sum(riders) AS ridership, sum(riders) / 22 AS ridership_daily FROM p2 WHERE day_type = 'Total Trips' GROUP BY 1, 2"))
def _(t):
    return O.boardings(O.total_rows(X.p2(t)))


@query("agg_exits", with_(["p2"], "SELECT destination, period AS month, sum(riders) AS total FROM p2 GROUP BY 1, 2"))
def _(t):
    return A.station_months(X.p2(t))


@query("agg_station_year", with_(["p2"], "SELECT destination, year(month) AS year, avg(total) AS mean_monthly, count(*) AS n_months FROM (SELECT destination, period AS month, sum(riders) AS total FROM p2 GROUP BY 1, 2) GROUP BY 1, 2"))
def _(t):
    return A.mean_monthly(X.p2(t))


_H = """SELECT event_type AS station, TIMESTAMP '1999-01-01' + to_months(CAST(event_id % 24 AS INTEGER)) AS mon, round(value * 100) AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""


@query("agg_weather_monthly", f"""WITH h AS ({_H}) SELECT a.station, a.mon AS month, a.v AS temp_f, m.k AS weather_code, a.lvl AS station_level FROM
  (SELECT station, mon, sum(v) / count(*) AS v, 1.0::DOUBLE AS lvl FROM h GROUP BY 1, 2 UNION ALL SELECT NULL, mon, sum(v) / count(*), 0.0 FROM h GROUP BY mon) a JOIN
  (SELECT station, mon, k, row_number() OVER (PARTITION BY station, mon ORDER BY count(*) DESC, k) AS rn FROM h GROUP BY 1, 2, 3 UNION ALL SELECT NULL, mon, k, row_number() OVER (PARTITION BY mon ORDER BY count(*) DESC, k) FROM h GROUP BY mon, k) m
  ON m.rn = 1 AND m.station IS NOT DISTINCT FROM a.station AND m.mon = a.mon""")
def _(t):
    return J.monthly_weather(hourly_weather(t), "station", "ts", ["temp_f"])


_COV = "EXISTS (SELECT 1 FROM merged_spans s WHERE s.span_start <= p.ts AND last_day(p.ts) <= s.span_end)"
_MODE = "SELECT m, h FROM (SELECT date_trunc('month', timestamp_start) AS m, game_start_hour AS h, row_number() OVER (PARTITION BY date_trunc('month', timestamp_start) ORDER BY count(*) DESC, game_start_hour) AS rn FROM p4m GROUP BY 1, 2) WHERE rn = 1"
_EV = "SELECT date_trunc('month', timestamp_start) AS m, CAST(count(*) AS DOUBLE) AS n, bool_or(is_sharks_game) AS big, bool_or(is_playoff) AS play FROM p4m GROUP BY 1"


@query("agg_events_monthly", with_(["p1", "p4m", "merged_spans"], f"""SELECT p.series, p.ts, CASE WHEN cov THEN coalesce(e.n, 0) END AS hours_to_event, {flag('CASE WHEN cov THEN coalesce(e.n > 0, false) END', 'is_game_day')},
  {flag('CASE WHEN cov THEN coalesce(e.big, false) END', 'is_sharks_game')}, {flag('CASE WHEN cov THEN coalesce(e.play, false) END', 'is_playoff')}, CASE WHEN cov THEN CAST(h.h AS DOUBLE) END AS game_start_hour
  FROM (SELECT *, {_COV} AS cov FROM p1 p) p LEFT JOIN ({_EV}) e ON e.m = p.ts LEFT JOIN ({_MODE}) h ON h.m = p.ts"""))
def _(t):
    return E.add_monthly_events(X.p1(t), X.p4_monthly(t), X.spans(t)).drop("y")


@query("agg_events_monthly_fe", with_(["p1", "p4m", "merged_spans"], f"""SELECT p.series, p.ts, CASE WHEN cov THEN coalesce(e.n, 0) / greatest(max(CASE WHEN cov THEN coalesce(e.n, 0) END) OVER (), 1) END AS event_proximity_score,
  {flag('CASE WHEN cov THEN coalesce(e.n, 0) > 0 END', 'is_any_event_day')}, CASE WHEN cov THEN CASE WHEN e.big THEN 2.0 WHEN e.n > 0 THEN 1.0 ELSE 0.0 END END AS nearest_event_attendance_tier
  FROM (SELECT *, {_COV} AS cov FROM p1 p) p LEFT JOIN ({_EV}) e ON e.m = p.ts"""))
def _(t):
    return E.add_monthly_event_features(X.p1(t), X.p4_monthly(t), X.spans(t)).select("series", "ts", "event_proximity_score", "is_any_event_day", "nearest_event_attendance_tier")


@query("agg_network_month", with_(["p1"], "SELECT ts, sum(y) AS total FROM p1 GROUP BY ts"))
def _(t):
    return A.network_months(X.p1(t))


@query("agg_network_year", with_(["p1"], "SELECT year(ts) AS year, sum(y) AS total, sum(y) / (SELECT sum(y) FROM p1 WHERE year(ts) = 1996) AS share FROM p1 GROUP BY 1"))
def _(t):
    return A.network_years(X.p1(t), 1996)


@query("agg_network_absent_years", "SELECT y AS year FROM (SELECT unnest(generate_series(min(y), max(y))) AS y FROM (SELECT 2 * year(o_orderdate) - 1995 AS y FROM orders)) WHERE y NOT IN (SELECT 2 * year(o_orderdate) - 1995 FROM orders)")
def _(t):
    # Every second year is empty once the calendar is stretched.
    later = F.add_months(F.col("o_orderdate").cast("date"), (F.year("o_orderdate") - 1995) * 12)
    return A.absent_years(t.orders.select(later.cast("timestamp_ntz").alias("ts")))


@query("agg_like_for_like", with_(["p1"], """SELECT year(ts) AS year, sum(y) AS total, sum(y) / sum(sum(CASE WHEN year(ts) = 1996 THEN y END)) OVER () AS share FROM (SELECT series, ts, CASE WHEN series % 5 = 0 AND year(ts) = 1996 THEN 0 ELSE y END AS y FROM p1)
  WHERE series NOT IN (SELECT series FROM p1 WHERE year(ts) = 1996 AND series % 5 = 0) GROUP BY 1"""))
def _(t):
    opened_later = X.p1(t).withColumn("y", F.when((F.col("series") % 5 == 0) & (F.year("ts") == 1996), 0.0).otherwise(F.col("y")))
    return A.like_for_like(opened_later, 1996)


@query("agg_seasonal_index", with_(["p1"], """SELECT year(ts) AS year, month(ts) AS month, round(total / avg(total) OVER (PARTITION BY year(ts)), 8) AS index_total, round(d / avg(d) OVER (PARTITION BY year(ts)), 8) AS index_per_day
  FROM (SELECT ts, sum(y) AS total, sum(y) / day(last_day(ts)) AS d FROM p1 GROUP BY ts)"""))
def _(t):
    return rnd(A.seasonal_index(X.p1(t)), 8, "index_total", "index_per_day")


@query("agg_rank_medians", with_(["p1"], """SELECT *, CASE WHEN median_post IS NOT NULL THEN row_number() OVER (ORDER BY median_post DESC NULLS LAST, series) END AS rank_post, CASE WHEN median_base IS NOT NULL THEN CAST(rank() OVER (ORDER BY median_base DESC NULLS LAST) AS DOUBLE) END AS rank_base FROM (
  SELECT series, quantile_cont(y, 0.5) FILTER (WHERE year(ts) >= 1998) AS median_post, CASE WHEN sum(CASE WHEN year(ts) = 1996 THEN y END) <> 0 THEN quantile_cont(y, 0.5) FILTER (WHERE year(ts) = 1996) END AS median_base FROM (SELECT series, ts, CASE WHEN series % 7 = 0 AND year(ts) = 1996 THEN 0 ELSE y END AS y FROM p1) GROUP BY series)"""))
def _(t):
    df = X.p1(t).withColumn("y", F.when((F.col("series") % 7 == 0) & (F.year("ts") == 1996), 0.0).otherwise(F.col("y")))
    return A.rank_medians(df, 1996, 1998)


@query("agg_topk_share", with_(["p1"], "SELECT series, total, share, cum AS cum_share, rn AS rank FROM (SELECT series, sum(y) AS total, sum(y) / sum(sum(y)) OVER () AS share, sum(sum(y)) OVER (ORDER BY sum(y) DESC, series) / sum(sum(y)) OVER () AS cum, row_number() OVER (ORDER BY sum(y) DESC, series) AS rn FROM p1 GROUP BY series) WHERE rn <= 6"))
def _(t):
    return A.top_share(X.p1(t), 6)


@query("agg_lorenz", "SELECT o_custkey AS series, v AS total, sum(v) OVER (ORDER BY v, o_custkey ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS cum_share, row_number() OVER (ORDER BY v, o_custkey) * 1.0::DOUBLE / count(*) OVER () * 100 AS entity_pct FROM (SELECT o_custkey, sum(round(o_totalprice)) AS v FROM orders GROUP BY 1)")
def _(t):
    return A.lorenz(t.orders.groupBy(F.col("o_custkey").alias("series")).agg(F.sum(F.round("o_totalprice")).alias("total")), "series", "total")


@query("agg_lorenz_top20", "SELECT round(1 - min_by(c, p), 8) AS top20_share FROM (SELECT sum(v) OVER (ORDER BY v, k ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS c, row_number() OVER (ORDER BY v, k) * 100.0::DOUBLE / count(*) OVER () AS p FROM (SELECT o_custkey AS k, sum(round(o_totalprice)) AS v FROM orders GROUP BY 1)) WHERE p >= 80 - 1e-9")
def _(t):
    curve = A.lorenz(t.orders.groupBy(F.col("o_custkey").alias("series")).agg(F.sum(F.round("o_totalprice")).alias("total")), "series", "total")
    return rnd(A.top_fifth_share(curve), 8, "top20_share")


_DESC = ["mean", "std", "skew", "kurtosis", "q1", "median", "q3", "mad", "trimmed_mean", "iqr"]


@query("agg_describe", """WITH e AS (SELECT o_orderpriority AS grp, round(o_totalprice) AS v FROM orders), m AS (SELECT grp, quantile_cont(v, 0.5) AS med, count(*) AS n FROM e GROUP BY grp)
  SELECT grp, n, min, max, round(mean, 4) AS mean, round(std, 4) AS std, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, q1, median, q3, mad, round(trimmed_mean, 4) AS trimmed_mean, q3 - q1 AS iqr FROM
  (SELECT grp, count(*) AS n, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS std, skewness(v) AS skew, kurtosis(v) AS kurtosis, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM e GROUP BY grp)
  JOIN (SELECT e.grp, quantile_cont(abs(v - med), 0.5) AS mad FROM e JOIN m USING (grp) GROUP BY 1) USING (grp)
  JOIN (SELECT grp, avg(v) AS trimmed_mean FROM (SELECT e.grp, v, n, row_number() OVER (PARTITION BY e.grp ORDER BY v) AS p FROM e JOIN m USING (grp)) WHERE p > floor(n * 0.1) AND p <= n - floor(n * 0.1) GROUP BY grp) USING (grp)""")
def _(t):
    d = A.describe(t.orders.select(F.col("o_orderpriority").alias("grp"), F.round("o_totalprice").alias("v")), "v", ["grp"])
    return rnd(rnd(d, 4, "mean", "std", "trimmed_mean"), 6, "skew", "kurtosis")


@query("agg_daytype_stats", with_(["p2"], "SELECT day_type, count(*) AS n, avg(riders) AS mean, quantile_cont(riders, 0.5) AS median, round(stddev_samp(riders), 6) AS std, quantile_cont(riders, 0.75) - quantile_cont(riders, 0.25) AS iqr FROM p2 WHERE riders > 0 GROUP BY 1"))
def _(t):
    return rnd(A.daytype_stats(X.p2(t)), 6, "std")


@query("agg_yoy_table", with_(["p2"], "SELECT year(period) AS year, avg(riders) AS mean, quantile_cont(riders, 0.5) AS median, round(stddev_samp(riders), 6) AS std, CASE WHEN year(period) > 1996 THEN avg(riders) / (SELECT avg(riders) FROM p2 WHERE year(period) = 1996) * 100 END AS pct_of_base FROM p2 GROUP BY 1"))
def _(t):
    return rnd(A.yearly_table(X.p2(t), 1996, "period", "riders"), 6, "std")


@query("agg_daytype_seasonal", with_(["p2"], """SELECT day_type, s AS summer, w AS winter, round((s - w) / w * 100, 6) AS swing_pct, m AS mean FROM (SELECT day_type, avg(riders) FILTER (WHERE month(period) IN (6, 7, 8)) AS s, avg(riders) FILTER (WHERE month(period) IN (12, 1, 2)) AS w, avg(riders) AS m FROM p2 GROUP BY 1)"""))
def _(t):
    return rnd(A.seasonal_swing(X.p2(t), "period", "riders"), 6, "swing_pct")


@query("agg_daytype_ratio", with_(["p2"], "SELECT avg(riders) FILTER (WHERE day_type = 'Avg Weekday') / avg(riders) FILTER (WHERE day_type = 'Avg Saturday') AS weekday_saturday_ratio FROM p2"))
def _(t):
    return A.weekday_saturday_ratio(X.p2(t), "riders")


@query("agg_weekend_ratio", """SELECT l_partkey AS route, wd AS weekday, sa AS saturday, su AS sunday, round((sa + su) / (2 * wd + 1), 8) AS ratio, CASE WHEN (sa + su) / (2 * wd + 1) > 0.8 THEN 'weekend-heavy' WHEN (sa + su) / (2 * wd + 1) < 0.4 THEN 'commuter' ELSE 'mixed' END AS class FROM
  (SELECT l_partkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS wd, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS sa, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS su FROM lineitem GROUP BY 1) WHERE wd IS NOT NULL AND sa IS NOT NULL AND su IS NOT NULL""")
def _(t):
    return rnd(A.weekend_ratio(t.lineitem.withColumnRenamed("l_partkey", "route"), "route", "l_returnflag", "l_quantity", ("N", "A", "R")), 8, "ratio")


@query("agg_category_mean_ratio", "SELECT p_brand AS line_type, avg(p_size) AS mean, (SELECT avg(p_size) FROM part WHERE p_brand = 'Brand#1') / (SELECT avg(p_size) FROM part WHERE p_brand = 'Brand#2') AS ratio FROM part GROUP BY 1")
def _(t):
    return A.category_ratio(t.part.withColumnRenamed("p_brand", "line_type"), "line_type", "p_size", "Brand#1", "Brand#2")


@query("agg_missing_profile", """SELECT 'y_lag' AS "column", count(*) FILTER (WHERE l IS NULL) AS nulls, count(*) FILTER (WHERE l IS NULL) * 100.0::DOUBLE / count(*) AS null_pct, count(*) FILTER (WHERE l = 0) AS zeros FROM (SELECT lag(o_orderkey % 3, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l FROM orders)
  UNION ALL SELECT 'o_orderkey', count(*) FILTER (WHERE o_orderkey IS NULL), count(*) FILTER (WHERE o_orderkey IS NULL) * 100.0::DOUBLE / count(*), count(*) FILTER (WHERE o_orderkey = 0) FROM orders
  UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS NULL), count(*) FILTER (WHERE o_orderpriority IS NULL) * 100.0::DOUBLE / count(*), 0 FROM orders""")
def _(t):
    from ..operators.ordered import windowed_by_rows

    df = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 3).alias("_v"))
    df = windowed_by_rows(df, ["o_custkey"], ["o_orderkey"], 2, lambda w: {"y_lag": F.lag("_v", 2).over(w)}, F.floor(F.col("o_orderkey") / 65536))
    return A.missing_profile(df.select("y_lag", "o_orderkey", "o_orderpriority"))


@query("agg_full_duplicates", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_shipdate, l_quantity)")
def _(t):
    return A.full_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_shipdate", "l_quantity"))


_FEATS = {"l_discount": "l_discount", "l_tax": "l_tax", "l_extendedprice": "l_extendedprice", "is_returned": "CAST(l_returnflag = 'R' AS INTEGER)"}
_RANKED = " UNION ALL ".join(f"SELECT '{k}' AS feature, corr({e}, l_quantity) AS pearson, (SELECT corr(rx, ry) FROM (SELECT rank() OVER (ORDER BY {e}) + (count(*) OVER (PARTITION BY {e}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ry FROM lineitem)) AS spearman, count(*) AS n FROM lineitem" for k, e in _FEATS.items())


@query("agg_corr_pearson_spearman", f"SELECT feature, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, n FROM ({_RANKED})")
def _(t):
    df = t.lineitem.withColumn("is_returned", F.col("l_returnflag") == "R")
    return rnd(A.correlations(df, "l_quantity", list(_FEATS)), 6, "pearson", "spearman").drop("abs_pearson")


@query("agg_corr_matrix", with_(["p2"], """SELECT a.day_type AS var_a, b.day_type AS var_b, round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM (SELECT destination, day_type, sum(riders) AS v FROM p2 GROUP BY 1, 2) a JOIN (SELECT destination, day_type, sum(riders) AS v FROM p2 GROUP BY 1, 2) b USING (destination)
  WHERE destination IN (SELECT destination FROM p2 GROUP BY 1 HAVING count(DISTINCT day_type) = 3) GROUP BY 1, 2"""))
def _(t):
    return rnd(A.correlation_matrix(X.p2(t), "destination", "day_type", "riders"), 6, "r")


@query("agg_linear_fit", with_(["p1"], "SELECT series, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, count(*) AS n FROM (SELECT series, y, (year(ts) - 1995) * 12 + month(ts) AS x FROM p1) GROUP BY series"))
def _(t):
    df = X.p1(t).withColumn("x", (F.year("ts") - 1995) * 12 + F.month("ts"))
    return rnd(rnd(A.linear_fit(df, "x", "y", ["series"]), 4, "slope"), 2, "intercept")


@query("agg_yoy_corr", with_(["p1"], """SELECT year, round(corr(t / t0 - 1, p - p0), 6) AS r_rain, round(corr(t / t0 - 1, g - g0), 6) AS r_games, count(*) AS n_months FROM (
  SELECT a.year, a.month, a.t, b.t AS t0, a.p, b.p AS p0, a.g, b.g AS g0 FROM m a JOIN m b ON a.year = b.year + 1 AND a.month = b.month) GROUP BY year HAVING count(*) = 12""",
  {"m": "SELECT year(p1.ts) AS year, month(p1.ts) AS month, sum(y) AS t, any_value(o.n) / 100.0 * 24 * day(last_day(p1.ts)) AS p, any_value(o.u) AS g FROM p1 JOIN (SELECT date_trunc('month', o_orderdate) AS ts, count(*) AS n, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS u FROM orders GROUP BY 1) o ON o.ts = p1.ts GROUP BY p1.ts"}))
def _(t):
    side = t.orders.groupBy(month_start("o_orderdate").alias("ts")).agg((F.count(F.lit(1)) / 100.0).alias("precip"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("games"))
    m = X.p1(t).groupBy("ts").agg(F.sum("y").alias("total")).join(side, "ts")
    return rnd(A.yoy_correlation(m, "total", "precip", "games"), 6, "r_rain", "r_games")


@query("agg_event_lift", with_(["p1"], """SELECT series, event_type, e AS event_median, n AS normal_median, round(e / n, 6) AS lift_ratio FROM (SELECT series, unnest(['any_event', 'summer']) AS event_type, unnest([quantile_cont(y, 0.5) FILTER (WHERE month(ts) IN (6, 7, 8, 12)), quantile_cont(y, 0.5) FILTER (WHERE month(ts) IN (6, 7, 8))]) AS e, quantile_cont(y, 0.5) FILTER (WHERE month(ts) NOT IN (6, 7, 8, 12)) AS n FROM p1 GROUP BY series) WHERE n > 0 AND e IS NOT NULL"""))
def _(t):
    df = X.p1(t).withColumns({"is_game_day": F.month("ts").isin(6, 7, 8, 12), "is_summer": F.month("ts").isin(6, 7, 8)})
    return rnd(A.event_lift(df, {"any_event": "is_game_day", "summer": "is_summer"}), 6, "lift_ratio")


@query("agg_typical_lift", with_(["p1", "p5"], """SELECT f.series, f.ts, round(f.p50, 1) AS forecast_p50, round(m.med, 1) AS typical_median, round((f.p50 - m.med) / greatest(m.med, 1) * 100, 1) AS lift_pct, CASE WHEN n.big THEN 'Home game, start ' || n.h || ':00' ELSE '' END AS reason FROM (SELECT * FROM p5 QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts) = 1) f
  LEFT JOIN (SELECT series, month(ts) AS mo, quantile_cont(y, 0.5) AS med FROM p1 WHERE year(ts) <> 1997 GROUP BY 1, 2) m ON m.series = f.series AND m.mo = month(f.ts)
  LEFT JOIN (SELECT series, ts, series % 2 = 0 AS big, series % 24 AS h FROM p1) n ON n.series = f.series AND n.ts = f.ts"""))
def _(t):
    h = X.p1(t).withColumns({"is_game_day": F.year("ts") == 1997, "is_sharks_game_window": F.col("series") % 2 == 0, "game_start_hour": F.col("series") % 24})
    return A.typical_lift(X.p5(t), h, False, rain=None)


@query("agg_recent_average", with_(["p1"], f"SELECT series, avg(y) AS avg_recent, min(ts) AS first_month, max(ts) AS last_month, count(DISTINCT ts) AS n_months, {flag('count(DISTINCT ts) < 12', 'is_short')} FROM p1 WHERE ts IN (SELECT DISTINCT ts FROM p1 ORDER BY ts DESC LIMIT 12) GROUP BY series"))
def _(t):
    return A.recent_average(X.p1(t))


@query("agg_heat_scale", with_(["p1"], "SELECT series, avg_recent, CASE WHEN p95 = 0 THEN 0.1 ELSE round(least(avg_recent / p95 * 2.4, 2.4), 3) END AS normalized FROM (SELECT series, avg(y) AS avg_recent FROM p1 GROUP BY series), (SELECT quantile_cont(a, 0.95) AS p95 FROM (SELECT avg(y) AS a FROM p1 GROUP BY series))"))
def _(t):
    return A.heat_scale(X.p1(t).groupBy("series").agg(F.avg("y").alias("avg_recent")))


@query("agg_distinct_counts", "SELECT count(DISTINCT o_custkey) AS n_series, count(DISTINCT date_trunc('month', o_orderdate)) AS n_months, count(*) AS n_rows FROM orders")
def _(t):
    return A.distinct_counts(t.orders, "o_custkey", "o_orderdate")


@query("agg_percentile_targets", f"SELECT event_type AS metric, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, {flag('quantile_cont(value, 0.5) <= t50', 'p50_ok')}, {flag('quantile_cont(value, 0.95) <= t95', 'p95_ok')} FROM events LEFT JOIN (VALUES ('click', 40.0, 100.0), ('error', 10.0, 500.0)) v(m, t50, t95) ON m = event_type GROUP BY event_type, t50, t95")
def _(t):
    q = A.percentile_targets(t.events.withColumnRenamed("event_type", "metric"), "metric", "value", {"click": {"p50": 40.0, "p95": 100.0}, "error": {"p50": 10.0, "p95": 500.0}})
    return rnd(q, 6, "p50", "p95")


@query("agg_od_identity", with_(["p2"], """SELECT period, round((coalesce(wd, 0) * nwd + coalesce(sat, 0) * nsat) / total, 8) AS ratio FROM (SELECT period, sum(riders) FILTER (WHERE day_type = 'Avg Weekday') AS wd, sum(riders) FILTER (WHERE day_type = 'Avg Saturday') AS sat, sum(riders) FILTER (WHERE day_type = 'Total Trips') AS total FROM p2 GROUP BY 1)
  JOIN (SELECT p AS period, count(*) FILTER (WHERE isodow(d) <= 5) AS nwd, count(*) FILTER (WHERE isodow(d) = 6) AS nsat FROM (SELECT p, unnest(generate_series(p, CAST(last_day(p) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM (SELECT DISTINCT period AS p FROM p2)) GROUP BY 1) USING (period)"""))
def _(t):
    return rnd(A.od_identity(X.p2(t), {"wd": "Avg Weekday", "sat": "Avg Saturday", "total": "Total Trips"}), 8, "ratio")


@query("agg_od_top_matrix", with_(["p2"], """SELECT origin, destination, avg(f) AS mean_flow, count(*) AS n_months FROM (SELECT period, origin, destination, sum(riders) AS f FROM p2 GROUP BY 1, 2, 3) WHERE origin IN (SELECT origin FROM p2 GROUP BY 1 ORDER BY sum(riders) DESC, origin LIMIT 20) AND destination IN (SELECT destination FROM p2 GROUP BY 1 ORDER BY sum(riders) DESC, destination LIMIT 20) GROUP BY 1, 2"""))
def _(t):
    return A.od_top_matrix(X.p2(t))


@query("agg_mean_std_scatter", with_(["p1"], "SELECT series, year(ts) AS year, avg(y) AS mean, round(stddev_samp(y), 4) AS std FROM p1 WHERE year(ts) IN (1996, 2000) GROUP BY 1, 2"))
def _(t):
    return rnd(A.mean_std_scatter(X.p1(t), (1996, 2000)), 4, "std")


@query("agg_band_breakdown", with_(["gp6"], f"""SELECT b.* EXCLUDE (width_all), b.width_all AS width_raw_of_p50, round(r.q * 100, 2) AS abs_rel_error_q80 FROM (SELECT s.*, w.width_all FROM ({interval_sql('origin')}) s JOIN (SELECT origin, round(100 * avg((p90 - p10) / nullif(p50, 0)), 2) AS width_all FROM gp6 GROUP BY 1) w USING (origin)) b
  JOIN (SELECT origin, quantile_cont(abs(y - p50) / nullif(p50, 0), 0.8) AS q FROM gp6 GROUP BY 1) r USING (origin)"""))
def _(t):
    return A.band_breakdown(X.gapped(t).withColumns({"p10_raw": F.col("p10"), "p90_raw": F.col("p90")}), ["origin"])
