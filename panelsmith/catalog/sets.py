"""Sorting, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import spans as S
from ..operators.ordered import first_k, keep_first, keep_latest, tail_per_group
from . import fixtures as X
from .common import rnd
from .fixtures import with_
from .registry import query


@query("topk_series", with_(["p1"], "SELECT series, sum(y) AS total FROM p1 GROUP BY series ORDER BY total DESC, series LIMIT 4"))
def _(t):
    return A.top_k(X.p1(t).groupBy("series").agg(F.sum("y").alias("total")), [F.col("total").desc(), "series"], 4)


@query("tail_per_group", "SELECT o_custkey AS series, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def _(t):
    return tail_per_group(t.orders.select(F.col("o_custkey").alias("series"), "o_orderkey", "o_orderdate"), ["series"], "o_orderkey", 3)


@query("rank_leaderboard", with_(["p1"], """SELECT model, n, n_expected, round(wape, 2) AS wape, round(mae, 2) AS mae, row_number() OVER (ORDER BY round(wape, 2), model) AS rank FROM (
  SELECT model, count(p50) AS n, count(*) AS n_expected, sum(abs(y - p50)) / sum(y) * 100 AS wape, avg(abs(y - p50)) AS mae FROM bt WHERE "window" = '2000-H1' GROUP BY model HAVING count(p50) = count(*)) WHERE wape <= 100""", X.BT_SQL))
def _(t):
    from ..plans.backtest import leaderboard

    lb = leaderboard(X.p1(t), X.TRAIN_END, X.TEST_END, X.MODELS, X.HORIZON, {})
    return lb.select("model", "n", "n_expected", "wape", "mae", "rank")


@query("sort_abs_corr", with_(["p3"], """SELECT feature, round(r, 4) AS pearson, row_number() OVER (ORDER BY abs(round(r, 4)) DESC, feature) AS position FROM (
  SELECT 'precip_mm' AS feature, corr(precip_mm, temp_f) AS r FROM p3 UNION ALL SELECT 'windspeed_mph', corr(windspeed_mph, temp_f) FROM p3 UNION ALL SELECT 'weather_code', corr(weather_code, temp_f) FROM p3)"""))
def _(t):
    from pyspark.sql import Window

    c = rnd(A.correlations(X.p3(t), "temp_f", ["precip_mm", "windspeed_mph", "weather_code"]), 4, "pearson").select("feature", "pearson")
    return c.withColumn("position", F.row_number().over(Window.orderBy(F.abs("pearson").desc(), "feature")))


@query("sort_lift", with_(["p1"], """SELECT series, round(e / n, 4) AS lift_ratio FROM (SELECT series, median(y) FILTER (WHERE month(ts) IN (6, 7, 8)) AS e, median(y) FILTER (WHERE month(ts) NOT IN (6, 7, 8)) AS n FROM p1 GROUP BY series) WHERE n > 0 ORDER BY lift_ratio DESC, series LIMIT 10"""))
def _(t):
    df = X.p1(t).withColumn("is_game_day", F.month("ts").isin(6, 7, 8))
    lift = rnd(A.event_lift(df, {"summer": "is_game_day"}), 4, "lift_ratio")
    return A.top_k(lift.select("series", "lift_ratio"), [F.col("lift_ratio").desc(), "series"], 10)


@query("first_k_violations", """SELECT string_agg(k, ', ' ORDER BY k) AS examples FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE o_totalprice > 400000 ORDER BY k LIMIT 10)""")
def _(t):
    return first_k(t.orders.where("o_totalprice > 400000"), "o_custkey", 10).select(F.nullif("examples", F.lit("")).alias("examples"))


@query("union_by_name", """SELECT kind, count(*) AS n, count(price) AS n_price, count(qty) AS n_qty FROM (SELECT 'orders' AS kind, o_totalprice AS price, NULL AS qty FROM orders UNION ALL SELECT 'lineitem', NULL, l_quantity FROM lineitem) GROUP BY kind""")
def _(t):
    a = t.orders.select(F.lit("orders").alias("kind"), F.col("o_totalprice").alias("price"))
    b = t.lineitem.select(F.lit("lineitem").alias("kind"), F.col("l_quantity").alias("qty"))
    return J.union_all([a, b]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("n_price"), F.count("qty").alias("n_qty"))


@query("except_periods", with_(["p2"], "SELECT DISTINCT period, origin FROM p2 EXCEPT SELECT period, origin FROM p2 WHERE lower(day_type) LIKE '%total%'"))
def _(t):
    od = X.p2(t)
    return J.only_in_left(od, od.where(F.lower("day_type").contains("total")), ["period", "origin"])


@query("intersect_series", with_(["p5", "p5r"], "SELECT series FROM p5 INTERSECT SELECT series FROM p5r"))
def _(t):
    return J.in_both(X.p5(t), X.p5_recent(t), ["series"])


@query("distinct_latest", "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(t):
    return keep_latest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("distinct_first", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(t):
    return keep_first(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


_PER_CUSTOMER = "SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS span_start, CAST(o_orderdate AS DATE) + CAST(20 + o_orderkey % 60 AS INTEGER) AS span_end FROM orders"


@query("merge_spans", f"""SELECT k, CAST(min(span_start) AS TIMESTAMP) AS span_start, CAST(max(span_end) AS TIMESTAMP) AS span_end FROM (
  SELECT *, sum(is_new) OVER (PARTITION BY k ORDER BY span_start, span_end) AS island FROM (
    SELECT *, CASE WHEN span_start <= max(span_end) OVER (PARTITION BY k ORDER BY span_start, span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS is_new FROM (SELECT DISTINCT * FROM ({_PER_CUSTOMER}))))
  GROUP BY k, island""")
def _(t):
    day = F.col("o_orderdate").cast("date")
    s = t.orders.select(F.col("o_custkey").alias("k"), day.alias("span_start"), F.date_add(day, (F.col("o_orderkey") % 60 + 20).cast("int")).alias("span_end"))
    return S.merge_spans(s, keys=["k"])


@query("file_span", """SELECT file, CAST(date_trunc('month', min(ts)) AS TIMESTAMP) AS span_start, CAST(CASE WHEN event_type IN ('click', 'error') THEN DATE '2024-12-31' ELSE last_day(CAST(max(ts) AS DATE)) END AS TIMESTAMP) AS span_end
  FROM (SELECT *, CASE WHEN event_type IN ('click', 'error') THEN '/data/events_2024-01-01_2024-12-31.parquet?' || event_type ELSE '/data/archive_' || event_type || '.parquet' END AS file FROM events) GROUP BY file, event_type""")
def _(t):
    kind = F.col("event_type")
    name = F.when(kind.isin("click", "error"), F.concat(F.lit("/data/"), kind, F.lit("/events_2024-01-01_2024-12-31.parquet"))).otherwise(F.concat(F.lit("/data/archive_"), kind, F.lit(".parquet")))
    out = S.file_spans(t.events.withColumn("file", name), "file", "ts")
    named = F.regexp_extract("file", "^/data/([a-z]+)/events", 1)
    return out.withColumn("file", F.when(named != "", F.concat(F.lit("/data/events_2024-01-01_2024-12-31.parquet?"), named)).otherwise(F.col("file")))
