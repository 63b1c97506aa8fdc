"""Stand-in panels built from the shared tables, in DataFrame form and as SQL text.

P1 monthly panel, P2 OD facts, P3 hourly covariates, P4 event archives, P5
forecasts, P6 rolling pool, P7 station dimension.  Measures are sums of whole
numbers, so both engines see the same bits whatever the summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import NTZ, hour_start, month_start, plus_hours
from ..operators import forecast as FC
from ..operators.ordered import tail_per_group
from .registry import Tables

TRAIN_END, TEST_END, HORIZON = "1999-12-31", "2000-06-30", 6
FIRST_ORIGIN = "1998-12-31"
ORIGINS = FC.month_end_origins(FIRST_ORIGIN, TRAIN_END)
GAP_ORIGIN = ORIGINS[4]
SPANS = [("1995-11-10", "1997-04-30"), ("1997-05-01", "1998-02-28"), ("1998-06-01", "1999-09-15"), ("1999-01-01", "1999-10-31")]
LABELS = {"N": "Total Trips", "A": "Avg Weekday", "R": "Avg Saturday"}


def p1(t: Tables) -> DataFrame:
    """Monthly panel: (series, ts, y)."""
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("long").alias("series"), month_start("o_orderdate").alias("ts"))
        .agg(F.sum(F.round("o_totalprice")).alias("y"))
    )


def p2(t: Tables) -> DataFrame:
    """OD facts: (period, day_type, origin, destination, riders)."""
    flag = F.col("l_returnflag")
    day_type = F.when(flag == "N", LABELS["N"]).when(flag == "A", LABELS["A"]).otherwise(LABELS["R"])
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(month_start("l_shipdate").alias("period"), day_type.alias("day_type"), F.col("c_nationkey").cast("long").alias("origin"), F.col("s_nationkey").cast("long").alias("destination"))
        .agg(F.sum("l_quantity").alias("riders"))
    )


def p3(t: Tables) -> DataFrame:
    """Hourly covariates: (station, ts, temp_f, precip_mm, windspeed_mph, weather_code)."""
    k = F.get_json_object("props", "$.k").cast("long")
    mean = F.floor(F.sum(F.round(F.col("value") * 100)) / (F.count(F.lit(1)) * 100.0)).cast("double")
    return t.events.groupBy(F.col("event_type").alias("station"), hour_start("ts").alias("ts")).agg(
        mean.alias("temp_f"), (mean / 50.0).alias("precip_mm"), F.count(F.lit(1)).cast("double").alias("windspeed_mph"), F.mode(k, deterministic=True).alias("weather_code")
    )


def p4(t: Tables) -> DataFrame:
    """Event archive at hour scale: every row of the stream is an event of three hours."""
    return t.events.select(
        F.col("ts").alias("timestamp_start"), plus_hours("ts", 3).alias("timestamp_end"), (F.col("user_id") % 2 == 0).alias("is_sharks_game"),
        F.col("event_type").alias("venue"), F.col("event_id"),
    )


def p4_monthly(t: Tables) -> DataFrame:
    """Event archive at month scale: every order is an event."""
    return t.orders.select(
        F.col("o_orderdate").alias("timestamp_start"), (F.col("o_orderpriority") == "1-URGENT").alias("is_sharks_game"),
        (F.col("o_orderstatus") == "F").alias("is_playoff"), (F.col("o_custkey") % 24).alias("game_start_hour"), F.col("o_orderkey").alias("event_id"),
    )


def spans(t: Tables) -> DataFrame:
    """Days the monthly archive vouches for (configuration)."""
    rows = t.spark.createDataFrame(SPANS, "a string, b string")
    return rows.select(F.col("a").cast("date").alias("span_start"), F.col("b").cast("date").alias("span_end"))


def p5(t: Tables) -> DataFrame:
    """Seasonal naive forecasts for the test months."""
    p = p1(t)
    return FC.seasonal_naive(p.where(F.col("ts") <= F.lit(TRAIN_END).cast(NTZ)), actuals(t, p))


def actuals(t: Tables, p: DataFrame | None = None) -> DataFrame:
    p = p1(t) if p is None else p
    return p.where((F.col("ts") > F.lit(TRAIN_END).cast(NTZ)) & (F.col("ts") <= F.lit(TEST_END).cast(NTZ)))


def recent_mean(history: DataFrame, horizon: int, keys: list[str]) -> DataFrame:
    """A second forecaster: mean of the last three rows, +-30 %."""
    level = tail_per_group(history, keys, "ts", 3).groupBy(*keys).agg(F.avg("y").alias("_l"))
    start = F.trunc(F.col("origin").cast("date"), "month")
    return level.select(*keys, "_l", F.explode(F.sequence(F.add_months(start, 1), F.add_months(start, horizon), F.expr("interval 1 month"))).alias("_d")).select(
        *keys, F.col("_d").cast(NTZ).alias("ts"), (F.col("_l") * 0.7).alias("p10"), F.col("_l").alias("p50"), (F.col("_l") * 1.3).alias("p90")
    )


def p5_recent(t: Tables) -> DataFrame:
    p = p1(t).where(F.col("ts") <= F.lit(TRAIN_END).cast(NTZ)).withColumn("origin", F.lit(TRAIN_END).cast(NTZ))
    return recent_mean(p, HORIZON, ["series", "origin"]).drop("origin")


def p6(t: Tables) -> DataFrame:
    """Rolling pool: forecasts from twelve month-end origins left-joined to actuals."""
    return FC.rolling_pool(p1(t), ORIGINS, HORIZON, TRAIN_END)


def gapped(t: Tables) -> DataFrame:
    """The rolling pool without actuals of one series and without another's first forecasts from one origin."""
    gone = (F.col("series") == 9) & (F.col("origin") == F.lit(GAP_ORIGIN).cast(NTZ)) & (F.col("horizon") < 4)
    bands = {c: F.when(~gone, F.col(c)) for c in ("p10", "p50", "p90")}
    return p6(t).withColumns({"y": F.when(F.col("series") != 4, F.col("y")), **bands})


def scored(t: Tables) -> DataFrame:
    """Test months with actuals, naive forecasts, origin and horizon."""
    from ..operators.calibration import with_origin_horizon

    return with_origin_horizon(actuals(t).join(p5(t), ["series", "ts"], "left"), TRAIN_END)


def p7(t: Tables) -> DataFrame:
    """Station dimension: code, name, region; the last region's stations have no weather station."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    # Regions map onto the covariate stations in name order; the fifth stays unmapped.
    stations = ["click", "error", "purchase", "signup"]
    ws = F.coalesce(*[F.when(F.col("r_regionkey") == i, s) for i, s in enumerate(stations)], F.lit(None))
    return n.select(F.col("n_nationkey").cast("long").alias("series"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), ws.alias("weather_station"))


# ---- SQL text ------------------------------------------------------------------------------------

_MODE_K = """(SELECT event_type AS station, hr AS ts, k, row_number() OVER (PARTITION BY event_type, hr ORDER BY count(*) DESC, k) AS rn
    FROM (SELECT event_type, date_trunc('hour', ts) AS hr, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type, hr, k)"""

CTE: dict[str, tuple[list[str], str]] = {
    "p1": ([], "SELECT CAST(c_nationkey AS BIGINT) AS series, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts, sum(round(o_totalprice)) AS y "
               "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"),
    "p2": ([], "SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS period, CASE l_returnflag WHEN 'N' THEN 'Total Trips' WHEN 'A' THEN 'Avg Weekday' ELSE 'Avg Saturday' END AS day_type, "
               "CAST(c_nationkey AS BIGINT) AS origin, CAST(s_nationkey AS BIGINT) AS destination, sum(l_quantity) AS riders "
               "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4"),
    "p3": ([], f"""SELECT a.station, a.ts, temp_f, temp_f / 50.0 AS precip_mm, windspeed_mph, m.k AS weather_code FROM
    (SELECT event_type AS station, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, floor(sum(round(value * 100)) / (count(*) * 100.0)) AS temp_f, CAST(count(*) AS DOUBLE) AS windspeed_mph FROM events GROUP BY 1, 2) a
    JOIN {_MODE_K} m ON a.station = m.station AND a.ts = m.ts AND m.rn = 1"""),
    "p4": ([], "SELECT ts AS timestamp_start, ts + INTERVAL 3 HOUR AS timestamp_end, user_id % 2 = 0 AS is_sharks_game, event_type AS venue, event_id FROM events"),
    "p4m": ([], "SELECT o_orderdate AS timestamp_start, o_orderpriority = '1-URGENT' AS is_sharks_game, o_orderstatus = 'F' AS is_playoff, o_custkey % 24 AS game_start_hour, o_orderkey AS event_id FROM orders"),
    "spans": ([], "SELECT * FROM (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in SPANS) + ") AS s(span_start, span_end)"),
    "merged_spans": (["spans"], """SELECT min(span_start) AS span_start, max(span_end) AS span_end FROM (
        SELECT *, sum(is_new) OVER (ORDER BY span_start, span_end) AS island FROM (
          SELECT *, CASE WHEN span_start <= max(span_end) OVER (ORDER BY span_start, span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS is_new FROM spans)) GROUP BY island"""),
    "train": (["p1"], f"SELECT * FROM p1 WHERE ts <= TIMESTAMP '{TRAIN_END}'"),
    "actuals": (["p1"], f"SELECT * FROM p1 WHERE ts > TIMESTAMP '{TRAIN_END}' AND ts <= TIMESTAMP '{TEST_END}'"),
    "p5": (["train", "actuals"], """SELECT r.series, r.ts, greatest(v.y, 0) * 0.8 AS p10, greatest(v.y, 0) AS p50, greatest(v.y, 0) * 1.2 AS p90 FROM
        (SELECT series, ts, (row_number() OVER (PARTITION BY series ORDER BY ts) - 1) % 12 AS i FROM actuals) r
        JOIN (SELECT series, y, 12 - row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS i, count(*) OVER (PARTITION BY series) AS n FROM train) v
        ON r.series = v.series AND r.i = v.i WHERE v.n >= 12"""),
    "p5r": (["train"], f"""SELECT series, CAST(DATE '{TRAIN_END}' + INTERVAL 1 DAY + to_months(h) AS TIMESTAMP) AS ts, l * 0.7 AS p10, l AS p50, l * 1.3 AS p90 FROM
        (SELECT series, avg(y) AS l FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS rn FROM train) WHERE rn <= 3 GROUP BY series), (SELECT CAST(range AS INTEGER) AS h FROM range({HORIZON}))"""),
    "origins": ([], "SELECT CAST(o AS TIMESTAMP) AS origin FROM (VALUES " + ", ".join(f"('{o}')" for o in ORIGINS) + ") AS v(o)"),
    "hist": (["p1", "origins"], "SELECT origin, series, ts, y, row_number() OVER (PARTITION BY origin, series ORDER BY ts DESC) AS rn, count(*) OVER (PARTITION BY origin, series) AS n FROM p1 JOIN origins ON ts <= origin"),
    "p6": (["p1", "origins", "hist"], f"""SELECT a.series, a.ts, a.y, a.origin, a.horizon, h.y * 0.8 AS p10, h.y AS p50, h.y * 1.2 AS p90 FROM
        (SELECT p1.*, origin, (year(ts) * 12 + month(ts)) - (year(origin) * 12 + month(origin)) AS horizon FROM p1 JOIN origins ON ts > origin
          AND (year(ts) * 12 + month(ts)) - (year(origin) * 12 + month(origin)) <= {HORIZON} AND ts <= TIMESTAMP '{TRAIN_END}') a
        LEFT JOIN (SELECT * FROM hist WHERE n >= 12) h ON a.series = h.series AND a.origin = h.origin AND h.rn = 12 - (a.horizon - 1) % 12"""),
    "gp6": (["p6"], f"""SELECT series, ts, origin, horizon, CASE WHEN series <> 4 THEN y END AS y, CASE WHEN ok THEN p10 END AS p10, CASE WHEN ok THEN p50 END AS p50, CASE WHEN ok THEN p90 END AS p90
        FROM (SELECT *, NOT (series = 9 AND origin = TIMESTAMP '{GAP_ORIGIN}' AND horizon < 4) AS ok FROM p6)"""),
    "scored": (["actuals", "p5"], f"""SELECT a.series, a.ts, a.y, f.p10, f.p50, f.p90, TIMESTAMP '{TRAIN_END}' AS origin, (year(a.ts) * 12 + month(a.ts)) - (1999 * 12 + 12) AS horizon
        FROM actuals a LEFT JOIN p5 f ON a.series = f.series AND a.ts = f.ts"""),
    "p7": ([], "SELECT CAST(n_nationkey AS BIGINT) AS series, n_name AS name, r_name AS region, CASE r_regionkey WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' END AS weather_station FROM nation JOIN region ON n_regionkey = r_regionkey"),
}


def with_(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """SQL text with the named stand-ins (and what they need) as leading CTEs."""
    order: list[str] = []

    def add(n: str):
        for d in CTE[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTE[n][1]})" for n in order] + [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


# ---- backtest windows --------------------------------------------------------------------------------


def naive(history: DataFrame, horizon: int, keys: list[str]) -> DataFrame:
    return FC.naive_ahead_full(history, horizon, keys)


BACKTESTS = [{"name": "1999-H1", "as_of": "1998-12-31"}, {"name": "1999-H2", "as_of": "1999-06-30"}, {"name": "2000-H1", "as_of": "1999-12-31"}]
MODELS = {"naive": naive, "recent": recent_mean}


def backtest(t: Tables) -> DataFrame:
    """(model, window, series, ts, y, bands) for the configured windows."""
    from ..plans import backtest as B

    return B.backtest_frame(p1(t), BACKTESTS, MODELS, HORIZON)


_BW = "(VALUES " + ", ".join(f"('{w['name']}', TIMESTAMP '{w['as_of']}')" for w in BACKTESTS) + ") AS w(name, o)"
BT_SQL = {
    "bh": f"SELECT w.name, w.o, p.series, p.y, row_number() OVER (PARTITION BY w.name, p.series ORDER BY p.ts DESC) AS rn, count(*) OVER (PARTITION BY w.name, p.series) AS n FROM p1 p, {_BW} WHERE p.ts <= w.o",
    "bt": f"""SELECT a.name AS window, m.model, a.series, a.ts, a.y, CASE m.model WHEN 'naive' THEN h.y * 0.8 ELSE r.l * 0.7 END AS p10, CASE m.model WHEN 'naive' THEN h.y ELSE r.l END AS p50, CASE m.model WHEN 'naive' THEN h.y * 1.2 ELSE r.l * 1.3 END AS p90 FROM
      (SELECT w.name, p.series, p.ts, p.y, (year(p.ts) * 12 + month(p.ts)) - (year(w.o) * 12 + month(w.o)) AS hz FROM p1 p, {_BW} WHERE p.ts > w.o AND (year(p.ts) * 12 + month(p.ts)) - (year(w.o) * 12 + month(w.o)) <= {HORIZON}) a CROSS JOIN (VALUES ('naive'), ('recent')) m(model)
      LEFT JOIN (SELECT * FROM bh WHERE n >= 12) h ON h.name = a.name AND h.series = a.series AND h.rn = 12 - (a.hz - 1) % 12
      LEFT JOIN (SELECT name, series, avg(y) AS l FROM bh WHERE rn <= 3 GROUP BY 1, 2) r ON r.name = a.name AND r.series = a.series""",
}
