"""Data quality and the publish gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import epoch_seconds
from ..operators import aggregates as A
from ..operators import gate as G
from ..operators import metrics as M
from ..operators import quality as Q
from ..session import materialise
from . import fixtures as X
from .common import flag, rnd, ts_lit
from .fixtures import BT_SQL, TRAIN_END, naive, with_
from .joins import _CAND, candidate, tracked
from .registry import query


def named(df, *details):
    """Check results with chosen details as columns instead of a map."""
    return df.select("check", "severity", *[F.col("details")[d].alias(d) for d in details])


@query("dq_required_columns", "SELECT 'required_columns' AS \"check\", 'ERROR' AS severity, CAST(count(*) AS VARCHAR) AS rows, count(o_orderkey) || ',' || count(o_custkey) AS filled FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS o_custkey FROM orders)")
def _(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("o_custkey"))
    return named(Q.required_columns(df, ["o_orderkey", "o_custkey", "riders"]), "rows", "filled")


@query("dq_monotonic", """SELECT 'timestamp_monotonic' AS "check", CASE WHEN count(*) > 0 THEN 'WARNING' ELSE 'INFO' END AS severity, CAST(count(*) AS VARCHAR) AS count, string_agg(s, ', ' ORDER BY s) AS examples FROM (SELECT DISTINCT o_orderpriority AS s FROM (SELECT o_orderpriority, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders) WHERE o_orderdate < p)""")
def _(t):
    df = t.orders.select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"), "o_orderkey")
    return named(Q.monotonic(df, "o_orderkey", chunk=F.floor(F.col("o_orderkey") / 65536)), "count", "examples")


@query("dq_gaps", with_(["p3"], """SELECT 'missing_windows' AS "check", CASE WHEN count(*) > 0 THEN 'WARNING' ELSE 'INFO' END AS severity, CAST(count(*) AS VARCHAR) AS count FROM (SELECT ts, lag(ts) OVER (PARTITION BY station ORDER BY ts) AS p FROM p3) WHERE epoch(ts - p) > 7200"""))
def _(t):
    return named(Q.missing_windows(X.p3(t), 2.0, "station", "ts", F.col("ts").cast("date")), "count")


_SPIKED = "SELECT series, ts, CASE WHEN series % 5 = 0 AND month(ts) = 6 AND year(ts) = 1998 THEN y * 40 ELSE y END AS y FROM p1"


def spiked(t):
    return X.p1(t).withColumn("y", F.when((F.col("series") % 5 == 0) & (F.month("ts") == 6) & (F.year("ts") == 1998), F.col("y") * 40).otherwise(F.col("y")))


@query("dq_spikes", with_(["p1"], f"""SELECT 'target_spikes' AS "check", 'WARNING' AS severity, CAST(count(*) AS VARCHAR) AS count, array_to_string(list_sort(list(series || '@' || strftime(ts, '%Y-%m-%d %H:%M:%S')))[1:10], ', ') AS examples FROM (SELECT *, quantile_cont(y, 0.5) OVER w AS med, count(y) OVER w AS c FROM ({_SPIKED}) WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE c >= 4 AND med > 0 AND y / med > 10"""))
def _(t):
    return named(Q.spikes(spiked(t)), "count", "examples")


@query("dq_range", """SELECT 'target_negative' AS "check", 'ERROR' AS severity, CAST(count(*) AS VARCHAR) AS count FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'target_implausible_max', 'ERROR', CAST(count(*) AS VARCHAR) FROM customer WHERE c_acctbal > 9000 HAVING count(*) > 0
  UNION ALL SELECT 'target_range', 'INFO', NULL FROM customer HAVING count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal > 9000) = 0""")
def _(t):
    return named(Q.value_range(t.customer, "c_acctbal", "c_nationkey", 9000), "count")


@query("dq_weather_nulls", with_(["p3"], """SELECT 'weather_nulls_' || c AS "check", CASE WHEN pct > 20 THEN 'ERROR' WHEN pct > 5 THEN 'WARNING' ELSE 'INFO' END AS severity FROM (SELECT 'temp_f' AS c, 100.0 * count(*) FILTER (WHERE temp_f < 20) / count(*) AS pct FROM p3 UNION ALL SELECT 'precip_mm', 100.0 * count(*) FILTER (WHERE hour(ts) = 3) / count(*) FROM p3 UNION ALL SELECT 'windspeed_mph', 100.0 * count(*) FILTER (WHERE hour(ts) IN (3, 4)) / count(*) FROM p3)"""))
def _(t):
    df = X.p3(t).withColumns({"temp_f": F.when(F.col("temp_f") >= 20, F.col("temp_f")), "precip_mm": F.when(F.hour("ts") != 3, F.col("precip_mm")), "windspeed_mph": F.when(~F.hour("ts").isin(3, 4), F.col("windspeed_mph"))})
    return Q.weather_nulls(df).select("check", "severity")


@query("dq_event_scores", "SELECT 'event_proximity_score' AS \"check\", CASE WHEN z + m > 50 THEN 'WARNING' ELSE 'INFO' END AS severity, round(z, 2) AS zero_pct, round(m, 2) AS missing_pct FROM (SELECT 100 * avg(CAST(user_id % 3 = 0 AND value >= 20 AS INTEGER)) AS z, 100 * avg(CAST(value < 20 AS INTEGER)) AS m FROM events WHERE event_type IN ('click', 'view'))")
def _(t):
    df = t.events.select(F.when(F.col("event_type") != "error", F.col("event_type").isin("click", "view")).alias("is_game_day"), F.when(F.col("value") >= 20, (F.col("user_id") % 3).cast("double")).alias("event_proximity_score"))
    shares = [F.col("details")[c].cast("double").alias(c) for c in ("zero_pct", "missing_pct")]
    return Q.event_scores(df).select("check", "severity", *shares)


@query("dq_station_coverage", """SELECT g.w AS "window", count(DISTINCT e.event_type) AS n_series, any_value(tot) AS total, count(DISTINCT e.event_type) / any_value(tot) AS share FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS w, count(DISTINCT event_type) AS tot FROM events WHERE hour(ts) NOT IN (2, 3)) g
  LEFT JOIN (SELECT * FROM events WHERE hour(ts) NOT IN (2, 3)) e ON date_trunc('hour', e.ts) = g.w GROUP BY 1""")
def _(t):
    return Q.window_coverage(t.events.where("hour(ts) not in (2, 3)"), "hour", "event_type", "ts")


@query("dq_series_coverage", """SELECT 'series_coverage' AS "check", 'WARNING' AS severity, CAST(count(*) AS VARCHAR) AS count, CAST(min(n) AS VARCHAR) AS fewest FROM (SELECT g.w, count(DISTINCT e.event_type) AS n FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS w FROM events) g
  LEFT JOIN (SELECT * FROM events WHERE hour(ts) NOT IN (2, 3)) e ON date_trunc('hour', e.ts) = g.w GROUP BY 1) WHERE n / 5.0 < 0.8""")
def _(t):
    return named(Q.series_coverage(t.events.where("hour(ts) not in (2, 3)"), "hour", 0.8, "event_type", "ts"), "count", "fewest")


@query("dq_duplicates", """SELECT 'duplicate_rows' AS "check", CASE WHEN sum(n) > 0 THEN 'ERROR' ELSE 'INFO' END AS severity, CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) AS count FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)""")
def _(t):
    return named(Q.duplicates(t.orders, ["o_custkey", "o_orderdate"]), "count")


@query("dq_target_nulls", "SELECT 'target_null_rate' AS \"check\", CASE WHEN p > 10 THEN 'ERROR' WHEN p > 2 THEN 'WARNING' ELSE 'INFO' END AS severity, CAST(n AS VARCHAR) AS null_count FROM (SELECT 100.0 * count(*) FILTER (WHERE l_linenumber = 5) / count(*) AS p, count(*) FILTER (WHERE l_linenumber = 5) AS n FROM lineitem)")
def _(t):
    return named(Q.target_nulls(t.lineitem.select(F.when(F.col("l_linenumber") != 5, F.col("l_quantity")).alias("y"))), "null_count")


@query("dq_run", with_(["p1"], f"""SELECT 'required_columns' AS "check", 'INFO' AS severity UNION ALL SELECT 'missing_windows', CASE WHEN (SELECT count(*) FROM (SELECT ts, lag(ts) OVER (PARTITION BY series ORDER BY ts) AS p FROM p1) WHERE epoch(ts - p) > 35 * 86400) > 0 THEN 'WARNING' ELSE 'INFO' END
  UNION ALL SELECT 'target_implausible_max', 'ERROR' WHERE (SELECT max(y) FROM ({_SPIKED})) > 5000000 UNION ALL SELECT 'target_range', 'INFO' WHERE (SELECT max(y) FROM ({_SPIKED})) <= 5000000 UNION ALL SELECT 'target_spikes', 'WARNING'
  UNION ALL SELECT 'weather_coverage', 'WARNING' UNION ALL SELECT 'series_coverage', CASE WHEN (SELECT min(n) FROM (SELECT count(p.series) AS n FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 MONTH)) AS ts FROM p1) g LEFT JOIN p1 p USING (ts) GROUP BY g.ts)) / 25.0 < 0.8 THEN 'WARNING' ELSE 'INFO' END
  UNION ALL SELECT 'duplicate_rows', 'INFO' UNION ALL SELECT 'target_null_rate', 'INFO'"""))
def _(t):
    return Q.run_checks(spiked(t), "monthly", step="month").select("check", "severity")


@query("dq_run_sub_daily", with_(["p3"], """SELECT 'timestamp_monotonic' AS "check", CASE WHEN count(*) > 0 THEN 'WARNING' ELSE 'INFO' END AS severity, CAST(count(*) AS VARCHAR) AS count FROM (SELECT DISTINCT station FROM (SELECT station, ts, lag(ts) OVER (PARTITION BY station ORDER BY arrival) AS p FROM late) WHERE ts < p)
  UNION ALL SELECT 'missing_windows', CASE WHEN count(*) > 0 THEN 'WARNING' ELSE 'INFO' END, CAST(count(*) AS VARCHAR) FROM (SELECT ts, lag(ts) OVER (PARTITION BY station ORDER BY ts) AS p FROM p3) WHERE epoch(ts - p) > 7200
  UNION ALL SELECT 'target_spikes', CASE WHEN count(*) > 0 THEN 'WARNING' ELSE 'INFO' END, CAST(count(*) AS VARCHAR) FROM (SELECT temp_f AS y, quantile_cont(temp_f, 0.5) OVER w AS med, count(temp_f) OVER w AS c FROM p3 WINDOW w AS (PARTITION BY station ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)) WHERE c >= 4 AND med > 0 AND y / med > 10""",
  {"late": "SELECT station, ts, CASE WHEN hour(ts) = 5 AND station <> 'view' THEN epoch(ts) + 7200 + 1 ELSE epoch(ts) END AS arrival FROM p3"}))
def _(t):
    """The composed report of an hourly panel whose rows arrive out of order."""
    epoch = epoch_seconds("ts")
    late = X.p3(t).withColumn("arrival", F.when((F.hour("ts") == 5) & (F.col("station") != "view"), epoch + 7201).otherwise(epoch))
    checks = ["timestamp_monotonic", "missing_windows", "target_spikes"]
    return named(Q.run_checks(late, "sub_daily", "arrival", "station", "ts", "temp_f").where(F.col("check").isin(checks)), "count")


@query("dq_station_table", """SELECT 'unique_series' AS "check", (SELECT count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'unique_region', (SELECT count(*) FROM (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'unique_name', 0
  UNION ALL SELECT 'code_pattern', 0 UNION ALL SELECT 'api_code_length', (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(r_name) < 4) UNION ALL SELECT 'store_not_in_table', (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)) UNION ALL SELECT 'table_not_in_store', (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier))""")
def _(t):
    return Q.dimension_checks(X.p7(t), t.supplier.select(F.col("s_nationkey").alias("series")), "series", "region", "name").select("check", "n")


@query("dq_series_publishable", with_(["p1"], f"SELECT series, 0 AS duplicate_months, 12 * 0 + count(*) FILTER (WHERE series % 4 = 0 AND month(ts) = 1) AS bad_values, count(*) FILTER (WHERE ts < TIMESTAMP '1995-06-01') AS missing_regime, count(*) FILTER (WHERE series % 6 = 0 AND year(ts) = 1999) AS bad_flags, {flag('count(*) FILTER (WHERE (series % 4 = 0 AND month(ts) = 1) OR ts < TIMESTAMP $$1995-06-01$$ OR (series % 6 = 0 AND year(ts) = 1999)) = 0', 'publishable')} FROM p1 GROUP BY series"))
def _(t):
    df = X.p1(t).withColumns({
        "y": F.when((F.col("series") % 4 == 0) & (F.month("ts") == 1), F.col("y") + 0.5).otherwise(F.col("y")),
        "method_period": F.when(F.col("ts") >= ts_lit("1995-06-01"), "a"), "electrified": F.when((F.col("series") % 6 == 0) & (F.year("ts") == 1999), 2).otherwise(1),
    })
    return Q.publishable_series(df, ["electrified"])


@query("gate_unique_keys", "SELECT 'unique_keys' AS \"check\", CASE WHEN sum(n) > 0 THEN 'fail' ELSE 'pass' END AS status, CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) AS n_duplicate_rows, CAST(count(*) AS VARCHAR) AS n_keys FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)")
def _(t):
    g = G.unique_keys(t.orders.select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("ts")))
    return g.select("check", "status", F.col("details")["n_duplicate_rows"].alias("n_duplicate_rows"), F.col("details")["n_keys"].alias("n_keys"))


_EXTRA = f"SELECT series, ts FROM ({_CAND}) UNION ALL SELECT 99, ts FROM p1 WHERE series = 1 AND year(ts) = 1997"


def with_extra(t):
    c = candidate(t).select("series", "ts")
    return c.unionByName(X.p1(t).where((F.col("series") == 1) & (F.year("ts") == 1997)).select(F.lit(99).cast("long").alias("series"), "ts"))


@query("gate_station_set", with_(["p1"], f"SELECT m.ts, s.series, 'missing' AS problem FROM (SELECT DISTINCT ts FROM ({_EXTRA})) m CROSS JOIN (SELECT DISTINCT series FROM p1) s LEFT JOIN ({_EXTRA}) e ON e.ts = m.ts AND e.series = s.series WHERE e.series IS NULL UNION ALL SELECT ts, series, 'extra' FROM ({_EXTRA}) WHERE series = 99"))
def _(t):
    return G.station_differences(with_extra(t), tracked(t))


@query("gate_columns_present", with_(["p1"], "SELECT 'tracked_columns' AS \"check\", 'fail' AS status, 'absent: temp_f' AS message, CAST(count(*) AS VARCHAR) AS rows FROM p1"))
def _(t):
    return G.columns_present(X.p1(t), tracked(t)).select("check", "status", "message", F.col("details")["rows"].alias("rows"))


_DIFF = f"SELECT count(*) FILTER (WHERE c.series IS NULL) AS n_missing, count(*) FILTER (WHERE c.series IS NOT NULL AND c.y <> t.y) AS diff_y, count(*) FILTER (WHERE c.series IS NOT NULL AND c.temp_f IS NULL) AS diff_temp_f FROM p1 t LEFT JOIN ({_CAND}) c ON t.series = c.series AND t.ts = c.ts"


@query("gate_tracked_differences", with_(["p1"], _DIFF))
def _(t):
    return G.tracked_differences(candidate(t), tracked(t))


_STATUS = "SELECT '{n}' AS \"check\", CASE WHEN {c} > 0 THEN 'fail' ELSE 'pass' END AS status FROM d"
for _n, _c in (("gate_keys_present", "n_missing"), ("gate_target_exact", "diff_y"), ("gate_covariates_rtol", "diff_temp_f")):
    _row = {"gate_keys_present": "tracked_keys_present", "gate_target_exact": "target_exact", "gate_covariates_rtol": "covariates_within_rtol"}[_n]

    @query(_n, with_(["p1"], _STATUS.format(n=_row, c=_c), {"d": _DIFF}))
    def _(t, row=_row):
        return G.tracked_rows(candidate(t), tracked(t)).where(F.col("check") == row).select("check", "status")


@query("gate_served_months", with_(["p1"], "SELECT 'served_months_retained' AS \"check\", CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status, CAST(count(*) AS VARCHAR) AS n, string_agg(strftime(ts, '%Y-%m'), ', ' ORDER BY ts) AS examples FROM (SELECT DISTINCT ts FROM p1 EXCEPT SELECT ts FROM p1 WHERE NOT (year(ts) = 1998 AND month(ts) > 9))"))
def _(t):
    g = G.served_months(X.p1(t).where("not (year(ts) = 1998 and month(ts) > 9)"), X.p1(t))
    return g.select("check", "status", F.col("details")["n"].alias("n"), F.col("details")["examples"].alias("examples"))


@query("gate_no_future_month", with_(["p1"], "SELECT 'no_future_month' AS \"check\", CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status, CAST(count(*) AS VARCHAR) AS n, string_agg(strftime(ts, '%Y-%m'), ', ' ORDER BY ts) AS examples FROM (SELECT DISTINCT ts FROM p1 WHERE ts > TIMESTAMP '2001-03-01')"))
def _(t):
    g = G.no_future_month(X.p1(t), "2001-03-31")
    return g.select("check", "status", F.col("details")["n"].alias("n"), F.col("details")["examples"].alias("examples"))


@query("gate_backtest", with_(["p1"], "SELECT 'backtest' AS \"check\", CASE WHEN round(sum(abs(y - p50)) / sum(y) * 100, 2) = 5.55 THEN 'pass' ELSE 'fail' END AS status, round(sum(abs(y - p50)) / sum(y) * 100, 2) AS wape, CAST(count(p50) AS BIGINT) AS n FROM bt WHERE \"window\" = '2000-H1' AND model = 'naive'", BT_SQL))
def _(t):
    g = G.backtest(X.p1(t), X.p1(t), TRAIN_END, 6, 5.55, naive)
    return g.select("check", "status", F.col("details")["wape"].cast("double").alias("wape"), F.col("details")["n"].cast("long").alias("n"))


LAST_CLOSED = "2001-08-31"


def _verdicts(cand: str, kept: str) -> str:
    """SQL for (check, status) of a gate run over two tables of (series, ts, y, temp_f), every verdict from the rows."""
    month = "strftime(ts, '%Y-%m')"
    counts = {
        "quality_checks": f"""(SELECT CAST(count(*) FILTER (WHERE y < 0) > 0 AS INTEGER) + CAST(count(*) FILTER (WHERE y > 5000000) > 0 AS INTEGER) + CAST(100.0 * count(*) FILTER (WHERE temp_f IS NULL) / count(*) > 20 AS INTEGER)
            + CAST(100.0 * count(*) FILTER (WHERE y IS NULL) / count(*) > 10 AS INTEGER) FROM {cand}) + (SELECT count(*) FROM (SELECT 1 FROM {cand} GROUP BY series, ts HAVING count(*) > 1))""",
        "unique_keys": f"(SELECT count(*) FROM (SELECT 1 FROM {cand} GROUP BY series, ts HAVING count(*) > 1))",
        "station_set": f"""(SELECT CAST(count(DISTINCT series) <> 25 AS INTEGER) FROM {kept}) + (SELECT count(*) FROM ((SELECT DISTINCT c.ts, k.series FROM {cand} c, {kept} k EXCEPT SELECT ts, series FROM {cand})
            UNION ALL (SELECT ts, series FROM {cand} WHERE series NOT IN (SELECT series FROM {kept}))))""",
        "tracked_columns": f"(SELECT 0 * count(*) FROM {cand})",
        "tracked_keys_present": f"(SELECT count(*) FROM (SELECT series, ts FROM {kept} EXCEPT SELECT series, ts FROM {cand}))",
        "target_exact": f"(SELECT count(*) FROM {kept} k JOIN {cand} c USING (series, ts) WHERE k.y IS DISTINCT FROM c.y)",
        "covariates_within_rtol": f"(SELECT count(*) FROM {kept} k JOIN {cand} c USING (series, ts) WHERE (k.temp_f IS NULL) <> (c.temp_f IS NULL) OR abs(k.temp_f - c.temp_f) > 1e-9 * greatest(abs(k.temp_f), abs(c.temp_f)))",
        "served_months_retained": f"(SELECT count(*) FROM (SELECT {month} FROM p1 EXCEPT SELECT {month} FROM {cand}))",
        "no_future_month": f"(SELECT count(*) FROM {cand} WHERE ts > TIMESTAMP '{LAST_CLOSED}')",
    }
    first = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(counts)) + ') v("check", position)'
    n = "CASE \"check\" " + " ".join(f"WHEN '{k}' THEN {q}" for k, q in counts.items()) + " END"
    return f"SELECT \"check\", position, CASE WHEN {n} > 0 THEN 'fail' ELSE 'pass' END AS status FROM ({first})"


_FULL = """SELECT s.series, m.ts, coalesce(p.y, 1) / 1000 AS y, coalesce(p.y, 1) / 2000 AS temp_f FROM (SELECT DISTINCT series FROM p1) s CROSS JOIN (SELECT DISTINCT ts FROM p1) m LEFT JOIN p1 p ON p.series = s.series AND p.ts = m.ts"""
_REFIT = f"""SELECT round(sum(abs(f.y - b.y)) / sum(f.y) * 100, 2) AS wape FROM full_panel f JOIN full_panel b ON b.series = f.series AND b.ts = f.ts - INTERVAL 12 MONTH
  WHERE f.ts > TIMESTAMP '{TRAIN_END}' AND f.ts <= TIMESTAMP '{TRAIN_END}' + INTERVAL 6 MONTH"""


def full_panel(t, p=None):
    """Every series in every month, in thousands: a panel that may be published."""
    p = X.p1(t) if p is None else p
    grid = p.select("series").distinct().join(F.broadcast(p.agg(F.collect_set("ts").alias("_m"))), F.lit(True)).select("series", F.explode("_m").alias("ts"))
    y = F.coalesce("y", F.lit(1.0))
    return grid.join(p, ["series", "ts"], "left").select("series", "ts", (y / 1000).alias("y"), (y / 2000).alias("temp_f"))


@query("gate_run", with_(["p1"], f"""SELECT 'failing' AS run, "check", position, status, NULL::DOUBLE AS wape FROM bad UNION ALL SELECT 'failing', 'backtest', 9, CASE WHEN (SELECT count(*) FROM bad WHERE status = 'fail') > 0 THEN 'skipped' END, NULL
  UNION ALL SELECT 'passing', "check", position, status, NULL FROM good UNION ALL SELECT 'passing', 'backtest', 9, CASE WHEN (SELECT count(*) FROM good WHERE status = 'fail') > 0 THEN 'skipped' WHEN (SELECT wape FROM refit) >= 0 THEN 'pass' ELSE 'fail' END, (SELECT wape FROM refit)
  UNION ALL SELECT 'other figure', "check", position, status, NULL FROM good UNION ALL SELECT 'other figure', 'backtest', 9, CASE WHEN (SELECT count(*) FROM good WHERE status = 'fail') > 0 THEN 'skipped' ELSE 'fail' END, (SELECT wape FROM refit)""",
  {"full_panel": _FULL, "cand": _CAND, "kept": "SELECT series, ts, y, y / 2 AS temp_f FROM p1", "bad": _verdicts("cand", "kept"), "good": _verdicts("full_panel", "full_panel"), "refit": _REFIT}))
def _(t):
    """A candidate with faults, one without, and one whose refit does not give the published figure."""
    # The checks run one by one: the panel is written once, so they don't all join the orders with the customers again.
    panel = materialise(X.p1(t), "gate_panel")
    served, full = panel.select("ts"), full_panel(t, panel)
    # The figure published before is that of the leaderboard: one number.
    at = ts_lit(TRAIN_END)
    refit = naive(full.where(F.col("ts") <= at).withColumn("origin", at), 6, ["series", "origin"])
    published = M.score(full.join(refit.select("series", "ts", "p10", "p50", "p90"), ["series", "ts"]), only=["wape"], decimals=2).first()["wape"]
    spec = {"as_of": TRAIN_END, "horizon": 6, "forecaster": naive}
    runs = {"failing": (candidate(t, panel), tracked(t, panel), published), "passing": (full, full, published), "other figure": (full, full, published + 1)}
    reports = [
        G.run_gate(cand, kept, served, 25, LAST_CLOSED, spec | {"expected_wape": figure}).select(F.lit(name).alias("run"), "check", F.col("position").cast("long").alias("position"), "status", F.col("details")["wape"].cast("double").alias("wape"))
        for name, (cand, kept, figure) in runs.items()
    ]
    return reduce(DataFrame.unionByName, reports)


@query("gate_series_revision", """WITH n AS (SELECT o_custkey AS series, o_orderkey AS position, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS v, o_orderstatus = 'P' AS rev FROM orders)
  SELECT series, 'months not strictly increasing' AS problem, month FROM (SELECT *, lag(month) OVER (PARTITION BY series ORDER BY position) AS p FROM n) WHERE month <= p UNION ALL SELECT series, 'month after the last closed month', month FROM n WHERE month > '2001-05'
  UNION ALL SELECT series, 'committed month missing', month FROM (SELECT DISTINCT series, '1994-12' AS month FROM n WHERE series % 50 = 0) UNION ALL SELECT series, 'committed value changed without a revision', month FROM n WHERE NOT rev AND position % 40 = 0""")
def _(t):
    new = t.orders.select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("position"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").cast("string").alias("value"), F.when(F.col("o_orderstatus") == "P", 1).alias("revised_from"))
    # Committed rows: every fortieth order with another value, and a month that is gone, per series.
    old = new.where("position % 40 = 0").select("series", F.concat_ws("#", "month", "position").alias("k"), "month", "position")
    changed = old.select("series", "month", F.lit("-1").alias("value"), "position")
    gone = new.where("series % 50 = 0").select("series").distinct().select("series", F.lit("1994-12").alias("month"), F.lit("1").alias("value"), F.lit(None).cast("long").alias("position"))
    out = G.series_revision(new.withColumn("month", F.col("month")), gone.drop("position"), "2001-05", keys=["series"])
    # Changes are matched per position so that a month with several orders stays one comparison.
    again = G.series_revision(new, changed, "2001-05", keys=["series", "position"]).where("problem = 'committed value changed without a revision'").select("series", "problem", "month")
    return out.unionByName(again)


@query("gate_export_complete", with_(["p1"], "SELECT n AS series, CASE WHEN n >= 25 THEN 'no rows in the averaging window' ELSE 'average or level not finite' END AS reason FROM (SELECT unnest(range(0, 27)) AS n) WHERE n >= 25 OR n % 8 = 3"))
def _(t):
    avg = A.heat_scale(A.recent_average(X.p1(t)).withColumn("avg_recent", F.when(F.col("series") % 8 != 3, F.col("avg_recent"))))
    dim = t.nation.select(F.explode(F.array(F.col("n_nationkey").cast("long"), F.col("n_nationkey").cast("long") + 2)).alias("series"))
    return G.export_complete(dim, avg, "series")

