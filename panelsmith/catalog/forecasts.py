"""Forecasters, rolling origins, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..plans import backtest as B
from . import fixtures as X
from .common import flag, rnd, ts_lit
from .fixtures import BACKTESTS, BT_SQL, HORIZON, MODELS, TRAIN_END, backtest, with_
from .registry import query


def train(t):
    return X.p1(t).where(F.col("ts") <= ts_lit(TRAIN_END))


@query("fc_seasonal_naive", with_(["p5"], "SELECT series, ts, p10, p50, p90 FROM p5"))
def _(t):
    return X.p5(t)


_LAST = "SELECT c.o_custkey AS series, last, n FROM (SELECT o_custkey, max(o_orderdate) AS last, least(count(*), 12) AS n FROM orders GROUP BY 1) c"


@query("fc_naive_fallback", f"""SELECT l.series, CAST(date_trunc('month', last) + to_months(h) AS TIMESTAMP) AS ts, greatest(v, 0) * 0.8 AS p10, greatest(v, 0) AS p50, greatest(v, 0) * 1.2 AS p90 FROM ({_LAST}) l, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS h) g
  JOIN (SELECT o_custkey AS series, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON o.series = l.series AND o.rn = l.n - (h - 1) % l.n""")
def _(t):
    # Short customer histories: the context wraps around what it has.  A microsecond per key keeps time stamps distinct.
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") / 1e6)
    return FC.naive_ahead(t.orders.select(F.col("o_custkey").alias("series"), at.alias("ts"), F.col("o_totalprice").alias("y")), HORIZON, ["series"])


@query("fc_future_index", with_(["train"], "SELECT series, CAST(max(ts) + to_months(h) AS TIMESTAMP) AS ts, CAST(h AS BIGINT) AS horizon FROM train, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS h) GROUP BY series, h"))
def _(t):
    return FC.future_index(train(t), HORIZON, ["series"])


@query("fc_airline")
def _(t):
    from ..operators.panel import interpolate_months

    fc = FC.fan_out(interpolate_months(train(t)).drop("imputed"), ["series"], FC.airline(HORIZON), 24)
    return rnd(fc, 2, "p10", "p50", "p90")


def last_value(pdf):
    """A deliberately fragile forecaster: it fails for series whose last value is odd."""
    import pandas as pd

    v = float(pdf["y"].iloc[-1])
    if int(v) % 2:
        raise ValueError("odd last value")
    return pd.DataFrame({"ts": [pdf["ts"].iloc[-1] + pd.DateOffset(months=1)], "p10": [v * 0.5], "p50": [v], "p90": [v * 1.5]})


@query("fc_fanout", with_(["train"], """SELECT series, CASE WHEN n < 60 THEN NULL WHEN CAST(y AS BIGINT) % 2 = 1 THEN NULL ELSE CAST(ts + INTERVAL 1 MONTH AS TIMESTAMP) END AS ts, CASE WHEN n >= 60 AND CAST(y AS BIGINT) % 2 = 0 THEN y END AS p50, CASE WHEN n >= 60 AND CAST(y AS BIGINT) % 2 = 0 THEN 'ok' ELSE 'failed' END AS status,
  CASE WHEN n < 60 THEN 'ValueError: ' || n || ' rows of history, 60 needed' WHEN CAST(y AS BIGINT) % 2 = 1 THEN 'ValueError: odd last value' END AS error FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS rn FROM train) WHERE rn = 1"""))
def _(t):
    return FC.fan_out(train(t), ["series"], last_value, 60).select("series", "ts", "p50", "status", "error")


_EXOG = "SELECT series, ts, y, CAST(month(ts) * 3 + series AS DOUBLE) AS temp_f, CASE WHEN series % 6 = 0 THEN 1.0 ELSE y / 1000 END AS wind FROM p1"


def _exog(t):
    return X.p1(t).withColumns({"temp_f": (F.month("ts") * 3 + F.col("series")).cast("double"), "wind": F.when(F.col("series") % 6 == 0, 1.0).otherwise(F.col("y") / 1000)})


_STATS = f"SELECT series, avg(temp_f) AS tm, stddev_pop(temp_f) AS tsd, avg(wind) AS wm, stddev_pop(wind) AS wsd FROM ({_EXOG}) WHERE ts <= TIMESTAMP '{TRAIN_END}' GROUP BY series"


@query("fc_standardise_exog", with_(["p1"], f"SELECT series, ts, {flag('tsd > 0 AND wsd > 0', 'exog_ok')}, CASE WHEN tsd > 0 AND wsd > 0 THEN round((temp_f - tm) / tsd, 6) END AS temp_f, CASE WHEN tsd > 0 AND wsd > 0 THEN round((wind - wm) / wsd, 6) END AS wind FROM ({_EXOG}) JOIN ({_STATS}) USING (series)"))
def _(t):
    return rnd(FC.standardise_exog(_exog(t), ["temp_f", "wind"], ts_lit(TRAIN_END)), 6, "temp_f", "wind")


@query("fc_future_exog", with_(["p1"], f"""SELECT g.series, g.ts, round((e.temp_f - s.tm) / s.tsd, 6) AS temp_f, CAST(CAST(e.temp_f IS NULL AS INTEGER) AS DOUBLE) AS missing FROM (SELECT DISTINCT series, CAST(TIMESTAMP '2001-05-01' + to_months(h) AS TIMESTAMP) AS ts FROM p1, (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS h)) g
  LEFT JOIN ({_EXOG}) e USING (series, ts) LEFT JOIN ({_STATS}) s ON s.series = g.series"""))
def _(t):
    scaled = FC.standardise_exog(_exog(t), ["temp_f"], ts_lit(TRAIN_END))
    return rnd(FC.future_exog(scaled, ["temp_f"], F.lit("2001-04-30"), HORIZON), 6, "temp_f")


CHANGES = {"step_1997_06": "1997-06-01", "step_2000_03": "2000-03-01"}


@query("fc_step_columns", with_(["p1"], "SELECT series, ts, CAST(ts >= TIMESTAMP '1997-06-01' AS BIGINT) AS step_1997_06, CAST(ts >= TIMESTAMP '2000-03-01' AS BIGINT) AS step_2000_03 FROM p1"))
def _(t):
    return FC.step_columns(X.p1(t), CHANGES).drop("y")


WINDOWS = [
    {"name": "early", "start": "1996-01-01", "end": "1996-06-01", "cutoff": "1995-12-01"},
    {"name": "middle", "start": "1999-01-01", "end": "1999-06-01", "cutoff": "1998-12-01"},
    {"name": "change", "start": "2000-01-01", "end": "2000-06-01", "cutoff": "1999-12-01"},
    {"name": "late", "start": "2001-04-01", "end": "2001-09-01", "cutoff": "2001-03-01"},
]
_W = "(VALUES " + ", ".join(f"('{w['name']}', TIMESTAMP '{w['start']}', TIMESTAMP '{w['end']}', TIMESTAMP '{w['cutoff']}')" for w in WINDOWS) + ") AS w(name, s, e, c)"


@query("fc_window_admission", with_(["p1"], f"""WITH g AS (SELECT n.series, w.name, m.ts, m.ts <= w.c AS tr, p.series IS NOT NULL AS have FROM (SELECT DISTINCT series FROM p1) n, {_W}, (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-09-01', INTERVAL 1 MONTH)) AS ts) m
    LEFT JOIN p1 p ON p.series = n.series AND p.ts = m.ts WHERE m.ts <= w.e AND NOT (m.ts <= w.c AND m.ts = TIMESTAMP '1997-02-01')),
  v AS (SELECT series, name AS window, count(*) FILTER (WHERE tr AND have) AS usable_months, count(*) FILTER (WHERE tr) AS planned, count(*) FILTER (WHERE NOT tr AND have) AS actual_months, count(*) FILTER (WHERE NOT tr AND ts >= TIMESTAMP '2000-03-01') AS win_b, count(*) FILTER (WHERE tr AND have AND ts >= TIMESTAMP '2000-03-01') AS pre_b,
    count(*) FILTER (WHERE NOT tr AND ts >= TIMESTAMP '1997-06-01') AS win_a, count(*) FILTER (WHERE tr AND have AND ts >= TIMESTAMP '1997-06-01') AS pre_a FROM g GROUP BY 1, 2)
  SELECT series, "window", usable_months, actual_months, concat_ws('; ', CASE WHEN usable_months < 24 THEN 'insufficient history' WHEN usable_months < planned THEN 'gap in training months' END, CASE WHEN actual_months < 6 THEN 'incomplete actuals' END, CASE WHEN win_a > 0 AND pre_a < 12 THEN 'step_1997_06 lacks support' END, CASE WHEN win_b > 0 AND pre_b < 12 THEN 'step_2000_03 lacks support' END) AS reason FROM v""").replace("WITH p1", "WITH p1", 1).replace(") WITH g AS", "), g AS", 1))
def _(t):
    v = FC.window_admission(X.p1(t), WINDOWS, "1995-01-01", ["1997-02-01"], CHANGES, HORIZON, 24, 12, "change")
    return v.select("series", "window", "usable_months", "actual_months", "reason")


@query("fc_rolling_pool", with_(["p6"], "SELECT series, ts, y, origin, horizon, p10, p50, p90 FROM p6"))
def _(t):
    return X.p6(t)


@query("fc_quantile_columns", with_(["p5"], "SELECT series, ts, p10, p50, p90 FROM p5"))
def _(t):
    raw = X.p5(t).select("series", "ts", F.col("p10").alias("0.1"), F.col("p50").alias("mean"), F.col("p90").alias("0.9"))
    return FC.quantile_columns(raw)


_OK = "count(*) FILTER (WHERE y IS NOT NULL AND p50 IS NULL) = 0"


@query("fc_backtest_windows", with_(["p1"], f"""SELECT "window", model, CASE WHEN {_OK} THEN round(sum(abs(y - p50)) / sum(abs(y)) * 100, 2) END AS wape, CASE WHEN {_OK} THEN round(avg(abs(y - p50)), 2) END AS mae, count(p50) AS n, CASE WHEN {_OK} THEN round(avg(CAST(y >= p10 AND y <= p90 AS INTEGER)) * 100, 2) END AS coverage,
  CASE WHEN count(p50) < count(*) THEN 'rejected: forecast missing rows' ELSE 'ok' END AS status FROM bt GROUP BY 1, 2""", BT_SQL))
def _(t):
    return B.score_cells(backtest(t), list(MODELS), [w["name"] for w in BACKTESTS])


@query("fc_backtest_beats", with_(["p1"], f"""SELECT "window", count(*) AS n_series, count(*) FILTER (WHERE a < b) AS n_beats FROM (SELECT "window", series, round(sum(abs(y - p50)) FILTER (WHERE model = 'naive') / sum(y) FILTER (WHERE model = 'naive') * 100, 4) AS a, round(sum(abs(y - p50)) FILTER (WHERE model = 'recent') / sum(y) FILTER (WHERE model = 'recent') * 100, 4) AS b,
  count(*) FILTER (WHERE p50 IS NULL) AS miss FROM bt GROUP BY 1, 2) WHERE miss = 0 GROUP BY 1""", BT_SQL))
def _(t):
    return B.beats(B.series_wape(backtest(t)), "naive", "recent")
