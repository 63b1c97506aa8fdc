"""Metrics, comparisons and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import panel as P
from ..operators.calibration import incomplete
from ..plans import backtest as B
from . import fixtures as X
from .common import flag, rnd, ts_lit
from .fixtures import BACKTESTS, BT_SQL, HORIZON, MODELS, ORIGINS, TRAIN_END, backtest, with_
from .registry import query


def holed(t):
    """The rolling pool with actuals missing for one series and forecasts for another."""
    return X.p6(t).withColumns({"y": F.when(F.col("series") != 4, F.col("y")), "p50": F.when((F.col("series") != 9) | (F.col("horizon") != 2), F.col("p50"))})


_HOLED = {"hp": "SELECT series, ts, origin, horizon, CASE WHEN series <> 4 THEN y END AS y, p10, CASE WHEN series <> 9 OR horizon <> 2 THEN p50 END AS p50, p90 FROM p6"}
_GOOD = "count(*) FILTER (WHERE y IS NOT NULL AND p50 IS NULL) = 0 AND count(y) > 0"
_METRIC = {
    "mae": "avg(abs(y - p50))", "rmse": "sqrt(avg((y - p50) * (y - p50)))", "mape": "avg(abs(y - p50) / greatest(abs(y), 1)) * 100",
    "wape": "sum(abs(y - p50)) / sum(CASE WHEN p50 IS NOT NULL THEN abs(y) END) * 100", "smape": "avg(abs(y - p50) / ((abs(y) + abs(p50)) / 2 + 1)) * 100",
}


@query("m_scorable", with_(["p6"], f"SELECT series, count(CASE WHEN p50 IS NOT NULL THEN y END) AS n, count(y) AS n_expected, CASE WHEN {_GOOD} THEN round(avg(abs(y - p50)), 4) END AS mae FROM hp GROUP BY series", _HOLED))
def _(t):
    return M.score(holed(t), ["series"], ["n", "n_expected", "mae"])


for _name, _expr in _METRIC.items():
    @query(f"m_{_name}", with_(["p6"], f"SELECT series, CASE WHEN {_GOOD} THEN round({_expr}, 4) END AS {_name} FROM hp GROUP BY series", _HOLED))
    def _(t, name=_name):
        return M.score(holed(t), ["series"], [name])


@query("m_mase", with_(["scored", "train"], """SELECT s.series, round(avg(abs(y - p50)) / any_value(scale), 4) AS mase FROM scored s JOIN (SELECT series, avg(abs(y - l)) AS scale FROM (SELECT series, y, lag(y, 12) OVER (PARTITION BY series ORDER BY ts) AS l FROM train) GROUP BY series) m ON m.series = s.series GROUP BY s.series"""))
def _(t):
    train = X.p1(t).where(F.col("ts") <= ts_lit(TRAIN_END))
    scale = P.mase_scale(train, 12, by=["series"])
    j = X.scored(t).join(scale, "series", "left")
    return j.groupBy("series").agg(F.round(M.score_columns()["mae"] / F.max("mase_scale"), 4).alias("mase"))


@query("m_coverage", with_(["p6"], "SELECT horizon, round(avg(CAST(y >= p10 AND y <= p90 AS INTEGER)) * 100, 4) AS coverage FROM p6 GROUP BY horizon"))
def _(t):
    return M.score(X.p6(t), ["horizon"], ["coverage"])


@query("m_width", with_(["p6"], "SELECT horizon, CASE WHEN count(*) = count(p90) THEN round(avg(p90 - p10), 3) END AS width FROM p6 GROUP BY horizon"))
def _(t):
    return M.score(X.p6(t), ["horizon"], ["width"], 3)


_COMPLETE = "count(*) FILTER (WHERE y IS NOT NULL AND (p10 IS NULL OR p90 IS NULL)) = 0 AND count(y) > 0"
_MISS = "CASE WHEN y < p10 THEN p10 - y WHEN y > p90 THEN y - p90 ELSE 0 END"
_BAND = {
    "coverage": "100 * avg(CASE WHEN y IS NOT NULL THEN CAST(y >= p10 AND y <= p90 AS INTEGER) END)", "below_p10": "100 * avg(CASE WHEN y < p10 THEN 1 ELSE 0 END)",
    "above_p90": "100 * avg(CASE WHEN y > p90 THEN 1 ELSE 0 END)", "width_of_p50": "100 * avg((p90 - p10) / nullif(p50, 0))", "interval_score": f"100 * sum((p90 - p10) + 10 * ({_MISS})) / sum(y)",
}


_IS = ", ".join(f"round({e}, 2) AS {n}" for n, e in _BAND.items())


def interval_sql(by: str, source: str = "gp6") -> str:
    """Interval scores of a pool by the columns ``by``; groups with a forecast missing where there is an actual have none."""
    scores = ", ".join(f"CASE WHEN {_COMPLETE} THEN round({e}, 2) END AS {n}" for n, e in _BAND.items())
    return f"""SELECT a.*, CASE WHEN a.coverage IS NOT NULL THEN b.months END AS coverage_by_month FROM (SELECT {by}, count(*) AS n, {scores} FROM {source} GROUP BY {by}) a JOIN (SELECT {by}, string_agg(c, ' ' ORDER BY ts) AS months FROM
  (SELECT {by}, ts, printf('%.0f', 100 * avg(coalesce(CAST(y >= p10 AND y <= p90 AS INTEGER), 0))) AS c FROM {source} GROUP BY {by}, ts) GROUP BY {by}) b USING ({by})"""


@query("m_interval_score", with_(["gp6"], f"SELECT s.*, i.n_incomplete FROM ({interval_sql('horizon')}) s JOIN (SELECT horizon, count(*) FILTER (WHERE y IS NOT NULL AND p50 IS NULL) AS n_incomplete FROM gp6 GROUP BY 1) i USING (horizon)"))
def _(t):
    pool = X.gapped(t)
    missing = pool.groupBy("horizon").agg(F.count_if(incomplete()).alias("n_incomplete"))
    return M.interval_scores(pool, ["horizon"]).join(missing, "horizon")


_SLICED = """SELECT 'overall' AS slice, 'all' AS slice_value, * FROM hp UNION ALL SELECT 'series', CAST(series AS VARCHAR), * FROM hp UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), * FROM hp UNION ALL SELECT 'weekday', CAST(isodow(ts) - 1 AS VARCHAR), * FROM hp
  UNION ALL SELECT 'game_day', 'all', * FROM hp WHERE month(ts) IN (3, 7) UNION ALL SELECT 'normal_day', 'all', * FROM hp WHERE month(ts) NOT IN (3, 7, 8) UNION ALL SELECT 'rainy', 'all', * FROM hp WHERE series % 2 = 0 UNION ALL SELECT 'clear', 'all', * FROM hp WHERE series % 2 = 1"""


@query("m_slices", with_(["p6"], f"SELECT slice, slice_value, count(CASE WHEN p50 IS NOT NULL THEN y END) AS n, count(y) AS n_expected, CASE WHEN {_GOOD} THEN round({_METRIC['wape']}, 4) END AS wape, CASE WHEN {_GOOD} THEN round({_METRIC['mae']}, 4) END AS mae FROM ({_SLICED}) GROUP BY 1, 2", _HOLED))
def _(t):
    # Month 8 is unknown: it belongs to neither the event nor the normal slice.
    df = holed(t).withColumns({"is_game_day": F.when(F.month("ts") != 8, F.month("ts").isin(3, 7)), "is_raining": F.col("series") % 2 == 0})
    keys, flags = M.evaluation_slices(df.columns)
    return M.score(M.slice_rows(df, {"series": "series"} | keys, flags), ["slice", "slice_value"], ["n", "n_expected", "wape", "mae"])


_MR = f"""SELECT model, slice, count(p50) AS n, count(*) AS n_expected, count(DISTINCT CASE WHEN p50 IS NULL THEN series END) AS n_missing_series, {', '.join(f"CASE WHEN {_GOOD} THEN round({e}, 2) END AS {k}" for k, e in _METRIC.items())},
  CASE WHEN count(*) FILTER (WHERE p10 IS NULL) = 0 THEN round(100 * avg(CAST(y >= p10 AND y <= p90 AS INTEGER)), 2) END AS coverage, CASE WHEN {_GOOD} THEN round(avg(abs(y - p50)) / any_value(scale), 4) END AS mase, 'own band' AS interval_method"""
_BH = {**BT_SQL, "bx": "SELECT \"window\", model, series, ts, y, CASE WHEN model = 'naive' AND series = 9 AND month(ts) = 2 THEN NULL ELSE p10 END AS p10, CASE WHEN model = 'naive' AND series = 9 AND month(ts) = 2 THEN NULL ELSE p50 END AS p50, p90 FROM bt"}


def holed_backtest(t):
    hole = (F.col("model") == "naive") & (F.col("series") == 9) & (F.month("ts") == 2)
    return backtest(t).withColumns({"p10": F.when(~hole, F.col("p10")), "p50": F.when(~hole, F.col("p50"))})


def _model_rows(t):
    scale = P.mase_scale(X.p1(t).where(F.col("ts") <= ts_lit(TRAIN_END)), 12)
    df = holed_backtest(t).withColumns({"is_game_day": F.month("ts").isin(3, 7), "is_raining": F.when(F.month("ts") != 5, F.col("series") % 2 == 0)})
    return M.model_rows(df, ["model"], None, scale, "own band")


@query("m_model_rows", with_(["p1", "train"], f"""{_MR} FROM (SELECT 'overall' AS slice, * FROM bx UNION ALL SELECT 'game_day', * FROM bx WHERE month(ts) IN (3, 7) UNION ALL SELECT 'rainy_day', * FROM bx WHERE series % 2 = 0 AND month(ts) <> 5),
  (SELECT avg(abs(y - l)) AS scale FROM (SELECT y, lag(y, 12) OVER (PARTITION BY series ORDER BY ts) AS l FROM train)) GROUP BY model, slice""", _BH))
def _(t):
    return _model_rows(t)


@query("m_missing_series", with_(["p1"], "SELECT model, series, count(*) AS n_missed FROM bx WHERE y IS NOT NULL AND p50 IS NULL GROUP BY 1, 2", _BH))
def _(t):
    return M.missing_series(holed_backtest(t), ["model"])


@query("m_accept", with_(["p1"], """SELECT model, n, n_expected, CASE WHEN n < n_expected THEN 'forecast missing rows' WHEN wape IS NULL THEN 'no valid score' WHEN wape > 8 THEN 'WAPE above ceiling' END AS reason FROM (SELECT model || '/' || "window" AS model, count(p50) AS n, count(*) AS n_expected,
  CASE WHEN count(p50) = count(*) THEN round(sum(abs(y - p50)) / sum(y) * 100, 2) END AS wape FROM bx GROUP BY model, "window")""", _BH))
def _(t):
    rows = M.model_rows(holed_backtest(t).withColumn("model", F.concat_ws("/", "model", "window")), ["model"], {})
    return rows.select("model", "n", "n_expected", M.rejection(ceiling=8.0).alias("reason"))


@query("m_simple_eval", with_(["p6"], "SELECT series, count(*) AS n, round(avg(abs(y - p50)), 4) AS mae, round(sqrt(avg((y - p50) * (y - p50))), 4) AS rmse, round(avg(CASE WHEN y <> 0 THEN abs(y - p50) / abs(y) END) * 100, 4) AS mape, round(sum(abs(y - p50)) / sum(CASE WHEN p50 IS NOT NULL THEN abs(y) END) * 100, 4) AS wape FROM hp GROUP BY series", _HOLED))
def _(t):
    return rnd(M.simple_evaluation(holed(t), ["series"]), 4, "mae", "rmse", "mape", "wape")


# Two-sided p of Student's t for whole degrees of freedom: the finite cosine series, even and odd.
_P = """CASE WHEN nu % 2 = 0 THEN 1 - sin(th) * list_sum(list_transform(range(0, nu // 2), lambda j: coalesce(exp(list_sum(list_transform(range(1, j + 1), lambda i: ln((2 * i - 1) / (2.0 * i))))), 1) * pow(cos(th), 2 * j)))
  ELSE 1 - 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (nu - 1) // 2), lambda j: coalesce(exp(list_sum(list_transform(range(1, j + 1), lambda i: ln(2 * i / (2.0 * i + 1))))), 1) * pow(cos(th), 2 * j + 1)))) END"""


@query("m_diebold_mariano", with_(["actuals", "p5", "p5r"], f"""SELECT 'naive' AS model_a, 'recent' AS model_b, n, round(md, 4) AS mean_d, round(t, 4) AS t_stat, round(p, 4) AS p_value, {flag('p < 0.05', 'significant')}, CASE WHEN md > 0 AND p < 0.05 THEN 'recent' ELSE 'naive' END AS winner FROM
  (SELECT *, {_P} AS p FROM (SELECT *, n - 1 AS nu, atan(abs(t) / sqrt(n - 1)) AS th FROM (SELECT count(*) AS n, avg(d) AS md, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM (SELECT abs(a.y - f.p50) - abs(a.y - g.p50) AS d FROM actuals a JOIN p5 f USING (series, ts) JOIN p5r g USING (series, ts)))))"""))
def _(t):
    return M.diebold_mariano(X.actuals(t), X.p5(t), X.p5_recent(t), "naive", "recent")


_CT = f"""SELECT n_series, round(md, 4) AS mean_d, round(t, 4) AS t, round({_P}, 6) AS p, arm_better, control_better FROM (SELECT *, n_series - 1 AS nu, atan(abs(t) / sqrt(n_series - 1)) AS th FROM (SELECT count(*) AS n_series, avg(d) AS md, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t,
  count(*) FILTER (WHERE d > 0) AS arm_better, count(*) FILTER (WHERE d < 0) AS control_better FROM (SELECT series, avg(abs(a.y - f.p50) - abs(a.y - g.p50)) AS d FROM actuals a JOIN p5 f USING (series, ts) JOIN p5r g USING (series, ts) GROUP BY series)))"""


@query("m_clustered_t", with_(["actuals", "p5", "p5r"], _CT))
def _(t):
    return rnd(rnd(M.clustered_t(X.actuals(t), X.p5(t), X.p5_recent(t)), 4, "mean_d", "t"), 6, "p")


@query("m_verdict", "SELECT o_orderkey, CASE WHEN o_custkey % 7 < 3 AND o_orderkey % 100 / 1000.0 < 0.05 AND o_custkey % 5 - 2 > 0 AND CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 3 END < 2 THEN 'improves' ELSE 'no improvement shown' END AS verdict FROM orders")
def _(t):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    v = M.verdict(k % 7, F.lit(3), o % 100 / 1000.0, k % 5 - 2, F.when(o % 11 != 0, k % 3), F.lit(2))
    return t.orders.select("o_orderkey", v.alias("verdict"))


@query("m_experiment_table", with_(["p1"], f"""SELECT 'recent' AS model, (SELECT round(w, 4) FROM c WHERE model = 'recent' AND win = '2000-H1') AS test_wape_arm, (SELECT round(w, 4) FROM c WHERE model = 'recent' AND win = '1999-H2') AS val_wape_arm, (SELECT round(w, 4) FROM c WHERE model = 'naive' AND win = '2000-H1') AS test_wape_control,
  n AS n_series, round(md, 4) AS mean_d, CASE WHEN (SELECT round(w, 4) FROM c WHERE model = 'recent' AND win = '2000-H1') < (SELECT round(w, 4) FROM c WHERE model = 'naive' AND win = '2000-H1') AND p < 0.05 AND md > 0 AND (SELECT round(w, 4) FROM c WHERE model = 'recent' AND win = '1999-H2') < (SELECT round(w, 4) FROM c WHERE model = 'naive' AND win = '1999-H2') THEN 'improves' ELSE 'no improvement shown' END AS verdict
  FROM (SELECT *, {_P} AS p FROM (SELECT *, n - 1 AS nu, atan(abs(t) / sqrt(n - 1)) AS th FROM (SELECT count(*) AS n, avg(d) AS md, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM (SELECT series, avg(CASE model WHEN 'naive' THEN abs(y - p50) END) - avg(CASE model WHEN 'recent' THEN abs(y - p50) END) AS d FROM bt WHERE "window" = '2000-H1' GROUP BY series))))""",
  {**BT_SQL, "c": 'SELECT model, "window" AS win, sum(abs(y - p50)) / sum(y) * 100 AS w FROM bt GROUP BY 1, 2'}))
def _(t):
    x = B.experiment_table(backtest(t), "naive", ["recent"], "2000-H1", "1999-H2")
    return rnd(x, 4, "mean_d").select("model", "test_wape_arm", "val_wape_arm", "test_wape_control", "n_series", "mean_d", "verdict")


# Candidates of the selection rule: pooled bands scaled by a factor, scored on two windows.
FACTORS = {"incumbent": 1.0, "narrow": 0.5, "wide": 1.15, "wider": 1.25}


def rule_candidates(t):
    df = backtest(t).where(F.col("window").isin("1999-H2", "2000-H1")).withColumn("window", F.when(F.col("window") == "1999-H2", "B").otherwise("V"))
    from ..operators.joins import evaluation_matrix

    c = evaluation_matrix(df, [{"candidate": k, "factor": v} for k, v in FACTORS.items()])
    c = c.withColumns({"p10": F.col("p50") - (F.col("p50") - F.col("p10")) * F.col("factor"), "p90": F.col("p50") + (F.col("p90") - F.col("p50")) * F.col("factor")})
    return M.interval_scores(c, ["model", "candidate", "window"], months=False)


_RC = {**BT_SQL, "rc": f"""SELECT model, candidate, "window", count(*) AS n, {_IS} FROM (SELECT model, candidate, CASE "window" WHEN '1999-H2' THEN 'B' ELSE 'V' END AS "window", y, p50, p50 - (p50 - p10) * factor AS p10, p50 + (p90 - p50) * factor AS p90 FROM bt, (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in FACTORS.items())}) f(candidate, factor) WHERE "window" IN ('1999-H2', '2000-H1')) GROUP BY 1, 2, 3""",
  "rt": "SELECT b.model, b.candidate, b.coverage AS coverage_B, v.coverage AS coverage_V, b.interval_score AS interval_score_B, v.interval_score AS interval_score_V, b.coverage BETWEEN 75 AND 92 AND b.below_p10 <= 15 AND b.above_p90 <= 15 AND v.coverage BETWEEN 75 AND 92 AND v.below_p10 <= 15 AND v.above_p90 <= 15 AS ok, (b.interval_score + v.interval_score) / 2 AS mean_score FROM rc b JOIN rc v ON b.model = v.model AND b.candidate = v.candidate AND b.\"window\" = 'B' AND v.\"window\" = 'V'"}


@query("m_rule_table", with_(["p1"], f"SELECT model, candidate, coverage_B, coverage_V, interval_score_B, interval_score_V, {flag('ok', 'qualifies')}, round(mean_score, 4) AS mean_score FROM rt", _RC))
def _(t):
    return rnd(M.rule_table(rule_candidates(t), high=92.0), 4, "mean_score").select("model", "candidate", "coverage_B", "coverage_V", "interval_score_B", "interval_score_V", "qualifies", "mean_score")


@query("m_apply_rule", with_(["p1"], """SELECT m.model, coalesce(s.candidate, o.candidate, 'keep current entry') AS choice, CASE WHEN s.candidate IS NOT NULL THEN 'one method qualifies for every model' WHEN o.candidate IS NOT NULL THEN 'lowest-scoring qualifier for this model' ELSE 'no eligible candidate qualifies' END AS basis FROM (SELECT DISTINCT model FROM rt) m
  LEFT JOIN (SELECT candidate FROM rt WHERE ok AND candidate <> 'incumbent' GROUP BY 1 HAVING count(DISTINCT model) = 2 ORDER BY avg(mean_score), candidate LIMIT 1) s ON true LEFT JOIN (SELECT model, candidate FROM rt WHERE ok QUALIFY row_number() OVER (PARTITION BY model ORDER BY mean_score, candidate) = 1) o ON o.model = m.model""", _RC))
def _(t):
    return M.apply_rule(M.rule_table(rule_candidates(t), high=92.0), len(MODELS))


@query("m_store_cut_check", with_(["p6"], f"""SELECT 0.0::DOUBLE AS max_abs_diff, 0 AS missing_resolved, 0 AS cut_only, count(DISTINCT origin) AS origins_cut, count(*) AS rows_compared, count(*) AS rows_compared_resolved, 1.0::DOUBLE AS passed FROM p6 WHERE p50 IS NOT NULL AND origin + INTERVAL {HORIZON} MONTH > TIMESTAMP '{TRAIN_END}'"""))
def _(t):
    from ..operators import forecast as FC

    p = X.p1(t)
    cut = FC.rolling_pool(p.where(F.col("ts") <= ts_lit(TRAIN_END)), ORIGINS, HORIZON, TRAIN_END)
    return M.cut_check(cut, FC.rolling_pool(p, ORIGINS, HORIZON, None), ts_lit(TRAIN_END), HORIZON)


def published(t):
    """A published table with one wrong cell and one unknown model."""
    rows = M.model_rows(backtest(t), ["model", "window"], {})
    wrong = (F.col("model") == "recent") & (F.col("window") == "1999-H1")
    return rows.select("model", "window", F.when(wrong, F.col("wape") + 0.5).otherwise(F.col("wape")).alias("wape"), "mae", "coverage")


@query("m_leaderboard_check", with_(["p1"], f"SELECT DISTINCT model, \"window\", CASE WHEN model = 'recent' AND \"window\" = '1999-H1' THEN 'wape differs' ELSE '' END AS reason, CAST(CAST(NOT (model = 'recent' AND \"window\" = '1999-H1') AS INTEGER) AS DOUBLE) AS accepted FROM bt", BT_SQL))
def _(t):
    fresh = M.score(backtest(t), ["model", "window"], ["wape", "mae", "coverage"])
    return M.leaderboard_check(fresh, published(t), ["model", "window"])


@query("m_backtest_check", with_(["p1"], "SELECT DISTINCT \"window\", CASE WHEN \"window\" = '1999-H1' THEN 'published window differs from the leaderboard' ELSE '' END AS reason FROM bt", BT_SQL))
def _(t):
    cells = B.score_cells(backtest(t), list(MODELS), [w["name"] for w in BACKTESTS])
    return B.backtest_check(cells, published(t).where("window = '1999-H1'"), list(MODELS), "1999-H1")


@query("m_best_on_window", with_(["p1"], "SELECT model, round(w, 2) AS wape, months AS n_months, 0 AS n_bad_bands, 1.0::DOUBLE AS publishable FROM (SELECT model, sum(abs(y - p50)) / sum(y) * 100 AS w, count(DISTINCT ts) AS months FROM bt WHERE \"window\" = '2000-H1' GROUP BY 1) ORDER BY round(w, 2), model LIMIT 1", BT_SQL))
def _(t):
    frame = backtest(t)
    cells = B.score_cells(frame, list(MODELS), [w["name"] for w in BACKTESTS])
    return B.best_on_window(cells, frame, "2000-H1", HORIZON)
