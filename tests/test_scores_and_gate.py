"""Scores, paired tests, selection rule, quality checks and the publish gate."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelsmith.functions.stats import student_t_two_sided
from panelsmith.operators import gate as G
from panelsmith.operators import metrics as M
from panelsmith.operators import quality as Q
from panelsmith.plans import backtest as B

SCHEMA = "series string, ts timestamp_ntz, y double, p10 double, p50 double, p90 double"


def rows(spark, data):
    return spark.createDataFrame([(s, dt.datetime(2024, m, 1), y, a, b, c) for s, m, y, a, b, c in data], SCHEMA)


def test_missing_forecast_makes_the_metric_undefined(spark):
    df = rows(spark, [("a", 1, 100.0, 80.0, 110.0, 120.0), ("a", 2, 200.0, None, None, None), ("b", 1, None, 1.0, 1.0, 1.0), ("b", 2, 50.0, 40.0, 45.0, 60.0), ("c", 1, 0.2, 0.0, 1.0, 2.0)])
    r = {x.series: x for x in M.score(df, ["series"]).collect()}
    assert (r["a"].n, r["a"].n_expected, r["a"].mae, r["a"].wape, r["a"].coverage, r["a"].width) == (1, 2, None, None, None, None)
    assert (r["b"].n, r["b"].mae, r["b"].wape, r["b"].coverage) == (1, 5.0, 10.0, 100.0)
    # Tiny totals have no WAPE; MAPE floors the denominator at one.
    assert r["c"].wape is None and r["c"].mape == 80.0


def test_negative_forecasts_are_floored(spark):
    assert M.score(rows(spark, [("a", 1, 10.0, -5.0, -5.0, 5.0)]), [], ["mae"]).first().mae == 10.0


def test_slices_skip_unknown_flags(spark):
    df = rows(spark, [("a", m, 100.0, 90.0, 100.0 + m, 120.0) for m in range(1, 7)]).withColumn("is_game_day", F.when(F.month("ts") == 1, True).when(F.month("ts") == 2, False))
    keys, flags = M.evaluation_slices(df.columns)
    n = {(x.slice, x.slice_value): x.n for x in M.score(M.slice_rows(df, keys, flags), ["slice", "slice_value"], ["n"]).collect()}
    assert n[("overall", "all")] == 6 and n[("game_day", "all")] == 1 and n[("normal_day", "all")] == 1


def test_rejection_and_ranking(spark):
    cols = "model string, slice string, n long, n_expected long, wape double"
    df = spark.createDataFrame([("good", "overall", 6, 6, 5.0), ("tie", "overall", 6, 6, 5.0), ("short", "overall", 5, 6, None), ("wild", "overall", 6, 6, 140.0), ("good", "rainy_day", 1, 1, 4.0)], cols)
    acc = M.accepted(df, ["model"])
    assert {(x.model, x.slice) for x in acc.collect()} == {("good", "overall"), ("tie", "overall"), ("good", "rainy_day")}
    assert [(x.model, x.rank) for x in M.rank_leaderboard(acc).orderBy("rank").collect()] == [("good", 1), ("tie", 2)]
    why = {x.model: x.r for x in df.where("slice = 'overall'").select("model", M.rejection().alias("r")).collect()}
    assert why == {"good": None, "tie": None, "short": "forecast missing rows", "wild": "WAPE above ceiling"}


@pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 1e7, 0.05), (0.0, 5, 1.0), (2.0, 24, 0.0569), (-3.5, 149, 0.000613)])
def test_student_t_tail(t, df, p):
    assert student_t_two_sided(t, df) == pytest.approx(p, rel=2e-2, abs=1e-4)


def test_diebold_mariano_needs_significance(spark):
    rng = np.random.default_rng(0)
    y = rng.uniform(100, 200, 60)
    def frame(err):
        return spark.createDataFrame([(f"s{i}", dt.datetime(2024, 1, 1), float(v + e)) for i, (v, e) in enumerate(zip(y, err))], "series string, ts timestamp_ntz, p50 double")
    act = frame(np.zeros(60)).withColumnRenamed("p50", "y")
    big, small, noise = rng.normal(0, 20, 60), rng.normal(0, 1, 60), rng.normal(0, 20, 60)
    assert M.diebold_mariano(act, frame(big), frame(small), "A", "B").first().winner == "B"
    row = M.diebold_mariano(act, frame(big), frame(noise), "A", "B").first()
    assert row.winner == ("B" if row.mean_d > 0 and row.p_value < 0.05 else "A")
    d = np.abs(big) - np.abs(noise)
    assert row.t_stat == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(60)), abs=1e-3)


def test_pairing_report_names_every_violation(spark):
    k = "series string, ts timestamp_ntz"
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    act = spark.createDataFrame([("a", t1, 1.0), ("a", t2, 2.0), ("b", t1, 3.0)], k + ", y double")
    ctl = spark.createDataFrame([("a", t1, 1.0), ("a", t2, None), ("b", t1, 3.0)], k + ", p50 double")
    arm = spark.createDataFrame([("a", t1, 1.0), ("a", t1, 1.0), ("b", t2, 3.0)], k + ", p50 double")
    r = M.pairing_report(act, ctl, arm).first()
    assert (r.n_series, r.without_control, r.without_arm, r.without_actual, r.duplicate_keys) == (2, 1, 2, 1, 1) and r.non_finite >= 1


def test_verdict_fails_on_any_missing_input(spark):
    df = spark.createDataFrame([(3.0, 4.0, 0.01, 1.0, 3.0, 4.0), (None, 4.0, 0.01, 1.0, 3.0, 4.0), (3.0, 4.0, 0.2, 1.0, 3.0, 4.0), (3.0, 4.0, 0.01, -1.0, 3.0, 4.0)],
                               "test_wape_arm double, test_wape_control double, p double, mean_d double, val_wape_arm double, val_wape_control double")
    assert [x.v for x in df.select(M.verdict().alias("v")).collect()] == ["improves"] + ["no improvement shown"] * 3


def test_selection_rule(spark):
    c = "model string, candidate string, window string, coverage double, below_p10 double, above_p90 double, interval_score double"
    good, bad = (80.0, 10.0, 10.0), (60.0, 20.0, 20.0)
    data = [(m, k, w, *(good if (m, k) not in {("m2", "x")} else bad), s) for m in ("m1", "m2") for k, s in (("x", 10.0), ("y", 12.0), ("incumbent", 5.0)) for w in ("B", "V")]
    t = M.rule_table(spark.createDataFrame(data, c))
    assert {x.choice for x in M.apply_rule(t, 2).collect()} == {"y"}
    assert {x.model: x.choice for x in M.apply_rule(t, 2, False).collect()} == {"m1": "incumbent", "m2": "incumbent"}
    inf = spark.createDataFrame([("m1", "x", w, 80.0, 10.0, 10.0, float("inf")) for w in ("B", "V")], c)
    assert M.apply_rule(M.rule_table(inf), 1).first().choice == "keep current entry"
    one = spark.createDataFrame([("m1", "x", "B", 80.0, 10.0, 10.0, 1.0)], c)
    assert not M.rule_table(one).first().qualifies


def store(spark, n=4, months=30):
    rows = [(f"S{i}", dt.datetime(2022 + m // 12, m % 12 + 1, 1), float(1000 * (i + 1) + 50 * (m % 12)), 60.0 + m) for i in range(n) for m in range(months)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double, temp_f double")


def statuses(report):
    return {r["check"]: r["status"] for r in report.collect()}


def naive(h, n, k):
    from panelsmith.operators.forecast import naive_ahead_full

    return naive_ahead_full(h, n, k)


def test_gate_passes_then_fails_by_name(spark):
    tracked = store(spark).cache()
    spec = {"as_of": "2023-12-31", "horizon": 6, "expected_wape": 0.0, "forecaster": naive}
    run = lambda cand, closed="2024-06-30": statuses(G.run_gate(cand, tracked, tracked.select("ts"), 4, closed, spec))
    ok = run(tracked)
    assert set(ok.values()) == {"pass"} and ok["backtest"] == "pass"
    assert run(tracked.withColumn("temp_f", F.col("temp_f") * (1 + 1e-12)))["covariates_within_rtol"] == "pass"
    assert run(tracked.withColumn("temp_f", F.when(F.col("series") != "S1", F.col("temp_f"))))["covariates_within_rtol"] == "fail"
    changed = run(tracked.withColumn("y", F.when((F.col("series") == "S1") & (F.month("ts") == 3), F.col("y") + 1).otherwise(F.col("y"))))
    assert changed["target_exact"] == "fail" and changed["backtest"] == "skipped"
    missing = run(tracked.where("not (series = 'S2' and ts = timestamp_ntz'2022-05-01')"))
    assert missing["tracked_keys_present"] == "fail" and missing["station_set"] == "fail"
    assert run(tracked.unionByName(tracked.limit(1)))["unique_keys"] == "fail"
    assert run(tracked.drop("temp_f"))["tracked_columns"] == "fail"
    assert run(tracked, "2024-03-31")["no_future_month"] == "fail" and run(tracked, None)["no_future_month"] == "fail"
    assert statuses(G.run_gate(tracked.drop("series"), tracked, tracked.select("ts"), 4, None))["input_frames"] == "fail"
    gone = statuses(G.run_gate(tracked.where("ts < timestamp_ntz'2024-06-01'"), tracked, tracked.select("ts"), 4, "2024-06-30"))
    assert gone["served_months_retained"] == "fail"


def test_strict_quality_raises(spark):
    df = store(spark)
    Q.raise_on_error(Q.run_checks(df, step="month"))
    with pytest.raises(ValueError, match="duplicate_rows"):
        Q.raise_on_error(Q.run_checks(df.unionByName(df.limit(1)), step="month"))
    with pytest.raises(ValueError, match="target_negative"):
        Q.raise_on_error(Q.run_checks(df.withColumn("y", F.when(F.col("series") == "S1", -F.col("y")).otherwise(F.col("y"))), step="month"))


def test_empty_windows_count_as_zero(spark):
    df = store(spark, 2, 6).where("month(ts) <> 3")
    w = {x.window.month: x.n_series for x in Q.window_coverage(df, "month").collect()}
    assert w == {1: 2, 2: 2, 3: 0, 4: 2, 5: 2, 6: 2}


def test_event_scores_count_missing_as_bad(spark):
    make = lambda xs: spark.createDataFrame([(g, s) for g, s in xs], "is_game_day boolean, event_proximity_score double")
    assert Q.event_scores(make([(True, None), (True, 0.0), (True, 0.5)])).first().severity == "WARNING"
    assert Q.event_scores(make([(True, 0.4), (True, 0.0), (None, None), (True, 0.5)])).first().severity == "INFO"
    assert Q.event_scores(make([(False, 0.4)])).count() == 0


def test_series_revision(spark):
    c = "month string, value string, position int, revised_from string"
    old = spark.createDataFrame([("2024-01", "5"), ("2024-02", "6")], "month string, value string")
    problems = lambda rows: {x.problem for x in G.series_revision(spark.createDataFrame(rows, c), old, "2024-05").collect()}
    assert problems([("2024-01", "5", 1, None), ("2024-02", "6", 2, None), ("2024-03", "7", 3, None)]) == set()
    assert problems([("2024-01", "5", 1, None), ("2024-02", "9", 2, "6")]) == set()
    assert problems([("2024-01", "5", 1, None), ("2024-02", "9", 2, None)]) == {"committed value changed without a revision"}
    assert problems([("2024-02", "6", 1, None), ("2024-01", "5", 2, None), ("2024-13", "x", 3, None)]) >= {"months not strictly increasing", "month is not YYYY-MM", "value is not a number"}
    assert problems([("2024-01", "5", 1, None), ("2024-07", "1", 2, None)]) == {"committed month missing", "month after the last closed month"}


def test_failed_cells_stay_in_the_table(spark):
    panel = store(spark, 3, 30)
    frame = B.backtest_frame(panel, [{"name": "w", "as_of": "2023-12-31"}], {"naive": naive}, 6)
    blocked = spark.createDataFrame([("early", "insufficient history")], "window string, status string")
    cells = {(x.window, x.model): x for x in B.score_cells(frame, ["naive", "absent"], ["w", "early"], blocked).collect()}
    assert cells[("w", "naive")].status == "ok" and cells[("w", "naive")].wape == 0.0
    assert cells[("w", "absent")].status.startswith("failed") and cells[("w", "absent")].wape is None
    assert cells[("early", "naive")].status == "insufficient history" and cells[("early", "naive")].n == 0
