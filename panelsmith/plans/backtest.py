"""Backtests: models x windows, experiment arms, calibration candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import NTZ, month_start
from ..operators import calibration as K
from ..operators import forecast as FC
from ..operators import metrics as M
from ..operators.joins import union_all

Forecaster = Callable[[DataFrame, int, list[str]], DataFrame]


def leaderboard(panel: DataFrame, train_end: str, test_end: str, models: dict[str, Forecaster], horizon: int, flags: dict | None = None) -> DataFrame:
    """Train, forecast, left-join to actuals, score every slice and rank the accepted models."""
    merged = backtest_frame(panel, [{"name": "test", "as_of": train_end, "end": test_end}], models, horizon)
    rows = M.model_rows(merged, ["model"], flags)
    return M.rank_leaderboard(M.accepted(rows, ["model"]))


def backtest_frame(panel: DataFrame, windows: list[dict], models: dict[str, Forecaster], horizon: int) -> DataFrame:
    """(model, window, series, ts, y, p10, p50, p90): every actual of every window for every model.

    Windows become origins, so each model forecasts all of them in one job.
    """
    names = [w["name"] for w in windows]
    origins = [w["as_of"] for w in windows]
    frames = []
    for label, make in models.items():
        pool = FC.rolling_pool(panel, origins, horizon, None, make)
        frames.append(pool.withColumn("model", F.lit(label)))
    lookup = F.coalesce(*[F.when(F.col("origin") == F.lit(o).cast(NTZ), F.lit(n)) for n, o in zip(names, origins)])
    return union_all(frames).withColumn("window", lookup)


def score_cells(frame: DataFrame, models: list[str], windows: list[str], admitted: DataFrame | None = None) -> DataFrame:
    """One row per (window, model), failed and inadmissible cells included with a status.

    ``admitted``: (window, status) for windows that may not be scored.
    """
    cells = frame.groupBy("window", "model").agg(
        F.round(M.score_columns()["wape"], 2).alias("wape"), F.round(M.score_columns()["mae"], 2).alias("mae"),
        M.score_columns()["n"].alias("n"), M.score_columns()["n_expected"].alias("n_expected"), F.round(M.score_columns()["coverage"], 2).alias("coverage"),
    )
    spark = frame.sparkSession
    grid = spark.createDataFrame([(w, m) for w in windows for m in models], "window string, model string")
    out = grid.join(cells, ["window", "model"], "left")
    status = F.when(F.col("n_expected").isNull(), "failed: no overlapping rows").when(M.rejection().isNotNull(), F.concat(F.lit("rejected: "), M.rejection())).otherwise("ok")
    if admitted is not None:
        out = out.join(admitted.select("window", F.col("status").alias("_why")), "window", "left")
        blocked = F.col("_why").isNotNull()
        for c in ("wape", "mae", "coverage"):
            out = out.withColumn(c, F.when(~blocked, F.col(c)))
        out = out.withColumn("n", F.when(blocked, 0).otherwise(F.col("n")))
        status = F.coalesce("_why", status)
    return out.select("window", "model", "wape", "mae", F.coalesce("n", F.lit(0)).alias("n"), "coverage", status.alias("status"))


def series_wape(frame: DataFrame) -> DataFrame:
    return frame.groupBy("window", "model", "series").agg(F.round(M.score_columns()["wape"], 4).alias("wape"))


def beats(per_series: DataFrame, reference: str, other: str) -> DataFrame:
    """(window, n_series, n_beats): series both models scored, and where the reference is lower."""
    a = per_series.where(F.col("model") == reference).select("window", "series", F.col("wape").alias("_a"))
    b = per_series.where(F.col("model") == other).select("window", "series", F.col("wape").alias("_b"))
    j = a.join(b, ["window", "series"]).where("_a is not null and _b is not null")
    return j.groupBy("window").agg(F.count(F.lit(1)).alias("n_series"), F.count_if(F.col("_a") < F.col("_b")).alias("n_beats"))


def backtest_check(cells: DataFrame, published: DataFrame, expected_models: list[str], published_window: str) -> DataFrame:
    """(window, reason): model sets, equal n, and the published window equal to the leaderboard."""
    want = F.array_sort(F.array(*[F.lit(m) for m in expected_models]))
    g = cells.groupBy("window").agg(F.array_sort(F.collect_set("model")).alias("_m"), F.count_distinct("n").alias("_n"))
    diff = cells.where(F.col("window") == published_window).join(published.select("model", F.col("wape").alias("_pw"), F.col("mae").alias("_pm")), "model", "full_outer")
    bad = diff.agg(F.count_if(~(F.round("wape", 2).eqNullSafe(F.round("_pw", 2)) & F.round("mae", 2).eqNullSafe(F.round("_pm", 2)))).alias("_d"))
    j = g.join(F.broadcast(bad), F.lit(True))
    return j.select("window", F.concat_ws("; ",
        F.when(F.col("_m") != want, "models differ from the leaderboard"),
        F.when(F.col("_n") != 1, "row counts differ"),
        F.when((F.col("window") == published_window) & (F.col("_d") > 0), "published window differs from the leaderboard"),
    ).alias("reason"))


def best_on_window(cells: DataFrame, frame: DataFrame, window: str, horizon: int) -> DataFrame:
    """Lowest-WAPE usable model of a window and whether its forecast can be published."""
    here = cells.where((F.col("window") == window) & (F.col("status") == "ok"))
    best = here.agg(F.min_by("model", F.struct("wape", "model")).alias("model"), F.min("wape").alias("wape"))
    from ..operators.joins import finite_bands

    _, ordered = finite_bands(frame)
    rows = frame.where(F.col("window") == window).join(F.broadcast(best.select("model")), "model", "left_semi")
    chk = rows.groupBy("model").agg(
        F.count_distinct(month_start("ts")).alias("n_months"), F.count_if(~ordered).alias("n_bad_bands"), F.round(M.score_columns()["wape"], 2).alias("_again"),
    )
    ok = (F.col("n_months") == horizon) & (F.col("n_bad_bands") == 0) & (F.col("_again") == F.col("wape"))
    return best.join(chk, "model", "left").select("model", "wape", "n_months", "n_bad_bands", F.coalesce(ok, F.lit(False)).alias("publishable"))


def experiment_table(frame: DataFrame, control: str, arms: list[str], test_window: str, val_window: str, alpha: float = 0.05) -> DataFrame:
    """Arms against a control: scores on both windows, paired test, verdict; rejected arms keep their reason."""
    cells = frame.groupBy("model", "window").agg(
        F.round(M.score_columns()["wape"], 4).alias("wape"), M.score_columns()["n"].alias("n"), M.score_columns()["n_expected"].alias("n_expected")
    ).withColumn("reason", M.rejection()).withColumn("wape", F.when(F.col("reason").isNull(), F.col("wape")))
    at = lambda w, c: F.max(F.when(F.col("window") == w, F.col(c)))
    wide = cells.groupBy("model").agg(at(test_window, "wape").alias("test_wape_arm"), at(val_window, "wape").alias("val_wape_arm"), at(test_window, "reason").alias("reason"))
    ctl = wide.where(F.col("model") == control).select(F.col("test_wape_arm").alias("test_wape_control"), F.col("val_wape_arm").alias("val_wape_control"))
    here = frame.where(F.col("window") == test_window)
    actual = here.where(F.col("model") == control).select("series", "ts", "y")
    ctl_fc = here.where(F.col("model") == control).select("series", "ts", "p50")
    arm_rows = here.where(F.col("model").isin(arms)).select("model", "series", "ts", "p50")
    # Every arm meets the same control rows, so the control is listed once per arm name.
    names = F.explode(F.array(*[F.lit(a) for a in arms])).alias("model")
    test = M.clustered_t(actual.select("*", names), ctl_fc.select("*", names), arm_rows, by=["model"])
    out = wide.where(F.col("model").isin(arms)).join(F.broadcast(ctl), F.lit(True), "left").join(test, "model", "left")
    decision = M.verdict(alpha=alpha)
    return out.withColumn("verdict", M.experiment_verdict(decision))


# ---- calibration runs -----------------------------------------------------------------------------


def calibrate(test: DataFrame, pool: DataFrame, spec: K.Spec, scheme: str, as_of: str, shift: dict | None = None) -> DataFrame:
    """Fit by the configured scheme, apply, label; a failed calibration leaves NULL bands."""
    if scheme == "none":
        return K.own_band(test).withColumn("interval_method", F.lit("own band"))
    if scheme == "shift":
        cal = K.fit_shift(pool, as_of, spec.group, spec.level, half_life=spec.half_life, name=spec.name, **(shift or {}))
        applied = K.apply(test, cal, [K.Spec(spec.name, "asym_relative", spec.group, spec.level)])
    else:
        rows = K.resolved_pool(pool, as_of) if scheme == "rolling" else pool
        cal = K.fit(rows, [spec])
        applied = K.apply(test, cal, [spec])
    return K.labelled(applied, cal, f"{scheme} {spec.method}/{spec.group}")


def candidate_specs(half_life: float = 6.0) -> list[K.Spec]:
    """Every score x group, with decaying and with equal weights."""
    out = []
    for method in K.METHODS:
        for group in ("pooled", "horizon"):
            out.append(K.Spec(f"rolling_hl6 {method}/{group}", method, group, 0.8, half_life))
            out.append(K.Spec(f"rolling_eq {method}/{group}", method, group, 0.8, None))
    return out


def calibration_candidates(pool: DataFrame, scored: DataFrame, windows: dict[str, str], specs: list[K.Spec]) -> DataFrame:
    """(window, candidate, interval scores): all candidates on all windows in one job.

    ``pool`` and ``scored`` carry every window's rows with a ``window`` column;
    ``windows`` maps a window to its as-of date.
    """
    as_of = F.coalesce(*[F.when(F.col("window") == w, F.lit(d).cast(NTZ)) for w, d in windows.items()])
    p = pool.withColumn("_at", as_of)
    resolved = p.where((F.col("origin") < F.col("_at")) & (F.col("ts") <= F.col("_at"))).withColumn("age", K.months_between("ts", "_at"))
    cal = K.fit(resolved, specs, by=["window"])
    out = K.apply(scored, cal, specs, by=["window"]).unionByName(K.own_band(scored, "incumbent"))
    return M.interval_scores(out, ["window", "candidate"])
