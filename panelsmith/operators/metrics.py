"""Forecast scores.  A NULL actual drops the row; a NULL forecast makes the metric NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import col
from ..functions.scalars import INF, at_least, known
from ..functions.stats import t_p_value

ALPHA = 0.2


def score_columns(y: str = "y", p50: str = "p50", p10: str = "p10", p90: str = "p90", clip_bands: bool = False) -> dict[str, Column]:
    """Named aggregate expressions; use them in any ``groupBy().agg``."""
    a, f = F.col(y), at_least(p50, 0.0)
    lo, hi = (at_least(p10, 0.0), at_least(p90, 0.0)) if clip_bands else (F.col(p10), F.col(p90))
    have = a.isNotNull()
    err = F.when(have, F.abs(f - a))

    def scored(value: Column, *inputs: Column) -> Column:
        skipped = F.lit(0)
        for x in inputs:
            skipped = skipped + F.count_if(have & x.isNull())
        return F.when((skipped == 0) & (F.count_if(have) > 0), value)

    denom = F.sum(F.abs(a))
    width = hi - lo
    return {
        "n": F.count_if(have & f.isNotNull()),
        "n_expected": F.count_if(have),
        "mae": scored(F.avg(err), f),
        "rmse": scored(F.sqrt(F.avg(err * err)), f),
        "mape": scored(F.avg(err / F.greatest(F.abs(a), F.lit(1.0))) * 100, f),
        "wape": scored(F.when(denom >= 1.0, F.sum(err) / denom * 100), f),
        "smape": scored(F.avg(err / ((F.abs(a) + F.abs(f)) / 2 + 1.0)) * 100, f),
        "coverage": scored(F.avg(F.when(have, ((a >= lo) & (a <= hi)).cast("double"))) * 100, lo, hi),
        "width": F.when(F.count_if(width.isNull()) == 0, F.avg(width)),
    }


def score(df: DataFrame, by: list[str] | None = None, only: list[str] | None = None, decimals: int = 4, **names) -> DataFrame:
    cols = score_columns(**names)
    keep = only or list(cols)
    aggs = [cols[k].alias(k) if k in ("n", "n_expected") else F.round(cols[k], decimals).alias(k) for k in keep]
    return df.groupBy(*(by or [])).agg(*aggs)


def actuals_left(actuals: DataFrame, forecasts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every actual kept, with ``forecast_present``, so a skipped forecast stays visible."""
    keys = keys or ["series", "ts"]
    return actuals.join(forecasts.withColumn("forecast_present", F.lit(True)), keys, "left").withColumn(
        "forecast_present", known("forecast_present")
    )


def drop_unless_overlap(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """No overlap between actuals and forecasts at all (per ``by``) leaves no rows."""
    by = by or []
    hit = df.where("forecast_present").select(*by).distinct() if by else df.where("forecast_present").limit(1).select(F.lit(1).alias("_hit"))
    return df.join(hit, by, "left_semi") if by else df.join(hit, F.lit(True), "left_semi")


def slice_rows(df: DataFrame, keys: dict[str, Column | str] | None = None, flags: dict[str, Column | str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows listed once per slice they belong to: overall, each key value, each TRUE flag.

    One explode and one aggregation score every slice; partial aggregation keeps
    the shuffle at (slices x tasks) rows.
    """
    entries = [F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("slice_value"))]
    for name, c in (keys or {}).items():
        entries.append(F.when(col(c).isNotNull(), F.struct(F.lit(name).alias("slice"), col(c).cast("string").alias("slice_value"))))
    for name, c in (flags or {}).items():
        entries.append(F.when(known(col(c)), F.struct(F.lit(name).alias("slice"), F.lit("all").alias("slice_value"))))
    listed = df.withColumn("_s", F.explode(F.array_compact(F.array(*entries))))
    return listed.withColumns({"slice": F.col("_s.slice"), "slice_value": F.col("_s.slice_value")}).drop("_s")


def evaluation_slices(columns: list[str], ts: str = "ts") -> tuple[dict, dict]:
    """Standard slices for the columns present: hour, weekday, mode; event, weather and holiday flags."""
    keys: dict = {"hour": F.hour(ts), "weekday": F.weekday(ts)}
    if "transit_mode" in columns:
        keys["transit_mode"] = "transit_mode"
    flags: dict = {}
    if "is_game_day" in columns:
        flags |= {"game_day": "is_game_day", "normal_day": ~F.col("is_game_day")}
    if "is_raining" in columns:
        flags |= {"rainy": "is_raining", "clear": ~F.col("is_raining")}
    if "precip_intensity" in columns:
        flags["heavy_rain"] = F.col("precip_intensity") >= 3
    for name, c in {"sharks_game": "is_sharks_game_window", "holiday": "is_holiday"}.items():
        if c in columns:
            flags[name] = c
    return keys, flags


# Leaderboard slice names and their flag columns.
LEADERBOARD_SLICES = {
    "game_day": "is_game_day", "sharks_game": "is_sharks_game_window", "rainy_day": "is_raining",
    "am_peak": "is_am_peak", "pm_peak": "is_pm_peak", "holiday": "is_holiday", "event_catchment": "in_event_catchment",
}


def model_rows(merged: DataFrame, by: list[str], flags: dict | None = None, mase_scale: DataFrame | None = None, method: str | None = None,
               y: str = "y", series: str = "series") -> DataFrame:
    """Leaderboard rows per (model, slice): metrics, n, n_expected, number of missing series."""
    flags = {k: c for k, c in LEADERBOARD_SLICES.items() if c in merged.columns} if flags is None else flags
    cols = score_columns(y=y)
    missed = F.when(F.col(y).isNotNull() & F.col("p50").isNull(), F.col(series))
    aggs = [cols["n"].alias("n"), cols["n_expected"].alias("n_expected"), F.count_distinct(missed).alias("n_missing_series"), cols["mae"].alias("_mae")]
    aggs += [F.round(cols[k], 2).alias(k) for k in ("wape", "mae", "rmse", "mape", "smape", "coverage")]
    if "p10_raw" in merged.columns:
        aggs.append(F.round(score_columns(y=y, p10="p10_raw", p90="p90_raw")["coverage"], 2).alias("coverage_raw"))
    out = slice_rows(merged, flags=flags).groupBy(*by, "slice").agg(*aggs)
    if mase_scale is not None:
        # The scale is one row for the whole panel, so its broadcast has a fixed size.
        out = out.join(F.broadcast(mase_scale.select("mase_scale").limit(1)), F.lit(True), "left")
        out = out.withColumn("mase", F.round(F.col("_mae") / F.col("mase_scale"), 4)).drop("mase_scale")
    if method is not None:
        out = out.withColumn("interval_method", F.lit(method))
    return out.drop("_mae")


def missing_series(merged: DataFrame, by: list[str], y: str = "y", series: str = "series") -> DataFrame:
    """The series behind ``n_missing_series``, as rows: (by, series, rows missed)."""
    return merged.where(F.col(y).isNotNull() & F.col("p50").isNull()).groupBy(*by, series).agg(F.count(F.lit(1)).alias("n_missed"))


def rejection(n="n", n_expected="n_expected", wape="wape", ceiling: float = 100.0) -> Column:
    """Why a model may not be ranked, or NULL."""
    return (
        F.when(col(n) < col(n_expected), "forecast missing rows")
        .when(col(wape).isNull(), "no valid score")
        .when(col(wape) > ceiling, "WAPE above ceiling")
    )


def accepted(rows: DataFrame, by: list[str], ceiling: float = 100.0) -> DataFrame:
    """Rows of models whose overall row is complete and plausible."""
    ok = rows.where((F.col("slice") == "overall") & rejection(ceiling=ceiling).isNull()).select(*by).distinct()
    return rows.join(ok, by, "left_semi")


def rank_leaderboard(rows: DataFrame, by: list[str] | None = None, model: str = "model") -> DataFrame:
    """Overall rows ranked by WAPE from 1, ties by model name."""
    w = Window.partitionBy(*(by or [])).orderBy("wape", model)
    return rows.where(F.col("slice") == "overall").withColumn("rank", F.row_number().over(w))


# ---- interval scores -------------------------------------------------------------------------


def interval_score_columns(y: str = "y") -> dict[str, Column]:
    a, lo, mid, hi = F.col(y), F.col("p10"), F.col("p50"), F.col("p90")
    below, above = a < lo, a > hi
    have = a.isNotNull()
    ok = (F.count_if(have & (lo.isNull() | hi.isNull())) == 0) & (F.count_if(have) > 0)
    miss = F.when(below, lo - a).when(above, a - hi).otherwise(0.0)
    return {
        "n": F.count(F.lit(1)),
        "coverage": F.when(ok, F.avg(F.when(have, (~(below | above)).cast("double"))) * 100),
        "below_p10": F.when(ok, F.avg(F.coalesce(below, F.lit(False)).cast("double")) * 100),
        "above_p90": F.when(ok, F.avg(F.coalesce(above, F.lit(False)).cast("double")) * 100),
        "width_of_p50": F.when(ok, F.avg((hi - lo) / F.nullif(mid, F.lit(0.0))) * 100),
        "interval_score": F.when(ok, F.sum((hi - lo) + miss * (2 / ALPHA)) / F.sum(a) * 100),
    }


def interval_scores(df: DataFrame, by: list[str], y: str = "y", ts: str = "ts", months: bool = True) -> DataFrame:
    """Coverage, tails, relative width, interval score and the coverage of each month as text."""
    agg = df.groupBy(*by).agg(*[c.alias(n) if n == "n" else F.round(c, 2).alias(n) for n, c in interval_score_columns(y).items()])
    if not months:
        return agg
    inside = ((F.col(y) >= F.col("p10")) & (F.col(y) <= F.col("p90"))).cast("double")
    monthly = df.groupBy(*by, ts).agg((F.avg(F.coalesce(inside, F.lit(0.0))) * 100).alias("_c"))
    text = monthly.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(ts, "_c"))).alias("_l")).select(
        *by, F.array_join(F.transform("_l", lambda s: F.format_string("%.0f", s["_c"])), " ").alias("_text")
    )
    joined = agg.join(text, by, "left") if by else agg.join(text, F.lit(True), "left")
    return joined.withColumn("coverage_by_month", F.when(F.col("coverage").isNotNull(), F.col("_text"))).drop("_text")


# ---- paired tests -----------------------------------------------------------------------------


def t_statistics(df: DataFrame, d: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean_d, t): one-sample t against zero."""
    sd = F.stddev_samp(d)
    return df.groupBy(*(by or [])).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_d"),
        F.when(sd > 0, F.avg(d) / (sd / F.sqrt(F.count(d)))).alias("t"),
    )


def loss_difference(y: str = "y", a: str = "p50_a", b: str = "p50_b") -> Column:
    """|y - a| - |y - b| with forecasts floored at zero: positive when b is better."""
    return F.abs(F.col(y) - at_least(a, 0.0)) - F.abs(F.col(y) - at_least(b, 0.0))


def diebold_mariano(actuals: DataFrame, fa: DataFrame, fb: DataFrame, model_a: str, model_b: str, keys: list[str] | None = None, y: str = "y") -> DataFrame:
    """Mean loss difference over rows both models forecast; b wins only if better with p < 0.05."""
    keys = keys or ["series", "ts"]
    both = fa.select(*keys, F.col("p50").alias("p50_a")).join(fb.select(*keys, F.col("p50").alias("p50_b")), keys)
    m = both.join(actuals.select(*keys, y), keys).where(F.col(y).isNotNull() & F.col("p50_a").isNotNull() & F.col("p50_b").isNotNull())
    s = t_statistics(m.withColumn("_d", loss_difference(y)), "_d").where("n >= 2").withColumn("p_value", t_p_value("t", (F.col("n") - 1).cast("double")))
    better = F.coalesce((F.col("mean_d") > 0) & (F.col("p_value") < 0.05), F.lit(False))
    return s.select(
        F.lit(model_a).alias("model_a"), F.lit(model_b).alias("model_b"), "n",
        F.round("mean_d", 4).alias("mean_d"), F.round("t", 4).alias("t_stat"), F.round("p_value", 4).alias("p_value"),
        F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"), F.when(better, model_b).otherwise(model_a).alias("winner"),
    )


def pairing_report(actuals: DataFrame, control: DataFrame, arm: DataFrame, keys: list[str] | None = None, series: str = "series", y: str = "y") -> DataFrame:
    """One row of pairing violations over actuals, control and arm forecasts."""
    keys = keys or ["series", "ts"]
    side = lambda d, v, tag: d.groupBy(*keys).agg(F.first(v).alias(f"v_{tag}"), F.count(F.lit(1)).alias(f"n_{tag}"))
    m = (
        side(actuals, y, "y").join(side(control, "p50", "c"), keys, "full_outer").join(side(arm, "p50", "a"), keys, "full_outer")
    )
    bad = lambda c: F.count_if(c)
    per = m.groupBy(series).agg(
        F.count(F.lit(1)).alias("_months"),
        bad(F.col("n_c").isNull()).alias("_noc"), bad(F.col("n_a").isNull()).alias("_noa"), bad(F.col("n_y").isNull()).alias("_noy"),
        bad((F.col("n_y") > 1) | (F.col("n_c") > 1) | (F.col("n_a") > 1)).alias("_dup"),
        bad(~(_finite("v_y") & _finite("v_c") & _finite("v_a"))).alias("_null"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.sum("_noc").alias("without_control"), F.sum("_noa").alias("without_arm"), F.sum("_noy").alias("without_actual"),
        F.sum("_dup").alias("duplicate_keys"), F.sum("_null").alias("non_finite"),
        (F.count_distinct("_months") != 1).alias("unequal_counts"), (F.count(F.lit(1)) < 2).alias("too_few_series"),
    )


def _finite(c: str) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != INF), F.lit(False))


def clustered_t(actuals: DataFrame, control: DataFrame, arm: DataFrame, by: list[str] | None = None, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """t-test across series of the mean loss difference per series."""
    by = by or []
    keys = [*by, series, ts]
    m = actuals.join(control.select(*keys, F.col("p50").alias("p50_a")), keys).join(arm.select(*keys, F.col("p50").alias("p50_b")), keys)
    per = m.withColumn("_d", loss_difference(y)).groupBy(*by, series).agg(F.avg("_d").alias("d"))
    sd = F.stddev_samp("d")
    return per.groupBy(*by).agg(
        F.count("d").alias("n_series"), F.avg("d").alias("mean_d"),
        F.when(sd > 0, F.avg("d") / (sd / F.sqrt(F.count("d")))).alias("t"),
        F.count_if(F.col("d") > 0).alias("arm_better"), F.count_if(F.col("d") < 0).alias("control_better"),
    ).withColumn("p", t_p_value("t", (F.col("n_series") - 1).cast("double")))


def verdict(test_arm="test_wape_arm", test_control="test_wape_control", p="p", mean_d="mean_d", val_arm="val_wape_arm", val_control="val_wape_control", alpha: float = 0.05) -> Column:
    """Improves only if the test score, the paired test and the validation score all say so."""
    ok = (col(test_arm) < col(test_control)) & (col(p) < alpha) & (col(mean_d) > 0) & (col(val_arm) < col(val_control))
    return F.when(F.coalesce(ok, F.lit(False)), "improves").otherwise("no improvement shown")


def experiment_verdict(decision: Column, test_arm="test_wape_arm", val_arm="val_wape_arm", test_control="test_wape_control", val_control="val_wape_control") -> Column:
    unscored = col(test_arm).isNull() | col(val_arm).isNull() | col(test_control).isNull() | col(val_control).isNull()
    return F.when(unscored, "not scored").otherwise(decision)


# ---- selection rule -----------------------------------------------------------------------------


def rule_table(candidates: DataFrame, windows: tuple[str, str] = ("B", "V"), low: float = 75.0, high: float = 85.0, max_tail: float = 15.0) -> DataFrame:
    """Both windows side by side per (model, candidate) and whether the candidate qualifies."""
    finite = F.coalesce(~F.isnan("interval_score") & (F.abs(F.col("interval_score")) != INF), F.lit(False))
    passes = F.coalesce(F.col("coverage").between(low, high) & (F.col("below_p10") <= max_tail) & (F.col("above_p90") <= max_tail), F.lit(False)) & finite
    aggs = []
    for w in windows:
        here = F.col("window") == w
        aggs += [F.max(F.when(here, F.col(c))).alias(f"{c}_{w}") for c in ("coverage", "below_p10", "above_p90", "interval_score")]
        aggs.append(F.max(F.when(here, passes)).alias(f"_ok_{w}"))
    t = candidates.groupBy("model", "candidate").agg(*aggs)
    both = F.coalesce(F.col(f"_ok_{windows[0]}"), F.lit(False)) & F.coalesce(F.col(f"_ok_{windows[1]}"), F.lit(False))
    mean = (F.col(f"interval_score_{windows[0]}") + F.col(f"interval_score_{windows[1]}")) / 2
    return t.withColumns({"qualifies": both, "mean_score": mean}).drop(*[f"_ok_{w}" for w in windows])


def apply_rule(table: DataFrame, n_models: int, shared_first: bool = True) -> DataFrame:
    """(model, choice, basis): a shared qualifier for all models if any, else each model's best."""
    q = table.where("qualifies")
    key = F.struct("mean_score", "candidate")
    own = q.groupBy("model").agg(F.min_by("candidate", key).alias("_own"))
    out = table.select("model").distinct().join(own, "model", "left")
    if shared_first:
        shared = q.where("candidate <> 'incumbent'").groupBy("candidate").agg(F.count_distinct("model").alias("_m"), F.avg("mean_score").alias("mean_score"))
        best = shared.where(F.col("_m") == n_models).agg(F.min_by("candidate", key).alias("_shared"))
        out = out.join(F.broadcast(best), F.lit(True), "left")
    else:
        out = out.withColumn("_shared", F.lit(None).cast("string"))
    return out.select(
        "model", F.coalesce("_shared", "_own", F.lit("keep current entry")).alias("choice"),
        F.when(F.col("_shared").isNotNull(), "one method qualifies for every model")
        .when(F.col("_own").isNotNull(), "lowest-scoring qualifier for this model").otherwise("no eligible candidate qualifies").alias("basis"),
    )


def cut_check(cut: DataFrame, full: DataFrame, as_of, horizon: int, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Cut forecasts must equal uncut ones wherever both exist and exist up to ``as_of``."""
    keys = keys or ["series", ts, "origin"]
    bands = ["p10", "p50", "p90"]
    both = cut.select(*keys, *[F.col(c).alias(f"{c}_cut") for c in bands]).join(full.select(*keys, *[F.col(c).alias(f"{c}_full") for c in bands]), keys)
    fin = lambda tag: _finite(f"p10_{tag}") & _finite(f"p50_{tag}") & _finite(f"p90_{tag}")
    diff = F.greatest(*[F.abs(F.col(f"{c}_cut") - F.col(f"{c}_full")) for c in bands])
    resolved = F.col(ts) <= col(as_of)
    distinct = F.add_months(F.col("origin").cast("date"), horizon).cast("timestamp_ntz") > col(as_of)
    pairs = fin("cut") & fin("full")
    return both.agg(
        F.max(F.when(pairs, diff)).alias("max_abs_diff"),
        F.count_if(resolved & ~pairs).alias("missing_resolved"),
        F.count_if(fin("cut") & ~fin("full")).alias("cut_only"),
        F.count_distinct(F.when(distinct, F.col("origin"))).alias("origins_cut"),
        F.count_if(pairs & distinct).alias("rows_compared"),
        F.count_if(pairs & distinct & resolved).alias("rows_compared_resolved"),
    ).withColumn("passed", F.coalesce((F.col("missing_resolved") == 0) & (F.col("cut_only") == 0) & (F.col("max_abs_diff") == 0), F.lit(False)))


def leaderboard_check(recomputed: DataFrame, published: DataFrame, keys: list[str], columns: tuple[str, ...] = ("wape", "mae", "coverage")) -> DataFrame:
    """Published rows against recomputed ones at two decimals, with the reason for a refusal."""
    r = recomputed.select(*keys, *[F.round(c, 2).alias(f"{c}_new") for c in columns]).withColumn("_have", F.lit(True))
    j = published.join(r, keys, "left")
    reasons = [F.when(F.col("_have").isNull(), F.lit("not recomputed"))]
    for c in columns:
        same = F.round(F.col(c), 2).eqNullSafe(F.col(f"{c}_new"))
        reasons.append(F.when(F.col("_have").isNotNull() & ~same, F.lit(f"{c} differs")))
    return j.select(*keys, F.concat_ws("; ", *reasons).alias("reason")).withColumn("accepted", F.col("reason") == "")


def simple_evaluation(df: DataFrame, by: list[str] | None = None, y: str = "y", p50: str = "p50") -> DataFrame:
    """MAE, RMSE, MAPE over non-zero actuals and WAPE on rows with both values; ``n`` counts all matched rows."""
    a, f = F.col(y), F.col(p50)
    err = F.abs(f - a)
    both = a.isNotNull() & f.isNotNull()
    total = F.sum(F.when(both, F.abs(a)))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(a != 0, err / F.abs(a))) * 100).alias("mape"), F.when(total > 0, F.sum(err) / total * 100).alias("wape"),
    )
