"""Forecasters and rolling origins.

A forecaster is ``(history, horizon) -> forecasts``: history has the key columns
plus ts and y, forecasts have the keys plus ts, p10, p50, p90.  Rolling origins
only add ``origin`` to the keys, so all origins run in one job.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import NTZ, as_times, col, month_list, month_start, months_between

Z90 = 1.2815515655446004
FORECAST_FIELDS = ["p10", "p50", "p90"]


def band(p50: Column) -> dict[str, Column]:
    """The naive forecast with its fixed +-20 % band, floored at zero."""
    mid = F.when(p50.isNotNull(), F.greatest(p50, F.lit(0.0)))
    return {"p10": mid * 0.80, "p50": mid, "p90": mid * 1.20}


def season_tail(train: DataFrame, keys: list[str], lag: int, ts: str = "ts", y: str = "y", short: str = "skip") -> DataFrame:
    """(keys, _idx, _value, _len): the last ``lag`` training values in order.

    Only the last rows of a key leave each task.  ``short='skip'`` drops keys
    with fewer rows; ``short='wrap'`` lets them repeat what they have.
    """
    last = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    tail = train.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= lag)
    sized = tail.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    if short == "skip":
        sized = sized.where(F.col("_len") == lag)
    return sized.select(*keys, (F.col("_len") - F.col("_rn")).alias("_idx"), F.col(y).alias("_value"), "_len")


def seasonal_naive(train: DataFrame, test: DataFrame, lag: int = 12, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """Repeat the last ``lag`` training values over each series' sorted test rows."""
    at = F.row_number().over(Window.partitionBy(series).orderBy(ts)) - 1
    rows = test.select(series, ts).withColumn("_idx", (at % lag).cast("long"))
    tail = season_tail(train, [series], lag, ts, y).withColumn("_idx", F.col("_idx").cast("long"))
    return rows.join(tail, [series, "_idx"]).select(series, ts, *[c.alias(n) for n, c in band(F.col("_value")).items()])


def season_steps(step_hours: float | None, season_hours: int = 168) -> int:
    """12 for calendar months, else the season in steps of the given length."""
    return 12 if step_hours is None else max(1, int(round(season_hours / step_hours)))


def future_index(history: DataFrame, horizon: int, keys: list[str], ts: str = "ts") -> DataFrame:
    """``horizon`` month starts after each key's last row: (keys, ts, horizon)."""
    last = history.groupBy(*keys).agg(F.max(ts).alias("_last"))
    first, final = (F.add_months(F.trunc(F.col("_last").cast("date"), "month"), k) for k in (1, horizon))
    return last.select(*keys, F.posexplode(F.sequence(first, final, F.expr("interval 1 month"))).alias("_i", "_d")).select(
        *keys, F.col("_d").cast(NTZ).alias(ts), (F.col("_i") + 1).alias("horizon")
    )


def naive_ahead(history: DataFrame, horizon: int, keys: list[str], period: int = 12, ts: str = "ts", y: str = "y") -> DataFrame:
    """Seasonal repeat from a context; a short context repeats whatever it has."""
    tail = season_tail(history, keys, period, ts, y, short="wrap").withColumn("_idx", F.col("_idx").cast("long"))
    size = tail.groupBy(*keys).agg(F.max("_len").alias("_len"))
    ahead = future_index(history, horizon, keys, ts).join(size, keys).withColumn(
        "_idx", ((F.col("horizon") - 1) % F.col("_len")).cast("long")
    )
    return ahead.drop("_len").join(tail.drop("_len"), [*keys, "_idx"]).select(
        *keys, ts, *[c.alias(n) for n, c in band(F.col("_value")).items()]
    )


# ---- user forecasters, one call per key -------------------------------------------------


def fan_out(
    history: DataFrame, keys: list[str], fit_predict: Callable[[pd.DataFrame], pd.DataFrame],
    min_rows: int = 1, ts: str = "ts", y: str = "y",
) -> DataFrame:
    """Run a per-key forecaster with failure isolation.

    ``fit_predict`` gets one key's rows sorted by ts and returns ts, p10, p50,
    p90.  A key that fails or is too short gives one row with its error instead
    of stopping the job.  Columns: keys, ts, p10, p50, p90, status, error.
    A group is one key's monthly history, bounded by the calendar.
    """
    types = {f.name: f.dataType.simpleString() for f in history.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {ts} timestamp_ntz, p10 double, p50 double, p90 double, status string, error string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in keys}
        try:
            if len(pdf) < min_rows:
                raise ValueError(f"{len(pdf)} rows of history, {min_rows} needed")
            out = fit_predict(pdf.sort_values(ts).reset_index(drop=True))[[ts, *FORECAST_FIELDS]].copy()
            out["status"], out["error"] = "ok", None
        except Exception as exc:  # noqa: BLE001 - the error becomes a row
            out = pd.DataFrame({ts: [pd.NaT], "p10": [np.nan], "p50": [np.nan], "p90": [np.nan],
                                "status": ["failed"], "error": [f"{type(exc).__name__}: {exc}"]})
        for k in reversed(keys):
            out.insert(0, k, head[k])
        out[ts] = pd.to_datetime(out[ts])
        return out

    raw = history.groupBy(*keys).applyInPandas(run, schema)
    return raw.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in FORECAST_FIELDS})


def airline(horizon: int, ts: str = "ts", y: str = "y", season: int = 12, grid: int = 19, min_obs: int = 24) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Seasonal (0,1,1)(0,1,1) by conditional sum of squares over a (theta, Theta) grid.

    w = (1-B)(1-B^s) y and e_t = w_t - a e_{t-1} - b e_{t-s} - ab e_{t-s-1}.  All
    grid points advance together as one NumPy vector.  Bands come from the
    psi-weights of the integrated model.  This is an approximation of the exact
    likelihood fit, not a replacement for it.
    """
    points = np.linspace(-0.9, 0.9, grid)
    theta, big = (g.ravel() for g in np.meshgrid(points, points, indexing="ij"))

    def fit_predict(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[y].to_numpy(dtype=float)
        if len(values) < min_obs or np.isnan(values).any():
            raise ValueError(f"{len(values)} complete months needed, at least {min_obs}")
        d = np.diff(values)
        w = d[season:] - d[:-season]
        lagged = np.zeros((season + 1, theta.size))
        css = np.zeros(theta.size)
        for x in w:
            e = x - theta * lagged[0] - big * lagged[season - 1] - theta * big * lagged[season]
            css += e * e
            lagged = np.roll(lagged, 1, axis=0)
            lagged[0] = e
        k = int(np.argmin(css))
        a, b, sigma = theta[k], big[k], math.sqrt(css[k] / max(len(w), 1))
        errors = list(lagged[::-1, k])  # oldest first, newest last
        path, psi = list(values), []
        for h in range(horizon):
            ma = a * errors[-1] + b * errors[-season] + a * b * errors[-season - 1]
            errors.append(0.0)
            path.append(ma + path[-1] + path[-season] - path[-season - 1])
            own = {0: 1.0, 1: a, season: b, season + 1: a * b}.get(h, 0.0)
            back = lambda j: psi[h - j] if h - j >= 0 else 0.0  # noqa: B023, E731
            psi.append(own + back(1) + back(season) - back(season + 1))
        mid = np.array(path[-horizon:])
        spread = Z90 * sigma * np.sqrt(np.cumsum(np.square(psi)))
        last = pd.Timestamp(pdf[ts].iloc[-1])
        return pd.DataFrame({
            ts: [last + pd.DateOffset(months=i + 1) for i in range(horizon)],
            "p10": np.maximum(mid - spread, 0), "p50": np.maximum(mid, 0), "p90": np.maximum(mid + spread, 0),
        })

    return fit_predict


# ---- rolling origins ----------------------------------------------------------------------


def month_end_origins(first: str, as_of: str) -> list[str]:
    """Month ends from ``first`` up to the month before ``as_of``: configuration, not data."""
    ends = pd.date_range(first, pd.Timestamp(as_of) - pd.offsets.MonthEnd(1), freq=pd.offsets.MonthEnd())
    return [f"{e:%Y-%m-%d}" for e in ends]


def history_by_origin(panel: DataFrame, origins: list[str], ts: str = "ts") -> DataFrame:
    """Each row once per origin it precedes (origins are a short configured list)."""
    listed = F.array(*[F.lit(o).cast("date") for o in origins])
    seen = F.filter(listed, lambda o: o >= F.col(ts).cast("date"))
    return panel.withColumn("origin", F.explode(as_times(seen)))


def rolling_pool(
    panel: DataFrame, origins: list[str], horizon: int, as_of: str | None,
    forecaster: Callable[[DataFrame, int, list[str]], DataFrame] | None = None,
    series: str = "series", ts: str = "ts", y: str = "y",
) -> DataFrame:
    """Forecasts from every origin left-joined to actuals, with origin and horizon.

    A row exists for every actual month in (origin, min(origin + horizon, as_of)];
    one the forecaster skipped has NULL bands.
    """
    keys = [series, "origin"]
    make = forecaster or (lambda h, n, k: naive_ahead_full(h, n, k, ts=ts, y=y))
    fc = make(history_by_origin(panel.select(series, ts, y), origins, ts), horizon, keys)
    listed = F.array(*[F.lit(o).cast("date") for o in origins])
    mine = F.filter(
        listed, lambda o: (o < F.col(ts).cast("date")) & (F.col(ts).cast("date") <= F.add_months(o, horizon))
    )
    actual = panel.select(series, ts, y)
    if as_of is not None:
        actual = actual.where(F.col(ts) <= F.lit(as_of).cast(NTZ))
    wanted = actual.withColumn("origin", F.explode(as_times(mine)))
    pool = wanted.join(fc.select(*keys, ts, *FORECAST_FIELDS), [*keys, ts], "left")
    return pool.withColumn("horizon", months_between("origin", ts))


def naive_ahead_full(history: DataFrame, horizon: int, keys: list[str], lag: int = 12, ts: str = "ts", y: str = "y") -> DataFrame:
    """Seasonal naive from the origin's month on; keys shorter than a season are skipped."""
    tail = season_tail(history, keys, lag, ts, y).withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    hit = tail.where((F.col("_h") - 1) % lag == F.col("_idx"))
    start = F.trunc(F.col("origin").cast("date"), "month")
    return hit.select(*keys, F.add_months(start, F.col("_h")).cast(NTZ).alias(ts), *[c.alias(n) for n, c in band(F.col("_value")).items()])


def empty_origins(pool: DataFrame, origins: list[str]) -> DataFrame:
    """Origins without a single forecast: an error for the caller to raise."""
    spark = pool.sparkSession
    want = spark.createDataFrame([(o,) for o in origins], "o string").select(F.col("o").cast(NTZ).alias("origin"))
    have = pool.where(F.col("p50").isNotNull()).select("origin").distinct()
    return want.join(have, "origin", "left_anti")


# ---- covariates -----------------------------------------------------------------------------


def standardise_exog(panel: DataFrame, cols: list[str], train_end, series: str = "series", ts: str = "ts") -> DataFrame:
    """Monthly covariates scaled per series by the training mean and population SD.

    ``exog_ok`` is FALSE for a series with a missing or constant training column.
    """
    monthly = panel.groupBy(series, month_start(ts).alias(ts)).agg(*[F.avg(c).alias(c) for c in cols])
    train = monthly.where(F.col(ts) <= col(train_end))
    stats = train.groupBy(series).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_sd") for c in cols],
        *[F.sum(F.col(c).isNull().cast("int")).alias(f"{c}_nulls") for c in cols],
    )
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce((F.col(f"{c}_nulls") == 0) & (F.col(f"{c}_sd") > 0), F.lit(False))
    scaled = monthly.join(stats.withColumn("exog_ok", ok), series)
    return scaled.select(
        series, ts, "exog_ok", *[F.when(F.col("exog_ok"), (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).alias(c) for c in cols]
    )


def future_exog(scaled: DataFrame, cols: list[str], last_train, horizon: int, series: str = "series", ts: str = "ts") -> DataFrame:
    """The next ``horizon`` months' covariates; ``missing`` marks a month without all values."""
    start = F.trunc(col(last_train).cast("date"), "month")
    months = month_list(F.add_months(start, 1), F.add_months(start, horizon))
    grid = scaled.select(series).distinct().select(series, F.explode(months).alias(ts))
    out = grid.join(scaled.select(series, ts, *cols), [series, ts], "left")
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    return out.withColumn("missing", missing)


def step_columns(df: DataFrame, changes: dict[str, str], ts: str = "ts") -> DataFrame:
    """0/1 columns from scheduled change dates (known in advance)."""
    return df.withColumns({n: (F.col(ts) >= F.lit(d).cast(NTZ)).cast("int") for n, d in changes.items()})


def asof_period(df: DataFrame, periods: list[str], ts: str = "ts", out: str = "method_period") -> DataFrame:
    """Latest configured period start at or before the row; earlier rows take the first."""
    ordered = sorted(periods)
    chain = F.lit(ordered[0])
    for p in ordered[1:]:
        chain = F.when(F.col(ts) >= F.lit(p).cast(NTZ), F.lit(p)).otherwise(chain)
    return df.withColumn(out, chain)


# ---- windows ---------------------------------------------------------------------------------


def window_admission(panel: DataFrame, windows: list[dict], train_start: str, excluded: list[str], changes: dict[str, str],
                     horizon: int, min_train: int, min_support: int, test_window: str, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """Verdict per (series, window): history long and gap-free, actuals complete, steps supported.

    ``windows``: dicts with name, start, end, cutoff (month starts).
    """
    for w in windows:
        start, end, cut = (pd.Timestamp(w[k]) for k in ("start", "end", "cutoff"))
        if cut != start - pd.DateOffset(months=1):
            raise ValueError(f"window {w['name']}: cutoff must be the month before start")
        if len(pd.date_range(start, end, freq="MS")) != horizon:
            raise ValueError(f"window {w['name']}: must span {horizon} months")
    months = []
    for w in windows:
        train = [m for m in pd.date_range(train_start, w["cutoff"], freq="MS") if f"{m:%Y-%m-%d}" not in excluded]
        months += [(w["name"], f"{m:%Y-%m-%d}", "train") for m in train]
        months += [(w["name"], f"{m:%Y-%m-%d}", "eval") for m in pd.date_range(w["start"], w["end"], freq="MS")]
    spark = panel.sparkSession
    dim = spark.createDataFrame(months, "window string, d string, part string").select("window", F.col("d").cast(NTZ).alias(ts), "part")
    have = panel.where(F.col(y).isNotNull()).select(series, ts).distinct().withColumn("_have", F.lit(1))
    # Window months are configuration (a few hundred rows): listed per month and exploded per series.
    slots = dim.groupBy().agg(F.collect_list(F.struct("window", ts, "part")).alias("_m"))
    grid = panel.select(series).distinct().join(F.broadcast(slots), F.lit(True), "left").select(series, F.inline("_m"))
    g = step_columns(grid.join(have, [series, ts], "left"), changes, ts)
    train, usable = F.col("part") == "train", F.col("_have").isNotNull()
    aggs = [
        F.count_if(train & usable).alias("usable_months"), F.count_if(train).alias("_planned"),
        F.count_if(~train & usable).alias("actual_months"),
    ]
    for c in changes:
        aggs += [F.count_if(train & usable & (F.col(c) == 1)).alias(f"pre_{c}"), F.count_if(~train & (F.col(c) == 1)).alias(f"win_{c}")]
    v = g.groupBy(series, "window").agg(*aggs)
    short = F.col("usable_months") < min_train
    reasons = [
        F.when(short, F.lit("insufficient history")).when(F.col("usable_months") < F.col("_planned"), F.lit("gap in training months")),
        F.when(F.col("actual_months") < horizon, F.lit("incomplete actuals")),
        *[F.when((F.col(f"win_{c}") > 0) & (F.col(f"pre_{c}") < min_support), F.lit(f"{c} lacks support")) for c in changes],
    ]
    v = v.withColumn("reason", F.concat_ws("; ", *reasons)).withColumn("insufficient_history", short)
    admitted = F.col("reason") == ""
    role = F.when(~admitted, "rejected").when(F.col("window") == test_window, "test").otherwise("development")
    return v.withColumn("admitted", admitted).withColumn("role", role).drop("_planned")


def quantile_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Model quantile columns ('0.1', '0.5', '0.9') renamed; 'mean' only stands in for a missing 0.5."""
    names = mapping or {"0.1": "p10", "0.5": "p50", "0.9": "p90"}
    have = set(df.columns)
    if "0.5" not in have and "mean" in have:
        names = {**{k: v for k, v in names.items() if k != "0.5"}, "mean": "p50"}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns if not (c == "mean" and "mean" not in names)])

