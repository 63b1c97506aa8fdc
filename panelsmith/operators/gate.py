"""Publish gate: a candidate panel against the tracked one.

Every check gives (check, status, message, details).  ``run_gate`` reads the
verdict with one small collect and fails closed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import NTZ, month_start
from ..functions.scalars import close_or_both_null
from .metrics import score_columns
from .ordered import first_k, keep_first, quantile_cuts, windowed_by_rows, with_piece
from .quality import run_checks

DEFAULT_RTOL = 1e-9
ORDER = ["input_frames", "quality_checks", "unique_keys", "station_set", "tracked_columns", "tracked_keys_present", "target_exact",
         "covariates_within_rtol", "served_months_retained", "no_future_month", "backtest"]


def verdict(df: DataFrame, check: str, bad, message, **details) -> DataFrame:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    d = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    return df.select(F.lit(check).alias("check"), F.when(bad, "fail").otherwise("pass").alias("status"), message.alias("message"), d.alias("details"))


def unique_keys(cand: DataFrame, series: str = "series", ts: str = "ts") -> DataFrame:
    dup = cand.groupBy(series, ts).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    label = F.concat_ws("@", F.col(series).cast("string"), F.date_format(ts, "yyyy-MM"))
    one = dup.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).join(first_k(dup, label, 10), F.lit(True))
    return verdict(one, "unique_keys", F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" rows share "), F.col("k").cast("string"), F.lit(" keys")),
                   n_duplicate_rows=F.col("n"), n_keys=F.col("k"), examples=F.col("examples"))


def station_differences(cand: DataFrame, tracked: DataFrame, series: str = "series", ts: str = "ts") -> DataFrame:
    """(ts, series, problem): missing or extra series per candidate month, as rows; ``ts`` is the month's start."""
    want = tracked.select(series).distinct()
    have = cand.select(month_start(ts).alias(ts), series).distinct()
    extra = have.join(want, series, "left_anti").select(ts, series, F.lit("extra").alias("problem"))
    # A month is complete when it holds every expected series: count first, list only incomplete months.
    good = have.join(want, series, "left_semi").groupBy(ts).agg(F.count(F.lit(1)).alias("_have"))
    total = want.agg(F.count(F.lit(1)).alias("_want"))
    short = have.select(ts).distinct().join(good, ts, "left").join(F.broadcast(total), F.lit(True)).where(F.coalesce("_have", F.lit(0)) < F.col("_want")).select(ts)
    # Every expected series lists the calendar between the first and the last short month (one row), then keeps the short ones.
    ends = short.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).where("_a is not null")
    calendar = F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias(ts)
    missing = (
        want.join(F.broadcast(ends), F.lit(True)).select(calendar, series)
        .join(short, ts, "left_semi").join(have, [ts, series], "left_anti").select(ts, series, F.lit("missing").alias("problem"))
    )
    return missing.unionByName(extra)


def station_set(cand: DataFrame, tracked: DataFrame, expected: int, series: str = "series", ts: str = "ts") -> DataFrame:
    d = station_differences(cand, tracked, series, ts)
    n = tracked.agg(F.count_distinct(series).alias("n_tracked"))
    one = d.agg(F.count_distinct(ts).alias("n_months"), F.count_if(F.col("problem") == "missing").alias("n_missing"), F.count_if(F.col("problem") == "extra").alias("n_extra")).join(n, F.lit(True))
    bad = (F.col("n_tracked") != expected) | (F.col("n_months") > 0)
    return verdict(one, "station_set", bad, F.concat(F.col("n_months").cast("string"), F.lit(" months differ from the tracked set")),
                   n_tracked=F.col("n_tracked"), n_months=F.col("n_months"), n_missing=F.col("n_missing"), n_extra=F.col("n_extra"))


def columns_present(cand: DataFrame, tracked: DataFrame) -> DataFrame:
    """Whether the candidate has every tracked column; details tell its rows."""
    absent = [c for c in tracked.columns if c not in cand.columns]
    one = cand.agg(F.count(F.lit(1)).alias("n"))
    return verdict(one, "tracked_columns", F.lit(bool(absent)), F.lit(f"absent: {', '.join(absent)}" if absent else "all present"), rows=F.col("n"))


def join_tracked(cand: DataFrame, tracked: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Tracked rows with the candidate's first row per key as ``*_c`` and ``present``."""
    cols = [c for c in tracked.columns if c in cand.columns and c not in keys]
    first = keep_first(cand.select(*keys, *cols, *[o for o in (order or []) if o not in cols]), keys, order or cols)
    c = first.select(*keys, *[F.col(x).alias(f"{x}_c") for x in cols], F.lit(True).alias("present"))
    return tracked.select(*keys, *[F.col(x).alias(f"{x}_t") for x in cols]).join(c, keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def tracked_differences(cand: DataFrame, tracked: DataFrame, y: str = "y", keys: list[str] | None = None, rtol: float = DEFAULT_RTOL, order: list[str] | None = None) -> DataFrame:
    """One row: missing keys and, per shared column, how many present values differ."""
    keys = keys or ["series", "ts"]
    cols = [c for c in tracked.columns if c in cand.columns and c not in keys]
    floats = {f.name for f in tracked.schema.fields if f.dataType.typeName() in ("double", "float")}
    j = join_tracked(cand, tracked, keys, order)
    aggs = [F.count_if(~F.col("present")).alias("n_missing")]
    for c in cols:
        tol = None if c == y or c not in floats else rtol
        aggs.append(F.count_if(F.col("present") & ~close_or_both_null(f"{c}_c", f"{c}_t", tol)).alias(f"diff_{c}"))
    return j.agg(*aggs)


def tracked_rows(cand: DataFrame, tracked: DataFrame, y: str = "y", keys: list[str] | None = None, rtol: float = DEFAULT_RTOL, order: list[str] | None = None) -> DataFrame:
    keys = keys or ["series", "ts"]
    d = tracked_differences(cand, tracked, y, keys, rtol, order)
    cov = [c[5:] for c in d.columns if c.startswith("diff_") and c != f"diff_{y}"]
    total = reduce(lambda a, b: a + b, [F.col(f"diff_{c}") for c in cov], F.lit(0))
    text = F.concat_ws(", ", *[F.when(F.col(f"diff_{c}") > 0, F.concat(F.lit(f"{c}="), F.col(f"diff_{c}").cast("string"))) for c in cov]) if cov else F.lit("")
    parts = [
        verdict(d, "tracked_keys_present", F.col("n_missing") > 0, F.concat(F.col("n_missing").cast("string"), F.lit(" tracked keys missing")), n_missing=F.col("n_missing")),
        verdict(d, "target_exact", F.col(f"diff_{y}") > 0, F.concat(F.col(f"diff_{y}").cast("string"), F.lit(" target values differ")), n_changed=F.col(f"diff_{y}")),
        verdict(d, "covariates_within_rtol", total > 0, F.concat(F.lit("differing: "), text)),
    ]
    return reduce(DataFrame.unionByName, parts)


def served_months(cand: DataFrame, served: DataFrame, ts: str = "ts") -> DataFrame:
    gone = served.select(month_start(ts).alias("m")).distinct().join(cand.select(month_start(ts).alias("m")), "m", "left_anti")
    one = gone.agg(F.count(F.lit(1)).alias("n")).join(first_k(gone, F.date_format("m", "yyyy-MM"), 10), F.lit(True))
    return verdict(one, "served_months_retained", F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" served months missing")), n=F.col("n"), examples=F.col("examples"))


def no_future_month(cand: DataFrame, last_closed: str | None, ts: str = "ts") -> DataFrame:
    if last_closed is None:
        return verdict(cand.sparkSession.range(1), "no_future_month", F.lit(True), F.lit("last closed month not given"))
    late = cand.where(F.col(ts) > month_start(F.lit(last_closed).cast(NTZ))).select(month_start(ts).alias("m")).distinct()
    one = late.agg(F.count(F.lit(1)).alias("n")).join(first_k(late, F.date_format("m", "yyyy-MM"), 10), F.lit(True))
    return verdict(one, "no_future_month", F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" months after the last closed one")), n=F.col("n"), examples=F.col("examples"))


def backtest(cand: DataFrame, tracked: DataFrame, as_of: str, horizon: int, expected_wape: float,
             forecaster: Callable[[DataFrame, int, list[str]], DataFrame], series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """Refit on the candidate at ``as_of``; WAPE on tracked actuals must equal the published one at 2 dp."""
    at = F.lit(as_of).cast(NTZ)
    hist = cand.where(F.col(ts) <= at).withColumn("origin", at)
    months = tracked.where(F.col(ts) > at).select(ts).distinct().orderBy(ts).limit(horizon)
    actual = tracked.join(F.broadcast(months), ts, "left_semi").select(series, ts, y)
    fc = forecaster(hist.select(series, "origin", ts, y), horizon, [series, "origin"])
    m = score_columns(y)
    one = actual.join(fc.select(series, ts, "p10", "p50", "p90"), [series, ts], "left").agg(
        F.round(m["wape"], 2).alias("wape"), m["n"].alias("n"), m["n_expected"].alias("n_expected"), F.count_distinct(ts).alias("n_months")
    )
    bad = (F.col("n_months") < horizon) | F.coalesce(F.col("wape") != round(expected_wape, 2), F.lit(True))
    return verdict(one, "backtest", bad, F.concat(F.lit("WAPE "), F.coalesce(F.col("wape").cast("string"), F.lit("undefined"))), wape=F.col("wape"), n=F.col("n"), n_expected=F.col("n_expected"))


def _guarded(spark, name: str, make: Callable[[], DataFrame]) -> list:
    """Run one check; an exception is a failed check."""
    try:
        return make().collect()
    except Exception as exc:  # noqa: BLE001 - fail closed
        row = spark.range(1).select(F.lit(name).alias("check"), F.lit("fail").alias("status"), F.lit(f"check raised {type(exc).__name__}: {exc}").alias("message"), F.lit(None).cast("map<string,string>").alias("details"))
        return row.collect()


def quality_verdict(cand: DataFrame, **names) -> DataFrame:
    bad = run_checks(cand, **names).agg(F.count_if(F.col("severity") == "ERROR").alias("n"))
    return verdict(bad, "quality_checks", F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" ERROR results")))


def run_gate(cand: DataFrame, tracked: DataFrame, served: DataFrame, expected_series: int, last_closed: str | None,
             backtest_spec: dict | None = None, series: str = "series", ts: str = "ts", y: str = "y", rtol: float = DEFAULT_RTOL, order: list[str] | None = None) -> DataFrame:
    """Ordered gate report.  Runs its checks (each result is one row), fails closed, and
    skips the backtest when a structural check failed."""
    spark = cand.sparkSession
    rows: list = []
    unreadable = [n for n, d in (("candidate", cand), ("tracked", tracked)) if not {series, ts} <= set(d.columns)]
    if not unreadable:
        empty_ts = cand.where(F.col(ts).isNull()).limit(1).count() + tracked.where(F.col(ts).isNull()).limit(1).count()
        unreadable = ["rows without a time stamp"] if empty_ts else []
    if unreadable:
        rows += [("input_frames", "fail", f"cannot read: {unreadable}", None), ("backtest", "skipped", "inputs unreadable", None)]
        return spark.createDataFrame(rows, "check string, status string, message string, details map<string,string>")
    names = {"series": series, "ts": ts}
    checks: list[tuple[str, Callable[[], DataFrame]]] = [
        ("quality_checks", lambda: quality_verdict(cand, y=y, step="month", **names)),
        ("unique_keys", lambda: unique_keys(cand, **names)),
        ("station_set", lambda: station_set(cand, tracked, expected_series, **names)),
        ("tracked_columns", lambda: columns_present(cand, tracked)),
        ("tracked_rows", lambda: tracked_rows(cand, tracked, y, [series, ts], rtol, order)),
        ("served_months_retained", lambda: served_months(cand, served, ts)),
        ("no_future_month", lambda: no_future_month(cand, last_closed, ts)),
    ]
    for name, make in checks:
        rows += [tuple(r) for r in _guarded(spark, name, make)]
    if any(r[1] == "fail" for r in rows):
        rows.append(("backtest", "skipped", "a structural check failed", None))
    elif backtest_spec:
        rows += [tuple(r) for r in _guarded(spark, "backtest", lambda: backtest(cand, tracked, series=series, ts=ts, y=y, **backtest_spec))]
    rank = {n: i for i, n in enumerate(ORDER)}
    rows.sort(key=lambda r: rank.get(r[0], len(ORDER)))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, check string, status string, message string, details map<string,string>")


def gate_passed(report: DataFrame) -> bool:
    return report.where("status = 'fail'").limit(1).count() == 0


def series_revision(new: DataFrame, committed: DataFrame, last_closed: str, month: str = "month", value: str = "value", position: str = "position", revised: str | None = "revised_from",
                    keys: list[str] | None = None) -> DataFrame:
    """(keys, problem, month): why a monthly series may not replace the committed one; no rows if it may.

    Months are 'YYYY-MM' text; ``position`` is the row's place in the file.
    """
    keys = keys or []
    num = F.expr(f"try_cast({value} as double)")
    n = new.withColumn("_v", num)
    row = lambda d, text: d.select(*keys, F.lit(text).alias("problem"), F.col(month).alias("month"))
    bad_month = row(n.where(~F.coalesce(F.col(month).rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(False))), "month is not YYYY-MM")
    not_number = row(n.where(F.col("_v").isNull()), "value is not a number")
    # Positions are cut into blocks of rows, so that one long file is many tasks.
    ranged = with_piece(n, F.col(position), quantile_cuts(n, F.col(position)), "_range")
    stepped = windowed_by_rows(ranged, keys, [position], 1, lambda w: {"_p": F.lag(month).over(w)}, F.col("_range"))
    order = row(stepped.where(F.col(month) <= F.col("_p")), "months not strictly increasing")
    late = row(n.where(F.col(month) > last_closed), "month after the last closed month")
    old = committed.select(*keys, month, F.expr(f"try_cast({value} as double)").alias("_old"))
    gone = row(old.join(n, [*keys, month], "left_anti"), "committed month missing")
    flag = F.col(revised).isNotNull() if revised and revised in new.columns else F.lit(False)
    changed = row(n.withColumn("_rev", flag).join(old, [*keys, month]).where((F.col("_v") != F.col("_old")) & ~F.col("_rev")), "committed value changed without a revision")
    return reduce(DataFrame.unionByName, [bad_month, not_number, order, late, gone, changed])


def export_complete(dim: DataFrame, averages: DataFrame, key: str, series: str = "series", value: str = "avg_recent", scaled: str = "normalized") -> DataFrame:
    """Dimension series without a finite average and level: none may be published until empty."""
    from ..functions.scalars import finite

    a = averages.select(F.col(series).alias(key), value, scaled, F.lit(True).alias("_have"))
    j = dim.select(key).distinct().join(a, key, "left")
    return j.select(key, F.when(F.col("_have").isNull(), "no rows in the averaging window").when(~(finite(value) & finite(scaled)), "average or level not finite").alias("reason")).where("reason is not null")
