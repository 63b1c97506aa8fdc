"""Exploratory and publishing aggregates over panels and OD facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import col, month_start
from ..functions.scalars import known
from .order_stats import exact_quantiles, merged_values, positions_by_value, running_mass, running_sums, spread, value_ranks


def station_months(od: DataFrame, period: str = "period", key: str = "destination", value: str = "riders") -> DataFrame:
    """Sum inside each month first; averaging over rows of a year would inflate by the month count."""
    return od.groupBy(key, F.col(period).alias("month")).agg(F.sum(value).alias("total"))


def mean_monthly(od: DataFrame, period: str = "period", key: str = "destination", value: str = "riders", by_year: bool = True) -> DataFrame:
    m = station_months(od, period, key, value)
    keys = [key] + (["year"] if by_year else [])
    return m.withColumn("year", F.year("month")).groupBy(*keys).agg(F.avg("total").alias("mean_monthly"), F.count(F.lit(1)).alias("n_months"))


def network_months(panel: DataFrame, ts: str = "ts", y: str = "y") -> DataFrame:
    """Sum over all series per time stamp: (ts, total)."""
    return panel.groupBy(ts).agg(F.sum(y).alias("total"))


def network_years(panel: DataFrame, base_year: int, ts: str = "ts", y: str = "y") -> DataFrame:
    """Yearly totals and their share of the base year."""
    yearly = panel.groupBy(F.year(ts).alias("year")).agg(F.sum(y).alias("total"))
    base = yearly.where(F.col("year") == base_year).select(F.col("total").alias("_base"))
    return yearly.join(F.broadcast(base), F.lit(True), "left").select("year", "total", F.try_divide("total", "_base").alias("share"))


def absent_years(panel: DataFrame, ts: str = "ts") -> DataFrame:
    have = panel.select(F.year(ts).alias("year")).distinct()
    span = have.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("year")).join(have, "year", "left_anti")


def like_for_like(panel: DataFrame, base_year: int, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """Shares over the series that were not zero in the base year.

    A series without any base-year row stays in, as one summing to zero goes out.
    """
    zero = panel.where(F.year(ts) == base_year).groupBy(series).agg(F.sum(y).alias("_s")).where("_s = 0")
    return network_years(panel.join(zero, series, "left_anti"), base_year, ts, y)


def seasonal_index(panel: DataFrame, ts: str = "ts", y: str = "y") -> DataFrame:
    """Month total over its year's mean month, on totals and on totals per calendar day."""
    m = panel.groupBy(month_start(ts).alias("month_ts")).agg(F.sum(y).alias("total"))
    m = m.withColumns({"year": F.year("month_ts"), "month": F.month("month_ts"), "per_day": F.col("total") / F.day(F.last_day(F.col("month_ts").cast("date")))})
    w = Window.partitionBy("year")
    return m.select("year", "month", (F.col("total") / F.avg("total").over(w)).alias("index_total"), (F.col("per_day") / F.avg("per_day").over(w)).alias("index_per_day"))


def rank_medians(panel: DataFrame, base_year: int, since_year: int, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """Median per series in two eras with ranks; a series that was zero in the base year has no base rank.

    Medians are over a series' months (bounded by the calendar); ranks are
    positions in value order.
    """
    era = lambda c: F.when(c, F.col(y))
    base, post = F.year(ts) == base_year, F.year(ts) >= since_year
    m = panel.groupBy(series).agg(
        F.percentile(era(post), F.lit(0.5)).alias("median_post"), F.percentile(era(base), F.lit(0.5)).alias("_b"), F.sum(era(base)).alias("_s")
    ).withColumn("median_base", F.when(F.coalesce(F.col("_s") != 0, F.lit(False)), F.col("_b")))
    posts = positions_by_value(m.where("median_post is not null").withColumn("_d", -F.col("median_post")), [], "_d", [series], "rank_post").select(series, "rank_post")
    b = m.where("median_base is not null").withColumn("_d", -F.col("median_base"))
    tied = running_mass(b.groupBy("_d").agg(F.count(F.lit(1)).cast("double").alias("_n")), [], "_d", "_n", out="_c")
    ranks = b.join(tied.select("_d", (F.col("_c") - F.col("_n") + 1).alias("rank_base")), "_d").select(series, "rank_base")
    return m.select(series, "median_post", "median_base").join(posts, series, "left").join(ranks, series, "left")


def top_share(panel: DataFrame, k: int, series: str = "series", y: str = "y") -> DataFrame:
    """The k largest series, their share and the running share, ties by name."""
    t = panel.groupBy(series).agg(F.sum(y).alias("total"))
    whole = t.agg(F.sum("total").alias("_all"))
    top = t.orderBy(F.col("total").desc(), series).limit(k)
    w = Window.orderBy(F.col("total").desc(), series)  # k rows, after the limit
    return top.join(F.broadcast(whole), F.lit(True)).select(
        series, "total", (F.col("total") / F.col("_all")).alias("share"),
        (F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_all")).alias("cum_share"), F.row_number().over(w).alias("rank"),
    )


def lorenz(entities: DataFrame, key: str, value: str) -> DataFrame:
    """Ascending cumulative share per entity and the share of entities at or below it (percent)."""
    whole = entities.agg(F.sum(value).alias("_all"), F.count(F.lit(1)).alias("_n"))
    curve = running_sums(entities.select(key, value), [], [value, key], {"cum": F.col(value), "pos": F.lit(1).cast("long")})
    return curve.join(F.broadcast(whole), F.lit(True)).select(key, value, (F.col("cum") / F.col("_all")).alias("cum_share"), (F.col("pos") / F.col("_n") * 100).alias("entity_pct"))


def top_fifth_share(curve: DataFrame) -> DataFrame:
    """1 - cumulative share at the first point with at least 80 % of the entities."""
    return curve.where(F.col("entity_pct") >= 80 - 1e-9).agg((1 - F.min_by("cum_share", "entity_pct")).alias("top20_share"))


def describe(entities: DataFrame, value: str, groups: list[str] | None = None, trim: float = 0.1) -> DataFrame:
    """Count, mean, trimmed mean, median, std, MAD, quartiles, bias-adjusted skew and excess kurtosis."""
    groups = groups or []
    e = entities.where(F.col(value).isNotNull()).select(*groups, value)
    n = F.count(value).cast("double")
    g1, g2 = F.skewness(value), F.kurtosis(value)
    basic = e.groupBy(*groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
    )
    q = spread(e, groups, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, "median", trim)
    return (basic.join(q, groups) if groups else basic.join(q, F.lit(True))).withColumn("iqr", F.col("q3") - F.col("q1"))


def daytype_stats(od: DataFrame, day_type: str = "day_type", value: str = "riders") -> DataFrame:
    """Mean, median, std and IQR of positive values per day type (groups of any size)."""
    pos = od.where(F.col(value) > 0)
    basic = pos.groupBy(day_type).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(pos, [day_type], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    return basic.join(q, day_type).select(day_type, "n", "mean", "median", "std", (F.col("q3") - F.col("q1")).alias("iqr"))


def yearly_table(df: DataFrame, base_year: int, ts: str, value: str) -> DataFrame:
    d = df.withColumn("year", F.year(ts))
    basic = d.groupBy("year").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    t = basic.join(exact_quantiles(d, ["year"], value, {"median": 0.5}).drop("n"), "year")
    base = basic.where(F.col("year") == base_year).select(F.col("mean").alias("_b"))
    return t.join(F.broadcast(base), F.lit(True), "left").select("year", "mean", "median", "std", F.when(F.col("year") > base_year, F.col("mean") / F.col("_b") * 100).alias("pct_of_base"))


def seasonal_swing(df: DataFrame, ts: str, value: str, weekday: str = "Avg Weekday", saturday: str = "Avg Saturday", day_type: str = "day_type") -> DataFrame:
    """Summer and winter means per day type with the swing."""
    m = F.month(ts)
    s, w = F.avg(F.when(m.isin(6, 7, 8), F.col(value))), F.avg(F.when(m.isin(12, 1, 2), F.col(value)))
    return df.groupBy(day_type).agg(s.alias("summer"), w.alias("winter"), ((s - w) / w * 100).alias("swing_pct"), F.avg(value).alias("mean"))


def weekday_saturday_ratio(df: DataFrame, value: str, weekday: str = "Avg Weekday", saturday: str = "Avg Saturday", day_type: str = "day_type") -> DataFrame:
    at = lambda v: F.avg(F.when(F.col(day_type) == v, F.col(value)))
    return df.agg(F.try_divide(at(weekday), at(saturday)).alias("weekday_saturday_ratio"))


def weekend_ratio(df: DataFrame, key: str, day: str, value: str, names: tuple[str, str, str] = ("Weekday", "Saturday", "Sunday")) -> DataFrame:
    """(sat + sun) / (2 weekday + 1) for keys that have all three, with its class."""
    wd, sa, su = (F.avg(F.when(F.col(day) == n, F.col(value))) for n in names)
    g = df.groupBy(key).agg(wd.alias("weekday"), sa.alias("saturday"), su.alias("sunday")).where("weekday is not null and saturday is not null and sunday is not null")
    r = (F.col("saturday") + F.col("sunday")) / (F.col("weekday") * 2 + 1)
    return g.withColumn("ratio", r).withColumn("class", F.when(r > 0.8, "weekend-heavy").when(r < 0.4, "commuter").otherwise("mixed"))


def category_ratio(df: DataFrame, category: str, value: str, a: str, b: str) -> DataFrame:
    """Mean per category and the ratio of two of them."""
    means = df.groupBy(category).agg(F.avg(value).alias("mean"))
    both = means.agg(F.max(F.when(F.col(category) == a, F.col("mean"))).alias("_a"), F.max(F.when(F.col(category) == b, F.col("mean"))).alias("_b"))
    return means.join(F.broadcast(both), F.lit(True)).select(category, "mean", F.try_divide("_a", "_b").alias("ratio"))


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, null_pct, zeros) for every column, in one pass."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "decimal")}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"_a{i}"), (F.count_if(F.col(c) == 0) if c in numeric else F.lit(0).cast("long")).alias(f"_z{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_a{i}").alias("nulls"), F.col(f"_z{i}").alias("zeros")) for i, c in enumerate(df.columns)])
    return one.select(F.inline(rows), F.col("_n")).select("column", "nulls", F.try_divide(F.col("nulls") * 100.0, F.col("_n")).alias("null_pct"), "zeros")


def full_duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("_x")).agg(F.coalesce(F.sum("_x"), F.lit(0)).alias("duplicate_rows"))


def correlations(df: DataFrame, target: str, features: list[str], least: int = 10) -> DataFrame:
    """Pearson and Spearman of each numeric or boolean column with the target, pairwise complete."""
    long = df.select(F.col(target).cast("double").alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])))
    # The facts are read once: everything else works on the number of rows of each (feature, x, y).
    pairs = long.where("x is not null and y is not null").groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    rank = lambda v: value_ranks(merged_values(pairs, ["feature"], v, F.col("c")), ["feature"]).withColumnsRenamed({"_v": v, "_rank": f"r{v}"})
    weighed = lambda e: F.sum(F.col("c") * e)
    # One row per named feature.
    means = pairs.groupBy("feature").agg(F.sum("c").alias("n"), (weighed(F.col("x")) / F.sum("c")).alias("mx"), (weighed(F.col("y")) / F.sum("c")).alias("my")).where(F.col("n") >= least)
    j = pairs.join(F.broadcast(means), "feature").join(rank("x"), ["feature", "x"]).join(rank("y"), ["feature", "y"])
    middle = (F.col("n") + 1) / 2
    centred = j.select("feature", "n", "c", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), (F.col("rx") - middle).alias("rx"), (F.col("ry") - middle).alias("ry"))
    corr = lambda a, b: F.try_divide(weighed(F.col(a) * F.col(b)), F.sqrt(weighed(F.col(a) * F.col(a)) * weighed(F.col(b) * F.col(b))))
    out = centred.groupBy("feature").agg(corr("x", "y").alias("pearson"), corr("rx", "ry").alias("spearman"), F.max("n").alias("n"))
    return out.select("feature", "pearson", "spearman", F.abs("pearson").alias("abs_pearson"), "n")


def correlation_matrix(df: DataFrame, entity: str, variable: str, value: str) -> DataFrame:
    """Pairwise correlation of per-entity totals between values of ``variable``.

    Only entities that have every variable count.  The variables are the
    categories of a small code list, each entity lists its own totals once.
    """
    t = df.groupBy(entity, variable).agg(F.sum(value).alias("_v"))
    n = t.agg(F.count_distinct(variable).alias("_k"))
    per = t.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(F.col(variable).alias("v"), "_v"))).alias("_l"))
    full = per.join(F.broadcast(n), F.lit(True)).where(F.size("_l") == F.col("_k"))
    pairs = full.select(F.explode("_l").alias("a"), "_l").select("a", F.explode("_l").alias("b"))
    return pairs.groupBy(F.col("a.v").alias("var_a"), F.col("b.v").alias("var_b")).agg(F.corr(F.col("a._v"), F.col("b._v")).alias("r"), F.count(F.lit(1)).alias("n"))


def linear_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def yoy_correlation(monthly: DataFrame, total: str, precip: str, games: str, ts: str = "ts") -> DataFrame:
    """Per pair of consecutive years: correlation of growth with the change in rain and games.

    ``precip`` is the month's mean hourly value; the month's millimetres are 24 x days of it.
    """
    days = F.day(F.last_day(F.col(ts).cast("date")))
    m = monthly.select(F.year(ts).alias("year"), F.month(ts).alias("month"), F.col(total).alias("t"), (F.col(precip) * 24 * days).alias("p"), F.col(games).cast("double").alias("g"))
    prev = m.select((F.col("year") + 1).alias("year"), "month", *[F.col(c).alias(f"{c}0") for c in "tpg"])
    j = m.join(prev, ["year", "month"]).withColumns({"yoy": F.try_divide("t", "t0") - 1, "dp": F.col("p") - F.col("p0"), "dg": F.col("g") - F.col("g0")})
    return j.groupBy("year").agg(F.corr("yoy", "dp").alias("r_rain"), F.corr("yoy", "dg").alias("r_games"), F.count(F.lit(1)).alias("n_months")).where("n_months = 12")


def event_lift(df: DataFrame, event_flags: dict[str, str], normal: str = "is_game_day", series: str = "series", y: str = "y") -> DataFrame:
    """Median on event rows over the median on normal rows, per series and event type."""
    rows = [F.when(F.coalesce(~F.col(normal), F.lit(False)), F.lit("_normal"))] + [F.when(known(c), F.lit(n)) for n, c in event_flags.items()]
    long = df.where(F.col(y).isNotNull()).withColumn("_t", F.explode(F.array_compact(F.array(*rows))))
    med = exact_quantiles(long, [series, "_t"], y, {"median": 0.5})
    base = med.where("_t = '_normal' and median > 0").select(series, F.col("median").alias("normal_median"))
    ev = med.where("_t <> '_normal'").select(series, F.col("_t").alias("event_type"), F.col("median").alias("event_median"))
    return ev.join(base, series).withColumn("lift_ratio", F.col("event_median") / F.col("normal_median"))


def typical_lift(forecast: DataFrame, history: DataFrame, sub_daily: bool, event: str = "is_game_day", sharks: str | None = "is_sharks_game_window",
                 rain: str | None = "is_raining", hour: str | None = "game_start_hour", series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """First forecast per series against the median of the same season without events.

    Season: hour and weekday for sub-daily panels, calendar month otherwise.
    The reason comes from the first history row at or after the forecast.
    """
    season = {"_season_hour": F.hour(ts), "_season_day": F.weekday(ts)} if sub_daily else {"_season_month": F.month(ts)}
    keys = [series, *season]
    first = forecast.groupBy(series).agg(F.min_by(F.struct(F.col(ts), F.col("p50")), ts).alias("_f")).select(series, F.col(f"_f.{ts}").alias(ts), "_f.p50")
    plain = history.where(F.coalesce(~F.col(event), F.lit(False))) if event in history.columns else history
    typical = exact_quantiles(plain.withColumns(season).where(F.col(y).isNotNull()), keys, y, {"typical_median": 0.5}).drop("n")
    out = first.withColumns(season).join(typical, keys, "left")
    lift = (F.col("p50") - F.col("typical_median")) / F.greatest(F.col("typical_median"), F.lit(1.0)) * 100
    flags = [c for c in (sharks, rain, hour) if c and c in history.columns]
    after = history.select(series, F.col(ts).alias("_t"), *flags).join(first.select(series, F.col(ts).alias("_now")), series).where("_t >= _now")
    nxt = after.groupBy(series).agg(F.min_by(F.struct(F.lit(1).alias("_x"), *flags), "_t").alias("_n"))
    out = out.join(nxt, series, "left")
    reason = F.lit("")
    if rain in flags:
        reason = F.when(known(F.col(f"_n.{rain}").cast("boolean")), "Rain in forecast").otherwise(reason)
    if sharks in flags:
        at = F.coalesce(F.col(f"_n.{hour}").cast("int") if hour in flags else F.lit(None), F.lit(19))
        reason = F.when(known(F.col(f"_n.{sharks}")), F.concat(F.lit("Home game, start "), at.cast("string"), F.lit(":00"))).otherwise(reason)
    return out.select(series, ts, F.round("p50", 1).alias("forecast_p50"), F.round("typical_median", 1).alias("typical_median"),
                      F.when(F.col("typical_median").isNotNull(), F.round(lift, 1)).alias("lift_pct"), reason.alias("reason"))


def recent_average(panel: DataFrame, months: int = 12, series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    """Mean over the panel's latest distinct months (not each series' own)."""
    last = panel.select(month_start(ts).alias("_m")).distinct().orderBy(F.col("_m").desc()).limit(months)
    inside = panel.withColumn("_m", month_start(ts)).join(F.broadcast(last), "_m", "left_semi")
    agg = inside.groupBy(series).agg(F.avg(y).alias("avg_recent"), F.min("_m").alias("first_month"), F.max("_m").alias("last_month"), F.count_distinct("_m").alias("n_months"))
    return agg.withColumn("is_short", F.col("n_months") < months)


def heat_scale(df: DataFrame, value: str = "avg_recent", top: float = 2.4, out: str = "normalized") -> DataFrame:
    """value / P95 x top, clipped and rounded; all 0.1 when the P95 is zero."""
    p = exact_quantiles(df, [], value, {"_p95": 0.95}).select("_p95")
    scaled = F.col(value) / F.col("_p95") * top
    return df.join(F.broadcast(p), F.lit(True), "left").withColumn(
        out, F.when(F.col("_p95") == 0, F.lit(0.1)).when(scaled.isNotNull(), F.round(F.least(scaled, F.lit(top)), 3))
    ).drop("_p95")


def distinct_counts(df: DataFrame, series: str = "series", ts: str = "ts", approximate: bool = False) -> DataFrame:
    """Series, months and rows; ``approximate`` trades exactness for one small sketch per task."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(series).alias("n_series"), count(month_start(ts)).alias("n_months"), F.count(F.lit(1)).alias("n_rows"))


def percentile_targets(df: DataFrame, metric: str, value: str, targets: dict[str, dict[str, float]]) -> DataFrame:
    """p50 and p95 per metric against their targets; missing values are skipped."""
    q = exact_quantiles(df, [metric], value, {"p50": 0.5, "p95": 0.95})
    items = [F.struct(F.lit(m).alias(metric), F.lit(t.get("p50")).cast("double").alias("t50"), F.lit(t.get("p95")).cast("double").alias("t95")) for m, t in targets.items()]
    t = df.sparkSession.range(1).select(F.inline(F.array(*items)))
    return q.join(F.broadcast(t), metric, "left").select(metric, "n", "p50", "p95", (F.col("p50") <= F.col("t50")).alias("p50_ok"), (F.col("p95") <= F.col("t95")).alias("p95_ok"))


def weekday_counts(first: Column) -> dict[str, Column]:
    """Weekdays, Saturdays and Sundays of a month given its first day."""
    days = F.sequence(F.trunc(first.cast("date"), "month"), F.last_day(first.cast("date")), F.expr("interval 1 day"))
    n = lambda f: F.size(F.filter(days, f))
    return {"n_wd": n(lambda d: F.weekday(d) < 5), "n_sat": n(lambda d: F.weekday(d) == 5), "n_sun": n(lambda d: F.weekday(d) == 6)}


def od_identity(od: DataFrame, names: dict[str, str], period: str = "period", day_type: str = "day_type", value: str = "riders") -> DataFrame:
    """Per month: day-type averages times their day counts over the Total block.

    ``names``: wd, sat, sun (optional) and total -> day type.
    """
    at = {k: F.sum(F.when(F.col(day_type) == v, F.col(value))) for k, v in names.items()}
    g = od.groupBy(period).agg(*[c.alias(k) for k, c in at.items()]).withColumns(weekday_counts(F.col(period)))
    parts = [F.coalesce(F.col(k), F.lit(0.0)) * F.col(f"n_{k}") for k in ("wd", "sat", "sun") if k in names]
    return g.select(period, F.try_divide(reduce(lambda a, b: a + b, parts), F.col("total")).alias("ratio"))


def od_top_matrix(od: DataFrame, k: int = 20, period: str = "period", origin: str = "origin", dest: str = "destination", value: str = "riders") -> DataFrame:
    """Mean monthly flow between the k busiest origins and the k busiest destinations, long form.

    The two top lists have k rows each, so their broadcasts have a fixed size.
    """
    top = lambda c: od.groupBy(c).agg(F.sum(value).alias("_t")).orderBy(F.col("_t").desc(), c).limit(k).select(c)
    inside = od.join(F.broadcast(top(origin)), origin, "left_semi").join(F.broadcast(top(dest)), dest, "left_semi")
    flows = inside.groupBy(period, origin, dest).agg(F.sum(value).alias("_f"))
    return flows.groupBy(origin, dest).agg(F.avg("_f").alias("mean_flow"), F.count(F.lit(1)).alias("n_months"))


def mean_std_scatter(panel: DataFrame, years: tuple[int, int], series: str = "series", ts: str = "ts", y: str = "y") -> DataFrame:
    d = panel.withColumn("year", F.year(ts)).where(F.col("year").isin(*years))
    return d.groupBy(series, "year").agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"))


def band_breakdown(df: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """Interval scores plus raw width and the 80th percentile of the relative error."""
    from .metrics import interval_scores

    base = interval_scores(df, by, y)
    raw = df.groupBy(*by).agg(F.round(F.avg((F.col("p90_raw") - F.col("p10_raw")) / F.nullif(F.col("p50"), F.lit(0.0))) * 100, 2).alias("width_raw_of_p50"))
    rel = df.withColumn("_e", F.abs(F.col(y) - F.col("p50")) / F.nullif(F.col("p50"), F.lit(0.0)))
    q = exact_quantiles(rel, by, "_e", {"_q": 0.8}).select(*by, F.round(F.col("_q") * 100, 2).alias("abs_rel_error_q80"))
    return base.join(raw, by).join(q, by, "left") if by else base.join(raw, F.lit(True)).join(q, F.lit(True), "left")


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """First k rows of a full order (each task keeps k rows)."""
    return df.orderBy(*[col(c) for c in order]).limit(k)
