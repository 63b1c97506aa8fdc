"""Conformal calibration of P10/P90 bands.

A calibrator is a table: ``by`` columns, candidate, group_key, q_lo, q_hi, n,
n_incomplete.  Several candidates (score, group, weighting, level) are fitted
in one pass: every pool row is listed once per candidate and tail, and one
exact weighted selection per (candidate, tail, group) gives the quantiles.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import NTZ, col, month_end, month_index, months_between
from ..functions.scalars import INF, no_nan, safe_ratio
from .order_stats import select_by_mass, value_bucket

METHODS = ("scaled", "relative", "asym_relative")
GROUPS = ("pooled", "horizon", "series")


@dataclass(frozen=True)
class Spec:
    """One way to calibrate: score, grouping, coverage level, weight half-life in months."""

    name: str
    method: str = "scaled"
    group: str = "pooled"
    level: float = 0.8
    half_life: float | None = None

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, not {self.method!r}")
        if self.group not in GROUPS:
            raise ValueError(f"group must be one of {GROUPS}, not {self.group!r}")


def conformity(method: str, y="y", p10="p10", p50="p50", p90="p90") -> Column:
    y, lo, mid, hi = (col(c) for c in (y, p10, p50, p90))
    if method == "scaled":
        down, up = safe_ratio(mid - y, mid - lo), safe_ratio(y - mid, hi - mid)
        return F.when(down.isNotNull() & up.isNotNull(), F.greatest(down, up))
    ratio = safe_ratio(y - mid, mid)
    return F.abs(ratio) if method == "relative" else ratio


def group_key(group: str, series: str = "series", horizon: str = "horizon") -> Column:
    return {"pooled": F.lit("all"), "horizon": F.col(horizon).cast("string"), "series": F.col(series).cast("string")}[group]


def incomplete(y="y") -> Column:
    """Actual present, forecast or bound missing: the calibration may not use the window."""
    return col(y).isNotNull() & (F.col("p10").isNull() | F.col("p50").isNull() | F.col("p90").isNull())


def conformal_rank(level, n) -> Column:
    """ceil((n + 1) * level), in floating point as the published rule is."""
    return F.ceil((col(n) + 1).cast("double") * col(level)).cast("double")


def conformal_quantile(df: DataFrame, groups: list[str], score: str, level: float, out: str = "q") -> DataFrame:
    """The ceil((n+1) level)-th smallest score per group, +inf when n is too small."""
    return select_by_mass(df, groups, score, lambda total, n: conformal_rank(F.lit(level), n), out=out)


def weighted_quantile(df: DataFrame, groups: list[str], score: str, weight: str, level: float, out: str = "q") -> DataFrame:
    """Smallest score with running weight >= level * (total + 1); unit weights use the integer rank."""
    unit = df.groupBy(*groups).agg((F.min(weight) == 1).alias("_lo"), (F.max(weight) == 1).alias("_hi"))
    unit = unit.select(*groups, (F.col("_lo") & F.col("_hi")).alias("_unit"))
    tagged = df.join(unit, groups) if groups else df.join(F.broadcast(unit), F.lit(True))
    need = lambda total, n: F.when(F.col("_unit"), conformal_rank(F.lit(level), n)).otherwise((total + 1.0) * level)
    return select_by_mass(tagged, [*groups, "_unit"], score, need, F.col(weight), out).drop("_unit")


def weighted_median(df: DataFrame, groups: list[str], value: str, weight: str, out: str = "m") -> DataFrame:
    """Lower weighted median; no rows give no row."""
    return select_by_mass(df, groups, value, lambda total, n: total * 0.5, F.col(weight), out)


def with_origin_horizon(df: DataFrame, origin=None, ts: str = "ts") -> DataFrame:
    """Tag with the origin (if given) and the calendar months from origin to target."""
    if origin is not None:
        df = df.withColumn("origin", F.lit(origin).cast(NTZ) if isinstance(origin, str) else origin)
    return df.withColumn("horizon", months_between("origin", ts))


def horizon_mismatches(pool: DataFrame, ts: str = "ts") -> DataFrame:
    return pool.where(~F.col("horizon").eqNullSafe(months_between("origin", ts)))


def resolved_pool(pool: DataFrame, as_of, ts: str = "ts") -> DataFrame:
    """Rows known by ``as_of``: origin before it, target on or before it; ``age`` in months."""
    at = F.lit(as_of).cast(NTZ) if isinstance(as_of, str) else col(as_of)
    return pool.where((F.col("origin") < at) & (F.col(ts) <= at)).withColumn("age", months_between(ts, at))


def decay(half_life: float | None, age: str = "age") -> Column:
    return F.lit(1.0) if half_life is None else F.pow(F.lit(0.5), F.col(age).cast("double") / float(half_life))


def _tails(spec: Spec, y: str, series: str, alphas: tuple | None = None) -> list[Column]:
    """One struct per tail of a candidate: score, weight, level, group key."""
    s = conformity(spec.method, y)
    w = decay(spec.half_life)
    a = 1.0 - spec.level
    if spec.method == "asym_relative":
        lo, hi = alphas if alphas else (a / 2, a / 2)
        sides = [("lo", -s, 1.0 - lo), ("hi", s, 1.0 - hi)]
    else:
        sides = [("both", s, spec.level if alphas is None else 1.0 - alphas[0])]
    return [
        F.struct(
            F.lit(spec.name).alias("candidate"), F.lit(side).alias("side"), group_key(spec.group, series).alias("group_key"),
            F.lit(spec.half_life is None).alias("unit"), F.lit(float(level)).alias("level"), score.alias("score"), w.alias("weight"),
        )
        for side, score, level in sides
    ]


def fit(pool: DataFrame, specs: list[Spec], by: list[str] | None = None, y: str = "y", series: str = "series",
        alphas: dict[str, tuple] | None = None) -> DataFrame:
    """Fit every candidate on the rows with an actual, separately per ``by``.

    With a half-life the pool needs ``age`` (see ``resolved_pool``); equal
    weights reproduce the split-conformal quantile on the same rows.
    """
    by = by or []
    alphas = alphas or {}
    seen = pool.where(F.col(y).isNotNull())
    bad = seen.groupBy(*by).agg(F.count_if(incomplete(y)).alias("n_incomplete"))
    entries = [t for s in specs for t in _tails(s, y, series, alphas.get(s.name))]
    rows = seen.select(*by, F.inline(F.array(*entries)))
    groups = [*by, "candidate", "side", "group_key", "unit", "level"]
    need = lambda total, n: F.when(F.col("unit"), conformal_rank("level", n)).otherwise((total + 1.0) * F.col("level"))
    q = select_by_mass(rows, groups, "score", need, F.col("weight"))
    side = lambda *names: F.max(F.when(F.col("side").isin(*names), F.col("q")))
    wide = q.groupBy(*by, "candidate", "group_key").agg(
        F.when(F.max("side") == "both", side("both")).otherwise(-side("lo")).alias("q_lo"),
        F.when(F.max("side") == "both", side("both")).otherwise(side("hi")).alias("q_hi"),
        F.max("n").alias("n"), F.max("mass_total").alias("weight_sum"),
    )
    return (wide.join(bad, by) if by else wide.join(F.broadcast(bad), F.lit(True))).select(
        *by, "candidate", "group_key", "q_lo", "q_hi", "n", "weight_sum", "n_incomplete"
    )


def fit_split(cal: DataFrame, method: str = "scaled", group: str = "pooled", level: float = 0.8, **kw) -> DataFrame:
    return fit(cal, [Spec("split", method, group, level)], **kw)


def fit_rolling(pool: DataFrame, as_of, method: str, group: str, level: float = 0.8, half_life: float | None = None, **kw) -> DataFrame:
    if group == "series":
        raise ValueError("rolling calibration groups are 'pooled' or 'horizon'")
    return fit(resolved_pool(pool, as_of), [Spec("rolling", method, group, level, half_life)], **kw)


def require_complete(pool: DataFrame, y: str = "y", series: str = "series") -> None:
    """Strict check (a small job, two if it raises): raise if any actual has no forecast or bound."""
    gone = pool.where(incomplete(y)).groupBy(series).agg(F.count(F.lit(1)).alias("n"))
    bad = gone.orderBy(series).limit(10).collect()
    if bad:
        raise ValueError(f"calibration window incomplete for {gone.count()} series, first: {[r[series] for r in bad]}")


def _times(p50: Column, factor: Column) -> Column:
    """p50 * factor, but 0 * infinity is an unbounded side."""
    return F.when((p50 == 0) & (F.abs(factor) == INF), factor).otherwise(p50 * factor)


def apply(preds: DataFrame, calibrator: DataFrame, specs: list[Spec], by: list[str] | None = None, series: str = "series") -> DataFrame:
    """Rebuild p10/p90 per candidate; p50 is untouched, the own band is kept as *_raw.

    A missing bound, an unseen group or a calibrator fitted on an incomplete
    window gives NULL, never the raw band.
    """
    by = by or []
    tags = [F.struct(F.lit(s.name).alias("candidate"), F.lit(s.method).alias("_method"), group_key(s.group, series).alias("group_key")) for s in specs]
    rows = preds.withColumn("_c", F.explode(F.array(*tags))).select(*preds.columns, "_c.*")
    c = calibrator.select(*by, "candidate", "group_key", "q_lo", "q_hi", "n_incomplete")
    j = rows.join(c, [*by, "candidate", "group_key"], "left")
    p10, p50, p90, m = F.col("p10"), F.col("p50"), F.col("p90"), F.col("_method")
    usable = F.coalesce(F.col("n_incomplete") == 0, F.lit(False))
    q_lo, q_hi = F.when(usable, F.col("q_lo")), F.when(usable, F.col("q_hi"))
    lower_w, upper_w = p50 - p10, p90 - p50
    lo = (
        F.when(q_lo.isNull() | p50.isNull() | p10.isNull(), None)
        .when(m == "scaled", F.when(lower_w == 0, p50).otherwise(p50 - q_lo * lower_w))
        .when(m == "relative", _times(p50, 1 - q_lo)).otherwise(_times(p50, 1 + q_lo))
    )
    hi = (
        F.when(q_hi.isNull() | p50.isNull() | p90.isNull(), None)
        .when(m == "scaled", F.when(upper_w == 0, p50).otherwise(p50 + q_hi * upper_w))
        .when(m == "relative", _times(p50, 1 + q_hi)).otherwise(_times(p50, 1 + q_hi))
    )
    ordered_lo = F.when(lo.isNotNull(), F.greatest(F.least(lo, p50), F.lit(0.0)))
    ordered_hi = F.when(hi.isNotNull(), F.greatest(hi, p50))
    return j.withColumns({"p10_raw": p10, "p90_raw": p90, "p10": ordered_lo, "p90": ordered_hi}).drop("_method", "q_lo", "q_hi", "n_incomplete")


def own_band(preds: DataFrame, name: str = "own band") -> DataFrame:
    """No calibration, in the shape ``apply`` returns."""
    return preds.withColumns({"candidate": F.lit(name), "group_key": F.lit("all"), "p10_raw": F.col("p10"), "p90_raw": F.col("p90")})


# ---- bias-shifted band ---------------------------------------------------------------------------


def bias_at_origins(seen: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """(by, origin month, bias): weighted median error of the rows resolved by each origin.

    A row's weight at an origin is its weight at the end (``_wb``) times a number of the origin alone, so one
    histogram of (error bucket, month) serves all origins: its masses are added up over months for every origin,
    then over buckets to the one that holds half of the origin's mass, and only that bucket's errors are ordered.
    Rows are not listed for each origin.
    """
    merged = seen.where(F.col("_r").isNotNull()).groupBy(*by, month_index(ts).alias("_at"), F.col("_r").alias("_v")).agg(F.sum("_wb").alias("_m"))
    merged = merged.withColumn("_bucket", value_bucket("_v"))
    hist = merged.groupBy(*by, "_bucket", "_at").agg(F.sum("_m").alias("_m"))
    # Origins are months: a short list for each ``by``.
    origins = seen.groupBy(*by).agg(F.collect_set(month_index("origin")).alias("_o"))
    buckets = hist.select(*by, "_bucket").distinct()
    marks = (buckets.join(origins, by) if by else buckets.join(F.broadcast(origins), F.lit(True))).select(*by, "_bucket", F.explode("_o").alias("_at"), F.lit(0.0).alias("_m"), F.lit(1).alias("_mark"))
    months = Window.partitionBy(*by, "_bucket").orderBy("_at", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    masses = hist.withColumn("_mark", F.lit(0)).unionByName(marks).withColumn("_own", F.sum("_m").over(months)).where("_mark = 1 and _own > 0")
    upto = Window.partitionBy(*by, "_at").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    found = masses.withColumns({"_end": F.sum("_own").over(upto), "_need": F.sum("_own").over(Window.partitionBy(*by, "_at")) * 0.5})
    # Sums in another order may differ in the last bits, so a bucket that ends on the half is joined by its neighbour.
    half = found.where((F.col("_end") >= F.col("_need") * (1 - 1e-12)) & (F.col("_end") - F.col("_own") < F.col("_need") * (1 + 1e-12)))
    half = half.select(*by, "_bucket", F.col("_at").alias("_o"), (F.col("_end") - F.col("_own")).alias("_base"), "_need")
    cell = [*by, "_o", "_bucket"]
    inside = merged.join(half, [*by, "_bucket"]).where(F.col("_at") <= F.col("_o")).groupBy(*cell, "_base", "_need", "_v").agg(F.sum("_m").alias("_m"))
    run = F.col("_base") + F.sum("_m").over(Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    reached = inside.withColumn("_run", run).where(F.col("_run") >= F.col("_need") * (1 - 1e-12))
    return reached.groupBy(*by, "_o").agg(F.min("_v").alias("_centre"))


def fit_shift(pool: DataFrame, as_of, group: str = "pooled", level: float = 0.8, bias_half_life: float = 6.0,
              half_life: float | None = None, bias_at: str = "as_of", by: list[str] | None = None, name: str = "shift",
              y: str = "y", series: str = "series", ts: str = "ts") -> DataFrame:
    """Band p50 * (1 + m -+ w): m the weighted median error, w a weighted quantile of |error - centre|."""
    if group not in ("pooled", "horizon") or bias_at not in ("as_of", "origin"):
        raise ValueError("group must be pooled or horizon, bias_at as_of or origin")
    if bias_at == "origin" and group != "pooled":
        raise ValueError("bias at each origin is pooled only")
    if not (isinstance(bias_half_life, (int, float)) and bias_half_life > 0):
        raise ValueError("bias_half_life must be a positive number of months")
    by = by or []
    seen = resolved_pool(pool, as_of, ts).where(F.col(y).isNotNull()).withColumns({
        "_r": conformity("asym_relative", y), "group_key": group_key(group, series),
        "_wb": decay(bias_half_life), "_ww": decay(half_life), "_unit": F.lit(half_life is None),
    })
    bad = seen.groupBy(*by).agg(F.count_if(incomplete(y)).alias("n_incomplete"))
    keys = [*by, "group_key"]
    bias = weighted_median(seen, keys, "_r", "_wb", "bias").select(*keys, "bias")
    if bias_at == "as_of":
        centred = seen.join(bias.withColumnRenamed("bias", "_centre"), keys)
    else:
        centred = seen.withColumn("_o", month_index("origin")).join(bias_at_origins(seen, by, ts), [*by, "_o"], "left")
    scored = centred.withColumn("_s", F.abs(F.col("_r") - F.col("_centre")))
    need = lambda total, n: F.when(F.col("_unit"), conformal_rank(F.lit(level), n)).otherwise((total + 1.0) * level)
    width = select_by_mass(scored, [*keys, "_unit"], "_s", need, F.col("_ww"), "width").drop("_unit")
    nulls = centred.groupBy(*keys).agg(F.count_if(F.col("_centre").isNull()).alias("n_no_bias"))
    out = bias.join(width, keys, "left").join(nulls, keys, "left")
    w = F.coalesce("width", F.lit(INF))
    out = out.join(bad, by) if by else out.join(F.broadcast(bad), F.lit(True))
    return out.select(
        *by, F.lit(name).alias("candidate"), "group_key", (F.col("bias") - w).alias("q_lo"), (F.col("bias") + w).alias("q_hi"),
        F.coalesce("n", F.lit(0)).alias("n"), F.col("mass_total").alias("weight_sum"), "n_incomplete",
        "bias", w.alias("width"), (F.abs("bias") > w).alias("clipped"), "n_no_bias",
    )


# ---- adaptive calibration -----------------------------------------------------------------------


def clip_alpha(a: float, n: float) -> float:
    """Keep the quantile finite (a >= 1/(n+1), with a hair of slack) and at least the median."""
    return min(max(a, (1.0 + 1e-9) / (n + 1)), 0.5)


class _ScoreIndex:
    """Scores by bucket: a histogram of fixed size on the driver, the rows on the executors.

    A month-by-month rule needs one quantile and one miss count per step.  The
    histogram names the bucket that holds the wanted rank; a small job then
    orders only that bucket's distinct scores, so every step is exact and no
    step touches more than a sliver of the rows.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows.withColumn("b", value_bucket("s", 128)).persist()
        # Buckets are below 1 % of the score wide: their number depends on the score range, not on the rows.
        self.hist = self.rows.groupBy("candidate", "side", "part", "b").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("b")

    def close(self) -> None:
        self.rows.unpersist()

    def parts(self) -> list[int]:
        return sorted(self.hist["part"].unique())

    def totals(self, before: int) -> dict[tuple, tuple[float, int]]:
        h = self.hist[self.hist["part"] < before].groupby(["candidate", "side"])[["w", "n"]].sum()
        return {k: (float(r["w"]), int(r["n"])) for k, r in h.iterrows()}

    def step(self, need: dict[tuple, float], before: int, batch: int) -> dict[tuple, tuple[float, float]]:
        """(quantile of the parts before, share of the batch above it) per (candidate, side)."""
        targets, above, size, out = [], {}, {}, {}
        for key, wanted in need.items():
            mine = self.hist[(self.hist["candidate"] == key[0]) & (self.hist["side"] == key[1])]
            seen = mine[mine["part"] < before].groupby("b", sort=True)["w"].sum()
            cum = seen.cumsum()
            now = mine[mine["part"] == batch]
            size[key] = float(now["n"].sum())
            hit = int((cum < wanted * (1 - 1e-12)).sum())
            if hit >= len(cum):
                out[key] = (INF, 0.0)
                continue
            # The next bucket is kept as well: bucket sums and running sums may differ in the last bit.
            buckets = [int(x) for x in cum.index[hit : hit + 2]]
            base = float(cum.iloc[hit - 1]) if hit else 0.0
            targets += [(*key, x, base, float(wanted)) for x in buckets]
            above[key] = (buckets, now)
        if targets:
            # A handful of configured candidates: their buckets are literals, no join is needed.
            here = lambda t: (F.col("candidate") == t[0]) & (F.col("side") == t[1])
            kept = reduce(lambda x, z: x | z, [here(t) & (F.col("b") == t[2]) for t in targets])
            literal = lambda i: F.coalesce(*[F.when(here(t), F.lit(t[i])) for t in targets])
            merged = self.rows.where(kept).groupBy("candidate", "side", "s").agg(
                F.sum(F.when(F.col("part") < before, F.col("w")).otherwise(0.0)).alias("old"), F.count_if(F.col("part") == batch).alias("new"),
            ).withColumns({"base": literal(3), "need": literal(4)})
            key_w = Window.partitionBy("candidate", "side")
            run = F.col("base") + F.sum("old").over(key_w.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
            found = merged.withColumn("_q", F.when((F.col("old") > 0) & (run >= F.col("need") * (1 - 1e-12)), F.col("s"))).withColumn("q", F.min("_q").over(key_w))
            got = found.groupBy("candidate", "side").agg(F.max("q").alias("q"), F.sum(F.when(F.col("s") > F.col("q"), F.col("new")).otherwise(0)).alias("n")).collect()
            for r in got:
                buckets, now = above[(r["candidate"], r["side"])]
                higher = float(now[~now["b"].isin(buckets) & (now["b"] > buckets[0])]["n"].sum()) + float(r["n"])
                total = size[(r["candidate"], r["side"])]
                out[(r["candidate"], r["side"])] = (float(r["q"]), higher / total if total else 0.0)
        return out


def _indexed(pool: DataFrame, specs: list[Spec], part: Column, y: str, series: str) -> DataFrame:
    entries = [t for s in specs for t in _tails(s, y, series)]
    return pool.where(F.col(y).isNotNull()).select(part.alias("part"), F.inline(F.array(*entries))).select(
        "part", "candidate", "side", F.col("score").alias("s"), F.col("weight").alias("w")
    )


def _sides(spec: Spec) -> list[str]:
    return ["lo", "hi"] if spec.method == "asym_relative" else ["both"]


def _targets(specs: list[Spec]) -> dict[tuple, float]:
    """Allowed miss rate per (candidate, tail)."""
    return {(s.name, side): (1 - s.level) / len(_sides(s)) for s in specs for side in _sides(s)}


def _need(spec_unit: bool, alpha: float, total: float, n: int) -> float:
    import math

    return float(math.ceil((n + 1) * (1.0 - alpha))) if spec_unit else (1.0 - alpha) * (total + 1.0)


def fit_adaptive(pool: DataFrame, as_of, specs: list[Spec], gamma: float = 0.1, y: str = "y", series: str = "series", ts: str = "ts") -> DataFrame:
    """Adaptive conformal inference over monthly target batches (pooled, equal weights).

    The rule is sequential over months: each month's level depends on the last
    month's miss rate.  One small distributed job per month brings back only
    that rate.  Adds ``alpha_lo`` and ``alpha_hi`` (the final levels).
    """
    seen = resolved_pool(pool, as_of, ts)
    index = _ScoreIndex(_indexed(seen, specs, month_index(ts), y, series))
    target = _targets(specs)
    alpha = dict(target)
    try:
        months = index.parts()
        for m in months[1:]:
            sizes = index.totals(m)
            alpha = {k: clip_alpha(a, sizes[k][1]) for k, a in alpha.items()}
            got = index.step({k: _need(True, a, *sizes[k]) for k, a in alpha.items()}, m, m)
            alpha = {k: a + gamma * (target[k] - got[k][1]) for k, a in alpha.items()}
        sizes = index.totals(months[-1] + 1)
        alpha = {k: clip_alpha(a, sizes[k][1]) for k, a in alpha.items()}
    finally:
        index.close()
    # The plan returned recomputes from the pool; nothing depends on cached blocks.
    chosen = {s.name: tuple(alpha[(s.name, side)] for side in _sides(s)) for s in specs}
    final = fit(seen, specs, y=y, series=series, alphas=chosen)
    lookup = lambda i: F.coalesce(*[F.when(F.col("candidate") == k, F.lit(float(a[min(i, len(a) - 1)]))) for k, a in chosen.items()])
    return final.withColumns({"alpha_lo": lookup(0), "alpha_hi": lookup(1)})


def adaptive_within_window(pool: DataFrame, scored: DataFrame, as_of, specs: list[Spec], gamma: float = 0.1, y: str = "y", series: str = "series", ts: str = "ts") -> DataFrame:
    """Diagnostic: each scored month's level reacts to the miss rates of the month before it.

    ``specs`` carry the half-life and are pooled.  Two small jobs per scored month.
    """
    index = _ScoreIndex(_indexed(resolved_pool(pool, as_of, ts), specs, F.lit(0), y, series))
    target = _targets(specs)
    unit = {s.name: s.half_life is None for s in specs}
    alpha, rows = dict(target), []
    by_month = [F.col(ts).alias("_at")]
    spark = pool.sparkSession
    schema = "candidate string, group_key string, q_lo double, q_hi double, n_incomplete long, _at timestamp_ntz"
    try:
        sizes = index.totals(1)
        for m in [r[ts] for r in scored.select(ts).distinct().orderBy(ts).collect()]:
            alpha = {k: clip_alpha(a, sizes[k][0]) for k, a in alpha.items()}
            q = {k: v[0] for k, v in index.step({k: _need(unit[k[0]], a, *sizes[k]) for k, a in alpha.items()}, 1, 1).items()}
            cal = [(s.name, "all", *((-q[(s.name, "lo")], q[(s.name, "hi")]) if len(_sides(s)) == 2 else (q[(s.name, "both")],) * 2), 0, m) for s in specs]
            rows += cal
            banded = apply(scored.where(F.col(ts) == F.lit(m)).select("*", *by_month), spark.createDataFrame(cal, schema), specs, by=["_at"], series=series)
            for r in banded.groupBy("candidate").agg(
                F.avg(F.coalesce(F.col(y) < F.col("p10"), F.lit(False)).cast("double")).alias("below"),
                F.avg(F.coalesce(F.col(y) > F.col("p90"), F.lit(False)).cast("double")).alias("above"),
            ).collect():
                miss = {"lo": r["below"], "hi": r["above"], "both": r["below"] + r["above"]}
                for k in [k for k in alpha if k[0] == r["candidate"]]:
                    alpha[k] += gamma * (target[k] - miss[k[1]])
    finally:
        index.close()
    return apply(scored.select("*", *by_month), spark.createDataFrame(rows, schema), specs, by=["_at"], series=series).drop("_at")


def monthly_recalibration(pool_full: DataFrame, scored: DataFrame, as_of: str, specs: list[Spec], y: str = "y", series: str = "series", ts: str = "ts") -> DataFrame:
    """Diagnostic: refit before each scored month with every row resolved by then.

    The k-th scored month uses the cutoff as_of + k month ends.  All cutoffs are
    fitted in one job: a pool row is listed for each cutoff that sees it.
    """
    at = F.lit(as_of).cast(NTZ)
    months = scored.select(ts).distinct().withColumn("_k", F.row_number().over(Window.orderBy(ts)) - 1)
    cut = months.withColumn("cutoff", month_end(F.add_months(at.cast("date"), F.col("_k")))).select(ts, "cutoff")
    cut = cut.withColumn("cutoff", F.when(month_index("cutoff") == month_index(at), at).otherwise(F.col("cutoff")))
    cuts = cut.agg(F.collect_set("cutoff").alias("_cuts"))
    # One cutoff per scored month: a short list carried by every pool row.
    rows = pool_full.join(F.broadcast(cuts), F.lit(True)).withColumn("cutoff", F.explode("_cuts")).drop("_cuts")
    seen = rows.where((F.col("origin") < F.col("cutoff")) & (F.col(ts) <= F.col("cutoff"))).withColumn("age", months_between(ts, "cutoff"))
    cal = fit(seen, specs, by=["cutoff"], y=y, series=series)
    return apply(scored.join(F.broadcast(cut), ts), cal, specs, by=["cutoff"], series=series)


# ---- folds, runs, provenance ----------------------------------------------------------------------


def series_folds(df: DataFrame, n_folds: int = 5, series: str = "series") -> DataFrame:
    """Fold = position of the series in text order, modulo ``n_folds``."""
    from .ordered import row_positions, with_text_range

    names = with_text_range(df.select(F.col(series).cast("string").alias("_name")).distinct(), "_name", "_range")
    placed = row_positions(names, [], ["_name"], F.col("_range"))
    return df.withColumn("_name", F.col(series).cast("string")).join(
        placed.select("_name", (F.col("_pos") % n_folds).cast("int").alias("fold")), "_name"
    ).drop("_name")


def cross_fit(frame: DataFrame, method: str, group: str, level: float = 0.8, n_folds: int = 5, y: str = "y", series: str = "series") -> DataFrame:
    """Each fold calibrated on the other folds, all folds in one job."""
    folded = series_folds(frame, n_folds, series)
    spec = [Spec("folds", method, group, level)]
    others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col("fold"))
    train = folded.withColumn("fold", F.explode(others))
    return apply(folded, fit(train, spec, by=["fold"], y=y, series=series), spec, by=["fold"], series=series)


def labelled(applied: DataFrame, calibrator: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Interval label; FAILED where the calibrator is missing or was fitted on incomplete rows."""
    by = by or []
    state = calibrator.groupBy(*by).agg(F.max("n_incomplete").alias("_bad"))
    j = applied.join(state, by, "left") if by else applied.join(F.broadcast(state), F.lit(True), "left")
    return j.withColumn("interval_method", F.when(F.coalesce(F.col("_bad") == 0, F.lit(False)), label).otherwise("FAILED")).drop("_bad")


PROVENANCE = ["model", "method", "group", "level", "as_of", "checkpoint"]


def save_calibrator(calibrator: DataFrame, path: str, **provenance) -> None:
    """Calibrator rows with their provenance as columns; infinity is kept as a DOUBLE."""
    cols = {f"prov_{k}": F.lit(provenance.get(k)).cast("string") for k in PROVENANCE}
    calibrator.withColumns(cols).write.mode("errorifexists").parquet(path)


def load_calibrator(spark, path: str, **expected) -> DataFrame:
    """Calibrator rows, refused if any expected provenance field disagrees (one small job)."""
    df = spark.read.parquet(path)
    first = df.select(*[f"prov_{k}" for k in PROVENANCE]).distinct().limit(2).collect()
    if len(first) != 1:
        raise ValueError("calibrator has no single provenance")
    for k, v in expected.items():
        if first[0][f"prov_{k}"] != (None if v is None else str(v)):
            raise ValueError(f"calibrator {k} is {first[0][f'prov_{k}']!r}, not {v!r}")
    return df.drop(*[f"prov_{k}" for k in PROVENANCE])


def serve_bands(preds: DataFrame, calibrators: DataFrame, plans: dict[str, Spec | None], expected: dict[str, dict], origin: str, model: str = "model", series: str = "series", ts: str = "ts") -> DataFrame:
    """Every forecast of many models with the band its plan assigns and a ``status``; P50 is untouched, own bounds stay as *_raw.

    ``plans``: the spec of each model, None for its own band.  ``calibrators``: rows as ``save_calibrator`` wrote them, the
    model's name as candidate.  ``expected``: the provenance that a model's calibrator must state.  A band nobody
    scored is never served; bounds are NULL and the status says why for

    * a row at or before ``origin``: forecasts are made from it, and horizons are counted in months after it;
    * a model without a plan, or without a calibrator;
    * a calibrator that states other provenance (the fields that differ are named), or more than one;
    * a group the calibrator never saw, or that was fitted on an incomplete window.
    """
    specs = [replace(s, name=m) for m, s in plans.items() if s is not None]
    keyed = with_origin_horizon(preds.drop("origin", "horizon"), origin, ts)
    calibrated = F.col(model).isin([s.name for s in specs])
    banded = apply(keyed.where(calibrated), calibrators, specs, series=series).where(F.col("candidate") == F.col(model))
    own = own_band(keyed.where(~calibrated))
    stated = calibrators.groupBy(F.col("candidate").alias(model)).agg(F.collect_set(F.struct(*[F.col(f"prov_{k}").alias(k) for k in PROVENANCE])).alias("_stated"))

    def differing(name: str, wanted: dict) -> Column:
        def differs(field: str) -> Column:
            return F.exists("_stated", lambda p: ~p[field].eqNullSafe(F.lit(wanted.get(field)).cast("string")))

        return F.when(F.col(model) == name, F.concat_ws(", ", *[F.when(differs(k), F.lit(k)) for k in PROVENANCE]))

    wrong = F.coalesce(*[differing(s.name, expected.get(s.name, {})) for s in specs], F.lit("")) if specs else F.lit("")
    j = banded.unionByName(own, allowMissingColumns=True).join(stated, model, "left").withColumn("_wrong", wrong)
    planned = F.col(model).isin(list(plans))
    status = (
        F.when(F.col("horizon") < 1, "at or before the origin").when(~planned, "no plan").when(~calibrated, "own band").when(F.col("_stated").isNull(), "no calibrator")
        .when(F.col("_wrong") != "", F.concat(F.lit("calibrator differs in "), F.col("_wrong"))).when(F.size("_stated") > 1, "calibrators of several origins")
        .when(F.col("p10").isNull() | F.col("p90").isNull(), "no band for this group").otherwise("served")
    )
    j = j.withColumn("status", status)
    kept = F.col("status").isin("served", "own band")
    return j.withColumns({c: F.when(kept, F.col(c)) for c in ("p10", "p90")}).drop("_stated", "_wrong", "candidate", "group_key", "origin")


def clean_forecast(df: DataFrame) -> DataFrame:
    """NaN quantiles become NULL before calibration."""
    return df.withColumns({c: no_nan(c) for c in ("p10", "p50", "p90") if c in df.columns})
