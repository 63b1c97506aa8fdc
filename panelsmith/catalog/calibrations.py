"""Conformal calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as K
from ..plans import backtest as B
from . import fixtures as X
from .common import flag, rnd, ts_lit
from .fixtures import TRAIN_END, with_
from .registry import query
from .scores import interval_sql

LEVEL = 0.8
BIG = 1e12  # infinity as a plain number in results


def plain(df, *cols):
    """Infinite quantiles as +-1e12, rounded: the two engines print them alike."""
    return df.withColumns({c: F.round(F.greatest(F.least(F.col(c), F.lit(BIG)), F.lit(-BIG)), 6) for c in cols})


def resolved(t):
    return K.resolved_pool(X.p6(t), TRAIN_END)


def _ratio(n, d):
    return f"CASE WHEN {n} IS NULL OR {d} IS NULL THEN NULL WHEN {d} <> 0 THEN {n} / {d} WHEN {n} = 0 THEN 0 WHEN {n} > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END"


_SCALED = f"CASE WHEN p10 + p50 + p90 + y IS NOT NULL THEN greatest({_ratio('(p50 - y)', '(p50 - p10)')}, {_ratio('(y - p50)', '(p90 - p50)')}) END"
_REL = f"abs({_ratio('(y - p50)', 'p50')})"
_ASYM = _ratio("(y - p50)", "p50")
_AGE = "((1999 * 12 + 12) - (year(ts) * 12 + month(ts)))"
# Resolved rows with an actual and a forecast; the pool has no incomplete rows unless a query makes some.
POOL = {"pool": f"SELECT *, {_SCALED} AS s_scaled, {_REL} AS s_rel, {_ASYM} AS s_asym, power(0.5::DOUBLE, {_AGE} / 6.0::DOUBLE) AS w6, {_AGE} AS age FROM p6 WHERE y IS NOT NULL AND p50 IS NOT NULL"}


# Every resolved row of the pool with holes; rows without a score count for nothing, and are not taken out before.
EVERY = {"every": f"SELECT *, {_SCALED} AS s_scaled, {_REL} AS s_rel, {_ASYM} AS s_asym, power(0.5::DOUBLE, {_AGE} / 6.0::DOUBLE) AS w6 FROM gp6"}


def every(t):
    return K.resolved_pool(X.gapped(t), TRAIN_END)


def _kth(src, group, score, level):
    """ceil((n+1) level)-th smallest score of each group, 1e12 when there are too few scores."""
    return f"SELECT {group} AS g, count({score}) AS n, coalesce(list_sort(list({score}) FILTER ({score} IS NOT NULL))[CAST(ceil((count({score}) + 1) * {level!r}::DOUBLE) AS BIGINT)], 1e12) AS q FROM {src} GROUP BY 1"


def _weighted(src, group, score, weight, need):
    """Smallest score whose running weight reaches ``need`` (an expression of tot)."""
    return f"""SELECT g, any_value(n) AS n, coalesce(min(CASE WHEN cum >= ({need}) * (1 - 1e-12) THEN s END), 1e12) AS q, any_value(tot) AS tot FROM (SELECT {group} AS g, {score} AS s, sum({weight}) OVER (PARTITION BY {group} ORDER BY {score} RANGE UNBOUNDED PRECEDING) AS cum,
      sum({weight}) OVER (PARTITION BY {group}) AS tot, count(*) OVER (PARTITION BY {group}) AS n FROM {src} WHERE ({score}) IS NOT NULL) GROUP BY g"""


def _incomplete(group):
    return f"SELECT {group} AS g, count(*) FILTER (WHERE y IS NOT NULL AND (p10 IS NULL OR p50 IS NULL OR p90 IS NULL)) AS n_incomplete FROM every GROUP BY 1"


def with_incomplete(df, pool, by):
    return df.join(pool.groupBy(by).agg(F.count_if(K.incomplete()).alias("n_incomplete")), by)


@query("cal_scores", with_(["gp6"], "SELECT series, ts, origin, round(CASE WHEN s_scaled IS NOT NULL THEN least(s_scaled, 1e12) END, 8) AS scaled, round(CASE WHEN s_rel IS NOT NULL THEN least(s_rel, 1e12) END, 8) AS relative, round(CASE WHEN s_asym IS NOT NULL THEN least(s_asym, 1e12) END, 8) AS asym_relative FROM every", EVERY))
def _(t):
    capped = lambda m: F.when(K.conformity(m).isNotNull(), F.least(K.conformity(m), F.lit(BIG)))
    return every(t).select("series", "ts", "origin", *[F.round(capped(m), 8).alias(m) for m in K.METHODS])


@query("cal_quantile", with_(["gp6"], f"SELECT g AS horizon, n, round(q, 6) AS q, n_incomplete FROM ({_kth('every', 'horizon', 's_rel', LEVEL)}) JOIN ({_incomplete('horizon')}) USING (g)", EVERY))
def _(t):
    p = every(t).withColumn("s", K.conformity("relative"))
    return with_incomplete(plain(K.conformal_quantile(p, ["horizon"], "s", LEVEL).drop("mass_total"), "q"), p, "horizon")


@query("cal_weighted_quantile", with_(["gp6"], f"SELECT g AS horizon, n, round(q, 6) AS q, n_incomplete FROM ({_weighted('every', 'horizon', 's_rel', 'w6', f'{LEVEL} * (tot + 1)')}) JOIN ({_incomplete('horizon')}) USING (g)", EVERY))
def _(t):
    p = every(t).withColumns({"s": K.conformity("relative"), "w": K.decay(6.0)})
    return with_incomplete(plain(K.weighted_quantile(p, ["horizon"], "s", "w", LEVEL).drop("mass_total"), "q"), p, "horizon")


@query("cal_weighted_median", with_(["gp6"], f"SELECT g AS series, round(q, 6) AS m, n_incomplete FROM ({_weighted('every', 'series', 's_asym', 'w6', '0.5 * tot')}) JOIN ({_incomplete('series')}) USING (g)", EVERY))
def _(t):
    p = every(t).withColumns({"s": K.conformity("asym_relative"), "w": K.decay(6.0)})
    return with_incomplete(plain(K.weighted_median(p, ["series"], "s", "w").select("series", "m"), "m"), p, "series")


# Split calibration on the test window, for the three scores and groups; the oracle covers one of each.
_SC = {"sc": f"SELECT *, {_SCALED} AS s_scaled, {_ASYM} AS s_asym FROM scored WHERE y IS NOT NULL"}


@query("cal_fit_split", with_(["scored"], f"""SELECT 'scaled pooled' AS fit, 'all' AS group_key, n, round(q, 6) AS q_lo, round(q, 6) AS q_hi FROM ({_kth('sc', "'all'", 's_scaled', LEVEL)}) UNION ALL
  SELECT 'scaled horizon', CAST(g AS VARCHAR), n, round(q, 6), round(q, 6) FROM ({_kth('sc', 'horizon', 's_scaled', LEVEL)}) UNION ALL
  SELECT 'asym series', CAST(h.g AS VARCHAR), h.n, round(-l.q, 6), round(h.q, 6) FROM ({_kth('sc', 'series', 's_asym', 1 - (1 - LEVEL) / 2)}) h JOIN ({_kth('sc', 'series', '-s_asym', 1 - (1 - LEVEL) / 2)}) l ON h.g = l.g""", _SC))
def _(t):
    s = X.scored(t)
    specs = [K.Spec("scaled pooled", "scaled"), K.Spec("scaled horizon", "scaled", "horizon"), K.Spec("asym series", "asym_relative", "series")]
    return plain(K.fit(s, specs).select(F.col("candidate").alias("fit"), "group_key", "n", "q_lo", "q_hi"), "q_lo", "q_hi")


_FITQ = {**POOL, "qh": _kth("pool", "horizon", "s_scaled", LEVEL)}


@query("cal_apply", with_(["p6", "scored"], """SELECT s.series, s.ts, s.p50, s.p10 AS p10_raw, s.p90 AS p90_raw, round(greatest(least(CASE WHEN s.p50 = s.p10 THEN s.p50 ELSE s.p50 - q.q * (s.p50 - s.p10) END, s.p50), 0), 4) AS p10, round(greatest(CASE WHEN s.p90 = s.p50 THEN s.p50 ELSE s.p50 + q.q * (s.p90 - s.p50) END, s.p50), 4) AS p90
  FROM scored s LEFT JOIN qh q ON q.g = s.horizon""", _FITQ))
def _(t):
    spec = [K.Spec("rolling", "scaled", "horizon")]
    out = K.apply(X.scored(t), K.fit(resolved(t), spec), spec)
    return rnd(out.select("series", "ts", "p50", "p10_raw", "p90_raw", "p10", "p90"), 4, "p10", "p90")


@query("cal_horizon_origin", with_(["p6"], "SELECT origin, horizon, count(*) AS n FROM p6 GROUP BY 1, 2"))
def _(t):
    return K.with_origin_horizon(X.p6(t).drop("horizon")).groupBy("origin", "horizon").agg(F.count(F.lit(1)).alias("n"))


@query("cal_pool", with_(["p6"], "SELECT origin, (1999 * 12 + 9) - (year(ts) * 12 + month(ts)) AS age, count(*) AS n FROM p6 WHERE origin < TIMESTAMP '1999-09-30' AND ts <= TIMESTAMP '1999-09-30' GROUP BY 1, 2"))
def _(t):
    return K.resolved_pool(X.p6(t), "1999-09-30").groupBy("origin", "age").agg(F.count(F.lit(1)).alias("n"))


_A2 = 1 - (1 - LEVEL) / 2


@query("cal_fit_rolling", with_(["p6"], f"""SELECT *, (SELECT count(*) FROM p6 WHERE y IS NOT NULL AND (p10 IS NULL OR p50 IS NULL OR p90 IS NULL)) AS n_incomplete FROM (SELECT 'rel pooled hl6' AS fit, 'all' AS group_key, n, round(q, 6) AS q_lo, round(q, 6) AS q_hi FROM ({_weighted('pool', "'all'", 's_rel', 'w6', f'{LEVEL} * (tot + 1)')}) UNION ALL
  SELECT 'scaled horizon eq', CAST(g AS VARCHAR), n, round(q, 6), round(q, 6) FROM ({_kth('pool', 'horizon', 's_scaled', LEVEL)}) UNION ALL
  SELECT 'asym horizon hl6', CAST(h.g AS VARCHAR), h.n, round(-l.q, 6), round(h.q, 6) FROM ({_weighted('pool', 'horizon', 's_asym', 'w6', f'{_A2} * (tot + 1)')}) h JOIN ({_weighted('pool', 'horizon', '-s_asym', 'w6', f'{_A2} * (tot + 1)')}) l ON h.g = l.g)""", POOL))
def _(t):
    specs = [K.Spec("rel pooled hl6", "relative", half_life=6.0), K.Spec("scaled horizon eq", "scaled", "horizon"), K.Spec("asym horizon hl6", "asym_relative", "horizon", half_life=6.0)]
    return plain(K.fit(resolved(t), specs).select(F.col("candidate").alias("fit"), "group_key", "n", "q_lo", "q_hi", "n_incomplete"), "q_lo", "q_hi")


# The sequential rule as a recursion over months: what was seen before each month, and the month's own scores, as lists.
_CLIP = "least(greatest({a}, (1.0 + 1e-9) / ({n} + 1)), 0.5)"
_MONTH = "year(ts) * 12 + month(ts)"
_SIDES = {("aci scaled", "both"): (f"1 - {LEVEL}::DOUBLE", "s_scaled"), ("aci asym", "lo"): (f"(1 - {LEVEL}::DOUBLE) / 2", "-s_asym"), ("aci asym", "hi"): (f"(1 - {LEVEL}::DOUBLE) / 2", "s_asym")}
_NEEDED = f"CAST(ceil((len(past) + 1) * (1.0 - {_CLIP.format(a='alpha', n='len(past)')})) AS BIGINT)"
_ACI = {
    "sc": " UNION ALL ".join(f"SELECT '{c}' AS cand, '{side}' AS side, {target} AS target, {_MONTH} AS m, {score} AS s FROM pool" for (c, side), (target, score) in _SIDES.items()),
    "mo": "SELECT cand, side, any_value(target) AS target, m, list(s) AS now, row_number() OVER (PARTITION BY cand, side ORDER BY m) - 1 AS i FROM sc GROUP BY cand, side, m",
    "seen": "SELECT mo.cand, mo.side, mo.i, any_value(mo.target) AS target, any_value(mo.now) AS now, list_sort(list(sc.s)) AS past FROM mo JOIN sc ON sc.cand = mo.cand AND sc.side = mo.side AND sc.m < mo.m GROUP BY mo.cand, mo.side, mo.i",
    "aci": f"""SELECT cand, side, CAST(1 AS BIGINT) AS i, target AS alpha FROM mo WHERE i = 0 UNION ALL
      SELECT cand, side, i + 1, clipped + 0.1 * (target - CASE WHEN needed > len(past) THEN 0 ELSE len(list_filter(now, lambda x: x > past[needed])) / len(now) END)
      FROM (SELECT a.cand, a.side, a.i, target, past, now, {_CLIP.format(a='alpha', n='len(past)')} AS clipped, {_NEEDED} AS needed FROM aci a JOIN seen p ON p.cand = a.cand AND p.side = a.side AND p.i = a.i)""",
    "total": "SELECT cand, side, list_sort(list(s)) AS past FROM sc GROUP BY 1, 2",
    "last": f"""SELECT cand, side, {_CLIP.format(a='alpha', n='len(past)')} AS alpha, past FROM (SELECT cand, side, arg_max(alpha, i) AS alpha FROM aci GROUP BY 1, 2) JOIN total USING (cand, side)""",
    "fitted": "SELECT cand, side, alpha, len(past) AS n, coalesce(past[CAST(ceil((len(past) + 1) * (1.0 - alpha)) AS BIGINT)], 1e12) AS q FROM last",
}


@query("cal_fit_aci", with_(["p6"], """SELECT cand AS candidate, 'all' AS group_key, round(coalesce(max(q) FILTER (side = 'both'), -max(q) FILTER (side = 'lo')), 6) AS q_lo, round(max(q) FILTER (side <> 'lo'), 6) AS q_hi, max(n) AS n, CAST(max(n) AS DOUBLE) AS weight_sum,
  (SELECT count(*) FROM p6 WHERE y IS NOT NULL AND (p10 IS NULL OR p50 IS NULL OR p90 IS NULL)) AS n_incomplete, round(max(alpha) FILTER (side <> 'hi'), 6) AS alpha_lo, round(max(alpha) FILTER (side <> 'lo'), 6) AS alpha_hi FROM fitted GROUP BY cand""", {**POOL, **_ACI}).replace("WITH ", "WITH RECURSIVE ", 1))
def _(t):
    specs = [K.Spec("aci scaled"), K.Spec("aci asym", "asym_relative")]
    return plain(K.fit_adaptive(X.p6(t), TRAIN_END, specs), "q_lo", "q_hi", "weight_sum", "alpha_lo", "alpha_hi")


_SHIFT = f"""SELECT b.g AS group_key, round(b.q - w.q, 6) AS q_lo, round(b.q + w.q, 6) AS q_hi, round(b.q, 6) AS bias, round(w.q, 6) AS width, {flag('abs(b.q) > w.q', 'clipped')}, w.n"""


@query("cal_fit_shift", with_(["p6"], f"""{_SHIFT} FROM b JOIN ({_weighted('(SELECT pool.*, abs(s_asym - b.q) AS dev FROM pool JOIN b ON b.g = CAST(horizon AS VARCHAR))', 'CAST(horizon AS VARCHAR)', 'dev', 'w6', f'{LEVEL} * (tot + 1)')}) w ON w.g = b.g""",
  {**POOL, "b": _weighted("pool", "CAST(horizon AS VARCHAR)", "s_asym", "power(0.5::DOUBLE, age / 4.0::DOUBLE)", "0.5 * tot")}))
def _(t):
    s = K.fit_shift(X.p6(t), TRAIN_END, "horizon", LEVEL, 4.0, 6.0)
    return plain(s.select("group_key", "q_lo", "q_hi", "bias", "width", "clipped", "n"), "q_lo", "q_hi", "bias", "width")


_SEEN = "SELECT a.oi, p.s_asym, power(0.5::DOUBLE, (a.oi - (year(p.ts) * 12 + month(p.ts))) / 4.0::DOUBLE) AS w FROM (SELECT DISTINCT year(origin) * 12 + month(origin) AS oi FROM pool) a JOIN pool p ON year(p.ts) * 12 + month(p.ts) <= a.oi"


@query("cal_fit_shift_origin", with_(["p6"], f"""{_SHIFT}, (SELECT count(*) FROM dev WHERE dev IS NULL) AS n_no_bias FROM b JOIN ({_weighted('(SELECT * FROM dev WHERE dev IS NOT NULL)', "'all'", 'dev', 'w6', f'{LEVEL} * (tot + 1)')}) w ON w.g = b.g""",
  {**POOL, "b": _weighted("pool", "'all'", "s_asym", "power(0.5::DOUBLE, age / 4.0::DOUBLE)", "0.5 * tot"), "seen": _SEEN, "bo": _weighted("seen", "oi", "s_asym", "w", "0.5 * tot"),
   "dev": "SELECT pool.*, abs(s_asym - bo.q) AS dev FROM pool LEFT JOIN bo ON bo.g = year(origin) * 12 + month(origin)"}))
def _(t):
    s = K.fit_shift(X.p6(t), TRAIN_END, "pooled", LEVEL, 4.0, 6.0, bias_at="origin")
    return plain(s.select("group_key", "q_lo", "q_hi", "bias", "width", "clipped", "n", "n_no_bias"), "q_lo", "q_hi", "bias", "width")


# Each scored month's rows as a list, the pool's scores with their running weight as another.
_LOW = "CASE WHEN {r}p50 = {r}p10 THEN {r}p50 ELSE {r}p50 - q * ({r}p50 - {r}p10) END"
_HIGH = "CASE WHEN {r}p90 = {r}p50 THEN {r}p50 ELSE {r}p50 + q * ({r}p90 - {r}p50) END"
_BANDS = {"lo": f"greatest(least({_LOW}, {{r}}p50), 0)", "hi": f"greatest({_HIGH}, {{r}}p50)"}
_MISSED = " OR ".join(f"coalesce(x.y {sign} {_BANDS[k].format(r='x.')}, false)" for k, sign in (("lo", "<"), ("hi", ">")))
_AT = f"coalesce(list_filter(runs, lambda x: x.cum >= (1.0 - {_CLIP.format(a='alpha', n='tot')}) * (tot + 1.0) * (1 - 1e-12))[1].s, 'inf'::DOUBLE)"
_WITHIN = {
    "cum": "SELECT s_scaled AS s, sum(sum(w6)) OVER (ORDER BY s_scaled ROWS UNBOUNDED PRECEDING) AS cum FROM pool WHERE s_scaled IS NOT NULL GROUP BY s_scaled",
    "runs": "SELECT list(struct_pack(s := s, cum := cum) ORDER BY s) AS runs, max(cum) AS tot FROM cum",
    "months": "SELECT row_number() OVER (ORDER BY ts) AS i, ts, list(struct_pack(y := y, p10 := p10, p50 := p50, p90 := p90)) AS rows FROM scored GROUP BY ts",
    "steps": f"""SELECT CAST(1 AS BIGINT) AS i, 1 - {LEVEL}::DOUBLE AS alpha UNION ALL SELECT i + 1, clipped + 0.1 * (1 - {LEVEL}::DOUBLE - len(list_filter(rows, lambda x: {_MISSED})) / len(rows))
      FROM (SELECT steps.i, rows, {_CLIP.format(a='alpha', n='tot')} AS clipped, {_AT} AS q FROM steps JOIN months ON months.i = steps.i, runs)""",
    "levels": f"SELECT months.ts, {_AT} AS q FROM steps JOIN months ON months.i = steps.i, runs",
}


@query("cal_within_window_aci", with_(["p6", "scored"], f"SELECT 'hl6' AS candidate, s.series, s.ts, s.y, round({_BANDS['lo'].format(r='s.')}, 4) AS p10, round(s.p50, 4) AS p50, round({_BANDS['hi'].format(r='s.')}, 4) AS p90 FROM scored s JOIN levels USING (ts)", {**POOL, **_WITHIN}).replace("WITH ", "WITH RECURSIVE ", 1))
def _(t):
    out = K.adaptive_within_window(X.p6(t), X.scored(t), TRAIN_END, [K.Spec("hl6", "scaled", half_life=6.0)])
    return rnd(out.select("candidate", "series", "ts", "y", "p10", "p50", "p90"), 4, "p10", "p50", "p90")


_CUT = "CASE WHEN k = 0 THEN TIMESTAMP '1999-12-31' ELSE CAST(last_day(DATE '1999-12-31' + to_months(k)) AS TIMESTAMP) END"


@query("cal_monthly_recal", with_(["p6", "scored"], f"""SELECT s.series, s.ts, round(greatest(s.p50 * (1 - least(q.q, 1e12)), 0), 4) AS p10, round(s.p50 * (1 + q.q), 4) AS p90 FROM scored s JOIN cuts c ON c.ts = s.ts JOIN ({_kth('(SELECT f.*, c.cutoff FROM full_pool f JOIN cuts c ON f.origin < c.cutoff AND f.ts <= c.cutoff)', 'cutoff', 's', LEVEL)}) q ON q.g = c.cutoff""",
  {"cuts": f"SELECT ts, {_CUT} AS cutoff FROM (SELECT ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT ts FROM scored))",
   "full_pool": f"SELECT series, ts, origin, {_REL} AS s FROM p6 WHERE y IS NOT NULL AND p50 IS NOT NULL UNION ALL SELECT series, ts, origin, {_REL} FROM scored WHERE y IS NOT NULL AND p50 IS NOT NULL"}))
def _(t):
    full = X.p6(t).unionByName(X.scored(t))
    out = K.monthly_recalibration(full, X.scored(t), TRAIN_END, [K.Spec("recal", "relative")])
    return rnd(out.select("series", "ts", "p10", "p90"), 4, "p10", "p90")


@query("cal_run", with_(["scored"], f"""SELECT 'none' AS run, 'own band' AS interval_method, count(*) AS n, count(p10) AS n_bands, round(sum(p10), 2) AS p10 FROM scored UNION ALL
  SELECT 'split', 'split relative/pooled', count(*), count(*), round(sum(greatest(s.p50 * (1 - q), 0)), 2) FROM scored s, ({_kth('(SELECT * FROM (SELECT *, ' + _REL + ' AS s FROM scored) WHERE y IS NOT NULL)', "'all'", 's', LEVEL)}) UNION ALL SELECT 'broken', 'FAILED', count(*), 0, NULL FROM scored"""))
def _(t):
    s, spec = X.scored(t), K.Spec("run", "relative")
    broken = s.withColumn("p10", F.when(F.col("series") != 3, F.col("p10")))
    runs = {
        "none": B.calibrate(s, s, spec, "none", TRAIN_END),
        "split": B.calibrate(s, s, spec, "split", TRAIN_END),
        "broken": B.calibrate(s, broken, spec, "split", TRAIN_END),
    }
    out = None
    for name, df in runs.items():
        row = df.groupBy("interval_method").agg(F.count(F.lit(1)).alias("n"), F.count("p10").alias("n_bands"), F.round(F.sum("p10"), 2).alias("p10")).withColumn("run", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("cal_station_folds", with_(["scored"], """SELECT series, ts, fold, round(greatest(p50 * (1 - q), 0), 4) AS p10, round(p50 * (1 + q), 4) AS p90 FROM f JOIN (SELECT k.fold AS kf, coalesce(list_sort(list(s))[CAST(ceil((count(*) + 1) * 0.8::DOUBLE) AS BIGINT)], 1e12) AS q FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY 1) ON kf = fold""",
  {"f": f"SELECT scored.*, {_REL} AS s, (dense_rank() OVER (ORDER BY CAST(series AS VARCHAR)) - 1) % 5 AS fold FROM scored WHERE y IS NOT NULL"}))
def _(t):
    return rnd(K.cross_fit(X.scored(t), "relative", "pooled").select("series", "ts", "fold", "p10", "p90"), 4, "p10", "p90")


CAND_WINDOWS = {"B": "1999-06-30", "V": TRAIN_END}


def candidate_frames(t):
    """Pools and scored rows of two windows with a window column."""
    pool = X.p6(t)
    both = pool.withColumn("window", F.explode(F.array(F.lit("B"), F.lit("V"))))
    b = pool.where(F.col("origin") == ts_lit("1999-06-30")).withColumn("window", F.lit("B"))
    return both, b.unionByName(X.scored(t).withColumn("window", F.lit("V")))


_CS = """round(100 * avg(CAST(y >= lo AND y <= hi AS INTEGER)), 2) AS coverage, round(100 * sum((hi - lo) + 10 * (CASE WHEN y < lo THEN lo - y WHEN y > hi THEN y - hi ELSE 0 END)) / sum(y), 2) AS interval_score"""


@query("cal_candidates", with_(["p6", "scored"], f"""SELECT "window", 'rolling_eq relative/pooled' AS candidate, count(*) AS n, {_CS} FROM (SELECT s.*, greatest(p50 * (1 - q), 0) AS lo, p50 * (1 + q) AS hi FROM sw s JOIN ({_kth('pw', '"window"', 's_rel', LEVEL)}) q ON q.g = s."window") GROUP BY 1
  UNION ALL SELECT "window", 'rolling_hl6 relative/pooled', count(*), {_CS} FROM (SELECT s.*, greatest(p50 * (1 - q), 0) AS lo, p50 * (1 + q) AS hi FROM sw s JOIN ({_weighted('pw', '"window"', 's_rel', 'w', f'{LEVEL} * (tot + 1)')}) q ON q.g = s."window") GROUP BY 1
  UNION ALL SELECT "window", 'incumbent', count(*), {_CS} FROM (SELECT *, p10 AS lo, p90 AS hi FROM sw) GROUP BY 1""",
  {"pw": f"""SELECT w AS "window", p6.*, {_REL} AS s_rel, power(0.5::DOUBLE, (wi - (year(ts) * 12 + month(ts))) / 6.0::DOUBLE) AS w FROM p6, (VALUES ('B', TIMESTAMP '1999-06-30', 1999 * 12 + 6), ('V', TIMESTAMP '1999-12-31', 1999 * 12 + 12)) v(w, at_, wi) WHERE origin < at_ AND ts <= at_ AND y IS NOT NULL AND p50 IS NOT NULL""",
   "sw": """SELECT 'B' AS "window", series, ts, y, p10, p50, p90 FROM p6 WHERE origin = TIMESTAMP '1999-06-30' AND p50 IS NOT NULL UNION ALL SELECT 'V', series, ts, y, p10, p50, p90 FROM scored"""}))
def _(t):
    pool, scored = candidate_frames(t)
    specs = [K.Spec("rolling_hl6 relative/pooled", "relative", "pooled", LEVEL, 6.0), K.Spec("rolling_eq relative/pooled", "relative")]
    return B.calibration_candidates(pool, scored, CAND_WINDOWS, specs).select("window", "candidate", "n", "coverage", "interval_score")


_ALL = {
    "pwa": f"""SELECT w AS "window", p6.*, {_SCALED} AS s_scaled, {_REL} AS s_relative, {_ASYM} AS s_asym_relative, power(0.5::DOUBLE, (wi - (year(ts) * 12 + month(ts))) / 6.0::DOUBLE) AS w FROM p6, (VALUES ('B', TIMESTAMP '1999-06-30', 1999 * 12 + 6), ('V', TIMESTAMP '1999-12-31', 1999 * 12 + 12)) v(w, at_, wi) WHERE origin < at_ AND ts <= at_ AND y IS NOT NULL""",
    "swa": """SELECT 'B' AS "window", series, ts, horizon, y, p10, p50, p90 FROM p6 WHERE origin = TIMESTAMP '1999-06-30' UNION ALL SELECT 'V', series, ts, horizon, y, p10, p50, p90 FROM scored""",
}


def _candidate(spec) -> str:
    """The scored rows with one candidate's bands."""
    group = "'all'" if spec.group == "pooled" else "CAST(horizon AS VARCHAR)"
    key = f"""\"window\" || '/' || {group}"""
    level = 1 - (1 - spec.level) / 2 if spec.method == "asym_relative" else spec.level

    def quantile(score):
        return _kth("pwa", key, score, level) if spec.half_life is None else _weighted("pwa", key, score, "w", f"{level!r}::DOUBLE * (tot + 1)")

    low, high = (f"-s_{spec.method}", f"s_{spec.method}") if spec.method == "asym_relative" else (f"s_{spec.method}",) * 2
    bands = {
        "scaled": ("CASE WHEN p50 = p10 THEN p50 ELSE p50 - l.q * (p50 - p10) END", "CASE WHEN p90 = p50 THEN p50 ELSE p50 + h.q * (p90 - p50) END"),
        "relative": ("p50 * (1 - l.q)", "p50 * (1 + h.q)"), "asym_relative": ("p50 * (1 - l.q)", "p50 * (1 + h.q)"),
    }[spec.method]
    return f"""SELECT \"window\", '{spec.name}' AS candidate, ts, y, p50, greatest(least({bands[0]}, p50), 0) AS p10, greatest({bands[1]}, p50) AS p90
      FROM (SELECT *, {key} AS g FROM swa) s JOIN ({quantile(low)}) l ON l.g = s.g JOIN ({quantile(high)}) h ON h.g = s.g"""


_ALL["banded"] = " UNION ALL ".join([*map(_candidate, B.candidate_specs()), "SELECT \"window\", 'incumbent', ts, y, p50, p10, p90 FROM swa"])


@query("cal_candidates_all", with_(["p6", "scored"], f"""SELECT * REPLACE (least(interval_score, 1e12) AS interval_score) FROM ({interval_sql('"window", candidate', 'banded')})""", _ALL))
def _(t):
    pool, scored = candidate_frames(t)
    out = B.calibration_candidates(pool, scored, CAND_WINDOWS, B.candidate_specs())
    return out.withColumn("interval_score", F.least("interval_score", F.lit(BIG)))


@query("cal_save_load", with_(["p6"], f"SELECT CAST(g AS VARCHAR) AS group_key, n, round(q, 6) AS q_lo, round(q, 6) AS q_hi FROM ({_kth('pool', 'horizon', 's_scaled', LEVEL)})", POOL))
def _(t):
    from ..session import scratch_dir

    cal = K.fit(resolved(t), [K.Spec("rolling", "scaled", "horizon")])
    path, prov = scratch_dir(t.spark, "calibrator"), {"model": "naive", "method": "scaled", "group": "horizon", "level": LEVEL, "as_of": TRAIN_END, "checkpoint": None}
    K.save_calibrator(cal, path, **prov)
    return plain(K.load_calibrator(t.spark, path, **prov).select("group_key", "n", "q_lo", "q_hi"), "q_lo", "q_hi")


_SERVED_MODELS = "(VALUES ('naive', 'served'), ('own', 'own band'), ('stale', 'calibrator differs in as_of'), ('lost', 'no calibrator'), ('new', 'no plan')) AS v(model, state)"


@query("cal_serve_bands", with_(["p1", "p6", "scored"], f"""SELECT model, series, ts, p50, p10_raw, p90_raw, status, horizon, CASE status WHEN 'served' THEN lo WHEN 'own band' THEN round(p10_raw, 4) END AS p10, CASE status WHEN 'served' THEN hi WHEN 'own band' THEN round(p90_raw, 4) END AS p90
  FROM (SELECT *, CASE WHEN horizon < 1 THEN 'at or before the origin' WHEN state = 'served' AND (p10_raw IS NULL OR q IS NULL) THEN 'no band for this group' ELSE state END AS status,
    round(greatest(least(CASE WHEN p50 = p10_raw THEN p50 ELSE p50 - q * (p50 - p10_raw) END, p50), 0), 4) AS lo, round(greatest(CASE WHEN p90_raw = p50 THEN p50 ELSE p50 + q * (p90_raw - p50) END, p50), 4) AS hi
    FROM (SELECT model, state, c.*, qh.q FROM calls c CROSS JOIN {_SERVED_MODELS} LEFT JOIN qh ON qh.g = c.horizon))""",
  {**_FITQ, "calls": """SELECT series, ts, p10 AS p10_raw, p50, p90 AS p90_raw, horizon FROM scored UNION ALL
    SELECT series, ts, y * 0.5, y, y * 2, (year(ts) * 12 + month(ts)) - (1999 * 12 + 12) FROM p1 WHERE year(ts) = 1999"""}))
def _(t):
    """Five models: a matching calibrator, the own band, a calibrator fitted on other data, none at all, and one without a plan."""
    from ..session import scratch_dir

    past = X.p1(t).where(F.year("ts") == 1999).select("series", "ts", (F.col("y") * 0.5).alias("p10"), F.col("y").alias("p50"), (F.col("y") * 2).alias("p90"))
    calls = X.scored(t).select("series", "ts", "p10", "p50", "p90").unionByName(past)
    preds = calls.withColumn("model", F.explode(F.array(*[F.lit(m) for m in ("naive", "own", "stale", "lost", "new")])))
    spec, prov = K.Spec("rolling", "scaled", "horizon"), {"method": "scaled", "group": "horizon", "level": LEVEL, "as_of": TRAIN_END}
    path = scratch_dir(t.spark, "calibrators")
    for name, as_of in (("naive", TRAIN_END), ("stale", "1998-12-31")):
        cal = K.fit(resolved(t), [K.Spec(name, "scaled", "horizon")])
        K.save_calibrator(cal, f"{path}/{name}", **prov | {"model": name, "as_of": as_of})
    saved = t.spark.read.parquet(f"{path}/naive", f"{path}/stale")
    plans = {"naive": spec, "stale": spec, "lost": spec, "own": None}
    out = K.serve_bands(preds, saved, plans, {m: prov | {"model": m} for m in plans}, TRAIN_END)
    return rnd(out, 4, "p10", "p90").select("model", "series", "ts", "p50", "p10_raw", "p90_raw", "status", "horizon", "p10", "p90")
