"""Calibration against direct NumPy formulas on a small skewed pool."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelsmith.operators import calibration as K

AS_OF = "2024-12-31"


def month(i):
    return dt.datetime(i // 12, i % 12 + 1, 1)


def pool_rows(seed=0, series=12, origins=10, horizon=4):
    rng = np.random.default_rng(seed)
    last = 2024 * 12 + 11
    out = []
    for o in range(last - origins, last):
        end = month(o + 1) - dt.timedelta(days=1)
        for s in range(series):
            for h in range(1, horizon + 1):
                p50 = float(rng.uniform(500, 1500))
                y = p50 * (1 + 0.03 * h * rng.normal()) + 20
                out.append((f"S{s}", month(o + h), float(y), end, h, p50 * 0.95, p50, p50 * 1.05))
    return pd.DataFrame(out, columns=["series", "ts", "y", "origin", "horizon", "p10", "p50", "p90"])


@pytest.fixture(scope="module")
def pool(spark):
    pdf = pool_rows()
    df = spark.createDataFrame(pdf).withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "origin": F.col("origin").cast("timestamp_ntz")})
    return pdf, df


def resolved(pdf):
    at = pd.Timestamp(AS_OF)
    r = pdf[(pdf.origin < at) & (pdf.ts <= at)].copy()
    r["age"] = (at.year * 12 + at.month) - (r.ts.dt.year * 12 + r.ts.dt.month)
    return r


def scores(r, method):
    e = (r.y - r.p50) / r.p50
    if method == "asym_relative":
        return e.to_numpy()
    if method == "relative":
        return e.abs().to_numpy()
    return np.maximum((r.p50 - r.y) / (r.p50 - r.p10), (r.y - r.p50) / (r.p90 - r.p50)).to_numpy()


def kth(s, level):
    k = math.ceil((len(s) + 1) * level)
    return math.inf if k > len(s) else np.sort(s)[k - 1]


def weighted(s, w, level):
    o = np.argsort(s)
    hit = np.cumsum(w[o]) >= level * (w.sum() + 1)
    return s[o][hit.argmax()] if hit.any() else math.inf


def rows(df):
    return {r.group_key: (r.q_lo, r.q_hi) for r in df.collect()}


@pytest.mark.parametrize("method", K.METHODS)
@pytest.mark.parametrize("group", ["pooled", "horizon"])
def test_split_and_rolling(pool, method, group):
    pdf, df = pool
    r = resolved(pdf)
    keys = pd.Series("all", index=r.index) if group == "pooled" else r.horizon.astype(str)
    split = rows(K.fit_split(K.resolved_pool(df, AS_OF), method, group))
    rolling = rows(K.fit_rolling(df, AS_OF, method, group, half_life=6.0))
    equal = rows(K.fit_rolling(df, AS_OF, method, group))
    assert split == equal
    for key in keys.unique():
        part = r[keys == key]
        s, w = scores(part, method), 0.5 ** (part.age.to_numpy() / 6.0)
        if method == "asym_relative":
            want, wantw = (-kth(-s, 0.9), kth(s, 0.9)), (-weighted(-s, w, 0.9), weighted(s, w, 0.9))
        else:
            want, wantw = (kth(s, 0.8),) * 2, (weighted(s, w, 0.8),) * 2
        assert split[key] == pytest.approx(want) and rolling[key] == pytest.approx(wantw)


def test_too_few_scores_give_infinity_and_unseen_groups_null(spark, pool):
    _, df = pool
    few = df.where("series = 'S1' and horizon = 1").limit(3)
    cal = K.fit_split(few, "relative", "series")
    assert rows(cal)["S1"] == (math.inf, math.inf)
    spec = [K.Spec("split", "relative", "series")]
    out = {r.series: r for r in K.apply(df.where("series in ('S1', 'S2')").dropDuplicates(["series"]), cal, spec).collect()}
    assert out["S1"].p10 == 0.0 and out["S1"].p90 == math.inf
    assert out["S2"].p10 is None and out["S2"].p90 is None and out["S2"].p90_raw is not None


def test_apply_orders_bands_and_keeps_p50(pool):
    _, df = pool
    for method in K.METHODS:
        spec = [K.Spec("rolling", method, "horizon", half_life=6.0)]
        out = K.apply(df, K.fit(K.resolved_pool(df, AS_OF), spec), spec).toPandas()
        assert (out.p10 <= out.p50).all() and (out.p50 <= out.p90).all() and (out.p10 >= 0).all()
        assert len(out) == df.count()


def test_zero_half_width_and_zero_p50(spark):
    cal = spark.createDataFrame([("c", "all", float("inf"), float("inf"), 1, 0)], "candidate string, group_key string, q_lo double, q_hi double, n long, n_incomplete long")
    pred = spark.createDataFrame([(1, 10.0, 10.0, 12.0), (2, 0.0, 0.0, 0.0), (3, None, 5.0, 6.0)], "series int, p10 double, p50 double, p90 double")
    s = {r.series: r for r in K.apply(pred, cal, [K.Spec("c", "scaled")]).collect()}
    assert s[1].p10 == 10.0 and s[1].p90 == math.inf and (s[2].p10, s[2].p90) == (0.0, 0.0) and s[3].p10 is None and s[3].p90 == math.inf
    r = {x.series: x for x in K.apply(pred, cal, [K.Spec("c", "relative")]).collect()}
    assert (r[2].p10, r[2].p90) == (0.0, math.inf)


def test_incomplete_window_fails_closed(pool):
    _, df = pool
    broken = df.withColumn("p90", F.when(F.col("series") != "S3", F.col("p90")))
    with pytest.raises(ValueError, match="S3"):
        K.require_complete(broken)
    spec = [K.Spec("split", "scaled")]
    cal = K.fit(broken, spec)
    out = K.labelled(K.apply(df, cal, spec), cal, "split")
    assert out.where("p10 is not null or p90 is not null").count() == 0 and out.select("interval_method").distinct().collect()[0][0] == "FAILED"
    # A missing actual is only left out.
    assert K.fit(df.withColumn("y", F.when(F.col("series") != "S3", F.col("y"))), spec).first().n_incomplete == 0


def test_weighted_median_is_lower_and_order_free(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": "a", "v": rng.integers(0, 6, 40).astype(float), "w": 0.5 ** (rng.integers(0, 8, 40) / 6)})
    o = np.lexsort((pdf.w, pdf.v))
    cum = np.cumsum(pdf.w.to_numpy()[o])
    want = pdf.v.to_numpy()[o][np.searchsorted(cum, 0.5 * cum[-1] * (1 - 1e-12))]
    for seed in (1, 2, 3):
        got = K.weighted_median(spark.createDataFrame(pdf.sample(frac=1, random_state=seed)), ["g"], "v", "w").first()
        assert got["m"] == want


@pytest.mark.parametrize("bias_at", ["as_of", "origin"])
def test_shift(pool, bias_at):
    pdf, df = pool
    r = resolved(pdf)
    e = scores(r, "asym_relative")
    med = lambda v, w: v[np.argsort(v, kind="stable")][np.searchsorted(np.cumsum(w[np.argsort(v, kind="stable")]), 0.5 * w.sum())]
    m = med(e, 0.5 ** (r.age.to_numpy() / 4.0))
    centre = np.full(len(r), m)
    if bias_at == "origin":
        oi, ti = (r.origin.dt.year * 12 + r.origin.dt.month).to_numpy(), (r.ts.dt.year * 12 + r.ts.dt.month).to_numpy()
        centre = np.array([med(e[(oi < o) & (ti <= o)], 0.5 ** ((o - ti[(oi < o) & (ti <= o)]) / 4.0)) if ((oi < o) & (ti <= o)).any() else np.nan for o in oi])
    keep = ~np.isnan(centre)
    w = weighted(np.abs(e - centre)[keep], 0.5 ** (r.age.to_numpy()[keep] / 6.0), 0.8)
    got = K.fit_shift(df, AS_OF, "pooled", 0.8, 4.0, 6.0, bias_at).first()
    assert (got.q_lo, got.q_hi) == pytest.approx((m - w, m + w)) and got.n == keep.sum() and got.n_no_bias == (~keep).sum()
    with pytest.raises(ValueError):
        K.fit_shift(df, AS_OF, "horizon", bias_at="origin")


def adaptive(r, method, gamma=0.1, level=0.8):
    """Month by month, straight from the definition."""
    s, m = scores(r, method), (r.ts.dt.year * 12 + r.ts.dt.month).to_numpy()
    tails = [-s, s] if method == "asym_relative" else [s]
    target = (1 - level) / len(tails)
    alpha = [target] * len(tails)
    clip = lambda a, n: min(max(a, (1 + 1e-9) / (n + 1)), 0.5)
    for cur in np.unique(m)[1:]:
        n = (m < cur).sum()
        alpha = [clip(a, n) for a in alpha]
        alpha = [a + gamma * (target - (t[m == cur] > kth(t[m < cur], 1 - a)).mean()) for a, t in zip(alpha, tails)]
    alpha = [clip(a, len(s)) for a in alpha]
    return alpha, [kth(t, 1 - a) for a, t in zip(alpha, tails)]


def test_adaptive_levels(pool):
    pdf, df = pool
    r = resolved(pdf)
    got = {x.candidate: x for x in K.fit_adaptive(df, AS_OF, [K.Spec("s", "scaled"), K.Spec("a", "asym_relative")]).collect()}
    a, q = adaptive(r, "scaled")
    assert got["s"].alpha_hi == pytest.approx(a[0]) and got["s"].q_hi == pytest.approx(q[0])
    a, q = adaptive(r, "asym_relative")
    assert (got["a"].alpha_lo, got["a"].alpha_hi) == pytest.approx(tuple(a)) and (got["a"].q_lo, got["a"].q_hi) == pytest.approx((-q[0], q[1]))


def test_adaptive_within_window(spark, pool):
    pdf, df = pool
    r = resolved(pdf)
    scored_pdf = pool_rows(9, 12, 1, 4).assign(ts=lambda d: d.ts + pd.DateOffset(months=1))
    scored = spark.createDataFrame(scored_pdf).withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "origin": F.col("origin").cast("timestamp_ntz")})
    s, w = scores(r, "scaled"), 0.5 ** (r.age.to_numpy() / 6.0)
    alpha, want = 0.2, {}
    for t, part in scored_pdf.groupby("ts"):
        alpha = min(max(alpha, (1 + 1e-9) / (w.sum() + 1)), 0.5)
        q = weighted(s, w, 1 - alpha)
        lo, hi = np.maximum(part.p50 - q * (part.p50 - part.p10), 0), part.p50 + q * (part.p90 - part.p50)
        want.update({(x, t): v for x, v in zip(part.series, hi)})
        alpha += 0.1 * (0.2 - (part.y < lo).mean() - (part.y > hi).mean())
    out = K.adaptive_within_window(df, scored, AS_OF, [K.Spec("hl6", "scaled", half_life=6.0)]).collect()
    assert len(out) == len(want)
    for x in out:
        assert x.p90 == pytest.approx(want[(x.series, pd.Timestamp(x.ts))])


def test_folds_exclude_own_series(pool):
    pdf, df = pool
    one = df.where("horizon = 1")
    got = K.cross_fit(one, "relative", "pooled", n_folds=3).select("series", "fold", "p50", "p90").toPandas()
    names = sorted(pdf.series.unique())
    assert dict(zip(got.series, got.fold)) == {s: i % 3 for i, s in enumerate(names)}
    p = pdf[pdf.horizon == 1]
    for f in range(3):
        others = p[~p.series.isin([s for i, s in enumerate(names) if i % 3 == f])]
        q = kth(scores(others, "relative"), 0.8)
        mine = got[got.fold == f]
        np.testing.assert_allclose(mine.p90, mine.p50 * (1 + q))


def test_saved_calibrator_refuses_other_provenance(spark, pool, tmp_path):
    _, df = pool
    path = str(tmp_path / "cal")
    cal = K.fit_split(df.where("series = 'S1'").limit(2), "relative")
    K.save_calibrator(cal, path, model="naive", method="relative", level=0.8)
    back = K.load_calibrator(spark, path, model="naive", level=0.8, checkpoint=None)
    assert back.first().q_hi == math.inf
    for bad in ({"model": "other"}, {"level": 0.9}, {"checkpoint": "x"}):
        with pytest.raises(ValueError):
            K.load_calibrator(spark, path, **bad)


def test_horizon_mismatch_is_listed(pool):
    _, df = pool
    assert K.horizon_mismatches(df).count() == 0
    assert K.horizon_mismatches(df.withColumn("horizon", F.col("horizon") + 1)).count() == df.count()
