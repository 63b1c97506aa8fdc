"""Serving of calibrated bands, names inside names, report texts and ranked correlations against plain rules."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelsmith.operators import aggregates as A
from panelsmith.operators import calibration as K
from panelsmith.operators import places as PL
from panelsmith.sources import reports as R

ORIGIN = "2024-03-31"


def calibrator(spark, rows):
    """Rows (model, group, q, n_incomplete, as_of) as ``save_calibrator`` writes them."""
    df = spark.createDataFrame(rows, "candidate string, group_key string, q_lo double, n_incomplete long, prov_as_of string").withColumn("q_hi", F.col("q_lo"))
    return df.withColumns({f"prov_{k}": F.lit(None).cast("string") for k in K.PROVENANCE if k != "as_of"})


def test_only_bands_that_were_scored_are_served(spark):
    models = ["fits", "own", "stale", "mixed", "broken", "unseen", "lost", "unplanned"]
    months = [dt.datetime(2024, 3, 1), dt.datetime(2024, 4, 1)]
    preds = spark.createDataFrame([(m, "A", t, 90.0, 100.0, 120.0) for m in models for t in months], "model string, series string, ts timestamp_ntz, p10 double, p50 double, p90 double")
    saved = calibrator(spark, [
        ("fits", "all", 0.5, 0, ORIGIN), ("stale", "all", 0.5, 0, "2023-12-31"), ("mixed", "all", 0.5, 0, ORIGIN), ("mixed", "other", 0.5, 0, "2023-12-31"),
        ("broken", "all", 0.5, 3, ORIGIN), ("unseen", "5", 0.5, 0, ORIGIN), ("own", "all", 9.0, 0, ORIGIN),
    ])
    plans = {m: K.Spec(m, "relative", "horizon" if m == "unseen" else "pooled") for m in models if m not in ("own", "unplanned")} | {"own": None}
    out = K.serve_bands(preds, saved, plans, {m: {"as_of": ORIGIN} for m in plans}, ORIGIN).collect()
    assert {r.status for r in out if r.ts == months[0]} == {"at or before the origin"} and all(r.p10 is None and r.p50 == 100 and r.p10_raw == 90 for r in out if r.ts == months[0])
    later = {r.model: r for r in out if r.ts == months[1]}
    assert {m: r.status for m, r in later.items()} == {
        "fits": "served", "own": "own band", "stale": "calibrator differs in as_of", "mixed": "calibrator differs in as_of", "broken": "no band for this group", "unseen": "no band for this group",
        "lost": "no calibrator", "unplanned": "no plan",
    }
    assert (later["fits"].p10, later["fits"].p90, later["own"].p10, later["own"].p90) == (50.0, 150.0, 90.0, 120.0)
    assert all(r.p10 is None and r.p90 is None for m, r in later.items() if m not in ("fits", "own"))
    assert K.serve_bands(preds.limit(0), saved, plans, {}, ORIGIN).count() == 0


def test_names_inside_names_with_a_word_that_most_names_use(spark):
    rng = np.random.default_rng(3)
    rare = [f"w{i}" for i in range(40)]
    stations = {f"S{i}": " ".join(["Park", *rng.choice(rare, rng.integers(0, 4), replace=False)] if i % 3 else rng.choice(rare, rng.integers(1, 4), replace=False)) for i in range(150)}
    names = sorted({" ".join(rng.permutation([*rng.choice(rare, rng.integers(0, 4), replace=False), *(["Park"] if rng.random() < 0.4 else [])])) for _ in range(200)} - {""})
    dim = spark.createDataFrame(list(stations.items()), "code string, label string")
    got = {r.q: (r.station, r.tier) for r in PL.match_places(spark.createDataFrame([(n,) for n in names], "q string"), dim, "q", "code", "label", fuzzy=False).collect()}
    words = {c: frozenset(label.lower().split()) for c, label in stations.items()}
    for n in names:
        mine = frozenset(n.lower().split())
        same = [c for c, label in stations.items() if label.lower().split() == n.lower().split()]
        near = sorted(c for c, w in words.items() if mine <= w or w <= mine)
        want = (same[0], "exact") if len(same) == 1 else (near[0] if len(near) == 1 else None, "subset") if near else (None, "none")
        assert got[n] == want, n


def test_reports_are_read_by_place_only(spark):
    texts = {
        "spaced": "In Marc h 20 22 , Calt rain's Av erage Week day Rider ship (AW R) decreased by 1.2 percent to 15,1 00 from March 2021 AWR of 3,500.",
        "follows": "In Feb. 2019, Caltrain’s ridership was estimated as follows: Average Weekday Ridership (AWR) increased 2.0 percent to 64,000 from calibrated February 2018 AWR of 62,000.",
        "no prior": "In Sept 2020, Caltrain’s Average Weekday Ridership (AWR) decreased 90 percent to 3,500 from",
        "no move": "In March 2022, Caltrain’s Average Weekday Ridership (AWR) stayed at 15,100 percent to 3 from",
        "no subject": "In March 2022 the Average Weekday Ridership (AWR) increased 2 percent to 15,100 from",
        "no month": "In Smarch 2022x, Caltrain’s Average Weekday Ridership (AWR) increased 2 percent to 15,100 from",
        "two columns": "Jan. 2021 Jan 2022 % Change Total Ridership 1 2 3 4% Average Weekday Ridership 64,000 3,500 15,100 331.4 %",
        "no totals": "Jan. 2020 Jan. 2021 Jan 2022 % Change Average Weekday Ridership 64,000 3,500 15,100 331.4%",
        "no change": "Jan. 2020 Jan. 2021 Jan 2022 % Change Total Ridership 1 2 3 4% Average Weekday Ridership 64,000 3,500 15,100 tail",
        "nothing": "", "null": None,
    }
    df = spark.createDataFrame(list(texts.items()), "url string, text string")
    got = {}
    for r in R.figures(df).collect():
        got.setdefault(r.url, set()).add((r.month, r.value, r["rank"], r.layout))
    assert got == {
        "spaced": {("2022-03", 15100, 0, "prose"), ("2021-03", 3500, 2, "prose")}, "follows": {("2019-02", 64000, 0, "prose"), ("2018-02", 62000, 2, "prose")},
        "no prior": {("2020-09", 3500, 0, "prose")}, "two columns": {("2022-01", 15100, 0, "table")},
    }


def test_correlations_with_ties_match_pandas(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"y": rng.integers(0, 30, 2000).astype(float), "a": rng.integers(0, 5, 2000).astype(float), "b": rng.normal(1e6, 1, 2000), "c": 1.0})
    pdf["d"] = pdf.y * 2 + rng.normal(0, 5, 2000)
    pdf.loc[::7, "a"] = np.nan
    got = A.correlations(spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None).cast("double"))), "y", ["a", "b", "c", "d"]).toPandas().set_index("feature")
    for c in ("a", "b", "d"):
        part = pdf[[c, "y"]].dropna()
        np.testing.assert_allclose([got.pearson[c], got.spearman[c]], [part[c].corr(part.y), part[c].rank().corr(part.y.rank())], rtol=1e-9, atol=1e-12)
        assert got.n[c] == len(part)
    assert np.isnan(got.pearson["c"]) and np.isnan(got.spearman["c"])


def test_spread_matches_numpy_by_group(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y"], 4000, p=[0.95, 0.05]), "v": np.where(rng.random(4000) < 0.5, 3.0, rng.lognormal(2, 1, 4000))})
    got = A.describe(spark.createDataFrame(pdf), "v", ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        v = np.sort(part.v.to_numpy())
        k = int(len(v) * 0.1)
        want = [*np.quantile(v, [0.25, 0.5, 0.75]), np.median(np.abs(v - np.median(v))), v[k : len(v) - k].mean()]
        np.testing.assert_allclose(got.loc[g, ["q1", "median", "q3", "mad", "trimmed_mean"]].astype(float), want, rtol=1e-9)
