"""Plan shape and hot keys."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelsmith.catalog import load
from panelsmith.catalog.registry import ORACLES, QUERIES, Tables, tidy
from panelsmith.operators import order_stats as OS
from panelsmith.operators.ordered import quantile_cuts, with_piece
from panelsmith.operators.events import event_profile

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["win_lag_calendar", "win_roll_rows", "join_event_window", "near_events", "agg_weather_monthly", "agg_describe", "cal_fit_rolling", "cal_apply", "cal_fit_shift", "fc_rolling_pool", "m_slices", "match_place_name", "gate_tracked_differences", "od_from_cells"])
def test_no_cartesian_and_pruned_scans(spark, name):
    load()
    text = plan(tidy(QUERIES[name](Tables(spark, SMALL))))
    assert "CartesianProduct" not in text
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        # No query needs a whole wide fact table.
        assert "l_tax" not in schema and "o_orderpriority" not in schema or name in ("agg_describe",)


def test_date_bounds_reach_the_scan(spark):
    load()
    text = plan(QUERIES["date_range"](Tables(spark, SMALL)))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)


def test_every_query_is_named_after_an_operator():
    load()
    assert len(QUERIES) > 230 and set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if re.match(r"op\d", n) or n == "pipeline"]


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert [r.model for r in entry(spark).orderBy("rank").collect()]


def test_hot_values_are_split(spark):
    # Half the rows share one value and one group: the columns behind it cut them, so every piece of the running sum stays small.
    pdf = pd.DataFrame({"g": "hot", "v": np.where(np.arange(20000) % 2, 5.0, np.arange(20000) / 7), "k": np.arange(20000)})
    df = spark.createDataFrame(pdf)
    out = OS.positions_by_value(df, ["g"], "v", ["k"], "pos").toPandas().sort_values("pos")
    want = pdf.sort_values(["v", "k"])
    assert (out["k"].to_numpy() == want["k"].to_numpy()).all()
    key = F.struct("v", "k")
    cells = with_piece(df, key, quantile_cuts(df, key, distinct=False), "p").groupBy("p").count().agg(F.max("count")).first()[0]
    assert cells < 250


def test_crowded_hour_makes_no_pairs(spark):
    # Thousands of events and times inside one hour: a pair join would produce their product.
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(t0 + dt.timedelta(milliseconds=3 * i), t0 + dt.timedelta(hours=1, milliseconds=3 * i), i % 5 == 0) for i in range(4000)], "timestamp_start timestamp_ntz, timestamp_end timestamp_ntz, is_sharks_game boolean")
    pts = spark.createDataFrame([(t0 + dt.timedelta(milliseconds=4 * i + 1),) for i in range(3000)], "ts timestamp_ntz")
    r = {x.ts: x.n_active for x in event_profile(pts, ev).collect()}
    assert len(r) == 3000 and set(r.values()) == {4000}
