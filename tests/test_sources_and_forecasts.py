"""Files, feeds, reports, forecasters, the stream and holidays."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelsmith.functions.calendar import epoch_seconds, last_closed_month_end, wall_clock
from panelsmith.functions.holidays import federal_holidays
from panelsmith.operators import forecast as FC
from panelsmith.operators import panel as P
from panelsmith.plans import feature_store as FS
from panelsmith.sources import feeds as FD
from panelsmith.sources import files as FL
from panelsmith.sources import od as O
from panelsmith.sources import reports as R
from panelsmith.streaming.stop_visits import read_snapshots, write_visits


def test_holidays_equal_pandas():
    from pandas.tseries.holiday import USFederalHolidayCalendar

    want = set(USFederalHolidayCalendar().holidays("2019-01-01", "2030-12-31").date)
    assert {d for d, _ in federal_holidays()} == want


def test_wall_clock_and_closed_month(spark):
    r = spark.sql("select '2024-01-01 03:30:00' as a, date'2024-03-06' as b, date'2024-03-07' as c").select(
        wall_clock("a", source="UTC").alias("w"), last_closed_month_end("b").alias("x"), last_closed_month_end("c").alias("y"), epoch_seconds(F.lit("1970-01-02 00:00:01.5").cast("timestamp_ntz")).alias("e")
    ).first()
    assert r.w == dt.datetime(2023, 12, 31, 19, 30) and r.x == dt.date(2024, 1, 31) and r.y == dt.date(2024, 2, 29) and r.e == 86401.5


def test_only_exact_month_files_are_read_and_corrupt_covariates_skipped(spark, tmp_path):
    frame = lambda v: pd.DataFrame({"riders": [v]})
    frame(1.0).to_parquet(tmp_path / "bart_od_2024_01.parquet")
    frame(2.0).to_parquet(tmp_path / "bart_od_2024_02.parquet")
    frame(99.0).to_parquet(tmp_path / "bart_od_all_2024_02.parquet")
    assert sorted(r.riders for r in FL.read_matching(spark, str(tmp_path)).collect()) == [1.0, 2.0]
    (tmp_path / "weather_bad.parquet").write_bytes(b"not parquet")
    frame(5.0).to_parquet(tmp_path / "weather_ok.parquet")
    got = FL.read_skipping_corrupt(spark, str(tmp_path), "riders double", "weather_*.parquet").collect()
    assert [r.riders for r in got] == [5.0] and got[0].source_file.endswith("weather_ok.parquet") and (tmp_path / "weather_bad.parquet").exists()
    with pytest.raises(Exception):
        FL.read_matching(spark, str(tmp_path), "weather_bad.parquet").collect()


def test_newest_file_wins_per_row(spark, tmp_path):
    import os

    for name, v, age in (("a", 1.0, 10), ("b", 2.0, 100)):
        p = tmp_path / f"{name}.parquet"
        pd.DataFrame({"k": [1, 2] if name == "b" else [1], "v": v}).to_parquet(p)
        os.utime(p, (1_700_000_000 - age, 1_700_000_000 - age))
    df = FL.with_file_version(spark.read.parquet(str(tmp_path)))
    assert {(r.k, r.v) for r in FL.latest_wins(df, ["k"]).collect()} == {(1, 1.0), (2, 2.0)}


def test_cells_need_ten_codes_for_a_header(spark):
    codes = [f"{a}{b}" for a in "AB" for b in "CDEFGH"]
    cells = [("f", "s", 3, i + 1, c) for i, c in enumerate(codes)] + [("f", "s", 1, 1, "ZZ"), ("f", "s", 4, 0, "12.0"), ("f", "s", 5, 0, "Exits"), ("f", "s", 4, 1, "7"), ("f", "s", 4, 2, "n/a"), ("f", "s", 5, 1, "3")]
    cells += [("f", "few", 0, i + 1, c) for i, c in enumerate(codes[:9])] + [("f", "few", 1, 0, "AC"), ("f", "few", 1, 1, "5")]
    got = O.od_from_cells(spark.createDataFrame(cells, "file string, sheet string, row long, col long, value string")).collect()
    assert [(r.sheet, r.origin, r.destination, r.riders) for r in got] == [("s", "AC", "12", 7.0)]


def test_one_total_block_per_period(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "Total Trips"), (t, "Weekday"), (t.replace(month=2), "Weekday"), (t.replace(month=3), "Total A"), (t.replace(month=3), "total b"), (t.replace(month=4), None)], "period timestamp_ntz, day_type string")
    assert {(r.period.month, r.n_total_blocks) for r in O.total_blocks(df).collect()} == {(2, 0), (3, 2), (4, 0)}


def test_venue_events_tolerate_nulls(spark):
    ev = [
        {"id": "1", "name": "A", "dates": {"start": {"dateTime": "2024-02-01T03:00:00Z"}}, "classifications": [], "priceRanges": [{"max": 50.0}, {"max": None}]},
        {"id": "2", "dates": {"start": {"localDate": "2024-02-03"}}, "classifications": [{"segment": None, "genre": None}]},
        {"id": "3", "dates": {"start": {}}}, {"id": "4", "dates": {"start": {"dateTime": "bad"}}},
        {"id": "5", "name": "S", "dates": {"start": {"dateTime": "2024-07-01T02:00:00Z"}}, "classifications": [{"segment": {"name": "Sports"}, "genre": {"name": "Hockey"}}], "priceRanges": []},
    ]
    docs = spark.createDataFrame([("v", json.dumps({"events": ev}))], "venue string, json string")
    r = {x.event_id: x for x in FD.flatten_venue_events(docs).collect()}
    assert set(r) == {"1", "2", "5"}
    assert r["1"].timestamp_start == dt.datetime(2024, 1, 31, 19) and r["1"].timestamp_end == dt.datetime(2024, 1, 31, 21, 30) and r["1"].event_type == "Other" and r["1"].avg_ticket_price == 50.0
    assert r["2"].timestamp_start == dt.datetime(2024, 2, 3) and r["2"].event_name == "" and r["2"].avg_ticket_price is None
    assert r["5"].timestamp_end - r["5"].timestamp_start == dt.timedelta(hours=3) and r["5"].event_type == "Hockey"


def visit(stop):
    return {"RecordedAtTime": "t", "MonitoredVehicleJourney": {"LineRef": "L", "MonitoredCall": {"StopPointRef": stop}}}


def doc(v):
    return json.dumps({"ServiceDelivery": {"StopMonitoringDelivery": {"MonitoredStopVisit": v}}})


def test_stream_equals_batch(spark, tmp_path):
    src, out, chk = (str(tmp_path / d) for d in ("in", "out", "chk"))
    rows = [("A", doc([visit("1"), visit("2")])), ("B", doc(visit("3"))), ("C", json.dumps({}))]
    batch = spark.createDataFrame(rows, "agency_id string, json string")
    batch.write.parquet(src)
    for _ in range(2):  # a restart adds nothing
        write_visits(read_snapshots(spark, src), out, chk).awaitTermination(120)
    assert sorted(r.stop_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3"] == sorted(r.stop_id for r in FD.flatten_stop_visits(batch).collect())


def test_reports(spark):
    prose = "In January 2019, Caltrain’s Average Weekday Ridership (AWR) decreased 1.2 percent to 65,095 from January 2018 AWR of 65,894."
    table = "x Mar. 2019 Mar. 2021 Mar. 2022 % Change Total Ridership 1 2 3 4% Average Weekday Ridership 64,000* 3,500 15,100 331.4% y"
    df = spark.createDataFrame([("p", prose), ("t", table), ("n", "nothing here")], "url string, text string")
    got = {(r.url, r.month, r.value, r["rank"]) for r in R.figures(df).collect()}
    assert got == {("p", "2019-01", 65095, 0), ("p", "2018-01", 65894, 2), ("t", "2022-03", 15100, 0), ("t", "2021-03", 3500, 2), ("t", "2019-03", 64000, 2)}
    c = spark.createDataFrame([("m", 10, 0, "prose"), ("m", 11, 0, "table"), ("m", 9, 2, "table"), ("x", 1, 0, "prose"), ("x", 2, 0, "prose"), ("o", 7, 2, "prose")], "month string, value long, rank int, layout string")
    r = {x.month: x for x in R.choose(c, ["month"]).collect()}
    assert (r["m"].value, r["x"].value, r["x"].error, r["o"].value) == (11, None, "conflicting values", 7)


def panel(spark, months=40, series=("A", "B")):
    rows = [(s, dt.datetime(2020 + m // 12, m % 12 + 1, 1), float(1000 + 100 * np.sin(m % 12) + 5 * m + 300 * i)) for i, s in enumerate(series) for m in range(months)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double")


def test_seasonal_naive_repeats_and_skips_short_series(spark):
    df = panel(spark)
    short = panel(spark, 8, ("C",))
    train = df.where("ts < timestamp_ntz'2022-05-01'").unionByName(short)
    test = df.where("ts >= timestamp_ntz'2022-05-01'").unionByName(short.select("series", F.lit(dt.datetime(2022, 5, 1)).cast("timestamp_ntz").alias("ts"), "y").limit(1))
    fc = FC.seasonal_naive(train, test).collect()
    y = {(r.series, r.ts): r.y for r in df.collect()}
    assert {r.series for r in fc} == {"A", "B"} and len(fc) == 24
    for r in fc:
        assert r.p50 == y[(r.series, r.ts.replace(year=r.ts.year - 1))] and r.p10 == r.p50 * 0.8


def test_airline_recovers_a_seasonal_trend(spark):
    df = panel(spark, 48)
    fc = FC.fan_out(df, ["series"], FC.airline(6), 24).collect()
    assert {r.status for r in fc} == {"ok"} and len(fc) == 12
    for r in fc:
        m = (r.ts.year - 2020) * 12 + r.ts.month - 1
        assert r.p50 == pytest.approx(1000 + 100 * np.sin(m % 12) + 5 * m + (300 if r.series == "B" else 0), rel=1e-6)
        assert 0 <= r.p10 <= r.p50 <= r.p90


def test_fan_out_isolates_failures(spark):
    def fragile(pdf):
        if pdf["series"].iloc[0] == "B":
            raise RuntimeError("boom")
        return pd.DataFrame({"ts": [pdf["ts"].iloc[-1]], "p10": [1.0], "p50": [float("nan")], "p90": [3.0]})

    r = {x.series: x for x in FC.fan_out(panel(spark), ["series"], fragile).collect()}
    assert r["A"].status == "ok" and r["A"].p50 is None and r["B"].status == "failed" and "boom" in r["B"].error and r["B"].ts is None


def test_rolling_pool_reads_nothing_after_as_of(spark):
    df = panel(spark)
    origins = FC.month_end_origins("2021-12-31", "2022-06-30")
    assert origins[0] == "2021-12-31" and origins[-1] == "2022-05-31"
    pool = FC.rolling_pool(df, origins, 3, "2022-06-30")
    assert pool.agg(F.max("ts")).first()[0] == dt.datetime(2022, 6, 1) and pool.where("p50 is null").count() == 0
    changed = df.withColumn("y", F.when(F.col("ts") > "2022-06-30", -1.0).otherwise(F.col("y")))
    assert pool.exceptAll(FC.rolling_pool(changed, origins, 3, "2022-06-30")).count() == 0
    assert FC.empty_origins(FC.rolling_pool(df, ["2020-06-30"], 3, None), ["2020-06-30"]).count() == 1


def test_interpolation_is_linear_in_time(spark):
    rows = [("A", dt.datetime(2024, 1, 1), 10.0), ("A", dt.datetime(2024, 4, 1), 101.0), ("A", dt.datetime(2024, 5, 1), None)]
    r = {x.ts.month: x.y for x in P.interpolate_months(spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double")).collect()}
    assert r[2] == pytest.approx(10 + 91 * 31 / 91) and r[3] == pytest.approx(10 + 91 * 60 / 91) and r[5] == 101.0


def test_exog_contract(spark):
    df = panel(spark).withColumns({"t": F.month("ts").cast("double"), "c": F.lit(1.0)})
    ok = FC.standardise_exog(df, ["t"], F.lit("2022-12-31").cast("timestamp_ntz")).where("ts <= timestamp_ntz'2022-12-31'").groupBy("series").agg(F.avg("t").alias("m"), F.stddev_pop("t").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in ok)
    assert not any(r.exog_ok for r in FC.standardise_exog(df, ["t", "c"], F.lit("2022-12-31").cast("timestamp_ntz")).collect())


def test_json_records_are_strict(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.23456), (4, None)], "k int, v double")
    got = [json.loads(r.record) for r in FL.json_records(df, ["k"], 2).collect()]
    assert got == [{"k": 1, "v": None}, {"k": 2, "v": None}, {"k": 3, "v": 1.23}, {"k": 4, "v": None}]


def test_publish_only_when_passed_and_changed(spark, tmp_path):
    root, df = str(tmp_path / "s"), panel(spark)
    assert FL.publish_if_passed(df, None, False, root, "r0") == "refused" and not (tmp_path / "s").exists()
    assert FL.publish_if_passed(df, None, True, root, "r1") == "published"
    served = FL.read_published(spark, root)
    assert FL.publish_if_passed(df, served, True, root, "r2") == "unchanged"
    assert FL.publish_if_passed(df.withColumn("y", F.col("y") + 1), served, True, root, "r3") == "published"
    assert FL.read_published(spark, root).agg(F.sum("y")).first()[0] == pytest.approx(df.agg(F.sum("y")).first()[0] + df.count())


def test_splits_need_a_test_end(spark, tmp_path):
    with pytest.raises(ValueError):
        FS.write_splits(panel(spark), str(tmp_path), "2021-12-31", "2022-06-30", None)
    paths = FS.write_splits(panel(spark), str(tmp_path / "x"), "2021-12-31", "2022-06-30", "2022-12-31")
    assert {k: spark.read.parquet(p).count() for k, p in paths.items()} == {"train": 48, "val": 12, "test": 12}


def test_wall_clock_ignores_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = spark.sql("select '2024-07-01T02:00:00Z' as s").select(wall_clock(F.try_to_timestamp("s")).alias("w")).first()
            assert r.w == dt.datetime(2024, 6, 30, 19)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
