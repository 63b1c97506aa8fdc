"""Sources, sinks and ingestion.

Feeds and workbooks are derived from the shared tables by Spark: documents are
built with ``to_json``, wide matrices by pivoting, cells by numbering.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import hour_start
from ..operators import metrics as M
from ..session import scratch_dir
from ..sources import feeds as FD
from ..sources import files as FL
from ..sources import od as O
from ..sources import reports as R
from . import fixtures as X
from .common import flag, rnd
from .fixtures import with_
from .registry import query


def named_files(df, column: str, folder: str, kind: str = "parquet") -> str:
    """One file of a kind for each value of ``column``, named by it: Spark writes a folder a value, its file is then moved up."""
    spark, staged = df.sparkSession, scratch_dir(df.sparkSession, "staged")
    df.repartition(column).write.partitionBy(column).format(kind).save(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(folder))
    for found in files.globStatus(hadoop.Path(f"{staged}/{column}=*/part-*")):
        files.rename(found.getPath(), hadoop.Path(f"{folder}/{found.getPath().getParent().getName().partition('=')[2]}"))
    return folder


@query("src_od_months", "SELECT 'bart_od_' || strftime(l_shipdate, '%Y_%m') || '.parquet' AS file_name, count(*) AS n, sum(l_quantity) AS riders FROM lineitem GROUP BY 1")
def _(t):
    # A file a month, and beside them one a year that holds the same rows again.
    rows = t.lineitem.select("l_quantity", F.concat(F.lit("bart_od_"), F.date_format("l_shipdate", "yyyy_MM"), F.lit(".parquet")).alias("file"))
    years = t.lineitem.select("l_quantity", F.concat(F.lit("bart_od_all_"), F.year("l_shipdate").cast("string"), F.lit(".parquet")).alias("file"))
    folder = named_files(rows.unionByName(years), "file", scratch_dir(t.spark, "od-months"))
    df = FL.read_matching(t.spark, folder).withColumn("file_name", F.col("_metadata.file_name"))
    return df.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("riders"))


@query("src_skip_corrupt", """SELECT 'weather_' || event_type || '.parquet' AS source, 'read' AS status, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1
  UNION ALL SELECT 'weather_damaged_' || r_regionkey || '.parquet', 'skipped', 0, NULL FROM region""")
def _(t):
    folder = named_files(t.events.select("value", F.concat(F.lit("weather_"), "event_type", F.lit(".parquet")).alias("file")), "file", scratch_dir(t.spark, "weather"))
    # Texts under the name of parquet files: what a broken download leaves.
    named_files(t.region.select("r_name", F.concat(F.lit("weather_damaged_"), F.col("r_regionkey").cast("string"), F.lit(".parquet")).alias("file")), "file", folder, "text")
    rows = FL.read_skipping_corrupt(t.spark, folder, "value double", "weather_*.parquet")
    read = rows.groupBy(F.element_at(F.split("source_file", "/"), -1).alias("source")).agg(F.lit("read").alias("status"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    unread = FL.unread_files(t.spark, folder, rows, "weather_*.parquet")
    return read.unionByName(unread.select(F.col("file_name").alias("source"), F.lit("skipped").alias("status"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("total")))


@query("src_latest_wins", with_(["p3"], "SELECT station, ts, temp_f + 100 AS temp_f, 2 AS version FROM p3 WHERE station <> 'error' UNION ALL SELECT station, ts, temp_f, 1 FROM p3 WHERE station = 'error'"))
def _(t):
    old = X.p3(t).select("station", "ts", "temp_f").withColumn("version", F.lit(1))
    new = old.where("station <> 'error'").select("station", "ts", (F.col("temp_f") + 100).alias("temp_f"), F.lit(2).alias("version"))
    return FL.latest_wins(old.unionByName(new), ["station", "ts"], ["version"])


@query("src_latest_wins_files", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice + 2 WHEN o_orderkey % 2 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def _(t):
    # Three fetches, each of fewer orders and with new values; the newest file that has an order wins.
    folder = scratch_dir(t.spark, "fetches")
    for i, (kept, added) in enumerate((("true", 0), ("o_orderkey % 2 = 1", 1), ("o_orderkey % 4 = 1", 2))):
        FL.write_parquet(t.orders.where(kept).select("o_orderkey", (F.col("o_totalprice") + added).alias("o_totalprice")), f"{folder}/fetch_{i}")
    df = t.spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return FL.latest_wins(FL.with_file_version(df), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("src_newest_forecast_file", "SELECT event_id, value FROM events WHERE event_type = (SELECT max(event_type) FROM events)")
def _(t):
    # One folder of part files per event type stands for the forecasts of one run.
    path = scratch_dir(t.spark, "forecasts")
    FL.write_parquet(t.events.select("event_id", "value", F.col("event_type").alias("run")), path, ["run"])
    return FL.read_newest(t.spark, path)


_OD_TEXT = "SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS VARCHAR) AS y, month(l_shipdate) AS m, CASE WHEN s_nationkey < 5 THEN CAST(10 + s_nationkey AS VARCHAR) || '.0' WHEN s_nationkey = 24 THEN 'Exits' ELSE 'st' || s_nationkey END AS o, l_returnflag AS d, CASE WHEN l_linenumber = 4 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


@query("src_csv_od", f"SELECT CAST(make_timestamp(CAST(y AS BIGINT), m, 1, 0, 0, 0) AS TIMESTAMP) AS period, CASE WHEN o LIKE '%.0' THEN substr(o, 1, 2) ELSE upper(o) END AS origin, sum(CAST(r AS DOUBLE)) AS riders, count(*) AS n FROM ({_OD_TEXT}) WHERE CAST(y AS INTEGER) BETWEEN 1996 AND 2000 AND o <> 'Exits' AND r <> 'n/a' AND (length(o) <= 4 OR o LIKE '%.0') GROUP BY 1, 2")
def _(t):
    k = F.col("s_nationkey")
    code = F.when(k < 5, F.concat((k + 10).cast("string"), F.lit(".0"))).when(k == 24, "Exits").otherwise(F.concat(F.lit("st"), k.cast("string")))
    raw = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.year("l_shipdate").cast("string").alias("year"), F.month("l_shipdate").cast("string").alias("month"), F.lit("Total").alias("day_type"),
        code.alias("origin"), code.alias("destination"), F.when(F.col("l_linenumber") == 4, "n/a").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("riders"),
    )
    path = scratch_dir(t.spark, "od-csv")
    FL.write_csv(raw, path)
    return O.read_od_csv(t.spark, path, 1996, 2000).groupBy("period", "origin").agg(F.sum("riders").alias("riders"), F.count(F.lit(1)).alias("n"))


# One workbook sheet per month: rows are exits, columns entries, the header on row 1 or 4, text in some cells.
_CELLS = with_(["p2"], """SELECT CAST(period AS VARCHAR) AS file, day_type AS sheet, chr(65 + CAST(origin AS INTEGER)) || 'X' AS origin, chr(65 + CAST(destination AS INTEGER)) || 'X' AS destination, riders FROM p2
  WHERE (origin + destination) % 9 <> 0 AND (SELECT count(DISTINCT q.origin) FROM p2 q WHERE q.period = p2.period AND q.day_type = p2.day_type) >= 10""")


@query("od_from_cells", _CELLS)
def _(t):
    od = X.p2(t).select(F.date_format("period", "yyyy-MM-dd HH:mm:ss").alias("file"), F.col("day_type").alias("sheet"), "origin", "destination", "riders")
    top = F.when(F.col("sheet") == "Total Trips", 1).otherwise(4)
    code = lambda c: F.concat(F.char(F.col(c) + 65), F.lit("X"))
    cell = lambda r, c, v: F.struct(r.cast("long").alias("row"), c.cast("long").alias("col"), v.cast("string").alias("value"))
    body = od.select("file", "sheet", F.inline(F.array(
        cell(top, F.col("origin") + 1, F.lower(code("origin"))), cell(top + 1 + F.col("destination"), F.lit(0), code("destination")),
        cell(top + 1 + F.col("destination"), F.col("origin") + 1, F.when((F.col("origin") + F.col("destination")) % 9 != 0, F.col("riders").cast("string")).otherwise("-")),
        cell(F.lit(0), F.lit(0), F.lit("Entries")), cell(top, F.lit(40), F.lit("Exits")),
    ))).distinct()
    return O.od_from_cells(body)


_NATIONS = [str(i) for i in range(25)]


@query("od_melt", with_(["p2"], "SELECT k.period, k.origin, CAST(d AS VARCHAR) AS destination, coalesce(sum(riders), 0) AS riders FROM (SELECT DISTINCT period, origin FROM p2) k CROSS JOIN (SELECT unnest(range(20)) AS d) LEFT JOIN p2 ON p2.period = k.period AND p2.origin = k.origin AND p2.destination = d GROUP BY 1, 2, 3"))
def _(t):
    wide = X.p2(t).groupBy("period", "origin").pivot("destination", list(range(25))).agg(F.sum("riders"))
    return O.od_melt(wide, ["period", "origin"], _NATIONS[:20])


@query("od_workbook_union", """SELECT CASE l_returnflag WHEN 'N' THEN 'Total Trips' WHEN 'A' THEN 'Avg Weekday' ELSE 'Avg Saturday' END AS day_type, date_trunc('month', l_shipdate)::TIMESTAMP AS period, year(l_shipdate) AS year, month(l_shipdate) AS month,
  n_name AS origin_name, sum(l_quantity) AS riders, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.col("s_nationkey").alias("origin"), F.col("s_nationkey").alias("destination"), F.col("l_quantity").alias("riders"), "l_returnflag", "l_shipdate")
    sheets = {"Total Trips": "N", "Avg Weekday": "A", "Avg Saturday": "R"}
    names = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    out = O.union_sheets({k: rows.where(F.col("l_returnflag") == f).drop("l_returnflag") for k, f in sheets.items()}, F.col("l_shipdate"), names)
    return out.groupBy("day_type", "period", "year", "month", "origin_name").agg(F.sum("riders").alias("riders"), F.count(F.lit(1)).alias("n"))


@query("day_type_of_sheet", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Avg Weekday' WHEN 1 THEN 'Avg Saturday' WHEN 2 THEN 'Avg Sunday' ELSE 'Total Trips' END AS day_type FROM part")
def _(t):
    i = F.col("p_size") % 4
    sheet = F.when(i == 0, F.when(F.col("p_partkey") % 2 == 0, "Wkdy Adj OD").otherwise("Avg Weekday OD")).when(i == 1, "Sat Adj OD").when(i == 2, "Average Sunday").otherwise("Total Trips OD")
    return t.part.select("p_partkey", O.day_type_of_sheet(sheet).alias("day_type"))


@query("wide_sensor_melt", with_(["p3"], f"SELECT ts, station AS sensor_id, temp_f AS speed_mph, {flag('temp_f < 35', 'is_congested')}, {flag('temp_f < 15', 'is_stop_n_go')}, CASE WHEN temp_f <= 15 THEN 'stop_and_go' WHEN temp_f <= 35 THEN 'slow' WHEN temp_f <= 55 THEN 'moderate' ELSE 'free_flow' END AS congestion_level FROM p3"))
def _(t):
    wide = X.p3(t).groupBy("ts").pivot("station", ["click", "error", "purchase", "signup", "view"]).agg(F.first("temp_f"))
    return O.sensor_melt(wide)


@query("sensor_standardise", f"SELECT event_type AS sensor_id, ts AS timestamp, CAST(user_id AS DOUBLE) AS flow_veh_5min, value AS speed_mph, {flag('value < 35', 'is_congested')}, event_id AS \"Lane 1 Flow\" FROM (SELECT * EXCLUDE (ts), date_trunc('second', ts) AS ts FROM events) WHERE user_id % 5 <> 0")
def _(t):
    stamp = F.when(F.col("user_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("bad")
    raw = t.events.select(F.col("event_type").alias("Station"), stamp.alias("Sample Time"), F.col("user_id").cast("double").alias("Total Flow"), F.col("value").alias("Avg Speed"), F.col("event_id").alias("Lane 1 Flow"))
    return O.sensor_standardise(raw).drop("is_stop_n_go")


_WMO_RAIN = "51, 53, 55, 61, 63, 65, 80, 81, 82, 95, 96, 99"


@query("weather_rename_decode", f"SELECT event_id, value / 100 * 25.4 AS precip_mm, CASE WHEN code = 0 THEN 'Clear sky' WHEN code = 3 THEN 'Overcast' WHEN code = 61 THEN 'Slight rain' WHEN code = 95 THEN 'Thunderstorm' WHEN code = 77 THEN 'Snow grains' ELSE 'Unknown' END AS weather_desc, {flag(f'coalesce(code IN ({_WMO_RAIN}), false)', 'is_raining')} FROM (SELECT event_id, value, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 61 WHEN 3 THEN 95 WHEN 4 THEN 77 WHEN 5 THEN 12 END AS code FROM events)")
def _(t):
    i = F.col("event_id") % 7
    code = F.coalesce(*[F.when(i == k, F.lit(c)) for k, c in enumerate([0, 3, 61, 95, 77, 12])], F.lit(None))
    raw = t.events.select("event_id", (F.col("value") / 100).alias("precipitation"), code.alias("weathercode"))
    return FD.flatten_weather(raw).select("event_id", "precip_mm", "weather_desc", "is_raining")


# Documents hold up to 64 entries each, however many rows a key has.
def batch(key: str):
    return F.floor(F.col(key) / 64).alias("batch")


_UTC = "timezone('America/Los_Angeles', timezone('UTC', date_trunc('second', ts)))"


@query("events_flatten_nhl", f"SELECT CAST(event_id AS VARCHAR) AS game_id, {_UTC} AS timestamp_start, {_UTC} + INTERVAL 3 HOUR AS timestamp_end, 'Sharks vs ' || event_type AS event_name FROM events WHERE user_id % 2 = 0 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")
def _(t):
    team = F.when(F.col("user_id") % 2 == 0, "SJS").otherwise("ANA")
    game = F.struct(
        F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("gameDate"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startTimeUTC"), F.lit(2).alias("gameType"),
        F.struct(team.alias("abbrev")).alias("homeTeam"), F.struct(F.col("event_type").alias("abbrev")).alias("awayTeam"),
    )
    docs = t.events.groupBy(hour_start("ts").alias("season"), batch("event_id")).agg(F.to_json(F.struct(F.collect_list(game).alias("games"))).alias("json"))
    return FD.flatten_games(docs.withColumn("season", F.col("season").cast("string")), "SJS", "2024-01-05", "2024-01-25").select("game_id", "timestamp_start", "timestamp_end", "event_name")


@query("events_flatten_venue", f"""SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 3 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE {_UTC} END AS timestamp_start, CASE event_id % 4 WHEN 0 THEN 'Rock' WHEN 1 THEN 'Sports' WHEN 2 THEN 'Other' ELSE 'Other' END AS event_type,
  CASE WHEN event_id % 4 <= 1 THEN 3.0 ELSE 2.5 END::DOUBLE AS hours, CASE WHEN event_id % 5 <> 0 THEN round(CASE WHEN value <> 0 THEN (value + 20) / 2 ELSE 20 END, 4) END AS avg_ticket_price FROM events WHERE event_id % 11 <> 0""")
def _(t):
    i, v = F.col("event_id"), F.col("value")
    start = F.struct(F.when((i % 3 != 0) & (i % 11 != 0), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("dateTime"), F.when(i % 11 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("localDate"))
    segment = F.when(i % 4 == 0, "Music").when(i % 4 == 1, "Sports")
    kind = F.struct(F.struct(segment.alias("name")).alias("segment"), F.when(i % 4 == 0, F.struct(F.lit("Rock").alias("name"))).alias("genre"))
    event = F.struct(
        i.cast("string").alias("id"), F.col("event_type").alias("name"), F.struct(start.alias("start")).alias("dates"), F.when(i % 4 == 3, F.array().cast(f"array<{KIND}>")).otherwise(F.array(kind)).alias("classifications"),
        F.when(i % 5 != 0, F.array(F.struct(v.alias("max")), F.struct(F.lit(20.0).alias("max")))).alias("priceRanges"),
    )
    docs = t.events.groupBy(hour_start("ts").cast("string").alias("venue"), batch("event_id")).agg(F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("json"))
    out = FD.flatten_venue_events(docs)
    from ..functions.calendar import hours_between

    return rnd(out.select("event_id", "timestamp_start", "event_type", hours_between("timestamp_start", "timestamp_end").alias("hours"), "avg_ticket_price"), 4, "avg_ticket_price")


KIND = "struct<segment: struct<name: string>, genre: struct<name: string>>"


@query("events_enrich", f"SELECT event_id, hour(ts) AS game_start_hour, {flag('isodow(ts) >= 6', 'is_weekend_event')}, {flag('user_id % 5 = 3', 'is_playoff')}, 1.0::DOUBLE AS is_game_day FROM events")
def _(t):
    kind = F.when(F.col("user_id") % 5 == 4, "pre").otherwise((F.col("user_id") % 5).cast("string"))
    return FD.enrich_events(t.events.select("event_id", F.col("ts").alias("timestamp_start"), kind.alias("game_type"))).select("event_id", "game_start_hour", "is_weekend_event", "is_playoff", "is_game_day")


def stop_documents(t):
    """Stop-monitoring documents, one per user: single visits come as an object, not a list."""
    call = F.struct(F.col("event_id").cast("string").alias("StopPointRef"), F.col("event_type").alias("StopPointName"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("AimedArrivalTime"))
    visit = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("RecordedAtTime"), F.struct(F.concat(F.lit("L"), (F.col("user_id") % 9).cast("string")).alias("LineRef"), call.alias("MonitoredCall")).alias("MonitoredVehicleJourney"))
    g = t.events.groupBy(F.col("user_id").cast("string").alias("agency_id"), batch("event_id")).agg(F.collect_list(visit).alias("v"))
    body = F.when(F.size("v") == 1, F.to_json(F.element_at("v", 1))).otherwise(F.to_json("v"))
    return g.select("agency_id", F.concat(F.lit('{"ServiceDelivery":{"StopMonitoringDelivery":{"MonitoredStopVisit":'), body, F.lit("}}}")).alias("json"))


@query("stop_visits_flatten", "SELECT strftime(ts, '%Y-%m-%d') AS recorded_at, CAST(event_id AS VARCHAR) AS stop_id, event_type AS stop_name, 'L' || (user_id % 9) AS line_ref, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS aimed_arrival, CAST(user_id AS VARCHAR) AS agency_id FROM events")
def _(t):
    return FD.flatten_stop_visits(stop_documents(t)).select("recorded_at", "stop_id", "stop_name", "line_ref", "aimed_arrival", "agency_id")


@query("stops_flatten", "SELECT CAST(c_custkey AS VARCHAR) AS stop_id, c_name AS stop_name, CASE WHEN c_custkey % 4 <> 0 THEN 37 + c_nationkey / 100.0 ELSE 0.0 END::DOUBLE AS lat, CASE WHEN c_custkey % 4 <> 0 THEN -122.0 ELSE 0.0 END::DOUBLE AS lng, c_mktsegment AS agency_id FROM customer")
def _(t):
    there = F.col("c_custkey") % 4 != 0
    loc = F.struct(F.when(there, (F.col("c_nationkey") / 100.0 + 37).cast("string")).alias("Latitude"), F.when(there, F.lit("-122.0")).alias("Longitude"))
    stop = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("Name"), loc.alias("Location"))
    docs = t.customer.groupBy(F.col("c_mktsegment").alias("agency_id"), "c_nationkey", batch("c_custkey")).agg(F.collect_list(stop).alias("s"))
    docs = docs.select("agency_id", F.concat(F.lit('{"Contents":{"dataObjects":{"ScheduledStopPoint":'), F.to_json("s"), F.lit("}}}")).alias("json"))
    return FD.flatten_stops(docs)


@query("lines_flatten", "SELECT CAST(s_suppkey AS VARCHAR) AS line_id, s_name AS line_name, CAST(s_nationkey AS VARCHAR) AS agency_id FROM supplier")
def _(t):
    line = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("Name"))
    docs = t.supplier.groupBy(F.col("s_nationkey").cast("string").alias("agency_id"), batch("s_suppkey")).agg(F.collect_list(line).alias("l"))
    body = F.when(F.size("l") == 1, F.to_json(F.element_at("l", 1))).otherwise(F.to_json("l"))
    return FD.flatten_lines(docs.select("agency_id", F.concat(F.lit('{"Content":{"dataObjects":{"LineGroup":'), body, F.lit("}}}")).alias("json")))


@query("series_from_reports", """SELECT o_custkey AS series, month, max(o_orderkey) AS seq, last(v ORDER BY o_orderkey) AS value, CASE WHEN first(v ORDER BY o_orderkey) <> last(v ORDER BY o_orderkey) THEN first(v ORDER BY o_orderkey) END AS revised_from
  FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, CAST(floor(o_totalprice / 100000) AS BIGINT) * 1.0::DOUBLE AS v FROM orders) GROUP BY 1, 2""")
def _(t):
    df = t.orders.select(F.col("o_custkey").alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("seq"), F.floor(F.col("o_totalprice") / 100000).cast("double").alias("value"))
    return O.latest_per_order(df, ["series", "month"], "seq", "value")


# Report texts around each order: two thirds prose with a prior-year figure, one third a table.
_MON = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


@query("report_value_extract", """SELECT o_orderkey AS url, strftime(o_orderdate, '%Y-%m') AS month, CAST(floor(o_totalprice) AS BIGINT) AS value, 0 AS rank, CASE WHEN o_orderkey % 3 = 0 THEN 'table' ELSE 'prose' END AS layout FROM orders
  UNION ALL SELECT o_orderkey, (year(o_orderdate) - 1) || '-' || strftime(o_orderdate, '%m'), CAST(floor(o_totalprice) AS BIGINT) + 7, 2, CASE WHEN o_orderkey % 3 = 0 THEN 'table' ELSE 'prose' END FROM orders
  UNION ALL SELECT o_orderkey, (year(o_orderdate) - 2) || '-' || strftime(o_orderdate, '%m'), 1234, 2, 'table' FROM orders WHERE o_orderkey % 3 = 0""")
def _(t):
    return R.figures(report_texts(t), keys=["url"])


def report_texts(t):
    d, v = F.col("o_orderdate"), F.floor("o_totalprice").cast("long")
    mon = F.element_at(F.array(*[F.lit(m) for m in _MON]), F.month(d))
    at = lambda k: F.concat(mon, F.lit(". "), (F.year(d) - k).cast("string"))
    num = lambda x: F.format_number(x, 0)
    prose = F.concat(F.lit("Staff report.  In "), at(0), F.lit(", Caltrain's Average Weekday\nRidership (AWR) increased by 3.1 percent to "), num(v), F.lit(" from "), at(1), F.lit(" AWR of "), num(v + 7), F.lit(". End."))
    table = F.concat(F.lit("Table A  "), at(2), F.lit(" "), at(1), F.lit(" "), at(0), F.lit(" % Change\nTotal Ridership 9 9 9 0.1%\nAverage Weekday Ridership 1,234* "), num(v + 7), F.lit(" "), num(v), F.lit(" -3.2% tail"))
    text = F.when(F.col("o_orderkey") % 3 == 0, table).otherwise(prose)
    # Every fifth text is badly spaced, as printed reports are.
    spaced = F.when(F.col("o_orderkey") % 5 == 1, F.replace(F.replace(text, F.lit("Weekday"), F.lit("Week day")), F.lit("Average"), F.lit("Ave rage"))).otherwise(text)
    return t.orders.select(F.col("o_orderkey").alias("url"), spaced.alias("text"))


@query("report_value_choose", """SELECT month, CAST(CASE WHEN nt > 1 OR np > 1 THEN NULL ELSE coalesce(tv, v) END AS DOUBLE) AS value, CASE WHEN nt > 1 OR np > 1 THEN 'conflicting values' END AS error FROM (SELECT strftime(o_orderdate, '%Y-%m') || '/' || (o_orderkey % 50) AS month, max(CAST(floor(o_totalprice) AS BIGINT)) AS v,
  max(CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END) AS tv, count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) END) AS nt, count(DISTINCT CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice) END) AS np FROM orders GROUP BY 1)""")
def _(t):
    f = R.figures(report_texts(t)).where("rank = 0").withColumn("month", F.concat_ws("/", "month", (F.col("url") % 50).cast("string")))
    return R.choose(f, ["month"]).select("month", F.col("value").cast("double").alias("value"), "error")


@query("batch_completeness", with_(["p3"], f"SELECT station, count(*) AS rows, count(*) FILTER (WHERE temp_f < 20) AS nulls, 720 AS expected, {flag('count(*) = 720 AND count(*) FILTER (WHERE temp_f < 20) = 0', 'complete')} FROM p3 GROUP BY 1"))
def _(t):
    df = X.p3(t).withColumn("temp_f", F.when(F.col("temp_f") >= 20, F.col("temp_f")))
    return FL.batch_completeness(df, "station", "ts", 30, ["temp_f"])


@query("never_shrink", """SELECT o.p AS source, o.y AS year, o.n AS old_rows, w.n AS new_rows, CASE WHEN o.n IS NULL THEN 'written' WHEN o.l >= w.l AND o.n >= w.n THEN 'unchanged' WHEN w.n < o.n THEN 'refused' ELSE 'written' END AS action FROM
  (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n, max(o_orderdate) AS l FROM orders GROUP BY 1, 2) w JOIN (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n, max(o_orderdate) AS l FROM orders WHERE month(o_orderdate) < 12 OR year(o_orderdate) % 2 = 0 GROUP BY 1, 2) o USING (p, y)""")
def _(t):
    new = t.orders.select(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").alias("ts"))
    old = new.where("month(ts) < 12 or year % 2 = 0")
    return FL.never_shrink(old, new, ["source", "year"])


@query("sink_parquet", with_(["p1"], "SELECT series, ts, y, year(ts) AS year FROM p1"))
def _(t):
    path = scratch_dir(t.spark, "panel")
    FL.write_parquet(X.p1(t).withColumn("year", F.year("ts")), path, ["year"])
    return t.spark.read.parquet(path)


@query("sink_csv_metrics", with_(["p6"], "SELECT horizon, round(avg(abs(y - p50)), 2) AS mae, CAST(count(*) AS BIGINT) AS n FROM p6 GROUP BY horizon"))
def _(t):
    path = scratch_dir(t.spark, "metrics")
    FL.write_csv(M.score(X.p6(t), ["horizon"], ["mae", "n"], 2), path)
    return t.spark.read.option("header", "true").schema("horizon long, mae double, n long").csv(path)


@query("sink_json_records", with_(["p5"], "SELECT series, ts, '{\"series\":' || series || ',\"month\":\"' || strftime(ts, '%Y-%m') || '\",\"p50\":' || CASE WHEN series % 4 = 0 THEN 'null' WHEN series % 4 = 1 THEN 'null' ELSE CAST(CAST(round(p50 / 10000) AS BIGINT) AS VARCHAR) || '.0' END || '}' AS record FROM p5"))
def _(t):
    p = X.p5(t)
    p50 = F.when(F.col("series") % 4 == 0, F.lit(float("nan"))).when(F.col("series") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("p50") / 10000)
    rec = FL.json_records(p.select("series", F.date_format("ts", "yyyy-MM").alias("month"), p50.alias("p50")), ["series", "month"], 0)
    return rec.select("series", F.to_timestamp_ntz(F.concat("month", F.lit("-01 00:00:00"))).alias("ts"), "record")


@query("publish_if_passed", with_(["p1"], "SELECT 'published' AS first_run, 'unchanged' AS second_run, 'refused' AS failed_run, count(*) AS n, sum(y) AS y FROM p1"))
def _(t):
    root, p = scratch_dir(t.spark, "store"), X.p1(t)
    first = FL.publish_if_passed(p, None, True, root, "run-1")
    served = FL.read_published(t.spark, root)
    second, failed = FL.publish_if_passed(p, served, True, root, "run-2"), FL.publish_if_passed(p, served, False, root, "run-3")
    return served.agg(F.lit(first).alias("first_run"), F.lit(second).alias("second_run"), F.lit(failed).alias("failed_run"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
