"""Weather, event and transit feeds: nested JSON to flat tables.

Each function is stateless, so it runs on a batch or a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import LOCAL_ZONE, NTZ, col, plus_hours, wall_clock
from ..functions.scalars import WMO_CODES

# ---- weather --------------------------------------------------------------------------------

# Fixed names: hourly variables of the weather service -> columns of the store.
WEATHER_NAMES = {
    "time": "timestamp", "temperature_2m": "temp_f", "precipitation": "precip_in", "windspeed_10m": "windspeed_mph",
    "cloudcover": "cloud_cover_pct", "relativehumidity_2m": "humidity_pct", "weathercode": "weather_code",
}


def decode_weather(code) -> dict[str, Column]:
    """Description and rain flag of a WMO code; unknown or missing codes are 'Unknown' and not rain."""
    text = F.create_map(*[F.lit(x) for k, (d, _) in WMO_CODES.items() for x in (k, d)])
    rain = [k for k, (_, r) in WMO_CODES.items() if r]
    c = col(code).cast("int")
    return {
        "weather_desc": F.coalesce(F.try_element_at(text, c), F.lit("Unknown")),
        "is_raining": F.coalesce(c.isin(rain), F.lit(False)),
    }


def flatten_weather(raw: DataFrame) -> DataFrame:
    """Rename the variables present, add millimetres and the decoded code."""
    df = raw.select(*[F.col(c).alias(WEATHER_NAMES.get(c, c)) for c in raw.columns])
    if "precip_in" in df.columns:
        df = df.withColumn("precip_mm", F.col("precip_in") * 25.4)
    if "weather_code" in df.columns:
        df = df.withColumns(decode_weather("weather_code"))
    return df


# ---- games and venue events ---------------------------------------------------------------------

GAMES_SCHEMA = (
    "struct<games: array<struct<id: string, gameDate: string, startTimeUTC: string, gameType: string, "
    "homeTeam: struct<abbrev: string>, awayTeam: struct<abbrev: string>>>>"
)


def flatten_games(docs: DataFrame, team: str, start: str, end: str, json: str = "json", season: str = "season") -> DataFrame:
    """Home games inside the date range; UTC start to local wall clock, end three hours later."""
    g = docs.select(season, F.explode(F.from_json(json, GAMES_SCHEMA)["games"]).alias("g"))
    day = F.try_to_date(F.col("g.gameDate"))
    g = g.where((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")) & (F.col("g.homeTeam.abbrev") == team))
    begins = wall_clock(F.try_to_timestamp(F.col("g.startTimeUTC")))
    return g.select(
        F.col("g.id").alias("game_id"), begins.alias("timestamp_start"), plus_hours(begins, 3).alias("timestamp_end"),
        F.concat(F.lit("Sharks vs "), F.coalesce("g.awayTeam.abbrev", F.lit("OPP"))).alias("event_name"),
        F.lit("NHL Hockey").alias("event_type"), F.lit("sap_center").alias("venue"), F.lit(True).alias("is_sharks_game"),
        F.col("g.gameType").alias("game_type"), season,
    )


VENUE_SCHEMA = (
    "struct<events: array<struct<id: string, name: string, dates: struct<start: struct<dateTime: string, localDate: string>>, "
    "classifications: array<struct<segment: struct<name: string>, genre: struct<name: string>>>, priceRanges: array<struct<max: double>>>>>"
)


def flatten_venue_events(docs: DataFrame, json: str = "json", venue: str = "venue") -> DataFrame:
    """Venue events: start from dateTime else localDate, duration by segment, mean of maximum prices.

    Missing, null and empty nested values are all tolerated; an event without a
    readable date is dropped.
    """
    e = docs.select(venue, F.explode(F.from_json(json, VENUE_SCHEMA)["events"]).alias("e"))
    s = F.col("e.dates.start")
    timed, dated = F.nullif(s["dateTime"], F.lit("")), F.nullif(s["localDate"], F.lit(""))
    begins = F.when(timed.isNotNull(), wall_clock(F.try_to_timestamp(timed), LOCAL_ZONE)).otherwise(F.try_to_timestamp(dated).cast(NTZ))
    first = F.try_element_at("e.classifications", F.lit(1))
    segment = F.coalesce(first["segment"]["name"], F.lit(""))
    genre = F.coalesce(first["genre"]["name"], F.nullif(segment, F.lit("")), F.lit("Other"))
    prices = F.filter(F.transform("e.priceRanges", lambda p: p["max"]), lambda p: p.isNotNull() & (p != 0))
    mean_price = F.when(F.size(prices) > 0, F.aggregate(prices, F.lit(0.0), lambda a, p: a + p) / F.size(prices))
    hours = F.when(segment.isin("Sports", "Music"), 3 * 3600.0).otherwise(2.5 * 3600.0)
    flat = e.select(
        F.col("e.id").alias("event_id"), begins.alias("timestamp_start"), F.coalesce("e.name", F.lit("")).alias("event_name"), genre.alias("event_type"),
        segment.alias("segment"), venue, F.lit(False).alias("is_sharks_game"), mean_price.alias("avg_ticket_price"), hours.alias("_s"),
    ).where("timestamp_start is not null")
    return flat.withColumn("timestamp_end", F.col("timestamp_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_s"))).drop("_s")


def enrich_events(df: DataFrame, start: str = "timestamp_start", game_type: str = "game_type") -> DataFrame:
    """Game-day flag, start hour, weekend flag, playoff flag (numeric game type 3)."""
    kind = F.expr(f"try_cast({game_type} as int)") if game_type in df.columns else F.lit(None).cast("int")
    return df.withColumns({
        "is_game_day": F.lit(True), "game_start_hour": F.hour(start), "is_weekend_event": F.weekday(start) >= 5,
        "is_playoff": F.coalesce(kind == 3, F.lit(False)),
    })


# ---- transit feeds -----------------------------------------------------------------------------------

_CALL = ("struct<StopPointRef: string, StopPointName: string, AimedArrivalTime: string, ExpectedArrivalTime: string, "
         "AimedDepartureTime: string, ExpectedDepartureTime: string>")
_VISIT = f"struct<RecordedAtTime: string, MonitoredVehicleJourney: struct<LineRef: string, Occupancy: string, MonitoredCall: {_CALL}>>"


def one_or_many(text: Column, element: str) -> Column:
    """JSON text that holds one object or a list of them -> ARRAY."""
    listed = F.when(F.trim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return F.from_json(listed, f"array<{element}>")


def flatten_stop_visits(docs: DataFrame, json: str = "json", agency: str = "agency_id") -> DataFrame:
    """Stop-monitoring documents -> one row per visit; a single visit may come without a list."""
    text = F.get_json_object(json, "$.ServiceDelivery.StopMonitoringDelivery.MonitoredStopVisit")
    v = docs.select(agency, F.explode(one_or_many(text, _VISIT)).alias("v"))
    call, journey = F.col("v.MonitoredVehicleJourney.MonitoredCall"), F.col("v.MonitoredVehicleJourney")
    return v.select(
        F.col("v.RecordedAtTime").alias("recorded_at"), call["StopPointRef"].alias("stop_id"), call["StopPointName"].alias("stop_name"),
        journey["LineRef"].alias("line_ref"), call["AimedArrivalTime"].alias("aimed_arrival"), call["ExpectedArrivalTime"].alias("expected_arrival"),
        call["AimedDepartureTime"].alias("aimed_departure"), call["ExpectedDepartureTime"].alias("expected_departure"),
        journey["Occupancy"].alias("occupancy"), agency,
    )


def flatten_stops(docs: DataFrame, json: str = "json", agency: str = "agency_id") -> DataFrame:
    text = F.get_json_object(json, "$.Contents.dataObjects.ScheduledStopPoint")
    element = "struct<id: string, Name: string, Location: struct<Latitude: string, Longitude: string>>"
    s = docs.select(agency, F.explode(one_or_many(text, element)).alias("s"))
    return s.select(
        F.col("s.id").alias("stop_id"), F.coalesce("s.Name", F.lit("")).alias("stop_name"),
        F.coalesce(F.col("s.Location.Latitude").try_cast("double"), F.lit(0.0)).alias("lat"),
        F.coalesce(F.col("s.Location.Longitude").try_cast("double"), F.lit(0.0)).alias("lng"), agency,
    )


def flatten_lines(docs: DataFrame, json: str = "json", agency: str = "agency_id") -> DataFrame:
    text = F.get_json_object(json, "$.Content.dataObjects.LineGroup")
    s = docs.select(agency, F.explode(one_or_many(text, "struct<id: string, Name: string>")).alias("s"))
    return s.select(F.coalesce("s.id", F.lit("")).alias("line_id"), F.coalesce("s.Name", F.lit("")).alias("line_name"), agency)
