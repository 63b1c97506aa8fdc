"""Event calendars joined to panels: windows, proximity, nearest start and end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import epoch_seconds, hours_between, month_start, plus_hours
from ..functions.scalars import haversine_km, unless_null
from .ordered import nearest_after, nearest_before, quantile_cuts, with_piece
from .spans import archive_span, with_coverage

APPROACH_HOURS = 3.0
DEPARTURE_HOURS = 1.5
#: Events listed in one cell and time slot before it is cut.
CROWDED = 1 << 16
#: Keys at one place and time that a row of ``near_events`` carries, give or take.
CARRIED = 64


def stabbing(points: DataFrame, intervals: DataFrame, ts: str, lo: str, hi: str, aggs: dict[str, tuple[str, str]], slot_s: int = 3600) -> DataFrame:
    """Aggregates over all intervals that contain each point, without listing pairs.

    ``aggs``: out -> ("sum" or "max", interval column).  Time is cut into slots
    no longer than the shortest interval, so within a slot an interval opens,
    closes or covers it whole; slots are cut into pieces at quantiles of the times:

    * covering intervals fold into one row per slot;
    * opening ones are a running aggregate from the slot's start, closing ones
      a running aggregate from its end: inside a piece, and over the pieces'
      summaries, one row each.

    The work grows with points + intervals x (slots per interval), even where a
    third of all events share an hour with as many points, and that hour is many tasks.
    """
    slot = lambda c: F.floor(epoch_seconds(c) / slot_s)
    fold = {"sum": F.sum, "max": F.max}
    names = list(aggs)
    values = [F.col(c).alias(o) for o, (_, c) in aggs.items()]
    blank = [F.lit(None).cast(intervals.schema[c].dataType).alias(o) for o, (_, c) in aggs.items()]
    iv = intervals.select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), *values).withColumns({"_a": slot("_lo"), "_b": slot("_hi")})

    whole = (
        iv.where(F.col("_b") > F.col("_a") + 1).groupBy("_a", "_b").agg(*[fold[k](o).alias(o) for o, (k, _) in aggs.items()])
        .withColumn("_slot", F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)))
        .groupBy("_slot").agg(*[fold[k](o).alias(f"{o}_whole") for o, (k, _) in aggs.items()])
    )
    cuts = quantile_cuts(points.select(F.col(ts).alias("_t")).unionByName(iv.select(F.col("_lo").alias("_t"))), F.col("_t"))
    rows = (
        points.select(ts).distinct().select(slot(ts).alias("_slot"), F.col(ts).alias("_t"), F.lit(1).alias("_kind"), *blank)
        .unionByName(iv.select(F.col("_a").alias("_slot"), F.col("_lo").alias("_t"), F.lit(0).alias("_kind"), *names))
        .unionByName(iv.where(F.col("_b") > F.col("_a")).select(F.col("_b").alias("_slot"), F.col("_hi").alias("_t"), F.lit(2).alias("_kind"), *names))
        # One row per time and kind, however many intervals open or close then.
        .groupBy("_slot", "_t", "_kind").agg(*[fold[k](o).alias(o) for o, (k, _) in aggs.items()])
    )
    rows = with_piece(rows, F.col("_t"), cuts, "_piece")
    ends = {"open": 0, "close": 2}
    only = lambda o, end: F.when(F.col("_kind") == ends[end], F.col(o))
    # Equal times: openings sort before points, closings after, so both bounds are inclusive.  Both run from
    # their first row: a frame that ends unbounded is computed anew for each row, the square of a piece's rows.
    inside, beside = Window.partitionBy("_slot", "_piece"), Window.partitionBy("_slot")
    frames = {
        "open": (inside.orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0), beside.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)),
        "close": (inside.orderBy(F.col("_t").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0), beside.orderBy(F.col("_piece").desc()).rowsBetween(Window.unboundedPreceding, -1)),
    }
    each = [(o, k, end) for o, (k, _) in aggs.items() for end in ends]
    carried = rows.groupBy("_slot", "_piece").agg(*[fold[k](only(o, end)).alias(f"{o}_{end}_all") for o, k, end in each])
    carried = carried.select("_slot", "_piece", *[fold[k](f"{o}_{end}_all").over(frames[end][1]).alias(f"{o}_{end}_beside") for o, k, end in each])
    near = rows.withColumns({f"{o}_{end}": fold[k](only(o, end)).over(frames[end][0]) for o, k, end in each}).where(F.col("_kind") == 1)
    out = near.join(carried, ["_slot", "_piece"]).join(whole, "_slot", "left")
    combined = []
    for o, (k, _) in aggs.items():
        parts = [F.col(f"{o}_{p}") for p in ("open", "open_beside", "close", "close_beside", "whole")]
        if k == "max":
            combined.append(F.greatest(*parts).alias(o))
        else:
            combined.append(F.nullif(sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)), F.lit(0)).alias(o))
    return out.select(F.col("_t").alias(ts), *combined)


def event_profile(
    times: DataFrame, events: DataFrame, ts: str = "ts", start: str = "timestamp_start", end: str = "timestamp_end",
    major: str = "is_sharks_game", approach: float = APPROACH_HOURS, departure: float = DEPARTURE_HOURS,
) -> DataFrame:
    """Every distinct time with the events around it.

    An event is active from ``approach`` hours before its start to ``departure``
    hours after its end.  Its effects depend on the time only, so times are made
    distinct and events that begin or end at once merged.  The closest start is the next one
    (if inside the approach) or the latest one still active.

    Starts and ends are laid beside the times (and the times moved by both margins) and swept
    once in order, piece by piece: active events are those begun by then less those ended.
    The latest start still active is nearly always the latest one.  Another can be it only if
    its event outlasts that of a later start; these few are searched as intervals.
    """
    points = times.select(ts).where(F.col(ts).isNotNull()).distinct()
    begin, over = F.col(start), F.greatest(start, end)
    one, big = F.when(begin.isNotNull(), 1).otherwise(0).cast("long"), F.when(begin.isNotNull() & F.col(major), 1).otherwise(0).cast("long")
    row = lambda t, kind, hi: F.struct(t.alias("_t"), F.lit(kind).alias("_kind"), one.alias("_n"), big.alias("_big"), hi.alias("_hi"))
    hi = plus_hours(over, departure)
    marks = events.select(F.inline(F.array(row(begin, 0, hi), row(over, 2, F.when(F.lit(False), hi))))).where("_t is not null")
    moved = {"now": F.col(ts), "opened": plus_hours(ts, approach), "closed": plus_hours(ts, -departure)}
    asked = points.select(ts, F.inline(F.array(*[F.struct(t.alias("_t"), F.lit(w).alias("_which")) for w, t in moved.items()])))
    zero = F.lit(0).cast("long")
    rows = (
        asked.select("_t", F.lit(1).alias("_kind"), zero.alias("_n"), zero.alias("_big"), F.lit(None).cast(marks.schema["_hi"].dataType).alias("_hi")).unionByName(marks)
        # One row per time and kind, however many events begin or end then.
        .groupBy("_t", "_kind").agg(F.sum("_n").alias("_n"), F.sum("_big").alias("_big"), F.max("_hi").alias("_hi"))
        # Always true: it keeps all columns in every use of this plan, so its shuffle is written once and reused.
        .where(F.col("_n").isNotNull() | F.col("_big").isNotNull() | F.col("_hi").isNotNull())
    )
    cuts = quantile_cuts(rows, F.col("_t"), distinct=False)
    rows = with_piece(rows, F.col("_t"), cuts, "_cut").withColumn("_piece", F.struct(F.date_trunc("hour", "_t").alias("slot"), "_cut")).drop("_cut")
    # Equal times: starts sort before the times asked for, ends after; what has ended has ended before.
    inside, back = Window.partitionBy("_piece").orderBy("_t", "_kind"), Window.partitionBy("_piece").orderBy(F.col("_t").desc(), F.col("_kind").desc())
    upto, after = Window.orderBy("_piece"), Window.orderBy(F.col("_piece").desc())
    of = lambda kind, c: F.when(F.col("_kind") == kind, F.col(c))
    found = {  # name: (of the rows of a piece, window in a piece, of the pieces, window over the pieces)
        "begun": (F.sum(of(0, "_n")), inside, F.sum, upto), "big_begun": (F.sum(of(0, "_big")), inside, F.sum, upto),
        "over": (F.sum(of(2, "_n")), inside, F.sum, upto), "big_over": (F.sum(of(2, "_big")), inside, F.sum, upto),
        "last": (F.max(of(0, "_t")), inside, F.max, upto), "ended": (F.max(of(2, "_t")), inside, F.max, upto), "next": (F.min(of(0, "_t")), back, F.min, after),
    }
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    beside = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # One row per piece: the carry over pieces is small however many rows there are.
    carried = rows.groupBy("_piece").agg(*[c.alias(f"_all_{o}") for o, (c, *_) in found.items()], F.max_by(of(0, "_hi"), of(0, "_t")).alias("_all_hi"))
    carried = carried.select("_piece", *[fold(f"_all_{o}").over(beside(w)).alias(f"_carried_{o}") for o, (_, _, fold, w) in found.items()], F.last("_all_hi", ignorenulls=True).over(beside(upto)).alias("_carried_hi"))
    near = rows.withColumns({f"_here_{o}": c.over(so_far(w)) for o, (c, w, *_) in found.items()} | {"_here_hi": F.last(of(0, "_hi"), ignorenulls=True).over(so_far(inside))}).where("_kind = 1")
    either = lambda o: F.coalesce(f"_here_{o}", f"_carried_{o}").alias(o)
    total = lambda o: (F.coalesce(f"_here_{o}", F.lit(0)) + F.coalesce(f"_carried_{o}", F.lit(0))).alias(o)
    swept = near.join(carried, "_piece").select("_t", *[total(o) for o in ("begun", "big_begun", "over", "big_over")], *[either(o) for o in ("last", "hi", "ended", "next")])
    at = lambda which, c: F.max(F.when(F.col("_which") == which, F.col(c)))
    swept = asked.join(swept, "_t").groupBy(ts).agg(
        (at("opened", "begun") - at("closed", "over")).alias("n_active"), (at("opened", "big_begun") - at("closed", "big_over") > 0).alias("_big"),
        *[at("now", c).alias(f"_{c}") for c in ("last", "hi", "ended", "next")],
    )
    later = F.lead("_hi").over(Window.partitionBy("_piece").orderBy("_t"))
    outlast = rows.where("_kind = 0").withColumn("_later", later).where("_later is null or _hi > _later").select(F.col("_t").alias("_start"), "_hi")
    slot_s = int(min(3600.0, departure * 3600.0)) or 60
    older = stabbing(points, outlast, ts, "_start", "_hi", {"_older": ("max", "_start")}, slot_s)
    j = swept.join(older, ts).withColumns({"_now": F.coalesce(F.col("_last") == F.col(ts), F.lit(False)), "_latest": F.when(F.col("_hi") >= F.col(ts), F.col("_last")).otherwise(F.col("_older"))})
    ahead, gone = F.when(F.col("_now"), F.lit(0.0)).otherwise(hours_between(ts, "_next")), hours_between("_ended", ts)
    pre = F.coalesce(ahead <= approach, F.lit(False))
    near = F.least(F.when(pre, ahead), hours_between("_latest", ts))
    return j.select(
        ts, pre.alias("is_pre_event_window"), F.coalesce(gone <= departure, F.lit(False)).alias("is_post_event_window"),
        F.coalesce("_big", F.lit(False)).alias("is_sharks_game_window"), F.coalesce(F.exp(F.pow(near / approach, 2) * -0.5), F.lit(0.0)).alias("event_proximity_score"),
        "n_active", hours_between(ts, "_next").alias("hours_to_next_event"), gone.alias("hours_since_last_event"),
    )


def event_windows(times: DataFrame, events: DataFrame, ts: str = "ts", **names) -> DataFrame:
    """The distinct times with at least one active event: flags, proximity, count."""
    return event_profile(times, events, ts, **names).where("n_active > 0").drop("hours_to_next_event", "hours_since_last_event")


def hours_to_next(times: DataFrame, events: DataFrame, ts: str = "ts", start: str = "timestamp_start") -> DataFrame:
    """Hours to the nearest strictly future start, per distinct time."""
    near = nearest_after(times, events.select(F.col(start).alias(ts)), ts, "_m")
    return near.select(ts, hours_between(ts, "_m").alias("hours_to_next_event"))


def hours_since_last(times: DataFrame, events: DataFrame, ts: str = "ts", end: str = "timestamp_end") -> DataFrame:
    """Hours since the latest strictly past end, per distinct time."""
    near = nearest_before(times, events.select(F.col(end).alias(ts)), ts, "_m")
    return near.select(ts, hours_between("_m", ts).alias("hours_since_last_event"))


def add_event_features(df: DataFrame, events: DataFrame, spans: DataFrame | None = None, ts: str = "ts",
                       start: str = "timestamp_start", end: str = "timestamp_end", major: str = "is_sharks_game") -> DataFrame:
    """Hour-scale event features; rows outside the archive's months are unknown (NULL)."""
    spans = archive_span(events, start) if spans is None else spans
    feats = with_coverage(event_profile(df, events, ts, start, end, major), spans, ts)
    columns = {c: F.col(c) for c in ("hours_to_next_event", "hours_since_last_event", "is_pre_event_window", "is_post_event_window", "is_sharks_game_window", "event_proximity_score")}
    columns["is_any_event_day"] = F.col("n_active") > 0
    columns["nearest_event_attendance_tier"] = F.when(F.col("is_sharks_game_window"), 2.0).when(F.col("n_active") > 0, 1.0).otherwise(0.0)
    known = feats.select(ts, *[unless_null("covered", c).alias(n) for n, c in columns.items()])
    return df.join(known, ts, "left")


def monthly_events(events: DataFrame, start: str = "timestamp_start", major: str = "is_sharks_game", playoff: str | None = "is_playoff", hour: str | None = "game_start_hour") -> DataFrame:
    """Per month: event count, any major, any playoff, modal start hour (lowest on ties)."""
    aggs = [F.count(F.lit(1)).cast("double").alias("n_events"), F.max(F.coalesce(F.col(major), F.lit(False))).alias("any_major")]
    aggs.append((F.max(F.coalesce(F.col(playoff), F.lit(False))) if playoff else F.lit(False)).alias("any_playoff"))
    if hour:
        aggs.append(F.mode(F.col(hour), deterministic=True).cast("double").alias("mode_hour"))
    return events.groupBy(month_start(start).alias("_month")).agg(*aggs)


def add_monthly_events(df: DataFrame, events: DataFrame, spans: DataFrame | None = None, ts: str = "ts", start: str = "timestamp_start",
                       major: str = "is_sharks_game", playoff: str | None = "is_playoff", hour: str | None = "game_start_hour") -> DataFrame:
    """Store columns: covered month without events is 0 / FALSE, uncovered month is NULL."""
    spans = archive_span(events, start) if spans is None else spans
    m = monthly_events(events, start, major, playoff, hour)
    j = with_coverage(df, spans, ts).withColumn("_month", month_start(ts)).join(m, "_month", "left")
    out = {
        "is_game_day": F.coalesce(F.col("n_events") > 0, F.lit(False)),
        "hours_to_event": F.coalesce("n_events", F.lit(0.0)),
        "is_sharks_game": F.coalesce("any_major", F.lit(False)),
        "is_playoff": F.coalesce("any_playoff", F.lit(False)),
    }
    if hour:
        out["game_start_hour"] = F.col("mode_hour")
    return j.withColumns({n: unless_null("covered", c) for n, c in out.items()}).drop("_month", "n_events", "any_major", "any_playoff", "mode_hour", "covered")


def add_monthly_event_features(df: DataFrame, events: DataFrame, spans: DataFrame | None = None, ts: str = "ts", start: str = "timestamp_start", major: str = "is_sharks_game") -> DataFrame:
    """Month-scale stand-in for the hour-scale features: share of the busiest covered month, tier."""
    spans = archive_span(events, start) if spans is None else spans
    m = monthly_events(events, start, major, None, None)
    j = with_coverage(df, spans, ts).withColumn("_month", month_start(ts)).join(m, "_month", "left")
    j = j.withColumn("_n", F.when(F.col("covered"), F.coalesce("n_events", F.lit(0.0))))
    # The peak over the panel's covered months: one row, so the broadcast is of fixed size.
    peak = j.agg(F.greatest(F.coalesce(F.max("_n"), F.lit(1.0)), F.lit(1.0)).alias("_peak"))
    big, any_event = F.coalesce("any_major", F.lit(False)), F.coalesce(F.col("_n") > 0, F.lit(False))
    out = {
        "is_any_event_day": any_event,
        "is_sharks_game_window": big,
        "is_pre_event_window": F.lit(False),
        "is_post_event_window": F.lit(False),
        "event_proximity_score": F.col("_n") / F.col("_peak"),
        "nearest_event_attendance_tier": F.when(big, 2.0).when(any_event, 1.0).otherwise(0.0),
    }
    return (
        j.join(F.broadcast(peak), F.lit(True), "left").withColumns({n: unless_null("covered", c) for n, c in out.items()})
        .withColumns({"hours_to_next_event": F.lit(None).cast("double"), "hours_since_last_event": F.lit(None).cast("double")})
        .drop("_month", "n_events", "any_major", "any_playoff", "covered", "_n", "_peak")
    )


def near_events(points: DataFrame, events: DataFrame, key: str, when: str, km: float = 1.5, hours: float = 3.0, digits: int | None = None) -> DataFrame:
    """Events within ``km`` and ``hours`` of each point, one row per (point, name, start), ``km`` rounded to ``digits``.

    Both sides carry ``lat`` and ``lng``.  Cells are a little over twice the search radius wide and time
    slots ``hours``: an event is listed in all cells that its radius touches (at most four) and
    a point in its own, in the slots around its time, so all that a point row finds at a start lies
    together; pairs are never dealt anew, except those of keys that several points share.  The
    exact distance and time decide.  Keys at one place and time are searched for as one row, at most
    some ``CARRIED`` of them, and told apart where pairs are put out.  Events whose name and start are met
    at one place only (nearly all) need no nearest one, so their pairs are put out as they arise; of
    the others the nearest is picked where the pairs arise.  Events whose
    radius crosses the 180th meridian are listed a full turn further too, so that neighbours across it
    meet; rows of cells at the poles are one cell.  Crowded cells are cut by the event's name and start.
    """
    # A degree of latitude is more than 110 km, so no event within ``km`` is further north or south than this.
    reach = km / 110.0
    # A little wider than what an event reaches, so that this never spans three cells by rounding.
    step = 2.001 * reach
    slot_s = hours * 3600.0
    cell_row = lambda lat: F.floor(lat / step)
    # The cosine at a latitude beyond the row's own and its neighbour's: a longitude step that stays wide enough.
    edge = lambda r: (F.abs(r) + 2) * step
    width = lambda r: F.cos(F.radians(F.least(edge(r), F.lit(89.0))))
    column = lambda lng, r: F.when(edge(r) >= 89.0, F.lit(0).cast("long")).otherwise(F.floor(lng / (step / width(r))))
    cell, name, start = ["_r", "_c", "_s"], "event_name", "timestamp_start"

    east = lambda lng: F.pmod(F.col(lng) + 180.0, F.lit(360.0)) - 180.0
    either = lambda a, b: F.when(a == b, F.array(a)).otherwise(F.array(a, b))

    def listed(ev: DataFrame) -> DataFrame:
        """In all cells that the event's radius touches."""
        ev = ev.withColumn("_r", F.explode(either(cell_row(F.col("lat") - reach), cell_row(F.col("lat") + reach)))).withColumn("_at", east("lng"))
        wide = reach / width(F.col("_r"))
        turned = F.col("_at") - F.signum("_at") * 360.0
        touched = lambda at: [column(at - wide, F.col("_r")), column(at + wide, F.col("_r"))]
        # Each cell once, as pairs are put out as they arise: at the poles both turns are in one.
        around = F.array_distinct(F.array(*touched(F.col("_at")), *touched(turned)))
        cells = F.when(F.abs("_at") + wide >= 180.0, around).otherwise(either(*touched(F.col("_at"))))
        return ev.withColumn("_c", F.explode(cells)).drop("_at")

    ev = events.select(name, start, "lat", "lng", epoch_seconds(start).alias("_begun")).withColumn("_s", F.floor(F.col("_begun") / slot_s))
    ev = ev.where(" and ".join(f"{c} is not null" for c in (start, "lat", "lng", "_begun", "_s")))
    # Least and greatest are the place itself where a name and start have one; these events are read off their own summary.
    met = ev.groupBy(name, start, "_begun", "_s").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"), F.max("lat").alias("_lat"), F.max("lng").alias("_lng"))
    one = (F.col("lat") == F.col("_lat")) & (F.col("lng") == F.col("_lng"))
    alone = met.where(one).drop("_lat", "_lng")
    others = met.where(~one).select(F.col(name).alias("_name"), F.col(start).alias("_start"))
    several = ev.join(others, F.col(name).eqNullSafe(F.col("_name")) & (F.col(start) == F.col("_start")), "left_semi").distinct()
    slots = alone.select("lat", "lng", "_s").unionByName(several.select("lat", "lng", "_s")).groupBy("lat", "lng", "_s").agg(F.count(F.lit(1)).alias("_n"))
    # At most one row for every CROWDED listed events.
    crowds = listed(slots).groupBy(*cell).agg(F.sum("_n").alias("_n")).where(F.col("_n") > CROWDED).select(*cell, F.ceil(F.col("_n") / CROWDED).cast("int").alias("_cuts"))
    crowds = F.broadcast(crowds)
    cut = lambda ev: listed(ev).join(crowds, cell, "left").withColumn("_cut", F.pmod(F.hash(name, start), F.coalesce("_cuts", F.lit(1)))).drop("_cuts")
    alone, several = cut(alone), cut(several)

    spot = ["_when", "_plat", "_plng"]
    pt = points.select(F.col(key).alias("_key"), F.col(when).alias("_when"), F.col("lat").alias("_plat"), F.col("lng").alias("_plng")).where("_when is not null and _plat is not null and _plng is not null").distinct()
    shared = pt.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_key").alias("_again"))
    same = F.col("_key").eqNullSafe(F.col("_again"))

    def spots(some: DataFrame) -> DataFrame:
        """Points at one place and time as rows of some CARRIED keys, in their cells."""
        many = some.groupBy(*spot).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CARRIED).select(*spot, F.ceil(F.col("_n") / CARRIED).alias("_parts"))
        some = some.join(many, spot, "left").withColumn("_part", F.pmod(F.hash("_key"), F.coalesce("_parts", F.lit(1))))
        some = some.groupBy(*spot, "_part").agg(F.collect_list(F.struct("_key")).alias("_keys")).drop("_part")
        some = some.withColumn("_r", cell_row(F.col("_plat"))).withColumn("_c", column(east("_plng"), F.col("_r"))).withColumn("_time", epoch_seconds("_when"))
        some = some.withColumn("_s", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda d: F.floor(F.col("_time") / slot_s) + d)))
        return some.join(crowds, cell, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), F.coalesce("_cuts", F.lit(1)) - 1))).drop("_cuts")

    def hits(some: DataFrame, ev: DataFrame) -> DataFrame:
        pairs = some.join(ev.hint("merge"), [*cell, "_cut"])
        # The plain tests come first, so the distance is worked out for few pairs beside the near ones; times are seconds by now.
        pairs = pairs.where((F.abs((F.col("_begun") - F.col("_time")) / 3600.0) <= hours) & (F.abs(F.col("_plat") - F.col("lat")) <= reach))
        return pairs.withColumn("km", haversine_km("_plat", "_plng", "lat", "lng")).where(F.col("km") <= km)

    rounded = F.col("km") if digits is None else F.round("km", digits).alias("km")
    each = lambda hit: hit.select("_keys", name, start, rounded).select(F.inline("_keys"), name, start, "km").withColumnRenamed("_key", key)
    own, common = spots(pt.join(shared, same, "left_anti")), spots(pt.join(shared, same, "left_semi"))
    nearest = hits(own, several).groupBy(*cell, "_cut", "_keys", name, start).agg(F.min("km").alias("km"))
    again = each(hits(common, alone)).unionByName(each(hits(common, several))).groupBy(key, name, start).agg(F.min("km").alias("km"))
    return each(hits(own, alone)).unionByName(each(nearest)).unionByName(again)


def active_alerts(alerts: DataFrame, at_epoch: int, labels: dict[str, str], wanted: list[str]) -> DataFrame:
    """Distinct (agency, header) active at an instant.

    ``alerts``: agency_ids ARRAY<STRING>, header STRING, periods
    ARRAY<STRUCT<start: LONG, end: LONG>>; 0 is an open end, no period at all
    is always active.
    """
    at = F.lit(at_epoch)
    live = F.exists("periods", lambda p: ((p["start"] == 0) | (p["start"] <= at)) & ((p["end"] == 0) | (p["end"] >= at)))
    always = F.coalesce(F.size("periods") <= 0, F.lit(True))
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return (
        alerts.where(always | live)
        .select(F.explode("agency_ids").alias("_id"), "header")
        .select(F.try_element_at(pairs, F.col("_id")).alias("agency"), "header")
        .where(F.col("agency").isin(wanted)).distinct()
    )
