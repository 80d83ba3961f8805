"""Scenarios: exclusions, planned services, timing edits, partial cancellations, linked trips and fares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators.shared import maybe_broadcast


def exclude(conns: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """The timetable without the named trips and routes."""
    return conns.join(trips.select("trip_id"), "trip_id", "left_anti").join(routes.select("route_id"), "route_id", "left_anti")


def planned_service(stops: DataFrame, windows: DataFrame, kmh: float, dwell_seconds: int = 21, both_ways: bool = True) -> DataFrame:
    """Connections of a service over ordered stops at a headway, back too unless one-way; distances are equirectangular.

    stops: stop_no, stop_id, lat, lon. windows: start_time, end_time, headway_secs; the end belongs to the window.
    """
    def direction(rows: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(F.lit(name)).orderBy("n")  # a service has a few stops
        km = geo.equirectangular_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
        run = rows.withColumn("run", F.coalesce(F.ceil(km / kmh * 3600), F.lit(0)).cast("long"))
        timed = run.withColumn("arrive", F.sum(F.col("run") + F.when(F.col("n") > 1, dwell_seconds).otherwise(0)).over(w) - F.when(F.col("n") > 1, dwell_seconds).otherwise(0))
        pairs = timed.select("n", F.col("stop_id").alias("from_stop_id"), F.lead("stop_id").over(w).alias("to_stop_id"), F.when(F.col("n") > 1, F.col("arrive") + dwell_seconds).otherwise(F.col("arrive")).alias("leave"), F.lead("arrive").over(w).alias("reach"))
        return pairs.where("to_stop_id IS NOT NULL").withColumn("way", F.lit(name))

    out = direction(stops.withColumn("n", F.col("stop_no")), "out")
    if both_ways:
        last = stops.agg(F.max("stop_no").alias("m"))
        back = stops.crossJoin(F.broadcast(last)).withColumn("n", F.col("m") - F.col("stop_no") + 1).drop("m")
        out = out.unionByName(direction(back, "back"))
    starts = windows.select(F.explode(F.sequence("start_time", "end_time", "headway_secs")).alias("t")).distinct()
    rows = out.crossJoin(F.broadcast(starts))  # a service's departures of a day
    return rows.select(
        F.concat_ws("-", "way", F.col("t").cast("string")).alias("trip_id"), F.col("n").cast("int").alias("stop_sequence"), "from_stop_id", "to_stop_id", (F.col("t") + F.col("leave")).cast("long").alias("departure"), (F.col("t") + F.col("reach")).cast("long").alias("arrival")
    )


def edit_timing(conns: DataFrame, speed_factor: float, dwell_scale: float) -> DataFrame:
    """Running times divided, dwells multiplied; later calls move by what has added up."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.col("arrival") - F.col("departure")
    dwell = F.coalesce(F.col("departure") - F.lag("arrival").over(w), F.lit(0))
    rows = conns.withColumns({"run": F.round(run / speed_factor).cast("long"), "dwell": F.round(dwell * dwell_scale).cast("long")}).withColumn("begin", F.first("departure").over(w))
    total = F.sum(F.col("run") + F.col("dwell")).over(upto)
    return rows.select("trip_id", "stop_sequence", (F.col("begin") + total - F.col("run")).alias("departure"), (F.col("begin") + total).alias("arrival"))


def cancel_spans(conns: DataFrame, spans: DataFrame) -> DataFrame:
    """Connections outside the cancelled spans of sequences; a new run starts after each hole.

    spans: trip_id, from_seq, to_seq; a connection goes if its call lies in [from_seq, to_seq).
    """
    hit = conns.join(spans, "trip_id").where("stop_sequence >= from_seq AND stop_sequence < to_seq").select("trip_id", "stop_sequence").distinct()
    kept = conns.join(hit, ["trip_id", "stop_sequence"], "left_anti")
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    hole = F.coalesce(F.col("stop_sequence") - F.lag("stop_sequence").over(w) > 1, F.lit(False))
    return kept.withColumn("hole", hole.cast("long")).withColumn("run", F.sum("hole").over(w)).drop("hole")


def block_links(spans: DataFrame) -> DataFrame:
    """Trips of a block and service that follow each other: unique departures, no overlap before, same terminal.

    spans: block_id, service_id, trip_id, first_departure, last_arrival, first_stop, last_stop.
    """
    keys = ["block_id", "service_id"]
    w = Window.partitionBy(*keys).orderBy("first_departure", "trip_id")
    same = F.count("*").over(Window.partitionBy(*keys, "first_departure"))
    before = F.max("last_arrival").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = spans.select(*keys, "trip_id", "last_stop", F.lead("trip_id").over(w).alias("next_trip"), F.lead("first_departure").over(w).alias("leaves"), F.lead("first_stop").over(w).alias("from"), before.alias("latest"), same.alias("same"), F.lead("first_departure").over(w).alias("nd"))
    twice = spans.groupBy(*keys, "first_departure").agg(F.count("*").alias("c")).where("c > 1").select(*keys, F.col("first_departure").alias("nd"), F.lit(True).alias("twice"))
    linked = rows.join(twice, [*keys, "nd"], "left").where("next_trip IS NOT NULL AND same = 1 AND twice IS NULL AND latest <= leaves AND last_stop = from")
    return linked.select(*keys, "trip_id", "next_trip", (F.col("leaves") - F.col("latest")).alias("layover"))


def best_fare(legs: DataFrame, rules: DataFrame, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """The rule of each leg: by network and areas, an empty field fits all; highest priority first, then the lower amount. No fare is null, not free.

    legs: leg_id, network, from_area, to_area. rules: rule_id, network, from_area, to_area, priority, amount; with starts
    and ends also from_timeframe and to_timeframe: the groups that `in_timeframes` found for the legs' first and last time.
    """
    # A rule has the same place for every leg, so a leg's best is the least number. One row a rule of a feed.
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("priority"), "amount", "rule_id")
    placed = rules.withColumn("place", F.row_number().over(order))
    # A leg asks for the rules of its network and for those of any network under one key; few rules go to the legs, or
    # all legs would meet at the latter.
    asked = legs.withColumn("key", F.explode(F.array_distinct(F.array(F.coalesce("network", F.lit("*")), F.lit("*"))))).alias("l")
    known = maybe_broadcast(placed.withColumn("key", F.coalesce("network", F.lit("*")))).alias("r")
    fits = [F.col(f"r.{c}").isNull() | (F.col(f"r.{c}") == F.col(f"l.{c}")) for c in ("from_area", "to_area")]
    timed = [] if starts is None else ["from_timeframe", "to_timeframe"]
    found = asked.join(known, F.col("l.key") == F.col("r.key")).where(fits[0] & fits[1]).select("l.leg_id", "r.place", *[f"r.{c}" for c in timed])
    for column, inside in zip(timed, (starts, ends), strict=False):
        groups = inside.select("leg_id", F.col("timeframe").alias(column), F.lit(True).alias("inside"))
        found = found.join(groups, ["leg_id", column], "left").where(F.col(column).isNull() | F.col("inside")).drop("inside")
    best = found.groupBy("leg_id").agg(F.min("place").alias("place"))
    chosen = maybe_broadcast(placed.select("place", "rule_id", "amount"))
    return legs.select("leg_id").join(best, "leg_id", "left").join(chosen, "place", "left").select("leg_id", "rule_id", "amount")


def in_timeframes(events: DataFrame, frames: DataFrame, days: DataFrame) -> DataFrame:
    """leg_id and timeframe of every group that an event (leg_id, day, seconds) falls into: a frame's service runs on the day, and the time is from its start up to, not at, its end.

    frames: timeframe, service_id, start_time, end_time; both times empty: all day. A frame with one time only, or that doesn't begin before it ends, never fits.
    """
    whole = F.col("start_time").isNull() & F.col("end_time").isNull()
    valid = frames.where(whole | (F.col("start_time") < F.col("end_time")))
    on = valid.join(days, "service_id").select("timeframe", "day", F.coalesce("start_time", F.lit(0)).alias("lo"), F.coalesce("end_time", F.lit(86400)).alias("hi")).distinct()
    return events.join(on, "day").where((F.col("seconds") >= F.col("lo")) & (F.col("seconds") < F.col("hi"))).select("leg_id", "timeframe").distinct()


def fares_v1(legs: DataFrame, attributes: DataFrame, rules: DataFrame) -> DataFrame:
    """R25, first version: every fare that a leg may be paid with, cheapest first (rank); fares aren't added up.

    A fare without rules fits all legs; one with rules needs one whose route, origin and destination zone, where given,
    are the leg's. Rules that ask which zones lie in between aren't read: a leg that one fits has no fare and isn't
    supported. legs: leg_id, route_id, from_zone, to_zone. attributes: fare_id, price. rules: fare_id, route_id,
    origin_id, destination_id, contains_id.
    """
    asked = legs.withColumn("key", F.explode(F.array_distinct(F.array(F.coalesce("route_id", F.lit("*")), F.lit("*"))))).alias("l")
    free = attributes.join(rules.select("fare_id").distinct(), "fare_id", "left_anti").select("fare_id", *[F.lit(None).cast("string").alias(c) for c in ("route_id", "origin_id", "destination_id", "contains_id")])
    known = rules.select("fare_id", "route_id", "origin_id", "destination_id", "contains_id").unionByName(free).withColumn("key", F.coalesce("route_id", F.lit("*")))
    known = maybe_broadcast(known).alias("r")  # as in best_fare
    fits = [F.col(f"r.{a}").isNull() | (F.col(f"r.{a}") == F.col(f"l.{b}")) for a, b in (("origin_id", "from_zone"), ("destination_id", "to_zone"))]
    met = asked.join(known, F.col("l.key") == F.col("r.key")).where(fits[0] & fits[1]).select("l.leg_id", "r.fare_id", "r.contains_id")
    options = met.groupBy("leg_id", "fare_id").agg(F.count("contains_id").alias("asks")).join(maybe_broadcast(attributes.select("fare_id", "price")), "fare_id")
    asks = F.max("asks").over(Window.partitionBy("leg_id"))
    ranked = options.withColumn("supported", asks == 0).withColumn("rank", F.row_number().over(Window.partitionBy("leg_id").orderBy("price", "fare_id")))
    kept = ranked.where("supported OR rank = 1")
    keep = lambda c: F.when(F.col("supported"), F.col(c)).alias(c)
    found = kept.select("leg_id", keep("fare_id"), keep("price"), keep("rank"), "supported")
    return legs.select("leg_id").join(found, "leg_id", "left").withColumn("supported", F.coalesce("supported", F.lit(True)))
