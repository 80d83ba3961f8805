"""Network overview and route analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.functions.measures import frequency_class, half_up

MAX_GAP = 6 * 3600


def stop_modes(conns: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Departures by station (or stop) and route type, where boarding is allowed."""
    place = stops.select(F.col("stop_id").alias("from_stop_id"), F.coalesce("station_id", "stop_id").alias("place_id"))
    return conns.where("can_board").join(place, "from_stop_id").join(routes.select("route_id", "route_type"), "route_id").groupBy("place_id", "route_type").agg(F.count("*").alias("departures"))


def route_services(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """Trips of every route, 0 where it has none; the default type is 3."""
    counts = trips.groupBy("route_id").agg(F.count("*").alias("n"))
    return routes.join(counts, "route_id", "left").select("route_id", F.coalesce("route_type", F.lit(3)).alias("route_type"), F.coalesce("n", F.lit(0)).alias("trips"))


def trip_spans(conns: DataFrame) -> DataFrame:
    """First departure, last arrival and number of connections of a trip."""
    return conns.groupBy("route_id", "service_id", "direction_id", "trip_id").agg(
        F.min_by("departure", "stop_sequence").alias("first_departure"), F.max_by("arrival", "stop_sequence").alias("last_arrival"), F.count("*").alias("n")
    )


def service_statistics(conns: DataFrame) -> DataFrame:
    """A3: by service, then by route; the mean headway is the sum of spans over the sum of gaps, in minutes, 1 at least."""
    by_service = trip_spans(conns).groupBy("route_id", "service_id").agg(
        F.min("first_departure").alias("first"),
        F.max("first_departure").alias("last"),
        F.max("last_arrival").alias("end"),
        F.sum(F.col("last_arrival") - F.col("first_departure")).alias("runtime"),
        F.count("*").alias("trips"),
    )
    mean = F.sum(F.col("last") - F.col("first")) / F.sum(F.col("trips") - 1)
    return by_service.groupBy("route_id").agg(
        F.min("first").alias("first_departure"),
        F.max("end").alias("last_arrival"),
        F.sum("runtime").alias("runtime"),
        F.sum("trips").alias("trips"),
        F.when(F.sum(F.col("trips") - 1) > 0, F.greatest(F.lit(1), half_up(mean / 60))).otherwise(0).alias("headway_minutes"),
    )


def median_headways(conns: DataFrame) -> DataFrame:
    """Median of the gaps, up to six hours, between distinct departures of one service and direction, in minutes, 1 at least, 0 without gaps."""
    starts = trip_spans(conns).select("route_id", "direction_id", "service_id", F.col("first_departure").alias("t")).distinct()
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("route_id", "direction_id", "service_id").orderBy("t"))
    gaps = starts.withColumn("gap", gap)
    median = F.percentile(F.when((F.col("gap") > 0) & (F.col("gap") <= MAX_GAP), F.col("gap")), F.lit(0.5))
    found = gaps.groupBy("route_id", "direction_id").agg(F.coalesce(F.greatest(F.lit(1), half_up(median / 60)), F.lit(0)).alias("headway_minutes"))
    return found.withColumn("frequency", frequency_class(F.col("headway_minutes")))


def patterns(conns: DataFrame) -> DataFrame:
    """A5: trips of a route with the same direction and stops in order; share and rank by trips, direction, signature."""
    calls = F.array_sort(F.collect_list(F.struct("stop_sequence", "from_stop_id", "to_stop_id")))
    ordered = conns.groupBy("route_id", "direction_id", "trip_id").agg(calls.alias("c"))
    stops = F.concat(F.array(F.col("c")[0]["from_stop_id"]), F.transform("c", lambda x: x["to_stop_id"]))
    signed = ordered.select("route_id", "direction_id", "trip_id", F.array_join(stops.cast("array<string>"), ">").alias("signature"))
    counted = signed.groupBy("route_id", "direction_id", "signature").agg(F.count("*").alias("trips"), F.min("trip_id").alias("representative"))
    w = Window.partitionBy("route_id").orderBy(F.desc("trips"), "direction_id", "signature")
    share = F.round(F.col("trips") / F.sum("trips").over(Window.partitionBy("route_id")), 6)
    return counted.select("*", share.alias("share"), F.row_number().over(w).alias("rank"))


def pattern_metrics(conns: DataFrame) -> DataFrame:
    """Hours from first to last departure, hours of service, trips by route and direction."""
    spans = trip_spans(conns)
    return spans.groupBy("route_id", "direction_id").agg(
        F.round((F.max("first_departure") - F.min("first_departure")) / 3600, 6).alias("span_hours"),
        F.round(F.sum(F.col("last_arrival") - F.col("first_departure")) / 3600, 6).alias("service_hours"),
        F.floor(F.min("first_departure") / 60).cast("long").alias("first_minute"),
        F.floor(F.max("first_departure") / 60).cast("long").alias("last_minute"),
    )


def stop_pairs(conns: DataFrame, stops: DataFrame) -> DataFrame:
    """Median runtime, distance and speed of every pair of neighbouring stops."""
    side = lambda c, n: stops.select(F.col("stop_id").alias(c), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"))
    pairs = conns.where("from_stop_id <> to_stop_id").groupBy("from_stop_id", "to_stop_id").agg(
        F.percentile(F.col("arrival") - F.col("departure"), F.lit(0.5)).alias("seconds"), F.count("*").alias("rides")
    )
    km = geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    found = pairs.join(side("from_stop_id", 1), "from_stop_id").join(side("to_stop_id", 2), "to_stop_id").withColumn("raw", km)
    return found.select(
        "from_stop_id", "to_stop_id", "seconds", "rides", F.round("raw", 6).alias("km"), F.when(F.col("seconds") > 0, F.round(F.col("raw") / F.col("seconds") * 3600, 4)).alias("kmh")
    )


def transfer_scores(conns: DataFrame) -> DataFrame:
    """min(100, 24 routes + 18 log10(trips)) of each stop."""
    found = conns.groupBy(F.col("from_stop_id").alias("stop_id")).agg(F.countDistinct("route_id").alias("routes"), F.countDistinct("trip_id").alias("trips"))
    return found.withColumn("score", F.round(F.least(F.lit(100.0), 24 * F.col("routes") + 18 * F.log10(F.greatest(F.lit(1), F.col("trips")))), 6))


def service_profile(conns: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Departures by mode band of a station: the greater of its own and the sum of its members."""
    band = F.when(F.col("route_type") <= 2, "rail").when(F.col("route_type") == 3, "bus").otherwise("other")
    own = conns.join(routes.select("route_id", "route_type"), "route_id").groupBy(F.col("from_stop_id").alias("stop_id"), band.alias("band")).agg(F.count("*").alias("n"))
    by_station = own.join(stops.select("stop_id", "station_id"), "stop_id")
    return by_station.groupBy("station_id", "band").agg(F.greatest(F.sum("n"), F.max(F.when(F.col("stop_id") == F.col("station_id"), F.col("n")).otherwise(0))).alias("departures"))


def anchors(profile: DataFrame, stops: DataFrame, most: int) -> DataFrame:
    """The stops with most departures in every 0.01 degree cell."""
    cell = lambda c: F.floor(F.round(F.col(c) * 100, 6)).cast("long")
    placed = profile.join(stops, "stop_id").withColumn("y", cell("lat")).withColumn("x", cell("lon"))
    w = Window.partitionBy("y", "x").orderBy(F.desc("departures"), "stop_id")
    return placed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("y", "x", "stop_id", "departures", "rank")


def feed_preview(conns: DataFrame) -> DataFrame:
    """Representative trip, trips, and the class of a route's trips against the busiest route's."""
    found = conns.groupBy("route_id").agg(F.min("trip_id").alias("representative"), F.countDistinct("trip_id").alias("trips"))
    busiest = F.broadcast(found.agg(F.max("trips").alias("most")))  # one row
    share = F.col("trips") / F.col("most")
    return found.crossJoin(busiest).select(
        "route_id", "representative", "trips", F.when(share >= 0.5, "high").when(share >= 0.2, "medium").otherwise("low").alias("frequency")
    )


def shared_departures(conns: DataFrame, stop_id: int, start: int, end: int) -> DataFrame:
    """Departures from a stop in [start, end): count, distinct times, per hour, and the mean, least and greatest gap."""
    rows = conns.where((F.col("from_stop_id") == stop_id) & (F.col("departure") >= start) & (F.col("departure") < end) & F.col("can_board"))
    times = rows.groupBy("route_id", "departure").agg(F.count("*").alias("n"))
    gap = F.col("departure") - F.lag("departure").over(Window.partitionBy("route_id").orderBy("departure"))
    return times.withColumn("gap", gap).groupBy("route_id").agg(
        F.sum("n").alias("departures"),
        F.count("*").alias("distinct_departures"),
        F.round(F.sum("n") * 3600 / (end - start), 6).alias("per_hour"),
        F.round(F.avg("gap"), 6).alias("mean_gap"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
    )


def feature_inventory(stop_times: DataFrame, exceptions: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Counts of special features of a feed."""
    one = lambda df, name, condition: df.agg(F.count_if(condition).alias("n")).select(F.lit(name).alias("feature"), "n")
    return (
        one(stop_times, "no_boarding", ~F.col("can_board"))
        .unionByName(one(stop_times, "no_alighting", ~F.col("can_alight")))
        .unionByName(one(exceptions, "removed_days", F.col("exception_type") == 2))
        .unionByName(one(frequencies, "headway_windows", F.lit(True)))
    )
