"""Timetable compilation: stop times to connections, repairs, runs, frequencies and service instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.shared import maybe_broadcast

MAX_CORRECTION = 600


def connections(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Neighbouring timed calls of a trip. Untimed calls are bridged; a missing arrival or departure is the other one."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    timed = stop_times.where("arrival IS NOT NULL OR departure IS NOT NULL")
    pairs = timed.select(
        "trip_id",
        F.coalesce("departure", "arrival").alias("departure"),
        F.lead(F.coalesce("arrival", "departure")).over(w).alias("arrival"),
        F.col("stop_id").alias("from_stop_id"),
        F.lead("stop_id").over(w).alias("to_stop_id"),
        "stop_sequence",
        "can_board",
        F.lead("can_alight").over(w).alias("can_alight"),
    ).where("to_stop_id IS NOT NULL")
    return pairs.join(trips, "trip_id").select(
        "departure", "arrival", "trip_id", "route_id", "service_id", "direction_id", "from_stop_id", "to_stop_id", "stop_sequence", "can_board", "can_alight"
    )


def backward_times(stop_times: DataFrame) -> DataFrame:
    """Calls that arrive before the call before them departs."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    return stop_times.withColumn("before", F.lag(F.coalesce("departure", "arrival")).over(w)).where("coalesce(arrival, departure) < before")


def repair_times(stop_times: DataFrame, most: int = MAX_CORRECTION) -> DataFrame:
    """Times raised to the running maximum of the trip; trips with a correction above `most` seconds are left out whole."""
    upto = Window.partitionBy("trip_id").orderBy("stop_sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("trip_id").orderBy("stop_sequence").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.greatest("arrival", "departure"))
    raised = stop_times.withColumn("fixed_arrival", F.greatest("arrival", latest.over(before))).withColumn("fixed_departure", F.greatest("departure", "fixed_arrival"))
    worst = F.max(F.greatest(F.col("fixed_arrival") - F.col("arrival"), F.col("fixed_departure") - F.col("departure"))).over(Window.partitionBy("trip_id"))
    del upto
    return (
        raised.withColumn("worst", worst)
        .where(F.coalesce("worst", F.lit(0)) <= most)
        .select("trip_id", "stop_sequence", "stop_id", F.col("fixed_arrival").alias("arrival"), F.col("fixed_departure").alias("departure"), "can_board", "can_alight")
    )


def runs(conns: DataFrame) -> DataFrame:
    """The number of the run a connection belongs to; a run ends where the next call isn't at the stop reached or comes too early."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    broken = (F.lag("to_stop_id").over(w) != F.col("from_stop_id")) | (F.lag("arrival").over(w) > F.col("departure"))
    return conns.withColumn("gap", F.coalesce(broken, F.lit(False)).cast("long")).withColumn("run", F.sum("gap").over(w)).drop("gap")


def bridged_gaps(conns: DataFrame) -> DataFrame:
    """Neighbours of a trip that leave a hole in the sequence at different stops but keep route, service and order in time."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    lag = lambda c: F.lag(c).over(w).alias(f"p_{c}")
    pairs = conns.select("*", lag("to_stop_id"), lag("arrival"), lag("stop_sequence"), lag("route_id"), lag("service_id"))
    return pairs.where(
        "p_to_stop_id <> from_stop_id AND stop_sequence - p_stop_sequence > 1 AND p_route_id = route_id AND p_service_id = service_id AND departure >= p_arrival"
    ).select(F.col("p_to_stop_id").alias("from_stop_id"), F.col("from_stop_id").alias("to_stop_id"), (F.col("departure") - F.col("p_arrival")).alias("seconds"))


def expand_frequencies(frequencies: DataFrame) -> DataFrame:
    """SC21: departures of headway windows, the end exclusive."""
    return frequencies.select("*", F.explode(F.sequence("start_time", F.col("end_time") - 1, "headway_secs")).alias("departure"))


def service_instances(days: DataFrame, offsets: tuple[int, int] = (-3, 5)) -> DataFrame:
    """Active services (service_id, day) as seconds from the asked day's midnight."""
    return days.where(F.col("offset").between(*offsets)).select("service_id", (F.col("offset") * 86400).alias("offset_seconds"))


def activate(conns: DataFrame, instances: DataFrame, horizon: int) -> DataFrame:
    """SC20: connections of active services with their clocks moved by the day's offset, from the asked midnight to the horizon."""
    moved = conns.join(maybe_broadcast(instances), "service_id")
    return moved.withColumns(
        {"departure": F.col("departure") + F.col("offset_seconds"), "arrival": F.col("arrival") + F.col("offset_seconds")}
    ).where((F.col("departure") >= 0) & (F.col("departure") <= horizon))


def time_bounds(conns: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Least departure and greatest arrival over connections and headway windows."""
    one = conns.select(F.col("departure").alias("lo"), F.col("arrival").alias("hi"))
    two = frequencies.select(F.col("start_time").cast("long").alias("lo"), F.col("end_time").cast("long").alias("hi"))
    return one.unionByName(two).agg(F.min("lo").alias("first_departure"), F.max("hi").alias("last_arrival"))


def access_roles(conns: DataFrame) -> DataFrame:
    """Which stops have a legal boarding and which a legal alighting."""
    board = conns.select(F.col("from_stop_id").alias("stop_id"), F.col("can_board").cast("int").alias("b"), F.lit(0).alias("a"))
    alight = conns.select(F.col("to_stop_id").alias("stop_id"), F.lit(0).alias("b"), F.col("can_alight").cast("int").alias("a"))
    return board.unionByName(alight).groupBy("stop_id").agg(F.max("b").alias("boards"), F.max("a").alias("alights"))


def topology(conns: DataFrame, transfers: DataFrame, stops: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Least seconds of every directed stop pair over rides, bridged gaps, transfers and, between undeclared platforms of a station, the fallback."""
    ride = conns.select("from_stop_id", "to_stop_id", (F.col("arrival") - F.col("departure")).alias("seconds"))
    walk = transfers.select("from_stop_id", "to_stop_id", F.col("seconds").cast("long").alias("seconds"))
    a, b = stops.select(F.col("stop_id").alias("from_stop_id"), "station_id"), stops.select(F.col("stop_id").alias("to_stop_id"), "station_id")
    pairs = a.join(b, "station_id").where("from_stop_id <> to_stop_id").join(walk, ["from_stop_id", "to_stop_id"], "left_anti")
    siblings = pairs.select("from_stop_id", "to_stop_id", (F.lit(120) if fallback is None else fallback).cast("long").alias("seconds"))
    every = ride.unionByName(bridged_gaps(conns)).unionByName(walk).unionByName(siblings)
    return every.where("from_stop_id <> to_stop_id").groupBy("from_stop_id", "to_stop_id").agg(F.min("seconds").alias("seconds"))


def merge_feeds(feeds: dict[str, DataFrame], ids: list[str]) -> DataFrame:
    """The union of one table of many feeds, every id with its feed's scope before it."""
    from tramline.functions.measures import scoped

    out = None
    for scope, rows in sorted(feeds.items()):
        rows = rows.withColumns({c: scoped(scope, F.col(c).cast("string")) for c in ids})
        out = rows if out is None else out.unionByName(rows)
    return out
