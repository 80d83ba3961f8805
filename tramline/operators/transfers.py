"""Walking transfers, station hierarchies and transfer rules."""

from __future__ import annotations

import itertools

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators.shared import materialize

CELL = 0.01


def walk_seconds(km: Column, km_per_hour: float = 4.8) -> Column:
    return F.ceil(km / km_per_hour * 3600).cast("int")


def near_points(points: DataFrame, stops: DataFrame, radius_km: float) -> DataFrame:
    """Points with each stop within a radius and its distance: a point meets the stops of the grid cells around it, not every stop."""
    # A degree of latitude is 111.19 km; of longitude less, so its reach depends on the latitude's band.
    reach_y = int(radius_km / (111.19 * CELL)) + 1
    band = F.cos(F.radians(F.least(F.abs("lat") + reach_y * CELL, F.lit(89.0))))
    reach_x = (F.floor(F.lit(radius_km) / (111.19 * CELL * band)) + 1).cast("int")
    cell = lambda c: F.floor(F.col(c) / CELL).cast("long")
    own = [c for c in points.columns if c not in ("lat", "lon")]
    spread = (
        points.withColumn("dy", F.explode(F.sequence(F.lit(-reach_y), F.lit(reach_y))))
        .withColumn("dx", F.explode(F.sequence(-reach_x, reach_x)))
        .select(*own, F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), (cell("lat") + F.col("dy")).alias("y"), (cell("lon") + F.col("dx")).alias("x"))
    )
    here = stops.select("stop_id", "lat", "lon", cell("lat").alias("y"), cell("lon").alias("x"))
    km = geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon"))
    return spread.join(here, ["y", "x"]).select(*own, "stop_id", km.alias("km")).where(F.col("km") <= radius_km)


def near_stops(stops: DataFrame, radius_km: float) -> DataFrame:
    """Ordered pairs of stops within a radius."""
    points = stops.select(F.col("stop_id").alias("from_stop_id"), "lat", "lon")
    found = near_points(points, stops, radius_km).where("from_stop_id <> stop_id")
    return found.select("from_stop_id", F.col("stop_id").alias("to_stop_id"), "km")


def transfer_index(declared: DataFrame, siblings: DataFrame, served: DataFrame) -> DataFrame:
    """Least seconds of each declared pair that isn't forbidden and leads to a stop with service; platforms of a station without a declared pair get the fallback."""
    allowed = declared.where("NOT forbidden").groupBy("from_stop_id", "to_stop_id").agg(F.min("seconds").alias("seconds"))
    rest = siblings.join(declared.select("from_stop_id", "to_stop_id").distinct(), ["from_stop_id", "to_stop_id"], "left_anti")
    every = allowed.unionByName(rest.select("from_stop_id", "to_stop_id", "seconds"))
    return every.join(served.select(F.col("stop_id").alias("to_stop_id")).distinct(), "to_stop_id", "left_semi").select("from_stop_id", "to_stop_id", "seconds")


def ancestors(parents: DataFrame, most: int = 8) -> DataFrame:
    """(stop_id, ancestor, depth) with the stop itself at depth 0; a chain longer than `most` is an error of the data and ends there."""
    level = parents.select("stop_id", F.col("stop_id").alias("ancestor"), F.lit(0).alias("depth"))
    levels = [level]
    up = parents.where("parent_id IS NOT NULL").select(F.col("stop_id").alias("ancestor"), F.col("parent_id"))
    for k in range(1, most + 1):
        level = level.join(up, "ancestor").select("stop_id", F.col("parent_id").alias("ancestor"), F.lit(k).alias("depth"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def hierarchy_problems(parents: DataFrame) -> DataFrame:
    """Stops with a parent that doesn't exist, and stops that are their own ancestor."""
    missing = parents.where("parent_id IS NOT NULL").join(parents.select(F.col("stop_id").alias("parent_id")), "parent_id", "left_anti")
    cyclic = ancestors(parents).where("depth > 0 AND ancestor = stop_id").select("stop_id").distinct()
    return missing.select("stop_id", F.lit("missing_parent").alias("problem")).unionByName(cyclic.select("stop_id", F.lit("cycle").alias("problem")))


def governing_rule(rules: DataFrame, closure: DataFrame) -> DataFrame:
    """Of the rules of a stop and its ancestors the shallowest; then a forbidden one; then the longest minimum."""
    found = closure.join(rules.withColumnRenamed("stop_id", "ancestor"), "ancestor")
    w = Window.partitionBy("stop_id").orderBy("depth", F.desc("forbidden"), F.desc("minimum"))
    return found.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("stop_id", "depth", "forbidden", "minimum")


def specific_rule(candidates: DataFrame) -> DataFrame:
    """The most specific rule of each pair of trips, and whether an equally specific one contradicts it.

    candidates: pair, from_trip, to_trip, from_route, to_route (booleans: whether the rule names them), depth, minimum.
    """
    weight = (
        F.when(F.col("from_trip") & F.col("to_trip"), 6)
        .when((F.col("from_trip") & F.col("to_route")) | (F.col("to_trip") & F.col("from_route")), 5)
        .when(F.col("from_trip") | F.col("to_trip"), 4)
        .when(F.col("from_route") & F.col("to_route"), 3)
        .when(F.col("from_route") | F.col("to_route"), 2)
        .otherwise(1)
    )
    ranked = candidates.withColumn("specificity", weight)
    w = Window.partitionBy("pair").orderBy(F.desc("specificity"), "depth")
    best = ranked.withColumn("rank", F.rank().over(w)).where("rank = 1")
    return best.groupBy("pair").agg(
        F.max("specificity").alias("specificity"), F.max("minimum").alias("minimum"), (F.min("minimum") != F.max("minimum")).alias("conflict")
    )


def station_paths(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Non-dominated (seconds, metres) walks between platforms, one edge more a round until nothing improves.

    Seconds and metres aren't negative, so that the rounds end. most: walks of at most so many edges and one are asked for.
    """
    if edges.where("seconds < 0 OR metres < 0").limit(1).count():
        raise ValueError("an edge's seconds or metres are negative")
    best = materialize(edges.select("u", "v", "seconds", "metres").groupBy("u", "v", "seconds").agg(F.min("metres").alias("metres")))
    for _ in itertools.count() if most is None else range(most):
        onward = best.select("u", F.col("v").alias("mid"), F.col("seconds").alias("s1"), F.col("metres").alias("m1")).join(
            edges.select(F.col("u").alias("mid"), "v", F.col("seconds").alias("s2"), F.col("metres").alias("m2")), "mid"
        )
        longer = onward.where("u <> v").select("u", "v", (F.col("s1") + F.col("s2")).alias("seconds"), (F.col("m1") + F.col("m2")).alias("metres"))
        merged = skyline(best.unionByName(longer), ["u", "v"], "seconds", "metres")
        merged = materialize(merged)
        if merged.count() == best.count() and not merged.join(best, ["u", "v", "seconds", "metres"], "left_anti").limit(1).count():
            return merged
        best = merged
    return best


def skyline(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """W11 on two criteria: sorted by x, a row stays if its y is below all before it."""
    w = Window.partitionBy(*keys).orderBy(x, y).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__least", F.min(y).over(w)).where(F.col("__least").isNull() | (F.col(y) < F.col("__least"))).drop("__least")
