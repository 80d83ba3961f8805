"""Integrity of feeds: references, conflicts and overlaps. Every check returns its violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_references(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Of every reference how many rows name something that doesn't exist. A null names nothing."""
    parts = []
    for name, (rows, column, target, key) in checks.items():
        known = target.select(F.col(key).alias("__key")).distinct()
        lost = rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__key"), "left_anti")
        parts.append(lost.agg(F.count("*").alias("violations")).select(F.lit(name).alias("reference"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def route_conflicts(rules: DataFrame, trips: DataFrame) -> DataFrame:
    """Rules whose route isn't the route of their trip."""
    return rules.join(trips.select("trip_id", F.col("route_id").alias("trip_route")), "trip_id").where("trip_route <> rule_route").select("trip_id", "trip_route", "rule_route")


def overlapping_windows(windows: DataFrame) -> DataFrame:
    """Windows of a trip that overlap a later one. Windows meet by the buckets of time they cover, not all with all.

    The later one is in the bucket of its start only, so that a pair meets once and the pairs, which grow with the
    square of windows at one time, are never compared with each other.
    """
    width = 900
    at = lambda c: F.floor(F.col(c) / width)
    starts = windows.groupBy("trip_id", "start_time").agg(F.max("end_time").alias("end_time"))
    a = starts.where("start_time < end_time").select(
        "trip_id", F.col("start_time").alias("start_a"), F.col("end_time").alias("end_a"), F.explode(F.sequence(at("start_time"), F.floor((F.col("end_time") - 1) / width))).alias("bucket")
    )
    b = starts.select("trip_id", at("start_time").alias("bucket"), F.col("start_time").alias("start_b"))
    return a.join(b, ["trip_id", "bucket"]).where("start_a < start_b AND start_b < end_a").select("trip_id", "start_a", "start_b")


def mixed_exactness(frequencies: DataFrame) -> DataFrame:
    """Trips with both exact and inexact windows."""
    return frequencies.groupBy("trip_id").agg(F.countDistinct("exact_times").alias("n")).where("n > 1").select("trip_id")
