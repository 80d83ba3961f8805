"""Services by date: weekly masks, exceptions, coverage and the nearest day with service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def service_days(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, day) of every active day: the weekly mask inside the dates, plus added, less removed days."""
    mask = F.array(*[F.col(d) for d in DAYS])
    date = lambda c: F.to_date(F.col(c).cast("string"), "yyyyMMdd")
    weekly = calendar.select("service_id", mask.alias("mask"), F.explode(F.sequence(date("start_date"), date("end_date"))).alias("day"))
    weekly = weekly.where(F.col("mask")[F.weekday("day")] == 1).select("service_id", "day")
    of = lambda kind: exceptions.where(F.col("exception_type") == kind).select("service_id", date("date").alias("day"))
    return weekly.unionByName(of(1)).distinct().join(of(2), ["service_id", "day"], "left_anti")


def active_on(calendar: DataFrame, exceptions: DataFrame, yyyymmdd: int) -> DataFrame:
    """Services active on one date, without expanding the other days."""
    weekday = F.weekday(F.to_date(F.lit(str(yyyymmdd)), "yyyyMMdd"))
    mask = F.array(*[F.col(d) for d in DAYS])
    weekly = calendar.where((F.col("start_date") <= yyyymmdd) & (F.col("end_date") >= yyyymmdd) & (mask[weekday] == 1)).select("service_id")
    today = exceptions.where(F.col("date") == yyyymmdd)
    added = today.where("exception_type = 1").select("service_id")
    return weekly.unionByName(added).distinct().join(today.where("exception_type = 2").select("service_id"), "service_id", "left_anti")


def service_ids(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Every service that a calendar or an exception names."""
    return calendar.select("service_id").unionByName(exceptions.select("service_id")).distinct()


def coverage(calendar: DataFrame, exceptions: DataFrame, scope) -> DataFrame:
    """First and last date of each scope over calendars and added days."""
    dates = calendar.select(scope.alias("scope"), F.col("start_date").alias("lo"), F.col("end_date").alias("hi")).unionByName(
        exceptions.where("exception_type = 1").select(scope.alias("scope"), F.col("date").alias("lo"), F.col("date").alias("hi"))
    )
    return dates.where("lo > 19010101 AND hi < 20991231").groupBy("scope").agg(F.min("lo").alias("first_date"), F.max("hi").alias("last_date"))


def complete_range(cover: DataFrame) -> DataFrame:
    """Dates that every scope covers."""
    return cover.agg(F.max("first_date").alias("first_date"), F.min("last_date").alias("last_date"))


def fallback_date(days: DataFrame, asked: int, scope) -> DataFrame:
    """The date with most scopes in service; of those the nearest to the asked one, then the earliest."""
    found = days.groupBy("day").agg(F.countDistinct(scope).alias("scopes"))
    gap = F.abs(F.datediff(F.col("day"), F.to_date(F.lit(str(asked)), "yyyyMMdd")))
    return found.withColumn("gap", gap).orderBy(F.desc("scopes"), "gap", "day").limit(1)
