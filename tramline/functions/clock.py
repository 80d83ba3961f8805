"""Service-day clocks and dates as column expressions.

A service-day time is an integer number of seconds since noon less twelve hours; it may exceed a day and is
never reduced by it. A date is an integer YYYYMMDD.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"^\s*(\d{1,3}):([0-5]\d):([0-5]\d)\s*$"


def parse_clock(text: Column) -> Column:
    """Seconds of H:MM:SS with one to three digits of hours; null for anything else."""
    part = lambda k: F.regexp_extract(text, CLOCK, k).cast("int")
    return F.when(text.rlike(CLOCK), part(1) * 3600 + part(2) * 60 + part(3))


def parse_request_clock(text: Column) -> Column:
    """Seconds of HH:MM or HH:MM:SS with hours up to 71; null for anything else."""
    pattern = r"^(\d{1,2}):([0-5]\d)(?::([0-5]\d))?$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    hours = part(1).cast("int")
    seconds = F.when(part(3) == "", F.lit(0)).otherwise(part(3).cast("int"))
    return F.when(text.rlike(pattern) & (hours <= 71), hours * 3600 + part(2).cast("int") * 60 + seconds)


def format_clock(seconds: Column) -> Column:
    """HH:MM:SS with hours that run on after a day."""
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    whole = lambda n, by: F.floor(n / by).cast("long")
    return F.concat_ws(":", two(whole(seconds, 3600)), two(whole(seconds % 3600, 60)), two((seconds % 60).cast("long")))


def parse_date(text: Column) -> Column:
    """YYYYMMDD as an integer if it is a day of the calendar; else null."""
    as_date = F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")
    return F.when(text.rlike(r"^\d{8}$") & (F.date_format(as_date, "yyyyMMdd") == text), text.cast("int"))


def to_day(yyyymmdd: Column) -> Column:
    return F.to_date(yyyymmdd.cast("string"), "yyyyMMdd")


def service_epoch(day: Column, zone: str) -> Column:
    """The instant a service day counts from: local noon less twelve hours."""
    noon = F.to_timestamp(F.concat(day.cast("string"), F.lit(" 12:00:00")))
    return F.to_utc_timestamp(noon, zone) - F.expr("INTERVAL 12 HOURS")
