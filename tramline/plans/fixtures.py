"""Timetable-shaped relations derived from the test tables, in Spark and in DuckDB's SQL.

`Views` gives each relation as a DataFrame; `with_views` puts the same relations as common table
expressions before a query, so that both engines start from equal rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EARTH_2R_KM = 12742.0176


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def calls(self) -> DataFrame:
        return self.table("events").select(
            "user_id",
            F.to_date("ts").alias("d"),
            F.get_json_object("props", "$.k").cast("int").alias("stop_id"),
            (F.unix_timestamp("ts") % 86400).alias("sec"),
            "event_id",
            "event_type",
            "value",
        )

    @cached_property
    def stop_times(self) -> DataFrame:
        w = Window.partitionBy("user_id", "d").orderBy("sec", "event_id")
        return self.calls.select(
            F.concat_ws("-", F.col("user_id").cast("string"), F.col("d").cast("string")).alias("trip_id"),
            F.row_number().over(w).alias("stop_sequence"),
            "stop_id",
            F.col("sec").alias("arrival"),
            F.col("sec").alias("departure"),
            (F.col("event_type") != "error").alias("can_board"),
            (F.col("event_type") != "signup").alias("can_alight"),
        )

    @cached_property
    def trips(self) -> DataFrame:
        return self.calls.select(
            F.concat_ws("-", F.col("user_id").cast("string"), F.col("d").cast("string")).alias("trip_id"),
            F.concat(F.lit("R"), (F.col("user_id") % 20).cast("string")).alias("route_id"),
            F.concat(F.lit("D"), (F.weekday("d") + 1).cast("string")).alias("service_id"),
            (F.col("user_id") % 2).cast("int").alias("direction_id"),
        ).distinct()

    @cached_property
    def connections(self) -> DataFrame:
        from tramline.operators import timetable

        return timetable.connections(self.stop_times, self.trips)

    @cached_property
    def stops(self) -> DataFrame:
        tens = F.floor(F.col("stop_id") / 10)
        return self.calls.select("stop_id").distinct().select(
            "stop_id",
            (F.lit(38.90) + (F.col("stop_id") % 10) * F.lit(0.01)).alias("lat"),
            (F.lit(-77.05) + tens * F.lit(0.01)).alias("lon"),
            tens.cast("int").alias("station_id"),
        )

    @cached_property
    def transfers(self) -> DataFrame:
        from tramline.operators import transfers

        return transfers.near_stops(self.stops, 1.2).select("from_stop_id", "to_stop_id", transfers.walk_seconds(F.col("km")).alias("seconds"))

    @cached_property
    def routes(self) -> DataFrame:
        """Routes R0 to R20; the last has no trips, and some have no type."""
        return self.spark.range(21).select(
            F.concat(F.lit("R"), F.col("id").cast("string")).alias("route_id"), F.when(F.col("id") % 5 != 4, (F.col("id") % 4).cast("int")).alias("route_type")
        )

    @cached_property
    def calendar(self) -> DataFrame:
        return self.spark.range(1, 8).select(
            F.concat(F.lit("D"), F.col("id").cast("string")).alias("service_id"),
            *[(F.col("id") == k).cast("int").alias(day) for k, day in enumerate(DAYS, 1)],
            F.lit(20240101).alias("start_date"),
            F.lit(20240131).alias("end_date"),
        )

    @cached_property
    def exceptions(self) -> DataFrame:
        return self.spark.createDataFrame([("D1", 20240115, 2), ("D7", 20240115, 1)], "service_id string, date int, exception_type int")

    @cached_property
    def frequencies(self) -> DataFrame:
        number = F.substring("route_id", 2, 9).cast("int")
        return self.trips.select("route_id").distinct().select(
            "route_id", F.lit(21600).alias("start_time"), F.lit(32400).alias("end_time"), (600 + 60 * number).alias("headway_secs")
        )

    @cached_property
    def street_edges(self) -> DataFrame:
        from tramline.operators import transfers

        near = transfers.near_stops(self.stops, 1.2).where("(from_stop_id + to_stop_id) % 7 <> 0 OR from_stop_id < to_stop_id")
        return near.select(F.col("from_stop_id").alias("u"), F.col("to_stop_id").alias("v"), F.round(F.col("km") * 1000).cast("int").alias("metres"))

    @cached_property
    def trip_updates(self) -> DataFrame:
        """A report for each error call: its delay, and when it was seen."""
        return self.calls.where("event_type = 'error'").select(
            F.concat_ws("-", F.col("user_id").cast("string"), F.col("d").cast("string")).alias("trip_id"),
            "stop_id",
            "sec",
            F.round("value").cast("int").alias("delay"),
            "event_id",
        )

    @cached_property
    def opportunities(self) -> DataFrame:
        return self.table("customer").groupBy((F.col("c_nationkey") * 4).cast("int").alias("stop_id")).agg(F.count("*").alias("count"))


DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

#: The relations in the order in which they build on each other.
SQL = {
    "fx_calls": """SELECT user_id, CAST(ts AS DATE) AS d, CAST(json_extract(props,'$.k') AS INTEGER) AS stop_id,
       CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS sec, event_id, event_type, value FROM events""",
    "fx_stop_times": """SELECT CAST(user_id AS VARCHAR) || '-' || CAST(d AS VARCHAR) AS trip_id,
       CAST(row_number() OVER (PARTITION BY user_id, d ORDER BY sec, event_id) AS INTEGER) AS stop_sequence,
       stop_id, sec AS arrival, sec AS departure,
       event_type <> 'error' AS can_board, event_type <> 'signup' AS can_alight FROM fx_calls""",
    "fx_trips": """SELECT DISTINCT CAST(user_id AS VARCHAR) || '-' || CAST(d AS VARCHAR) AS trip_id,
       'R' || CAST(user_id % 20 AS VARCHAR) AS route_id, 'D' || CAST(isodow(d) AS VARCHAR) AS service_id,
       CAST(user_id % 2 AS INTEGER) AS direction_id FROM fx_calls""",
    "fx_connections": """SELECT s.departure, s.n_arr AS arrival, s.trip_id, t.route_id, t.service_id, t.direction_id,
       s.stop_id AS from_stop_id, s.n_stop AS to_stop_id, s.stop_sequence, s.can_board, s.n_alight AS can_alight
FROM (SELECT *, lead(arrival) OVER w AS n_arr, lead(stop_id) OVER w AS n_stop, lead(can_alight) OVER w AS n_alight
      FROM fx_stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) s
JOIN fx_trips t USING (trip_id) WHERE s.n_stop IS NOT NULL""",
    "fx_stops": """SELECT DISTINCT stop_id, CAST(38.90 AS DOUBLE) + (stop_id % 10) * CAST(0.01 AS DOUBLE) AS lat,
       CAST(-77.05 AS DOUBLE) + floor(stop_id / 10) * CAST(0.01 AS DOUBLE) AS lon,
       CAST(floor(stop_id / 10) AS INTEGER) AS station_id FROM fx_calls""",
    "fx_near": """SELECT * FROM (SELECT a.stop_id AS from_stop_id, b.stop_id AS to_stop_id,
       12742.0176 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat))
            * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km
FROM fx_stops a JOIN fx_stops b ON a.stop_id <> b.stop_id AND abs(a.lat - b.lat) < 0.0205 AND abs(a.lon - b.lon) < 0.0205) WHERE km <= 1.2""",
    "fx_transfers": """SELECT from_stop_id, to_stop_id, CAST(ceil(km / 4.8 * 3600) AS INTEGER) AS seconds FROM fx_near""",
    "fx_routes": """SELECT 'R' || CAST(k AS VARCHAR) AS route_id, CASE WHEN k % 5 <> 4 THEN CAST(k % 4 AS INTEGER) END AS route_type FROM range(21) r(k)""",
    "fx_calendar": """SELECT 'D' || CAST(k AS VARCHAR) AS service_id, CAST(k = 1 AS INTEGER) AS monday, CAST(k = 2 AS INTEGER) AS tuesday,
       CAST(k = 3 AS INTEGER) AS wednesday, CAST(k = 4 AS INTEGER) AS thursday, CAST(k = 5 AS INTEGER) AS friday,
       CAST(k = 6 AS INTEGER) AS saturday, CAST(k = 7 AS INTEGER) AS sunday, 20240101 AS start_date, 20240131 AS end_date FROM range(1, 8) r(k)""",
    "fx_exceptions": "SELECT * FROM (VALUES ('D1',20240115,2),('D7',20240115,1)) v(service_id, date, exception_type)",
    "fx_frequencies": """SELECT DISTINCT route_id, 21600 AS start_time, 32400 AS end_time,
       600 + 60 * CAST(substr(route_id, 2) AS INTEGER) AS headway_secs FROM fx_trips""",
    "fx_street_edges": """SELECT from_stop_id AS u, to_stop_id AS v, CAST(round(km * 1000) AS INTEGER) AS metres FROM fx_near
WHERE (from_stop_id + to_stop_id) % 7 <> 0 OR from_stop_id < to_stop_id""",
    "fx_trip_updates": """SELECT CAST(user_id AS VARCHAR) || '-' || CAST(d AS VARCHAR) AS trip_id, stop_id, sec,
       CAST(round(value) AS INTEGER) AS delay, event_id FROM fx_calls WHERE event_type = 'error'""",
    "fx_opportunities": "SELECT CAST(c_nationkey * 4 AS INTEGER) AS stop_id, count(*) AS count FROM customer GROUP BY 1",
}


def with_views(body: str, extra: str = "") -> str:
    """body after the relations it needs (by name), and further expressions of its own."""
    needed: set[str] = set()
    todo = [body + extra]
    while todo:
        text = todo.pop()
        for name, sql in SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(sql)
    parts = [f"{name} AS MATERIALIZED ({SQL[name]})" for name in SQL if name in needed]
    if extra:
        parts.append(extra)
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
