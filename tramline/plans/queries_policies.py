"""Queries of the smaller rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import policies, timetable
from tramline.plans.registry import query

NOW = 43200


@query("p2_source_scopes", "SELECT 'rail' || chr(31) || trip_id AS trip_id FROM fx_trips")
def _(v):
    rows = v.trips.select("trip_id")
    return policies.in_scopes(timetable.merge_feeds({"bus": rows, "rail": rows}, ["trip_id"]), "trip_id", ["rail"])


@query("p3_legal_boardings", "SELECT trip_id, stop_sequence FROM fx_connections WHERE can_board")
def _(v):
    return policies.legal_boardings(v.connections).select("trip_id", "stop_sequence")


@query(
    "p8_wheelchair",
    """SELECT c.trip_id, c.stop_sequence, c.can_board AND coalesce(a.ok, false) AS can_board, c.can_alight AND coalesce(b.ok, false) AS can_alight FROM fx_connections c LEFT JOIN access a ON a.stop_id = c.from_stop_id LEFT JOIN access b ON b.stop_id = c.to_stop_id WHERE length(c.trip_id) % 2 = 0""",
    """access AS (SELECT s.stop_id, CASE WHEN s.stop_id % 3 = 0 THEN coalesce(p.stop_id % 3, 0) ELSE s.stop_id % 3 END = 1 AS ok FROM fx_stops s LEFT JOIN fx_stops p ON p.stop_id = s.stop_id // 10)""",
)
def _(v):
    stops = v.stops.select("stop_id", (F.col("stop_id") % 3).alias("wheelchair"), F.floor(F.col("stop_id") / 10).cast("int").alias("parent_id"))
    trips = v.trips.select("trip_id", F.when(F.length("trip_id") % 2 == 0, 1).otherwise(2).alias("wheelchair_accessible"))
    return policies.wheelchair_connections(v.connections, trips, stops).select("trip_id", "stop_sequence", "can_board", "can_alight")


@query(
    "p11_weekly_windows",
    """SELECT ask_id, active, CASE WHEN active THEN until_end ELSE until_start END AS change_in FROM (SELECT ask_id, bool_or(minute >= s AND minute < e) AS active, min(CASE WHEN minute >= s AND minute < e THEN e - minute END) AS until_end, min((s - minute + 10080) % 10080) AS until_start
FROM (SELECT event_id AS ask_id, stop_id AS id, CAST(sec % 10080 AS INTEGER) AS minute FROM fx_calls) a JOIN (SELECT stop_id AS id, stop_id * 50 AS s, stop_id * 50 + 600 AS e FROM fx_stops UNION ALL SELECT stop_id, stop_id * 50 + 3000, stop_id * 50 + 3100 FROM fx_stops) w USING (id) GROUP BY ask_id)""",
)
def _(v):
    at = lambda a, b: v.stops.select(F.col("stop_id").alias("id"), (F.col("stop_id") * 50 + a).alias("start_minute"), (F.col("stop_id") * 50 + b).alias("end_minute"))
    asks = v.calls.select(F.col("event_id").alias("ask_id"), F.col("stop_id").alias("id"), (F.col("sec") % 10080).cast("int").alias("minute"))
    return policies.active_windows(at(0, 600).unionByName(at(3000, 3100)), asks)


@query("t7_capped_options", "SELECT from_stop_id, departure, trip_id, CAST(k AS INTEGER) AS rank, n > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY from_stop_id ORDER BY departure, trip_id, stop_sequence) AS k, count(*) OVER (PARTITION BY from_stop_id) AS n FROM fx_connections) WHERE k <= 5")
def _(v):
    rows = v.connections.select("from_stop_id", "departure", "trip_id", "stop_sequence")
    return policies.capped(rows, ["from_stop_id"], ["departure", "trip_id", "stop_sequence"], 5).drop("stop_sequence")


@query("a28_fair_budget", "SELECT route_id AS id, CAST(least(n, (SELECT max(l) FROM range(0, 10000) r(l) WHERE (SELECT sum(least(n, l)) FROM w) <= 0.5 * (SELECT sum(n) FROM w))) AS BIGINT) AS share FROM w", "w AS (SELECT route_id, count(*) AS n FROM fx_trips GROUP BY route_id)")
def _(v):
    wishes = v.trips.groupBy(F.col("route_id").alias("id")).agg(F.count("*").alias("wish"))
    total = wishes.agg(F.floor(F.sum("wish") / 2)).first()[0]
    return policies.fair_budget(wishes, total)


@query(
    "a28_proportional_budget",
    """SELECT route_id AS id, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, route_id) <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM (SELECT route_id, CAST(1000 * n // t AS BIGINT) AS base, 1000 * n % t AS rest FROM (SELECT route_id, n, CAST(sum(n) OVER () AS BIGINT) AS t FROM (SELECT route_id, count(*) AS n FROM fx_trips GROUP BY route_id)))""",
)
def _(v):
    return policies.largest_remainder(v.trips.groupBy(F.col("route_id").alias("id")).agg(F.count("*").alias("weight")), 1000)


@query(
    "r17_closed_stops",
    """SELECT trip_id, stop_sequence, can_board AND NOT (from_stop_id = 5 AND departure BETWEEN 30000 AND 40000 OR from_stop_id = 9 AND departure <= 20000) AS can_board, can_alight AND NOT (to_stop_id = 5 AND arrival BETWEEN 30000 AND 40000 OR to_stop_id = 9 AND arrival <= 20000) AS can_alight FROM fx_connections""",
)
def _(v):
    closures = v.spark.createDataFrame([(5, 30000, 40000), (9, None, 20000)], "stop_id int, start long, end long")
    return policies.close_stops(v.connections, closures).select("trip_id", "stop_sequence", "can_board", "can_alight")


@query("ops2_delay_events", "SELECT trip_id, sec AS time, delay, CASE WHEN delay >= 900 THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT trip_id, sec, delay * 10 AS delay FROM fx_trip_updates) WHERE sec > 41400 AND sec <= 43200 AND delay >= 300")
def _(v):
    calls = v.trip_updates.select("trip_id", F.col("sec").alias("time"), (F.col("delay") * 10).alias("delay"))
    return policies.delay_events(calls, NOW).select("trip_id", "time", "delay", "severity")


REPORTS = """updates AS (SELECT trip_id || '/' || CAST(copy AS VARCHAR) AS update_id, CASE WHEN k % 11 <> 10 THEN trip_id END AS trip_id, service_id AS day, CASE k % 7 WHEN 0 THEN 'CANCELED' WHEN 1 THEN 'DELETED' WHEN 2 THEN 'ADDED' WHEN 3 THEN 'SCHEDULED' END AS relationship, k % 5 <> 4 AS fresh
  FROM (SELECT *, CAST(substr(route_id, 2) AS INTEGER) AS k FROM fx_trips), (VALUES (0), (1)) c(copy) WHERE copy = 0 OR k % 9 = 8),
departures AS (SELECT trip_id, service_id AS day, stop_sequence, from_stop_id AS stop_id, departure AS scheduled FROM fx_connections),
predictions AS (SELECT trip_id || '/0' AS update_id, stop_sequence, CASE WHEN stop_sequence % 5 = 4 THEN 'SKIPPED' END AS relationship, CASE WHEN stop_sequence % 6 <> 5 THEN departure + stop_sequence * departure % 1700 - 300 END AS departure FROM fx_connections, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR stop_sequence % 8 = 7),
marked AS (SELECT *, CASE WHEN trip_id IS NULL OR count(trip_id) OVER (PARTITION BY trip_id, day) > 1 OR NOT fresh THEN 'unresolved' WHEN relationship = 'DELETED' THEN 'deleted' WHEN relationship = 'CANCELED' THEN 'cancelled' WHEN relationship <> 'SCHEDULED' THEN 'unresolved' ELSE 'matched' END AS status FROM updates),
told AS (SELECT m.update_id, d.stop_sequence, d.stop_id, d.scheduled, p.relationship, p.departure AS predicted FROM marked m JOIN (SELECT update_id, stop_sequence, max(relationship) AS relationship, max(departure) AS departure FROM predictions GROUP BY ALL HAVING count(*) = 1) p USING (update_id)
  JOIN departures d ON d.trip_id = m.trip_id AND d.day = m.day AND d.stop_sequence = p.stop_sequence WHERE m.status = 'matched'),
statuses AS (SELECT m.update_id, m.trip_id, m.day, m.status, n.stop_sequence AS next_sequence, n.stop_id AS next_stop, n.predicted, n.predicted - n.scheduled AS delay FROM marked m LEFT JOIN (SELECT * FROM told WHERE relationship IS NULL AND predicted BETWEEN 43200 AND 45000 QUALIFY row_number() OVER (PARTITION BY update_id ORDER BY predicted, stop_sequence) = 1) n USING (update_id))"""


def _reports(v):
    k = F.substring("route_id", 2, 9).cast("int")
    copies, seq = F.explode(F.array(F.lit(0), F.lit(1))), F.col("stop_sequence")
    updates = v.trips.withColumn("k", k).withColumn("copy", copies).where("copy = 0 OR k % 9 = 8").select(
        F.concat_ws("/", "trip_id", F.col("copy").cast("string")).alias("update_id"), F.when(F.col("k") % 11 != 10, F.col("trip_id")).alias("trip_id"), F.col("service_id").alias("day"),
        F.when(F.col("k") % 7 == 0, "CANCELED").when(F.col("k") % 7 == 1, "DELETED").when(F.col("k") % 7 == 2, "ADDED").when(F.col("k") % 7 == 3, "SCHEDULED").alias("relationship"), (F.col("k") % 5 != 4).alias("fresh"),
    )
    departures = v.connections.select("trip_id", F.col("service_id").alias("day"), "stop_sequence", F.col("from_stop_id").alias("stop_id"), F.col("departure").alias("scheduled"))
    predictions = v.connections.withColumn("copy", copies).where("copy = 0 OR stop_sequence % 8 = 7").select(
        F.concat("trip_id", F.lit("/0")).alias("update_id"), "stop_sequence", F.when(seq % 5 == 4, "SKIPPED").alias("relationship"), F.when(seq % 6 != 5, F.col("departure") + seq * F.col("departure") % 1700 - 300).alias("departure")
    )
    return updates, predictions, departures


@query("ops2_trip_status", "SELECT * FROM statuses", REPORTS)
def _(v):
    return policies.trip_status(*_reports(v), NOW)


@query(
    "ops2_trip_events",
    """SELECT update_id, 'cancellation' AS kind, CAST(NULL AS INTEGER) AS stop_sequence, CAST(NULL AS BIGINT) AS delay, 'warning' AS severity FROM statuses WHERE status = 'cancelled'
UNION ALL SELECT update_id, 'skipped-stop', stop_sequence, NULL, 'warning' FROM told WHERE relationship = 'SKIPPED' AND scheduled BETWEEN 43020 AND 45000
UNION ALL SELECT update_id, 'delay', next_sequence, delay, CASE WHEN delay >= 900 THEN 'critical' WHEN delay >= 300 THEN 'warning' ELSE 'info' END FROM statuses WHERE delay > 0""",
    REPORTS,
)
def _(v):
    updates, predictions, departures = _reports(v)
    return policies.trip_events(policies.trip_status(updates, predictions, departures, NOW), predictions, departures, NOW)


@query(
    "ops6_vehicle_detail",
    """SELECT trip_id, max(CASE WHEN stop_sequence = 1 THEN stop_id * 10 END) AS delay_here, arg_min(stop_id, stop_sequence) FILTER (stop_sequence > 1) AS next_stop, arg_min(departure, stop_sequence) FILTER (stop_sequence > 1) AS next_departure FROM fx_stop_times GROUP BY trip_id""",
)
def _(v):
    calls = v.stop_times.withColumn("delay", F.col("stop_id") * 10)
    return policies.next_prediction(calls, v.trips.select("trip_id", F.lit(1).alias("stop_sequence")))


@query("x3_preserved_trips", "SELECT trip_id, stop_sequence, departure - 86400 + 50000 AS departure FROM fx_connections WHERE departure - 86400 + 50000 >= 0")
def _(v):
    return policies.preserved_trips(v.connections, -1, 50000).select("trip_id", "stop_sequence", "departure")


@query("ops18_journey_groups", "SELECT count(*) AS journeys, min(d) AS first_departure FROM (SELECT trip_id, string_agg(route_id || ':' || CAST(from_stop_id AS VARCHAR) || ':' || CAST(to_stop_id AS VARCHAR), ';' ORDER BY stop_sequence) AS p, min(departure) AS d FROM fx_connections GROUP BY trip_id) GROUP BY p")
def _(v):
    legs = v.connections.select(F.col("trip_id").alias("journey_id"), F.col("stop_sequence").alias("leg"), "route_id", "from_stop_id", "to_stop_id", "departure")
    return policies.journey_groups(legs).select("journeys", "first_departure")


@query(
    "g10_nearest_place",
    """SELECT point_id, name, km FROM (SELECT a.stop_id AS point_id, 'S' || CAST(b.stop_id AS VARCHAR) AS name, round(12742.0176 * asin(sqrt(pow(sin(radians(b.lat - (a.lat + 0.003)) / 2), 2) + cos(radians(a.lat + 0.003)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 6) AS km FROM fx_stops a, fx_stops b WHERE b.stop_id % 5 = 0) WHERE km <= 1.5 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY km, name) = 1""",
)
def _(v):
    points = v.stops.select(F.col("stop_id").alias("point_id"), (F.col("lat") + 0.003).alias("lat"), "lon")
    places = v.stops.where("stop_id % 5 = 0").select(F.concat(F.lit("S"), F.col("stop_id").cast("string")).alias("name"), "lat", "lon")
    return policies.nearest_places(points, places, 1.5)


@query("x8_scenario_collection", "SELECT s AS scenario_id, route_id, count(*) AS connections FROM fx_connections, (VALUES ('base'), ('cut')) v(s) WHERE s = 'base' OR route_id <> 'R3' GROUP BY ALL")
def _(v):
    cut = v.connections.where("route_id <> 'R3'")
    every = v.connections.withColumn("scenario_id", F.lit("base")).unionByName(cut.withColumn("scenario_id", F.lit("cut")))
    return every.groupBy("scenario_id", "route_id").agg(F.count("*").alias("connections"))
