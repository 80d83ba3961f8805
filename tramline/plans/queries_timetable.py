"""Queries of timetables, calendars, transfers and the network overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import clock, geo, measures
from tramline.operators import calendar, network, timetable, transfers
from tramline.plans.registry import query

# ---- sources and scalar functions -------------------------------------------------------------------


@query("sc3_agency_timezones", "SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'America/New_York' ELSE 'Europe/Paris' END AS zone FROM fx_calls")
def _(v):
    return v.calls.select(F.when(F.col("user_id") % 2 == 0, "America/New_York").otherwise("Europe/Paris").alias("zone")).distinct()


CLOCKS = "CAST(event_id % 40 AS VARCHAR) || ':' || CASE WHEN event_id % 7 = 0 THEN '5' ELSE lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') END || ':' || lpad(CAST(event_id % 61 AS VARCHAR), 2, '0')"


@query(
    "f1_clock_parse",
    """SELECT event_id, t AS text, CASE WHEN regexp_full_match(t, '\\d{1,3}:[0-5]\\d:[0-5]\\d') THEN
  CAST(split_part(t, ':', 1) AS INTEGER) * 3600 + CAST(split_part(t, ':', 2) AS INTEGER) * 60 + CAST(split_part(t, ':', 3) AS INTEGER) END AS seconds
FROM (SELECT event_id, """ + CLOCKS + " AS t FROM fx_calls)",
)
def _(v):
    text = F.concat_ws(
        ":",
        (F.col("event_id") % 40).cast("string"),
        F.when(F.col("event_id") % 7 == 0, "5").otherwise(F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")),
        F.lpad((F.col("event_id") % 61).cast("string"), 2, "0"),
    )
    return v.calls.select("event_id", text.alias("text"), clock.parse_clock(text).alias("seconds"))


@query(
    "f2_clock_format",
    """SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
FROM (SELECT event_id, sec + 86400 * (event_id % 2) AS s FROM fx_calls)""",
)
def _(v):
    return v.calls.select("event_id", clock.format_clock(F.col("sec") + 86400 * (F.col("event_id") % 2)).alias("clock"))


@query(
    "f3_date_parse",
    """SELECT event_id, CASE WHEN try_strptime(t, '%Y%m%d') IS NOT NULL THEN CAST(t AS INTEGER) END AS day
FROM (SELECT event_id, '2023' || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') || lpad(CAST(event_id % 33 AS VARCHAR), 2, '0') AS t FROM fx_calls)""",
)
def _(v):
    two = lambda n: F.lpad((F.col("event_id") % n).cast("string"), 2, "0")
    return v.calls.select("event_id", clock.parse_date(F.concat(F.lit("2023"), two(14), two(33))).alias("day"))


@query(
    "f4_geo",
    """SELECT a.stop_id AS a, b.stop_id AS b, round(12742.0176 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 6) AS km,
  round(sqrt(pow((b.lat - a.lat) * 111.32, 2) + pow((b.lon - a.lon) * greatest(12.0, 111.32 * cos(radians((a.lat + b.lat) / 2))), 2)), 6) AS flat_km,
  round(CASE WHEN z < 0 THEN z + 360 ELSE z END, 4) AS bearing
FROM (SELECT x.*, y.stop_id AS bs, y.lat AS blat, y.lon AS blon FROM fx_stops x JOIN fx_stops y ON y.stop_id = (x.stop_id + 7) % 100) j
JOIN fx_stops a ON a.stop_id = j.stop_id JOIN fx_stops b ON b.stop_id = j.bs,
LATERAL (SELECT degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) AS z) q""",
)
def _(v):
    a = v.stops.select(F.col("stop_id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), ((F.col("stop_id") + 7) % 100).alias("b"))
    b = v.stops.select(F.col("stop_id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    at = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    return a.join(b, "b").select(
        "a", "b", F.round(geo.haversine_km(*at), 6).alias("km"), F.round(geo.equirectangular_km(*at), 6).alias("flat_km"), F.round(geo.bearing(*at), 4).alias("bearing")
    )


@query(
    "f5_polygon",
    """SELECT stop_id, lat > 38.915 AND lat < 38.965 AND lon > -77.035 AND lon < -76.985 AND NOT (lat >= lon + 115.958) AS inside FROM fx_stops""",
)
def _(v):
    ring = [(-77.035, 38.915), (-76.985, 38.915), (-76.985, 38.965), (-76.993, 38.965), (-77.035, 38.923), (-77.035, 38.915)]
    column = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
    return v.stops.select("stop_id", geo.ring_contains(column, F.col("lon"), F.col("lat")).alias("inside"))


@query(
    "f6_service_epoch",
    """SELECT DISTINCT CAST(d AS VARCHAR) AS day, CAST(epoch(CAST(d AS TIMESTAMP)) AS BIGINT) + 5 * 3600 AS epoch_seconds FROM fx_calls""",
)
def _(v):
    instant = clock.service_epoch(F.col("d"), "America/New_York")
    return v.calls.select("d").distinct().select(F.col("d").cast("string").alias("day"), F.unix_timestamp(instant).alias("epoch_seconds"))


@query(
    "f7_decay_weights",
    """SELECT stop_id, m AS minutes, CASE WHEN m < 30 THEN 1.0 ELSE 0.0 END::DOUBLE AS step, round(greatest(0.0, 1 - m / 30.0), 6)::DOUBLE AS linear, round(exp(-ln(2.0) * m / 30.0), 6) AS exponential, round(exp(-0.05 * m), 6) AS fixed,
  round(1 / (1 + exp((m - 30.0) / 5.0)), 6) AS logistic FROM (SELECT stop_id, CAST(stop_id AS DOUBLE) AS m FROM fx_stops)""",
)
def _(v):
    m, cut = F.col("stop_id").cast("double"), F.lit(30.0)
    w = lambda kind, rate=0.0: F.round(measures.decay_weight(kind, m, cut, rate), 6)
    return v.stops.select("stop_id", m.alias("minutes"), w("step").alias("step"), w("linear").alias("linear"), w("exponential").alias("exponential"), w("fixed-exponential", 0.05).alias("fixed"), w("logistic", 5.0).alias("logistic"))


@query("f8_scoped_ids", "SELECT DISTINCT 'rail' AS scope, route_id AS local_id, 'rail' || chr(31) || route_id AS id FROM fx_trips")
def _(v):
    merged = timetable.merge_feeds({"rail": v.trips.select("route_id").distinct()}, ["route_id"]).withColumnRenamed("route_id", "id")
    return merged.select(measures.scope_of(F.col("id")).alias("scope"), measures.local_id(F.col("id")).alias("local_id"), "id")


# ---- timetable ---------------------------------------------------------------------------------------

@query("w1_connections", "SELECT * FROM fx_connections")
def _(v):
    return v.connections


SHIFTED = """shifted AS (SELECT trip_id, stop_sequence, stop_id, arrival - CASE WHEN stop_sequence % 3 = 0 THEN 900 ELSE 0 END AS arrival,
  departure - CASE WHEN stop_sequence % 3 = 0 THEN 900 ELSE 0 END AS departure, can_board, can_alight FROM fx_stop_times)"""


def _shifted(v):
    back = F.when(F.col("stop_sequence") % 3 == 0, 900).otherwise(0)
    return v.stop_times.withColumns({"arrival": F.col("arrival") - back, "departure": F.col("departure") - back})


@query(
    "w2_time_repair",
    """SELECT trip_id, stop_sequence, stop_id, arrival_f AS arrival, departure_f AS departure, can_board, can_alight FROM (
  SELECT *, max(greatest(arrival_f - arrival, departure_f - departure)) OVER (PARTITION BY trip_id) AS worst FROM (
    SELECT *, greatest(departure, arrival_f) AS departure_f FROM (
      SELECT *, greatest(arrival, coalesce(max(greatest(arrival, departure)) OVER (PARTITION BY trip_id ORDER BY stop_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), arrival)) AS arrival_f FROM shifted)))
WHERE worst <= 600""",
    SHIFTED,
)
def _(v):
    return timetable.repair_times(_shifted(v))


@query(
    "w3_backward_times",
    """SELECT trip_id, stop_sequence FROM (SELECT *, lag(departure) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS b FROM shifted) WHERE arrival < b""",
    SHIFTED,
)
def _(v):
    return timetable.backward_times(_shifted(v)).select("trip_id", "stop_sequence")


#: All connections, with a hole in the numbers and another stop after every second of three.
HOLES = """holes AS (SELECT * REPLACE (CAST(stop_sequence + stop_sequence // 3 AS INTEGER) AS stop_sequence, CASE WHEN stop_sequence % 3 = 2 THEN (to_stop_id + 1) % 100 ELSE to_stop_id END AS to_stop_id) FROM fx_connections)"""


def _holes(v):
    seq = F.col("stop_sequence")
    elsewhere = F.when(seq % 3 == 2, (F.col("to_stop_id") + 1) % 100).otherwise(F.col("to_stop_id"))
    return v.connections.withColumn("to_stop_id", elsewhere).withColumn("stop_sequence", (seq + F.floor(seq / 3)).cast("int"))


@query(
    "w4_runs",
    """SELECT trip_id, stop_sequence, CAST(sum(CAST(coalesce(p <> from_stop_id, false) AS INTEGER)) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS BIGINT) AS run
FROM (SELECT *, lag(to_stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS p FROM holes)""",
    HOLES,
)
def _(v):
    return timetable.runs(_holes(v)).select("trip_id", "stop_sequence", "run")


@query(
    "w15_bridged_gaps",
    """SELECT from_stop_id, to_stop_id, seconds FROM (SELECT lag(to_stop_id) OVER w AS from_stop_id, from_stop_id AS to_stop_id, departure - lag(arrival) OVER w AS seconds, stop_sequence - lag(stop_sequence) OVER w AS jump
  FROM holes WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)) WHERE jump > 1 AND from_stop_id <> to_stop_id AND seconds >= 0""",
    HOLES,
)
def _(v):
    return timetable.bridged_gaps(_holes(v))


@query("sc21_frequency_departures", "SELECT route_id, CAST(t AS INTEGER) AS departure FROM (SELECT route_id, unnest(range(start_time, end_time, headway_secs)) AS t FROM fx_frequencies)")
def _(v):
    return timetable.expand_frequencies(v.frequencies).select("route_id", "departure")


ACTIVE = """days AS (SELECT service_id, day FROM (SELECT c.*, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM fx_calendar c)
  WHERE [monday, tuesday, wednesday, thursday, friday, saturday, sunday][isodow(day)] = 1
  UNION SELECT service_id, CAST(strptime(CAST(date AS VARCHAR), '%Y%m%d') AS DATE) FROM fx_exceptions WHERE exception_type = 1
  EXCEPT SELECT service_id, CAST(strptime(CAST(date AS VARCHAR), '%Y%m%d') AS DATE) FROM fx_exceptions WHERE exception_type = 2)"""


@query("p1_service_days", "SELECT service_id, CAST(day AS VARCHAR) AS day FROM days", ACTIVE)
def _(v):
    return calendar.service_days(v.calendar, v.exceptions).select("service_id", F.col("day").cast("string").alias("day"))


@query("p1_active_services", "SELECT service_id FROM days WHERE day = DATE '2024-01-15'", ACTIVE)
def _(v):
    return calendar.active_on(v.calendar, v.exceptions, 20240115)


@query("u2_service_ids", "SELECT service_id FROM fx_calendar UNION SELECT service_id FROM fx_exceptions")
def _(v):
    return calendar.service_ids(v.calendar, v.exceptions)


@query("a27_service_coverage", "SELECT 'all' AS scope, CAST(20240101 AS INTEGER) AS first_date, CAST(20240131 AS INTEGER) AS last_date")
def _(v):
    return calendar.coverage(v.calendar, v.exceptions, F.lit("all"))


@query(
    "f9_fallback_date",
    """SELECT CAST(day AS VARCHAR) AS day, scopes, gap FROM (SELECT day, count(DISTINCT service_id) AS scopes, abs(day - DATE '2024-02-10') AS gap FROM days GROUP BY day) ORDER BY scopes DESC, gap, day LIMIT 1""",
    ACTIVE,
)
def _(v):
    days = calendar.service_days(v.calendar, v.exceptions)
    return calendar.fallback_date(days, 20240210, F.col("service_id")).select(F.col("day").cast("string").alias("day"), "scopes", F.col("gap").cast("long").alias("gap"))


@query(
    "j6_active_timetable",
    """SELECT trip_id, stop_sequence, departure + o AS departure, arrival + o AS arrival FROM (SELECT c.*, (day - DATE '2024-01-10') * 86400 AS o FROM fx_connections c JOIN days USING (service_id)
  WHERE day - DATE '2024-01-10' BETWEEN -3 AND 5) WHERE departure + o BETWEEN 0 AND 172800""",
    ACTIVE,
)
def _(v):
    days = calendar.service_days(v.calendar, v.exceptions).withColumn("offset", F.datediff("day", F.lit("2024-01-10").cast("date")))
    active = timetable.activate(v.connections, timetable.service_instances(days), 172800)
    return active.select("trip_id", "stop_sequence", "departure", "arrival")


@query("a17_time_bounds", "SELECT least(min(departure), 21600) AS first_departure, greatest(max(arrival), 32400) AS last_arrival FROM fx_connections")
def _(v):
    return timetable.time_bounds(v.connections, v.frequencies)


@query(
    "a22_access_roles",
    """SELECT stop_id, CAST(max(b) AS INTEGER) AS boards, CAST(max(a) AS INTEGER) AS alights FROM (SELECT from_stop_id AS stop_id, CAST(can_board AS INTEGER) AS b, 0 AS a FROM fx_connections UNION ALL SELECT to_stop_id, 0, CAST(can_alight AS INTEGER) FROM fx_connections) GROUP BY stop_id""",
)
def _(v):
    return timetable.access_roles(v.connections)


@query(
    "a23_topology",
    """SELECT from_stop_id, to_stop_id, min(s) AS seconds FROM (SELECT from_stop_id, to_stop_id, arrival - departure AS s FROM fx_connections
  UNION ALL SELECT from_stop_id, to_stop_id, CAST(seconds AS BIGINT) FROM fx_transfers
  UNION ALL SELECT a.stop_id, b.stop_id, 120 FROM fx_stops a JOIN fx_stops b USING (station_id) WHERE NOT EXISTS (SELECT 1 FROM fx_transfers t WHERE t.from_stop_id = a.stop_id AND t.to_stop_id = b.stop_id))
WHERE from_stop_id <> to_stop_id GROUP BY ALL""",
)
def _(v):
    return timetable.topology(v.connections, v.transfers, v.stops)


@query("u1_merged_feeds", "SELECT f || chr(31) || trip_id AS trip_id, f || chr(31) || route_id AS route_id, direction_id FROM fx_trips, (VALUES ('bus'), ('rail')) v(f)")
def _(v):
    rows = v.trips.select("trip_id", "route_id", "direction_id")
    return timetable.merge_feeds({"bus": rows, "rail": rows}, ["trip_id", "route_id"])


@query("u3_all_connections", "SELECT trip_id, departure, false AS headway FROM fx_connections UNION ALL SELECT route_id, CAST(t AS BIGINT), true FROM (SELECT route_id, unnest(range(start_time, end_time, headway_secs)) AS t FROM fx_frequencies)")
def _(v):
    headway = timetable.expand_frequencies(v.frequencies).select(F.col("route_id").alias("trip_id"), F.col("departure").cast("long").alias("departure"), F.lit(True).alias("headway"))
    return v.connections.select("trip_id", "departure", F.lit(False).alias("headway")).unionByName(headway)


# ---- transfers ---------------------------------------------------------------------------------------

@query("j13_near_stops", "SELECT from_stop_id, to_stop_id, round(km, 6) AS km FROM fx_near")
def _(v):
    return transfers.near_stops(v.stops, 1.2).select("from_stop_id", "to_stop_id", F.round("km", 6).alias("km"))


@query("j14_transfer_seconds", "SELECT * FROM fx_transfers")
def _(v):
    return v.transfers


DECLARED = "declared AS (SELECT from_stop_id, to_stop_id, seconds, (from_stop_id + to_stop_id) % 11 = 0 AS forbidden FROM fx_transfers)"


@query(
    "r9_transfer_index",
    """SELECT from_stop_id, to_stop_id, seconds FROM (SELECT from_stop_id, to_stop_id, min(seconds) AS seconds FROM declared WHERE NOT forbidden GROUP BY ALL
  UNION ALL SELECT a.stop_id, b.stop_id, 120 FROM fx_stops a JOIN fx_stops b USING (station_id) WHERE a.stop_id <> b.stop_id AND NOT EXISTS (SELECT 1 FROM declared t WHERE t.from_stop_id = a.stop_id AND t.to_stop_id = b.stop_id))
WHERE to_stop_id IN (SELECT from_stop_id FROM fx_connections WHERE can_board)""",
    DECLARED,
)
def _(v):
    declared = v.transfers.withColumn("forbidden", (F.col("from_stop_id") + F.col("to_stop_id")) % 11 == 0)
    a, b = v.stops.select(F.col("stop_id").alias("from_stop_id"), "station_id"), v.stops.select(F.col("stop_id").alias("to_stop_id"), "station_id")
    siblings = a.join(b, "station_id").where("from_stop_id <> to_stop_id").select("from_stop_id", "to_stop_id", F.lit(120).alias("seconds"))
    served = v.connections.where("can_board").select(F.col("from_stop_id").alias("stop_id")).distinct()
    return transfers.transfer_index(declared, siblings, served)


PARENTS = "parents AS (SELECT stop_id, CASE WHEN stop_id >= 10 THEN stop_id // 10 END AS parent_id FROM fx_stops)"


def _parents(v):
    return v.stops.select("stop_id", F.when(F.col("stop_id") >= 10, F.floor(F.col("stop_id") / 10).cast("int")).alias("parent_id"))


@query("u6_station_closure", "SELECT stop_id, stop_id AS ancestor, 0 AS depth FROM parents UNION ALL SELECT p.stop_id, p.parent_id, 1 FROM parents p JOIN fx_stops s ON s.stop_id = p.parent_id", PARENTS)
def _(v):
    return transfers.ancestors(_parents(v))


@query(
    "j18_governing_rule",
    """SELECT stop_id, depth, forbidden, minimum FROM (SELECT c.stop_id, c.depth, r.forbidden, r.minimum, row_number() OVER (PARTITION BY c.stop_id ORDER BY c.depth, r.forbidden DESC, r.minimum DESC) AS k
  FROM (SELECT stop_id, stop_id AS ancestor, 0 AS depth FROM parents UNION ALL SELECT stop_id, parent_id, 1 FROM parents WHERE parent_id IS NOT NULL) c
  JOIN (SELECT stop_id AS ancestor, stop_id % 4 = 0 AS forbidden, 60 * stop_id AS minimum FROM fx_stops WHERE stop_id % 3 = 0) r USING (ancestor)) WHERE k = 1""",
    PARENTS,
)
def _(v):
    rules = v.stops.where("stop_id % 3 = 0").select("stop_id", (F.col("stop_id") % 4 == 0).alias("forbidden"), (60 * F.col("stop_id")).alias("minimum"))
    return transfers.governing_rule(rules, transfers.ancestors(_parents(v)))


@query(
    "j17_specific_rule",
    """SELECT pair, specificity, max(minimum) AS minimum, min(minimum) <> max(minimum) AS conflict FROM (SELECT *, rank() OVER (PARTITION BY pair ORDER BY specificity DESC, depth) AS k FROM (
  SELECT event_id % 500 AS pair, stop_id % 3 AS depth, CAST(sec % 7 AS BIGINT) AS minimum, CASE WHEN ft AND tt THEN 6 WHEN (ft AND tr) OR (tt AND fr) THEN 5 WHEN ft OR tt THEN 4 WHEN fr AND tr THEN 3 WHEN fr OR tr THEN 2 ELSE 1 END AS specificity
  FROM (SELECT *, sec % 3 = 0 AS ft, sec % 5 = 0 AS tt, sec % 2 = 0 AS fr, sec % 7 = 0 AS tr FROM fx_calls))) WHERE k = 1 GROUP BY ALL""",
)
def _(v):
    flag = lambda n: F.col("sec") % n == 0
    rows = v.calls.select((F.col("event_id") % 500).alias("pair"), (F.col("stop_id") % 3).alias("depth"), (F.col("sec") % 7).alias("minimum"), flag(3).alias("from_trip"), flag(5).alias("to_trip"), flag(2).alias("from_route"), flag(7).alias("to_route"))
    return transfers.specific_rule(rows)


# ---- network overview --------------------------------------------------------------------------------

@query("a1_stop_modes", "SELECT s.station_id AS place_id, r.route_type, count(*) AS departures FROM fx_connections c JOIN fx_stops s ON s.stop_id = c.from_stop_id JOIN fx_routes r USING (route_id) WHERE c.can_board GROUP BY ALL")
def _(v):
    return network.stop_modes(v.connections, v.stops, v.routes)


@query("a2_route_services", "SELECT r.route_id, coalesce(r.route_type, 3) AS route_type, count(t.trip_id) AS trips FROM fx_routes r LEFT JOIN fx_trips t USING (route_id) GROUP BY ALL")
def _(v):
    return network.route_services(v.routes, v.trips)


SPANS = """spans AS (SELECT route_id, service_id, direction_id, trip_id, arg_min(departure, stop_sequence) AS f, arg_max(arrival, stop_sequence) AS e, count(*) AS n FROM fx_connections GROUP BY ALL)"""


@query("w5_trip_spans", "SELECT route_id, service_id, direction_id, trip_id, f AS first_departure, e AS last_arrival, n FROM spans", SPANS)
def _(v):
    return network.trip_spans(v.connections)


@query(
    "a3_service_statistics",
    """SELECT route_id, min(a) AS first_departure, max(e) AS last_arrival, CAST(sum(r) AS BIGINT) AS runtime, CAST(sum(t) AS BIGINT) AS trips,
  CASE WHEN sum(t - 1) > 0 THEN greatest(1, CAST(floor(sum(b - a) / sum(t - 1) / 60 + 0.5) AS BIGINT)) ELSE 0 END AS headway_minutes
FROM (SELECT route_id, service_id, min(f) AS a, max(f) AS b, max(e) AS e, sum(e - f) AS r, count(*) AS t FROM spans GROUP BY ALL) GROUP BY route_id""",
    SPANS,
)
def _(v):
    return network.service_statistics(v.connections)


@query(
    "a4_median_headways",
    """SELECT route_id, direction_id, h AS headway_minutes, CASE WHEN h > 0 AND h <= 15 THEN 'high' WHEN h > 0 AND h <= 30 THEN 'medium' ELSE 'low' END AS frequency
FROM (SELECT route_id, direction_id, coalesce(greatest(1, CAST(floor(quantile_cont(g, 0.5) FILTER (g > 0 AND g <= 21600) / 60 + 0.5) AS BIGINT)), 0) AS h
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY route_id, direction_id, service_id ORDER BY t) AS g FROM (SELECT DISTINCT route_id, direction_id, service_id, f AS t FROM spans)) GROUP BY ALL)""",
    SPANS,
)
def _(v):
    return network.median_headways(v.connections)


@query(
    "a5_patterns",
    """SELECT route_id, direction_id, signature, trips, representative, round(trips / sum(trips) OVER (PARTITION BY route_id), 6) AS share, CAST(row_number() OVER (PARTITION BY route_id ORDER BY trips DESC, direction_id, signature) AS INTEGER) AS rank
FROM (SELECT route_id, direction_id, signature, count(*) AS trips, min(trip_id) AS representative FROM (
  SELECT route_id, direction_id, trip_id, CAST(arg_min(from_stop_id, stop_sequence) AS VARCHAR) || '>' || string_agg(CAST(to_stop_id AS VARCHAR), '>' ORDER BY stop_sequence) AS signature FROM fx_connections GROUP BY ALL) GROUP BY ALL)""",
)
def _(v):
    return network.patterns(v.connections)


@query(
    "a6_pattern_metrics",
    """SELECT route_id, direction_id, round((max(f) - min(f)) / 3600, 6) AS span_hours, round(sum(e - f) / 3600, 6) AS service_hours, CAST(min(f) // 60 AS BIGINT) AS first_minute, CAST(max(f) // 60 AS BIGINT) AS last_minute FROM spans GROUP BY ALL""",
    SPANS,
)
def _(v):
    return network.pattern_metrics(v.connections)


@query(
    "a7_stop_pairs",
    """SELECT from_stop_id, to_stop_id, s AS seconds, n AS rides, round(km, 6) AS km, CASE WHEN s > 0 THEN round(km / s * 3600, 4) END AS kmh FROM (SELECT p.*, 12742.0176 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km
FROM (SELECT from_stop_id, to_stop_id, quantile_cont(arrival - departure, 0.5) AS s, count(*) AS n FROM fx_connections WHERE from_stop_id <> to_stop_id GROUP BY ALL) p JOIN fx_stops a ON a.stop_id = from_stop_id JOIN fx_stops b ON b.stop_id = to_stop_id)""",
)
def _(v):
    return network.stop_pairs(v.connections, v.stops)


@query("a9_transfer_scores", "SELECT from_stop_id AS stop_id, count(DISTINCT route_id) AS routes, count(DISTINCT trip_id) AS trips, round(least(100.0, 24 * count(DISTINCT route_id) + 18 * log10(count(DISTINCT trip_id))), 6)::DOUBLE AS score FROM fx_connections GROUP BY 1")
def _(v):
    return network.transfer_scores(v.connections)


@query("a10_feeds_per_stop", "SELECT stop_id, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM fx_calls GROUP BY stop_id")
def _(v):
    kinds = F.array_sort(F.collect_set("event_type"))
    return v.calls.groupBy("stop_id").agg(F.countDistinct("event_type").alias("kinds"), F.array_join(kinds, ",").alias("names"))


@query(
    "a24_service_profile",
    """SELECT station_id, band, greatest(CAST(sum(n) AS BIGINT), max(CASE WHEN stop_id = station_id THEN n ELSE 0 END)) AS departures FROM (SELECT from_stop_id AS stop_id, CASE WHEN route_type <= 2 THEN 'rail' WHEN route_type = 3 THEN 'bus' ELSE 'other' END AS band, count(*) AS n
  FROM fx_connections JOIN fx_routes USING (route_id) GROUP BY ALL) JOIN fx_stops USING (stop_id) GROUP BY ALL""",
)
def _(v):
    return network.service_profile(v.connections, v.routes, v.stops)


@query(
    "a25_spatial_anchors",
    """SELECT y, x, stop_id, departures, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY y, x ORDER BY departures DESC, stop_id) AS INTEGER) AS rank FROM (
  SELECT stop_id, count(*) AS departures FROM (SELECT from_stop_id AS stop_id FROM fx_connections) GROUP BY stop_id) JOIN (SELECT stop_id, CAST(floor(round(lat * 50, 6)) AS BIGINT) AS y, CAST(floor(round(lon * 50, 6)) AS BIGINT) AS x FROM fx_stops) USING (stop_id)) WHERE rank <= 2""",
)
def _(v):
    halved = v.stops.select("stop_id", (F.col("lat") / 2).alias("lat"), (F.col("lon") / 2).alias("lon"))
    profile = v.connections.groupBy(F.col("from_stop_id").alias("stop_id")).agg(F.count("*").alias("departures"))
    return network.anchors(profile, halved, 2)


@query(
    "a26_feed_preview",
    """SELECT route_id, representative, trips, CASE WHEN s >= 0.5 THEN 'high' WHEN s >= 0.2 THEN 'medium' ELSE 'low' END AS frequency FROM (SELECT *, trips / max(trips) OVER () AS s FROM (SELECT route_id, min(trip_id) AS representative, count(DISTINCT trip_id) AS trips FROM fx_connections GROUP BY route_id))""",
)
def _(v):
    return network.feed_preview(v.connections)


@query(
    "a11_shared_departures",
    """SELECT route_id, CAST(sum(n) AS BIGINT) AS departures, count(*) AS distinct_departures, round(sum(n) * 3600 / 43200, 6) AS per_hour, round(avg(g), 6) AS mean_gap, min(g) AS min_gap, max(g) AS max_gap FROM (
  SELECT *, departure - lag(departure) OVER (PARTITION BY route_id ORDER BY departure) AS g FROM (SELECT route_id, departure, count(*) AS n FROM fx_connections WHERE from_stop_id = 7 AND can_board AND departure >= 21600 AND departure < 64800 GROUP BY ALL)) GROUP BY route_id""",
)
def _(v):
    return network.shared_departures(v.connections, 7, 21600, 64800)


@query(
    "a18_feature_inventory",
    """SELECT 'no_boarding' AS feature, count(*) FILTER (NOT can_board) AS n FROM fx_stop_times UNION ALL SELECT 'no_alighting', count(*) FILTER (NOT can_alight) FROM fx_stop_times
UNION ALL SELECT 'removed_days', count(*) FILTER (exception_type = 2) FROM fx_exceptions UNION ALL SELECT 'headway_windows', count(*) FROM fx_frequencies""",
)
def _(v):
    return network.feature_inventory(v.stop_times, v.exceptions, v.frequencies)
