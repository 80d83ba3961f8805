"""Queries of operations, scenarios, streets and fares."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import measures
from tramline.operators import calendar, network, operations, scenario, streets, validate
from tramline.plans.fixtures import DAYS  # noqa: F401
from tramline.plans.registry import query

NOW = 43200

def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


# ---- integrity ---------------------------------------------------------------------------------------


@query(
    "j3_missing_references",
    """SELECT 'trips.route_id' AS reference, count(*) AS violations FROM fx_trips t WHERE NOT EXISTS (SELECT 1 FROM fx_routes r WHERE r.route_id = t.route_id AND r.route_type IS NOT NULL)
UNION ALL SELECT 'trips.service_id', count(*) FROM fx_trips WHERE service_id NOT IN (SELECT service_id FROM fx_calendar UNION SELECT service_id FROM fx_exceptions)
UNION ALL SELECT 'transfers.from_stop_id', count(*) FROM fx_transfers WHERE from_stop_id NOT IN (SELECT stop_id FROM fx_stops WHERE stop_id % 9 <> 0)
UNION ALL SELECT 'transfers.to_stop_id', count(*) FROM fx_transfers WHERE to_stop_id NOT IN (SELECT stop_id FROM fx_stops WHERE stop_id % 9 <> 0)""",
)
def _(v):
    services = v.calendar.select("service_id").unionByName(v.exceptions.select("service_id"))
    stops = v.stops.where("stop_id % 9 <> 0")
    return validate.missing_references(
        {
            "trips.route_id": (v.trips, "route_id", v.routes.where("route_type IS NOT NULL"), "route_id"),
            "trips.service_id": (v.trips, "service_id", services, "service_id"),
            "transfers.from_stop_id": (v.transfers, "from_stop_id", stops, "stop_id"),
            "transfers.to_stop_id": (v.transfers, "to_stop_id", stops, "stop_id"),
        }
    )


@query("j4_rule_conflicts", "SELECT trip_id, route_id AS trip_route, 'R' || CAST(length(trip_id) % 20 AS VARCHAR) AS rule_route FROM fx_trips WHERE route_id <> 'R' || CAST(length(trip_id) % 20 AS VARCHAR)")
def _(v):
    rules = v.trips.select("trip_id", F.concat(F.lit("R"), (F.length("trip_id") % 20).cast("string")).alias("rule_route"))
    return validate.route_conflicts(rules, v.trips)


@query(
    "j5_overlapping_windows",
    """SELECT a.route_id AS trip_id, a.s AS start_a, b.s AS start_b FROM w a JOIN w b ON a.route_id = b.route_id AND a.s < b.s AND b.s < a.e""",
    "w AS (SELECT DISTINCT route_id, first_sec AS s, first_sec + 900 AS e FROM (SELECT 'R' || CAST(user_id % 20 AS VARCHAR) AS route_id, sec AS first_sec FROM fx_calls WHERE event_type = 'purchase'))",
)
def _(v):
    rows = v.calls.where("event_type = 'purchase'").select(F.concat(F.lit("R"), (F.col("user_id") % 20).cast("string")).alias("trip_id"), F.col("sec").alias("start_time"), (F.col("sec") + 900).alias("end_time")).distinct()
    return validate.overlapping_windows(rows)


@query("a21_mixed_exactness", "SELECT route_id AS trip_id FROM fx_trips GROUP BY route_id HAVING count(DISTINCT length(trip_id) % 2) > 1")
def _(v):
    return validate.mixed_exactness(v.trips.select(F.col("route_id").alias("trip_id"), (F.length("trip_id") % 2).alias("exact_times")))


# ---- operations --------------------------------------------------------------------------------------


@query(
    "ops1_feed_state",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'unknown' WHEN abs(43200 - sec) > 180 THEN 'stale' ELSE 'fresh' END AS state FROM fx_calls""",
)
def _(v):
    feeds = v.calls.select("event_id", (F.col("event_type") == "error").alias("failed"), F.when(F.col("event_id") % 11 != 0, F.col("sec")).alias("timestamp"))
    return operations.feed_state(feeds, NOW).select("event_id", "state")


@query("p6_usable_records", "SELECT coalesce(reason, 'used') AS reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'no_timestamp' WHEN 43200 - sec > 180 THEN 'stale' WHEN sec - 43200 > 60 THEN 'future' END AS reason FROM fx_calls) GROUP BY 1")
def _(v):
    records = v.calls.select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("sec")).alias("timestamp"))
    return operations.usable(records, NOW).groupBy(F.coalesce("reason", F.lit("used")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "j11_identity",
    """SELECT event_id AS record_id, CASE WHEN n = 1 THEN trip_id END AS trip_id, CASE WHEN n = 0 THEN 'no_match' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM (
  SELECT e.event_id, count(t.trip_id) AS n, max(t.trip_id) AS trip_id FROM (SELECT event_id, CAST(user_id AS VARCHAR) || '-' || CAST(d AS VARCHAR) AS raw, CASE WHEN event_id % 3 > 0 THEN 'R' || CAST(event_id % 20 AS VARCHAR) END AS r FROM fx_calls) e
  LEFT JOIN fx_trips t ON t.trip_id = e.raw AND (e.r IS NULL OR e.r = t.route_id) GROUP BY e.event_id)""",
)
def _(v):
    raw = F.concat_ws("-", F.col("user_id").cast("string"), F.col("d").cast("string"))
    route = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("R"), (F.col("event_id") % 20).cast("string")))
    records = v.calls.select(F.col("event_id").alias("record_id"), raw.alias("raw_trip_id"), route.alias("route_id"), F.lit(None).cast("int").alias("direction_id"))
    return operations.resolve_identity(records, v.trips)


@query(
    "j12_call_matching",
    """SELECT u.event_id, CAST(CASE WHEN u.seq IS NOT NULL THEN CASE WHEN u.stop_id IS NULL OR u.stop_id = c.stop_id THEN c.stop_sequence END ELSE q.only END AS INTEGER) AS matched_sequence
FROM (SELECT event_id, trip_id, CASE WHEN event_id % 2 = 0 THEN CAST(1 + event_id % 3 AS INTEGER) END AS seq, CASE WHEN event_id % 5 > 0 THEN stop_id END AS stop_id FROM fx_trip_updates) u
LEFT JOIN fx_stop_times c ON c.trip_id = u.trip_id AND c.stop_sequence = u.seq
LEFT JOIN (SELECT trip_id, stop_id, min(stop_sequence) AS only FROM fx_stop_times GROUP BY ALL HAVING count(*) = 1) q ON q.trip_id = u.trip_id AND q.stop_id = u.stop_id""",
)
def _(v):
    updates = v.trip_updates.select(
        "event_id", "trip_id", F.when(F.col("event_id") % 2 == 0, (1 + F.col("event_id") % 3).cast("int")).alias("stop_sequence"), F.when(F.col("event_id") % 5 > 0, F.col("stop_id")).alias("stop_id")
    )
    return operations.match_calls(updates, v.stop_times).select("event_id", "matched_sequence")


DELAYS = """delays AS (SELECT s.trip_id, s.stop_sequence, s.stop_id, s.departure, CASE WHEN s.stop_sequence % 3 = 1 THEN CAST(s.departure % 1000 AS INTEGER) END AS delay, s.stop_id % 7 = 0 AS no_data FROM fx_stop_times s)"""


def _delays(v):
    return v.stop_times.select("trip_id", "stop_sequence", "stop_id", "departure", F.when(F.col("stop_sequence") % 3 == 1, (F.col("departure") % 1000).cast("int")).alias("delay"), (F.col("stop_id") % 7 == 0).alias("no_data"))


@query(
    "w9_delay_propagation",
    """SELECT trip_id, stop_sequence, last_value(CASE WHEN NOT no_data THEN delay END IGNORE NULLS) OVER (PARTITION BY trip_id, b ORDER BY stop_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS predicted_delay
FROM (SELECT *, sum(CAST(no_data AS INTEGER)) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS b FROM delays)""",
    DELAYS,
)
def _(v):
    return operations.propagate_delays(_delays(v)).select("trip_id", "stop_sequence", "predicted_delay")


RUNNING = """running AS (SELECT route_id, direction_id, from_stop_id % 2 AS stop_id, CASE WHEN service_id IN ('D6', 'D7') THEN 'weekend' ELSE 'week' END AS day, trip_id, departure AS scheduled,
  CASE WHEN stop_sequence % 4 <> 3 THEN departure + stop_sequence * departure % 1700 END AS predicted, stop_sequence % 8 = 3 AS passed FROM fx_connections)"""
#: After the pairs.
SEVERITY = """severity AS (SELECT p AS planned, a AS actual, CASE WHEN a > p AND a >= 1200 AND a >= 3 * p AND a - p >= 600 THEN 'critical' WHEN a > p AND 2 * a >= 3 * p AND a - p >= 300 THEN 'warning'
  WHEN a <= p AND 4 * a <= p AND a <= 120 AND p - a >= 300 THEN 'critical' WHEN a <= p AND 2 * a <= p AND p - a >= 180 THEN 'warning' ELSE 'info' END AS severity FROM (SELECT DISTINCT planned AS p, actual AS a FROM pairs))"""


def _running(v):
    seq = F.col("stop_sequence")
    return v.connections.select(
        "route_id", "direction_id", (F.col("from_stop_id") % 2).alias("stop_id"), F.when(F.col("service_id").isin("D6", "D7"), "weekend").otherwise("week").alias("day"), "trip_id", F.col("departure").alias("scheduled"),
        F.when(seq % 4 != 3, F.col("departure") + seq * F.col("departure") % 1700).alias("predicted"), (seq % 8 == 3).alias("passed"),
    )


@query(
    "w7_headways",
    """SELECT route_id, direction_id, stop_id, day, before, trip_id, planned, actual, reversed, CASE WHEN actual < planned THEN 'bunching' WHEN actual > planned THEN 'gap' ELSE 'matches' END AS kind, severity
FROM pairs JOIN severity USING (planned, actual)
WHERE (actual < planned OR moved = 1) AND (SELECT count(*) FROM running r WHERE r.route_id = pairs.route_id AND r.direction_id = pairs.direction_id AND r.stop_id = pairs.stop_id AND r.day = pairs.day AND r.scheduled BETWEEN pairs.scheduled - planned AND pairs.scheduled) = 2""",
    f"""{RUNNING},
pairs AS (SELECT * FROM (SELECT *, lag(trip_id) OVER w AS before, scheduled - lag(scheduled) OVER w AS planned, abs(predicted - lag(predicted) OVER w) AS actual, predicted < lag(predicted) OVER w AS reversed, place - lag(place) OVER w AS moved
  FROM (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id, stop_id, day ORDER BY predicted, trip_id) AS place FROM running WHERE predicted IS NOT NULL)
  WINDOW w AS (PARTITION BY route_id, direction_id, stop_id, day ORDER BY scheduled, trip_id)) WHERE planned > 0),
{SEVERITY}""",
)
def _(v):
    return operations.headways(_running(v))


@query(
    "w8_reordered_bunching",
    """SELECT route_id, direction_id, stop_id, day, before, trip_id, planned, actual, severity FROM pairs JOIN severity USING (planned, actual) WHERE severity <> 'info'""",
    f"""{RUNNING},
neighbours AS (SELECT *, row_number() OVER () AS pair FROM (SELECT route_id, direction_id, stop_id, day, predicted - lag(predicted) OVER w AS actual,
    least(scheduled, lag(scheduled) OVER w) AS lo, greatest(scheduled, lag(scheduled) OVER w) AS hi,
    CASE WHEN lag(scheduled) OVER w < scheduled THEN lag(trip_id) OVER w ELSE trip_id END AS before, CASE WHEN lag(scheduled) OVER w < scheduled THEN trip_id ELSE lag(trip_id) OVER w END AS trip_id, lag(scheduled) OVER w AS other
  FROM running WHERE predicted IS NOT NULL WINDOW w AS (PARTITION BY route_id, direction_id, stop_id, day ORDER BY predicted, trip_id)) WHERE other IS NOT NULL AND lo < hi),
met AS (SELECT n.*, r.scheduled, r.trip_id IN (n.before, n.trip_id) OR r.predicted IS NOT NULL OR r.passed AS known, r.scheduled - lag(r.scheduled) OVER (PARTITION BY n.pair ORDER BY r.scheduled, r.trip_id) AS own
  FROM neighbours n JOIN running r USING (route_id, direction_id, stop_id, day) WHERE r.scheduled BETWEEN lo AND hi),
pairs AS (SELECT * FROM (SELECT route_id, direction_id, stop_id, day, before, trip_id, any_value(actual) AS actual, min(own) AS planned, count(*) AS expected, bool_and(known) AS known FROM met GROUP BY pair, route_id, direction_id, stop_id, day, before, trip_id)
  WHERE expected > 2 AND known AND actual < planned),
{SEVERITY}""",
)
def _(v):
    return operations.reordered_bunching(_running(v))


@query(
    "ops4_stop_board",
    """SELECT route_id, direction_id, trip_id, CAST(day AS VARCHAR) AS day, stop_sequence, expected, status, stands FROM (
  SELECT *, coalesce(c_arrival, c_departure, s_arrival, s_departure) AS expected, coalesce(c_departure, c_arrival, s_departure, s_arrival) AS leaves,
    coalesce(one AND at_stop = stop_sequence AND status NOT IN ('cancelled', 'skipped'), false) AS stands FROM (
    SELECT *, CASE WHEN usable THEN p_arrival END AS c_arrival, CASE WHEN usable THEN p_departure END AS c_departure,
      CASE WHEN reports > 1 THEN 'unresolved' WHEN NOT fresh THEN 'stale' WHEN one AND relationship = 'CANCELED' THEN 'cancelled' WHEN one AND NOT by_call THEN 'unresolved' WHEN told > 1 THEN 'unresolved'
        WHEN by_call AND skipped THEN 'skipped' WHEN usable AND coalesce(p_arrival, p_departure) IS NOT NULL THEN 'live' ELSE 'scheduled' END AS status FROM (
      SELECT *, coalesce(by_call AND told = 1 AND NOT skipped, false) AS usable FROM (
        SELECT s.*, u.reports, u.relationship, u.fresh, u.passed, u.at_stop, coalesce(u.reports = 1 AND u.fresh, false) AS one, coalesce(u.reports = 1 AND u.fresh AND coalesce(u.relationship, 'SCHEDULED') = 'SCHEDULED', false) AS by_call, p.told, p.skipped, p.arrival AS p_arrival, p.departure AS p_departure
        FROM run s LEFT JOIN (SELECT trip_id, day, count(*) AS reports, max(update_id) AS update_id, max(relationship) AS relationship, bool_and(fresh) AS fresh, max(passed) AS passed, max(at_stop) AS at_stop FROM updates GROUP BY ALL) u USING (trip_id, day)
        LEFT JOIN (SELECT update_id, stop_sequence, count(*) AS told, bool_and(skipped) AS skipped, max(arrival) AS arrival, max(departure) AS departure FROM predictions GROUP BY ALL) p ON p.update_id = u.update_id AND p.stop_sequence = s.stop_sequence))))
WHERE NOT coalesce(one AND (relationship = 'DELETED' OR passed >= stop_sequence), false) AND expected <= 86400 AND (stands OR leaves >= 43200)
ORDER BY stands DESC, expected, trip_id, 4, stop_sequence LIMIT 100""",
    """days AS (SELECT service_id, CAST(d AS DATE) AS day FROM fx_calendar, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16', INTERVAL 1 DAY) g(d)
  WHERE 'D' || CAST(isodow(d) AS VARCHAR) = service_id AND NOT (service_id = 'D1' AND d = TIMESTAMP '2024-01-15') UNION SELECT 'D7', DATE '2024-01-15'),
run AS (SELECT t.route_id, t.direction_id, s.trip_id, d.day, s.stop_sequence, s.arrival + 21600 + date_diff('day', DATE '2024-01-15', d.day) * 86400 AS s_arrival, s.departure + 21600 + date_diff('day', DATE '2024-01-15', d.day) * 86400 AS s_departure
  FROM fx_stop_times s JOIN fx_trips t USING (trip_id) JOIN days d USING (service_id) WHERE s.stop_id = 7),
updates AS (SELECT DISTINCT trip_id || CAST(copy AS VARCHAR) AS update_id, trip_id, DATE '2024-01-15' AS day, CASE WHEN stop_sequence = 2 THEN 'CANCELED' WHEN stop_sequence = 3 THEN 'DELETED' WHEN stop_sequence = 4 THEN 'ADDED' END AS relationship,
  stop_sequence <> 5 AS fresh, CASE WHEN stop_sequence = 6 THEN 6 END AS passed, CASE WHEN stop_sequence = 7 THEN 7 END AS at_stop FROM fx_stop_times, (VALUES (0), (1)) c(copy) WHERE stop_id = 7 AND trip_id IN (SELECT trip_id FROM fx_stop_times WHERE stop_id = 7 GROUP BY trip_id HAVING count(*) = 1) AND (copy = 0 OR stop_sequence = 8)),
predictions AS (SELECT trip_id || '0' AS update_id, stop_sequence, stop_sequence % 5 = 4 AS skipped, CASE WHEN stop_sequence % 5 <> 3 THEN arrival + 21600 + 60 * stop_sequence END AS arrival, departure + 21600 + 90 * stop_sequence AS departure FROM fx_stop_times, (VALUES (0), (1)) c(copy) WHERE stop_id = 7 AND stop_sequence > 8 AND (copy = 0 OR stop_sequence % 7 = 0))""",
)
def _(v):
    """Times stand six hours later than in the tables, so that some of the day before are after midnight."""
    later = v.stop_times.withColumn("arrival", F.col("arrival") + 21600).withColumn("departure", F.col("departure") + 21600)
    calls, seq = later.join(v.trips, "trip_id"), F.col("stop_sequence")
    here = later.where("stop_id = 7")
    once = here.groupBy("trip_id").agg(F.count("*").alias("n"), F.max("stop_sequence").alias("stop_sequence")).where("n = 1")
    copies = F.explode(F.array(F.lit(0), F.lit(1)))
    updates = once.withColumn("copy", copies).where("copy = 0 OR stop_sequence = 8").select(
        F.concat("trip_id", F.col("copy").cast("string")).alias("update_id"), "trip_id", F.lit("2024-01-15").cast("date").alias("day"),
        F.when(seq == 2, "CANCELED").when(seq == 3, "DELETED").when(seq == 4, "ADDED").alias("relationship"), (seq != 5).alias("fresh"),
        F.when(seq == 6, 6).alias("passed"), F.when(seq == 7, 7).alias("at_stop"),
    )
    predictions = here.where("stop_sequence > 8").withColumn("copy", copies).where("copy = 0 OR stop_sequence % 7 = 0").select(
        F.concat("trip_id", F.lit("0")).alias("update_id"), "stop_sequence", (seq % 5 == 4).alias("skipped"), F.when(seq % 5 != 3, F.col("arrival") + 60 * seq).alias("arrival"), (F.col("departure") + 90 * seq).alias("departure")
    )
    return operations.stop_board(calls, calendar.service_days(v.calendar, v.exceptions), 7, "2024-01-15", NOW, 86400, updates, predictions).withColumn("day", F.col("day").cast("string"))


@query("j9_service_windows", "SELECT trip_id, seconds FROM (SELECT trip_id, least(max(arrival), 50400) - greatest(min(departure), 36000) AS seconds FROM fx_connections GROUP BY trip_id) WHERE seconds > 0")
def _(v):
    return operations.service_windows(network.trip_spans(v.connections), 36000, 50400).select("trip_id", "seconds")


@query(
    "a19_route_operations",
    """SELECT route_id, trips, reporting, max_delay, CASE WHEN coalesce(max_delay, 0) >= 900 THEN 'critical' WHEN coalesce(max_delay, 0) >= 300 THEN 'warning' ELSE 'none' END AS severity FROM (SELECT t.route_id, count(*) AS trips, count(u.delay) AS reporting, max(u.delay) AS max_delay FROM fx_trips t LEFT JOIN (SELECT trip_id, max(delay) AS delay FROM fx_trip_updates GROUP BY trip_id) u USING (trip_id) GROUP BY t.route_id)""",
)
def _(v):
    worst = v.trip_updates.groupBy("trip_id").agg(F.max("delay").alias("delay"))
    return operations.route_operations(v.trips.join(worst, "trip_id", "left"))


@query(
    "ops9_coverage",
    """SELECT scope, CASE WHEN lo IS NULL THEN 'unknown' WHEN 20240115 BETWEEN lo AND hi THEN CASE WHEN active THEN 'scheduled_service' ELSE 'no_service_today' END WHEN on_road THEN 'continuing_service' ELSE 'outside_dates' END AS status FROM (
  SELECT s.scope, min(least(start_date, coalesce(x.date, start_date))) AS lo, max(greatest(end_date, coalesce(x.date, end_date))) AS hi,
    coalesce(bool_or(coalesce(x.exception_type = 1, false) OR (start_date <= 20240115 AND end_date >= 20240115 AND monday = 1 AND coalesce(x.exception_type, 0) <> 2)), false) AS active,
    EXISTS (SELECT 1 FROM spans p JOIN days d ON d.service_id = p.service_id WHERE p.scope = s.scope AND p.lo < 3601 + date_diff('day', d.day, DATE '2024-01-15') * 86400 AND p.hi > 3600 + date_diff('day', d.day, DATE '2024-01-15') * 86400) AS on_road
  FROM scopes s LEFT JOIN cal c ON c.scope = s.scope LEFT JOIN (SELECT * FROM fx_exceptions WHERE date = 20240115) x ON x.service_id = c.service_id GROUP BY s.scope)""",
    """scopes AS (SELECT * FROM (VALUES ('week'), ('weekend'), ('past'), ('gone'), ('none')) v(scope)),
cal AS (SELECT CASE WHEN service_id IN ('D6', 'D7') THEN 'weekend' ELSE 'week' END AS scope, * FROM fx_calendar UNION ALL SELECT 'past' AS scope, * REPLACE ('P' || service_id AS service_id, 20240114 AS end_date) FROM fx_calendar
  UNION ALL SELECT 'gone' AS scope, * REPLACE ('G' || service_id AS service_id, 20240108 AS end_date) FROM fx_calendar),
days AS (SELECT service_id, CAST(d AS DATE) AS day FROM cal, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) g(d)
  WHERE right(service_id, 1) = CAST(isodow(d) AS VARCHAR) AND CAST(d AS DATE) <= strptime(CAST(end_date AS VARCHAR), '%Y%m%d') AND NOT (service_id = 'D1' AND d = TIMESTAMP '2024-01-15') UNION SELECT 'D7', DATE '2024-01-15'),
trips AS (SELECT service_id, trip_id, min(departure) + 43200 AS lo, max(arrival) + 43200 AS hi FROM fx_connections GROUP BY ALL),
spans AS (SELECT CASE WHEN service_id IN ('D6', 'D7') THEN 'weekend' ELSE 'week' END AS scope, service_id, lo, hi FROM trips UNION ALL SELECT 'past', 'P' || service_id, lo, hi FROM trips UNION ALL SELECT 'gone', 'G' || service_id, lo, hi FROM trips)""",
)
def _(v):
    """Four sources of one timetable, half a day later: weekdays, weekends, all that ended yesterday, all that ended a week before; and one without a calendar."""
    def scoped(rows):
        own = rows.withColumn("scope", F.when(F.col("service_id").isin("D6", "D7"), "weekend").otherwise("week"))
        return own, [rows.withColumn("service_id", F.concat(F.lit(k), "service_id")).withColumn("scope", F.lit(name)) for k, name in (("P", "past"), ("G", "gone"))]

    own, (past, gone) = scoped(v.calendar)
    services = own.unionByName(past.withColumn("end_date", F.lit(20240114))).unionByName(gone.withColumn("end_date", F.lit(20240108)))
    spans = network.trip_spans(v.connections).select("service_id", *[(F.col(c) + 43200).alias(c) for c in ("first_departure", "last_arrival")])
    first, others = scoped(spans)
    spans = first.unionByName(others[0]).unionByName(others[1])
    scopes = v.spark.createDataFrame([(s,) for s in ("week", "weekend", "past", "gone", "none")], "scope string")
    return operations.coverage_status(scopes, services, scoped(v.exceptions)[0], spans, 20240115, 3600)


#: alert_id, scope, route_id, stop_id, direction_id, route_type, trip_id, start, end; the last alert gives no field.
SELECTORS = (
    (1, "a", "R3", None, None, None, None, None, None), (2, "a", None, 17, None, None, None, 0, 43200), (3, "a", "R4", 17, None, None, None, None, None), (4, "a", None, None, 1, None, None, 50000, None),
    (5, "a", "R5", None, 1, None, None, None, 40000), (6, "a", None, None, 1, None, None, 40000, None), (7, "b", None, None, None, 3, None, None, None), (8, "b", "R6", None, None, 2, None, None, None),
    (9, "a", None, None, None, None, "1-2024-01-01", None, None), (10, "b", "R3", None, None, None, None, None, None), (11, "b", None, None, None, None, None, 43200, 43201),
)


@query(
    "p7_matching_alerts",
    """SELECT DISTINCT c.call_id, a.alert_id FROM calls c JOIN selectors a ON a.scope = c.scope AND (a.r IS NULL OR a.r = c.route_id) AND (a.s IS NULL OR a.s = c.stop_id) AND (a.dir IS NULL OR a.dir = c.direction_id)
AND (a.rt IS NULL OR a.rt = c.route_type) AND (a.trip IS NULL OR a.trip = c.trip_id) AND (b IS NULL OR b <= 43200) AND (e IS NULL OR e >= 43200)""",
    f"""selectors AS (SELECT * FROM (VALUES {_values(SELECTORS)}) a(alert_id, scope, r, s, dir, rt, trip, b, e)),
calls AS (SELECT event_id AS call_id, 'R' || CAST(user_id % 20 AS VARCHAR) AS route_id, stop_id, CAST(user_id % 2 AS INTEGER) AS direction_id, CAST(user_id % 4 AS INTEGER) AS route_type, CAST(user_id AS VARCHAR) || '-' || CAST(d AS VARCHAR) AS trip_id, CASE WHEN user_id % 3 = 0 THEN 'b' ELSE 'a' END AS scope FROM fx_calls)""",
)
def _(v):
    selectors = v.spark.createDataFrame(SELECTORS, "alert_id int, scope string, route_id string, stop_id int, direction_id int, route_type int, trip_id string, start int, end int")
    user = F.col("user_id")
    calls = v.calls.select(
        F.col("event_id").alias("call_id"), F.concat(F.lit("R"), (user % 20).cast("string")).alias("route_id"), "stop_id", (user % 2).cast("int").alias("direction_id"), (user % 4).cast("int").alias("route_type"),
        F.concat_ws("-", user.cast("string"), F.col("d").cast("string")).alias("trip_id"), F.when(user % 3 == 0, "b").otherwise("a").alias("scope"),
    )
    return operations.matching_alerts(selectors, calls, NOW)


@query("r16_realtime_view", "SELECT trip_id, stop_sequence, departure FROM fx_connections WHERE route_id NOT IN ('R1', 'R2') UNION ALL SELECT trip_id, stop_sequence, departure + 300 FROM fx_connections WHERE route_id = 'R2'")
def _(v):
    replaced = v.connections.where("route_id = 'R2'").withColumn("departure", F.col("departure") + 300)
    return operations.realtime_view(v.connections, v.trips.where("route_id = 'R1'"), replaced).select("trip_id", "stop_sequence", "departure")


@query(
    "ops14_added_trips",
    """SELECT trip_id, count(DISTINCT r) AS routes, count(*) AS reports, count(DISTINCT r) <> 1 AS ambiguous FROM (SELECT CASE WHEN stop_id % 2 = 0 THEN 'x' || CAST(event_id % 50 AS VARCHAR) ELSE trip_id END AS trip_id, CAST(sec % 2 AS VARCHAR) AS r FROM fx_trip_updates) WHERE trip_id NOT IN (SELECT trip_id FROM fx_trips) GROUP BY trip_id""",
)
def _(v):
    records = v.trip_updates.select(
        F.when(F.col("stop_id") % 2 == 0, F.concat(F.lit("x"), (F.col("event_id") % 50).cast("string"))).otherwise(F.col("trip_id")).alias("trip_id"), (F.col("sec") % 2).cast("string").alias("route_id"), F.lit("ADDED").alias("relationship")
    )
    return operations.added_trips(records, v.trips)


@query(
    "w14_vehicle_positions",
    """SELECT trip_id, CASE WHEN arrival > 43200 THEN 'moving' WHEN nd IS NOT NULL THEN 'dwelling' ELSE 'arrived' END AS state, from_stop_id, to_stop_id, round(least((43200 - departure) / greatest(arrival - departure, 1), 1.0), 6)::DOUBLE AS share
FROM (SELECT *, lead(departure) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS nd FROM fx_connections) WHERE departure <= 43200 AND coalesce(nd, 1000000000) > 43200""",
)
def _(v):
    return operations.vehicle_positions(v.connections, NOW)


@query(
    "ops7_trip_progress",
    """SELECT trip_id, stop_sequence, CASE WHEN a IS NULL OR stop_sequence < a THEN 'passed' WHEN stop_sequence = a THEN 'next' ELSE 'ahead' END AS progress FROM (SELECT *, min(CASE WHEN departure > 43200 THEN stop_sequence END) OVER (PARTITION BY trip_id) AS a FROM fx_stop_times)""",
)
def _(v):
    return operations.trip_progress(v.stop_times, NOW)


@query("ops16_route_browser", "SELECT route_id, route_type FROM fx_routes WHERE route_id LIKE '%1%' AND route_type IS NOT NULL ORDER BY route_id")
def _(v):
    return v.routes.where("route_id LIKE '%1%' AND route_type IS NOT NULL").orderBy("route_id")


@query(
    "ops12_address_search",
    """SELECT query_id, address_id, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(text), address_id) AS rank FROM (SELECT query_id, address_id, text, sum(p) AS score FROM (
  SELECT q.query_id, a.address_id, a.text, q.key, max(CASE WHEN a.word = q.key THEN 2 ELSE 1 END) AS p FROM (VALUES (1, 'customer'), (1, '000000012'), (2, 'cust'), (2, '0000')) q(query_id, key)
  JOIN (SELECT c_custkey AS address_id, replace(lower(c_name), '#', ' ') AS text, unnest(string_split(replace(lower(c_name), '#', ' '), ' ')) AS word FROM customer) a ON starts_with(a.word, q.key) GROUP BY ALL) GROUP BY ALL)) WHERE rank <= 6""",
)
def _(v):
    addresses = v.table("customer").select(F.col("c_custkey").alias("address_id"), F.col("c_name").alias("name"))
    asked = v.spark.createDataFrame([(1, "Customer 000000012"), (2, "cust 0000")], "query_id int, query string")
    return operations.address_search(addresses, asked)


@query("ops13_near_words", """SELECT asked, word FROM (SELECT a.w AS asked, b.w AS word, row_number() OVER (PARTITION BY a.w ORDER BY b.w) AS k FROM (SELECT DISTINCT lower(n_name) AS w FROM nation UNION SELECT 'francs' UNION SELECT 'kenia') b JOIN (VALUES ('france'), ('kenya'), ('perus'), ('chin')) a(w) ON levenshtein(a.w, b.w) = 1) WHERE k <= 3""")
def _(v):
    more = v.spark.createDataFrame([("francs",), ("kenia",)], "word string")
    words = v.table("nation").select(F.lower("n_name").alias("word")).unionByName(more).distinct()
    return operations.near_words(words, v.spark.createDataFrame([("france",), ("kenya",), ("perus",), ("chin",)], "word string"))


# ---- scenarios ---------------------------------------------------------------------------------------


@query("p4_exclusions", "SELECT trip_id, stop_sequence FROM fx_connections WHERE route_id <> 'R3' AND direction_id = 0")
def _(v):
    return scenario.exclude(v.connections, v.trips.where("direction_id = 1"), v.routes.where("route_id = 'R3'")).select("trip_id", "stop_sequence")


@query(
    "u7_partial_cancellation",
    """SELECT trip_id, stop_sequence, CAST(sum(CAST(coalesce(stop_sequence - p > 1, false) AS INTEGER)) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS BIGINT) AS run FROM (SELECT *, lag(stop_sequence) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS p FROM fx_connections WHERE NOT (route_id = 'R4' AND stop_sequence >= 2 AND stop_sequence < 4))""",
)
def _(v):
    spans = v.trips.where("route_id = 'R4'").select("trip_id", F.lit(2).alias("from_seq"), F.lit(4).alias("to_seq"))
    return scenario.cancel_spans(v.connections, spans).select("trip_id", "stop_sequence", "run")


@query(
    "x4_timing_edits",
    """SELECT trip_id, stop_sequence, b + t - run AS departure, b + t AS arrival FROM (SELECT *, CAST(sum(run + dwell) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS BIGINT) AS t FROM (
  SELECT trip_id, stop_sequence, CAST(round((arrival - departure) / 1.25) AS BIGINT) AS run, CAST(round(coalesce(departure - lag(arrival) OVER w, 0) * 0.5) AS BIGINT) AS dwell, first_value(departure) OVER w AS b FROM fx_connections WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)))""",
)
def _(v):
    return scenario.edit_timing(v.connections, 1.25, 0.5)


@query("x1_planned_service", """SELECT count(*) AS connections, count(DISTINCT trip_id) AS trips FROM (SELECT w || CAST(t AS VARCHAR) AS trip_id FROM (VALUES ('out'), ('back')) v(w), (SELECT unnest(generate_series(21600, 25200, 900)) AS t), range(9))""")
def _(v):
    stops = v.stops.where("stop_id % 11 = 0").select((F.col("stop_id") / 11 + 1).cast("int").alias("stop_no"), "stop_id", "lat", "lon")
    windows = v.spark.createDataFrame([(21600, 25200, 900)], "start_time int, end_time int, headway_secs int")
    return scenario.planned_service(stops, windows, 25.0).agg(F.count("*").alias("connections"), F.countDistinct("trip_id").alias("trips"))


@query(
    "w16_block_links",
    """SELECT block_id, service_id, trip_id, next_trip, leaves - latest AS layover FROM (SELECT *, lead(trip_id) OVER w AS next_trip, lead(f) OVER w AS leaves, lead(fs) OVER w AS nfs, max(e) OVER (PARTITION BY block_id, service_id ORDER BY f, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest,
  count(*) OVER (PARTITION BY block_id, service_id, f) AS c, lead(c0) OVER w AS nc FROM (SELECT *, count(*) OVER (PARTITION BY block_id, service_id, f) AS c0 FROM (SELECT route_id AS block_id, service_id, trip_id, arg_min(departure, stop_sequence) AS f, arg_max(arrival, stop_sequence) AS e, arg_min(from_stop_id % 4, stop_sequence) AS fs, arg_max(to_stop_id % 4, stop_sequence) AS ls FROM fx_connections GROUP BY ALL))
  WINDOW w AS (PARTITION BY block_id, service_id ORDER BY f, trip_id)) WHERE next_trip IS NOT NULL AND c = 1 AND nc = 1 AND latest <= leaves AND ls = nfs""",
)
def _(v):
    spans = v.connections.groupBy(F.col("route_id").alias("block_id"), "service_id", "trip_id").agg(
        F.min_by("departure", "stop_sequence").alias("first_departure"), F.max_by("arrival", "stop_sequence").alias("last_arrival"),
        F.min_by(F.col("from_stop_id") % 4, "stop_sequence").alias("first_stop"), F.max_by(F.col("to_stop_id") % 4, "stop_sequence").alias("last_stop"),
    )
    return scenario.block_links(spans)


RULES = [(1, "R1", 1, None, 5, 250), (2, "R1", None, None, 3, 200), (3, None, 2, 3, 4, 180), (4, None, None, None, 1, 300), (5, "R7", None, 4, 9, 90)]


@query(
    "r25_best_fare",
    """SELECT l.leg_id, b.rule_id, b.amount FROM legs l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY leg_id ORDER BY priority DESC, amount, rule_id) AS k FROM legs JOIN (VALUES (1, 'R1', 1, NULL, 5, 250), (2, 'R1', NULL, NULL, 3, 200), (3, NULL, 2, 3, 4, 180), (4, NULL, NULL, NULL, 1, 300), (5, 'R7', NULL, 4, 9, 90)) r(rule_id, n, f, t, priority, amount)
  ON (n IS NULL OR n = network) AND (f IS NULL OR f = from_area) AND (t IS NULL OR t = to_area)) b ON b.leg_id = l.leg_id AND b.k = 1""",
    "legs AS (SELECT event_id AS leg_id, 'R' || CAST(user_id % 20 AS VARCHAR) AS network, stop_id % 5 AS from_area, CAST(sec % 5 AS INTEGER) AS to_area FROM fx_calls)",
)
def _(v):
    rules = v.spark.createDataFrame(RULES, "rule_id int, network string, from_area int, to_area int, priority int, amount int")
    legs = v.calls.select(F.col("event_id").alias("leg_id"), F.concat(F.lit("R"), (F.col("user_id") % 20).cast("string")).alias("network"), (F.col("stop_id") % 5).alias("from_area"), (F.col("sec") % 5).cast("int").alias("to_area"))
    return scenario.best_fare(legs, rules)


LEGS = """legs AS (SELECT event_id AS leg_id, 'R' || CAST(user_id % 20 AS VARCHAR) AS network, stop_id % 5 AS from_area, CAST(sec % 5 AS INTEGER) AS to_area, d AS day, sec AS t0, sec + 1800 AS t1 FROM fx_calls)"""


def _legs(v):
    return v.calls.select(
        F.col("event_id").alias("leg_id"), F.concat(F.lit("R"), (F.col("user_id") % 20).cast("string")).alias("network"), (F.col("stop_id") % 5).alias("from_area"), (F.col("sec") % 5).cast("int").alias("to_area"),
        F.col("d").alias("day"), F.col("sec").alias("t0"), (F.col("sec") + 1800).alias("t1"),
    )


FRAMES = (("peak", "D1", 25200, 32400), ("peak", "D2", 25200, 32400), ("peak", "D3", 57600, 68400), ("night", "D6", 72000, 86400), ("night", "D7", None, None), ("broken", "D4", 30000, None), ("broken", "D5", 40000, 30000))
TIMED = ((1, "R1", None, None, 9, 400, "peak", None), (2, None, None, None, 5, 350, "peak", "peak"), (3, None, None, 3, 6, 120, None, "night"), (4, None, None, None, 1, 250, None, None), (5, "R2", None, None, 8, 1, "broken", None), (6, "R3", None, None, 8, 2, "unknown", None))


@query(
    "r25_timeframes",
    """SELECT l.leg_id, b.rule_id, b.amount FROM legs l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY leg_id ORDER BY priority DESC, amount, rule_id) AS k FROM legs JOIN rules ON (n IS NULL OR n = network) AND (f IS NULL OR f = from_area) AND (t IS NULL OR t = to_area)
  WHERE (g0 IS NULL OR EXISTS (SELECT 1 FROM frames WHERE g = g0 AND frames.day = legs.day AND t0 >= lo AND t0 < hi)) AND (g1 IS NULL OR EXISTS (SELECT 1 FROM frames WHERE g = g1 AND frames.day = legs.day AND t1 >= lo AND t1 < hi))) b ON b.leg_id = l.leg_id AND b.k = 1""",
    f"""{LEGS},
rules AS (SELECT * FROM (VALUES {_values(TIMED)}) r(rule_id, n, f, t, priority, amount, g0, g1)),
days AS (SELECT service_id, CAST(d AS DATE) AS day FROM fx_calendar, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) x(d)
  WHERE 'D' || CAST(isodow(d) AS VARCHAR) = service_id AND NOT (service_id = 'D1' AND d = TIMESTAMP '2024-01-15') UNION SELECT 'D7', DATE '2024-01-15'),
frames AS (SELECT g, day, coalesce(lo, 0) AS lo, coalesce(hi, 86400) AS hi FROM (VALUES {_values(FRAMES)}) f(g, service_id, lo, hi) JOIN days USING (service_id) WHERE (lo IS NULL AND hi IS NULL) OR lo < hi)""",
)
def _(v):
    legs, days = _legs(v), calendar.service_days(v.calendar, v.exceptions)
    frames = v.spark.createDataFrame(FRAMES, "timeframe string, service_id string, start_time int, end_time int")
    rules = v.spark.createDataFrame(TIMED, "rule_id int, network string, from_area int, to_area int, priority int, amount int, from_timeframe string, to_timeframe string")
    at = lambda c: scenario.in_timeframes(legs.select("leg_id", "day", F.col(c).alias("seconds")), frames, days)
    return scenario.best_fare(legs, rules, at("t0"), at("t1"))


V1_FARES = (("flat", 300), ("zone", 250), ("line", 150), ("loop", 100))
V1_RULES = (("zone", None, "1", "2", None), ("zone", None, "2", None, None), ("line", "R4", None, None, None), ("line", "R5", "3", None, None), ("loop", "R6", "4", None, "2"))


@query(
    "r25_v1_fares",
    """SELECT l.leg_id, CASE WHEN s.ok THEN o.fare_id END AS fare_id, CASE WHEN s.ok THEN o.price END AS price, CASE WHEN s.ok THEN CAST(o.k AS INTEGER) END AS rank, s.ok AS supported
FROM legs l JOIN (SELECT leg_id, count(m.c) = 0 AS ok FROM legs LEFT JOIN met m USING (leg_id) GROUP BY leg_id) s USING (leg_id)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY leg_id ORDER BY price, fare_id) AS k FROM (SELECT DISTINCT leg_id, fare_id, price FROM met)) o ON o.leg_id = l.leg_id AND (s.ok OR o.k = 1)""",
    f"""{LEGS},
met AS (SELECT leg_id, a.fare_id, a.price, r.c FROM legs CROSS JOIN (VALUES {_values(V1_FARES)}) a(fare_id, price) LEFT JOIN (VALUES {_values(V1_RULES)}) r(fare_id, n, f, t, c) ON r.fare_id = a.fare_id AND (n IS NULL OR n = network) AND (f IS NULL OR f = CAST(from_area AS VARCHAR)) AND (t IS NULL OR t = CAST(to_area AS VARCHAR))
  WHERE r.fare_id IS NOT NULL OR a.fare_id = 'flat')""",
)
def _(v):
    legs = _legs(v).select("leg_id", F.col("network").alias("route_id"), F.col("from_area").cast("string").alias("from_zone"), F.col("to_area").cast("string").alias("to_zone"))
    return scenario.fares_v1(legs, v.spark.createDataFrame(V1_FARES, "fare_id string, price int"), v.spark.createDataFrame(V1_RULES, "fare_id string, route_id string, origin_id string, destination_id string, contains_id string"))


# ---- streets -----------------------------------------------------------------------------------------


@query(
    "g1_street_paths",
    "SELECT 0 AS source, node, CAST(min(cost) AS BIGINT) AS cost FROM reach GROUP BY node",
    "reach AS (SELECT 0 AS node, CAST(0 AS BIGINT) AS cost UNION SELECT e.v, r.cost + e.metres FROM reach r JOIN fx_street_edges e ON e.u = r.node WHERE r.cost + e.metres <= 5000)",
)
def _(v):
    seeds = v.spark.createDataFrame([(0, 0, 0)], "source int, node int, cost long")
    return streets.shortest_paths(v.street_edges.select("u", "v", F.col("metres").alias("cost")), seeds, 5000)


@query(
    "g3_traffic_weights",
    """SELECT e.u, e.v, e.metres, CASE WHEN t.f IS NOT NULL THEN greatest(s, CAST(ceil(s * t.f) AS BIGINT)) ELSE s END AS seconds FROM (SELECT *, CAST(ceil(metres / 10.0) AS BIGINT) AS s FROM fx_street_edges) e
LEFT JOIN (SELECT stop_id AS u, max(1 + stop_id % 4 * 0.25) AS f FROM fx_stops WHERE stop_id % 3 = 0 GROUP BY stop_id) t USING (u) WHERE NOT (e.u % 13 = 0 AND e.u % 3 = 0)""",
)
def _(v):
    edges = v.street_edges.withColumn("seconds", F.ceil(F.col("metres") / 10).cast("long"))
    updates = edges.where("u % 3 = 0").select("u", "v", (1 + F.col("u") % 4 * 0.25).alias("factor"), F.lit(None).cast("double").alias("kmh"), (F.col("u") % 13 == 0).alias("closed"))
    return streets.apply_traffic(edges, updates)


@query("g5_street_surface", "SELECT u, v, metres AS cost FROM fx_street_edges WHERE u = 0 AND metres <= 1150")
def _(v):
    zero = v.spark.createDataFrame([(0, 0, 0)], "source int, node int, cost int")
    return streets.path_surface(zero, v.street_edges.withColumnRenamed("metres", "seconds"), 1150).select("u", "v", "cost")


@query("j15_road_attachment", "SELECT stop_id AS point_id, 0.0::DOUBLE AS km FROM fx_stops")
def _(v):
    side = lambda n: v.stops.select(F.col("stop_id").alias("u" if n == 1 else "v"), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"))
    edges = v.street_edges.select("u", "v").join(side(1), "u").join(side(2), "v")
    return streets.attach(v.stops.select(F.col("stop_id").alias("point_id"), "lat", "lon"), edges, 0.5).select("point_id", "km")


@query(
    "w13_shape_distance",
    """SELECT station_id AS shape_id, CAST(stop_id AS INTEGER) AS point_no, round(sum(s) OVER (PARTITION BY station_id ORDER BY stop_id), 6) AS km FROM (SELECT *, coalesce(12742.0176 * asin(sqrt(pow(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER w) / 2), 2))), 0) AS s FROM fx_stops WINDOW w AS (PARTITION BY station_id ORDER BY stop_id))""",
)
def _(v):
    points = v.stops.select(F.col("station_id").alias("shape_id"), F.col("stop_id").alias("point_no"), "lat", "lon")
    return streets.cumulative_shape(points).select("shape_id", "point_no", F.round("km", 6).alias("km"))


@query("a8_frequency_class", "SELECT stop_id, CASE WHEN stop_id > 0 AND stop_id <= 15 THEN 'high' WHEN stop_id > 0 AND stop_id <= 30 THEN 'medium' ELSE 'low' END AS frequency FROM fx_stops")
def _(v):
    return v.stops.select("stop_id", measures.frequency_class(F.col("stop_id")).alias("frequency"))
