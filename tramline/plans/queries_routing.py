"""Queries of search, reach and analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import analysis, routing, transfers
from tramline.plans.registry import query

START = 28800
OPT = routing.Options(skyline=False)


def rounds_sql(n: int, origins: str, conns: str = "fx_connections", walks: str = "fx_transfers", horizon: int = 86400, p: str = "", minima: bool = False) -> str:
    """Expressions l0 ... ln: labels (o, stop, kind, arrival) of each round; lall has them all with their round k. p stands before every name."""
    parts = [f"{p}l0 AS ({origins})"]
    for k in range(1, n + 1):
        least = "coalesce(m.minimum, 120) + 60" if minima else "180"
        ready = f"l.arrival + CASE l.kind WHEN 'ride' THEN {least} WHEN 'transfer' THEN 60 ELSE 0 END"
        at = f"{p}l{k - 1} l" + (" LEFT JOIN minima m ON m.stop_id = l.stop" if minima else "")
        also = " AND (l.kind <> 'ride' OR NOT coalesce(m.forbidden, false))" if minima else ""
        parts.append(
            f"""{p}r{k} AS MATERIALIZED (SELECT o, c.to_stop_id AS stop, min(c.arrival) AS arrival FROM (
  SELECT o, trip_id, min(stop_sequence) AS s FROM {at} JOIN {conns} c ON l.stop = c.from_stop_id AND c.departure >= {ready} WHERE c.can_board AND c.departure <= {horizon}{also} GROUP BY ALL) b
  JOIN {conns} c USING (trip_id) WHERE c.stop_sequence >= s AND c.departure <= {horizon} AND c.can_alight GROUP BY ALL),
{p}l{k} AS MATERIALIZED (SELECT o, stop, 'ride' AS kind, arrival FROM {p}r{k} UNION ALL SELECT o, to_stop_id, 'transfer', min(arrival + seconds) FROM {p}r{k} JOIN {walks} t ON t.from_stop_id = stop GROUP BY ALL)"""
        )
    every = " UNION ALL ".join(f"SELECT *, {k} AS k FROM {p}l{k}" for k in range(1, n + 1))
    parts.append(f"{p}lall AS ({every})")
    parts.append(f"{p}best AS (SELECT o, stop, min(arrival) AS arrival, arg_min(k, (arrival, k)) AS boardings FROM {p}lall GROUP BY ALL)")
    return ",\n".join(parts)


def skyline_sql(n: int, origins: str) -> str:
    """The same with walking: all labels of a round that no other of it beats; options has those that no label of any round beats."""
    parts = [f"l0 AS ({origins})"]
    for k in range(1, n + 1):
        ready = "l.arrival + CASE l.kind WHEN 'ride' THEN 180 WHEN 'transfer' THEN 60 ELSE 0 END"
        parts.append(
            f"""r{k} AS MATERIALIZED (SELECT o, c.to_stop_id AS stop, c.arrival, min(b.walking) AS walking FROM (
  SELECT o, trip_id, stop_sequence AS s, min(walking) AS walking FROM l{k - 1} l JOIN fx_connections c ON l.stop = c.from_stop_id AND c.departure >= {ready} WHERE c.can_board GROUP BY ALL) b
  JOIN fx_connections c USING (trip_id) WHERE c.stop_sequence >= s AND c.can_alight GROUP BY ALL),
w{k} AS (SELECT o, stop, 'ride' AS kind, arrival, walking FROM r{k} UNION ALL SELECT o, to_stop_id, 'transfer', arrival + seconds, min(walking + seconds) FROM r{k} JOIN fx_transfers t ON t.from_stop_id = stop GROUP BY ALL),
l{k} AS MATERIALIZED (SELECT o, stop, kind, arrival, walking FROM (SELECT *, min(walking) OVER (PARTITION BY o, stop, kind ORDER BY arrival, walking ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w{k}) WHERE m IS NULL OR walking < m)"""
        )
    every = " UNION ALL ".join(f"SELECT *, {k} AS k FROM l{k}" for k in range(1, n + 1))
    parts.append(f"lall AS MATERIALIZED (SELECT o, stop, arrival, k, min(walking) AS walking FROM ({every}) GROUP BY ALL)")
    parts.append(
        """options AS MATERIALIZED (SELECT o AS origin_id, stop AS stop_id, arrival, CAST(k AS INTEGER) AS boardings, CAST(walking AS BIGINT) AS walking FROM lall a WHERE NOT EXISTS (
  SELECT 1 FROM lall b WHERE b.o = a.o AND b.stop = a.stop AND b.arrival <= a.arrival AND b.k <= a.k AND b.walking <= a.walking AND (b.arrival < a.arrival OR b.k < a.k OR b.walking < a.walking)))"""
    )
    return ",\n".join(parts)


def origin_rows(v, ids, at=START):
    return v.spark.createDataFrame([(i, i, at) for i in ids], "origin_id int, stop_id int, arrival long")


ONE = f"SELECT 0 AS o, 0 AS stop, 'origin' AS kind, CAST({START} AS BIGINT) AS arrival"
THREE = f"SELECT o, o AS stop, 'origin' AS kind, CAST({START} AS BIGINT) AS arrival FROM (VALUES (0), (17), (42)) w(o)"


@query("r1_earliest_arrival", "SELECT stop AS stop_id, arrival, CAST(boardings AS INTEGER) AS boardings FROM best", rounds_sql(3, ONE))
def _(v):
    found = routing.labels(v.connections, v.transfers, origin_rows(v, [0]), OPT)
    return routing.earliest(found, OPT).select("stop_id", "arrival", "boardings")


@query("r3_one_to_many", "SELECT o AS origin_id, stop AS stop_id, arrival, CAST(boardings AS INTEGER) AS boardings FROM best", rounds_sql(2, THREE))
def _(v):
    opt = routing.Options(boardings=2, skyline=False)
    found = routing.labels(v.connections, v.transfers, origin_rows(v, [0, 17, 42]), opt)
    return routing.earliest(found, opt).select("origin_id", "stop_id", "arrival", "boardings")


MIRROR = """mirror AS MATERIALIZED (SELECT trip_id, -stop_sequence AS stop_sequence, to_stop_id AS from_stop_id, from_stop_id AS to_stop_id, 86400 - arrival AS departure, 86400 - departure AS arrival, can_alight AS can_board, can_board AS can_alight FROM fx_connections),
back AS (SELECT to_stop_id AS from_stop_id, from_stop_id AS to_stop_id, seconds FROM fx_transfers), """


@query(
    "r2_latest_departure",
    "SELECT stop AS stop_id, 86400 - arrival AS departure, CAST(boardings AS INTEGER) AS boardings FROM best",
    MIRROR + rounds_sql(3, "SELECT 55 AS o, 55 AS stop, 'origin' AS kind, CAST(86400 - 64800 AS BIGINT) AS arrival", "mirror", "back"),
)
def _(v):
    goal = v.spark.createDataFrame([(55, 55, 64800)], "destination_id int, stop_id int, deadline long")
    return routing.latest_departures(v.connections, v.transfers, goal, OPT).select("stop_id", "departure", "boardings")


@query(
    "r4_matrix",
    f"""SELECT a.i AS origin_id, b.i AS destination_id, arrival - {START} AS seconds FROM (VALUES ('A', 0), ('B', 17), ('C', 42), ('D', 17)) a(i, s) CROSS JOIN (VALUES ('X', 3), ('Y', 77), ('Z', 98)) b(i, s) LEFT JOIN best ON o = a.s AND stop = b.s""",
    rounds_sql(3, THREE),
)
def _(v):
    origins = v.spark.createDataFrame([("A", 0), ("B", 17), ("C", 42), ("D", 17)], "origin_id string, stop_id int")
    destinations = v.spark.createDataFrame([("X", 3), ("Y", 77), ("Z", 98)], "destination_id string, stop_id int")
    return routing.matrix(v.connections, v.transfers, origins, destinations, START, OPT)


@query(
    "r8_overlay_search",
    "SELECT stop AS stop_id, arrival, CAST(boardings AS INTEGER) AS boardings FROM best",
    """overlay AS MATERIALIZED (SELECT departure, arrival, trip_id, from_stop_id, to_stop_id, stop_sequence, can_board, can_alight FROM fx_connections WHERE route_id <> 'R3'
  UNION ALL SELECT t, t + 600, 'plan' || CAST(t AS VARCHAR), 0, 99, 1, true, true FROM (SELECT unnest(range(30000, 36000, 1800)) AS t)), """
    + rounds_sql(2, ONE, "overlay"),
)
def _(v):
    planned = v.spark.range(30000, 36000, 1800).select(
        F.col("id").alias("departure"), (F.col("id") + 600).alias("arrival"), F.concat(F.lit("plan"), F.col("id").cast("string")).alias("trip_id"), F.lit(0).alias("from_stop_id"),
        F.lit(99).alias("to_stop_id"), F.lit(1).alias("stop_sequence"), F.lit(True).alias("can_board"), F.lit(True).alias("can_alight"),
    )
    conns = v.connections.where("route_id <> 'R3'").select(*planned.columns).unionByName(planned)
    opt = routing.Options(boardings=2, skyline=False)
    return routing.earliest(routing.labels(conns, v.transfers, origin_rows(v, [0]), opt), opt).select("stop_id", "arrival", "boardings")


@query(
    "r18_departure_windows",
    "SELECT o AS departure_at, stop AS stop_id, arrival FROM best",
    rounds_sql(2, "SELECT o, 5 AS stop, 'origin' AS kind, CAST(o AS BIGINT) AS arrival FROM (SELECT CAST(unnest(range(28800, 32400, 600)) AS INTEGER) AS o)"),
)
def _(v):
    found = routing.windows(v.connections, v.transfers, 5, list(range(28800, 32400, 600)), routing.Options(boardings=2, skyline=False))
    return found.select("departure_at", "stop_id", "arrival")


OPTIONS = skyline_sql(2, f"SELECT o, o AS stop, 'origin' AS kind, CAST({START} AS BIGINT) AS arrival, 0 AS walking FROM (VALUES (0), (17), (42)) w(o)")


def _options(v):
    """The options of a search with two boardings from three stops."""
    return routing.pareto(routing.labels(v.connections, v.transfers, origin_rows(v, [0, 17, 42]), routing.Options(boardings=2)))


@query("w11_pareto", "SELECT * FROM options", OPTIONS)
def _(v):
    return _options(v)


@query(
    "t3_ranked_alternatives",
    """SELECT origin_id, stop_id, arrival, boardings, walking, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY origin_id, stop_id ORDER BY arrival, walking, boardings) AS rank FROM (SELECT DISTINCT *, min(arrival) OVER (PARTITION BY origin_id, stop_id) AS b FROM options) WHERE arrival <= b + 7200) WHERE rank <= 9""",
    OPTIONS,
)
def _(v):
    return routing.ranked(_options(v), slack=7200)


@query(
    "t4_bounded_choice",
    """SELECT origin_id, stop_id, arrival, boardings, walking, 'best' AS role FROM options QUALIFY row_number() OVER (PARTITION BY origin_id, stop_id ORDER BY arrival, boardings, walking) = 1
UNION ALL SELECT origin_id, stop_id, arrival, boardings, walking, 'fewest_boardings' FROM options QUALIFY row_number() OVER (PARTITION BY origin_id, stop_id ORDER BY boardings, arrival, walking) = 1
UNION ALL SELECT origin_id, stop_id, arrival, boardings, walking, 'least_walking' FROM options QUALIFY row_number() OVER (PARTITION BY origin_id, stop_id ORDER BY walking, arrival, boardings) = 1""",
    OPTIONS,
)
def _(v):
    return routing.bounded_choice(_options(v))


@query("r6_generalized_cost", "SELECT origin_id, stop_id, min(arrival + 300 * (boardings - 1) + walking) AS cost FROM options GROUP BY ALL", OPTIONS)
def _(v):
    """Walking counts twice, a change five minutes."""
    return routing.generalized(_options(v)).groupBy("origin_id", "stop_id").agg(F.min("cost").alias("cost"))


@query("r1_pre_walk", "SELECT stop AS stop_id, arrival, CAST(boardings AS INTEGER) AS boardings FROM best", rounds_sql(2, ONE + " UNION ALL SELECT 0, to_stop_id, 'transfer', 28800 + seconds FROM fx_transfers WHERE from_stop_id = 0"))
def _(v):
    opt = routing.Options(boardings=2, pre_walk=True, skyline=False)
    return routing.earliest(routing.labels(v.connections, v.transfers, origin_rows(v, [0]), opt), opt).select("stop_id", "arrival", "boardings")


@query("r5_journeys", "SELECT stop AS stop_id, arrival, CAST(boardings AS BIGINT) AS rides FROM best", rounds_sql(2, ONE))
def _(v):
    """When the last leg of the journey to every stop ends, and how many of its legs are rides; tests hold the legs."""
    legs = routing.journeys(v.connections, v.transfers, origin_rows(v, [0]), routing.Options(boardings=2))
    return legs.groupBy("stop_id").agg(F.max_by("arrival", "leg").alias("arrival"), F.count(F.when(F.col("mode") == "ride", 1)).alias("rides"))


@query(
    "r10_stop_minima",
    "SELECT stop AS stop_id, arrival, CAST(boardings AS INTEGER) AS boardings FROM best",
    "minima AS (SELECT stop_id, CASE WHEN stop_id % 3 = 0 THEN 900 END AS minimum, stop_id % 10 = 9 AS forbidden FROM fx_stops), " + rounds_sql(2, ONE, minima=True),
)
def _(v):
    minima = v.stops.select("stop_id", F.when(F.col("stop_id") % 3 == 0, 900).alias("minimum"), (F.col("stop_id") % 10 == 9).alias("forbidden"))
    opt = routing.Options(boardings=2, skyline=False)
    return routing.earliest(routing.labels(v.connections, v.transfers, origin_rows(v, [0]), opt, minima), opt).select("stop_id", "arrival", "boardings")


@query(
    "r19_through_via",
    "SELECT stop AS stop_id, arrival, CAST(boardings AS INTEGER) AS boardings FROM vbest",
    rounds_sql(2, ONE) + ", " + rounds_sql(2, "SELECT o, stop, 'origin' AS kind, arrival FROM best WHERE stop = 42", p="v"),
)
def _(v):
    return routing.through_via(v.connections, v.transfers, 0, 42, START, routing.Options(boardings=2, skyline=False)).select("stop_id", "arrival", "boardings")


POINTS = ((1, 38.9312, -77.0181), (2, 38.9649, -76.9755), (3, 38.9203, -76.9601))


@query(
    "r21_access",
    "SELECT o AS origin_id, stop AS stop_id, arrival, CAST(boardings AS INTEGER) AS boardings FROM best",
    f"""points AS (SELECT * FROM (VALUES {", ".join(f"({o}, CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))" for o, lat, lon in POINTS)}) p(o, plat, plon)),
access AS (SELECT o, stop_id, CAST(ceil(km / 4.8 * 3600) AS BIGINT) AS seconds FROM (SELECT o, stop_id, 12742.0176 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))) AS km FROM points, fx_stops) WHERE km <= 1.5), """
    + rounds_sql(2, f"SELECT o, stop_id AS stop, 'origin' AS kind, {START} + seconds AS arrival FROM access"),
)
def _(v):
    """From points off the stops: every stop within 1.5 km is reached on foot first."""
    points = v.spark.createDataFrame([(*p, START) for p in POINTS], "origin_id int, lat double, lon double, departure long")
    opt = routing.Options(boardings=2, skyline=False)
    found = routing.labels(v.connections, v.transfers, routing.access(points, v.stops, 1.5), opt)
    return routing.earliest(found, opt).select("origin_id", "stop_id", "arrival", "boardings")


@query(
    "r23_arrival_reserve",
    "SELECT stop AS stop_id, 86400 - arrival AS departure FROM best",
    MIRROR + rounds_sql(2, "SELECT 55 AS o, 55 AS stop, 'origin' AS kind, CAST(86400 - 64800 + 600 AS BIGINT) AS arrival", "mirror", "back"),
)
def _(v):
    """To be there ten minutes before the deadline."""
    goal = v.spark.createDataFrame([(55, 55, 64800)], "destination_id int, stop_id int, deadline long")
    return routing.latest_departures(v.connections, v.transfers, goal, routing.Options(boardings=2, reserve=600, skyline=False)).select("stop_id", "departure")


@query(
    "j7_earliest_boardable",
    "SELECT event_id AS ask_id, stop_id, sec + 60 AS ready, (SELECT min(departure) FROM fx_connections c WHERE c.can_board AND c.from_stop_id = e.stop_id AND c.departure >= e.sec + 60) AS departure FROM fx_calls e",
)
def _(v):
    return routing.earliest_boardable(v.connections, v.calls.select(F.col("event_id").alias("ask_id"), "stop_id", (F.col("sec") + 60).alias("ready")))


@query("j8_last_before", "SELECT event_id AS ask_id, stop_id, sec AS ready, (SELECT max(departure) FROM fx_connections c WHERE c.from_stop_id = e.stop_id AND c.departure <= e.sec) AS departure FROM fx_calls e")
def _(v):
    return routing.last_before(v.connections, v.calls.select(F.col("event_id").alias("ask_id"), "stop_id", F.col("sec").alias("ready")))


@query(
    "j10_aligned_rides",
    """SELECT min(trip_id) AS first_trip, count(*) AS trips FROM (SELECT trip_id, string_agg(CAST(from_stop_id AS VARCHAR) || '>' || CAST(to_stop_id AS VARCHAR) || CAST(can_board AS VARCHAR) || CAST(can_alight AS VARCHAR), ';' ORDER BY stop_sequence) AS p FROM fx_connections GROUP BY trip_id) GROUP BY p HAVING count(*) > 1""",
)
def _(v):
    return routing.aligned_rides(v.connections).groupBy("path").agg(F.min("trip_id").alias("first_trip"), F.count("*").alias("trips")).where("trips > 1").select("first_trip", "trips")


@query(
    "r22_walk_or_ride",
    """SELECT coalesce(r.a, w.from_stop_id) AS origin_id, coalesce(r.b, w.to_stop_id) AS destination_id, CASE WHEN w.seconds IS NOT NULL AND (r.s IS NULL OR w.seconds <= r.s) THEN w.seconds ELSE r.s END AS seconds, CASE WHEN w.seconds IS NOT NULL AND (r.s IS NULL OR w.seconds <= r.s) THEN 'walk' ELSE 'transit' END AS mode
FROM (SELECT from_stop_id AS a, to_stop_id AS b, min(arrival - departure) AS s FROM fx_connections GROUP BY ALL) r FULL JOIN fx_transfers w ON r.a = w.from_stop_id AND r.b = w.to_stop_id""",
)
def _(v):
    rides = v.connections.groupBy(F.col("from_stop_id").alias("origin_id"), F.col("to_stop_id").alias("destination_id")).agg(F.min(F.col("arrival") - F.col("departure")).alias("seconds"))
    walks = v.transfers.select(F.col("from_stop_id").alias("origin_id"), F.col("to_stop_id").alias("destination_id"), "seconds")
    return routing.walk_or_ride(rides, walks)


#: Least metres of walks of up to 128 edges, by seven times joining walks with themselves; there are 100 stops.
WALKS = ", ".join(
    ["d0 AS MATERIALIZED (SELECT u, v, CAST(min(metres) AS BIGINT) AS s FROM fx_street_edges GROUP BY ALL)"]
    + [f"d{k} AS MATERIALIZED (SELECT u, v, min(s) AS s FROM (SELECT * FROM d{k - 1} UNION ALL SELECT a.u, b.v, a.s + b.s FROM d{k - 1} a JOIN d{k - 1} b ON a.v = b.u) GROUP BY ALL)" for k in range(1, 8)]
)


@query("r12_station_paths", "SELECT u, v, CAST(s AS BIGINT) AS seconds FROM d7 WHERE u <> v", WALKS)
def _(v):
    """All edges, to the fixpoint."""
    edges = v.street_edges.select("u", "v", F.col("metres").cast("long").alias("seconds"), F.col("metres").cast("long").alias("metres"))
    return transfers.station_paths(edges).groupBy("u", "v").agg(F.min("seconds").alias("seconds")).where("u <> v")


# ---- analysis ----------------------------------------------------------------------------------------

TIMES = """times AS (SELECT from_stop_id AS origin_id, to_stop_id AS stop_id, min(arrival - departure) / 60 AS minutes FROM fx_connections GROUP BY ALL)"""


def _times(v):
    return v.connections.groupBy(F.col("from_stop_id").alias("origin_id"), F.col("to_stop_id").alias("stop_id")).agg((F.min(F.col("arrival") - F.col("departure")) / 60).alias("minutes"))


@query("a14_accessibility", "SELECT origin_id, CAST(k AS INTEGER) AS cutoff, CAST(sum(count * CASE WHEN minutes < k THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM times JOIN fx_opportunities USING (stop_id), (VALUES (30), (60), (120)) c(k) GROUP BY ALL", TIMES)
def _(v):
    return analysis.accessibility(_times(v), v.opportunities, [30, 60, 120])


@query("a14_logistic_access", "SELECT origin_id, CAST(60 AS INTEGER) AS cutoff, round(sum(count / (1 + exp((minutes - 60) / 10.0))), 4) AS score FROM times JOIN fx_opportunities USING (stop_id) GROUP BY ALL", TIMES)
def _(v):
    return analysis.accessibility(_times(v), v.opportunities, [60], "logistic", 10.0)


@query("a15_dual_access", "SELECT origin_id, min(minutes) AS minutes FROM (SELECT *, sum(count) OVER (PARTITION BY origin_id ORDER BY minutes) AS t FROM times JOIN fx_opportunities USING (stop_id)) WHERE t >= 100 GROUP BY origin_id", TIMES)
def _(v):
    return analysis.dual_access(_times(v), v.opportunities, 100)


SAMPLES = "samples AS (SELECT stop_id AS cell, CASE WHEN event_id % 5 <> 0 THEN sec % 3600 END AS seconds FROM fx_calls)"


def _samples(v):
    return v.calls.select(F.col("stop_id").alias("cell"), F.when(F.col("event_id") % 5 != 0, F.col("sec") % 3600).alias("seconds"))


@query(
    "a12_percentiles",
    """SELECT cell, percentile, seconds, reachable FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY seconds NULLS LAST) AS rn, count(*) OVER (PARTITION BY cell) AS n, count(seconds) OVER (PARTITION BY cell) AS reachable FROM samples), (VALUES (5), (50), (95)) p(percentile) WHERE rn = greatest(1, (percentile * n + 99) // 100)""",
    SAMPLES,
)
def _(v):
    return analysis.percentile_ranks(_samples(v), ["cell"], "seconds", [5, 50, 95])


@query("a13_all_day", "SELECT cell, count(*) AS samples, count(seconds) AS reachable, round(avg(seconds), 6) AS mean, count(*) FILTER (seconds <= 900) AS within_900, count(*) FILTER (seconds <= 1800) AS within_1800 FROM samples GROUP BY cell", SAMPLES)
def _(v):
    return analysis.all_day(_samples(v), ["cell"], "seconds", [900, 1800])


SIDES = """one AS (SELECT stop_id, min(sec) AS m FROM fx_calls WHERE event_type = 'click' GROUP BY stop_id), two AS (SELECT stop_id, min(sec) AS m FROM fx_calls WHERE event_type IN ('click', 'view') AND stop_id % 9 <> 0 GROUP BY stop_id)"""


def _sides(v):
    of = lambda rows: rows.groupBy("stop_id").agg(F.min("sec").alias("m"))
    return of(v.calls.where("event_type = 'click'")), of(v.calls.where("event_type IN ('click', 'view') AND stop_id % 9 <> 0"))


@query("j19_compare", "SELECT stop_id, one.m AS before, two.m AS after, two.m - one.m AS change FROM one FULL JOIN two USING (stop_id)", SIDES)
def _(v):
    return analysis.compare(*_sides(v), ["stop_id"], "m")


@query(
    "a16_comparison_counts",
    """SELECT count(b - a) AS comparable, count(*) FILTER (b < a) AS faster, count(*) FILTER (b > a) AS slower, count(*) FILTER (a = b) AS unchanged, count(*) FILTER (a IS NULL) AS newly_reached, count(*) FILTER (b IS NULL) AS lost, round(avg(b - a), 3) AS mean_change FROM (SELECT one.m AS a, two.m AS b FROM one FULL JOIN two USING (stop_id))""",
    SIDES,
)
def _(v):
    return analysis.comparison_counts(analysis.compare(*_sides(v), ["stop_id"], "m"))


BOUNDS, SIDE = (-77.055, 38.895, -76.955, 38.995), 5
SURFACE = """surface AS (SELECT CAST(greatest(0, least(4, floor((lon + 77.055) / 0.1 * 5))) AS INTEGER) AS x, CAST(greatest(0, least(4, floor((38.995 - lat) / 0.1 * 5))) AS INTEGER) AS y, CAST(min(stop_id * 37 % 101) AS INTEGER) AS seconds FROM fx_stops GROUP BY ALL)"""


def _surface(v):
    points = v.stops.withColumn("seconds", (F.col("stop_id") * 37 % 101).cast("int"))
    return analysis.raster(points, "seconds", BOUNDS_EXACT, SIDE, SIDE)


#: The width of the box in floating point is the SQL's 0.1.
BOUNDS_EXACT = (-77.055, 38.895, -77.055 + 0.1, 38.895 + 0.1)


@query("g5_raster", "SELECT * FROM surface", SURFACE.replace("0.1 *", "(-77.055::DOUBLE + 0.1::DOUBLE - -77.055::DOUBLE) *", 1).replace("(38.995 - lat) / 0.1", "((38.895::DOUBLE + 0.1::DOUBLE) - lat) / (38.895::DOUBLE + 0.1::DOUBLE - 38.895::DOUBLE)"))
def _(v):
    return _surface(v)


SURFACE = SURFACE.replace("0.1 *", "(-77.055::DOUBLE + 0.1::DOUBLE - -77.055::DOUBLE) *", 1).replace("(38.995 - lat) / 0.1", "((38.895::DOUBLE + 0.1::DOUBLE) - lat) / (38.895::DOUBLE + 0.1::DOUBLE - 38.895::DOUBLE)")


@query("g7_cell_centers", "SELECT CAST(k % 5 AS INTEGER) AS x, CAST(k // 5 AS INTEGER) AS y, round(38.995 - (k // 5 + 0.5) * 0.02, 6)::DOUBLE AS lat, round(-77.055 + (k % 5 + 0.5) * 0.02, 6)::DOUBLE AS lon FROM range(25) r(k)")
def _(v):
    return analysis.grid(v.spark, BOUNDS, SIDE, SIDE).select("x", "y", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(
    "g8_area_edges",
    """SELECT x + a AS x1, y + b AS y1, x + c AS x2, y + d AS y2 FROM (SELECT * FROM surface WHERE seconds <= 12) s, (VALUES (0, -1, 1, 0, 0, 0), (-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0)) k(dx, dy, a, b, c, d)
WHERE NOT EXISTS (SELECT 1 FROM surface n WHERE n.seconds <= 12 AND n.x = s.x + dx AND n.y = s.y + dy)""",
    SURFACE,
)
def _(v):
    return analysis.area_edges(_surface(v), "seconds", 12)


@query(
    "g8_rings",
    """SELECT w.start AS ring, string_agg(CAST(x1 AS VARCHAR) || ' ' || CAST(y1 AS VARCHAR), ',' ORDER BY n) AS points, sum(x1 * y2 - x2 * y1) > 0 AS hole FROM walk w JOIN edges e ON e.id = w.here WHERE w.start = (SELECT min(v.here) FROM walk v WHERE v.start = w.start) GROUP BY w.start""",
    SURFACE
    + """,
edges AS (SELECT *, (CAST(y1 AS BIGINT) * 100000 + x1) * 10 + (x2 - x1 + 1) * 3 + y2 - y1 + 1 AS id FROM (SELECT x + a AS x1, y + b AS y1, x + c AS x2, y + d AS y2 FROM (SELECT * FROM surface WHERE seconds <= 20) s, (VALUES (0, -1, 1, 0, 0, 0), (-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0)) k(dx, dy, a, b, c, d)
  WHERE NOT EXISTS (SELECT 1 FROM surface n WHERE n.seconds <= 20 AND n.x = s.x + dx AND n.y = s.y + dy))),
nexts AS (SELECT id, next FROM (SELECT a.id, b.id AS next, row_number() OVER (PARTITION BY a.id ORDER BY (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) AS k FROM edges a JOIN edges b ON b.x1 = a.x2 AND b.y1 = a.y2) WHERE k = 1),
walk AS (SELECT id AS start, id AS here, 0 AS n FROM edges UNION ALL SELECT start, next, n + 1 FROM walk JOIN nexts f ON f.id = here WHERE next <> start)""",
)
def _(v):
    found = analysis.rings(analysis.area_edges(_surface(v), "seconds", 20))
    return found.select("ring", F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",").alias("points"), "hole")


@query(
    "g9_contour_crossings",
    """SELECT a.x, a.y, round(a.x + (12.5 - a.seconds) / (b.seconds - a.seconds), 6) AS top FROM surface a JOIN surface b ON b.x = a.x + 1 AND b.y = a.y JOIN surface c ON c.x = a.x + 1 AND c.y = a.y + 1 JOIN surface d ON d.x = a.x AND d.y = a.y + 1 WHERE (a.seconds <= 12.5) <> (b.seconds <= 12.5)""",
    SURFACE,
)
def _(v):
    # The crossing of a square's upper side is the start of one of its segments.
    found = analysis.contour_segments(_surface(v), "seconds", 12.5)
    return found.where("y1 = y").select("x", "y", F.col("x1").alias("top")).distinct()


@query("ops17_point_sample", "SELECT p.stop_id, s.seconds FROM (SELECT stop_id, CAST(greatest(0, least(4, floor((lon + 77.055) / (-77.055::DOUBLE + 0.1::DOUBLE - -77.055::DOUBLE) * 5))) AS INTEGER) AS x, CAST(greatest(0, least(4, floor(((38.895::DOUBLE + 0.1::DOUBLE) - lat) / (38.895::DOUBLE + 0.1::DOUBLE - 38.895::DOUBLE) * 5))) AS INTEGER) AS y FROM fx_stops) p LEFT JOIN surface s USING (x, y)", SURFACE)
def _(v):
    return analysis.sample_at(_surface(v), v.stops, "seconds", BOUNDS_EXACT, SIDE, SIDE).select("stop_id", "seconds")


@query("x5_monte_carlo_departures", "")
def _(v):
    services = v.frequencies.select(F.col("route_id").alias("service_id"), F.col("headway_secs").alias("headway"))
    return analysis.sampled_departures(analysis.phases(services, 20, 7), 21600, 32400)
