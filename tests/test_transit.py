"""Small hand-made networks and properties."""

import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tramline.functions import clock, geo, measures
from tramline.operators import analysis, calendar, operations, routing, scenario, streets, timetable, transfers, validate

CONN = "departure long, arrival long, trip_id string, from_stop_id int, to_stop_id int, stop_sequence int, can_board boolean, can_alight boolean"
NO_WALKS = "from_stop_id int, to_stop_id int, seconds int"


def test_three_stop_line(spark):
    """A 08:00 -> X 08:10, X 08:15 -> B 08:30: leaving at 07:55 arrives at 08:30 with one change; the way back doesn't exist."""
    conns = spark.createDataFrame([(28800, 29400, "T1", 1, 2, 1, True, True), (29700, 30600, "T2", 2, 3, 1, True, True)], CONN)
    walks = spark.createDataFrame([], NO_WALKS)
    opt = routing.Options(same_stop=120, buffer=0)
    start = lambda s: spark.createDataFrame([(s, s, 28500)], "origin_id int, stop_id int, arrival long")
    found = {r.stop_id: (r.arrival, r.boardings, r.walking) for r in routing.earliest(routing.labels(conns, walks, start(1), opt), opt).collect()}
    assert found == {2: (29400, 1, 0), 3: (30600, 2, 0)}
    assert routing.earliest(routing.labels(conns, walks, start(3), opt), opt).count() == 0
    legs = routing.journey(conns, walks, 1, 3, 28500, opt).collect()
    assert [(x.mode, x.from_stop_id, x.to_stop_id, x.departure, x.arrival) for x in legs] == [("ride", 1, 2, 28800, 29400), ("ride", 2, 3, 29700, 30600)]


def brute_force(conns, walks, origin, at, opt):
    """Earliest arrivals by following whole trips from every label, round by round, in plain Python."""
    best, labels = {}, {(origin, "origin"): at}
    trips = {}
    for c in sorted(conns, key=lambda c: c[5]):
        trips.setdefault(c[2], []).append(c)
    for _ in range(opt.boardings):
        rides = {}
        for (stop, kind), t in labels.items():
            ready = t + {"ride": opt.same_stop + opt.buffer, "transfer": opt.buffer, "origin": 0}[kind]
            for calls in trips.values():
                for i, c in enumerate(calls):
                    if c[3] == stop and c[6] and c[0] >= ready:
                        for later in calls[i:]:
                            if later[7]:
                                rides[later[4]] = min(rides.get(later[4], 10**9), later[1])
        labels = {(s, "ride"): t for s, t in rides.items()}
        for a, b, seconds in walks:
            if a in rides:
                labels[b, "transfer"] = min(labels.get((b, "transfer"), 10**9), rides[a] + seconds)
        for (s, _), t in labels.items():
            best[s] = min(best.get(s, 10**9), t)
    return best


def test_search_equals_whole_trip_enumeration(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        conns = []
        for k in range(28):
            t = rng.randrange(28000, 40000)
            stops = rng.sample(range(10), rng.randrange(2, 6))
            for i, (a, b) in enumerate(itertools.pairwise(stops)):
                dep, arr = t, t + rng.randrange(60, 900)
                conns.append((dep, arr, f"T{k}", a, b, i + 1, rng.random() < 0.8, rng.random() < 0.8))
                t = arr + rng.randrange(0, 60)
        walks = [(a, b, rng.randrange(60, 600)) for a in range(10) for b in range(10) if a != b and rng.random() < 0.2]
        opt = routing.Options()
        found = routing.labels(spark.createDataFrame(conns, CONN), spark.createDataFrame(walks, NO_WALKS), spark.createDataFrame([(0, 0, 28000)], "origin_id int, stop_id int, arrival long"), opt)
        assert {r.stop_id: r.arrival for r in routing.earliest(found, opt).collect()} == brute_force(conns, walks, 0, 28000, opt)


def skyline_brute_force(conns, walks, origin, at, opt):
    """(stop, arrival, boardings, walking) that no other beats, by following whole trips from every label."""
    trips, labels, every = {}, {(origin, "origin", at, 0)}, set()
    for c in sorted(conns, key=lambda c: c[5]):
        trips.setdefault(c[2], []).append(c)
    for k in range(1, opt.boardings + 1):
        rides = set()
        for stop, kind, t, w in labels:
            ready = t + {"ride": opt.same_stop + opt.buffer, "transfer": opt.buffer, "origin": 0}[kind]
            for calls in trips.values():
                for i, c in enumerate(calls):
                    if c[3] == stop and c[6] and c[0] >= ready:
                        rides |= {(later[4], "ride", later[1], w) for later in calls[i:] if later[7]}
        labels = rides | {(b, "transfer", t + s, w + s) for stop, _, t, w in rides for a, b, s in walks if a == stop}
        every |= {(stop, t, k, w) for stop, _, t, w in labels}
    return {x for x in every if not any(y[0] == x[0] and y != x and all(p <= q for p, q in zip(y[1:], x[1:], strict=True)) for y in every)}


def small_network(rng, name=lambda stop: stop):
    conns = []
    for k in range(24):
        t = rng.randrange(28000, 36000)
        for i, (a, b) in enumerate(itertools.pairwise(rng.sample(range(8), rng.randrange(2, 6)))):
            dep, arr = t, t + rng.randrange(60, 900)
            conns.append((dep, arr, f"T{k}", name(a), name(b), i + 1, rng.random() < 0.8, rng.random() < 0.8))
            t = arr + rng.randrange(0, 60)
    return conns, [(name(a), name(b), rng.randrange(60, 900)) for a in range(8) for b in range(8) if a != b and rng.random() < 0.3]


def test_skylines_equal_whole_trip_enumeration(spark):
    for seed in (3, 4):
        conns, walks = small_network(random.Random(seed))
        opt = routing.Options(boardings=3)
        start = spark.createDataFrame([(0, 0, 28000)], "origin_id int, stop_id int, arrival long")
        found = routing.pareto(routing.labels(spark.createDataFrame(conns, CONN), spark.createDataFrame(walks, NO_WALKS), start, opt))
        assert {(r.stop_id, r.arrival, r.boardings, r.walking) for r in found.collect()} == skyline_brute_force(conns, walks, 0, 28000, opt)


def test_journeys_on_a_network_of_named_stops(spark):
    """Stop ids are text, as in real feeds: every leg exists, legs fit together, and the last one ends when the search says."""
    conns, walks = small_network(random.Random(5), lambda stop: f"a:{stop}")
    timetable_, table = spark.createDataFrame(conns, CONN.replace("stop_id int", "stop_id string")), spark.createDataFrame(walks, NO_WALKS.replace("stop_id int", "stop_id string"))
    opt = routing.Options(boardings=3)
    best = {r.stop_id: (r.arrival, r.boardings) for r in routing.windows(timetable_, table, "a:0", [28000], opt).collect()}
    start = spark.createDataFrame([("a:0", "a:0", 28000)], "origin_id string, stop_id string, arrival long")
    legs = {}
    for r in routing.journeys(timetable_, table, start, opt).orderBy("stop_id", "leg").collect():
        legs.setdefault(r.stop_id, []).append(r)
    assert {s: (x[-1].arrival, sum(y.mode == "ride" for y in x)) for s, x in legs.items()} == best
    for stop, own in legs.items():
        at, t, before = "a:0", 28000, "origin"
        for x in own:
            assert x.from_stop == at and x.departure >= t
            if x.mode == "walk":
                assert (at, x.to_stop, x.arrival - x.departure) in walks
            else:
                assert x.departure >= t + {"ride": 180, "walk": 60, "origin": 0}[before]
                board = [c for c in conns if c[2] == x.run and c[3] == at and c[0] == x.departure and c[6]]
                assert board and any(c[2] == x.run and c[4] == x.to_stop and c[1] == x.arrival and c[7] and c[5] >= board[0][5] for c in conns)
            at, t, before = x.to_stop, x.arrival, x.mode
        assert at == stop
    via = routing.through_via(timetable_, table, "a:0", "a:3", 28000, opt)
    assert all(r.arrival >= best["a:3"][0] for r in via.collect())
    asked = [r.asDict() for r in routing.journey(timetable_, table, "a:0", "a:3", 28000, opt).collect()]
    assert [x["from_stop_id"] for x in asked] == [x.from_stop for x in legs["a:3"]]


def test_a_matrix_has_a_bound(spark):
    many = spark.range(300).select(F.col("id").alias("origin_id"), F.col("id").alias("destination_id"), F.col("id").alias("stop_id"))
    with pytest.raises(ValueError, match="65536"):
        routing.matrix(None, None, many, many, 0)


BOARD = "trip_id string, route_id string, direction_id int, service_id string, stop_sequence int, stop_id int, arrival long, departure long"


def test_board_asks_the_calendar_and_the_reports(spark):
    """Monday's trip doesn't leave on Tuesday; yesterday's after midnight and tomorrow's do; reports cancel, skip, move and drop calls."""
    calls = spark.createDataFrame([(f"T{k}", f"R{k}", 0, s, 3, 7, t, t) for k, s, t in ((0, "MON", 40000), (1, "TUE", 40000), (2, "MON", 90000), (3, "WED", 1000), (4, "TUE", 41000), (5, "TUE", 42000), (6, "TUE", 39000), (7, "TUE", 43000), (8, "TUE", 44000), (9, "TUE", 30000))], BOARD)
    days = spark.createDataFrame([("MON", "2024-01-15"), ("TUE", "2024-01-16"), ("WED", "2024-01-17")], "service_id string, day string").withColumn("day", F.to_date("day"))
    updates = spark.createDataFrame([("a", "T4", "CANCELED", True, None, None), ("b", "T5", None, True, None, None), ("c", "T6", None, True, None, None), ("d", "T7", None, False, None, None), ("e", "T8", "DELETED", True, None, None), ("f", "T9", None, True, None, 3)], "update_id string, trip_id string, relationship string, fresh boolean, passed int, at_stop int")
    updates = updates.withColumn("day", F.to_date(F.lit("2024-01-16")))
    told = spark.createDataFrame([("b", 3, True, None, None), ("c", 3, False, 41500, 41600)], "update_id string, stop_sequence int, skipped boolean, arrival long, departure long")
    board = lambda now, until, **more: [(r.trip_id, str(r.day)[-2:], r.expected, r.status) for r in operations.stop_board(calls, days, 7, "2024-01-16", now, until, updates, told, **more).collect()]
    assert board(39500, 90000) == [("T9", "16", 30000, "scheduled"), ("T1", "16", 40000, "scheduled"), ("T4", "16", 41000, "cancelled"), ("T6", "16", 41500, "live"), ("T5", "16", 42000, "skipped"), ("T7", "16", 43000, "stale"), ("T3", "17", 87400, "scheduled")]
    assert board(0, 5000) == [("T9", "16", 30000, "scheduled")][:0] + [("T2", "15", 3600, "scheduled")]
    assert [x[0] for x in board(39500, 90000, next_per_route=True)] == ["T9", "T1", "T6", "T7", "T3"]


DEPARTURES = "route_id string, direction_id int, stop_id int, day string, trip_id string, scheduled long, predicted long, passed boolean"


def test_headways_ask_that_all_between_report(spark):
    rows = lambda *x: spark.createDataFrame([("R", 0, 7, "d", f"T{k}", s, p, g) for k, (s, p, g) in enumerate(x)], DEPARTURES)
    pairs = lambda *x: [(r.before, r.trip_id, r.planned, r.actual, r.reversed, r.kind, r.severity) for r in operations.headways(rows(*x)).orderBy("before").collect()]
    assert pairs((0, 0, False), (600, 660, False), (1200, 1200, False)) == [("T0", "T1", 600, 660, False, "gap", "info"), ("T1", "T2", 600, 540, False, "bunching", "info")]
    assert pairs((0, 0, False), (600, None, False), (1200, 1300, False)) == []
    assert pairs((0, 900, False), (600, 800, False)) == [("T0", "T1", 600, 100, True, "bunching", "critical")]
    assert pairs((0, 1900, False), (600, 700, False)) == []
    found = lambda *x: [(r.before, r.trip_id, r.planned, r.actual, r.severity) for r in operations.reordered_bunching(rows(*x)).collect()]
    late = ((0, 1500, False), (600, 620, False), (1200, 1530, False))
    assert found(*late) == [("T0", "T2", 600, 30, "critical")]
    assert found(late[0], (600, None, True), late[2]) == [("T0", "T2", 600, 30, "critical")] and found(late[0], (600, None, False), late[2]) == []


def test_removing_service_never_helps(spark):
    conns = [(i * 100, i * 100 + 50 + i % 7, f"T{i}", i % 5, (i * 3 + 1) % 5, 1, True, True) for i in range(40) if i % 5 != (i * 3 + 1) % 5]
    start = spark.createDataFrame([(0, 0, 0)], "origin_id int, stop_id int, arrival long")
    walks = spark.createDataFrame([], NO_WALKS)
    times = lambda rows: {r.stop_id: r.arrival for r in routing.earliest(routing.labels(spark.createDataFrame(rows, CONN), walks, start)).collect()}
    full, less = times(conns), times([c for c in conns if c[2] not in ("T3", "T7", "T11")])
    assert all(full[s] <= t for s, t in less.items())


def test_clocks_and_dates(spark):
    rows = spark.createDataFrame([("25:10:00",), ("7:05:09",), ("1:60:00",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(clock.parse_clock(F.col("t"))).collect()] == [90600, 25509, None, None, None]
    days = spark.createDataFrame([("20240229",), ("20230229",), ("2024-1-1",), (None,)], "t string")
    assert [r[0] for r in days.select(clock.parse_date(F.col("t"))).collect()] == [20240229, None, None, None]
    asked = spark.createDataFrame([("71:59",), ("72:00",), ("08:15:30",)], "t string")
    assert [r[0] for r in asked.select(clock.parse_request_clock(F.col("t"))).collect()] == [71 * 3600 + 3540, None, 29730]


def test_epoch_on_a_day_with_a_clock_change(spark):
    row = spark.createDataFrame([("2026-03-08",)], "d string").select(F.date_format(clock.service_epoch(F.to_date("d"), "America/New_York"), "yyyy-MM-dd HH:mm")).first()
    assert row[0] == "2026-03-08 04:00"


def test_untimed_calls_are_bridged(spark):
    calls = spark.createDataFrame(
        [("T", 1, 1, 100, 100, True, True), ("T", 2, 2, None, None, True, True), ("T", 3, 3, 200, None, True, False)],
        "trip_id string, stop_sequence int, stop_id int, arrival long, departure long, can_board boolean, can_alight boolean",
    )
    trips = spark.createDataFrame([("T", "R", "S", 0)], "trip_id string, route_id string, service_id string, direction_id int")
    assert [(r.departure, r.arrival, r.from_stop_id, r.to_stop_id, r.can_alight) for r in timetable.connections(calls, trips).collect()] == [(100, 200, 1, 3, False)]


def test_holiday_runs_sunday_service(spark):
    cal = spark.createDataFrame([("W", 1, 1, 1, 1, 1, 0, 0, 20240101, 20240131), ("S", 0, 0, 0, 0, 0, 0, 1, 20240101, 20240131)], "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date int, end_date int")
    exc = spark.createDataFrame([("W", 20240115, 2), ("S", 20240115, 1)], "service_id string, date int, exception_type int")
    assert [r[0] for r in calendar.active_on(cal, exc, 20240115).collect()] == ["S"]
    assert [r[0] for r in calendar.active_on(cal, exc, 20240116).collect()] == ["W"]


def test_nearest_rank_puts_unreachable_last(spark):
    rows = spark.createDataFrame([(1, 10), (1, None), (1, 30), (1, 20)], "cell int, seconds int")
    found = {r.percentile: (r.seconds, r.reachable) for r in analysis.percentile_ranks(rows, ["cell"], "seconds", [0, 50, 75, 100]).collect()}
    assert found == {0: (10, 3), 50: (20, 3), 75: (30, 3), 100: (None, 3)}


def test_step_decay_is_strict_and_linear_ends_at_the_cutoff(spark):
    rows = spark.createDataFrame([(30.0,), (29.9,), (None,)], "m double")
    assert [r[0] for r in rows.select(measures.decay_weight("step", F.col("m"), F.lit(30))).collect()] == [0.0, 1.0, 0.0]


def test_ring_area_and_containment(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]])
    row = spark.range(1).select(geo.ring_area(ring), geo.ring_contains(ring, F.lit(1.0), F.lit(1.0)), geo.ring_contains(ring, F.lit(3.0), F.lit(1.0))).first()
    assert tuple(row) == (4.0, True, False)


def test_near_stops_is_symmetric_at_high_latitudes(spark):
    stops = spark.createDataFrame([(1, 69.65, 18.95), (2, 69.65, 18.98), (3, 69.70, 18.95)], "stop_id int, lat double, lon double")
    assert {(r.from_stop_id, r.to_stop_id) for r in transfers.near_stops(stops, 1.5).collect()} == {(1, 2), (2, 1)}


def test_hierarchy_problems(spark):
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 9), (4, 5), (5, 4)], "stop_id int, parent_id int")
    assert {tuple(r) for r in transfers.hierarchy_problems(parents).collect()} == {(3, "missing_parent"), (4, "cycle"), (5, "cycle")}


def test_delay_is_carried_and_reset(spark):
    calls = spark.createDataFrame([("T", 1, None, False), ("T", 2, 60, False), ("T", 3, None, False), ("T", 4, None, True), ("T", 5, None, False)], "trip_id string, stop_sequence int, delay int, no_data boolean")
    assert [r.predicted_delay for r in operations.propagate_delays(calls).orderBy("stop_sequence").collect()] == [None, 60, 60, None, None]


def test_alert_period_ends(spark):
    selectors = spark.createDataFrame([(1, "R", None, None, None, 100)], "alert_id int, route_id string, stop_id int, direction_id int, start int, end int")
    calls = spark.createDataFrame([(7, "R", 1, 0)], "call_id int, route_id string, stop_id int, direction_id int")
    assert operations.matching_alerts(selectors, calls, 100, True).count() == 1
    assert operations.matching_alerts(selectors, calls, 100, False).count() == 0


def test_monotone_alignment(spark):
    cost = [("s", i, j, float(abs(2 * i - j))) for i in range(3) for j in range(6)]
    found = streets.monotone_alignment(spark.createDataFrame(cost, "shape_id string, stop_no int, point_no int, cost double"))
    assert [r.point_no for r in found.orderBy("stop_no").collect()] == [0, 2, 4]


def test_traffic_never_speeds_up(spark):
    edges = spark.createDataFrame([(1, 2, 100, 10), (2, 3, 100, 10), (3, 4, 100, 10)], "u int, v int, metres int, seconds long")
    updates = spark.createDataFrame([(1, 2, 0.5, None, False), (1, 2, 2.0, None, False), (2, 3, None, 9.0, False), (3, 4, None, None, True)], "u int, v int, factor double, kmh double, closed boolean")
    assert {(r.u, r.seconds) for r in streets.apply_traffic(edges, updates).collect()} == {(1, 20), (2, 40)}


def test_missing_fare_is_not_free(spark):
    legs = spark.createDataFrame([(1, "N", 1, 2), (2, None, 1, 2)], "leg_id int, network string, from_area int, to_area int")
    rules = spark.createDataFrame([(1, "N", 1, None, 1, 100), (2, "N", None, 2, 2, 150)], "rule_id int, network string, from_area int, to_area int, priority int, amount int")
    assert {(r.leg_id, r.amount) for r in scenario.best_fare(legs, rules).collect()} == {(1, 150), (2, None)}


def test_paths_of_many_edges_are_found(spark):
    n = 66
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(n)] + [(0, n, 500)], "u int, v int, cost int")
    seeds = spark.createDataFrame([(0, 0, 0)], "source int, node int, cost long")
    assert {r.node: r.cost for r in streets.shortest_paths(edges, seeds, 5000).collect()} == {i: i for i in range(n + 1)}


def test_walks_of_many_edges_are_found(spark):
    n = 19
    rows = [(i, i + 1, 1, 3) for i in range(n)] + [(0, n, 50, 4), (0, n, 60, 5)]
    found = transfers.station_paths(spark.createDataFrame(rows, "u int, v int, seconds long, metres long")).collect()
    own = {(i, j, j - i, 3 * (j - i)) for i in range(n) for j in range(i + 1, n + 1)}
    assert sorted(tuple(r) for r in found) == sorted(own | {(0, n, 50, 4)})


def test_sampled_phases_are_the_hashes_and_links_shift_them(spark):
    services = spark.createDataFrame([("A", 600), ("B", 900), ("C", 900)], "service_id string, headway int")
    drawn = analysis.phases(services, 5, 7)
    phase = {(r.service_id, r.sample): r.phase for r in drawn.collect()}
    assert phase == {(s, k): zlib.crc32(f"7:{k}:{s}".encode()) % h for s, h in (("A", 600), ("B", 900), ("C", 900)) for k in range(5)}
    links = spark.createDataFrame([("B", "A", 1000)], "service_id string, parent_id string, offset int")
    tied = {(r.service_id, r.sample): r.phase for r in analysis.coordinated(drawn, links).collect()}
    assert tied == phase | {("B", k): (phase["A", k] + 1000) % 900 for k in range(5)}
    found = sorted((r.service_id, r.sample, r.departure) for r in analysis.sampled_departures(drawn, 3600, 7200).collect())
    assert found == sorted((s, k, t) for (s, k), p in phase.items() for t in range(3600 + p, 7200, 600 if s == "A" else 900))


def broadcast_parts(found):
    """What stands below each broadcast in the plan of a DataFrame."""
    parts, lines = [], found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            parts.append("\n".join(itertools.takewhile(lambda x, d=depth(line): depth(x) > d, lines[k + 1 :])))
    return parts


def test_search_broadcasts_the_asked_words_not_the_index(spark, tmp_path):
    spark.createDataFrame([(k, f"Main Street {k}") for k in range(50)], "address_id int, name string").write.parquet(str(tmp_path / "a"))
    asked = spark.createDataFrame([(1, "main 4"), (1, "42")], "query_id int, query string")
    found = operations.address_search(spark.read.parquet(str(tmp_path / "a")), asked, 2)
    parts = broadcast_parts(found)
    assert parts and not any("FileScan" in x for x in parts)
    assert [(r.address_id, r.score) for r in found.orderBy("rank").collect()] == [(42, 4), (0, 2)]
    words = spark.read.parquet(str(tmp_path / "a")).select(F.lower("name").alias("word"))
    near = operations.near_words(words, spark.createDataFrame([("main street 4x",)], "word string"))
    assert not any("FileScan" in x for x in broadcast_parts(near))
    assert [r.word for r in near.orderBy("rank").collect()] == ["main street 4", "main street 40", "main street 41"]


def test_the_next_departure_is_carried_in_linear_time(spark):
    """No frame ends with its partition, as Spark computes that one anew for every row; and many asks at one time are one row."""
    conns = spark.createDataFrame([(t, t + 60, f"T{t}", 1, 2, 1, t != 700, True) for t in (300, 700, 900)] + [(500, 560, "T", 2, 1, 1, True, True)], CONN)
    asks = spark.createDataFrame([(1, 1, 300), (2, 1, 301), (3, 1, 301), (4, 1, 901), (5, 2, 0), (6, 3, 0), (7, None, 0)], "ask_id int, stop_id int, ready long")
    found = routing.earliest_boardable(conns, asks)
    assert sorted((r.ask_id, r.departure) for r in found.collect()) == [(1, 300), (2, 900), (3, 900), (4, None), (5, 500), (6, None), (7, None)]
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString()


def test_calls_of_a_trip_predicted_at_one_time_keep_their_scheduled_order(spark):
    kind = "route_id string, direction_id int, stop_id int, day string, trip_id string, scheduled long, predicted long, passed boolean"
    calls = [("Z", 0, 300), ("X", 100, 500), ("X", 1700, 500)]
    for order in itertools.permutations(calls):
        rows = spark.createDataFrame([("R", 0, 1, "d", *x, False) for x in order], kind).coalesce(1)
        assert sorted((r.before, r.trip_id, r.planned, r.actual) for r in operations.headways(rows).collect()) == [("X", "X", 1600, 0), ("Z", "X", 100, 200)]
    # The sort before keeps them in that order by chance; the window has to ask for it.
    assert re.search(r"predicted#\d+L ASC NULLS FIRST, trip_id#\d+ ASC NULLS FIRST, scheduled#\d+L", operations.headways(rows)._jdf.queryExecution().executedPlan().toString())


def test_reordered_bunching_meets_a_stretch_not_the_whole_day(spark):
    """Against all pairs with all between, in plain Python; calls at one time, dense and sparse hours, and gone calls among them."""
    rng, rows = random.Random(5), []
    for stop in range(6):
        t = 0
        for k in range(120):
            t += rng.choice((200, 400, 700, 900)) if stop < 4 or rng.random() < 0.5 else rng.choice((0, 20, 179, 180))
            rows.append(("R", 0, stop, "d", f"T{k % 90}", t, t + 7 * rng.randrange(400) if rng.random() < 0.8 else None, rng.random() < 0.7))
    expected = set()
    for stop in range(6):
        here = [r for r in rows if r[2] == stop]
        told = sorted((r for r in here if r[6] is not None), key=lambda r: (r[6], r[4], r[5]))
        for a, b in itertools.pairwise(told):
            x, y = sorted((a, b), key=lambda r: (r[5], r[4]))
            met = sorted((r for r in here if x[5] <= r[5] <= y[5]), key=lambda r: r[5])
            if x[5] == y[5] or len(met) < 3 or not all(r[4] in (x[4], y[4]) or r[6] is not None or r[7] for r in met):
                continue
            planned, actual = min(q[5] - p[5] for p, q in itertools.pairwise(met)), b[6] - a[6]
            if planned - actual >= 180 and 2 * actual <= planned:
                expected.add((stop, x[4], y[4], planned, actual))
    found = operations.reordered_bunching(spark.createDataFrame(rows, "route_id string, direction_id int, stop_id int, day string, trip_id string, scheduled long, predicted long, passed boolean"))
    assert expected and {(r.stop_id, r.before, r.trip_id, r.planned, r.actual) for r in found.collect()} == expected
    joins = re.findall(r"\w+Join \[[^\]]*\]", found._jdf.queryExecution().executedPlan().toString())
    assert joins and all("stretch" in x for x in joins)


def test_overlaps_are_met_once(spark):
    """The pairs, which may be many, aren't made distinct again; odd and equal windows, and long ones, against all pairs in plain Python."""
    rng = random.Random(3)
    rows = [(f"R{rng.randrange(2)}", s, s + rng.choice((-5000, 0, 1, 900, 9000))) for s in (rng.randrange(0, 20000, 50) for _ in range(200))]
    found = validate.overlapping_windows(spark.createDataFrame([*rows, *rows[:20], ("R0", None, 5)], "trip_id string, start_time long, end_time long"))
    pairs = [tuple(r) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] < a[2]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "start_b" not in "".join(re.findall(r"Exchange hashpartitioning\(trip_id[^)]*\)", plan)) and "start_b" not in "".join(re.findall(r"keys=\[[^\]]*\]", plan))


def test_no_fare_rule_gathers_all_legs(spark):
    """Rules of any network fit all legs: few rules go to the legs, so none of the joins deals legs by it."""
    legs = spark.createDataFrame([(k // 2, None if k == 3 else f"R{k % 3}", k % 2, 1) for k in range(12)], "leg_id int, network string, from_area int, to_area int")
    rules = [(1, "R1", None, None, 2, 90), (2, None, 1, None, 2, 80), (3, None, 0, 1, 2, 80), (4, None, None, 7, 9, 1)]
    found = scenario.best_fare(legs, spark.createDataFrame(rules, "rule_id int, network string, from_area int, to_area int, priority int, amount int"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((k // 2, 2, 80) for k in range(12))
    zones = legs.select("leg_id", F.col("network").alias("route_id"), F.col("from_area").cast("string").alias("from_zone"), F.col("to_area").cast("string").alias("to_zone"))
    fares = scenario.fares_v1(zones, spark.createDataFrame([("flat", 300)], "fare_id string, price int"), spark.createDataFrame([], "fare_id string, route_id string, origin_id string, destination_id string, contains_id string"))
    assert {tuple(r)[1:] for r in fares.collect()} == {("flat", 300, 1, True)}
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (found, fares)):
        assert not re.search(r"SortMergeJoin \[(key|fare_id)#\d+\], \[\w+#\d+\], Inner", plan)


def test_without_a_skyline_only_the_least_ride_of_a_stop_walks_on(spark):
    conns = spark.createDataFrame([(100 + k, 200 + k // 2, f"T{k}", 1, 2, 1, True, True) for k in range(20)], CONN)
    walks = spark.createDataFrame([(2, 3, 50), (2, 4, 60)], NO_WALKS)
    opt = routing.Options(boardings=1, skyline=False)
    start = routing.seeds(spark.createDataFrame([(1, 1, 103, 30), (1, 1, 101, 40)], "origin_id int, stop_id int, arrival long, walking long"))
    rides = routing.ride_round(routing.Network.of(conns, walks, opt), start, opt)
    assert [(r.stop_id, r.arrival, r.walking) for r in rides.collect()] == [(2, 200, 40)]
    found = routing.labels(conns, walks, spark.createDataFrame([(1, 1, 103, 30), (1, 1, 101, 40)], "origin_id int, stop_id int, arrival long, walking long"), opt)
    assert sorted((r.stop_id, r.kind, r.arrival, r.walking) for r in found.collect()) == [(2, "ride", 200, 40), (3, "transfer", 250, 90), (4, "transfer", 260, 100)]
