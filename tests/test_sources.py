"""Archives, sinks and streams on small inputs."""

import json
import struct
import zipfile

from pyspark.sql import functions as F

from tramline.operators import calendar, timetable
from tramline.sources import gtfs, realtime, sinks
from tramline.streaming import live

FEED = {
    "stops.txt": "﻿stop_id,stop_name,stop_lat,stop_lon\nA,\"Alpha, main\",38.900,-77.050\nX,Transfer,,\nB,Bravo,38.910,-77.030\n,nameless,1,1\n",
    "routes.txt": "route_id,route_short_name,route_type\nR1,One,3\nR2,Two,\n",
    "trips.txt": "route_id,service_id,trip_id,direction_id\nR1,WKD,T1,0\nR2,WKD,T2,0\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type\nT1,08:00:00,08:00:00,A,1,\nT1,08:10:00,08:10:00,X,2,1\nT2,08:15:00,08:15:00,X,1,\nT2,25:30:00,25:30:00,B,2,\nT2,8:99:00,,B,3,7\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWKD,1,1,1,1,1,0,0,20260101,20261231\n",
    "transfers.txt": "from_stop_id,to_stop_id,transfer_type,min_transfer_time,from_trip_id\nA,B,2,100,\nA,B,2,200,\nB,A,1,,\nA,X,4,,T1\n",
    "pathways.txt": "from_stop_id,to_stop_id,pathway_mode,is_bidirectional,traversal_time\nA,X,1,1,30\nA,X,1,0,20\n",
}


def test_archive_to_connections(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as out:
        for name, text in FEED.items():
            out.writestr(name, text)
    raw = lambda t: gtfs.read_raw(spark, str(tmp_path / "*.zip"), t)
    stops = {r.stop_id: (r.stop_name, r.lat) for r in gtfs.stops(raw("stops")).collect()}
    assert stops == {"A": ("Alpha, main", 38.9), "X": ("Transfer", None), "B": ("Bravo", 38.91)}
    assert {r.route_id: r.route_type for r in gtfs.routes(raw("routes")).collect()} == {"R1": 3, "R2": 3}
    found = timetable.connections(gtfs.stop_times(raw("stop_times")).where("stop_sequence < 3"), gtfs.trips(raw("trips")).select("trip_id", "route_id", "service_id", "direction_id"))
    assert sorted((r.trip_id, r.departure, r.arrival, r.can_board) for r in found.collect()) == [("T1", 28800, 29400, True), ("T2", 29700, 91800, True)]
    assert sorted((r.line, r.problem) for r in gtfs.problems(raw("stop_times"), "stop_times").collect()) == [(5, "arrival_time"), (5, "pickup_type")]
    assert gtfs.problems(raw("stops"), "stops").count() == 1
    split = gtfs.split_transfers(raw("transfers"))
    assert [(r.from_stop_id, r.to_stop_id, r.seconds) for r in split["transfers"].collect()] == [("A", "B", 200)]
    assert split["links"].count() == 1 and split["rules"].count() == 4
    assert {(r.from_stop_id, r.to_stop_id, r.seconds) for r in gtfs.pathway_edges(raw("pathways")).collect()} == {("A", "X", 20), ("X", "A", 30)}
    none = spark.createDataFrame([], "service_id string, date int, exception_type int")
    assert calendar.active_on(gtfs.calendar(raw("calendar")), none, 20260715).count() == 1
    assert calendar.active_on(gtfs.calendar(raw("calendar")), none, 20260719).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2]), (2, None)], "id int, legs array<int>")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert {r.id: r.legs for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"1": "[1,2]", "2": None}
    feature = json.loads(spark.range(1).select(sinks.point_feature(F.lit(1.5), F.lit(2.5), F.struct(F.lit(7).alias("n")))).first()[0])
    assert feature["geometry"]["coordinates"] == [1.5, 2.5] and feature["properties"] == {"n": 7}
    assert sinks.fingerprint({"a": 1, "output": "csv"}) == sinks.fingerprint({"output": "json", "a": 1}) != sinks.fingerprint({"a": 2})


def test_rolling_history_keeps_half_an_hour(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("T", 1000, 10), ("T", 1000, 10), ("T", 2500, 20), ("T", 4000, 30), ("U", 5, 1)], "trip_id string, ts long, delay int").write.json(str(source))
    stream = live.rolling_history(spark.readStream.schema("trip_id string, ts long, delay int").json(str(source)))
    query = stream.writeStream.format("memory").queryName("history").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.trip_id, r.points, r.first_ts, r.last_delay) for r in spark.table("history").collect()} == {("T", 2, 2500, 30), ("U", 1, 5, 1)}


def test_records_are_rejected_with_a_reason(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2023-12-31 23:50:00"), ("c", "2024-01-01 00:05:00"), ("d", None)], "id string, t string").select(
        "id", F.to_timestamp("t").alias("event_ts"), F.lit("2024-01-01 00:00:30").cast("timestamp").alias("received")
    )
    good, bad = live.accepted(rows)
    assert [r.id for r in good.collect()] == ["a"] and {r.id: r.reason for r in bad.collect()} == {"b": "stale", "c": "future", "d": "no_timestamp"}


def test_unchanged_snapshots_are_not_published(spark):
    written = []
    publish = live.publish_generations(lambda rows, n: written.append(n))
    for n, rows in enumerate(([(1,)], [(1,)], [(2,)])):
        publish(spark.createDataFrame(rows, "x int"), n)
    assert written == [0, 2]


def test_archives_unpacked_once_give_the_same_rows(spark, tmp_path):
    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as out:
            for table, text in FEED.items():
                out.writestr(table, text)
    gtfs.unpack(spark, str(tmp_path / "*.zip"), str(tmp_path / "tables"))
    for table in ("stops", "routes", "stop_times", "calendar"):
        rows = lambda d: sorted(map(repr, d.collect()))
        assert rows(gtfs.read_unpacked(spark, str(tmp_path / "tables"), table)) == rows(gtfs.read_raw(spark, str(tmp_path / "*.zip"), table))


def test_a_restarted_stream_does_not_publish_the_same_again(spark, tmp_path):
    at, source = str(tmp_path / "out"), tmp_path / "in"
    source.mkdir()

    def run(number, rows):
        (source / f"{number}.json").write_text("\n".join(json.dumps({"trip_id": t, "delay": d}) for t, d in rows))
        stream = spark.readStream.schema("trip_id string, delay int").option("maxFilesPerTrigger", 1).json(str(source))
        query = stream.writeStream.foreachBatch(live.publish_to(at)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    run(1, [("A", 1), ("B", 2)])
    run(2, [("B", 2), ("A", 1)])
    assert sinks.generations(spark, at).count() == 1
    run(3, [("A", 5)])
    assert [r.generation for r in sinks.generations(spark, at).orderBy("generation").collect()] == [1, 2]
    assert [tuple(r) for r in sinks.current(spark, at).collect()] == [("A", 5)]


# ---- GTFS-Realtime ------------------------------------------------------------------------------------


def varint(n):
    n, out = n & (2**64 - 1), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def written(kind, value):
    """A message as bytes, by the same numbers; fields in reverse order, and one unknown field of each wire type."""
    out = varint(1000 << 3) + varint(5) + varint(1001 << 3 | 2) + varint(3) + b"abc" + varint(1002 << 3 | 5) + b"1234" + varint(1003 << 3 | 1) + b"12345678"
    for number, (name, of, many) in reversed(realtime.MESSAGES[kind].items()):
        for x in (value.get(name) or []) if many else [value[name]] if value.get(name) is not None else []:
            if of in ("int", "signed"):
                out += varint(number << 3) + varint(x)
            elif of == "float":
                out += varint(number << 3 | 5) + struct.pack("<f", x)
            else:
                body = x.encode() if of == "text" else written(of, x)
                out += varint(number << 3 | 2) + varint(len(body)) + body
    return out


def feed(entities, **header):
    head = written("FeedHeader", {"version": "2.0", "timestamp": 1_700_000_000, **header})
    out = varint(1 << 3 | 2) + varint(len(head)) + head
    for e in entities:
        body = written("FeedEntity", e)
        out += varint(2 << 3 | 2) + varint(len(body)) + body
    return out


def test_realtime_feeds_are_read_whole_and_broken_ones_are_listed(spark, tmp_path):
    update = {"trip": {"trip_id": "T1", "start_date": "20240115", "schedule_relationship": 0}, "stop_time_update": [{"stop_sequence": 3, "arrival": {"delay": -45}}, {"stop_id": "é", "departure": {"time": 1_700_000_100}, "schedule_relationship": 1}], "vehicle": {"id": "V"}, "delay": 30}
    vehicle = {"trip": {"trip_id": "T2", "schedule_relationship": 3}, "position": {"latitude": 38.5, "longitude": -77.25}, "current_stop_sequence": 4, "vehicle": {"id": "V2", "label": "Bus 2"}}
    alert = {"active_period": [{"start": 5}, {"start": 9, "end": 12}], "informed_entity": [{"route_id": "R", "route_type": 3}, {"stop_id": "S", "trip": {"trip_id": "T1"}}], "effect": 2, "header_text": {"translation": [{"text": "Closed", "language": "en"}]}}
    good = feed([{"id": "a", "trip_update": update}, {"id": "b", "vehicle": vehicle}, {"id": "c", "alert": alert}, {"id": "d"}])
    files = {"good": good, "cut": good[:-3], "differential": feed([], incrementality=1), "deleted": feed([{"id": "x", "is_deleted": 1}]), "empty": b"", "none": feed([])}
    for name, data in files.items():
        (tmp_path / f"{name}.pb").write_bytes(data)
    feeds = realtime.read_feeds(spark, str(tmp_path)).cache()
    assert {r.feed.rsplit("/", 1)[1] for r in realtime.rejected(feeds).collect()} == {"cut.pb", "differential.pb", "deleted.pb"}
    assert feeds.where("error IS NULL").count() == 4
    u = realtime.trip_updates(feeds).first()
    assert (u.trip_id, u.relationship, u.vehicle_id, u.delay, u.feed_timestamp, u.timestamp, len(u.calls)) == ("T1", "SCHEDULED", "V", 30, 1_700_000_000, None, 2)
    calls = [(r.stop_sequence, r.stop_id, r.arrival_delay, r.departure_time, r.relationship) for r in realtime.call_updates(feeds).orderBy("place").collect()]
    assert calls == [(3, None, -45, None, "SCHEDULED"), (None, "é", None, 1_700_000_100, "SKIPPED")]
    v = realtime.vehicles(feeds).first()
    assert (v.trip_id, v.relationship, v.lat, v.lon, v.stop_sequence, v.status, v.vehicle_label) == ("T2", "CANCELED", 38.5, -77.25, 4, "IN_TRANSIT_TO", "Bus 2")
    rows = {(r.route_id, r.route_type, r.stop_id, r.trip_id, r.start, r.end, r.header) for r in realtime.alerts(feeds).collect()}
    assert rows == {(*s, *t, "Closed") for s in (("R", 3, None, None), (None, None, "S", "T1")) for t in ((5, None), (9, 12))}
