"""GTFS-Realtime feeds as DataFrames: messages are read from the wire by the published field numbers.

A file is one snapshot (FeedMessage), read by Spark; a worker turns it into a row for each entity, and tables of
trip updates, calls, vehicles and alerts are columns of those rows. A file that can't be read, isn't a full
data set or deletes entities gives one row with an error and no entity: `rejected` lists these, the tables leave
them out, so that one broken feed doesn't stop the others. A file without a byte gives no row: Spark leaves it out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

MAX_ENTITIES = 500_000

#: Of every message of the published schema the fields that are read, by number: name, kind, and whether it repeats.
#: A kind is text, int, signed, float, or another message.
MESSAGES: dict[str, dict[int, tuple[str, str, bool]]] = {
    "FeedHeader": {1: ("version", "text", False), 2: ("incrementality", "int", False), 3: ("timestamp", "int", False)},
    "FeedEntity": {1: ("id", "text", False), 2: ("is_deleted", "int", False), 3: ("trip_update", "TripUpdate", False), 4: ("vehicle", "VehiclePosition", False), 5: ("alert", "Alert", False)},
    "TripUpdate": {
        1: ("trip", "TripDescriptor", False), 2: ("stop_time_update", "StopTimeUpdate", True), 3: ("vehicle", "VehicleDescriptor", False), 4: ("timestamp", "int", False), 5: ("delay", "signed", False),
    },
    "StopTimeUpdate": {
        1: ("stop_sequence", "int", False), 2: ("arrival", "StopTimeEvent", False), 3: ("departure", "StopTimeEvent", False), 4: ("stop_id", "text", False), 5: ("schedule_relationship", "int", False),
    },
    "StopTimeEvent": {1: ("delay", "signed", False), 2: ("time", "signed", False), 3: ("uncertainty", "signed", False)},
    "TripDescriptor": {
        1: ("trip_id", "text", False), 2: ("start_time", "text", False), 3: ("start_date", "text", False), 4: ("schedule_relationship", "int", False), 5: ("route_id", "text", False), 6: ("direction_id", "int", False),
    },
    "VehicleDescriptor": {1: ("id", "text", False), 2: ("label", "text", False)},
    "VehiclePosition": {
        1: ("trip", "TripDescriptor", False), 2: ("position", "Position", False), 3: ("current_stop_sequence", "int", False), 4: ("current_status", "int", False), 5: ("timestamp", "int", False),
        7: ("stop_id", "text", False), 8: ("vehicle", "VehicleDescriptor", False),
    },
    "Position": {1: ("latitude", "float", False), 2: ("longitude", "float", False), 3: ("bearing", "float", False), 5: ("speed", "float", False)},
    "Alert": {
        1: ("active_period", "TimeRange", True), 5: ("informed_entity", "EntitySelector", True), 6: ("cause", "int", False), 7: ("effect", "int", False), 10: ("header_text", "TranslatedString", False), 11: ("description_text", "TranslatedString", False),
    },
    "TimeRange": {1: ("start", "int", False), 2: ("end", "int", False)},
    "EntitySelector": {
        1: ("agency_id", "text", False), 2: ("route_id", "text", False), 3: ("route_type", "signed", False), 4: ("trip", "TripDescriptor", False), 5: ("stop_id", "text", False), 6: ("direction_id", "int", False),
    },
    "TranslatedString": {1: ("translation", "Translation", True)},
    "Translation": {1: ("text", "text", False), 2: ("language", "text", False)},
}
#: Names of the enumerations' numbers.
TRIP_RELATIONSHIPS = {0: "SCHEDULED", 1: "ADDED", 2: "UNSCHEDULED", 3: "CANCELED", 5: "REPLACEMENT", 6: "DUPLICATED", 7: "DELETED", 8: "NEW"}
CALL_RELATIONSHIPS = {0: "SCHEDULED", 1: "SKIPPED", 2: "NO_DATA", 3: "UNSCHEDULED"}
STATUSES = {0: "INCOMING_AT", 1: "STOPPED_AT", 2: "IN_TRANSIT_TO"}

PLAIN = {"text": pa.string(), "int": pa.int64(), "signed": pa.int64(), "float": pa.float64()}


def _type(kind: str) -> pa.DataType:
    if kind in PLAIN:
        return PLAIN[kind]
    return pa.struct([(name, pa.list_(_type(k)) if many else _type(k)) for name, k, many in MESSAGES[kind].values()])


ENTITIES = pa.schema([("feed", pa.string()), ("feed_timestamp", pa.int64()), ("error", pa.string()), ("entity", _type("FeedEntity"))])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number runs over the end")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if not number:
            raise ValueError("field number 0")
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire}")
            if at + size > len(data):
                raise ValueError("a field runs over the end")
            value, at = data[at : at + size], at + size
        yield number, wire, value


def message(data: bytes, kind: str) -> dict:
    """The fields that are read; of one that doesn't repeat the last counts, parts of a message are put together."""
    out: dict = {}
    for number, wire, value in fields(data):
        if number not in MESSAGES[kind]:
            continue
        name, of, many = MESSAGES[kind][number]
        if wire != {"int": 0, "signed": 0, "float": 5}.get(of, 2):
            raise ValueError(f"{kind}.{name} has wire type {wire}")
        if of == "signed":
            found = value - (1 << 64) if value >> 63 else value
        elif of == "int":
            found = value if value >> 63 == 0 else value - (1 << 64)
        elif of == "float":
            found = struct.unpack("<f", value)[0]
        elif of == "text":
            found = value.decode("utf-8")
        else:
            found = message(value, of)
            if not many and name in out:
                found = out[name] | found
        if many:
            out.setdefault(name, []).append(found)
        else:
            out[name] = found
    return out


def snapshot(data: bytes) -> tuple[int | None, list[dict]]:
    """The header's time and all entities of a file; raises ValueError where it isn't a full data set."""
    header, entities = None, []
    for number, wire, value in fields(data):
        if number in (1, 2) and wire != 2:
            raise ValueError("the feed's parts aren't messages")
        if number == 1:
            header = (header or {}) | message(value, "FeedHeader")
        elif number == 2:
            if len(entities) == MAX_ENTITIES:
                raise ValueError(f"more than {MAX_ENTITIES} entities")
            entities.append(message(value, "FeedEntity"))
            if entities[-1].get("is_deleted"):
                raise ValueError("an entity is deleted: only full data sets are read")
    if not header or not header.get("version"):
        raise ValueError("no header with a version")
    if header.get("incrementality"):
        raise ValueError("DIFFERENTIAL feeds aren't read, only full data sets")
    return header.get("timestamp"), entities


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                at, entities = snapshot(content)
                rows = [{"feed": path, "feed_timestamp": at, "error": None, "entity": e} for e in entities]
            except ValueError as error:
                rows = [{"feed": path, "feed_timestamp": None, "error": str(error), "entity": None}]
            for begin in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[begin : begin + 10_000], schema=ENTITIES)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """SC18: a row for each entity of every feed file under path: feed, feed_timestamp, error, entity."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_decoded, from_arrow_schema(ENTITIES))


def rejected(feeds: DataFrame) -> DataFrame:
    return feeds.where("error IS NOT NULL").select("feed", "error")


def named(number: Column, names: dict[int, str]) -> Column:
    """An enumeration's name; 0's where none is given, null for an unknown number."""
    out = F.when(number.isNull(), names[0])
    for k, name in names.items():
        out = out.when(number == k, name)
    return out


def _trip(at: str) -> list[Column]:
    return [*[F.col(f"{at}.{c}").alias(c) for c in ("trip_id", "start_time", "start_date", "route_id", "direction_id")], named(F.col(f"{at}.schedule_relationship"), TRIP_RELATIONSHIPS).alias("relationship")]


def trip_updates(feeds: DataFrame) -> DataFrame:
    """A row for each trip update, with its calls as an array."""
    rows = feeds.where("entity.trip_update IS NOT NULL").select("feed", "feed_timestamp", F.col("entity.id").alias("entity_id"), F.col("entity.trip_update").alias("u"))
    return rows.select(
        "feed", "feed_timestamp", "entity_id", *_trip("u.trip"), F.col("u.vehicle.id").alias("vehicle_id"), F.col("u.vehicle.label").alias("vehicle_label"), F.col("u.timestamp").alias("timestamp"), F.col("u.delay").alias("delay"),
        F.coalesce("u.stop_time_update", F.array()).alias("calls"),
    )


def call_updates(feeds: DataFrame) -> DataFrame:
    """A row for each call of every trip update, in the order of the feed (place)."""
    rows = trip_updates(feeds).select("feed", "entity_id", "trip_id", "start_date", F.posexplode("calls").alias("place", "c"))
    times = [F.col(f"c.{e}.{k}").alias(f"{e}_{k}") for e in ("arrival", "departure") for k in ("delay", "time", "uncertainty")]
    return rows.select("feed", "entity_id", "trip_id", "start_date", "place", F.col("c.stop_sequence").alias("stop_sequence"), F.col("c.stop_id").alias("stop_id"), *times, named(F.col("c.schedule_relationship"), CALL_RELATIONSHIPS).alias("relationship"))


def vehicles(feeds: DataFrame) -> DataFrame:
    rows = feeds.where("entity.vehicle IS NOT NULL").select("feed", "feed_timestamp", F.col("entity.id").alias("entity_id"), F.col("entity.vehicle").alias("v"))
    # Without a status a vehicle is on its way.
    status = F.when(F.col("v.current_status").isNull(), STATUSES[2]).otherwise(named(F.col("v.current_status"), STATUSES))
    return rows.select(
        "feed", "feed_timestamp", "entity_id", *_trip("v.trip"), F.col("v.vehicle.id").alias("vehicle_id"), F.col("v.vehicle.label").alias("vehicle_label"), F.col("v.position.latitude").alias("lat"), F.col("v.position.longitude").alias("lon"),
        F.col("v.position.bearing").alias("bearing"), F.col("v.position.speed").alias("speed"), F.col("v.current_stop_sequence").alias("stop_sequence"), F.col("v.stop_id").alias("stop_id"), status.alias("status"), F.col("v.timestamp").alias("timestamp"),
    )


def alerts(feeds: DataFrame) -> DataFrame:
    """A row for each selector and active period of every alert; nulls stand for none."""
    rows = feeds.where("entity.alert IS NOT NULL").select("feed", F.col("entity.id").alias("alert_id"), F.col("entity.alert").alias("a"))
    text = lambda c: F.col(f"a.{c}.translation")[0]["text"]
    wide = rows.select("feed", "alert_id", F.col("a.cause").alias("cause"), F.col("a.effect").alias("effect"), text("header_text").alias("header"), text("description_text").alias("description"), F.explode_outer("a.informed_entity").alias("s"), F.col("a.active_period").alias("p"))
    wide = wide.select("*", F.explode_outer("p").alias("t"))
    return wide.select(
        "feed", "alert_id", "cause", "effect", "header", "description", *[F.col(f"s.{c}").alias(c) for c in ("agency_id", "route_id", "route_type", "stop_id", "direction_id")], F.col("s.trip.trip_id").alias("trip_id"),
        F.col("t.start").alias("start"), F.col("t.end").alias("end"),
    )
