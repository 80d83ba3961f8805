"""GTFS archives as DataFrames: tables are read from ZIP files, typed by explicit expressions, and split as routing needs them.

Archives are read by Spark (`binaryFile`), so any path that Spark opens will do. A table of an archive is
unpacked as lines in a Python worker; parsing and typing are column expressions. Text that isn't a time, date
or number of its column's form is an error of the feed and listed by `problems`, not dropped in silence.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.clock import parse_clock, parse_date

#: Columns of each table that are read; others are left out.
COLUMNS = {
    "agency": ("agency_id", "agency_name", "agency_timezone"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station", "wheelchair_boarding"),
    "routes": ("route_id", "agency_id", "route_short_name", "route_long_name", "route_type"),
    "trips": ("route_id", "service_id", "trip_id", "direction_id", "shape_id", "block_id", "bikes_allowed", "wheelchair_accessible"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "pickup_type", "drop_off_type"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "transfers": ("from_stop_id", "to_stop_id", "transfer_type", "min_transfer_time", "from_route_id", "to_route_id", "from_trip_id", "to_trip_id"),
    "frequencies": ("trip_id", "start_time", "end_time", "headway_secs", "exact_times"),
    "shapes": ("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"),
    "pathways": ("from_stop_id", "to_stop_id", "pathway_mode", "is_bidirectional", "length", "traversal_time", "stair_count"),
}
MAX_ENTRY_BYTES = 4 << 30
BATCH_ROWS = 20_000


def _rows(batches: Iterator[pa.RecordBatch], table: str) -> Iterator[pa.RecordBatch]:
    import csv

    names = COLUMNS[table]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                entry = next((i for i in archive.infolist() if i.filename.rpartition("/")[2] == f"{table}.txt" and ".." not in i.filename), None)
                if entry is None:
                    continue
                if entry.file_size > MAX_ENTRY_BYTES:
                    raise ValueError(f"{path}: {table}.txt has {entry.file_size} bytes")
                with archive.open(entry) as raw:
                    reader = csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                    held: list[dict] = []
                    for n, row in enumerate(reader, 1):
                        held.append({"feed": path, "line": n} | {c: (row.get(c) or "").strip() or None for c in names})
                        if len(held) == BATCH_ROWS:
                            yield _batch(held, names)
                            held = []
                    if held:
                        yield _batch(held, names)


def _batch(rows: list[dict], names: tuple[str, ...]) -> pa.RecordBatch:
    schema = pa.schema([("feed", pa.string()), ("line", pa.int64()), *[(c, pa.string()) for c in names]])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def read_raw(spark: SparkSession, path: str, table: str) -> DataFrame:
    """SC1, SC2: all rows of a table of every archive under path, as text, with the archive and the row's number."""
    schema = "feed string, line long, " + ", ".join(f"{c} string" for c in COLUMNS[table])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda b: _rows(b, table), schema)


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All known tables of each archive in one pass: table, and the rest as _rows gives it, with the columns as a map."""
    for batch in batches:
        for k in range(batch.num_rows):
            for table, names in COLUMNS.items():
                for rows in _rows(iter([batch.slice(k, 1)]), table):
                    held = [[(c, row[c]) for c in names] for row in rows.to_pylist()]
                    values = pa.array(held, pa.map_(pa.string(), pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([table] * rows.num_rows), rows.column(0), rows.column(1), values], names=["table", "feed", "line", "values"])


def unpack(spark: SparkSession, path: str, to: str) -> None:
    """SC1: every archive under path read once; its tables' rows as text, a folder for each table."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_every, "table string, feed string, line long, values map<string, string>")
    rows.write.partitionBy("table").parquet(to)


def read_unpacked(spark: SparkSession, to: str, table: str) -> DataFrame:
    """What read_raw gives, from a folder that unpack wrote: splittable, without opening an archive again."""
    rows = spark.read.parquet(to).where(F.col("table") == table)
    return rows.select("feed", "line", *[F.col("values")[c].alias(c) for c in COLUMNS[table]])


def _int(name: str, default: int | None = None) -> Column:
    value = F.expr(f"try_cast({name} AS INT)")
    return value if default is None else F.coalesce(value, F.lit(default))


def stops(raw: DataFrame) -> DataFrame:
    """SC4: an empty coordinate is null, not 0; the default location type is 0; rows without an id are left to `problems`."""
    return raw.where("stop_id IS NOT NULL").select(
        "stop_id", F.coalesce("stop_name", F.lit("")).alias("stop_name"), F.expr("try_cast(stop_lat AS DOUBLE)").alias("lat"), F.expr("try_cast(stop_lon AS DOUBLE)").alias("lon"),
        _int("location_type", 0).alias("location_type"), F.col("parent_station").alias("parent_id"), _int("wheelchair_boarding", 0).alias("wheelchair_boarding"),
    )


def routes(raw: DataFrame) -> DataFrame:
    """SC5: null names are empty; the default type is 3."""
    return raw.select("route_id", F.coalesce("route_short_name", F.lit("")).alias("short_name"), F.coalesce("route_long_name", F.lit("")).alias("long_name"), _int("route_type", 3).alias("route_type"))


def trips(raw: DataFrame) -> DataFrame:
    """SC6, SC7."""
    return raw.select("trip_id", "route_id", "service_id", _int("direction_id", 0).alias("direction_id"), "shape_id", "block_id", _int("bikes_allowed", 0).alias("bikes_allowed"), _int("wheelchair_accessible", 0).alias("wheelchair_accessible"))


def stop_times(raw: DataFrame) -> DataFrame:
    """SC13: blank times are null; boarding and alighting are legal unless the type is 1 or 2."""
    return raw.select(
        "trip_id", _int("stop_sequence").alias("stop_sequence"), "stop_id", parse_clock(F.col("arrival_time")).alias("arrival"), parse_clock(F.col("departure_time")).alias("departure"),
        (~_int("pickup_type", 0).isin(1, 2)).alias("can_board"), (~_int("drop_off_type", 0).isin(1, 2)).alias("can_alight"),
    )


def calendar(raw: DataFrame) -> DataFrame:
    """SC8."""
    days = [_int(c).alias(c) for c in COLUMNS["calendar"][1:8]]
    return raw.select("service_id", *days, parse_date(F.col("start_date")).alias("start_date"), parse_date(F.col("end_date")).alias("end_date"))


def calendar_dates(raw: DataFrame) -> DataFrame:
    """SC9."""
    return raw.select("service_id", parse_date(F.col("date")).alias("date"), _int("exception_type").alias("exception_type"))


def frequencies(raw: DataFrame) -> DataFrame:
    """SC11."""
    return raw.select("trip_id", parse_clock(F.col("start_time")).alias("start_time"), parse_clock(F.col("end_time")).alias("end_time"), _int("headway_secs").alias("headway_secs"), _int("exact_times", 0).alias("exact_times"))


def shapes(raw: DataFrame) -> DataFrame:
    """SC12."""
    return raw.select("shape_id", _int("shape_pt_sequence").alias("point_no"), F.expr("try_cast(shape_pt_lat AS DOUBLE)").alias("lat"), F.expr("try_cast(shape_pt_lon AS DOUBLE)").alias("lon"))


def split_transfers(raw: DataFrame) -> dict[str, DataFrame]:
    """SC10: all rows are rules; types 4 and 5 link trips; stop-to-stop rows but type 1 are transfers, the last of a pair wins."""
    typed = raw.withColumn("kind", _int("transfer_type", 0))
    scoped = F.coalesce("from_route_id", "to_route_id", "from_trip_id", "to_trip_id").isNotNull()
    w = Window.partitionBy("feed", "from_stop_id", "to_stop_id").orderBy(F.desc("line"))
    plain = typed.where(~scoped & ~F.col("kind").isin(1, 4, 5)).withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return {
        "rules": typed,
        "links": typed.where("kind IN (4, 5)"),
        "transfers": plain.select("from_stop_id", "to_stop_id", _int("min_transfer_time", 0).alias("seconds"), (F.col("kind") == 3).alias("forbidden")),
    }


def pathway_edges(raw: DataFrame, metres_per_second: float = 1.33, seconds_per_stair: float = 0.6, gate_seconds: int = 10) -> DataFrame:
    """SC14: directed edges with their seconds, both ways where a pathway is; of parallel ones the least."""
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    guess = F.coalesce(number("length") / metres_per_second, F.abs(number("stair_count")) * seconds_per_stair, F.when(_int("pathway_mode") >= 6, F.lit(float(gate_seconds))), F.lit(0.0))
    rows = raw.select("from_stop_id", "to_stop_id", F.ceil(F.coalesce(number("traversal_time"), guess)).cast("int").alias("seconds"), _int("is_bidirectional", 0).alias("both"))
    back = rows.where("both = 1").select(F.col("to_stop_id").alias("from_stop_id"), F.col("from_stop_id").alias("to_stop_id"), "seconds", "both")
    return rows.unionByName(back).groupBy("from_stop_id", "to_stop_id").agg(F.min("seconds").alias("seconds"))


def problems(raw: DataFrame, table: str) -> DataFrame:
    """Rows of a table that break its rules: feed, line and the rule."""
    flag = lambda c, kinds: F.col(c).isNotNull() & ~_int(c, -1).isin(*kinds)
    bad_time = lambda c: F.col(c).isNotNull() & parse_clock(F.col(c)).isNull()
    if table == "stops":
        rules = {"no_id": F.col("stop_id").isNull()}
    elif table == "stop_times":
        rules = {c: bad_time(c) for c in ("arrival_time", "departure_time")} | {c: flag(c, range(4)) for c in ("pickup_type", "drop_off_type")}
    elif table == "calendar":
        days = F.array(*[_int(c, -1) for c in COLUMNS["calendar"][1:8]])
        order = parse_date(F.col("end_date")) < parse_date(F.col("start_date"))
        rules = {"weekday": F.exists(days, lambda d: ~d.isin(0, 1)), "dates": F.coalesce(order, F.lit(True))}
    elif table == "calendar_dates":
        rules = {"exception_type": ~_int("exception_type", 0).isin(1, 2)}
    elif table == "frequencies":
        window = parse_clock(F.col("end_time")) <= parse_clock(F.col("start_time"))
        rules = {"window": F.coalesce(window, F.lit(True)), "headway": F.coalesce(_int("headway_secs") <= 0, F.lit(True))}
    else:
        raise ValueError(f"no rules for {table}")
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return raw.select("feed", "line", F.explode(found).alias("problem"))


def write_table(rows: DataFrame, path: str, partitions: str | None = None) -> None:
    """Timetable facts at rest: Parquet, by service where asked, sorted in files by trip."""
    columns = [c for c in ("trip_id", "stop_sequence") if c in rows.columns]
    rows = rows.sortWithinPartitions(*columns) if columns else rows
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partitions) if partitions else writer).parquet(path)
