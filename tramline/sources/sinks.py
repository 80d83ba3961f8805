"""Results at the boundary: journeys as CSV, geometry as GeoJSON, arrays as base64, and fingerprints."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def flat(rows: DataFrame) -> DataFrame:
    """SK2: nested columns as JSON text, so that a row fits a CSV."""
    nested = {c for c, t in rows.dtypes if t.startswith(("array", "struct", "map"))}
    return rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("overwrite").option("header", True).csv(path)


def point_feature(lon: Column, lat: Column, properties: Column) -> Column:
    """SK3: a GeoJSON feature of a point."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def line_feature(points: Column, properties: Column) -> Column:
    """A GeoJSON feature of a line, from an array of [lon, lat]."""
    geometry = F.struct(F.lit("LineString").alias("type"), points.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def fingerprint(request: dict, without: tuple[str, ...] = ("output", "format")) -> str:
    """SK5: SHA-256 of a request's canonical JSON without its output switches."""
    import hashlib

    kept = {k: v for k, v in request.items() if k not in without}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def packed(batches):
    """SK4: for mapInArrow over (id, array of doubles): little-endian 32-bit floats as base64, infinity for null."""
    import base64

    import numpy as np

    for batch in batches:
        out = [base64.b64encode(np.array([np.inf if v is None else v for v in row or []], dtype="<f4").tobytes()).decode() for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "data"])


MANIFEST = "generation long, path string, n long, sign decimal(38,0)"


def generations(spark: SparkSession, at: str) -> DataFrame:
    """What has been published in a folder: a row for each generation, with its path, rows and the sum of their hashes."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{at}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def signature(rows: DataFrame) -> tuple:
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("sign")).first()
    return found["n"], found["sign"]


def publish(rows: DataFrame, at: str) -> bool:
    """SK6: rows as a new generation, if their content differs from the last one's; whether they were published.

    Rows are written beside the others first, then one file is added to the manifest: a reader sees the generation
    before or this one, whole, and a writer that breaks off leaves the one before.
    """
    spark = rows.sparkSession
    path = f"{at}/data/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    n, sign = signature(spark.read.schema(rows.schema).parquet(path))
    last = generations(spark, at).orderBy(F.desc("generation")).first()
    if last and (last["n"], last["sign"]) == (n, sign):
        return False
    row = spark.createDataFrame([((last["generation"] if last else 0) + 1, path, n, sign)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{at}/manifest")
    return True


def current(spark: SparkSession, at: str) -> DataFrame:
    """The last generation of a folder."""
    last = generations(spark, at).orderBy(F.desc("generation")).first()
    if not last:
        raise ValueError(f"nothing has been published in {at}")
    return spark.read.parquet(last["path"])
