"""Helpers of the transit operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this many rows a side of a join is broadcast after its count; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000
#: And no more bytes than this.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode, where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tramline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage of a loop and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tramline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: eight for a number, the length of a text, nested values as written."""
    out = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.length(column), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            out = out + F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0))
    return out


def size(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[int, bool]:
    """Rows of df, or most + 1 if there are more; and whether they're few enough, by count and by bytes, to be broadcast."""
    found = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).first()
    return found["n"], found["n"] <= most and found["bytes"] <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small by count and by bytes; else as it is."""
    return F.broadcast(df) if size(df, most)[1] else df
