"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

HOLD_OUT_FOLDS = 5


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python, where it isn't on their path: Spark serves the archive from the driver."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in paths or getattr(context, "_tramline_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tramline-")) / "tramline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "tramline").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    context._tramline_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, mod 5; a null id counts as the empty text. 0 is the held-out fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HOLD_OUT_FOLDS


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode, where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tramline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tramline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def labelled(spark: SparkSession, labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label (0 or 1) of the training folds: rows with a null are left out, of rows that repeat a doc_id the largest label counts."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, those with the least hash of doc_id: the same rows whatever the partitions."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def give_back() -> None:
    """Hand memory that is free back to the system. Workers outlive their tasks and take turns, so what each holds on to adds up in an executor."""
    pa.default_memory_pool().release_unused()
    trim = _allocator()
    if trim:
        trim(0)


#: Arrays of so many bytes get memory of their own, which goes back as soon as they do.
OWN_MEMORY = 1 << 20
#: Fixed value: the number of that setting in the C library's mallopt.
M_MMAP_THRESHOLD = -3


@functools.cache
def _allocator():
    """In this process arrays of numpy and Arrow come from the C library, if it is one that can give memory back; its function for that."""
    libc = ctypes.CDLL(None)
    if not (hasattr(libc, "malloc_trim") and hasattr(libc, "mallopt")):
        return None
    libc.mallopt(M_MMAP_THRESHOLD, OWN_MEMORY)
    pa.set_memory_pool(pa.system_memory_pool())
    return libc.malloc_trim


def vector_udf(kind: pa.DataType):
    """An Arrow UDF that returns `kind`; unlike a type's text, it needs no session when the module is imported."""

    def of(f: Callable) -> Callable:
        @functools.wraps(f)
        def batch(*columns: pa.Array) -> pa.Array:
            give_back()
            return f(*columns)

        return F.arrow_udf(batch, returnType=from_arrow_type(kind))

    return of
