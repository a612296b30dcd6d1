"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import cache
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="postlens-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset, a session whose tasks all run on the driver's machine gets a folder
    there, as its tasks share it; any other session gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/postlens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Sends whole texts to Python in batches of 1,000 rows, where the session has Spark's 10,000.

    A worker holds a batch as Arrow, as strings and as what is made of them, all at once. A
    number that the session has set itself stays.
    """
    if spark.conf.get(ROWS_PER_BATCH) == "10000":
        spark.conf.set(ROWS_PER_BATCH, str(rows))


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system: it goes on to other tasks, and keeps what it once took."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the tasks that read the files, never the
    work that made them, and what several consumers need is made once.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize gave; nothing that is still to run may read them."""
    for df in tables:
        if path := _paths.pop(df, None):
            to = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
