"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="postlens-mail-")


def new_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, in local mode alone, below a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/postlens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


class Aside:
    """Tables written aside, which cuts their lineage. As a context it deletes them at its end, all but those that were kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, rows: DataFrame) -> DataFrame:
        path = new_path(self.spark)
        rows.write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def keep(self, table: DataFrame) -> DataFrame:
        self.paths.pop(id(table), None)
        return table

    def __enter__(self) -> Aside:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.paths.values():
            to = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
