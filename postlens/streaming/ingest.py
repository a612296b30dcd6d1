"""Streams of log lines to facts: stateless parsing, minute folds with a watermark, and tables that batches are merged into.

Deliveries and SMTP sessions are in postlens.streaming.keyed. A checkpoint folder takes the place of the single-writer lock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens.functions import lines as L
from postlens.functions.text import after_label, tai64n


def logins(stream: DataFrame, year: Column | int, now: Column, zone: str = "UTC") -> DataFrame:
    """Login events of a stream of lines; other lines go."""
    rows = L.parse_login(stream, year, now, zone).filter("result is not null")
    return rows.select("ts", "service", "result", F.col("user").alias("user_name"), "client_ip", "method", "tls")


def bans(stream: DataFrame) -> DataFrame:
    return L.parse_ban(stream).filter("action is not null").select("ts", "jail", "ip", "action")


def labelled(stream: DataFrame, line: str = "line") -> DataFrame:
    """Adds ts (UTC) and text of lines that begin with a label; lines without one go."""
    rows = stream.withColumns({"ts": tai64n(F.col(line)).cast("timestamp"), "text": after_label(F.col(line))})
    return rows.filter("ts is not null")


def service_minutes(smtp: DataFrame, late: str = "1 minute") -> DataFrame:
    """Connections, messages and most connections at once by log and minute.

    smtp: parse_smtp's columns with logdir, seq, ts. The limit is the last seen in the minute.
    In append mode a minute comes out once, when the watermark has passed it, so the newest
    minute is held back.
    """
    rows = smtp.filter("kind in ('open', 'recv', 'concurrency')").withWatermark("ts", late).groupBy("logdir", F.window("ts", "1 minute").alias("w"))
    out = rows.agg(
        F.count_if(F.col("kind") == "open").alias("connects"), F.count_if(F.col("kind") == "recv").alias("messages"),
        F.coalesce(F.max("used"), F.lit(0)).alias("max_concurrency"), F.max_by("max", F.when(F.col("kind") == "concurrency", F.struct("ts", "seq"))).alias("limit_value"),
    )
    return out.select("logdir", F.col("w.start").alias("minute"), "connects", "messages", "max_concurrency", "limit_value")


def beat(spark: SparkSession, path: str, now: str) -> None:
    """Appends a heartbeat: a run has ended, mail or no mail."""
    spark.range(1).select(F.lit(now).cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("append").parquet(path)


def beats(spark: SparkSession, path: str) -> DataFrame | None:
    """The heartbeats (ts), however old; None before the first."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to) else None


def store(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, once: bool = True, heartbeat: str | None = None
) -> StreamingQuery:
    """Appends a stream to the Parquet table at path, by day (column day, from ts); with keys, rows that are stored or repeated are left out.

    keys hold ts, so a batch looks only at the days of its own rows. A batch that runs again
    after a failure finds its rows stored, so nothing is doubled. With a heartbeat path, each
    batch that has been written is noted there.
    """
    if keys and "ts" not in keys:
        raise ValueError("keys must hold ts")

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", F.to_date("ts"))
        if keys:
            rows = rows.dropDuplicates(keys)
            to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to):
                days = [r.day for r in rows.select("day").distinct().collect()]  # a batch's days
                known = spark.read.schema(rows.schema).parquet(path).filter(F.col("day").isin(days)).select(keys)
                same = [rows[k].eqNullSafe(known[k]) for k in keys]
                rows = rows.join(known, same, "left_anti")
        rows.write.mode("append").partitionBy("day").parquet(path)
        if heartbeat:
            beat(spark, heartbeat, dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    if keys or heartbeat:
        return writer.foreachBatch(merge).start()
    return writer.format("parquet").option("path", path).outputMode("append").start()
