"""Daily totals of old facts, and their pruning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.plans.reports import outcomes

NUMBERS = ("messages", "bytes", "successes", "deferrals", "failures")


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _old(rows: DataFrame, now: str, days: int) -> DataFrame:
    return rows.filter(F.col("ts") < _at(now) - F.expr(f"INTERVAL {days} DAY"))


def fold_messages(message: DataFrame, now: str, days: int = 90) -> DataFrame:
    rows = _old(message, now, days).filter("sender_domain is not null").groupBy(F.to_date("ts").alias("day"), F.col("sender_domain").alias("domain"), "direction")
    return rows.agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def fold_deliveries(delivery: DataFrame, now: str, days: int = 90) -> DataFrame:
    rows = _old(delivery, now, days).filter("recipient_domain is not null").groupBy(F.to_date("ts").alias("day"), F.col("recipient_domain").alias("domain"), F.lit("out").alias("direction"))
    return rows.agg(*outcomes())


def merge_daily(stored: DataFrame, *folded: DataFrame) -> DataFrame:
    """Totals by day, domain and direction, of each number the greatest: folding again changes nothing."""
    every = stored
    for f in folded:
        every = every.unionByName(f, allowMissingColumns=True)
    return every.groupBy("day", "domain", "direction").agg(*[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in NUMBERS])


def _bound(old: DataFrame, budget: int, unit: str) -> tuple[object, int]:
    """The oldest day or second (of the rows old) that can't go as a whole, None if all can, and what is left of the budget for it."""
    at = F.date_trunc(unit, "ts").cast("timestamp_ntz")
    for r in old.groupBy(at.alias("at")).count().orderBy("at").collect():  # a row for each day, or for each second of a day
        if r["count"] > budget:
            return r["at"], budget
        budget -= r["count"]
    return None, budget


def prune(rows: DataFrame, now: str, days: int = 90, budget: int = 100_000, order: tuple[str, ...] = ()) -> DataFrame:
    """rows without the oldest ``budget`` of those that are past keeping; rows of no time stay.

    Rows of one time go in the order of ``order`` (no order: of all columns); of rows alike in
    that, as many go as must. Where the budget ends is found from counts by day, then by
    second, then among the first ``budget`` rows of one second, so no task sees all old rows.
    """
    old = _old(rows, now, days)
    day, left = _bound(old, budget, "day")
    if day is None:
        return rows.filter(F.col("ts").isNull() | (F.col("ts") >= _at(now) - F.expr(f"INTERVAL {days} DAY")))
    second, left = _bound(old.filter((F.col("ts") >= F.lit(day)) & (F.col("ts") < F.lit(day) + F.expr("INTERVAL 1 DAY"))), left, "second")
    begin, end = F.lit(second), F.lit(second) + F.expr("INTERVAL 1 SECOND")
    if not left:
        return rows.filter(F.col("ts").isNull() | (F.col("ts") >= begin))
    key = F.struct("ts", *(order or [c for c in rows.columns if c != "ts"]))
    here = old.filter((F.col("ts") >= begin) & (F.col("ts") < end)).withColumn("_key", key)
    last = here.orderBy("_key").limit(left).agg(F.max("_key").alias("_last"))  # one row
    here = here.join(F.broadcast(last))
    below, same = here.agg(F.count_if(F.col("_key") < F.col("_last")), F.count_if(F.col("_key") == F.col("_last"))).first()
    alike = here.filter(F.col("_key") == F.col("_last")).limit(below + same - left)
    # Rows of that second that aren't past keeping (now may lie within it) are among those after it.
    later = rows.filter(F.col("ts").isNull() | (F.col("ts") >= end) | ((F.col("ts") >= begin) & (F.col("ts") >= _at(now) - F.expr(f"INTERVAL {days} DAY"))))
    return later.unionByName(here.filter(F.col("_key") > F.col("_last")).select(rows.columns)).unionByName(alike.select(rows.columns))


def prune_stored(spark: SparkSession, path: str, now: str, days: int = 90, budget: int = 100_000) -> int:
    """Prunes a Parquet table of day partitions and gives the number of rows that went.

    Whole days go as folders, the oldest first; only the day in which the budget or the time
    of keeping ends is written anew. A run that was broken off can be run again.
    """
    rows = spark.read.parquet(path)
    last = _last_day(now, days)
    counts = rows.filter(F.col("day") <= F.lit(last)).groupBy("day").count().orderBy("day").collect()  # one row a day
    gone, whole = 0, []
    for r in counts:
        if r["day"] == last or gone + r["count"] > budget:
            kept = prune(rows.filter(F.col("day") == F.lit(r["day"])), now, days, budget - gone)
            aside = f"{path.rstrip('/')}.pruned"
            kept.write.mode("overwrite").parquet(aside)
            kept = spark.read.schema(rows.schema).parquet(aside)
            n = kept.count()
            if n:
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
            else:
                whole.append(r["day"])
            gone += r["count"] - n
            _delete(spark, aside)
            break
        gone += r["count"]
        whole.append(r["day"])
    for day in whole:
        _delete(spark, f"{path.rstrip('/')}/day={day}")
    return gone


def _last_day(now: str, days: int) -> dt.date:
    return (dt.datetime.fromisoformat(now) - dt.timedelta(days=days)).date()


def _delete(spark: SparkSession, path: str) -> None:
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
