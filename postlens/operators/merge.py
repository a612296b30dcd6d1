"""Idempotent merges: what a keyed store would do row by row, as aggregates over all versions of a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import rounded_to_ms

UNKNOWN_INSTANCE = "1970-01-01 00:00:00"
FILLED = ("msg_id", "size_bytes", "auth_user", "auth_source", "client_ip", "spam_score", "verdict", "subject", "queue_qp", "queue_ts")


def upsert_messages(rows: DataFrame) -> DataFrame:
    """One row for each (qp, ts), from versions ordered by seq; rows without qp pass.

    Of each filled column the last value that isn't null counts, of sender the first version's,
    of direction the last version's that knows the client, else the first's.
    """
    keyed = rows.filter("qp is not null").groupBy("qp", "ts").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in FILLED if c in rows.columns],
        F.min_by("sender", "seq").alias("sender"),
        F.coalesce(F.max_by("direction", F.when(F.col("client_ip").isNotNull(), F.col("seq"))), F.min_by("direction", "seq")).alias("direction"),
        F.max("seq").alias("seq"),
    )
    return keyed.unionByName(rows.filter("qp is null").select(keyed.columns))


def dedupe_deliveries(rows: DataFrame) -> DataFrame:
    """The first (by seq) of rows alike in message instance, time, recipient and result; an unknown instance gets the epoch."""
    key = ["msg_id", "msg_ts", "ts", "recipient", "result"]
    rows = rows.withColumn("msg_ts", F.coalesce("msg_ts", F.lit(UNKNOWN_INSTANCE).cast("timestamp_ntz")))
    return rows.groupBy(*key).agg(*[F.min_by(c, "seq").alias(c) for c in rows.columns if c not in key])


def merge_queue_minutes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("minute").agg(
        F.max("local_max_used").alias("local_max_used"), F.max_by("local_limit", "seq").alias("local_limit"),
        F.max("remote_max_used").alias("remote_max_used"), F.max_by("remote_limit", "seq").alias("remote_limit"),
    )


def merge_service_minutes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("minute", "service").agg(
        F.sum("connects").alias("connects"), F.sum("messages").alias("messages"), F.max("max_concurrency").alias("max_concurrency"), F.max_by("limit_value", "seq").alias("limit_value")
    )


def dedupe_auth(rows: DataFrame) -> DataFrame:
    """Rows alike in time, service, result, user and address count once, unless user or address is null."""
    known = F.col("user_name").isNotNull() & F.col("client_ip").isNotNull()
    return rows.filter(known).dropDuplicates(["ts", "service", "result", "user_name", "client_ip"]).unionByName(rows.filter(~known))


def dedupe_bans(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["ts", "jail", "ip", "action"])


def infer_direction(message: DataFrame, delivery: DataFrame) -> DataFrame:
    """Messages that only the queue saw are incoming if all their deliveries are local."""
    by = delivery.groupBy("msg_id", F.col("msg_ts").alias("queue_ts")).agg(
        F.count_if(F.col("route") == "remote").alias("n_remote"), F.count_if(F.col("route") == "local").alias("n_local")
    )
    rows = message.join(by, ["msg_id", "queue_ts"], "left")
    inferred = F.when((F.col("n_remote") == 0) & (F.col("n_local") > 0), "in").otherwise("out")
    direction = F.when(F.col("qp").isNull() & F.col("n_local").isNotNull(), inferred).otherwise(F.col("direction"))
    return rows.withColumn("direction", direction).select(message.columns)


def not_applied(queue: DataFrame, message: DataFrame) -> DataFrame:
    """Queue records that no message carries yet: same queue_qp and the same time to the millisecond."""
    done = message.filter("queue_qp is not null").select("queue_qp", rounded_to_ms(F.col("queue_ts")).alias("ms")).distinct()
    return queue.withColumn("ms", rounded_to_ms(F.col("queue_ts"))).join(done, ["queue_qp", "ms"], "left_anti").drop("ms")
