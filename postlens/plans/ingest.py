"""Log files to tables, by role: read, parse, assemble, merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import lines as L
from postlens.functions import text as T
from postlens.operators import assemble, correlate, merge
from postlens.plans.schema import conform
from postlens.sources import derived, logs


def mail(spark: SparkSession, root: str, logdirs: dict[str, str], envelope_fallback: bool = False, hold_newest: bool = True) -> dict[str, DataFrame]:
    """message, delivery, queue_minute, service_minute and counters of the folders root/logdir of each role.

    SMTP logs give messages, the queue log gives deliveries and its own side of each message,
    which is put onto the SMTP side or stays alone. The newest minute of a log is held back.
    """
    sides, queue, out, minutes, counts = [], None, {}, [], []
    for folder, role in logs.check_roles(logdirs).items():
        rows = logs.read_multilog(spark, f"{root}/{folder}")
        if role == "send":
            send = L.parse_send(rows)
            lost = assemble.unmatched(send)
            counts.append(assemble.counters(send).join(lost, "logdir", "left"))
            queue = assemble.queue_messages(send)
            made = derived.delivery_fields(assemble.deliveries(send))
            out["delivery"] = conform(merge.dedupe_deliveries(made), "delivery")
            folded = assemble.queue_minutes(send, hold_newest).withColumn("seq", F.lit(0))
            out["queue_minute"] = conform(merge.merge_queue_minutes(folded), "queue_minute")
        else:
            smtp = L.parse_smtp(rows)
            counts.append(assemble.counters(smtp).withColumn("unmatched", F.lit(0).cast("long")))
            sides.append(assemble.smtp_messages(smtp, logs.ROLES[role], envelope_fallback))
            minutes.append(assemble.service_minutes(smtp, hold_newest).withColumns({"service": F.lit(role), "seq": F.lit(0)}))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    nulls = {"msg_id": "long", "size_bytes": "long", "queue_qp": "long", "queue_ts": "timestamp_ntz"}
    smtp = union(sides).drop("logdir") if sides else None
    message = merge.upsert_messages(smtp.withColumns({c: F.lit(None).cast(k) for c, k in nulls.items()})) if smtp is not None else None
    if queue is not None:
        queue = queue.drop("logdir", "seq")
        message = correlate.merge_sides(message.drop("seq"), merge.not_applied(queue, message)) if message is not None else queue
        message = merge.infer_direction(conform(message, "message"), out["delivery"])
    if message is not None:
        out["message"] = conform(message.withColumn("sender_domain", T.domain_of(F.col("sender"))), "message")
    if minutes:
        out["service_minute"] = conform(merge.merge_service_minutes(union(minutes)), "service_minute")
    return out | {"counters": union(counts)}


def access(spark: SparkSession, live_path: str, now: Column, zone: str = "UTC") -> dict[str, DataFrame]:
    """auth_event, service_minute and counters (one row: lines, ignored, malformed) of a login log and its rotations."""
    rows = L.parse_login(logs.read_syslog(spark, live_path), F.col("year"), now, zone)
    events = rows.filter("result is not null").withColumnRenamed("user", "user_name")
    counts = rows.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("result").isNull() & F.col("readable")).alias("ignored"),
        F.count_if(F.col("result").isNull() & ~F.col("readable")).alias("malformed"),
    )
    minutes = merge.merge_service_minutes(assemble.login_minutes(rows).withColumn("seq", F.lit(0)))
    return {"auth_event": conform(merge.dedupe_auth(events), "auth_event"), "service_minute": conform(minutes, "service_minute"), "counters": counts}


def bans(spark: SparkSession, path: str) -> DataFrame:
    """ban_event of a fail2ban log; no rows if there is none."""
    return conform(merge.dedupe_bans(logs.read_bans(spark, path)), "ban_event")
