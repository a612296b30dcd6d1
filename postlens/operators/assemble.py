"""Records from log lines, in batch form: state machines written as windows over line numbers.

Windows are kept to a message, a delivery or a connection. The policy rule looks one line back
in a whole log; a log is cut into ranges of lines for it, and each range gets the last line of
the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.functions.text import fold

SUBMISSION_PORTS = (587, 465)
#: Lines of a log in one task, where a rule looks at a whole log.
RANGE = 1_000_000
DETAIL, SUBJECT = 1024, 512


def _before(*by: str):
    return Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def queue_messages(send: DataFrame) -> DataFrame:
    """One outgoing record for each info line. send: parse_send's columns with logdir, seq, ts."""
    return send.filter("kind = 'info'").select(
        "logdir", "seq", F.lit(None).cast("long").alias("qp"), F.col("qp").alias("queue_qp"), "ts", F.col("ts").alias("queue_ts"),
        F.lit("out").alias("direction"), fold(F.col("sender")).alias("sender"), "msg_id", F.col("bytes").alias("size_bytes"),
    )


def deliveries(send: DataFrame) -> DataFrame:
    """One record for each outcome of a started delivery; msg_ts is when the message was queued, null if unknown.

    A delivery number counts from its last start; an outcome without one is left out.
    """
    w = Window.partitionBy("logdir", "delivery_id").orderBy("seq")
    pairs = send.filter("kind in ('starting', 'outcome')").withColumn("last", F.lag(F.struct("kind", "seq", "msg_id", "route", "recipient")).over(w))
    pairs = pairs.filter("kind = 'outcome' and last.kind = 'starting'").select(
        "logdir", "seq", "ts", "result", F.substring("detail", 1, DETAIL).alias("detail"), F.col("last.seq").alias("began"), F.col("last.msg_id").alias("msg_id"), F.col("last.route").alias("route"),
        F.col("last.recipient").alias("recipient"),
    )
    opened = send.filter("kind in ('info', 'end')").select("logdir", "seq", "msg_id", F.struct("kind", "ts").alias("state"))
    starts = pairs.select("logdir", F.col("began").alias("seq"), "msg_id", F.lit(None).cast(opened.schema["state"].dataType).alias("state"))
    state = F.last("state", ignorenulls=True).over(_before("logdir", "msg_id"))
    known = opened.unionByName(starts).withColumn("now", state).filter("state is null").select("logdir", F.col("seq").alias("began"), F.when(F.col("now.kind") == "info", F.col("now.ts")).alias("msg_ts"))
    return pairs.join(known, ["logdir", "began"]).drop("began")


def unmatched(send: DataFrame) -> DataFrame:
    """logdir, unmatched: outcomes without a start."""
    w = Window.partitionBy("logdir", "delivery_id").orderBy("seq")
    rows = send.filter("kind in ('starting', 'outcome')").withColumn("last", F.lag("kind").over(w))
    lost = (F.col("kind") == "outcome") & (F.coalesce("last", F.lit("")) != "starting")
    return rows.groupBy("logdir").agg(F.sum(lost.cast("long")).alias("unmatched"))


def counters(rows: DataFrame) -> DataFrame:
    """logdir, lines, malformed (no label), ignored (of no kind) of parsed lines."""
    return rows.groupBy("logdir").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("ts").isNull()).alias("malformed"), F.count_if(F.col("ts").isNotNull() & F.col("kind").isNull()).alias("ignored")
    )


def line_before(rows: DataFrame, value: Column, size: int = RANGE) -> DataFrame:
    """Adds before: value of the row before (by seq) in the same logdir."""
    rows = rows.withColumns({"value": value, "range": F.expr(f"seq div {size}")})
    last = rows.groupBy("logdir", "range").agg(F.max_by("value", "seq").alias("value"))  # one row a range
    carried = last.select("logdir", "range", F.lag("value").over(Window.partitionBy("logdir").orderBy("range")).alias("carried"))
    within = F.lag("value").over(Window.partitionBy("logdir", "range").orderBy("seq"))
    rows = rows.withColumn("within", within).join(carried, ["logdir", "range"])
    return rows.withColumn("before", F.coalesce("within", "carried")).drop("within", "carried", "value", "range")


def smtp_messages(smtp: DataFrame, default_direction: str = "in", envelope_fallback: bool = False) -> DataFrame:
    """One record for each recv line, with what its connection told before it.

    smtp: parse_smtp's columns with logdir, seq, ts. A process number's session ends with a
    recv or close line. The address is that of the last connect line, else of the first scan
    that names one. Outgoing mail is credited to the last authenticated policy line since
    the log's last recv, else, if asked for, to the sender.
    """
    own = smtp.filter("kind in ('connect', 'scan', 'recv', 'close')")
    ends = F.sum(F.col("kind").isin("recv", "close").cast("int")).over(_before("logdir", "pid"))
    own = own.withColumn("session", F.coalesce(ends, F.lit(0)))
    w = _before("logdir", "pid", "session")
    last = lambda kind, c: F.last(F.when(F.col("kind") == kind, F.col(c)), ignorenulls=True).over(w)
    first_ip = F.first(F.when(F.col("kind") == "scan", F.nullif("client_ip", F.lit(""))), ignorenulls=True).over(w)
    own = own.withColumns({
        "from_ip": F.coalesce(last("connect", "client_ip"), first_ip), "port": last("connect", "local_port"), "score": last("scan", "spam_score"),
        "label": last("scan", "verdict"), "title": last("scan", "subject"),
    }).filter("kind = 'recv'")
    # The last authenticated policy line since the last recv is the line before, if only these two kinds are looked at.
    policy = smtp.filter("kind = 'recv' or (kind = 'policy' and authenticated)").select("logdir", "seq", "kind", "auth_user")
    policy = line_before(policy, F.struct("kind", "auth_user")).filter("kind = 'recv'")
    credited = policy.select("logdir", "seq", F.when(F.col("before.kind") == "policy", F.col("before.auth_user")).alias("by"))
    rows = own.join(credited, ["logdir", "seq"])
    direction = F.when(F.col("port").isNull(), default_direction).when(F.col("port").isin(*SUBMISSION_PORTS), "out").otherwise("in")
    rows = rows.withColumn("direction", direction)
    out = F.col("direction") == "out"
    source = F.when(out & F.col("by").isNotNull(), "policy_check")
    user = F.when(out, F.col("by"))
    if envelope_fallback:
        source = F.when(source.isNotNull(), source).when(out & (F.col("sender") != ""), "envelope")
        user = F.when(out, F.coalesce("by", F.nullif("sender", F.lit(""))))
    return rows.select(
        "logdir", "seq", "qp", "ts", "direction", fold(F.col("sender")).alias("sender"), fold(user).alias("auth_user"), source.alias("auth_source"),
        F.col("from_ip").alias("client_ip"), F.col("score").alias("spam_score"), F.col("label").alias("verdict"), F.substring("title", 1, SUBJECT).alias("subject"),
    )


def _minute():
    return F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")


def queue_minutes(send: DataFrame, hold_newest: bool = False) -> DataFrame:
    """Most deliveries at once by minute; limits as first seen in it. The log's newest minute can be held back."""
    out = send.filter("kind = 'concurrency'").groupBy("logdir", _minute()).agg(
        F.max("local_used").alias("local_max_used"), F.min_by("local_max", "seq").alias("local_limit"),
        F.max("remote_used").alias("remote_max_used"), F.min_by("remote_max", "seq").alias("remote_limit"),
    )
    return without_newest(out) if hold_newest else out


def service_minutes(smtp: DataFrame, hold_newest: bool = False) -> DataFrame:
    """Connections, messages and most connections at once by minute; the limit as last seen in it."""
    out = smtp.filter("kind in ('open', 'recv', 'concurrency')").groupBy("logdir", _minute()).agg(
        F.count_if(F.col("kind") == "open").alias("connects"), F.count_if(F.col("kind") == "recv").alias("messages"),
        F.coalesce(F.max("used"), F.lit(0)).alias("max_concurrency"), F.max_by(F.col("max"), F.when(F.col("kind") == "concurrency", F.col("seq"))).alias("limit_value"),
    )
    return without_newest(out) if hold_newest else out


def without_newest(minutes: DataFrame) -> DataFrame:
    newest = minutes.groupBy("logdir").agg(F.max("minute").alias("newest"))  # one row a log
    return minutes.join(newest, "logdir").filter("minute < newest").drop("newest")


def login_minutes(logins: DataFrame) -> DataFrame:
    """service, minute, connects, messages of parse_login's rows: messages are logins."""
    return logins.filter("result is not null").groupBy("service", _minute()).agg(
        F.count(F.lit(1)).alias("connects"), F.count_if(F.col("result") == "login").alias("messages"), F.lit(0).alias("max_concurrency"), F.lit(0).alias("limit_value")
    )
