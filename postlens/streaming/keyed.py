"""Deliveries and SMTP sessions of streams, with keyed state.

A message's state is kept by (log, message), a delivery's by (log, delivery number), a
session's by (log, process), so a log is spread over as many keys as it names. Only the rule
on policy lines looks back in a whole log: it is followed in ranges of a log, and of each
range one line goes on to the next.

State is forgotten a day after a key's last line, by a timer. The clock is that of the batch
unless another is given, and stands where the slower of lines that begin and lines that end
something has come to. With a log's own time as clock, lines that come later than the clock
allows are left out, as Spark does with late rows; with the batch's, no line is late.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postlens.functions.text import fold
from postlens.operators.assemble import DETAIL, SUBJECT, SUBMISSION_PORTS

DAY = "24 hours"
#: The state store that keyed state needs; sessions set it before their first stream.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A range of a log's numbers (bytes, of a growing log).
RANGE = 8 << 20


class Keyed(StatefulProcessor):
    """One value by key. ``step`` takes the value (None at first) and a line, and gives the next value and what comes out.

    Lines have at (the clock) and ms (the same in milliseconds) and come in the order of seq, then kind.
    ``end`` gives what else comes out after a batch's last line of the key.
    """

    def __init__(self, step, schema: str, ttl_ms: int, end=None):
        self.step, self.schema, self.ttl, self.end = step, schema, ttl_ms, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = value = tuple(self.value.get()) if self.value.exists() else None
        due = until = self.due.get()[0] if self.due.exists() else None
        for row in sorted(rows, key=lambda r: (r.seq, r.kind)):
            if until is not None and row.ms > until:
                value = None  # the timer, which runs after a batch's lines, would have cleared it
            value, out = self.step(value, row)
            until = max(until or 0, row.ms + self.ttl)
            yield from out
        if self.end:
            yield self.end(row)
        if value is None:
            until = None
            if before is not None:
                self.value.clear()
        elif value != before:
            self.value.update(value)
        if until != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if until is None:
                self.due.clear()
            else:
                self.handle.registerTimer(until)
                self.due.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.value.clear()
        self.due.clear()
        return iter(())


def _milliseconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")] * 1_000


def _clocked(rows: DataFrame, clock: Column | None) -> DataFrame:
    rows = rows.withColumn("at", F.current_timestamp() if clock is None else clock.cast("timestamp")).withWatermark("at", "0 seconds")
    return rows.withColumns({"ms": F.unix_millis("at"), "us": F.unix_micros(F.col("ts").cast("timestamp"))})


def _row(schema: str):
    """Makes rows with the schema's names."""
    return Row(*[c.split()[0] for c in schema.split(", ")])


def _state(rows: DataFrame, keys: list[str], step, value: str, out: str, ttl: str, chained: bool = False, end=None) -> DataFrame:
    rows.sparkSession.conf.set(*PROVIDER)
    more = {"eventTimeColumnName": "at"} if chained else {}
    return rows.groupBy(*keys).transformWithState(Keyed(step, value, _milliseconds(ttl), end), out, "Append", "EventTime", **more)


TIME = lambda c: F.timestamp_micros(c)
DELIVERED = "logdir string, seq long, us long, msg_id long, msg_us long, route string, recipient string, result string, detail string"
START = "logdir string, seq long, at timestamp, ms long, us long, kind string, delivery_id long, msg_id long, msg_us long, route string, recipient string, result string, detail string"


def _message(value, row):
    """The value: when the message was queued, while it is open."""
    if row.kind == "info":
        return (row.us,), ()
    if row.kind == "end":
        return None, ()
    opened = value[0] if value else None
    return value, [_row(START)(row.logdir, row.seq, row.at, row.ms, row.us, row.kind, row.delivery_id, row.msg_id, opened, row.route, row.recipient, None, None)]


def _delivery(value, row):
    """The value: a started delivery."""
    if row.kind == "starting":
        return (row.msg_id, row.msg_us, row.route, row.recipient), ()
    if value is None:
        return None, ()
    msg_id, msg_us, route, recipient = value
    return None, [_row(DELIVERED)(row.logdir, row.seq, row.us, msg_id, msg_us, route, recipient, row.result, row.detail)]


def deliveries(send: DataFrame, clock: Column | None = None, ttl: str = DAY) -> DataFrame:
    """The stream form of assemble.deliveries: one row for each outcome of a started delivery. send: parse_send's columns with logdir, seq, ts."""
    rows = _clocked(send, clock)
    opened = rows.filter("kind in ('info', 'end', 'starting')").select("logdir", "seq", "at", "ms", "us", "kind", "delivery_id", "msg_id", "route", "recipient")
    starts = _state(opened, ["logdir", "msg_id"], _message, "us long", START, ttl, chained=True)
    outcomes = rows.filter("kind = 'outcome'").select(
        "logdir", "seq", "at", "ms", "us", "kind", "delivery_id", F.lit(None).cast("long").alias("msg_id"), F.lit(None).cast("long").alias("msg_us"),
        F.lit(None).cast("string").alias("route"), F.lit(None).cast("string").alias("recipient"), "result", F.substring("detail", 1, DETAIL).alias("detail"),
    )
    out = _state(
        starts.unionByName(outcomes), ["logdir", "delivery_id"], _delivery, "msg_id long, msg_us long, route string, recipient string",
        DELIVERED, ttl,
    )
    return out.select("logdir", "seq", TIME("us").alias("ts"), "msg_id", TIME("msg_us").alias("msg_ts"), "route", "recipient", "result", "detail")


MESSAGE = "logdir string, seq long, us long, qp long, direction string, sender string, auth_user string, auth_source string, client_ip string, spam_score double, verdict string, subject string"
SESSION = "logdir string, seq long, at timestamp, ms long, us long, kind string, pid long, port int, ip string, score double, verdict string, subject string, sender string, qp long, auth_user string"


def _changed(row, **fields) -> Row:
    return Row(**row.asDict() | fields)


def _range(value, row):
    """The value: the last line of the range. A range's first recv goes out as "first"."""
    last = (row.kind == "policy", row.auth_user)
    if row.kind == "policy":
        return last, ()
    return last, [_changed(row, kind="recv" if value else "first", auth_user=value[1] if value and value[0] else None)]


def _last(row):
    """The last line of a range so far, as "last"; qp tells whether it is a policy line."""
    return _changed(row, kind="last", qp=int(row.kind == "policy"))


def _carried(value, row):
    """The value: the last line of the range before. Of lines other than "first" and "last" nothing is known here."""
    if row.kind == "last":
        return (bool(row.qp), row.auth_user), ()
    if row.kind == "first":
        by = value[1] if value and value[0] else None
        return value, [_changed(row, kind="recv", auth_user=by)]
    return value, [row]


def _session(value, row, default_direction: str, envelope_fallback: bool):
    """The value: what the open connection has told."""
    if row.kind == "close":
        return None, ()
    ip, port, score, verdict, subject = value or (None,) * 5
    if row.kind == "connect":
        return (row.ip, row.port, score, verdict, subject), ()
    if row.kind == "scan":
        return (ip or row.ip or None, port, row.score, row.verdict, row.subject), ()
    direction = default_direction if port is None else "out" if port in SUBMISSION_PORTS else "in"
    user, source = (row.auth_user, "policy_check") if direction == "out" and row.auth_user is not None else (None, None)
    if envelope_fallback and direction == "out" and user is None and row.sender:
        user, source = row.sender, "envelope"
    return None, [_row(MESSAGE)(row.logdir, row.seq, row.us, row.qp, direction, row.sender, user, source, ip, score, verdict, subject)]


def credited(smtp: DataFrame, ttl: str = DAY, size: int = RANGE) -> DataFrame:
    """SESSION's columns of recv lines, auth_user being that of the last authenticated policy line since the log's last recv.

    smtp: SESSION's columns of recv and authenticated policy lines. A range passes on one line a batch; these few, by log, settle the
    first recv of each range.
    """
    ranges = smtp.withColumn("range", F.expr(f"seq div {size}"))
    found = _state(ranges, ["logdir", "range"], _range, "policy boolean, auth_user string", SESSION + ", range long", ttl, chained=True, end=_last)
    found = found.withColumn("slot", F.when(F.col("kind") == "recv", F.col("range")).otherwise(-1))
    return _state(found, ["logdir", "slot"], _carried, "policy boolean, auth_user string", SESSION + ", range long, slot long", ttl, chained=True).drop("range", "slot")


def smtp_messages(
    smtp: DataFrame, default_direction: str = "in", envelope_fallback: bool = False, clock: Column | None = None, ttl: str = DAY, size: int = RANGE
) -> DataFrame:
    """The stream form of assemble.smtp_messages. smtp: parse_smtp's columns with logdir, seq, ts."""
    rows = _clocked(smtp, clock).filter("kind in ('connect', 'scan', 'recv', 'close') or (kind = 'policy' and authenticated)").select(
        "logdir", "seq", "at", "ms", "us", "kind", "pid", F.col("local_port").alias("port"), F.col("client_ip").alias("ip"), F.col("spam_score").alias("score"),
        "verdict", F.substring("subject", 1, SUBJECT).alias("subject"), "sender", "qp", "auth_user",
    )
    by = credited(rows.filter("kind in ('recv', 'policy')"), ttl, size)
    out = _state(
        by.unionByName(rows.filter("kind in ('connect', 'scan', 'close')")), ["logdir", "pid"],
        partial(_session, default_direction=default_direction, envelope_fallback=envelope_fallback),
        "ip string, port int, score double, verdict string, subject string",
        MESSAGE, ttl,
    )
    return out.select(
        "logdir", "seq", "qp", TIME("us").alias("ts"), "direction", fold(F.col("sender")).alias("sender"), fold(F.col("auth_user")).alias("auth_user"),
        "auth_source", "client_ip", "spam_score", "verdict", "subject",
    )


def state_sizes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """logdir, bytes of the state that a stream of this module keeps, read from its checkpoint: parser_state's columns.

    Bytes are those of keys and values as JSON. A checkpoint without keyed state gives no rows.
    """
    kept = spark.read.format("state-metadata").load(checkpoint).filter("operatorName like 'transformWithState%'").select("operatorId").distinct()
    out = spark.createDataFrame([], "logdir string, bytes long")
    for row in kept.collect():  # a stream's operators
        state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", row.operatorId).option("stateVarName", "value").load()
        size = F.octet_length(F.to_json(F.struct("key", "value")))
        out = out.unionByName(state.groupBy("key.logdir").agg(F.sum(size).cast("long").alias("bytes")))
    return out.groupBy("logdir").agg(F.sum("bytes").alias("bytes"))
