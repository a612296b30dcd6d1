"""Log lines to fields, as column expressions. Each function adds ``kind`` and the fields of its log.

The first pattern that fits decides the kind; fields that a kind lacks are null, and a line
that fits none has a null kind. Input: a text column; numbers that do not fit are null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import DateTimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.text import fold

# The formats of the logs, a field for each group.
SEND = {
    "info": (r"^info msg ([0-9]+): bytes ([0-9]+) from <([^>]*)> qp ([0-9]+) uid ([0-9]+)", "msg_id:long bytes:long sender qp:long uid:long"),
    "starting": (r"^starting delivery ([0-9]+): msg ([0-9]+) to (local|remote) (\S+)", "delivery_id:long msg_id:long route recipient"),
    "outcome": (r"(?s)^delivery ([0-9]+): (success|deferral|failure): ([^\n]*)$", "delivery_id:long result detail"),
    "end": (r"^end msg ([0-9]+)", "msg_id:long"),
    "concurrency": (r"^status: local ([0-9]+)/([0-9]+) remote ([0-9]+)/([0-9]+)", "local_used:long local_max:long remote_used:long remote_max:long"),
}
SMTP = {
    "connect": (r"^tcpserver: ok ([0-9]+) \S+?:[0-9.]+:([0-9]+) :([0-9a-fA-F.:]+)::[0-9]+\s*$", "pid:long local_port:int client_ip"),
    "recv": (r"^mail recv: pid ([0-9]+) from <([^>]*)> qp ([0-9]+)", "pid:long sender qp:long"),
    "policy": (r"^policy_check: \w+ (\S+) -> \w+ (\S+)( \(AUTHENTICATED SENDER\))?", "auth_user recipient authenticated:mark"),
    "scan": (
        r"(?s)^simscan:\[([0-9]+)\]:([A-Z]+) \((-?[0-9.]+)/[0-9.]+\):[0-9.]+s:(.*):([^:]*):([^:]*):([^:]*)$",
        "pid:long verdict spam_score:double subject client_ip sender recipient",
    ),
    "concurrency": (r"^tcpserver: status: ([0-9]+)/([0-9]+)", "used:long max:long"),
    "close": (r"^tcpserver: end ([0-9]+) status [0-9]+", "pid:long"),
    "open": (r"^tcpserver: pid ([0-9]+) from ([0-9a-fA-F.:]+)", "pid:long client_ip"),
}
#: A scan line whose tail has too few fields is no line of any kind.
SCAN_HEAD = r"^simscan:\[[0-9]+\]:[A-Z]+ \(-?[0-9.]+/[0-9.]+\):[0-9.]+s:"
LOGIN = r"(?s)^([A-Z][a-z]{2})\s+([0-9]{1,2})\s+([0-9]{2}):([0-9]{2}):([0-9]{2})\s+(imap|pop3|submission)-login: \w+: ([^\n]*)$"
ANY_LOGIN = r"^[A-Z][a-z]{2}\s+[0-9]{1,2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}\s+\S+?[:(]"
BAN = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})\s+([0-9]{2}:[0-9]{2}:[0-9]{2})[,.][0-9]+\s+fail2ban\.actions\s*\[[0-9]+\]:\s*\w+\s+\[([^\]]+)\]\s+(Ban|Unban|Restore Ban)\s+([0-9a-fA-F:.]+)\s*$"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _classified(rows: DataFrame, text: str, kinds: dict[str, tuple[str, str]], never: Column) -> DataFrame:
    line = F.col(text)
    tests = list(kinds.items())
    kind = reduce(lambda c, x: c.when(line.rlike(x[1][0]), x[0]), tests[1:], F.when(never, None).when(line.rlike(tests[0][1][0]), tests[0][0]))
    rows = rows.withColumn("kind", kind)
    fields: dict[str, list[tuple[str, Column]]] = {}
    for name, (pattern, spec) in kinds.items():
        for i, field in enumerate(spec.split(), 1):
            field, _, type_ = field.partition(":")
            value = F.regexp_extract(line, pattern, i)
            value = (value != "") if type_ == "mark" else value.try_cast(type_) if type_ else value
            fields.setdefault(field, []).append((name, value))
    columns = {f: reduce(lambda c, x: c.when(F.col("kind") == x[0], x[1]), v[1:], F.when(F.col("kind") == v[0][0], v[0][1])) for f, v in fields.items()}
    return rows.withColumns(columns)


def parse_send(rows: DataFrame, text: str = "text") -> DataFrame:
    return _classified(rows, text, SEND, F.col(text).isNull())


def parse_smtp(rows: DataFrame, text: str = "text") -> DataFrame:
    whole = F.col(text).rlike(SMTP["scan"][0])
    return _classified(rows, text, SMTP, F.col(text).isNull() | (F.col(text).rlike(SCAN_HEAD) & ~whole))


def login_result(rest: Column) -> Column:
    return F.when(F.startswith(rest, F.lit("Login:")), "login").when(rest.contains("auth failed"), "auth_failed").when(rest.contains("no auth attempts"), "no_auth")


def known_zone(spark: SparkSession, zone: str | None) -> str:
    """zone, or UTC if it is none that the JVM knows."""
    try:
        return spark.sparkContext._jvm.java.time.ZoneId.of(zone or "UTC").getId()
    except DateTimeException:
        return "UTC"


def parse_login(rows: DataFrame, year: Column | int, now: Column, zone: str = "UTC", text: str = "line") -> DataFrame:
    """ts (UTC, without zone), service, result, user, client_ip, method, tls; null result for other lines.

    The year is an estimate: a date that it lacks is taken from a year nearby, and one more
    than a day ahead of now from the year before. A zone that isn't known is UTC.
    """
    zone = known_zone(rows.sparkSession, zone)
    line, year = F.col(text), year if isinstance(year, Column) else F.lit(year)
    part = lambda i: F.regexp_extract(line, LOGIN, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(1))

    def dated(y: Column) -> Column:
        tries = [
            F.try_make_timestamp(y + d, month, part(2).try_cast("int"), part(3).try_cast("int"), part(4).try_cast("int"), part(5).try_cast("decimal(8,6)"), F.lit(zone))
            for d in (0, -1, 1, -2)
        ]
        return F.coalesce(*tries)

    rest, ts = part(7), dated(year)
    late = ts > now.cast("timestamp") + F.expr("INTERVAL 1 DAY")
    ts = F.when(late, F.coalesce(dated(F.year(ts) - 1), ts)).otherwise(ts)
    found = lambda p: F.nullif(F.regexp_extract(rest, p, 1), F.lit(""))
    return rows.withColumns({
        "ts": ts.cast("timestamp_ntz"), "service": F.nullif(part(6), F.lit("")),
        "result": F.when(line.rlike(LOGIN) & ts.isNotNull(), login_result(rest)),
        "user": F.nullif(fold(F.regexp_extract(rest, "user=<([^>]*)>", 1)), F.lit("")),
        "client_ip": found(r"\brip=([0-9a-fA-F.:]+)"), "method": found(r"\bmethod=([A-Za-z0-9-]+)"),
        "tls": rest.contains(", TLS") | F.endswith(rest, F.lit("TLS")), "readable": line.rlike(ANY_LOGIN),
    })


def parse_ban(rows: DataFrame, text: str = "line") -> DataFrame:
    """ts (as written), jail, ip, action (ban or unban); null action for other lines."""
    line = F.trim(F.col(text))
    part: Callable[[int], Column] = lambda i: F.nullif(F.regexp_extract(line, BAN, i), F.lit(""))
    return rows.withColumns({
        "ts": F.to_timestamp_ntz(F.concat_ws(" ", part(1), part(2)), F.lit("yyyy-MM-dd HH:mm:ss")), "jail": part(3), "ip": part(5),
        "action": F.when(F.endswith(part(4), F.lit("Ban")), "ban").when(part(4).isNotNull(), "unban"),
    })
