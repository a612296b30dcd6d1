"""Alert rules: each a frame of at most one row (id, severity, title, detail, rank), relative to a given now."""

from __future__ import annotations

import shutil
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.functions.text import NOWHERE
from postlens.plans.reports import total

RANK = {"critical": 0, "serious": 1, "warning": 2}


@dataclass(frozen=True)
class Settings:
    """The limits' defaults."""

    discarded_bounces_per_hour: int = 200
    failure_rate_percent: int = 25
    failure_rate_minimum_attempts: int = 20
    stale_minutes: int = 10
    silent_minutes: int = 60
    auth_failures_per_hour: int = 150
    concurrency_percent: int = 90
    parser_state_kb: int = 1024
    disk_percent: int = 85
    cracked_account_failures: int = 5
    cracked_account_window_minutes: int = 60
    trusted_ips: tuple[str, ...] = ("127.0.0.1", "::1")
    disk_paths: tuple[str, ...] = ("/",)

    @classmethod
    def of(cls, config: dict[str, str]) -> Settings:
        """Settings from text; what is no number leaves the default."""
        out: dict[str, object] = {}
        for f in fields(cls):
            value = config.get(f.name)
            if value is None:
                continue
            if f.name in ("trusted_ips", "disk_paths"):
                out[f.name] = tuple(x.strip() for x in value.split(",") if x.strip())
                continue
            try:
                out[f.name] = int(value)
            except (TypeError, ValueError):
                pass
        return cls(**out)


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _last(rows: DataFrame, now: str, interval: str = "1 HOUR", ts: str = "ts") -> DataFrame:
    return rows.filter((F.col(ts) > _at(now) - F.expr(f"INTERVAL {interval}")) & (F.col(ts) <= _at(now)))


def _alert(rows: DataFrame, id_: str, severity: str, title: str, detail: Column) -> DataFrame:
    return rows.select(
        F.lit(id_).alias("id"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), detail.alias("detail"), F.lit(RANK[severity]).alias("rank")
    )


def bounce_storm(delivery: DataFrame, now: str, s: Settings) -> DataFrame:
    n = _last(delivery.filter(F.col("recipient") == NOWHERE), now).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= s.discarded_bounces_per_hour)
    return _alert(n, "bounce_storm", "critical", "Bounces that nobody can get", F.format_string("%d bounces were discarded within an hour.", "n"))


def delivery_failing(delivery: DataFrame, now: str, s: Settings) -> DataFrame:
    rows = _last(delivery.filter((F.col("route") == "remote") & (F.col("recipient") != NOWHERE)), now)
    n = rows.agg(F.count(F.lit(1)).alias("n"), total("result = 'failure'").alias("bad"))
    n = n.filter((F.col("n") >= s.failure_rate_minimum_attempts) & (F.col("bad") * 100.0 / F.col("n") >= s.failure_rate_percent))
    return _alert(n, "delivery_failing", "critical", "Outgoing mail is refused", F.format_string("%d of %d attempts failed within an hour.", "bad", "n"))


def parser_stalled(message: DataFrame, heartbeat: DataFrame | None, now: str, s: Settings) -> DataFrame:
    """By the age of the last heartbeat (column ts), or without one by that of the newest message; nothing without either."""
    beat = heartbeat.agg(F.max("ts").alias("beat")) if heartbeat is not None else message.limit(0).agg(F.max("ts").alias("beat"))
    newest = message.agg(F.max("ts").alias("newest"))
    one = F.lit(1).alias("one")
    age = lambda c: F.timestamp_diff("MINUTE", F.col(c), _at(now))
    rows = beat.select("*", one).join(newest.select("*", one), "one").select(
        F.when(F.col("beat").isNotNull(), age("beat")).otherwise(age("newest")).alias("age"),
        F.when(F.col("beat").isNotNull(), s.stale_minutes).otherwise(s.silent_minutes).alias("limit"),
    ).filter("age >= limit")
    return _alert(rows, "parser_stalled", "serious", "No news from the parser", F.format_string("The last sign is %d minutes old.", "age"))


def auth_guessing(auth_event: DataFrame, now: str, s: Settings) -> DataFrame:
    by = _last(auth_event.filter("result = 'auth_failed'"), now).groupBy("client_ip").agg(F.count(F.lit(1)).alias("k"))
    n = by.agg(F.sum("k").alias("n"), F.min(F.struct(F.negative("k").alias("k"), "client_ip")).alias("worst")).filter(F.col("n") >= s.auth_failures_per_hour)
    said = F.format_string("%d failed logins within an hour, %d of them from %s.", F.col("n"), F.negative("worst.k"), F.col("worst.client_ip"))
    return _alert(n, "auth_guessing", "serious", "Passwords are being guessed", said)


def queue_saturated(queue_minute: DataFrame, now: str, s: Settings) -> DataFrame:
    n = _last(queue_minute, now, ts="minute").agg(F.max("remote_max_used").alias("used"), F.max("remote_limit").alias("top"))
    n = n.filter((F.col("top") > 0) & (F.col("used") * 100.0 / F.col("top") >= s.concurrency_percent))
    return _alert(n, "queue_saturated", "warning", "The queue runs at its limit", F.format_string("%d of %d remote deliveries ran at once.", "used", "top"))


def _listed(rows: DataFrame, worst: str, *then: str, said: Column) -> DataFrame:
    """One row, said: the rows' texts, the greatest ``worst`` first; no row for none. The rows are accounts or logs that are past a limit."""
    each = F.struct(F.negative(worst).alias("a"), *then, said.alias("said"))
    one = rows.agg(F.sort_array(F.collect_list(each)).alias("l")).filter("size(l) > 0")
    return one.select(F.concat_ws("; ", F.transform("l", lambda x: x["said"])).alias("said"))


def parser_state_large(state: DataFrame, s: Settings) -> DataFrame:
    """state: logdir, bytes, as of keyed.state_sizes; all logs past the limit are named."""
    big = state.filter(F.col("bytes") > s.parser_state_kb * 1024)
    big = _listed(big, "bytes", "logdir", said=F.format_string("The state of %s takes %d KB", F.col("logdir"), F.expr("bytes div 1024")))
    return _alert(big, "parser_state_large", "serious", "The parser's state has grown", F.concat("said", F.lit(".")))


def cracked_accounts(auth_event: DataFrame, now: str, s: Settings) -> DataFrame:
    """user_name, client_ip, failures, seen: recent logins after failures of the same account from the same address within a week before."""
    recent = (F.col("ts") > _at(now) - F.expr(f"INTERVAL {s.cracked_account_window_minutes} MINUTE")) & (F.col("ts") <= _at(now))
    login = (F.col("result") == "login") & ~F.col("client_ip").isin(*s.trusted_ips) & recent
    # The recent logins bound the week of failures that is read.
    since = _at(now) - F.expr(f"INTERVAL {s.cracked_account_window_minutes} MINUTE") - F.expr("INTERVAL 7 DAY")
    rows = auth_event.filter((F.col("ts") > since) & F.col("user_name").isNotNull() & F.col("client_ip").isNotNull())
    rows = rows.select("id", "user_name", "client_ip", "ts", login.alias("login"), (F.col("result") == "auth_failed").alias("failed")).filter("login or failed")
    # Only the next login can be within a week of a failure if any is, and only the last failure before a login; neither is of the same time.
    seen = Window.partitionBy("user_name", "client_ip").rowsBetween(Window.unboundedPreceding, -1)
    next_login = F.last(F.when(F.col("login"), F.col("ts")), ignorenulls=True).over(seen.orderBy(F.desc("ts"), "login"))
    last_failure = F.last(F.when(F.col("failed"), F.col("ts")), ignorenulls=True).over(seen.orderBy("ts", F.desc("login")))
    rows = rows.withColumns({"next_login": next_login, "last_failure": last_failure})
    week = F.expr("INTERVAL 7 DAY")
    out = rows.groupBy("user_name", "client_ip").agg(
        F.count_distinct(F.when(F.col("failed") & (F.col("next_login") < F.col("ts") + week), F.col("id"))).alias("failures"),
        F.max(F.when(F.col("login") & (F.col("last_failure") > F.col("ts") - week), F.col("ts"))).alias("seen"),
    )
    return out.filter(F.col("failures") >= s.cracked_account_failures).filter("seen is not null")


def account_cracked(auth_event: DataFrame, now: str, s: Settings) -> DataFrame:
    """All accounts that were cracked are named."""
    said = F.format_string("%s logged in from %s after %d failed tries from there", "user_name", "client_ip", "failures")
    w = _listed(cracked_accounts(auth_event, now, s), "failures", "user_name", "client_ip", said=said)
    return _alert(w, "account_cracked", "critical", "A password was guessed", F.concat("said", F.lit(".")))


def disk_full(s: Settings, usage=shutil.disk_usage) -> list[tuple[str, str, str, str]]:
    """id, severity, title, detail of the paths' file systems that are too full, each once; paths that can't be read are left out.

    These are the driver's own disks.
    """
    out, seen = [], set()
    for p in s.disk_paths:
        try:
            total, used, free = usage(p)
        except OSError:
            continue
        if total and (total, free) not in seen:
            seen.add((total, free))
            percent = 100 * used / total
            if percent >= s.disk_percent:
                out.append((f"disk_full:{p}", "critical" if percent >= 95 else "serious", f"{p} is filling up", f"{percent:.0f} percent used, {free / 1e9:.1f} GB free."))
    return out


def evaluate(tables: dict[str, DataFrame], now: str, s: Settings | None = None) -> DataFrame:
    """All alerts that hold, worst first; those of the driver's disks are as of this call."""
    s = s or Settings()
    rules = [
        bounce_storm(tables["delivery"], now, s), delivery_failing(tables["delivery"], now, s), parser_stalled(tables["message"], tables.get("heartbeat"), now, s),
        auth_guessing(tables["auth_event"], now, s), queue_saturated(tables["queue_minute"], now, s), account_cracked(tables["auth_event"], now, s),
    ]
    if "parser_state" in tables:
        rules.append(parser_state_large(tables["parser_state"], s))
    full = disk_full(s)
    if full:
        disks = tables["delivery"].sparkSession.createDataFrame(full, "id string, severity string, title string, detail string")
        rules.append(disks.withColumn("rank", F.when(F.col("severity") == "critical", RANK["critical"]).otherwise(RANK["serious"])))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.orderBy("rank", "id")


def mail_text(raised: list[dict], host: str) -> tuple[str, str]:
    """Subject and body of the mail on alerts, worst first; the all-clear without any."""
    if not raised:
        return f"{host}: mail is well again", "No alert holds any more.\n"
    body = [f"{len(raised)} alerts hold on {host}.", ""]
    for a in raised:
        body += [f"[{a['severity']}] {a['title']}", f"    {a['detail']}"]
    return f"{host}: {raised[0]['severity']}: {raised[0]['title']}", "\n".join(body) + "\n"


#: Priorities of notifications.
PRIORITY = {"critical": 5, "serious": 4, "warning": 3}


def push_text(raised: list[dict], host: str = "") -> dict | None:
    """title, message, priority of one notification: the worst alert in full, the others as "also: title"; None without any."""
    if not raised:
        return None
    worst = raised[0]
    also = [f"also: {a['title']}" for a in raised[1:]]
    return {
        "title": f"{host}: {worst['title']}" if host else worst["title"], "message": "\n".join([worst["detail"], *([""] + also if also else [])]),
        "priority": PRIORITY.get(worst["severity"], 3),
    }


def changed(now: DataFrame, before: DataFrame) -> bool:
    """Whether the set of alert ids differs from the one stored before."""
    a, b = now.select("id").distinct(), before.select("id").distinct()
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
