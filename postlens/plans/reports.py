"""The dashboard's questions as DataFrames.

Each function takes the fact tables it needs and a half-open time range; ranges and column
lists reach the scans. Tables: message(msg_id, ts, queue_ts, direction, sender,
sender_domain, auth_user, size_bytes, client_ip, spam_score, verdict, subject),
delivery(msg_id, msg_ts, ts, recipient, recipient_domain, route, result, detail, remote_ip,
remote_code, remote_status, reason), auth_event, ban_event, queue_minute, service_minute.
A message instance is (msg_id, queue_ts), as queue numbers are used again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.functions import text as T
from postlens.operators.merge import UNKNOWN_INSTANCE

BUCKETS = {
    "day": lambda ts: F.date_format(ts, "yyyy-MM-dd"),
    "hour": lambda ts: F.date_format(ts, "yyyy-MM-dd HH:00"),
    "week": T.week,
}
SPAM_SCORE = 5.0


def bucket(name: str, ts: Column | str) -> Column:
    """KeyError for an unknown bucket."""
    return BUCKETS[name](F.col(ts) if isinstance(ts, str) else ts)


def between(rows: DataFrame, since: str, until: str, ts: str = "ts") -> DataFrame:
    return rows.filter((F.col(ts) >= F.lit(since).cast("timestamp_ntz")) & (F.col(ts) < F.lit(until).cast("timestamp_ntz")))


def total(condition: Column | str) -> Column:
    return F.sum((F.expr(condition) if isinstance(condition, str) else condition).cast("long"))


def outcomes() -> list[Column]:
    return [total("result = 'success'").alias("successes"), total("result = 'deferral'").alias("deferrals"), total("result = 'failure'").alias("failures")]


def real(delivery: DataFrame) -> DataFrame:
    return delivery.filter(F.col("recipient") != T.NOWHERE)


def summary(message: DataFrame, delivery: DataFrame, since: str, until: str) -> DataFrame:
    """One row: messages and bytes by direction, attempts by result, rates, and bounces nobody can get."""
    m = between(message, since, until).agg(
        total("direction = 'in'").alias("messages_in"), total("direction = 'out'").alias("messages_out"),
        F.sum(F.when(F.col("direction") == "in", F.col("size_bytes"))).alias("bytes_in"), F.sum(F.when(F.col("direction") == "out", F.col("size_bytes"))).alias("bytes_out"),
    )
    d, good = between(delivery, since, until), F.col("recipient") != T.NOWHERE
    a = d.agg(
        total(good).alias("attempts"), total(good & (F.col("result") == "success")).alias("successes"), total(good & (F.col("result") == "deferral")).alias("deferrals"),
        total(good & (F.col("result") == "failure")).alias("failures"), total(good & (F.col("route") == "remote")).alias("remote_attempts"),
        total(good & (F.col("route") == "remote") & (F.col("result") == "success")).alias("remote_successes"), total(~good).alias("discarded"),
    )
    peak = d.filter(~good).groupBy(F.to_date("ts").alias("day")).count()
    peak = peak.agg(F.max_by(F.struct("day", "count"), F.struct("count", F.negative(F.unix_date("day")))).alias("p"))
    one = F.lit(1).alias("one")  # three frames of one row each
    both = m.select("*", one).join(a.select("*", one), "one").join(peak.select("p", one), "one")
    return both.select(
        *m.columns, *a.columns, T.rate(F.col("successes"), F.col("attempts")).alias("success_rate"),
        T.rate(F.col("remote_successes"), F.col("remote_attempts")).alias("outbound_rate"), F.col("p.day").cast("string").alias("discarded_peak_day"), F.col("p.count").alias("discarded_peak"),
    )


def timeseries(message: DataFrame, since: str, until: str, by: str = "day") -> DataFrame:
    rows = between(message, since, until).groupBy(bucket(by, "ts").alias("bucket"))
    return rows.agg(total("direction = 'in'").alias("messages_in"), total("direction = 'out'").alias("messages_out")).orderBy("bucket")


def top_senders(message: DataFrame, since: str, until: str, limit: int = 20) -> DataFrame:
    rows = between(message, since, until).filter("direction = 'out' and auth_user is not null").groupBy("auth_user")
    return rows.agg(F.count(F.lit(1)).alias("messages"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("messages"), "auth_user").limit(limit)


def top_recipients(delivery: DataFrame, since: str, until: str, limit: int = 20) -> DataFrame:
    rows = real(between(delivery, since, until)).filter("route = 'remote'").groupBy("recipient_domain")
    return rows.agg(F.count(F.lit(1)).alias("attempts"), *outcomes()).orderBy(F.desc("attempts"), "recipient_domain").limit(limit)


def per_domain(message: DataFrame, since: str, until: str) -> DataFrame:
    rows = between(message, since, until).groupBy(F.col("sender_domain").alias("domain"), "direction")
    return rows.agg(F.count(F.lit(1)).alias("messages"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("messages"), "domain", "direction")


def mailboxes(message: DataFrame, delivery: DataFrame, since: str, until: str, limit: int = 100) -> DataFrame:
    sent = between(message, since, until).filter("direction = 'out' and auth_user is not null").groupBy(F.col("auth_user").alias("address"))
    got = between(delivery, since, until).filter("route = 'local' and result = 'success'").groupBy(F.col("recipient").alias("address"))
    both = sent.agg(F.count(F.lit(1)).alias("sent"), F.lit(0).cast("long").alias("received")).unionByName(
        got.agg(F.lit(0).cast("long").alias("sent"), F.count(F.lit(1)).alias("received"))
    )
    out = both.groupBy("address").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"))
    return out.orderBy(F.desc(F.col("sent") + F.col("received")), "address").limit(limit)


def joined(message: DataFrame, delivery: DataFrame, how: str = "inner") -> DataFrame:
    """Deliveries with their message instance; an unknown instance (the epoch) joins none.

    The first and last instance of the deliveries, asked for beforehand, bound the messages
    that are read: a range of deliveries may reach back some days, but not to all of history.
    """
    known = delivery.filter(F.col("msg_ts") > F.lit(UNKNOWN_INSTANCE).cast("timestamp_ntz"))
    first, last = known.agg(F.min("msg_ts"), F.max("msg_ts")).first()
    message = message.filter((F.col("queue_ts") >= F.lit(first)) & (F.col("queue_ts") <= F.lit(last)) if first else F.lit(False))
    m = message.withColumnsRenamed({"ts": "message_ts", "queue_ts": "msg_ts"})
    return delivery.join(m, ["msg_id", "msg_ts"], how)


def mailbox_outcomes(message: DataFrame, delivery: DataFrame, since: str, until: str, address: str) -> DataFrame:
    """One row for a mailbox: mail sent and received, its attempts by result and their rate."""
    who = address.strip().lower()
    m = between(message, since, until).filter(F.col("auth_user") == who).agg(F.count(F.lit(1)).alias("sent"))
    d = between(delivery, since, until)
    got = d.filter((F.col("recipient") == who) & (F.col("route") == "local") & (F.col("result") == "success")).agg(F.count(F.lit(1)).alias("received"))
    tried = joined(message.filter(F.col("auth_user") == who), d).agg(F.count(F.lit(1)).alias("attempts"), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(outcomes(), ("successes", "deferrals", "failures"), strict=True)])
    one = F.lit(1).alias("one")
    out = m.select("*", one).join(got.select("*", one), "one").join(tried.select("*", one), "one").drop("one")
    return out.withColumn("success_rate", T.rate(F.col("successes"), F.col("attempts")))


def mailbox_sent_to(message: DataFrame, delivery: DataFrame, since: str, until: str, address: str, limit: int = 20) -> DataFrame:
    rows = joined(message.filter(F.col("auth_user") == address.strip().lower()), between(delivery, since, until))
    return rows.groupBy("recipient").agg(F.count(F.lit(1)).alias("attempts"), *outcomes()).orderBy(F.desc("attempts"), "recipient").limit(limit)


def mailbox_received_from(message: DataFrame, delivery: DataFrame, since: str, until: str, address: str, limit: int = 20) -> DataFrame:
    d = between(delivery, since, until).filter((F.col("recipient") == address.strip().lower()) & (F.col("route") == "local"))
    return joined(message, d).groupBy("sender").agg(F.count(F.lit(1)).alias("messages")).orderBy(F.desc("messages"), "sender").limit(limit)


def outcomes_timeseries(delivery: DataFrame, since: str, until: str, by: str = "day") -> DataFrame:
    return real(between(delivery, since, until)).groupBy(bucket(by, "ts").alias("bucket")).agg(*outcomes()).orderBy("bucket")


def hourly_profile(message: DataFrame, since: str, until: str) -> DataFrame:
    rows = between(message, since, until).groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour"))
    return rows.agg(F.count(F.lit(1)).alias("messages")).orderBy("weekday", "hour")


def spam_per_account(message: DataFrame, delivery: DataFrame, since: str, until: str, limit: int = 100, threshold: float = SPAM_SCORE) -> DataFrame:
    """Mail that was scanned, by mailbox. A missing score or label makes neither spam nor clean unless the other decides."""
    is_spam = (F.col("verdict") == "SPAM") | (F.col("spam_score") >= threshold)
    rows = joined(message, between(delivery, since, until)).filter("route = 'local' and direction = 'in' and (verdict is not null or spam_score is not null)")
    out = rows.groupBy(F.col("recipient").alias("address")).agg(
        total(is_spam).alias("spam"), total(~is_spam).alias("clean"), F.count(F.lit(1)).alias("scanned"), F.max("spam_score").alias("worst_score")
    )
    out = out.withColumn("spam_rate", T.rate(F.coalesce("spam", F.lit(0)), F.col("scanned")))
    return out.orderBy(F.desc("spam"), F.desc("scanned"), "address").limit(limit)


def failure_reasons(message: DataFrame, delivery: DataFrame, since: str, until: str, limit: int = 25) -> DataFrame:
    """Reasons with attempts, distinct messages, senders, recipients and domains, and the three first domains of either side.

    Attempts are summed by reason and value first, for all kinds of values at once, so every
    distinct count is a plain count of sums, and a hot reason is spread by its values.
    """
    rows = joined(message, real(between(delivery, since, until)).filter("result <> 'success'"), "left")
    key = ["result", "code", "status", "reason"]
    text = lambda c: F.col(c).cast("string")
    values = {
        "messages": F.concat(text("msg_id"), F.lit(" "), text("msg_ts")), "senders": F.coalesce("auth_user", "sender"), "recipients": F.col("recipient"),
        "domains": F.col("recipient_domain"), "sender_domains": F.col("sender_domain"),
    }
    pairs = rows.select(
        "result", F.col("remote_code").alias("code"), F.col("remote_status").alias("status"), F.coalesce("reason", "detail").alias("reason"), "ts",
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()])).alias("x"),
    ).select(*key, "ts", "x.*")
    sums = pairs.groupBy(*key, "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("seen"))
    # The three first values of each of some parts of a reason's values hold the three first of all.
    part = Window.partitionBy(*key, "kind", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(F.asc_nulls_last("value"))
    sums = sums.withColumn("rank", F.row_number().over(part))
    held = lambda kind: (F.col("kind") == kind) & F.col("value").isNotNull()
    first3 = lambda kind: F.array_join(F.slice(F.sort_array(F.collect_list(F.when(held(kind) & (F.col("rank") <= 3), F.col("value")))), 1, 3), ", ")
    out = sums.groupBy(*key).agg(
        F.sum(F.when(F.col("kind") == "recipients", F.col("n"))).alias("attempts"), *[F.count_if(held(k)).alias(k) for k in list(values)[:4]],
        first3("domains").alias("sample_domains"), first3("sender_domains").alias("sample_senders"), F.max("seen").alias("last_seen"),
    )
    return out.orderBy(F.desc("attempts"), *key).limit(limit)


def domain_flow(message: DataFrame, delivery: DataFrame, since: str, until: str, limit: int = 50) -> DataFrame:
    rows = joined(message.select("msg_id", "ts", "queue_ts", "sender_domain"), real(between(delivery, since, until)))
    out = rows.groupBy("sender_domain", "recipient_domain").agg(F.count(F.lit(1)).alias("attempts"), *outcomes())
    return out.orderBy(F.desc("attempts"), "sender_domain", "recipient_domain").limit(limit)


def concurrency(queue_minute: DataFrame, since: str, until: str) -> DataFrame:
    return between(queue_minute, since, until, "minute").orderBy("minute")


def connections(service_minute: DataFrame, since: str, until: str) -> DataFrame:
    out = between(service_minute, since, until, "minute").groupBy("service").agg(
        F.sum("connects").alias("connects"), F.sum("messages").alias("messages"), F.max("max_concurrency").alias("peak"), F.max("limit_value").alias("limit_value")
    )
    return out.withColumn("sessions_without_mail", F.greatest(F.col("connects") - F.col("messages"), F.lit(0).cast("long"))).orderBy(F.desc("connects"), "service")


def mailbox_access(auth_event: DataFrame, since: str, until: str, limit: int = 100) -> DataFrame:
    rows = between(auth_event, since, until).filter("result = 'login' and user_name is not null").groupBy(F.col("user_name").alias("address"), "service")
    out = rows.agg(F.count(F.lit(1)).alias("logins"), F.count_distinct("client_ip").alias("addresses"), F.max("ts").alias("last_seen"))
    return out.orderBy(F.desc("logins"), "address", "service").limit(limit)


def latest_action(ban_event: DataFrame) -> DataFrame:
    """ip, action: the last action on each address, of all times; of equal times the ban."""
    return ban_event.groupBy("ip").agg(F.max_by("action", F.struct("ts", F.col("action") == "ban")).alias("action"))


def auth_failures(auth_event: DataFrame, ban_event: DataFrame, since: str, until: str, limit: int = 50) -> DataFrame:
    rows = between(auth_event, since, until).filter("result = 'auth_failed' and client_ip is not null").groupBy("client_ip")
    top = rows.agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("user_name").alias("accounts_tried"), F.max("ts").alias("last_seen"))
    top = top.orderBy(F.desc("failures"), "client_ip").limit(limit)
    last = latest_action(ban_event).withColumnRenamed("ip", "client_ip")
    return top.join(last, "client_ip", "left").withColumn("blocked", T.block_state(F.col("action"))).drop("action").orderBy(F.desc("failures"), "client_ip")


def access_summary(auth_event: DataFrame, since: str, until: str) -> DataFrame:
    login = F.col("result") == "login"
    return between(auth_event, since, until).groupBy("service").agg(
        total(login).alias("logins"), total("result = 'auth_failed'").alias("failures"), total("result = 'no_auth'").alias("scans"),
        F.count_distinct(F.when(login, F.col("user_name"))).alias("accounts"),
    ).orderBy(F.desc("logins"), "service")


def chains(delivery: DataFrame, since: str, until: str) -> DataFrame:
    """All attempts to bring one message instance to one recipient, in one row."""
    rows = real(between(delivery, since, until)).groupBy("msg_id", "msg_ts", "recipient")
    return rows.agg(
        F.count(F.lit(1)).alias("attempts"), F.min("ts").alias("first_try"), F.max("ts").alias("last_try"), F.max(F.col("result") == "success").alias("delivered"),
        F.max(F.col("result") == "failure").alias("bounced"), F.max(F.when(F.col("reason").isNotNull(), F.struct("ts", "reason")))["reason"].alias("reason"),
    )


def retry_summary(delivery: DataFrame, since: str, until: str) -> DataFrame:
    """One row; minutes_to_delivery is the mean of whole minutes from the first to the last try of delivered chains."""
    minutes = F.timestamp_diff("MINUTE", F.col("first_try"), F.col("last_try"))
    return chains(delivery, since, until).agg(
        total("delivered and attempts = 1").alias("delivered_first_attempt"), total("delivered and attempts > 1").alias("delivered_after_retry"),
        total("not delivered and bounced").alias("bounced"), total("not delivered and not bounced").alias("still_trying"), F.count(F.lit(1)).alias("chains"),
        F.round(F.avg(F.when(F.col("delivered"), minutes)), 4).alias("minutes_to_delivery"),
    )


def stuck_deliveries(delivery: DataFrame, since: str, until: str, now: str, limit: int = 50) -> DataFrame:
    rows = chains(delivery, since, until).filter("not delivered and not bounced")
    waiting = F.timestamp_diff("HOUR", F.col("first_try"), F.lit(now).cast("timestamp_ntz"))
    return rows.select("msg_id", "recipient", "attempts", "first_try", "last_try", "reason", waiting.alias("hours_waiting")).orderBy(
        F.desc("attempts"), "first_try", "msg_id", "recipient"
    ).limit(limit)


def looks_like_demo_data(message: DataFrame) -> DataFrame:
    """One row: whether a sender's domain is one that is kept for examples."""
    example = F.col("sender_domain").isin("example.com", "example.net") | F.endswith("sender_domain", F.lit(".example"))
    return message.filter(example).limit(1).agg((F.count(F.lit(1)) > 0).alias("demo"))


def fold_aliases(rows: DataFrame, aliases: dict[str, str], key: str, group: list[str], order: list[Column]) -> DataFrame:
    """Rows of alias domains are added to those of the real domain: numbers are summed, other columns come from the first row."""
    if aliases:
        pairs = [F.lit(x) for kv in sorted(aliases.items()) for x in kv]
        rows = rows.withColumn(key, F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(key)), F.col(key)))
    numeric = {c for c, t in rows.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")}
    first = F.struct(*order)
    return rows.groupBy(*group).agg(*[(F.sum(c) if c in numeric else F.min_by(c, first)).alias(c) for c in rows.columns if c not in group])


def aliases_from_config(aliases: str) -> dict[str, str]:
    """alias -> real domain of text like `alias:real, alias:real`, in lower case; what lacks either is left out."""
    pairs = [[x.strip().lower() for x in item.split(":", 1)] for item in aliases.split(",") if ":" in item]
    return {alias: name for alias, name in pairs if alias and name}


def blocked_summary(ban_event: DataFrame, since: str, until: str) -> DataFrame:
    rows = between(ban_event, since, until)
    a = rows.agg(F.count(F.lit(1)).alias("actions"), F.count_distinct("ip").alias("addresses"))
    still = rows.select("ip").distinct().join(latest_action(ban_event).filter("action = 'ban'"), "ip", "left_semi").agg(F.count(F.lit(1)).alias("still_blocked"))
    one = F.lit(1).alias("one")
    return a.select("*", one).join(still.select("*", one), "one").drop("one")


def blocked_addresses(ban_event: DataFrame, since: str, until: str, limit: int = 100) -> DataFrame:
    rows = between(ban_event, since, until).filter("action = 'ban'").groupBy("ip")
    out = rows.agg(
        F.count(F.lit(1)).alias("times"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.array_join(F.sort_array(F.collect_set("jail")), ", ").alias("jails")
    )
    return out.orderBy(F.desc("times"), "ip").limit(limit)


def blocked_by_jail(ban_event: DataFrame, since: str, until: str) -> DataFrame:
    rows = between(ban_event, since, until).filter("action = 'ban'").groupBy("jail")
    return rows.agg(F.count(F.lit(1)).alias("bans"), F.count_distinct("ip").alias("addresses")).orderBy(F.desc("bans"), "jail")


def failure_detail(message: DataFrame, delivery: DataFrame, since: str, until: str, address: str | None = None, limit: int = 200) -> DataFrame:
    """The last failed attempts with the far end's words and whose problem they describe."""
    rows = joined(message, real(between(delivery, since, until)).filter("result <> 'success'"), "left")
    if address:
        who = address.strip().lower()[:320]
        rows = rows.filter((F.col("auth_user") == who) | (F.col("sender") == who) | (F.col("recipient") == who))
    rows = rows.select(
        "ts", "result", "recipient", "recipient_domain", "route", F.coalesce("auth_user", "sender").alias("sender"), "sender_domain", "size_bytes", "client_ip", "subject",
        "remote_ip", "remote_code", "remote_status", F.coalesce("reason", "detail").alias("reason"), "detail", "msg_id",
    ).orderBy(F.desc("ts"), "msg_id", "recipient").limit(limit)
    said = F.coalesce(F.nullif(T.readable_detail(F.col("detail")), F.lit("")), F.col("reason"))
    rows = rows.withColumn("said", said)
    return rows.withColumn("side", T.failure_side(F.col("result"), F.col("remote_code"), F.col("said"), F.col("route"))).drop("msg_id")
