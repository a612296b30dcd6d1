"""Invented mail tables, for trying things out: exchanges of letters between our accounts and partners of fixed habits. Names are those reserved for examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.plans.schema import conform
from postlens.sources.derived import delivery_fields

ACCOUNTS = ["iris@example.com", "noor@example.com", "tom@example.com", "desk@example.net"]
#: Partners and what their hosts do: take all, put off a first letter, know only some people, send in bulk.
PARTNERS = {"harbour.example": "takes", "museum.example": "puts_off", "press.example": "knows_few", "offers.example": "bulk"}
REFUSED = "203.0.113.40_does_not_like_recipient./Remote_host_said:_550_5.1.1_Nobody_here_by_that_name/Giving_up_on_203.0.113.40./"
PUT_OFF = "203.0.113.41_does_not_like_recipient./Remote_host_said:_451_4.7.1_Come_back_later/Giving_up_on_203.0.113.41./"
TAKEN = "did_1+0+0/"
GUESSER = "198.51.100.77"


def _after(ts: Column | str, seconds: Column | int) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def letters(spark: SparkSession, until: str, days: int, threads: int, seed: int) -> DataFrame:
    """One row a letter: exchanges begin all over the days, one to four letters each, the partner's first, half an hour apart."""
    span = days * 86_400 - 7_200
    rows = spark.range(days * threads).withColumn("h", F.xxhash64("id", F.lit(seed)))
    of = lambda values, shift: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.shiftright("h", shift), F.lit(len(values))).cast("int") + 1)
    rows = rows.withColumns({
        "begun": _after(F.date_sub(F.lit(until).cast("date"), days).cast("timestamp_ntz"), F.pmod("h", F.lit(span))),
        "account": of(ACCOUNTS, 8), "host": of(list(PARTNERS), 16), "person": F.pmod(F.shiftright("h", 24), F.lit(12)),
    })
    habit = F.create_map(*[F.lit(x) for pair in PARTNERS.items() for x in pair])[F.col("host")]
    length = F.when(habit == "bulk", 1).otherwise(F.pmod(F.shiftright("h", 32), F.lit(4)).cast("int") + 1)
    rows = rows.withColumns({"habit": habit, "n": F.explode(F.sequence(F.lit(0), length - 1))})
    return rows.withColumns({
        "out": F.col("n") % 2 == 1, "ts": _after("begun", F.col("n") * 1_800), "msg_id": F.col("id") * 4 + F.col("n") + 70_000,
        "partner": F.concat(F.lit("p"), F.col("person"), F.lit("@"), F.col("host")),
    })


def tables(spark: SparkSession, until: str, days: int = 15, threads: int = 60, seed: int = 11) -> dict[str, DataFrame]:
    """message, delivery, auth_event, ban_event, queue_minute and service_minute for the days before until (a date). The same seed gives the same rows."""
    sent = letters(spark, until, days, threads, seed)
    out, bulk = F.col("out"), F.col("habit") == "bulk"
    message = sent.withColumns({
        "qp": F.col("msg_id") - 60_000, "queue_ts": F.col("ts"), "direction": F.when(out, "out").otherwise("in"), "sender": F.when(out, F.col("account")).otherwise(F.col("partner")),
        "sender_domain": F.when(out, F.substring_index("account", "@", -1)).otherwise(F.col("host")), "auth_user": F.when(out, F.col("account")),
        "size_bytes": 900 * (F.col("n") + 1) + F.pmod("h", F.lit(41)) * 700, "client_ip": F.when(out, "192.0.2.10").otherwise("192.0.2.200"),
        "spam_score": F.when(~out, F.when(bulk, 8.5).otherwise(-1.0)), "verdict": F.when(bulk, "SPAM").otherwise("CLEAN"),
    })
    refused, put_off = out & (F.col("habit") == "knows_few") & (F.col("person") % 4 == 0), out & (F.col("habit") == "puts_off") & (F.col("n") == 1)
    one = lambda result, wait, said: F.struct(F.lit(result).alias("result"), F.lit(wait).alias("wait"), F.lit(said).alias("detail"))
    tries = F.when(refused, F.array(one("failure", 2, REFUSED))).when(put_off, F.array(one("deferral", 2, PUT_OFF), one("success", 600, TAKEN))).otherwise(F.array(one("success", 2, TAKEN)))
    tried = sent.select(
        "msg_id", F.col("ts").alias("msg_ts"), F.col("ts").alias("queued"), F.when(out, "remote").otherwise("local").alias("route"),
        F.when(out, F.col("partner")).otherwise(F.col("account")).alias("recipient"), F.inline(tries),
    ).withColumn("ts", _after("queued", F.col("wait")))
    logins = sent.filter("out").select(_after("ts", -60).alias("ts"), F.lit("login").alias("result"), F.col("account").alias("user_name"), F.lit("192.0.2.10").alias("client_ip"))
    night = spark.range(days).select(_after(F.date_sub(F.lit(until).cast("date"), F.col("id").cast("int") + 1).cast("timestamp_ntz"), 3 * 3_600).alias("at"))
    guesses = night.select(F.col("at"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select(
        _after("at", F.col("k") * 5).alias("ts"), F.lit("auth_failed").alias("result"), F.lit(ACCOUNTS[-1]).alias("user_name"), F.lit(GUESSER).alias("client_ip")
    )
    auth = logins.unionByName(guesses).withColumns({"service": F.lit("submission"), "method": F.lit("PLAIN"), "tls": F.lit(True)})
    bans = night.select(_after("at", 45).alias("ts"), F.lit("submission").alias("jail"), F.lit(GUESSER).alias("ip"), F.lit("ban").alias("action"))
    by_minute = sent.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"))
    queue = by_minute.agg(F.count_if(~out).alias("local_max_used"), F.count_if(out).alias("remote_max_used")).withColumns({"local_limit": F.lit(10), "remote_limit": F.lit(60)})
    service = sent.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), F.when(out, "submission").otherwise("smtp").alias("service")).agg(F.count(F.lit(1)).alias("messages"))
    service = service.withColumns({"connects": F.col("messages") + 1, "max_concurrency": F.col("messages"), "limit_value": F.lit(40)})
    made = {"message": message, "delivery": delivery_fields(tried), "auth_event": auth, "ban_event": bans, "queue_minute": queue, "service_minute": service}
    return {name: conform(rows, name) for name, rows in made.items()}
