"""Mail tables derived from the tables of a data folder, which holds no mail logs.

``tables`` builds them with the library's own functions (addresses are folded, details are
parsed); ``PREFIX`` states them as SQL with the expected fields spelled out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions import text as T

SINCE, UNTIL, NOW = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-01-31 00:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("event_id % 4 = 0").selectExpr(
        "cast(floor(event_id / 4) as bigint) as msg_id", "ts", "ts as queue_ts",
        "case when user_id % 3 = 0 then 'in' else 'out' end as direction",
        "concat(' U', user_id, '@Dom', user_id % 12, '.Test ') as sender",
        "case when user_id % 3 <> 0 then concat('u', user_id, '@dom', user_id % 12, '.test') end as auth_user",
        "cast(floor(value * 1000) as bigint) as size_bytes",
        "case when event_id % 28 <> 0 then value / 4.0 - 3.0 end as spam_score",
        "case when event_id % 28 = 0 then null when event_id % 20 = 0 then 'SPAM' else 'CLEAN' end as verdict",
        "concat('192.0.2.', user_id % 50) as client_ip", "concat('subject ', event_id % 9) as subject",
    )
    rows = rows.withColumn("sender", T.fold(F.col("sender")))
    return rows.withColumn("sender_domain", T.domain_of(F.col("sender")))


def delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = message(spark, sf_dir).select("msg_id", F.col("queue_ts").alias("msg_ts"), "direction")
    e = events(spark, sf_dir).selectExpr("cast(floor(event_id / 4) as bigint) as msg_id", "event_id", "ts", "event_type", "user_id")
    rows = e.join(m, "msg_id").selectExpr(
        "msg_id", "msg_ts", "ts", "event_id",
        "case when event_id % 97 = 0 then '#@[]' when direction = 'in' then concat('dst', msg_id % 15, '.test-r', msg_id % 150, case when event_id % 4 = 3 then 'b' else 'a' end, '@dst', msg_id % 15, '.test') else concat('r', msg_id % 150, case when event_id % 4 = 3 then 'b' else 'a' end, '@dst', msg_id % 15, '.test') end as recipient",
        "case when direction = 'in' then 'local' else 'remote' end as route",
        "case event_type when 'error' then 'failure' when 'signup' then 'deferral' when 'view' then 'deferral' else 'success' end as result",
        """case when event_type not in ('error', 'signup', 'view') then 'done' else case event_id % 6
          when 0 then concat('192.0.2.', user_id % 50, '_does_not_like_recipient./Remote_host_said:_550_5.1.1_User_unknown_in_table/Giving_up_on_192.0.2.', user_id % 50, './')
          when 1 then concat('192.0.2.', user_id % 50, '_does_not_like_recipient./Remote_host_said:_451_4.7.1_IP_Reputation_Greylisted_n_', event_id % 90, '/Giving_up_on_192.0.2.', user_id % 50, './')
          when 2 then 'Sorry,_no_mailbox_here_by_that_name._(#5.1.1)/'
          when 3 then '198.51.100.7_failed_after_I_sent_the_message./Remote_host_said:_554_5.7.1_Blocked_-_see_https://x.example/a_b/'
          when 4 then 'Connected_to_203.0.113.9_but_connection_died._(#4.4.2)/' end end as detail""",
    )
    return delivery_fields(rows)


def delivery_fields(rows: DataFrame) -> DataFrame:
    """Folds recipients and reads details; a success has no cause to read."""
    folded = T.fold(F.col("recipient"))
    rows = rows.withColumn("recipient", F.when(F.col("route") == "local", T.without_prefix(folded)).otherwise(folded))
    failed = (F.col("result") != "success") & (F.col("detail") != "")
    return rows.withColumns({
        "recipient_domain": T.domain_of(F.col("recipient")), "remote_ip": F.when(failed, T.detail_ip(F.col("detail"))),
        "remote_code": F.when(failed, T.detail_code(F.col("detail"))), "remote_status": F.when(failed, T.detail_status(F.col("detail"))),
        "reason": F.when(failed, T.detail_reason(F.col("detail"))),
    })


def auth_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(
        "event_id as id", "ts", "case user_id % 3 when 0 then 'imap' when 1 then 'pop3' else 'submission' end as service",
        "case when event_type <> 'view' then concat('u', user_id) end as user_name", "concat('192.0.2.', user_id % 50) as client_ip",
        "case event_type when 'error' then 'auth_failed' when 'view' then 'no_auth' when 'signup' then 'auth_failed' else 'login' end as result",
    )


def ban_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_id % 10 = 0").selectExpr(
        "event_id", "ts", "concat('jail', user_id % 4) as jail", "concat('192.0.2.', user_id % 50) as ip",
        "case when event_type = 'view' then 'unban' else 'ban' end as action",
    )


def queue_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(
        F.expr("cast(max(user_id % 10) as int)").alias("local_max_used"), F.lit(10).alias("local_limit"),
        F.expr("cast(max(user_id % 60) as int)").alias("remote_max_used"), F.lit(60).alias("remote_limit"),
    )


def service_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("service", F.expr("case user_id % 3 when 0 then 'smtp' when 1 then 'submission' else 'imap' end"))
    return rows.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "service").agg(
        F.count(F.lit(1)).alias("connects"), F.expr("count_if(event_type = 'purchase')").alias("messages"),
        F.expr("cast(max(user_id % 200) as int)").alias("max_concurrency"), F.lit(200).alias("limit_value"),
    )


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    made = (message, delivery, auth_event, ban_event, queue_minute, service_minute)
    return {f.__name__: f(spark, sf_dir) for f in made}


PREFIX = """WITH message AS (SELECT CAST(floor(event_id / 4) AS BIGINT) AS msg_id, ts, ts AS queue_ts,
  CASE WHEN user_id % 3 = 0 THEN 'in' ELSE 'out' END AS direction,
  concat('u', user_id, '@dom', user_id % 12, '.test') AS sender, concat('dom', user_id % 12, '.test') AS sender_domain,
  CASE WHEN user_id % 3 <> 0 THEN concat('u', user_id, '@dom', user_id % 12, '.test') END AS auth_user,
  CAST(floor(value * 1000) AS BIGINT) AS size_bytes,
  CASE WHEN event_id % 28 <> 0 THEN CAST(value AS DOUBLE) / 4.0 - 3.0 END AS spam_score,
  CASE WHEN event_id % 28 = 0 THEN NULL WHEN event_id % 20 = 0 THEN 'SPAM' ELSE 'CLEAN' END AS verdict,
  concat('192.0.2.', user_id % 50) AS client_ip, concat('subject ', event_id % 9) AS subject
  FROM events WHERE event_id % 4 = 0),
delivery AS (SELECT *, CASE WHEN bad AND k < 5 THEN [ip0, ip0, NULL, '198.51.100.7', '203.0.113.9'][k + 1] END AS remote_ip,
  CASE WHEN bad AND k < 5 THEN [550, 451, NULL, 554, NULL][k + 1] END AS remote_code,
  CASE WHEN bad AND k < 5 THEN ['5.1.1', '4.7.1', '5.1.1', '5.7.1', '4.4.2'][k + 1] END AS remote_status,
  CASE WHEN bad AND k < 5 THEN ['User unknown in table', 'IP Reputation Greylisted n #', 'Sorry, no mailbox here by that name.',
    'failed after I sent the message. Blocked - see https: x.example a b', 'Connected to but connection died.'][k + 1] END AS reason,
  CASE WHEN bad AND k < 5 THEN ['550 5.1.1 User unknown in table', concat('451 4.7.1 IP Reputation Greylisted n ', event_id % 90),
    'Sorry, no mailbox here by that name. (#5.1.1)', '198.51.100.7 failed after I sent the message./554 5.7.1 Blocked - see https://x.example/a b',
    'Connected to 203.0.113.9 but connection died. (#4.4.2)'][k + 1] END AS said,
  CASE WHEN NOT bad THEN NULL WHEN route = 'local' THEN 'our side' WHEN result = 'deferral' OR k = 1 THEN 'temporary'
    WHEN k = 0 THEN 'their side' WHEN k = 3 THEN 'check ours' ELSE 'unknown' END AS side
  FROM (SELECT m.msg_id, m.queue_ts AS msg_ts, e.ts, e.event_id, CAST(e.event_id % 6 AS INT) AS k, concat('192.0.2.', e.user_id % 50) AS ip0,
    CASE WHEN e.event_id % 97 = 0 THEN '#@[]' ELSE concat('r', m.msg_id % 150, CASE WHEN e.event_id % 4 = 3 THEN 'b' ELSE 'a' END, '@dst', m.msg_id % 15, '.test') END AS recipient,
    CASE WHEN e.event_id % 97 = 0 THEN '[]' ELSE concat('dst', m.msg_id % 15, '.test') END AS recipient_domain,
    CASE WHEN m.direction = 'in' THEN 'local' ELSE 'remote' END AS route,
    CASE e.event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'deferral' WHEN 'view' THEN 'deferral' ELSE 'success' END AS result,
    e.event_type IN ('error', 'signup', 'view') AS bad
    FROM events e JOIN message m ON m.msg_id = CAST(floor(e.event_id / 4) AS BIGINT))),
auth_event AS (SELECT event_id AS id, ts, CASE user_id % 3 WHEN 0 THEN 'imap' WHEN 1 THEN 'pop3' ELSE 'submission' END AS service,
  CASE WHEN event_type <> 'view' THEN concat('u', user_id) END AS user_name, concat('192.0.2.', user_id % 50) AS client_ip,
  CASE event_type WHEN 'error' THEN 'auth_failed' WHEN 'view' THEN 'no_auth' WHEN 'signup' THEN 'auth_failed' ELSE 'login' END AS result FROM events),
ban_event AS (SELECT event_id, ts, concat('jail', user_id % 4) AS jail, concat('192.0.2.', user_id % 50) AS ip,
  CASE WHEN event_type = 'view' THEN 'unban' ELSE 'ban' END AS action FROM events WHERE event_id % 10 = 0),
queue_minute AS (SELECT date_trunc('minute', ts) AS minute, CAST(max(user_id % 10) AS INT) AS local_max_used, CAST(10 AS INT) AS local_limit,
  CAST(max(user_id % 60) AS INT) AS remote_max_used, CAST(60 AS INT) AS remote_limit FROM events GROUP BY 1),
service_minute AS (SELECT date_trunc('minute', ts) AS minute, CASE user_id % 3 WHEN 0 THEN 'smtp' WHEN 1 THEN 'submission' ELSE 'imap' END AS service,
  count(*) AS connects, count(*) FILTER (event_type = 'purchase') AS messages, CAST(max(user_id % 200) AS INT) AS max_concurrency,
  CAST(200 AS INT) AS limit_value FROM events GROUP BY 1, 2)
"""
