"""The registered mail queries and their SQL. Every query runs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import lines, text as T
from postlens.operators import assemble, correlate, merge
from postlens.plans import alerts, digest, reports as R, rollup
from postlens.sources import derived as D

SINCE, UNTIL, NOW = D.SINCE, D.UNTIL, D.NOW
RANGE = f"ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}'"
WHO, LOCAL = "u7@dom7.test", "r3a@dst3.test"
#: Limits low enough that every alert rule speaks on the derived tables.
LIMITS = alerts.Settings(discarded_bounces_per_hour=0, failure_rate_percent=1, failure_rate_minimum_attempts=1, stale_minutes=1, silent_minutes=1,
                         auth_failures_per_hour=1, concurrency_percent=1, cracked_account_failures=1, cracked_account_window_minutes=60 * 24 * 31)
ALERT_NOW = "2024-01-20 00:00:00"
OUTCOMES = """count(*) FILTER (result = 'success')::BIGINT AS successes, count(*) FILTER (result = 'deferral')::BIGINT AS deferrals,
  count(*) FILTER (result = 'failure')::BIGINT AS failures"""

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None, prefix: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (D.PREFIX if prefix else "") + sql
        return f

    return add


def report(name: str, sql: str, call, *needs: str):
    makers = {f.__name__: f for f in (D.message, D.delivery, D.auth_event, D.ban_event, D.queue_minute, D.service_minute)}
    register(name, sql)(lambda spark, sf_dir: call(*[makers[n](spark, sf_dir) for n in needs]))


report("summary", f"""SELECT *, round(100.0 * successes / attempts, 2) AS success_rate, round(100.0 * remote_successes / remote_attempts, 2) AS outbound_rate FROM
 (SELECT count(*) FILTER (direction = 'in')::BIGINT AS messages_in, count(*) FILTER (direction = 'out')::BIGINT AS messages_out,
   sum(size_bytes) FILTER (direction = 'in')::BIGINT AS bytes_in, sum(size_bytes) FILTER (direction = 'out')::BIGINT AS bytes_out FROM message WHERE {RANGE}),
 (SELECT count(*) FILTER (g)::BIGINT AS attempts, count(*) FILTER (g AND result = 'success')::BIGINT AS successes, count(*) FILTER (g AND result = 'deferral')::BIGINT AS deferrals,
   count(*) FILTER (g AND result = 'failure')::BIGINT AS failures, count(*) FILTER (g AND route = 'remote')::BIGINT AS remote_attempts,
   count(*) FILTER (g AND route = 'remote' AND result = 'success')::BIGINT AS remote_successes, count(*) FILTER (NOT g)::BIGINT AS discarded
  FROM (SELECT *, recipient <> '#@[]' AS g FROM delivery WHERE {RANGE})),
 (SELECT strftime(day, '%Y-%m-%d') AS discarded_peak_day, n AS discarded_peak FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM delivery WHERE recipient = '#@[]' AND {RANGE} GROUP BY 1) ORDER BY n DESC, day LIMIT 1)""",
       lambda m, d: R.summary(m, d, SINCE, UNTIL), "message", "delivery")
for _by, _format in (("day", "strftime(ts, '%Y-%m-%d')"), ("hour", "strftime(ts, '%Y-%m-%d %H:00')"), ("week", "strftime(ts, '%G-W%V')")):
    report(f"timeseries_{_by}", f"SELECT {_format} AS bucket, count(*) FILTER (direction = 'in')::BIGINT AS messages_in, count(*) FILTER (direction = 'out')::BIGINT AS messages_out FROM message WHERE {RANGE} GROUP BY 1",
           lambda m, by=_by: R.timeseries(m, SINCE, UNTIL, by), "message")
    report(f"outcomes_{_by}", f"SELECT {_format} AS bucket, {OUTCOMES} FROM delivery WHERE recipient <> '#@[]' AND {RANGE} GROUP BY 1",
           lambda d, by=_by: R.outcomes_timeseries(d, SINCE, UNTIL, by), "delivery")
report("top_senders", f"SELECT auth_user, count(*) AS messages, sum(size_bytes)::BIGINT AS bytes FROM message WHERE direction = 'out' AND auth_user IS NOT NULL AND {RANGE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
       lambda m: R.top_senders(m, SINCE, UNTIL), "message")
report("top_recipients", f"SELECT recipient_domain, count(*) AS attempts, {OUTCOMES} FROM delivery WHERE route = 'remote' AND recipient <> '#@[]' AND {RANGE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
       lambda d: R.top_recipients(d, SINCE, UNTIL), "delivery")
report("per_domain", f"SELECT sender_domain AS domain, direction, count(*) AS messages, sum(size_bytes)::BIGINT AS bytes FROM message WHERE {RANGE} GROUP BY 1, 2",
       lambda m: R.per_domain(m, SINCE, UNTIL), "message")
report("mailboxes", f"""SELECT address, sum(s)::BIGINT AS sent, sum(r)::BIGINT AS received FROM (
  SELECT auth_user AS address, count(*) AS s, 0 AS r FROM message WHERE direction = 'out' AND auth_user IS NOT NULL AND {RANGE} GROUP BY 1
  UNION ALL SELECT recipient, 0, count(*) FROM delivery WHERE route = 'local' AND result = 'success' AND {RANGE} GROUP BY 1) GROUP BY 1 ORDER BY sum(s) + sum(r) DESC, 1 LIMIT 100""",
       lambda m, d: R.mailboxes(m, d, SINCE, UNTIL), "message", "delivery")
_JOIN = "FROM delivery d JOIN message m ON m.msg_id = d.msg_id AND m.queue_ts = d.msg_ts"
report("mailbox_outcomes", f"""SELECT *, round(100.0 * successes / nullif(attempts, 0), 2) AS success_rate FROM (SELECT count(*) AS sent FROM message WHERE auth_user = '{WHO}'),
  (SELECT count(*) AS received FROM delivery WHERE recipient = '{WHO}' AND route = 'local' AND result = 'success'),
  (SELECT count(*) AS attempts, {OUTCOMES} {_JOIN} WHERE auth_user = '{WHO}')""",
       lambda m, d: R.mailbox_outcomes(m, d, SINCE, UNTIL, f" {WHO.upper()} "), "message", "delivery")
report("mailbox_sent_to", f"SELECT recipient, count(*) AS attempts, {OUTCOMES} {_JOIN} WHERE auth_user = '{WHO}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
       lambda m, d: R.mailbox_sent_to(m, d, SINCE, UNTIL, WHO), "message", "delivery")
report("mailbox_received_from", f"SELECT sender, count(*) AS messages {_JOIN} WHERE recipient = '{LOCAL}' AND route = 'local' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
       lambda m, d: R.mailbox_received_from(m, d, SINCE, UNTIL, LOCAL), "message", "delivery")
report("hourly_profile", f"SELECT CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, count(*) AS messages FROM message WHERE {RANGE} GROUP BY 1, 2",
       lambda m: R.hourly_profile(m, SINCE, UNTIL), "message")
report("spam_per_account", f"""SELECT *, round(100.0 * coalesce(spam, 0) / scanned, 2) AS spam_rate FROM (SELECT recipient AS address, sum((verdict = 'SPAM' OR spam_score >= 5.0)::INT)::BIGINT AS spam,
  sum((NOT (verdict = 'SPAM' OR spam_score >= 5.0))::INT)::BIGINT AS clean, count(*) AS scanned, max(spam_score) AS worst_score {_JOIN}
  WHERE route = 'local' AND direction = 'in' AND (verdict IS NOT NULL OR spam_score IS NOT NULL) GROUP BY 1 ORDER BY spam DESC NULLS LAST, scanned DESC, address LIMIT 100)""",
       lambda m, d: R.spam_per_account(m, d, SINCE, UNTIL), "message", "delivery")
report("failure_reasons", f"""SELECT result, remote_code AS code, remote_status AS status, coalesce(reason, CASE WHEN k < 5 THEN reason END) AS reason, count(*) AS attempts, count(DISTINCT (d.msg_id, d.msg_ts)) AS messages,
  count(DISTINCT coalesce(auth_user, sender)) AS senders, count(DISTINCT recipient) AS recipients, count(DISTINCT recipient_domain) AS domains,
  array_to_string(list_slice(list_sort(list_distinct(list(recipient_domain))), 1, 3), ', ') AS sample_domains,
  array_to_string(list_slice(list_sort(list_distinct(list(sender_domain))), 1, 3), ', ') AS sample_senders, max(d.ts) AS last_seen
  FROM delivery d LEFT JOIN message m ON m.msg_id = d.msg_id AND m.queue_ts = d.msg_ts WHERE result <> 'success' AND recipient <> '#@[]'
  GROUP BY 1, 2, 3, 4 ORDER BY attempts DESC, result, code NULLS FIRST, status NULLS FIRST, reason NULLS FIRST LIMIT 25""",
       lambda m, d: R.failure_reasons(m, d, SINCE, UNTIL), "message", "delivery")
report("domain_flow", f"SELECT sender_domain, recipient_domain, count(*) AS attempts, {OUTCOMES} {_JOIN} WHERE recipient <> '#@[]' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50",
       lambda m, d: R.domain_flow(m, d, SINCE, UNTIL), "message", "delivery")
report("concurrency", "SELECT * FROM queue_minute", lambda q: R.concurrency(q, SINCE, UNTIL), "queue_minute")
report("connections", """SELECT service, sum(connects)::BIGINT AS connects, sum(messages)::BIGINT AS messages, max(max_concurrency) AS peak, max(limit_value) AS limit_value,
  greatest(sum(connects) - sum(messages), 0)::BIGINT AS sessions_without_mail FROM service_minute GROUP BY 1""", lambda s: R.connections(s, SINCE, UNTIL), "service_minute")  # fmt: skip
report("mailbox_access", "SELECT user_name AS address, service, count(*) AS logins, count(DISTINCT client_ip) AS addresses, max(ts) AS last_seen FROM auth_event WHERE result = 'login' AND user_name IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100",
       lambda a: R.mailbox_access(a, SINCE, UNTIL), "auth_event")
_LATEST = "latest AS (SELECT ip, action FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts DESC, (action = 'ban') DESC) AS r FROM ban_event) WHERE r = 1)"
report("auth_failures", f""", {_LATEST}, top AS (SELECT client_ip, count(*) AS failures, count(DISTINCT user_name) AS accounts_tried, max(ts) AS last_seen FROM auth_event WHERE result = 'auth_failed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
  SELECT top.*, CASE action WHEN 'ban' THEN 'blocked' WHEN 'unban' THEN 'ban expired' ELSE 'not blocked' END AS blocked FROM top LEFT JOIN latest ON ip = client_ip""",
       lambda a, b: R.auth_failures(a, b, SINCE, UNTIL), "auth_event", "ban_event")
report("access_summary", "SELECT service, count(*) FILTER (result = 'login')::BIGINT AS logins, count(*) FILTER (result = 'auth_failed')::BIGINT AS failures, count(*) FILTER (result = 'no_auth')::BIGINT AS scans, count(DISTINCT user_name) FILTER (result = 'login') AS accounts FROM auth_event GROUP BY 1",
       lambda a: R.access_summary(a, SINCE, UNTIL), "auth_event")
_CHAINS = """, chains AS (SELECT msg_id, msg_ts, recipient, count(*) AS attempts, min(ts) AS first_try, max(ts) AS last_try, bool_or(result = 'success') AS delivered,
  bool_or(result = 'failure') AS bounced, arg_max(reason, ts) FILTER (reason IS NOT NULL) AS reason FROM delivery WHERE recipient <> '#@[]' GROUP BY 1, 2, 3)"""
report("retry_summary", _CHAINS + """ SELECT count(*) FILTER (delivered AND attempts = 1)::BIGINT AS delivered_first_attempt, count(*) FILTER (delivered AND attempts > 1)::BIGINT AS delivered_after_retry,
  count(*) FILTER (NOT delivered AND bounced)::BIGINT AS bounced, count(*) FILTER (NOT delivered AND NOT bounced)::BIGINT AS still_trying, count(*) AS chains,
  round(avg(date_sub('minute', first_try, last_try)) FILTER (delivered), 4) AS minutes_to_delivery FROM chains""", lambda d: R.retry_summary(d, SINCE, UNTIL), "delivery")  # fmt: skip
report("stuck_deliveries", _CHAINS + f""" SELECT msg_id, recipient, attempts, first_try, last_try, reason, date_sub('hour', first_try, TIMESTAMP '{NOW}') AS hours_waiting
  FROM chains WHERE NOT delivered AND NOT bounced ORDER BY attempts DESC, first_try, msg_id, recipient LIMIT 50""", lambda d: R.stuck_deliveries(d, SINCE, UNTIL, NOW), "delivery")  # fmt: skip
report("demo_data_flag", "SELECT count(*) > 0 AS demo FROM message WHERE sender_domain IN ('example.com', 'example.net') OR sender_domain LIKE '%.example'", R.looks_like_demo_data, "message")
_ALIASES = {f"dst{i}.test": f"dst{i % 4}.test" for i in range(4, 12)}
report("alias_fold_domain", f"""SELECT CASE WHEN k BETWEEN 4 AND 11 THEN concat('dst', k % 4, '.test') ELSE recipient_domain END AS recipient_domain, sum(attempts)::BIGINT AS attempts, sum(successes)::BIGINT AS successes,
  sum(deferrals)::BIGINT AS deferrals, sum(failures)::BIGINT AS failures FROM (SELECT recipient_domain, CAST(substr(recipient_domain, 4, position('.' IN recipient_domain) - 4) AS INT) AS k, count(*) AS attempts, {OUTCOMES}
  FROM delivery WHERE route = 'remote' AND recipient <> '#@[]' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20) GROUP BY 1""",
       lambda d: R.fold_aliases(R.top_recipients(d, SINCE, UNTIL), _ALIASES, "recipient_domain", ["recipient_domain"], [F.negative("attempts"), F.col("recipient_domain")]), "delivery")
report("blocked_summary", f", {_LATEST} SELECT count(*) AS actions, count(DISTINCT ip) AS addresses, (SELECT count(*) FROM latest WHERE action = 'ban') AS still_blocked FROM ban_event",
       lambda b: R.blocked_summary(b, SINCE, UNTIL), "ban_event")
report("blocked_addresses", "SELECT ip, count(*) AS times, min(ts) AS first_seen, max(ts) AS last_seen, string_agg(DISTINCT jail, ', ' ORDER BY jail) AS jails FROM ban_event WHERE action = 'ban' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
       lambda b: R.blocked_addresses(b, SINCE, UNTIL), "ban_event")
report("blocked_by_jail", "SELECT jail, count(*) AS bans, count(DISTINCT ip) AS addresses FROM ban_event WHERE action = 'ban' GROUP BY 1", lambda b: R.blocked_by_jail(b, SINCE, UNTIL), "ban_event")
_DETAIL = """SELECT d.ts, result, recipient, recipient_domain, route, coalesce(auth_user, sender) AS sender, sender_domain, size_bytes, client_ip, subject, remote_ip, remote_code, remote_status,
  reason, said, side FROM delivery d LEFT JOIN message m ON m.msg_id = d.msg_id AND m.queue_ts = d.msg_ts WHERE result <> 'success' AND recipient <> '#@[]'"""
report("failure_detail", _DETAIL + " ORDER BY d.ts DESC, d.msg_id, recipient LIMIT 200", lambda m, d: R.failure_detail(m, d, SINCE, UNTIL).drop("detail"), "message", "delivery")
report("failure_detail_of_mailbox", _DETAIL + f" AND (auth_user = '{WHO}' OR sender = '{WHO}' OR recipient = '{WHO}') ORDER BY d.ts DESC, d.msg_id, recipient LIMIT 200",
       lambda m, d: R.failure_detail(m, d, SINCE, UNTIL, WHO).drop("detail"), "message", "delivery")
report("failure_side", "SELECT side, count(*) AS attempts FROM delivery WHERE result <> 'success' GROUP BY 1",
       lambda d: d.filter("result <> 'success'").withColumn("side", T.failure_side(F.col("result"), F.col("remote_code"), T.readable_detail(F.col("detail")), F.col("route"))).groupBy("side").agg(F.count(F.lit(1)).alias("attempts")), "delivery")
report("parse_detail", "SELECT event_id, remote_ip, remote_code, remote_status, reason FROM delivery", lambda d: d.select("event_id", "remote_ip", "remote_code", "remote_status", "reason"), "delivery")
report("readable_detail", "SELECT event_id, coalesce(said, CASE WHEN bad THEN '' ELSE 'done' END) AS said FROM delivery", lambda d: d.select("event_id", T.readable_detail(F.col("detail")).alias("said")), "delivery")
report("recipient_fold", "SELECT event_id, recipient, recipient_domain FROM delivery", lambda d: d.select("event_id", "recipient", "recipient_domain"), "delivery")

# Alerts, relative to a fixed now and with limits at which each rule speaks.
_HOUR = f"ts > TIMESTAMP '{ALERT_NOW}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{ALERT_NOW}'"
_alert = lambda id_, sev, title, detail, rest: f"SELECT '{id_}' AS id, '{sev}' AS severity, '{title.replace("'", "''")}' AS title, {detail} AS detail, {alerts.RANK[sev]}::INT AS rank {rest}"
report("alert_bounce_storm", _alert("bounce_storm", "critical", "Bounces that nobody can get", "format('{} bounces were discarded within an hour.', n)", f"FROM (SELECT count(*) AS n FROM delivery WHERE recipient = '#@[]' AND {_HOUR}) WHERE n >= 0"),
       lambda d: alerts.bounce_storm(d, ALERT_NOW, LIMITS), "delivery")
report("alert_delivery_failing", _alert("delivery_failing", "critical", "Outgoing mail is refused", "format('{} of {} attempts failed within an hour.', b, n)",
       f"FROM (SELECT count(*) AS n, count(*) FILTER (result = 'failure') AS b FROM delivery WHERE route = 'remote' AND recipient <> '#@[]' AND {_HOUR}) WHERE n >= 1 AND b * 100.0 / n >= 1"),
       lambda d: alerts.delivery_failing(d, ALERT_NOW, LIMITS), "delivery")
report("alert_parser_stalled", _alert("parser_stalled", "serious", "No news from the parser", "format('The last sign is {} minutes old.', a)", "FROM (SELECT date_sub('minute', max(ts), TIMESTAMP '2024-02-02 00:00:00') AS a FROM message) WHERE a >= 1"),
       lambda m: alerts.parser_stalled(m, None, "2024-02-02 00:00:00", LIMITS), "message")
report("alert_auth_guessing", _alert("auth_guessing", "serious", "Passwords are being guessed", "format('{} failed logins within an hour, {} of them from {}.', n, k, ip)",
       f"FROM (SELECT client_ip AS ip, count(*) AS k, sum(count(*)) OVER ()::BIGINT AS n FROM auth_event WHERE result = 'auth_failed' AND {_HOUR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) WHERE n >= 1"),
       lambda a: alerts.auth_guessing(a, ALERT_NOW, LIMITS), "auth_event")
report("alert_queue_saturated", _alert("queue_saturated", "warning", "The queue runs at its limit", "format('{} of {} remote deliveries ran at once.', u, l)",
       f"FROM (SELECT max(remote_max_used) AS u, max(remote_limit) AS l FROM (SELECT *, minute AS ts FROM queue_minute) WHERE {_HOUR}) WHERE u * 100.0 / l >= 1"),
       lambda q: alerts.queue_saturated(q, ALERT_NOW, LIMITS), "queue_minute")
report("alert_account_cracked", f"""SELECT l.user_name, l.client_ip, count(DISTINCT f.id) AS failures, max(l.ts) AS seen FROM auth_event l JOIN auth_event f ON f.user_name = l.user_name AND f.client_ip = l.client_ip AND f.result = 'auth_failed'
  AND f.ts < l.ts AND f.ts > l.ts - INTERVAL 7 DAY WHERE l.result = 'login' AND l.ts > TIMESTAMP '{NOW}' - INTERVAL 44640 MINUTE AND l.ts <= TIMESTAMP '{NOW}' GROUP BY 1, 2 HAVING failures >= 1""",
       lambda a: alerts.cracked_accounts(a, NOW, LIMITS), "auth_event")

# Daily totals.
_OLD = f"ts < TIMESTAMP '{NOW}' - INTERVAL 10 DAY"
_FM = f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sender_domain AS domain, direction, count(*) AS messages, sum(size_bytes)::BIGINT AS bytes FROM message WHERE {_OLD} GROUP BY 1, 2, 3"
_FD = f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, recipient_domain AS domain, 'out' AS direction, {OUTCOMES} FROM delivery WHERE {_OLD} GROUP BY 1, 2"
_dated = lambda rows: rows.withColumn("day", F.col("day").cast("string"))
report("rollup_messages", _FM, lambda m: _dated(rollup.fold_messages(m, NOW, 10)), "message")
report("rollup_deliveries", _FD, lambda d: _dated(rollup.fold_deliveries(d, NOW, 10)), "delivery")
report("rollup_merge", f"""SELECT day, domain, direction, max(messages)::BIGINT AS messages, max(bytes)::BIGINT AS bytes, max(successes)::BIGINT AS successes, max(deferrals)::BIGINT AS deferrals, max(failures)::BIGINT AS failures FROM (
  SELECT day, domain, direction, messages, bytes, 0 AS successes, 0 AS deferrals, 0 AS failures FROM ({_FM}) UNION ALL SELECT day, domain, direction, 0, 0, successes, deferrals, failures FROM ({_FD})) GROUP BY 1, 2, 3""",
       lambda m, d: _dated(rollup.merge_daily(rollup.fold_messages(m, NOW, 10), rollup.fold_messages(m, NOW, 10), rollup.fold_deliveries(d, NOW, 10))), "message", "delivery")
report("prune_oldest", f"""SELECT msg_id, ts FROM (SELECT *, row_number() OVER (ORDER BY ts NULLS LAST, msg_id NULLS FIRST) AS n FROM message) WHERE coalesce(NOT ({_OLD}), true) OR n > 500""",
       lambda m: rollup.prune(m, NOW, 10, 500, ("msg_id",)).select("msg_id", "ts"), "message")
report("digest_figures", f"""SELECT 'messages out' AS figure, count(*) FILTER (direction = 'out')::DOUBLE AS value FROM message WHERE CAST(ts AS DATE) = DATE '2024-01-10'
  UNION ALL SELECT 'messages in', count(*) FILTER (direction = 'in')::DOUBLE FROM message WHERE CAST(ts AS DATE) = DATE '2024-01-10'
  UNION ALL SELECT 'attempts', count(*)::DOUBLE FROM delivery WHERE CAST(ts AS DATE) = DATE '2024-01-10' AND recipient <> '#@[]'""",
       lambda m, d: digest.figures(m, d, "2024-01-10"), "message", "delivery")


# Lines are written from known columns and read back; the SQL gives the columns.
def _send_lines(spark, sf_dir):
    e = D.events(spark, sf_dir).selectExpr("event_id as seq", "ts", "cast(floor(event_id / 4) as bigint) as m", "event_id", "user_id", "'log' as logdir")
    text = """case event_id % 4 when 0 then concat('info msg ', m, ': bytes ', user_id * 10, ' from <u', user_id, '@a.test> qp ', event_id, ' uid 89')
      when 1 then concat('starting delivery ', m, ': msg ', m, ' to ', if(user_id % 2 = 0, 'local', 'remote'), ' r', user_id, '@b.test')
      when 2 then concat('delivery ', m, ': ', element_at(array('success', 'deferral', 'failure'), cast(user_id % 3 + 1 as int)), ': did_', event_id, '_x/')
      else if(user_id % 2 = 0, concat('end msg ', m), concat('status: local ', user_id % 10, '/10 remote ', user_id % 60, '/60')) end"""
    return e.select("logdir", "seq", "ts", F.expr(text).alias("text"))


_SEND = "SELECT event_id AS seq, ts, CAST(floor(event_id / 4) AS BIGINT) AS m, event_id % 4 AS k, user_id AS u FROM events"


@register("parse_send_lines", f"""SELECT seq, CASE k WHEN 0 THEN 'info' WHEN 1 THEN 'starting' WHEN 2 THEN 'outcome' ELSE CASE WHEN u % 2 = 0 THEN 'end' ELSE 'concurrency' END END AS kind,
  CASE WHEN k < 2 OR (k = 3 AND u % 2 = 0) THEN m END AS msg_id, CASE WHEN k = 0 THEN u * 10 END AS bytes, CASE WHEN k = 0 THEN concat('u', u, '@a.test') END AS sender, CASE WHEN k = 0 THEN seq END AS qp,
  CASE WHEN k IN (1, 2) THEN m END AS delivery_id, CASE WHEN k = 1 THEN CASE WHEN u % 2 = 0 THEN 'local' ELSE 'remote' END END AS route, CASE WHEN k = 1 THEN concat('r', u, '@b.test') END AS recipient,
  CASE WHEN k = 2 THEN ['success', 'deferral', 'failure'][u % 3 + 1] END AS result, CASE WHEN k = 2 THEN concat('did_', seq, '_x/') END AS detail,
  CASE WHEN k = 3 AND u % 2 = 1 THEN u % 10 END AS local_used, CASE WHEN k = 3 AND u % 2 = 1 THEN u % 60 END AS remote_used FROM ({_SEND})""", prefix=False)  # fmt: skip
def _parse_send(spark, sf_dir):
    return lines.parse_send(_send_lines(spark, sf_dir)).select("seq", "kind", "msg_id", "bytes", "sender", "qp", "delivery_id", "route", "recipient", "result", "detail", "local_used", "remote_used")


@register("assemble_send", f"""SELECT o.m AS msg_id, i.ts AS msg_ts, o.ts, CASE WHEN s.u % 2 = 0 THEN 'local' ELSE 'remote' END AS route, concat('r', s.u, '@b.test') AS recipient, ['success', 'deferral', 'failure'][o.u % 3 + 1] AS result
  FROM ({_SEND}) o JOIN ({_SEND}) s ON s.m = o.m AND s.k = 1 AND o.k = 2 LEFT JOIN ({_SEND}) i ON i.m = o.m AND i.k = 0""", prefix=False)  # fmt: skip
def _assemble_send(spark, sf_dir):
    return assemble.deliveries(lines.parse_send(_send_lines(spark, sf_dir))).select("msg_id", "msg_ts", "ts", "route", "recipient", "result")


@register("minute_fold_queue", f"""SELECT date_trunc('minute', ts) AS minute, max(u % 10) AS local_max_used, 10::BIGINT AS local_limit, max(u % 60) AS remote_max_used, 60::BIGINT AS remote_limit
  FROM ({_SEND}) WHERE k = 3 AND u % 2 = 1 GROUP BY 1""", prefix=False)  # fmt: skip
def _minute_fold_queue(spark, sf_dir):
    return assemble.queue_minutes(lines.parse_send(_send_lines(spark, sf_dir))).drop("logdir")


def _smtp_lines(spark, sf_dir):
    e = D.events(spark, sf_dir).selectExpr("event_id as seq", "ts", "cast(floor(event_id / 8) as bigint) as p", "event_id % 8 as k", "user_id as u", "event_id", "'log' as logdir")
    text = """case k when 0 then concat('tcpserver: pid ', p, ' from 2001:db8::', u % 90) when 1 then concat('tcpserver: ok ', p, ' mx.test:192.0.2.1:', if(u % 2 = 0, 25, 587), ' :2001:db8::', u % 90, '::4711')
      when 2 then concat('tcpserver: status: ', u % 200, '/200') when 3 then concat('simscan:[', p, ']:CLEAN (', u % 7, '.5/12.0):0.1s:Re: a: b:192.0.2.9:s@a.test:r@b.test')
      when 4 then concat('policy_check: local U', u, '@A.test -> remote r@b.test', if(u % 3 = 0, ' (AUTHENTICATED SENDER)', ''))
      when 5 then concat('mail recv: pid ', p, ' from <S', u, '@a.test> qp ', event_id) when 6 then concat('tcpserver: end ', p, ' status 0') else 'something else' end"""
    return e.select("logdir", "seq", "ts", F.expr(text).alias("text"))


_SMTP = "SELECT event_id AS seq, ts, CAST(floor(event_id / 8) AS BIGINT) AS p, event_id % 8 AS k, user_id AS u FROM events"


@register("parse_smtp_lines", f"""SELECT seq, [ 'open', 'connect', 'concurrency', 'scan', 'policy', 'recv', 'close', NULL ][k + 1] AS kind, CASE WHEN k IN (0, 1, 3, 5, 6) THEN p END AS pid,
  CASE WHEN k IN (0, 1) THEN concat('2001:db8::', u % 90) WHEN k = 3 THEN '192.0.2.9' END AS client_ip, CASE WHEN k = 1 THEN CASE WHEN u % 2 = 0 THEN 25 ELSE 587 END END::INT AS local_port,
  CASE WHEN k = 2 THEN u % 200 END AS used, CASE WHEN k = 3 THEN CAST(u % 7 AS DOUBLE) + 0.5 END AS spam_score, CASE WHEN k = 3 THEN 'Re: a: b' END AS subject,
  CASE WHEN k = 4 THEN u % 3 = 0 END AS authenticated, CASE WHEN k = 3 THEN 's@a.test' WHEN k = 5 THEN concat('S', u, '@a.test') END AS sender, CASE WHEN k = 5 THEN seq END AS qp FROM ({_SMTP})""", prefix=False)  # fmt: skip
def _parse_smtp(spark, sf_dir):
    return lines.parse_smtp(_smtp_lines(spark, sf_dir)).select("seq", "kind", "pid", "client_ip", "local_port", "used", "spam_score", "subject", "authenticated", "sender", "qp")


_POLICY = "CASE WHEN c.u % 2 = 1 AND y.u % 3 = 0 THEN concat('u', y.u, '@a.test') END"


@register("assemble_smtp", f"""SELECT r.seq AS qp, r.ts, CASE WHEN c.u % 2 = 0 THEN 'in' ELSE 'out' END AS direction, concat('s', r.u, '@a.test') AS sender, {_POLICY} AS auth_user, CASE WHEN {_POLICY} IS NOT NULL THEN 'policy_check' END AS auth_source,
  concat('2001:db8::', c.u % 90) AS client_ip, CAST(s.u % 7 AS DOUBLE) + 0.5 AS spam_score, 'CLEAN' AS verdict, 'Re: a: b' AS subject
  FROM ({_SMTP}) r JOIN ({_SMTP}) c ON c.p = r.p AND c.k = 1 AND r.k = 5 JOIN ({_SMTP}) s ON s.p = r.p AND s.k = 3 JOIN ({_SMTP}) y ON y.p = r.p AND y.k = 4""", prefix=False)  # fmt: skip
def _assemble_smtp(spark, sf_dir):
    return assemble.smtp_messages(lines.parse_smtp(_smtp_lines(spark, sf_dir))).drop("logdir", "seq")


@register("minute_fold_service", f"""SELECT date_trunc('minute', ts) AS minute, count(*) FILTER (k = 0) AS connects, count(*) FILTER (k = 5) AS messages, coalesce(max(u % 200) FILTER (k = 2), 0) AS max_concurrency,
  CASE WHEN count(*) FILTER (k = 2) > 0 THEN 200 END::BIGINT AS limit_value FROM ({_SMTP}) WHERE k IN (0, 2, 5) GROUP BY 1""", prefix=False)  # fmt: skip
def _minute_fold_service(spark, sf_dir):
    return assemble.service_minutes(lines.parse_smtp(_smtp_lines(spark, sf_dir))).drop("logdir")


@register("parse_tai64n", "SELECT event_id, ts, concat('x ', user_id) AS text FROM events", prefix=False)
def _parse_tai64n(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.lpad(F.lower(F.hex(F.floor(us / 1_000_000) + 10)), 15, "0")
    line = F.concat(F.lit("@4"), seconds, F.lpad(F.lower(F.hex((us % 1_000_000) * 1000)), 8, "0"), F.lit(" x "), F.col("user_id").cast("string"))
    rows = D.events(spark, sf_dir).select("event_id", line.alias("line"))
    return rows.select("event_id", T.tai64n(F.col("line")).alias("ts"), T.after_label(F.col("line")).alias("text"))


@register("parse_logins", """SELECT event_id, date_trunc('second', ts) AS ts, ['imap', 'pop3', 'submission'][user_id % 3 + 1] AS service, ['login', 'auth_failed', 'no_auth'][event_id % 3 + 1] AS result,
  CASE WHEN event_id % 3 < 2 THEN concat('u', user_id, '@a.test') END AS "user", concat('2001:db8::', user_id % 50) AS client_ip, CASE WHEN event_id % 3 < 2 THEN 'PLAIN' END AS method, event_id % 2 = 0 AS tls FROM events""", prefix=False)  # fmt: skip
def _parse_logins(spark, sf_dir):
    line = F.expr("""concat(date_format(ts, 'MMM dd HH:mm:ss'), ' ', element_at(array('imap', 'pop3', 'submission'), cast(user_id % 3 + 1 as int)), '-login: Info: ',
      case event_id % 3 when 0 then concat('Login: user=<U', user_id, '@a.test>, method=PLAIN') when 1 then concat('Disconnected (auth failed, 1 attempts): user=<U', user_id, '@a.test>, method=PLAIN')
        else 'Disconnected (no auth attempts in 0 secs): user=<>' end, ', rip=2001:db8::', user_id % 50, ', lip=192.0.2.1', if(event_id % 2 = 0, ', TLS', ''))""")
    rows = lines.parse_login(D.events(spark, sf_dir).select("event_id", line.alias("line")), 2024, F.lit("2024-06-01 00:00:00"))
    return rows.select("event_id", "ts", "service", "result", "user", "client_ip", "method", "tls")


@register("parse_bans", "SELECT event_id, date_trunc('second', ts) AS ts, concat('jail-', user_id % 4) AS jail, concat('192.0.2.', user_id % 50) AS ip, CASE WHEN event_id % 4 = 1 THEN 'unban' WHEN event_id % 4 < 3 THEN 'ban' END AS action FROM events WHERE event_id % 4 < 3", prefix=False)
def _parse_bans(spark, sf_dir):
    line = F.expr("""concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',123 fail2ban.actions [77]: NOTICE  [jail-', user_id % 4, '] ',
      element_at(array('Ban', 'Unban', 'Restore Ban', 'Found'), cast(event_id % 4 + 1 as int)), ' 192.0.2.', user_id % 50)""")
    return lines.parse_ban(D.events(spark, sf_dir).select("event_id", line.alias("line"))).filter("action is not null").drop("line")


# Merges.
def _versions(spark, sf_dir):
    return D.events(spark, sf_dir).selectExpr(
        "event_id as seq", "user_id as qp", "cast(timestamp'2024-01-01 00:00:00' as timestamp_ntz) as ts", "if(event_id % 2 = 0, 'in', 'out') as direction", "concat('s', event_id, '@a.test') as sender",
        "if(event_id % 3 = 0, event_id, null) as msg_id", "if(event_id % 5 = 0, 'x', null) as auth_user", "if(event_id % 4 = 0, concat('ip', event_id), null) as client_ip")


@register("upsert_message", """SELECT user_id AS qp, arg_max(event_id, event_id) FILTER (event_id % 3 = 0) AS msg_id, arg_max('x', event_id) FILTER (event_id % 5 = 0) AS auth_user, arg_max(concat('ip', event_id), event_id) FILTER (event_id % 4 = 0) AS client_ip,
  arg_min(concat('s', event_id, '@a.test'), event_id) AS sender, coalesce(arg_max('in', event_id) FILTER (event_id % 4 = 0), arg_min(CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END, event_id)) AS direction FROM events GROUP BY 1""", prefix=False)  # fmt: skip
def _upsert(spark, sf_dir):
    return merge.upsert_messages(_versions(spark, sf_dir)).select("qp", "msg_id", "auth_user", "client_ip", "sender", "direction")


@register("dedupe_delivery", "SELECT msg_id, coalesce(msg_ts, TIMESTAMP '1970-01-01') AS msg_ts, ts, recipient, result, min(event_id) AS seq FROM delivery GROUP BY 1, 2, 3, 4, 5")
def _dedupe_delivery(spark, sf_dir):
    d = D.delivery(spark, sf_dir).select("msg_id", F.when(F.col("event_id") % 11 > 0, F.col("msg_ts")).alias("msg_ts"), "ts", "recipient", "result", F.col("event_id").alias("seq"))
    return merge.dedupe_deliveries(d.unionByName(d.withColumn("seq", F.col("seq") + 1_000_000)))


SQL["dedupe_delivery"] = SQL["dedupe_delivery"].replace("coalesce(msg_ts, TIMESTAMP '1970-01-01')", "CASE WHEN event_id % 11 > 0 THEN msg_ts ELSE TIMESTAMP '1970-01-01' END")


@register("infer_direction", "SELECT m.msg_id, CASE WHEN m.msg_id % 2 = 0 THEN m.direction WHEN count(*) FILTER (d.route = 'remote') = 0 THEN 'in' ELSE 'out' END AS direction FROM message m JOIN delivery d ON d.msg_id = m.msg_id GROUP BY m.msg_id, m.direction")
def _infer_direction(spark, sf_dir):
    m = D.message(spark, sf_dir).withColumn("qp", F.when(F.col("msg_id") % 2 == 0, F.col("msg_id")))
    m = m.withColumn("direction", F.when(F.col("msg_id") % 2 == 0, F.col("direction")).otherwise("out"))
    return merge.infer_direction(m, D.delivery(spark, sf_dir)).select("msg_id", "direction")


@register("merge_minutes", "SELECT minute, sum(connects)::BIGINT AS connects, max(max_concurrency)::BIGINT AS peak FROM service_minute GROUP BY 1")
def _merge_minutes(spark, sf_dir):
    rows = D.service_minute(spark, sf_dir).withColumns({"seq": F.lit(1), "service": F.lit("all")})
    return merge.merge_service_minutes(rows).select("minute", "connects", F.col("max_concurrency").cast("long").alias("peak"))


@register("dedupe_auth", "SELECT DISTINCT ts, service, result, user_name, client_ip FROM auth_event WHERE user_name IS NOT NULL UNION ALL SELECT ts, service, result, user_name, client_ip FROM auth_event, range(2) WHERE user_name IS NULL")
def _dedupe_auth(spark, sf_dir):
    a = D.auth_event(spark, sf_dir)
    return merge.dedupe_auth(a.unionByName(a)).drop("id")


# The matches are made one after another, a step for each queue record of a sender; senders go side by side.
@register("correlate_nearest", """WITH RECURSIVE e AS (SELECT concat('s', user_id % 20, '@a.test') AS sender, event_id, ts, epoch_us(ts) AS us, CAST(CAST(value AS DOUBLE) % 60 AS DECIMAL(8, 6)) AS late FROM events),
  q AS (SELECT sender, event_id, ts - to_microseconds(CAST(late * 1000000 AS BIGINT)) - INTERVAL 4 MINUTE AS queue_ts FROM e WHERE event_id % 2 = 1),
  near AS (SELECT q.sender, q.event_id AS queue_qp, q.queue_ts, row_number() OVER (PARTITION BY q.sender ORDER BY q.queue_ts, q.event_id) AS n,
    list(s.event_id ORDER BY abs(s.us - epoch_us(q.queue_ts)), s.ts, s.event_id) FILTER (s.event_id IS NOT NULL) AS c
    FROM q LEFT JOIN e s ON s.sender = q.sender AND s.event_id % 2 = 0 AND abs(s.us - epoch_us(q.queue_ts)) <= 120000000 GROUP BY 1, 2, 3),
  r AS (SELECT DISTINCT sender, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS queue_qp, NULL::TIMESTAMP AS queue_ts, NULL::BIGINT AS qp FROM q
    UNION ALL SELECT sender, n, CASE WHEN qp IS NULL THEN used ELSE list_append(used, qp) END, queue_qp, queue_ts, qp
    FROM (SELECT r.sender, near.n, r.used, near.queue_qp, near.queue_ts, list_filter(near.c, lambda x: NOT list_contains(r.used, x))[1] AS qp FROM r JOIN near ON near.sender = r.sender AND near.n = r.n + 1))
  SELECT r.sender, r.queue_qp, r.queue_ts, r.qp, e.ts FROM r JOIN e ON e.event_id = r.qp""", prefix=False)
def _correlate(spark, sf_dir):
    e = D.events(spark, sf_dir).withColumn("sender", F.expr("concat('s', user_id % 20, '@a.test')"))
    smtp = e.filter("event_id % 2 = 0").selectExpr("sender", "event_id as qp", "cast(null as bigint) as queue_qp", "ts")
    queue = e.filter("event_id % 2 = 1").selectExpr("sender", "event_id as queue_qp", "ts - make_dt_interval(0, 0, 4, cast(value % 60 as decimal(8,6))) as queue_ts")
    return correlate.correlate(smtp, queue, 120)


# The same reports over a part of the range, so that the range cuts.
PART = ("2024-01-08 00:00:00", "2024-01-15 00:00:00")
_IN = lambda c: f"{c} >= TIMESTAMP '{PART[0]}' AND {c} < TIMESTAMP '{PART[1]}'"
report("summary_week", SQL["summary"].removeprefix(D.PREFIX).replace(RANGE, _IN("ts")), lambda m, d: R.summary(m, d, *PART), "message", "delivery")
report("mailbox_outcomes_week", f"""SELECT *, round(100.0 * successes / nullif(attempts, 0), 2) AS success_rate FROM (SELECT count(*) AS sent FROM message WHERE auth_user = '{WHO}' AND {_IN("ts")}),
  (SELECT count(*) AS received FROM delivery WHERE recipient = '{WHO}' AND route = 'local' AND result = 'success' AND {_IN("ts")}),
  (SELECT count(*) AS attempts, {OUTCOMES} {_JOIN} WHERE auth_user = '{WHO}' AND {_IN("d.ts")})""",
       lambda m, d: R.mailbox_outcomes(m, d, *PART, WHO), "message", "delivery")
report("mailbox_sent_to_week", SQL["mailbox_sent_to"].removeprefix(D.PREFIX).replace("GROUP BY", f"AND {_IN('d.ts')} GROUP BY"), lambda m, d: R.mailbox_sent_to(m, d, *PART, WHO), "message", "delivery")
report("mailbox_received_from_week", SQL["mailbox_received_from"].removeprefix(D.PREFIX).replace("GROUP BY", f"AND {_IN('d.ts')} GROUP BY"), lambda m, d: R.mailbox_received_from(m, d, *PART, LOCAL), "message", "delivery")
report("domain_flow_week", SQL["domain_flow"].removeprefix(D.PREFIX).replace("GROUP BY", f"AND {_IN('d.ts')} GROUP BY"), lambda m, d: R.domain_flow(m, d, *PART), "message", "delivery")
report("failure_reasons_week", SQL["failure_reasons"].removeprefix(D.PREFIX).replace("  GROUP BY", f"  AND {_IN('d.ts')} GROUP BY"), lambda m, d: R.failure_reasons(m, d, *PART), "message", "delivery")
report("failure_detail_week", _DETAIL + f" AND {_IN('d.ts')} ORDER BY d.ts DESC, d.msg_id, recipient LIMIT 200", lambda m, d: R.failure_detail(m, d, *PART).drop("detail"), "message", "delivery")
report("retry_summary_week", SQL["retry_summary"].removeprefix(D.PREFIX).replace("GROUP BY 1, 2, 3)", f"AND {_IN('ts')} GROUP BY 1, 2, 3)", 1), lambda d: R.retry_summary(d, *PART), "delivery")
report("access_summary_week", SQL["access_summary"].removeprefix(D.PREFIX).replace("GROUP BY", f"WHERE {_IN('ts')} GROUP BY"), lambda a: R.access_summary(a, *PART), "auth_event")

# Aliases from a configuration, and a heartbeat and a parser's state for the alerts on them.
report("alias_config_fold", f"""SELECT CASE recipient_domain WHEN 'dst1.test' THEN 'dst0.test' ELSE recipient_domain END AS recipient_domain, sum(attempts)::BIGINT AS attempts FROM
  (SELECT recipient_domain, count(*) AS attempts FROM delivery WHERE route = 'remote' AND recipient <> '#@[]' AND {RANGE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) GROUP BY 1""",
       lambda d: R.fold_aliases(R.top_recipients(d, SINCE, UNTIL).select("recipient_domain", "attempts"), R.aliases_from_config(" DST1.test : Dst0.TEST, , x:, :y"), "recipient_domain", ["recipient_domain"], [F.negative("attempts"), F.col("recipient_domain")]), "delivery")
report("alert_heartbeat_late", _alert("parser_stalled", "serious", "No news from the parser", "format('The last sign is {} minutes old.', a)", "FROM (SELECT date_sub('minute', max(ts) - INTERVAL 90 SECOND, TIMESTAMP '2024-02-02 00:00:00') AS a FROM ban_event) WHERE a >= 1"),
       lambda m, b: alerts.parser_stalled(m, b.select((F.col("ts") - F.expr("INTERVAL 90 SECOND")).alias("ts")), "2024-02-02 00:00:00", LIMITS), "message", "ban_event")
report("alert_parser_state", _alert("parser_state_large", "serious", "The parser's state has grown", "d || '.'",
       "FROM (SELECT string_agg(format('The state of {} takes {} KB', g, b // 1024), '; ' ORDER BY b DESC, g) AS d FROM (SELECT concat('log', user_id % 5) AS g, (count(*) * 1024 * 1024 + user_id % 5)::BIGINT AS b FROM events GROUP BY 1, user_id % 5) WHERE b > 1024 * 1024) WHERE d IS NOT NULL"),
       lambda a: alerts.parser_state_large(a.groupBy(F.expr("cast(substring(client_ip, 9) as int) % 5").alias("g")).count().selectExpr("concat('log', g) as logdir", "count * 1024 * 1024 + g as bytes"), LIMITS), "auth_event")
report("alert_account_cracked_text", _alert("account_cracked", "critical", "A password was guessed", "d || '.'", f"""FROM (SELECT string_agg(format('{{}} logged in from {{}} after {{}} failed tries from there', user_name, client_ip, failures), '; ' ORDER BY failures DESC, user_name, client_ip) AS d FROM (
       SELECT l.user_name, l.client_ip, count(DISTINCT f.id) AS failures FROM auth_event l JOIN auth_event f ON f.user_name = l.user_name AND f.client_ip = l.client_ip AND f.result = 'auth_failed' AND f.ts < l.ts AND f.ts > l.ts - INTERVAL 7 DAY
       WHERE l.result = 'login' AND l.ts > TIMESTAMP '{NOW}' - INTERVAL 44640 MINUTE AND l.ts <= TIMESTAMP '{NOW}' GROUP BY 1, 2)) WHERE d IS NOT NULL"""),
       lambda a: alerts.account_cracked(a, NOW, LIMITS), "auth_event")


# Merges and rules that the queries above do not reach.
@register("merge_queue_minute", "SELECT minute, local_max_used::BIGINT AS local_max_used, local_limit::BIGINT + 1 AS local_limit, remote_max_used::BIGINT AS remote_max_used, remote_limit::BIGINT - 1 AS remote_limit FROM queue_minute")
def _merge_queue_minute(spark, sf_dir):
    q = D.queue_minute(spark, sf_dir).select("minute", *[F.col(c).cast("long").alias(c) for c in ("local_max_used", "local_limit", "remote_max_used", "remote_limit")])
    later = q.withColumns({"local_max_used": F.col("local_max_used") - 1, "remote_max_used": F.col("remote_max_used") - 1, "local_limit": F.col("local_limit") + 1, "remote_limit": F.col("remote_limit") - 1})
    return merge.merge_queue_minutes(q.withColumn("seq", F.lit(1)).unionByName(later.withColumn("seq", F.lit(2))))


@register("dedupe_ban", "SELECT DISTINCT ts, jail, ip, action FROM ban_event")
def _dedupe_ban(spark, sf_dir):
    b = D.ban_event(spark, sf_dir).drop("event_id")
    return merge.dedupe_bans(b.unionByName(b))


@register("not_applied", "SELECT msg_id AS queue_qp, ts AS queue_ts FROM message WHERE msg_id % 3 <> 0 OR msg_id % 2 = 1")
def _not_applied(spark, sf_dir):
    m = D.message(spark, sf_dir)
    done = m.filter("msg_id % 3 = 0").selectExpr("msg_id as queue_qp", "if(msg_id % 2 = 1, ts + interval 2 milliseconds, ts) as queue_ts")
    return merge.not_applied(m.selectExpr("msg_id as queue_qp", "ts as queue_ts"), done)


@register("merge_sides", """SELECT concat('m', msg_id, '@a.test') AS sender, msg_id AS qp, CASE WHEN msg_id % 4 < 2 THEN msg_id + 1 END AS queue_qp, CASE WHEN msg_id % 4 < 2 THEN size_bytes END AS size_bytes FROM message
  UNION ALL SELECT concat('m', msg_id, '@a.test'), NULL, msg_id + 1, size_bytes FROM message WHERE msg_id % 4 = 2""")  # fmt: skip
def _merge_sides(spark, sf_dir):
    m = D.message(spark, sf_dir).withColumn("sender", F.expr("concat('m', msg_id, '@a.test')"))
    none = {"msg_id": "bigint", "size_bytes": "bigint", "queue_qp": "bigint", "queue_ts": "timestamp_ntz"}
    smtp = m.selectExpr("sender", "msg_id as qp", "ts", "direction", *[f"cast(null as {k}) as {c}" for c, k in none.items()])
    queue = m.filter("msg_id % 4 < 3").selectExpr("sender", "msg_id + 1 as queue_qp", "ts + make_interval(0, 0, 0, 0, 0, 0, if(msg_id % 4 = 2, 20, 2)) as queue_ts", "msg_id", "size_bytes", "direction")
    return correlate.merge_sides(smtp, queue).select("sender", "qp", "queue_qp", "size_bytes")


@register("role_default", f"""SELECT r.seq AS qp, 'out' AS direction, CASE WHEN y.u % 3 = 0 THEN concat('u', y.u, '@a.test') ELSE concat('s', r.u, '@a.test') END AS auth_user,
  CASE WHEN y.u % 3 = 0 THEN 'policy_check' ELSE 'envelope' END AS auth_source, '192.0.2.9' AS client_ip FROM ({_SMTP}) r JOIN ({_SMTP}) y ON y.p = r.p AND y.k = 4 AND r.k = 5""", prefix=False)  # fmt: skip
def _role_default(spark, sf_dir):
    rows = lines.parse_smtp(_smtp_lines(spark, sf_dir).filter("seq % 8 <> 1"))
    return assemble.smtp_messages(rows, "out", True).select("qp", "direction", "auth_user", "auth_source", "client_ip")


@register("queue_minutes_held", f"SELECT minute, remote_max_used FROM (SELECT date_trunc('minute', ts) AS minute, max(u % 60) AS remote_max_used, max(date_trunc('minute', max(ts))) OVER () AS newest FROM ({_SEND}) WHERE k = 3 AND u % 2 = 1 GROUP BY 1) WHERE minute < newest", prefix=False)
def _queue_minutes_held(spark, sf_dir):
    return assemble.queue_minutes(lines.parse_send(_send_lines(spark, sf_dir)), hold_newest=True).select("minute", "remote_max_used")


@register("service_minutes_held", f"SELECT minute, connects FROM (SELECT date_trunc('minute', ts) AS minute, count(*) FILTER (k = 0) AS connects, max(date_trunc('minute', max(ts))) OVER () AS newest FROM ({_SMTP}) WHERE k IN (0, 2, 5) GROUP BY 1) WHERE minute < newest", prefix=False)
def _service_minutes_held(spark, sf_dir):
    return assemble.service_minutes(lines.parse_smtp(_smtp_lines(spark, sf_dir)), hold_newest=True).select("minute", "connects")


@register("login_minutes", """SELECT ['imap', 'pop3', 'submission'][user_id % 3 + 1] AS service, date_trunc('minute', ts) AS minute, count(*) AS connects, count(*) FILTER (event_id % 3 = 0) AS messages FROM events GROUP BY 1, 2""", prefix=False)
def _login_minutes(spark, sf_dir):
    return assemble.login_minutes(_parse_logins(spark, sf_dir)).select("service", "minute", "connects", "messages")


@register("login_years", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN TIMESTAMP '2024-02-29 10:00:00' WHEN date_trunc('second', ts) > TIMESTAMP '2024-01-11 00:00:00' THEN date_trunc('second', ts) - INTERVAL 1 YEAR
  ELSE date_trunc('second', ts) END AS ts, event_id % 5 <> 0 AS readable FROM events""", prefix=False)  # fmt: skip
def _login_years(spark, sf_dir):
    """Dates without a year: a leap day in a year that lacks it, days ahead of now, and lines that are none."""
    rows = D.events(spark, sf_dir).select("event_id", F.expr("""case event_id % 5 when 0 then 'no date at all' when 1 then 'Feb 29 10:00:00 imap-login: Info: Login: user=<a@b.test>, rip=192.0.2.1'
      else concat(date_format(ts, 'MMM dd HH:mm:ss'), ' pop3-login: Info: Login: user=<a@b.test>, rip=192.0.2.1') end""").alias("line"), F.expr("if(event_id % 5 = 1, 2025, 2024)").alias("year"))
    return lines.parse_login(rows, F.col("year"), F.lit("2024-01-10 00:00:00")).select("event_id", "ts", "readable")


@register("line_counters", f"SELECT 'log' AS logdir, count(*) AS lines, 0::BIGINT AS malformed, count(*) FILTER (k = 7) AS ignored FROM ({_SMTP})", prefix=False)
def _line_counters(spark, sf_dir):
    return assemble.counters(lines.parse_smtp(_smtp_lines(spark, sf_dir)))


@register("unmatched_outcomes", f"SELECT 'log' AS logdir, count(*) AS unmatched FROM ({_SEND}) WHERE k = 2 AND m % 3 = 0", prefix=False)
def _unmatched_outcomes(spark, sf_dir):
    rows = _send_lines(spark, sf_dir).filter("m % 3 <> 0 or event_id % 4 <> 1")  # the starts of every third are missing
    return assemble.unmatched(lines.parse_send(rows))
