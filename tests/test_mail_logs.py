"""Log files to records, and the matching of both sides against a plain search."""

import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F

from postlens.functions import lines as L
from postlens.operators import assemble, correlate, merge
from postlens.plans import alerts, demo, digest, facade, ingest, schema
from postlens.sources import logs

T0 = dt.datetime(2026, 9, 15, 10)


def label(seconds):
    return "@4" + format(int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) + seconds + 10, "015x") + "00000000"


def test_multilog_folder(spark, tmp_path):
    folder = tmp_path / "send"
    folder.mkdir()
    (folder / "@400000006a0000000000aaaa.s").write_bytes(f"{label(0)} info msg 5: bytes 9 from <A@x.test> qp 3 uid 1\n\n{label(1)} a\rb\xff\nno label\n".encode("latin-1"))
    (folder / "current").write_text(f"{label(2)} starting delivery 8: msg 5 to local b@x.test\n{label(3)} delivery 8: success: ok/\n{label(4)} unfinished")
    (folder / "lock").write_text("x\n")
    rows = logs.read_multilog(spark, str(folder)).orderBy("seq").collect()
    assert [r.seq for r in rows] == [1, 3, 4, 5, 6] and rows[1].text == "a\rb�"
    assert rows[2].ts is None and rows[0].ts == T0
    send = L.parse_send(logs.read_multilog(spark, str(folder)))
    out = assemble.deliveries(send).collect()
    assert [(r.msg_id, r.msg_ts, r.route, r.result, r.detail) for r in out] == [(5, T0, "local", "success", "ok/")]
    assert assemble.queue_messages(send).first().sender == "a@x.test"


def test_roles():
    assert list(logs.check_roles({"q": "send", "s": "smtp"})) == ["s", "q"]
    with pytest.raises(ValueError):
        logs.check_roles({"q": "mail"})


def test_connection_facts_and_policy(spark):
    text = [
        "tcpserver: ok 1 mx.test:192.0.2.1:587 :2001:db8::5::4711", "policy_check: local U@A.test -> remote r@b.test (AUTHENTICATED SENDER)", "mail recv: pid 1 from <U@A.test> qp 11",
        "mail recv: pid 1 from <other@a.test> qp 12", "simscan:[2]:SPAM (9.5/12.0):0.1s:a: b:192.0.2.9:s@a.test:r@b.test", "mail recv: pid 2 from <s@a.test> qp 13",
    ]
    rows = spark.createDataFrame([("smtp", i, T0, t) for i, t in enumerate(text)], "logdir string, seq long, ts timestamp_ntz, text string")
    got = {r.qp: r for r in assemble.smtp_messages(L.parse_smtp(rows)).collect()}
    assert (got[11].direction, got[11].auth_user, got[11].client_ip) == ("out", "u@a.test", "2001:db8::5")
    assert (got[12].direction, got[12].auth_user, got[12].client_ip) == ("in", None, None)
    assert (got[13].spam_score, got[13].verdict, got[13].subject, got[13].client_ip) == (9.5, "SPAM", "a: b", "192.0.2.9")


def test_nearest_records_match_once(spark):
    r = random.Random(4)
    at = lambda s: T0 + dt.timedelta(milliseconds=round(s * 1000))
    smtp = [(f"s{r.randrange(3)}@a.test", i, at(r.random() * 120)) for i in range(80)]
    queue = [(f"s{r.randrange(3)}@a.test", 1000 + i, at(r.random() * 120)) for i in range(80)]
    want, free = set(), set(smtp)
    for s, q, t in sorted(queue, key=lambda x: (x[2], x[1])):
        near = min((x for x in free if x[0] == s and abs(x[2] - t) <= dt.timedelta(seconds=5)), key=lambda x: (abs(x[2] - t), x[2], x[1]), default=None)
        if near:
            free.remove(near)
            want.add((q, near[1]))
    a = spark.createDataFrame(smtp, "sender string, qp long, ts timestamp_ntz").withColumn("queue_qp", F.lit(None).cast("long"))
    b = spark.createDataFrame(queue, "sender string, queue_qp long, queue_ts timestamp_ntz")
    assert {(x.queue_qp, x.qp) for x in correlate.correlate(a, b).collect()} == want


def test_merges_change_nothing_when_repeated(spark):
    rows = spark.createDataFrame([(1, T0, "success", "r", None, 1), (1, T0, "success", "r", None, 2)], "msg_id long, ts timestamp_ntz, result string, recipient string, msg_ts timestamp_ntz, seq long")
    once = merge.dedupe_deliveries(rows)
    assert once.count() == 1 and merge.dedupe_deliveries(once.unionByName(once)).collect() == once.collect()


def test_splits_keep_the_order_of_lines(spark, tmp_path):
    folder = tmp_path / "big"
    folder.mkdir()
    (folder / "@400000006a0000000000aaaa.s").write_text("".join(f"{label(i)} old {i} {'x' * (i % 50)}\n" for i in range(2_000)))
    (folder / "current").write_text("".join(f"{label(i)} new {i}\n" for i in range(500)) + "tail")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = logs.read_multilog(spark, str(folder))
        assert rows.rdd.getNumPartitions() > 4
        got = [r.text.split()[:2] for r in rows.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [["old", str(i)] for i in range(2_000)] + [["new", str(i)] for i in range(500)]


def test_syslog_and_bans(spark, tmp_path):
    assert logs.read_syslog(spark, str(tmp_path / "none" / "mail.log")).count() == 0
    assert logs.read_bans(spark, str(tmp_path / "fail2ban.log")).count() == 0
    (tmp_path / "mail.log").write_bytes(b"third\nhalf")
    assert [r.line for r in logs.read_syslog(spark, str(tmp_path / "mail.log")).collect()] == ["third"]
    with gzip.open(tmp_path / "mail.log-20260901.gz", "wb") as f:
        f.write(b"first\n")
    (tmp_path / "mail.log-20260902").write_bytes(b"second\rpart\n")
    (tmp_path / "mail.logger").write_bytes(b"of another log\n")
    rows = logs.read_syslog(spark, str(tmp_path / "mail.log")).orderBy("seq").collect()
    assert [r.line for r in rows] == ["first", "second\rpart", "third"] and rows[0].year >= 2024
    (tmp_path / "fail2ban.log").write_text("2026-09-15 10:00:00,123 fail2ban.actions [7]: NOTICE  [dovecot] Restore Ban 192.0.2.7\nother\n")
    assert [tuple(r) for r in logs.read_bans(spark, str(tmp_path / "fail2ban.log")).collect()] == [(T0, "dovecot", "192.0.2.7", "ban")]


def test_policy_over_ranges_of_lines(spark):
    r = random.Random(2)
    kinds = [r.choice(["recv", "policy"]) for _ in range(200)]
    rows = spark.createDataFrame([("a", i * 3, k, f"u{i}") for i, k in enumerate(kinds)], "logdir string, seq long, kind string, auth_user string")
    got = assemble.line_before(rows, F.struct("kind", "auth_user"), 7).orderBy("seq").collect()
    assert got[0].before is None
    assert [(x.before.kind, x.before.auth_user) for x in got[1:]] == [(k, f"u{i}") for i, k in enumerate(kinds[:-1])]


@pytest.mark.parametrize("span", [1, 7, 3_600])
def test_islands_in_ranges(spark, span):
    r = random.Random(span)
    smtp = [(f"s{r.randrange(2)}@a.test", i, T0 + dt.timedelta(seconds=r.choice([3, 40]) * r.randrange(40))) for i in range(60)]
    a = spark.createDataFrame(smtp, "sender string, qp long, ts timestamp_ntz").withColumn("queue_qp", F.lit(None).cast("long"))
    b = a.limit(0).select("sender", F.col("qp").alias("queue_qp"), F.col("ts").alias("queue_ts"))
    got = {(x.sender, x.id): x.island for x in correlate.islands(a, b, 5, span).collect()}
    for s in {x[0] for x in smtp}:
        mine = sorted((t, i) for q, i, t in smtp if q == s)
        begin = None
        for k, (t, i) in enumerate(mine):
            if not k or t - mine[k - 1][0] > dt.timedelta(seconds=5):
                begin = int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
            assert got[s, i] == begin


def test_folders_to_tables(spark, tmp_path):
    """An SMTP log, a submission log and a queue log: one row for a message seen on both sides."""
    for name in ("in", "sub", "queue"):
        (tmp_path / name).mkdir()
    (tmp_path / "in" / "current").write_text("".join(f"{label(i)} {x}\n" for i, x in enumerate([
        "tcpserver: pid 5 from 192.0.2.1", "tcpserver: ok 5 mx:192.0.2.2:25 :192.0.2.1::99", "mail recv: pid 5 from <Far@b.test> qp 70", "tcpserver: status: 3/40"])) + "no label\n")
    (tmp_path / "sub" / "current").write_text("".join(f"{label(60 + i)} {x}\n" for i, x in enumerate([
        "policy_check: local u@a.test -> remote r@b.test (AUTHENTICATED SENDER)", "mail recv: pid 6 from <u@a.test> qp 71"])))
    (tmp_path / "queue" / "current").write_text("".join(f"{label(s)} {x}\n" for s, x in [
        (3, "info msg 1: bytes 500 from <far@b.test> qp 90 uid 1"), (3, "starting delivery 1: msg 1 to local a.test-x@a.test"), (4, "delivery 1: success: " + "y" * 2_000), (5, "end msg 1"),
        (62, "info msg 2: bytes 700 from <u@a.test> qp 91 uid 1"), (63, "starting delivery 2: msg 2 to remote r@b.test"), (64, "delivery 2: failure: 192.0.2.5_does_not_like_recipient./Remote_host_said:_550_5.1.1_No/"),
        (500, "info msg 3: bytes 9 from <cron@a.test> qp 92 uid 1"), (501, "starting delivery 3: msg 3 to local root@a.test"), (502, "delivery 3: success: ok/"), (503, "delivery 9: success: lost/"),
        (503, "status: local 1/10 remote 2/60"), (700, "status: local 4/10 remote 9/60")]))
    t = ingest.mail(spark, str(tmp_path), {"queue": "send", "in": "smtp", "sub": "submission"})
    m = {r.sender: r for r in t["message"].collect()}
    assert len(m) == 3 and (m["far@b.test"].direction, m["far@b.test"].size_bytes, m["far@b.test"].client_ip, m["far@b.test"].queue_qp) == ("in", 500, "192.0.2.1", 90)
    assert (m["u@a.test"].direction, m["u@a.test"].auth_user, m["u@a.test"].msg_id) == ("out", "u@a.test", 2)
    assert (m["cron@a.test"].direction, m["cron@a.test"].qp) == ("in", None)  # its only delivery is local
    d = {r.recipient: r for r in t["delivery"].collect()}
    assert set(d) == {"x@a.test", "r@b.test", "root@a.test"} and len(d["x@a.test"].detail) == 1_024 and d["r@b.test"].remote_code == 550
    assert [r.remote_max_used for r in t["queue_minute"].collect()] == [2]  # the newest minute is held back
    c = {r.logdir: r for r in t["counters"].collect()}
    assert (c["in"].malformed, c["queue"].unmatched, c["sub"].ignored) == (1, 1, 0)
    a = facade.MailAnalytics(spark, t)
    assert a.summary("2026-09-15 00:00:00", "2026-09-16 00:00:00").first().attempts == 3


def test_logins_of_a_file(spark, tmp_path):
    (tmp_path / "maillog").write_text("Sep 13 06:03:15 imap-login: Info: Login: user=<\tU@a.test >, method=PLAIN, rip=192.0.2.1, TLS\nSep 13 06:03:16 lmtp(x): saved\nbroken\n")
    t = ingest.access(spark, str(tmp_path / "maillog"), F.lit("2090-01-01 00:00:00"), "America/Denver")
    e = t["auth_event"].first()
    assert (e.user_name, e.ts.hour, e.tls) == ("u@a.test", 12, True) and e.id is not None
    assert tuple(t["counters"].first()) == (3, 1, 1) and t["service_minute"].first().messages == 1


def test_demo_tables(spark):
    t = demo.tables(spark, "2026-09-15")
    a = facade.MailAnalytics(spark, t)
    assert a.looks_like_demo_data().first()[0]
    s = a.summary("2026-08-01 00:00:00", "2026-10-01 00:00:00").first()
    assert s.messages_in > s.messages_out > 100 and s.failures > 0 and s.deferrals > 0
    assert demo.tables(spark, "2026-09-15")["message"].exceptAll(t["message"]).count() == 0
    assert all(t[x].count() > 10 for x in ("auth_event", "ban_event", "queue_minute", "service_minute"))


def test_ranges_and_texts():
    assert facade.days(None, None, "2026-09-15") == ("2026-09-09 00:00:00", "2026-09-16 00:00:00")
    with pytest.raises(ValueError):
        facade.days("2026-09-15", "2026-09-15")
    assert alerts.push_text([]) is None and "well" in alerts.mail_text([], "mx")[0]
    two = [{"severity": "critical", "title": "A", "detail": "d1"}, {"severity": "warning", "title": "B", "detail": "d2"}]
    assert alerts.push_text(two, "mx") == {"title": "mx: A", "message": "d1\n\nalso: B", "priority": 5}
    subject, body = alerts.mail_text(two, "mx")
    assert "critical" in subject and body.index("d1") < body.index("d2")


def test_changes_and_digest(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert alerts.changed(ids("a"), ids("b")) and alerts.changed(ids(), ids("b")) and not alerts.changed(ids("b", "a"), ids("a", "b"))
    t = demo.tables(spark, "2026-09-16", days=2)
    t |= {"auth_event": spark.createDataFrame([], schema.schema("auth_event")), "ban_event": spark.createDataFrame([], schema.schema("ban_event"))}
    text = digest.compose(t, "2026-09-15")
    assert text.startswith("Mail on 2026-09-15\n  sent ") and "Failed logins" not in text
    assert "quiet" in digest.compose(t, "2020-01-01")
