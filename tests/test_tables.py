"""Records fed in any batches, against one run over all of them."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import correlate, merge
from postlens.plans import ingest
from postlens.plans.schema import conform, schema
from postlens.sources import derived
from postlens.streaming.tables import QUEUE, Tables, run_once

SMTP = "seq long, qp long, ts timestamp_ntz, direction string, sender string, auth_user string, auth_source string, client_ip string, spam_score double, verdict string, subject string"
SENT = "queue_qp long, queue_ts timestamp_ntz, sender string, msg_id long, size_bytes long"
MADE = "seq long, ts timestamp_ntz, result string, detail string, msg_id long, route string, recipient string, msg_ts timestamp_ntz"
MIDNIGHT = dt.datetime(2026, 9, 15)


def records(seed):
    """Both sides of messages around two midnights, some dense, some alone, and deliveries of what the queue saw."""
    r = random.Random(seed)
    at = lambda: MIDNIGHT + dt.timedelta(days=r.randrange(2), milliseconds=r.randrange(-40_000, 40_000))
    smtp = [(i, 1_000 + i, at(), r.choice(["in", "out"]), r.choice(["a@x.test", "b@x.test", None]), None, None, "192.0.2.1", None, None, "s") for i in range(30)]
    queue = [(i, at(), r.choice(["a@x.test", "b@x.test", None]), i, 100 + i) for i in range(30)]
    made = [(i, q[1] + dt.timedelta(hours=r.randrange(30)), r.choice(["success", "deferral"]), "did_0+0+1/", q[3], r.choice(["local", "local", "remote"]), f"r{r.randrange(2)}@x.test", q[1]) for i, q in enumerate(r.choices(queue, k=40))]
    return smtp, queue, made


def one_run(spark, smtp, queue, made):
    nulls = {c: F.lit(None).cast(schema("message")[c].dataType) for c in QUEUE}
    message = merge.upsert_messages(spark.createDataFrame(smtp, SMTP).withColumns(nulls)).drop("seq")
    queue = spark.createDataFrame(queue, SENT).withColumns({"ts": F.col("queue_ts"), "direction": F.lit("out"), "qp": F.lit(None).cast("long")})
    delivery = conform(merge.dedupe_deliveries(derived.delivery_fields(spark.createDataFrame(made, MADE))), "delivery")
    message = merge.infer_direction(conform(correlate.merge_sides(message, queue), "message"), delivery)
    return conform(message.withColumn("sender_domain", T.domain_of(F.col("sender"))), "message"), delivery


def counted(rows):
    return Counter(map(str, rows.collect()))


@pytest.mark.parametrize("seed", [1])
def test_any_batches_give_one_run(spark, tmp_path, seed):
    """Batches of either side in any order, days apart, some twice."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    r, (smtp, queue, made) = random.Random(seed), records(seed)
    tables = Tables(spark, str(tmp_path / "t"))
    todo = [("smtp", smtp[a : a + 15]) for a in range(0, 30, 15)] + [("queue", queue[a : a + 15]) for a in (0, 15)] + [("made", made[a : a + 20]) for a in (0, 20)]
    r.shuffle(todo)
    for side, rows in todo + [r.choice(todo)]:
        if side == "smtp":
            tables.add_messages(smtp=spark.createDataFrame(rows, SMTP))
        elif side == "queue":
            tables.add_messages(queue=spark.createDataFrame(rows, SENT))
        else:
            tables.add_deliveries(spark.createDataFrame(rows, MADE))
    message, delivery = one_run(spark, smtp, queue, made)
    assert counted(tables.read("message")) == counted(message)
    assert counted(tables.read("delivery")) == counted(delivery)


def test_only_touched_days_are_written(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    row = lambda i, d: (i, i, MIDNIGHT + dt.timedelta(days=d, hours=9), "in", "a@x.test", None, None, None, None, None, None)
    tables.add_messages(smtp=spark.createDataFrame([row(i, i) for i in range(5)], SMTP))
    before = {p.name: max(f.stat().st_mtime_ns for f in p.iterdir()) for p in (tmp_path / "t" / "message").glob("day=*")}
    tables.add_messages(queue=spark.createDataFrame([(9, MIDNIGHT + dt.timedelta(days=2, hours=9, seconds=2), "a@x.test", 7, 70)], SENT))
    after = {p.name: max(f.stat().st_mtime_ns for f in p.iterdir()) for p in (tmp_path / "t" / "message").glob("day=*")}
    assert [d for d in sorted(before) if before[d] != after[d]] == ["day=2026-09-17"]
    assert tables.read("message").filter("msg_id = 7").first().qp == 2


def test_minutes_add_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    part = lambda n, top: spark.createDataFrame([(MIDNIGHT, "smtp", n, 1, n, top)], "minute timestamp_ntz, service string, connects long, messages long, max_concurrency long, limit_value long")
    read = lambda: [(x.connects, x.messages, x.max_concurrency, x.limit_value) for x in tables.read("service_minute").collect()]
    assert read() == []
    tables.add_minutes("service_minute", part(3, 40), "a", 0)
    tables.add_minutes("service_minute", part(5, 50), "a", 1)
    tables.add_minutes("service_minute", part(5, 50), "a", 1)  # once more
    assert read() == [(8, 2, 5, 50)]
    tables.compact("service_minute")
    tables.add_minutes("service_minute", part(5, 50), "a", 1)  # and after its sum
    assert read() == [(8, 2, 5, 50)]
    tables.add_minutes("service_minute", part(2, 60), "a", 2)
    tables.add_minutes("service_minute", part(1, 30), "b", 0)
    assert [x[:3] for x in read()] == [(11, 4, 5)]
    tables.compact("service_minute")
    tables.compact("service_minute")
    assert [x[:3] for x in read()] == [(11, 4, 5)]


def label(second):
    return f"@{(1 << 62) + 10 + 1_790_000_000 + second:016x}{0:08x}"


def test_logs_to_tables_in_two_passes(spark, tmp_path):
    """An SMTP log and a queue log that grow: the tables equal those of one batch run over the whole logs."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    lines = {
        "in": [(0, "tcpserver: pid 5 from 192.0.2.1"), (0, "tcpserver: ok 5 mx:192.0.2.2:25 :192.0.2.1::99"), (1, "mail recv: pid 5 from <Far@b.test> qp 70"), (1, "tcpserver: status: 3/40"),
               (60, "tcpserver: pid 6 from 192.0.2.1"), (61, "mail recv: pid 6 from <Far@b.test> qp 71"), (600, "tcpserver: status: 1/40")],
        "queue": [(3, "info msg 1: bytes 500 from <far@b.test> qp 90 uid 1"), (3, "starting delivery 1: msg 1 to local a@a.test"), (4, "delivery 1: success: ok/"), (5, "end msg 1"),
                  (62, "info msg 2: bytes 700 from <far@b.test> qp 91 uid 1"), (63, "starting delivery 2: msg 2 to local a@a.test"), (64, "delivery 2: success: ok/"), (70, "info msg 3: bytes 9 from <cron@a.test> qp 92 uid 1"),
                  (71, "starting delivery 3: msg 3 to local root@a.test"), (72, "delivery 3: success: ok/"), (73, "status: local 1/10 remote 2/60"), (700, "status: local 4/10 remote 9/60")],
    }
    roles, tables = {"in": "smtp", "queue": "send"}, Tables(spark, str(tmp_path / "t"))
    for low, high in ((0, 4), (4, 99)):
        for name, every in lines.items():
            (tmp_path / "root" / name).mkdir(parents=True, exist_ok=True)
            with (tmp_path / "root" / name / "current").open("a") as f:
                f.writelines(f"{label(s)} {x}\n" for s, x in every[low:high])
        run_once(tables, str(tmp_path / "root"), roles, str(tmp_path / "marks"))
    want = ingest.mail(spark, str(tmp_path / "root"), roles, hold_newest=False)
    for table in ("message", "delivery", "service_minute", "queue_minute"):
        assert counted(tables.read(table)) == counted(conform(want[table], table)), table
