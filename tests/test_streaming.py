"""Streams of logs, read to their end twice or more with lines added between."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from postlens.functions import lines as L
from postlens.operators import assemble
from postlens.plans import alerts
from postlens.sources.growing import follow
from postlens.sources.logs import read_multilog, stream_lines
from postlens.streaming import ingest, keyed


@pytest.fixture(autouse=True)
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def put(folder, name, rows):
    (folder / name).write_text("".join(r + "\n" for r in rows))


def test_logins_are_stored_once(spark, tmp_path):
    src, table, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    rows = [f"Sep 13 06:03:1{i} imap-login: Info: Login: user=<U{i}@a.test>, method=PLAIN, rip=192.0.2.{i}, TLS" for i in range(3)]
    put(src, "a", [*rows, rows[0], "no login line"])
    stream = lambda: ingest.logins(stream_lines(spark, str(src)), 2026, F.lit("2026-10-01 00:00:00"))
    keys = ["ts", "service", "result", "user_name", "client_ip"]
    ingest.store(stream(), table, mark, keys).awaitTermination(120)
    put(src, "b", [rows[1], rows[2].replace("06:03:12", "06:04:00")])
    ingest.store(stream(), table, mark, keys).awaitTermination(120)
    got = spark.read.parquet(table).collect()
    assert len(got) == 4 and {r.user_name for r in got} == {"u0@a.test", "u1@a.test", "u2@a.test"}


def label(second):
    return f"@{(1 << 62) + 10 + 1_790_000_000 + second:016x}{0:08x}"


def add(folder, lines):
    """Appends lines with a label each: (second, text)."""
    folder.mkdir(parents=True, exist_ok=True)
    with (folder / "current").open("a") as f:
        f.writelines(f"{label(s)} {x}\n" for s, x in lines)


def test_deliveries_over_batches(spark, tmp_path):
    table, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run(lines):
        add(tmp_path / "root" / "send", lines)
        rows = ingest.labelled(follow(spark, str(tmp_path / "root"), ["send"]))
        ingest.store(keyed.deliveries(L.parse_send(rows)), table, mark).awaitTermination(120)

    run([(100, "info msg 7: bytes 10 from <s@a.test> qp 9 uid 1"), (101, "starting delivery 1: msg 7 to remote r@b.test"), (102, "delivery 5: success: never_started/")])
    run([(200, "delivery 1: deferral: later/"), (201, "end msg 7"), (202, "starting delivery 2: msg 7 to local x@a.test"), (203, "delivery 2: success: did_0+0+1/")])
    got = sorted(spark.read.parquet(table).collect(), key=lambda r: r.seq)
    assert [(r.logdir, r.msg_id, r.route, r.result) for r in got] == [("send", 7, "remote", "deferral"), ("send", 7, "local", "success")]
    assert got[0].msg_ts is not None and got[1].msg_ts is None  # the message had ended before the second start
    run([(300, "starting delivery 3: msg 8 to local y@a.test")])
    state = keyed.state_sizes(spark, mark).collect()
    assert [x.logdir for x in state] == ["send"] and 0 < state[0].bytes < 1_000
    state = spark.createDataFrame(state, "logdir string, bytes long")
    assert alerts.parser_state_large(state, alerts.Settings(parser_state_kb=0)).count() == 1 and alerts.parser_state_large(state, alerts.Settings()).count() == 0


def random_sessions(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        pid = r.randrange(12)
        yield r.choice([
            f"tcpserver: ok {pid} mx:192.0.2.2:{r.choice([25, 587, 465])} :192.0.2.{pid}::99", f"mail recv: pid {pid} from <S{pid}@a.test> qp {r.randrange(10**6)}", f"tcpserver: end {pid} status 0",
            f"simscan:[{pid}]:SPAM ({pid}.5/12.0):0.1s:a: b:198.51.100.{pid}:s@a.test:r@b.test", f"policy_check: local U{pid}@a.test -> remote r@b.test{r.choice(['', ' (AUTHENTICATED SENDER)'])}",
        ])


COLUMNS = ["logdir", "qp", "ts", "direction", "sender", "auth_user", "auth_source", "client_ip", "spam_score", "verdict", "subject"]


def test_sessions_over_batches_equal_those_of_one_batch(spark, tmp_path):
    """Two logs that grow; ranges of a few lines, so that policy lines are carried from one to the next."""
    table, mark, beats = str(tmp_path / "out"), str(tmp_path / "mark"), str(tmp_path / "beats")
    text = {"smtp": list(random_sessions(6, 300)), "other": list(random_sessions(7, 90))}
    assert ingest.beats(spark, beats) is None
    for k, (low, high) in enumerate([(0, 100), (100, 101), (101, 300)]):
        for x, lines in text.items():
            add(tmp_path / "root" / x, [(i, line) for i, line in enumerate(lines)][low:high])
        if k == 1:
            (tmp_path / "root" / "smtp" / "current").rename(tmp_path / "root" / "smtp" / "@1.s")
        rows = L.parse_smtp(ingest.labelled(follow(spark, str(tmp_path / "root"), list(text), split=700)))
        ingest.store(keyed.smtp_messages(rows, "out", True, size=500), table, mark, ["logdir", "seq", "ts"], heartbeat=beats).awaitTermination(120)
    got = spark.read.parquet(table).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = [assemble.smtp_messages(L.parse_smtp(read_multilog(spark, str(tmp_path / "root" / x))), "out", True) for x in text]
    assert sorted(map(str, got.select(COLUMNS).collect())) == sorted(str(r) for w in want for r in w.select(COLUMNS).collect())
    assert ingest.beats(spark, beats).count() >= 3


class Store:
    """A handle of keyed state for one key, in memory."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        class Value:
            held = None

            def exists(self):
                return self.held is not None

            def get(self):
                return self.held

            def update(self, x):
                self.held = x

            def clear(self):
                self.held = None

        return Value()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def test_state_is_forgotten_after_a_while():
    """A delivery that ends more than an hour after its start finds nothing, and one timer at most is set."""
    keep = Store()
    one = keyed.Keyed(keyed._delivery, "", 3_600_000)
    one.init(keep)
    line = lambda seq, hours, kind: Row(logdir="send", seq=seq, at=None, ms=int(hours * 3_600_000), us=0, kind=kind, msg_id=7, msg_us=None, route="local", recipient="r", result="success", detail="ok/")
    feed = lambda *lines: [x.seq for x in one.handleInputRows(("send", 1), iter(lines), None)]
    assert feed(line(2, 0.5, "outcome"), line(1, 0, "starting")) == [2] and keep.timers == set()
    assert feed(line(3, 1, "starting")) == [] and keep.timers == {7_200_000}
    assert feed(line(4, 1.5, "starting")) == [] and keep.timers == {9_000_000}
    assert feed(line(5, 2.6, "outcome"), line(6, 2.7, "starting")) == [] and keep.timers == {int(3.7 * 3_600_000)}
    assert feed(line(7, 3.7, "outcome")) == [7]
    feed(line(8, 4, "starting"))
    assert list(one.handleExpiredTimer(("send", 1), None, None)) == []
    assert feed(line(9, 4.1, "outcome")) == []


def test_service_minutes_keep_the_last_limit(spark, tmp_path):
    table, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    add(tmp_path / "smtp", [(1, "tcpserver: status: 3/100"), (2, "tcpserver: status: 2/40"), (500, "tcpserver: status: 1/40")])
    rows = ingest.labelled(follow(spark, str(tmp_path / "smtp")))
    ingest.store(ingest.service_minutes(L.parse_smtp(rows)), table, mark).awaitTermination(120)
    got = spark.read.parquet(table).collect()
    assert [(x.logdir, x.max_concurrency, x.limit_value) for x in got] == [("smtp", 3, 40)]
