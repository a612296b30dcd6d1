"""Pruning by rows and by stored days, zones, settings, disks, and failures before a login."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlens.functions import lines as L
from postlens.plans import alerts, demo, rollup, schema
from postlens.plans import reports as R

NOW, T = "2026-10-01 12:00:00", dt.datetime(2026, 6, 1, 10)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, k long, text string")


def survivors(rows, budget):
    """The oldest rows that are past keeping go, in order, as many as the budget allows."""
    limit = dt.datetime.fromisoformat(NOW) - dt.timedelta(days=90)
    old = sorted((r for r in rows if r[0] is not None and r[0] < limit), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    return Counter(rows) - Counter(old[:budget])


@pytest.mark.parametrize("seed,budget", [(1, 20), (2, 49), (3, 0), (4, 500), (5, 77), (6, 131)])
def test_prune_takes_exactly_the_budget(spark, seed, budget):
    r = random.Random(seed)
    times = [T, T + dt.timedelta(milliseconds=3), T + dt.timedelta(seconds=1), T + dt.timedelta(days=2), dt.datetime(2026, 7, 3, 11, 59, 59), dt.datetime(2026, 7, 3, 12), None]
    rows = [(r.choice(times), r.choice([None, 1, 2]), r.choice("ab")) for _ in range(150)]
    got = rollup.prune(rows_of(spark, rows), NOW, 90, budget)
    assert Counter(tuple(x) for x in got.collect()) == survivors(rows, budget)


def test_prune_of_one_second(spark):
    """50 rows of one second and a budget of 20 leave 30, alike or not."""
    assert rollup.prune(rows_of(spark, [(T, i, "x") for i in range(50)]), NOW, 90, 20).count() == 30
    assert rollup.prune(rows_of(spark, [(T, 1, "x")] * 50), NOW, 90, 20).count() == 30


def test_prune_of_stored_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(T + dt.timedelta(days=d, hours=h), h, "x") for d in range(4) for h in range(10)] + [(dt.datetime(2026, 7, 3, 11), 1, "y"), (dt.datetime(2026, 7, 3, 13), 2, "y")]
    rows_of(spark, rows).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    days = lambda: sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("day="))
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "day=2026-06-03").iterdir()}
    assert rollup.prune_stored(spark, path, NOW, 90, 13) == 13
    assert days() == ["day=2026-06-02", "day=2026-06-03", "day=2026-06-04", "day=2026-07-03"]
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "day=2026-06-03").iterdir()} == untouched
    assert Counter(tuple(x) for x in spark.read.parquet(path).select("ts", "k", "text").collect()) == survivors(rows, 13)
    assert rollup.prune_stored(spark, path, NOW, 90, 1_000) == 28
    assert [tuple(x)[2] for x in spark.read.parquet(path).select("ts", "k", "text").collect()] == ["y"] and days() == ["day=2026-07-03"]
    assert rollup.prune_stored(spark, path, NOW, 90, 1_000) == 0


@pytest.mark.parametrize("zone,hour", [("Nowhere/X", 6), ("", 6), (None, 6), ("America/Denver", 12)])
def test_zones(spark, zone, hour):
    rows = spark.createDataFrame([("Sep 13 06:03:15 imap-login: Info: Login: user=<u@a.test>, method=PLAIN, rip=192.0.2.1, TLS",)], "line string")
    r = L.parse_login(rows, 2026, F.lit("2026-10-01 00:00:00"), zone).first()
    assert (r.result, r.ts) == ("login", dt.datetime(2026, 9, 13, hour, 3, 15))


def test_settings_from_text():
    s = alerts.Settings.of({"stale_minutes": "--5", "silent_minutes": "5²", "disk_percent": "+7", "auth_failures_per_hour": " 12 ", "parser_state_kb": "", "disk_paths": "/, /var ,", "trusted_ips": "::1"})
    d = alerts.Settings()
    assert (s.stale_minutes, s.silent_minutes, s.parser_state_kb) == (d.stale_minutes, d.silent_minutes, d.parser_state_kb)
    assert (s.disk_percent, s.auth_failures_per_hour, s.disk_paths, s.trusted_ips) == (7, 12, ("/", "/var"), ("::1",))


def test_disks():
    def usage(p):
        if p == "/gone":
            raise OSError
        return {"/": (100, 96, 4), "/same": (100, 96, 4), "/var": (200, 170, 30), "/home": (100, 10, 90)}[p]

    s = alerts.Settings(disk_paths=("/", "/same", "/gone", "/var", "/home"))
    assert [x[:2] for x in alerts.disk_full(s, usage)] == [("disk_full:/", "critical"), ("disk_full:/var", "serious")]


def test_evaluate_tells_of_disks(spark):
    empty = {
        "delivery": "ts timestamp_ntz, route string, result string, recipient string, detail string", "message": "ts timestamp_ntz", "queue_minute": "minute timestamp_ntz, remote_max_used long, remote_limit long",
        "auth_event": "id long, ts timestamp_ntz, result string, user_name string, client_ip string, service string", "heartbeat": "ts timestamp_ntz",
    }
    tables = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    out = alerts.evaluate(tables, NOW, alerts.Settings(disk_percent=0)).collect()
    assert [x.id for x in out if x.id.startswith("disk_full")] == ["disk_full:/"]
    assert not [x for x in alerts.evaluate(tables, NOW, alerts.Settings(disk_percent=101)).collect() if x.id.startswith("disk_full")]


def test_failures_before_a_login(spark):
    r, now = random.Random(5), dt.datetime(2026, 10, 1, 12)
    rows = [(i, now - dt.timedelta(hours=r.randrange(24 * 20)), r.choice(["login", "auth_failed", "auth_failed", "no_auth"]), r.choice(["a", "b", None]), r.choice(["192.0.2.1", "::1", None])) for i in range(400)]
    s = alerts.Settings(cracked_account_failures=3, cracked_account_window_minutes=60 * 24 * 9)
    events = spark.createDataFrame(rows, "id long, ts timestamp_ntz, result string, user_name string, client_ip string")
    want = {}
    for u, ip in {(x[3], x[4]) for x in rows if x[3] and x[4] and x[4] not in s.trusted_ips}:
        mine = [x for x in rows if x[3:] == (u, ip)]
        pairs = [(f[0], l[1]) for l in mine if l[2] == "login" and now - dt.timedelta(days=9) < l[1] <= now for f in mine if f[2] == "auth_failed" and l[1] - dt.timedelta(days=7) < f[1] < l[1]]
        if len({f for f, _ in pairs}) >= 3:
            want[u, ip] = (len({f for f, _ in pairs}), max(t for _, t in pairs))
    out = alerts.cracked_accounts(events, NOW, s)
    assert {(x.user_name, x.client_ip): (x.failures, x.seen) for x in out.collect()} == want and want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    text = alerts.account_cracked(events, NOW, s).first().detail
    assert text.count("logged in from") == len(want)


def test_reports_read_the_messages_of_their_range(spark, tmp_path):
    """A day's deliveries bound the scan of the messages; failure reasons need no Expand and no unbounded array."""
    for name, rows in demo.tables(spark, "2026-09-16").items():
        rows.write.parquet(str(tmp_path / name))
    message, delivery = (spark.read.parquet(str(tmp_path / x)) for x in ("message", "delivery"))
    day = ("2026-09-10 00:00:00", "2026-09-11 00:00:00")
    for report in (R.domain_flow, R.failure_reasons):
        plan = report(message, delivery, *day)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(queue_ts,2026-09-", plan), plan
        assert "Expand" not in plan and "collect_set" not in plan
    assert R.domain_flow(message, delivery, "2020-01-01 00:00:00", "2020-01-02 00:00:00").count() == 0


def test_stored_tables_of_any_age(spark, tmp_path):
    """A folder with narrow numbers, a column that is gone, and without newer ones, beside a folder of today."""
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    spark.createDataFrame([(T, 5, 7, "x")], "minute timestamp_ntz, connects int, messages int, gone string").write.parquet(old)
    now = spark.createDataFrame([(T, "smtp", 1 << 40, 2, 3, 4)], "minute timestamp_ntz, service string, connects long, messages long, max_concurrency long, limit_value long")
    schema.conform(now, "service_minute").write.parquet(new)
    got = schema.read_stored(spark, "service_minute", old, new)
    assert got.schema == schema.schema("service_minute")
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == [(T, None, 5, 7, None, None), (T, "smtp", 1 << 40, 2, 3, 4)]
