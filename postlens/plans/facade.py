"""All reports as methods over a set of tables."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from postlens.plans import alerts, digest
from postlens.plans import reports as R

#: The tables that each report reads, in the order of its parameters.
NEEDS = {
    R.summary: "message delivery", R.timeseries: "message", R.top_senders: "message", R.top_recipients: "delivery", R.per_domain: "message",
    R.mailboxes: "message delivery", R.mailbox_outcomes: "message delivery", R.mailbox_sent_to: "message delivery", R.mailbox_received_from: "message delivery",
    R.outcomes_timeseries: "delivery", R.hourly_profile: "message", R.spam_per_account: "message delivery", R.failure_reasons: "message delivery",
    R.domain_flow: "message delivery", R.concurrency: "queue_minute", R.connections: "service_minute", R.mailbox_access: "auth_event",
    R.auth_failures: "auth_event ban_event", R.access_summary: "auth_event", R.retry_summary: "delivery", R.stuck_deliveries: "delivery",
    R.blocked_summary: "ban_event", R.blocked_addresses: "ban_event", R.blocked_by_jail: "ban_event", R.failure_detail: "message delivery",
}


def days(since: str | None = None, until: str | None = None, today: str | None = None) -> tuple[str, str]:
    """A half-open range of dates: until defaults to tomorrow, since to a week before until. ValueError if it is empty."""
    day = dt.date.fromisoformat
    end = day(until) if until else (day(today) if today else dt.datetime.now(dt.timezone.utc).date()) + dt.timedelta(days=1)
    begin = day(since) if since else end - dt.timedelta(days=7)
    if begin >= end:
        raise ValueError("since must be before until")
    return f"{begin} 00:00:00", f"{end} 00:00:00"


class MailAnalytics:
    """MailAnalytics(spark, tables).summary(since, until): each report of ``reports`` by its name, as a DataFrame.

    tables: message, delivery, auth_event, ban_event, queue_minute, service_minute, and
    heartbeat and parser_state if there are such.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables
        for f, needs in NEEDS.items():
            setattr(self, f.__name__, partial(f, *[tables[t] for t in needs.split() if t in tables]))

    @classmethod
    def at(cls, spark: SparkSession, folder: str, *names: str) -> MailAnalytics:
        """Over the Parquet tables folder/name."""
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}") for n in names})

    def looks_like_demo_data(self) -> DataFrame:
        return R.looks_like_demo_data(self.tables["message"])

    def alerts(self, now: str, settings: alerts.Settings | None = None) -> DataFrame:
        return alerts.evaluate(self.tables, now, settings)

    def digest(self, day: str) -> str:
        return digest.compose(self.tables, day)
