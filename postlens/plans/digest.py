"""The daily digest: a day's figures from the reports, and their text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.plans import reports as R


def day_range(day: str) -> tuple[str, str]:
    start = dt.date.fromisoformat(day)
    return f"{start} 00:00:00", f"{start + dt.timedelta(days=1)} 00:00:00"


def figures(message: DataFrame, delivery: DataFrame, day: str) -> DataFrame:
    """figure, value of a day."""
    s = R.summary(message, delivery, *day_range(day))
    pairs = [("messages out", "messages_out"), ("messages in", "messages_in"), ("attempts", "attempts")]
    each = F.array(*[F.struct(F.lit(n).alias("figure"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("value")) for n, c in pairs])
    return s.select(F.inline(each))


def table(rows: list[dict], columns: list[str], width: int = 30) -> list[str]:
    """Lines of fixed width; the last column is not cut."""
    return ["  ".join(str(r.get(c, "")).ljust(width)[: None if c == columns[-1] else width] for c in columns).rstrip() for r in rows]


def compose(tables: dict[str, DataFrame], day: str) -> str:
    """The text; a day without messages and attempts is told in one line. At most 12 rows of each report are fetched."""
    since, until = day_range(day)
    m, d, a, b = (tables[k] for k in ("message", "delivery", "auth_event", "ban_event"))
    s = R.summary(m, d, since, until).first().asDict()
    if not s["messages_in"] and not s["messages_out"] and not s["attempts"]:
        return f"Mail on {day}: a quiet day, nothing was sent or received.\n"
    fetch = lambda rows: [r.asDict() for r in rows.collect()]
    out = [f"Mail on {day}", f"  sent {s['messages_out']}, received {s['messages_in']}, delivered {s['success_rate']} % of {s['attempts']} attempts"]
    retry = R.retry_summary(d, since, until).first().asDict()
    out.append(f"  at once {retry['delivered_first_attempt']}, after retries {retry['delivered_after_retry']}, bounced {retry['bounced']}, waiting {retry['still_trying']}")
    parts = [
        ("Failures", R.failure_detail(m, d, since, until, limit=12), ["recipient", "side", "said"]), ("Spam", R.spam_per_account(m, d, since, until, 5), ["address", "spam", "scanned"]),
        ("Failed logins", R.auth_failures(a, b, since, until, 5), ["client_ip", "failures", "blocked"]), ("Logins", R.mailbox_access(a, since, until, 5), ["address", "service", "logins"]),
    ]
    for title, rows, columns in parts:
        if found := fetch(rows):
            out += ["", title, *("  " + x for x in table(found, columns))]
    return "\n".join(out) + "\n"
