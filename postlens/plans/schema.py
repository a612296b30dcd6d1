"""The tables' columns, and frames brought to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names of tables and columns.
TABLES = {
    "message": "qp long, queue_qp long, queue_ts timestamp_ntz, ts timestamp_ntz, direction string, sender string, sender_domain string, auth_user string, "
    "msg_id long, size_bytes long, client_ip string, spam_score double, verdict string, auth_source string, subject string",
    "delivery": "msg_id long, ts timestamp_ntz, recipient string, recipient_domain string, route string, result string, detail string, msg_ts timestamp_ntz, "
    "remote_ip string, remote_code int, remote_status string, reason string",
    "daily_stats": "day date, domain string, direction string, messages long, bytes long, successes long, deferrals long, failures long",
    "queue_minute": "minute timestamp_ntz, local_max_used long, local_limit long, remote_max_used long, remote_limit long",
    "service_minute": "minute timestamp_ntz, service string, connects long, messages long, max_concurrency long, limit_value long",
    "auth_event": "id long, ts timestamp_ntz, service string, result string, user_name string, client_ip string, method string, tls boolean",
    "ban_event": "ts timestamp_ntz, jail string, ip string, action string",
    "parser_state": "logdir string, bytes long",
    "heartbeat": "ts timestamp_ntz",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(rows: DataFrame, table: str) -> DataFrame:
    """rows with exactly the table's columns: missing ones are null, others go, numbers are widened. A missing id is made from the row."""
    key = [c for c in ("ts", "service", "result", "user_name", "client_ip") if c in rows.columns]
    made = {"id": F.xxhash64(*key)} if table == "auth_event" else {}
    absent = lambda f: made.get(f.name, F.lit(None))
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else absent(f)).cast(f.dataType).alias(f.name) for f in schema(table)])


def read_stored(spark: SparkSession, table: str, *paths: str) -> DataFrame:
    """Parquet folders of any age as one table: what an old file lacks is null, its narrower numbers are widened, columns that the table no longer has go."""
    return spark.read.schema(schema(table)).parquet(*paths)
