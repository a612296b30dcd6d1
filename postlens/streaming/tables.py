"""Tables that grow by batches: what any batches of log records give is what one run over all of them gives.

Tables are Parquet, by day. A batch rewrites only the days that it touches. Both sides of a
message are matched anew where a batch adds to an island of records (see operators.correlate);
queue records without a partner stay rows of their own and are tried again when an SMTP record
comes near. Minutes are kept as contributions of a stream's batches and summed when read.

One writer at a time. A ledger notes the batches that are done; one that was broken off, or
runs again, changes nothing that it has already changed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens.functions import lines as L
from postlens.functions import text as T
from postlens.operators import assemble, correlate, merge
from postlens.plans.schema import conform, schema
from postlens.sources import derived, logs
from postlens.sources.growing import follow
from postlens.streaming import ingest, keyed

#: What the queue tells of a message.
QUEUE = ["msg_id", "size_bytes", "queue_qp", "queue_ts"]
DAY = dt.timedelta(days=1)


class Tables:
    """message, delivery and minutes below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, seconds: int = correlate.SECONDS):
        self.spark, self.root, self.seconds = spark, root.rstrip("/"), seconds

    def _fs(self, path: str):
        to = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return to, to.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        to, fs = self._fs(path)
        return fs.exists(to)

    def _names(self, path: str) -> list[str]:
        to, fs = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(to)] if fs.exists(to) else []

    def _stored(self, table: str) -> DataFrame:
        """The table with its day; no rows before the first batch."""
        columns = schema(table).add("day", "date")
        path = f"{self.root}/{table}"
        return self.spark.read.schema(columns).parquet(path) if self._exists(path) else self.spark.createDataFrame([], columns)

    def read(self, table: str) -> DataFrame:
        if table in ("service_minute", "queue_minute"):
            return conform(self._minutes(table), table)
        return self._stored(table).drop("day")

    # The ledger.

    def done(self, stream: str, batch: int) -> bool:
        return self._exists(f"{self.root}/_ledger/{stream}/{batch}")

    def note(self, stream: str, batch: int) -> None:
        to, fs = self._fs(f"{self.root}/_ledger/{stream}/{batch}")
        fs.create(to, True).close()

    # Messages and deliveries.

    def _rewrite(self, rows: DataFrame, days: set[dt.date]) -> None:
        """Puts rows in the place of the days of message; days without rows are emptied."""
        aside = f"{self.root}/_message"
        rows.write.mode("overwrite").parquet(aside)
        rows = self.spark.read.schema(rows.schema).parquet(aside)
        kept = {r.day for r in rows.select("day").distinct().collect()}
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.root}/message")
        for day in days - kept:
            to, fs = self._fs(f"{self.root}/message/day={day}")
            fs.delete(to, True)

    def _directed(self, rows: DataFrame, days: set[dt.date]) -> DataFrame:
        """Rows of these days (of message, with day); those that only the queue saw get their direction from the deliveries known so far."""
        delivery = self._stored("delivery")
        if days:
            delivery = delivery.filter((F.col("day") >= F.lit(min(days))) & F.to_date("msg_ts").isin(sorted(days)))
        return merge.infer_direction(rows, delivery)

    def add_messages(self, smtp: DataFrame | None = None, queue: DataFrame | None = None) -> None:
        """Merges SMTP records (qp, ts, sender and others, with seq) and queue records (queue_qp, queue_ts, sender, msg_id, size_bytes).

        Records that are stored already change nothing; of SMTP records of one (qp, ts) later fields count, as in merge.upsert_messages.
        """
        no = lambda table: self.spark.createDataFrame([], schema(table))
        nulls = {c: F.lit(None).cast(schema("message")[c].dataType) for c in QUEUE}
        smtp = conform(smtp.withColumns(nulls), "message").withColumn("seq", F.lit(1)) if smtp is not None else no("message").withColumn("seq", F.lit(1))
        if queue is None:
            queue = no("message")
        queue = queue.select(*QUEUE, "sender").dropDuplicates(["queue_qp", "queue_ts", "sender"])
        smtp, queue = (self._aside(x, n) for x, n in ((smtp, "_smtp"), (queue, "_queue")))
        new = {r.d for r in smtp.select(F.to_date("ts").alias("d")).union(queue.select(F.to_date("queue_ts"))).distinct().collect()}
        if not new:
            return
        days = {d + k * DAY for d in new for k in (-1, 0, 1)}
        while True:
            stored = self._stored("message").filter(F.col("day").isin(sorted(days))).drop("day")
            rows = self._aside(merge.upsert_messages(stored.withColumn("seq", F.lit(0)).unionByName(smtp)).drop("seq"), "_rows")
            carried = stored.filter("queue_qp is not null").select(*QUEUE, "sender")
            fresh = self._aside(merge.not_applied(queue, stored).select(*QUEUE, "sender"), "_fresh")
            sides = rows.filter("qp is not null").withColumns(nulls), carried.unionByName(fresh)
            records = self._aside(correlate.islands(sides[0].filter("sender is not null"), sides[1].filter("sender is not null"), self.seconds), "_islands")
            added = smtp.select(F.lit("smtp").alias("side"), "sender", F.col("qp").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
            added = added.unionByName(fresh.select(F.lit("queue").alias("side"), "sender", F.col("queue_qp").alias("id"), F.unix_micros(F.col("queue_ts").cast("timestamp")).alias("us")))
            touched = records.join(added.distinct(), ["side", "sender", "id", "us"], "left_semi").select("sender", "island").distinct()
            records = self._aside(records.join(touched, ["sender", "island"], "left_semi"), "_records")
            gap = self.seconds * 1_000_000
            near = [F.to_date(F.timestamp_micros(F.col("us") + k).cast("timestamp_ntz")) for k in (-gap, gap)]
            reached = {r.d for r in records.select(F.explode(F.array(*near)).alias("d")).distinct().collect()} - days
            if not reached:
                break
            days |= reached  # an island goes on beyond the days that were read
        of = lambda side, id_, ts: records.filter(F.col("side") == side).select("sender", F.col("id").alias(id_), F.timestamp_micros("us").cast("timestamp_ntz").alias(ts))
        on_smtp, on_queue = of("smtp", "qp", "ts").distinct(), of("queue", "queue_qp", "queue_ts").distinct()
        smtp_side, queue_side = sides[0].join(on_smtp, ["sender", "qp", "ts"], "left_semi"), sides[1].join(on_queue, ["sender", "queue_qp", "queue_ts"], "left_semi")
        queue_side = queue_side.withColumns({"ts": F.col("queue_ts"), "direction": F.lit("out")})
        matched = conform(correlate.merge_sides(smtp_side, queue_side, self.seconds), "message")
        # What stays as it is: rows of no touched island. Queue records without a sender are matched by none.
        stays = rows.join(on_smtp, ["sender", "qp", "ts"], "left_anti").filter("qp is not null").unionByName(
            rows.filter("qp is null").join(on_queue, ["sender", "queue_qp", "queue_ts"], "left_anti")
        )
        nameless = fresh.filter("sender is null").withColumns({"ts": F.col("queue_ts"), "direction": F.lit("out")})
        rows = conform(stays, "message").unionByName(matched).unionByName(conform(nameless, "message"))
        rows = rows.withColumns({"sender_domain": T.domain_of(F.col("sender")), "day": F.to_date("ts")})
        changed = new | {r.d for r in records.select(F.to_date(F.timestamp_micros("us").cast("timestamp_ntz")).alias("d")).distinct().collect()}
        self._rewrite(self._directed(rows.filter(F.col("day").isin(sorted(changed))), changed), changed)

    def _aside(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def add_deliveries(self, made: DataFrame) -> None:
        """Merges deliveries (assemble.deliveries' columns, with seq); those that are stored already, or repeated, are left out."""
        rows = merge.dedupe_deliveries(derived.delivery_fields(made))
        rows = self._aside(conform(rows, "delivery").withColumn("day", F.to_date("ts")), "_delivery")
        days = [r.day for r in rows.select("day").distinct().collect()]
        key = ["msg_id", "msg_ts", "ts", "recipient", "result"]
        known = self._stored("delivery").filter(F.col("day").isin(days)).select(*key)
        fresh = self._aside(rows.join(known, [rows[k].eqNullSafe(known[k]) for k in key], "left_anti"), "_new")
        fresh.write.mode("append").partitionBy("day").parquet(f"{self.root}/delivery")
        # Messages that only the queue saw may now be known to be incoming.
        days = {r.d for r in rows.select(F.to_date("msg_ts").alias("d")).distinct().collect()}
        message = self._stored("message").filter(F.col("day").isin(sorted(days)))
        if message.filter("qp is null").limit(1).count():
            self._rewrite(self._directed(message, days), days)

    # Minutes.

    def add_minutes(self, table: str, rows: DataFrame, stream: str, batch: int) -> None:
        """Puts a batch's minutes (columns of merge_service_minutes or merge_queue_minutes) beside those of other batches; again, in their own place."""
        path = f"{self.root}/{table}"
        if batch > self._summed(path, stream):
            rows.withColumns({"stream": F.lit(stream), "seq": F.lit(batch)}).write.mode("overwrite").parquet(f"{path}/parts/{stream}/{batch}")

    def _summed(self, path: str, stream: str) -> int:
        """The last batch that the stream's sums hold; -1 if none."""
        return max((int(x) for x in self._names(f"{path}/sums/{stream}") if self._exists(f"{path}/sums/{stream}/{x}/_SUCCESS")), default=-1)

    def _paths(self, path: str, stream: str) -> list[str]:
        upto = self._summed(path, stream)
        parts = [f"{path}/parts/{stream}/{x}" for x in self._names(f"{path}/parts/{stream}") if int(x) > upto]
        return [p for p in parts if self._exists(f"{p}/_SUCCESS")] + ([f"{path}/sums/{stream}/{upto}"] if upto >= 0 else [])

    def _streams(self, path: str) -> set[str]:
        return set(self._names(f"{path}/parts")) | set(self._names(f"{path}/sums"))

    def _minutes(self, table: str, stream: str | None = None) -> DataFrame:
        path = f"{self.root}/{table}"
        paths = [p for s in ([stream] if stream else self._streams(path)) for p in self._paths(path, s)]
        if not paths:
            return self.spark.createDataFrame([], schema(table))
        rows = self.spark.read.parquet(*paths)
        return merge.merge_service_minutes(rows) if table == "service_minute" else merge.merge_queue_minutes(rows)

    def compact(self, table: str) -> None:
        """Sums each stream's contributions; sums are named after the last batch they hold, so a batch counts in one place only."""
        path = f"{self.root}/{table}"
        for stream in self._streams(path):
            batches = [int(x) for x in self._names(f"{path}/parts/{stream}") if self._exists(f"{path}/parts/{stream}/{x}/_SUCCESS")]
            upto, before = max(batches, default=-1), self._summed(path, stream)
            if upto <= before:
                continue
            self._minutes(table, stream).withColumns({"stream": F.lit(stream), "seq": F.lit(upto)}).write.mode("overwrite").parquet(f"{path}/sums/{stream}/{upto}")
            for old in [f"parts/{stream}/{b}" for b in batches] + ([f"sums/{stream}/{before}"] if before >= 0 else []):
                to, fs = self._fs(f"{path}/{old}")
                fs.delete(to, True)


def run_once(tables: Tables, root: str, logdirs: dict[str, str], checkpoints: str, envelope_fallback: bool = False, clock=None) -> None:
    """One pass over what the logs root/logdir (of each role) have gained: messages, deliveries and minutes are merged into the tables."""
    spark = tables.spark
    ntz = lambda rows, *cs: rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cs})

    def into(stream: DataFrame, name: str, add) -> StreamingQuery:
        def once(batch: DataFrame, number: int) -> None:
            if not tables.done(name, number):
                add(batch, number)
                tables.note(name, number)

        writer = stream.writeStream.option("checkpointLocation", f"{checkpoints}/{name}").trigger(availableNow=True)
        return writer.foreachBatch(once).start()

    for folder, role in logs.check_roles(logdirs).items():
        lines = ingest.labelled(follow(spark, root, [folder]))
        if role == "send":
            parsed = L.parse_send(lines)

            def add(batch: DataFrame, number: int, folder=folder) -> None:
                batch = ntz(batch, "ts")
                tables.add_messages(queue=assemble.queue_messages(batch))
                tables.add_minutes("queue_minute", assemble.queue_minutes(batch).drop("logdir"), folder, number)

            queries = [(parsed, f"{folder}-lines", add), (keyed.deliveries(parsed, clock), f"{folder}-deliveries", lambda b, _: tables.add_deliveries(ntz(b, "ts", "msg_ts")))]
        else:
            parsed = L.parse_smtp(lines)

            def add(batch: DataFrame, number: int, folder=folder, role=role) -> None:
                minutes = assemble.service_minutes(ntz(batch, "ts")).drop("logdir").withColumn("service", F.lit(role))
                tables.add_minutes("service_minute", minutes, folder, number)

            made = keyed.smtp_messages(parsed, logs.ROLES[role], envelope_fallback, clock)
            queries = [(parsed, f"{folder}-lines", add), (made, f"{folder}-messages", lambda b, _: tables.add_messages(smtp=ntz(b, "ts")))]
        for query in queries:
            into(*query).awaitTermination()
