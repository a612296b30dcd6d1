"""Matching the two sides of a message: queue records onto SMTP records.

The logs share no number. A queue record takes the nearest free SMTP record of its sender
within a few seconds, in the order of arrival. Records of a sender more than that apart
cannot compete, so a sender's records are cut into islands at larger gaps and every island
is matched by itself. Gaps are found in ranges of time, so a busy sender is spread over many
tasks for that. A long island is matched in slices of time, side by side (see settle).
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.shared import Aside

SECONDS, SPAN = 5, 3_600
SLICE = ["sender", "island", "slice"]
PAIR = [*SLICE, "queue_qp", "queue_us", "qp", "us"]


def islands(smtp: DataFrame, queue: DataFrame, seconds: int = SECONDS, span: int = SPAN) -> DataFrame:
    """sender, island (when it begins), side, id, us (microseconds) of the records of both sides that may be matched."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("us")
    a = smtp.filter("qp is not null and queue_qp is null").select("sender", F.lit("smtp").alias("side"), F.col("qp").alias("id"), us("ts"))
    b = queue.select("sender", F.lit("queue").alias("side"), F.col("queue_qp").alias("id"), us("queue_ts"))
    rows = a.unionByName(b).withColumn("range", F.expr(f"floor(us / {span * 1_000_000})"))
    w, gap = Window.partitionBy("sender", "range").orderBy("us", "side", "id"), seconds * 1_000_000
    rows = rows.withColumn("last", F.lag("us").over(w))
    new = F.col("last").isNull() | (F.col("us") - F.col("last") > gap)
    rows = rows.withColumn("begins", F.last(F.when(new, F.col("us")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A range's first run of records belongs to what comes before if that is near: one row a range.
    ends = rows.groupBy("sender", "range").agg(F.min("us").alias("low"), F.max("us").alias("high"), F.max("begins").alias("latest"))
    order = Window.partitionBy("sender").orderBy("range")
    ends = ends.withColumn("joins", F.coalesce(F.col("low") - F.lag("high").over(order) <= gap, F.lit(False)))
    own = F.when(~F.col("joins") | (F.col("latest") > F.col("low")), F.col("latest"))  # where the island at the range's end begins, if in it
    ends = ends.withColumn("open", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select("sender", "range", "low", F.when(F.col("joins"), F.col("open")).alias("open"))
    rows = rows.join(ends, ["sender", "range"])
    island = F.when(F.col("begins") == F.col("low"), F.coalesce("open", "begins")).otherwise(F.col("begins"))
    return rows.select("sender", island.alias("island"), "side", "id", "us")


def slices(rows: DataFrame, seconds: int, size: int) -> DataFrame:
    """The records of islands with the slice of ``size`` microseconds they lie in, counted from the island's begin.

    A queue record lies in one slice. An SMTP record that a queue record of the slice before
    or after may take lies in that one too; size is at least twice the seconds, so no other can.
    """
    limit, smtp = seconds * 1_000_000, F.col("side") == "smtp"
    rows = rows.withColumn("own", F.expr(f"(us - island) div {size}"))
    at = F.col("us") - F.col("island") - F.col("own") * size
    before = F.when(smtp & (at < limit) & (F.col("own") > 0), F.col("own") - 1)
    after = F.when(smtp & (at >= size - limit), F.col("own") + 1)
    return rows.withColumn("slice", F.explode(F.array_compact(F.array("own", before, after)))).select(*SLICE, "side", "id", "us")


def gone(pairs: DataFrame, seconds: int, size: int) -> DataFrame:
    """The SMTP records that are taken when a slice begins, by the slice before it, and which it may reach."""
    limit = seconds * 1_000_000
    rows = pairs.filter(F.col("us") >= F.col("island") + (F.col("slice") + 1) * size - limit)
    return rows.select("sender", "island", (F.col("slice") + 1).alias("slice"), F.lit("gone").alias("side"), F.col("qp").alias("id"), "us")


def take_nearest(free: list[tuple[int, int]], us: int, limit: int) -> tuple[int, int] | None:
    """Takes the nearest (us, id) out of a sorted list, of equally near ones the earlier, of equal times the smaller id."""
    after = bisect_right(free, (us, math.inf))
    best = bisect_left(free, (free[after - 1][0], -math.inf)) if after else None
    if after < len(free) and (best is None or free[after][0] - us < us - free[best][0]):
        best = after
    return free.pop(best) if best is not None and abs(free[best][0] - us) <= limit else None


def _match(seconds: int):
    limit = seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by sender, island, slice, time and side, with all of a slice in one task."""
        key, free, taken, waiting = None, [], Counter(), deque()  # free: sorted (us, id) that may still be taken

        def settled(upto: int | None) -> list[tuple]:
            """Matches of the queue records whose SMTP records have all been seen."""
            out = []
            while waiting and (upto is None or waiting[0][0] + limit < upto):
                us, id_ = waiting.popleft()
                del free[: bisect_left(free, (us - limit, -math.inf))]
                if near := take_nearest(free, us, limit):
                    out.append((*key, id_, us, near[1], near[0]))
            return out

        for batch in batches:
            rows = []
            for *own, side, id_, us in zip(*(batch[c] for c in (*SLICE, "side", "id", "us")), strict=True):
                if own != key:
                    rows += settled(None) if key else []
                    key, free = own, []
                    taken.clear()
                rows += settled(us)
                if side == "gone":
                    taken[us, id_] += 1
                elif side == "queue":
                    waiting.append((us, id_))
                elif taken[us, id_] > 0:
                    taken[us, id_] -= 1
                else:
                    free.append((us, id_))
                    if not waiting:  # the next queue record is no earlier
                        del free[: bisect_left(free, (us - limit, -math.inf))]
            yield pd.DataFrame(rows, columns=PAIR)
        yield pd.DataFrame(settled(None) if key else [], columns=PAIR)

    return run


def _matched(rows: DataFrame, seconds: int) -> DataFrame:
    rows = rows.repartition(*SLICE).sortWithinPartitions(*SLICE, "us", "side", "id")  # at equal times "gone" comes first
    return rows.mapInPandas(_match(seconds), "sender string, island long, slice long, queue_qp long, queue_us long, qp long, us long")


def settle(aside: Aside, rows: DataFrame, seconds: int, size: int) -> DataFrame:
    """The pairs of islands' records, matched by slices side by side.

    What a slice gives depends on the records that the slice before it has taken near the
    border. All slices first run as if there were none, then those run again for which this
    was wrong, until none is left. An island whose slices depend on each other over a long
    way, so that a round does not halve those to be run again, is cut into longer slices, in
    the end into one; so the work is bounded and the result exact in each case.
    """
    first = aside.write(_matched(slices(rows, seconds, size), seconds))
    if gone(first, seconds, size).isEmpty():  # most records: no match reaches over a border
        return first
    pairs, seen, last = first, None, None
    while True:
        now = aside.write(gone(pairs, seconds, size))
        other = now if seen is None else now.exceptAll(seen).unionAll(seen.exceptAll(now))
        wrong = aside.write(other.select(*SLICE).distinct())
        n = wrong.count()
        if not n:
            return pairs
        if seen is None:
            long = now.select("sender", "island").distinct()
            rows = aside.write(rows.join(long, ["sender", "island"], "left_semi"))
        elif 2 * n > last:
            slow = aside.write(wrong.select("sender", "island").distinct())
            done = pairs.join(slow, ["sender", "island"], "left_anti")
            return done.unionByName(settle(aside, rows.join(slow, ["sender", "island"], "left_semi"), seconds, 4 * size))
        again = slices(rows, seconds, size).unionByName(now).join(wrong, SLICE, "left_semi")
        pairs = aside.write(pairs.join(wrong, SLICE, "left_anti").unionByName(_matched(again, seconds)))
        seen, last = now, n


def correlate(smtp: DataFrame, queue: DataFrame, seconds: int = SECONDS, size: int = 720) -> DataFrame:
    """sender, queue_qp, queue_ts, qp, ts of the matched pairs, one to one.

    Equal distances go to the earlier record, equal times to the smaller number. Islands are
    matched in slices of ``size`` times the seconds, 2 at least: an hour, unless set otherwise. The pairs are a table below
    spark.checkpoint.dir; nothing else that is written on the way stays.
    """
    rows = islands(smtp.filter("sender is not null"), queue.filter("sender is not null"), seconds)
    with Aside(smtp.sparkSession) as aside:
        out = settle(aside, rows, seconds, max(size, 2) * max(seconds, 1) * 1_000_000)
        out = aside.keep(out if id(out) in aside.paths else aside.write(out))
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select("sender", "queue_qp", time("queue_us").alias("queue_ts"), "qp", time("us").alias("ts"))


def merge_sides(smtp: DataFrame, queue: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """SMTP records with the queue's fields where matched, and the unmatched queue records as records of their own."""
    pairs = correlate(smtp, queue, seconds)
    fields = queue.select("sender", "queue_qp", "queue_ts", F.col("msg_id").alias("q_msg_id"), F.col("size_bytes").alias("q_size"))
    found = pairs.join(fields, ["sender", "queue_qp", "queue_ts"]).withColumnsRenamed({"queue_qp": "q_qp", "queue_ts": "q_ts"})
    rows = smtp.join(found, ["sender", "qp", "ts"], "left").withColumns({
        "msg_id": F.coalesce("q_msg_id", "msg_id"), "size_bytes": F.coalesce("q_size", "size_bytes"), "queue_qp": F.coalesce("q_qp", "queue_qp"),
        "queue_ts": F.coalesce("q_ts", "queue_ts"),
    }).select(smtp.columns)
    alone = queue.join(pairs.select("sender", "queue_qp", "queue_ts"), ["sender", "queue_qp", "queue_ts"], "left_anti")
    return rows.unionByName(alone, allowMissingColumns=True)
