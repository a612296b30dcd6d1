"""Islands of records that reach over many slices, against a greedy match in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postlens.operators import correlate
from postlens.shared import Aside

T0 = dt.datetime(2026, 9, 15, 10)
AT = lambda us: T0 + dt.timedelta(microseconds=us)


def greedy(smtp, queue, seconds):
    """Takes records in order of arrival, looking at every free record of the second around it."""
    free = {}
    for us, i in smtp:
        free.setdefault(us // 1_000_000, set()).add((us, i))
    want = set()
    for us, q in sorted(queue):
        near = None
        for away in range(seconds + 2):  # seconds nearer first; what lies a whole second farther can't be nearer
            for k in {us // 1_000_000 - away, us // 1_000_000 + away}:
                for t, i in free.get(k, ()):
                    if abs(t - us) <= seconds * 1_000_000:
                        near = min(near or (abs(t - us), t, i), (abs(t - us), t, i))
            if near and near[0] < away * 1_000_000:
                break
        if near:
            free[near[1] // 1_000_000].remove(near[1:])
            want.add((q, near[2]))
    return want


def frames(spark, smtp, queue):
    a = spark.createDataFrame([("s@a.test", i, AT(us)) for us, i in smtp], "sender string, qp long, ts timestamp_ntz").withColumn("queue_qp", F.lit(None).cast("long"))
    return a, spark.createDataFrame([("s@a.test", i, AT(us)) for us, i in queue], "sender string, queue_qp long, queue_ts timestamp_ntz")


@pytest.mark.parametrize("seed", range(2))
def test_slices_give_the_match_in_order(spark, seed):
    """Times on whole seconds, so that there are many ties, and more records of one side than of the other."""
    r = random.Random(seed)
    smtp = [(r.randrange(240) * 1_000_000, i) for i in range(200 + 150 * seed)]
    queue = [(r.randrange(240) * 1_000_000, i) for i in range(500 - 150 * seed)]
    a, b = frames(spark, smtp, queue)
    got = [(x.queue_qp, x.qp) for x in correlate.correlate(a, b, 5, 2).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(smtp, queue, 5)


def test_one_record_shifts_a_whole_island(spark):
    """Each queue record takes what the next one would have taken, from the first slice to the last."""
    smtp = [(4_000_000 * i, i) for i in range(60)]
    queue = [(0, 1_000)] + [(4_000_000 * i + 1_900_000, i) for i in range(60)]
    a, b = frames(spark, smtp, queue)
    got = {(x.queue_qp, x.qp) for x in correlate.correlate(a, b, 5, 2).collect()}
    assert got == greedy(smtp, queue, 5) and (50, 51) in got and (59, 59) not in got


def test_a_thousand_records_a_second(spark):
    r = random.Random(7)
    smtp = [(1_000 * i + r.randrange(1_000), i) for i in range(20_000)]
    queue = [(us + 600_000 + r.randrange(200_000), i) for us, i in smtp if r.random() < 0.9]
    a, b = frames(spark, smtp, queue)
    rows = correlate.islands(a, b, 1)
    assert rows.select("island").distinct().count() == 1
    dealt = correlate.slices(rows, 1, 2_000_000).groupBy("slice").count().collect()
    assert len(dealt) >= 10 and max(x["count"] for x in dealt) < len(smtp) * 2 / 5
    assert {(x.queue_qp, x.qp) for x in correlate.correlate(a, b, 1, 2).collect()} == greedy(smtp, queue, 1)


def test_only_the_pairs_stay(spark):
    smtp, queue = [(1_000_000 * i, i) for i in range(60)], [(1_000_000 * i, i) for i in range(60)]
    written, write = [], Aside.write

    def noted(self, rows):
        out = write(self, rows)
        written.append(self.paths[id(out)][1])
        return out

    Aside.write = noted
    try:
        out = correlate.correlate(*frames(spark, smtp, queue), 5, 2)
    finally:
        Aside.write = write
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    exists = [hadoop.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(p)) for p in written]
    assert sum(exists) == 1 and out.count() == 60


def test_no_records(spark):
    a, b = frames(spark, [(0, 1)], [(0, 1)])
    assert correlate.correlate(a.limit(0), b, 5).count() == 0 and correlate.correlate(a, b.limit(0), 5).count() == 0
    assert correlate.correlate(a, b, 0).count() == 1
