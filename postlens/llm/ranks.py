"""Places and running sums in a total order, without a task that holds a group.

Rows are sorted over partitions by group and order and written; each partition's part of a
group is summed to one row, and the sums of the parts before it are carried over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.llm.scratch import materialize

PART, AT = "_part", "_at"  # a row's partition, and a number that grows within it


def sorted_runs(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows as a written table, with PART and AT: sorted by group (not null), order and, for rows alike in these, place in the input.

    The place keeps rows alike in all apart, so that many of them don't meet in one partition.
    """
    rows = rows.withColumn("_nth", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(group, *order, "_nth").sortWithinPartitions(group, *order, "_nth").drop("_nth")
    return materialize(rows.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()}))


def parts(runs: DataFrame, group: str, *sums: str) -> DataFrame:
    """PART, group, _first (its least AT there), _before and _n (rows before it in its group, and of the group in all).

    For each of sums: before_<name> and all_<name>, the sum over the group's parts before it and over all of the group.
    One row for each partition and group, so a group has at most as many rows as there are partitions.
    """
    here = runs.groupBy(PART, group).agg(F.min(AT).alias("_first"), F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    whole = Window.partitionBy(group)
    so_far = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    return here.select(
        PART, group, "_first", before("n").alias("_before"), F.sum("n").over(whole).alias("_n"),
        *[before(c).alias(f"before_{c}") for c in sums], *[F.sum(c).over(whole).alias(f"all_{c}") for c in sums],
    )


def placed(runs: DataFrame, splits: DataFrame, group: str, *sums: str) -> DataFrame:
    """runs with splits' columns, and place: a row's number (from 0) in its group. Of sums, before_<name> becomes the sum of all rows before it.

    splits: of parts, whatever was joined to it. Rows meet splits by partition and group, so a large group is many keys.
    """
    within = Window.partitionBy(PART, group).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    run = {f"_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}
    rows = runs.withColumns(run) if run else runs
    rows = rows.join(splits, [PART, group]).withColumn("place", F.col("_before") + F.col(AT) - F.col("_first"))
    return rows.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_{c}") for c in sums}).drop("_first", "_before", *run)
