"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on the ring; the arc before a point belongs to it. A row
goes to the shard that it meets first clockwise; rows that a full shard can't take go on to
the next shard that they meet. Capacities differ by one row at most, so the law is "rows".

What decides the placement is counted by arc (shards x vnodes numbers, however many rows
there are), and a row's place follows from its rank on its arc. Ranks are made in two
steps, by fine ring bucket and within it, so no task holds a shard or an arc.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.llm.scratch import materialize

CELL_DIGITS, BUCKET_DIGITS, PLACE_DIGITS = 3, 5, 13  # hexadecimal digits of a place on the ring
CELLS = 16**CELL_DIGITS


def ring(spark, shards: int, vnodes: int) -> tuple[DataFrame, DataFrame]:
    """cell, arc for each ring cell; and one row: prefs, for each arc the shards in the order met."""
    node = F.concat_ws(":", F.lit("node"), "shard", "replica")
    nodes = spark.range(shards * vnodes, numPartitions=1).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("replica")
    )
    nodes = nodes.select(
        F.conv(F.substring(F.md5(node), 1, CELL_DIGITS), 16, 10).cast("int").alias("cell"), "shard", "replica"
    )
    cells = spark.range(CELLS, numPartitions=1).select(F.col("id").cast("int").alias("cell"), F.lit(0).alias("n"))
    cells = cells.unionAll(nodes.select("cell", F.lit(1))).groupBy("cell").agg(F.sum("n").alias("n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows
    cells = cells.select("cell", (F.coalesce(F.sum("n").over(before), F.lit(0)) % (shards * vnodes)).cast("int").alias("arc"))
    nodes = nodes.agg(F.sort_array(F.collect_list(F.struct("cell", "shard", "replica"))).alias("s"))
    nodes = nodes.select(F.transform("s", lambda x: x["shard"]).alias("s"))
    met = lambda a: F.array_distinct(
        F.concat(F.slice("s", a + 1, F.lit(shards * vnodes)), F.slice("s", F.lit(1), a))
    )
    return cells, nodes.select(F.transform(F.sequence(F.lit(0), F.lit(shards * vnodes - 1)), met).alias("prefs"))


def _intervals(counts: DataFrame, prefs: DataFrame, shards: int, arcs: int) -> DataFrame:
    """Which ranks of each arc go where: arc, hops, shard, lo, n, base (the slot of rank lo).

    counts: arc, n; at most ``arcs`` rows. In round r each arc offers the rows left to the
    r-th shard that it meets, arcs in ring order, and the shard takes what it has room for.
    After as many rounds as there are shards every row has met every shard.
    """
    one = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("arc", "n"))).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    )  # one row
    one = one.join(F.broadcast(prefs))
    one = one.select(
        "prefs",
        F.expr(f"transform(sequence(0, {arcs - 1}), a -> coalesce(m[a], 0L))").alias("left"),
        F.expr(f"transform(sequence(0, {shards - 1}), s -> total div {shards} + if(s < total % {shards}, 1L, 0L))").alias("room"),
    )
    pair = f"prefs[i % {arcs}][i div {arcs}]"
    took = f"least(a.left[i % {arcs}], a.room[{pair}])"
    out = one.select(
        "prefs",
        F.expr(f"""
          aggregate(sequence(0, {arcs * shards - 1}),
            named_struct('left', left, 'room', room, 'took', cast(array() as array<bigint>)),
            (a, i) -> named_struct(
              'left', transform(a.left, (v, j) -> if(j = i % {arcs}, v - {took}, v)),
              'room', transform(a.room, (v, j) -> if(j = {pair}, v - {took}, v)),
              'took', concat(a.took, array({took}))),
            a -> a.took)""").alias("took"),
    )
    out = out.select("prefs", F.posexplode("took").alias("i", "n")).filter("n > 0")
    out = out.select(
        F.expr(f"i % {arcs}").alias("arc"), F.expr(f"i div {arcs}").cast("int").alias("hops"), F.expr(pair).alias("shard"), "i", "n"
    )
    before = lambda *by: Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(
        "arc", "hops", "shard", "n",
        F.coalesce(F.sum("n").over(before("arc")), F.lit(0)).alias("lo"),
        F.coalesce(F.sum("n").over(before("shard")), F.lit(0)).alias("base"),
    )


def shard(
    docs: DataFrame, shards: int = 8, vnodes: int = 32, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot, home_shard, hops.

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty. Slots run from 0
    without gaps in each shard; long texts are only measured and summed. hops is 0 where a row stays in the shard that it met first.
    Rows are ordered on their arc by ring place, id, checksum and size; rows equal in all
    of these take neighbouring slots in any order. An empty table gives no rows; other
    columns of docs are not looked at.
    """
    spark, arcs = docs.sparkSession, shards * vnodes
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    place = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"))
    rows = rows.withColumn("place", F.substring(place, 1, PLACE_DIGITS))
    rows = materialize(rows.withColumn("bucket", F.conv(F.substring("place", 1, BUCKET_DIGITS), 16, 10).cast("int")))

    cells, prefs = map(materialize, ring(spark, shards, vnodes))
    homes = prefs.select(F.posexplode("prefs").alias("arc", "p")).select("arc", F.col("p")[0].alias("home_shard"))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # 16^5 rows at most
    buckets = buckets.withColumn("cell", F.expr(f"bucket div {16 ** (BUCKET_DIGITS - CELL_DIGITS)}").cast("int"))
    buckets = buckets.join(F.broadcast(cells), "cell")
    intervals = _intervals(buckets.groupBy("arc").agg(F.sum("n").alias("n")), prefs, shards, arcs)
    before = Window.partitionBy("arc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("bucket", "arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    within = Window.partitionBy("bucket").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(buckets, "bucket")
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("offset"))
    where = (F.col("r.arc") == F.col("i.arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n"))
    placed = ranked.alias("r").join(F.broadcast(intervals.alias("i")), where).drop(F.col("i.arc"))
    return placed.join(F.broadcast(homes), "arc").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), "home_shard", "hops"
    )


def query(spark, sf_dir):
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard", "hops",
    )
