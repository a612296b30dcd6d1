"""Mixing sources to target weights: blocks of equal numbers of words, given to sources by highest quotients.

A source's documents, in a seeded order, are one line of words that is cut into blocks. Of
all blocks of the mix each source gets as many seats as it has quotients
target / (2 k - 1), k = 1, 2, ..., among the highest; a shard of the mix is a range of these
quotients, so each source has a whole number of seats in each shard. A source's seats go to
its blocks in another seeded order, once round and then again. Only DataFrame functions are used.

Sources are counted, ordered and served as tables too, so there may be any number of them;
a source's rows are spread over partitions by their place in its line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm import ranks
from postlens.llm.scratch import discard, materialize

# The weights of the first, second and third source, and so on in turn; the mix in percent of all words; the most times a word is taken.
WEIGHTS, PERCENT, TIMES = (5, 2, 1), 150, 2
WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SHARDS = 64, 8


def _ordered(rows: DataFrame, *order: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """rows with place, before_ and all_ of sums over the whole table in this order."""
    rows = rows.withColumn("_one", F.lit(""))
    runs = ranks.sorted_runs(rows, "_one", *order)
    return ranks.placed(runs, ranks.parts(runs, "_one", *sums), "_one", *sums).drop("_one", "_n", ranks.PART, ranks.AT)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, times: int = TIMES) -> DataFrame:
    """source, size to source, size, rank, target, share (whole numbers in the target's proportion), total (words of all sources).

    Sources share percent of all words by weight, in code point order; one that would get more
    than ``times`` its size gets that, and the others share what is left, as often as needed:
    in the order of size over weight these are the first ones, up to one that stays below.
    """
    n, common = len(weights), math.lcm(*weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % n + 1).cast("int"))
    rows = _ordered(sources, "source").withColumnRenamed("place", "rank")
    rows = rows.withColumn("weight", weight.cast("long")).withColumn("ratio", F.col("size") * (F.lit(common) / F.col("weight")).cast("long"))
    rows = materialize(_ordered(rows, "ratio", "rank", sums=("size", "weight")))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    # In hundredths of words: what is left for this source and those after it, and their weights.
    left = percent * wide("all_size") - 100 * times * wide("before_size")
    rest = wide("all_weight") - wide("before_weight")
    full = 100 * times * wide("size") * rest <= wide("weight") * left
    free = rows.filter(~full).groupBy().agg(F.min_by(F.struct(left.alias("left"), rest.alias("rest")), "place").alias("f"))  # one row
    rows = rows.join(F.broadcast(free)).withColumn("full", F.col("f").isNull() | full)
    capped, shared = F.col("size") * times, (F.col("weight") * F.col("f.left")).cast("double") / (100 * F.col("f.rest")).cast("double")
    return rows.select("source", "size", "rank", F.when(F.col("full"), capped.cast("double")).otherwise(shared).alias("target"), F.col("all_size").alias("total"))


def seats(sources: DataFrame, block: int = BLOCK, percent: int = PERCENT, times: int = TIMES) -> DataFrame:
    """sources (of targets) with blocks, and seats: those of a source's quotients that are among the highest, as many in all as the mix has blocks.

    Rounding each source's share gives almost all seats; what is missing goes to the highest
    of the next quotients, what is too much leaves the lowest. No source gets more seats than ``times`` its blocks.
    """
    mix = F.expr(f"({percent} * total + {50 * block}) div {100 * block}")
    rows = sources.withColumns({"blocks": F.expr(f"(size + {block - 1}) div {block}"), "mix": mix})
    fair = F.col("target") * F.col("mix") / (F.lit(percent / 100) * F.nullif("total", F.lit(0)))
    rows = rows.withColumn("seats", F.least(F.col("blocks") * times, F.floor(F.coalesce(fair, F.lit(0.0)) + 0.5)))
    while True:
        rows = materialize(rows)
        lack, n = rows.agg(F.max("mix") - F.sum("seats"), F.count(F.lit(1))).first()
        if not lack:
            return rows
        # A source's seats move with its part of those that still can move: so many quotients are enough, or the loop goes on.
        can = F.col("seats") < F.col("blocks") * times if lack > 0 else F.col("seats") > 0
        moving = rows.filter(can).agg(F.sum("target")).first()[0] or 1.0
        many = F.ceil(F.col("target") / moving * (abs(lack) + n)) + 1
        many = F.least(many, F.col("blocks") * times - F.col("seats") if lack > 0 else F.col("seats"))
        k = F.explode(F.sequence(F.lit(1).cast("long"), many)).alias("k")
        quotients = rows.filter(can).select("source", "rank", "target", "seats", k)
        seat = F.col("seats") + F.col("k") if lack > 0 else F.col("seats") - F.col("k") + 1
        quotient = F.col("target") / (2 * seat - 1)
        order = -quotient if lack > 0 else quotient
        quotients = _ordered(quotients.select("source", order.alias("order"), F.col("rank") if lack > 0 else -F.col("rank"), "k").toDF("source", "order", "rank", "k"), "order", "rank", "k")
        moved = quotients.filter(F.col("place") < abs(lack)).groupBy("source").agg(F.count(F.lit(1)).alias("moved"))
        sign = 1 if lack > 0 else -1
        rows = rows.join(moved, "source", "left").withColumn("seats", F.col("seats") + sign * F.coalesce("moved", F.lit(0))).drop("moved")


def _seeded(seed: int, *what: Column | str) -> Column:
    """A number below 16^15 made from the seed and what; nulls are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *what).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, times: int = TIMES, block: int = BLOCK, shards: int = SHARDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (doc_id, size, source_size, target, taken), one row per input row, and the mix itself,
    pieces (doc_id, shard, block, from_word, n_words): a row for each time that a block's part of a document is taken.

    Null and empty texts, and texts of white space, have no words and are never taken; null is
    a source of its own, the last. Rows alike in id and text stand side by side in their
    source's line, each with words of its own. Long texts are many pieces. An empty table, or
    one without words, gives empty pieces. Other columns of docs are not looked at. ValueError for a percent beyond ``times`` hundred.
    """
    if not 0 <= percent <= 100 * times:
        raise ValueError(f"no word is taken more than {times} times, so the mix is at most {100 * times} percent")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))  # null after all others
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("source"), size.alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"))
    rows = materialize(rows.withColumn("turn", _seeded(seed, F.lit("document"), F.col("doc_id").cast("string"))))
    facts = seats(targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, percent, times), block, percent, times)

    runs = ranks.sorted_runs(rows, "source", "turn", "doc_id", "crc")
    line = ranks.parts(runs, "source", "size").join(facts.select("source", "target"), "source")
    line = ranks.placed(runs, line, "source", "size").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size", F.col("before_size").alias("lo"), F.col("all_size").alias("source_size"), "target"
    )
    line = materialize(line)
    discard(rows, runs)

    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"lo div {block}"), F.expr(f"(lo + size - 1) div {block}")))
    pieces = line.select("*", F.explode_outer(blocks).alias("block"))
    low, high = F.greatest(F.col("lo"), F.col("block") * block), F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.withColumns({"from_word": low - F.col("lo"), "n_words": high - low})
    begun = pieces.filter(F.col("block") * block >= F.col("lo")).select("source", "block")  # each block once, where it begins
    drawn = ranks.sorted_runs(begun.withColumn("turn", _seeded(seed, F.lit("block"), "source", F.col("block").cast("string"))), "source", "turn", "block")
    quota = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.when(j == shards, F.col("seats")).otherwise(F.least("seats", F.floor(F.col("seats") * j / shards + 0.5))))
    owned = ranks.parts(drawn, "source").join(facts.select("source", "seats", "blocks", quota.alias("quota")), "source")
    drawn_ = ranks.placed(drawn, owned, "source")
    # A block's seats are place, place + blocks, ...; a seat's shard is the first whose quota, and those before, reach it.
    turns = F.filter(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda t: F.col("place") + t * F.col("blocks")), lambda s: s < F.col("seats"))
    in_shards = F.transform(turns, lambda s: F.size(F.filter("quota", lambda q: q <= s)))
    drawn_ = materialize(drawn_.select("source", "block", in_shards.alias("shards")))
    discard(drawn)

    taken = pieces.join(drawn_.withColumnRenamed("block", "b").withColumnRenamed("source", "s"), (F.col("source") == F.col("s")) & (F.col("block") == F.col("b")), "left")
    times_taken = F.coalesce(F.size("shards"), F.lit(0))
    documents = taken.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.coalesce(F.sum(F.col("n_words") * times_taken), F.lit(0)).alias("taken")
    )
    return documents.drop("row"), taken.select("doc_id", F.explode("shards").alias("shard"), "block", "from_word", "n_words")


def query(spark, sf_dir):
    documents, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS size,
        ('0x' || md5('7:document:' || doc_id::VARCHAR)[1:15])::BIGINT AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[rank % 3 + 1] AS weight, (sum(source_size) OVER ())::BIGINT AS total FROM s),
c AS (SELECT a.source, sum(least(200 * b.source_size * a.weight, 200 * a.source_size * b.weight)) <= 150 * any_value(a.total) * any_value(a.weight) AS capped
      FROM w a, w b GROUP BY a.source),
f AS (SELECT 150 * any_value(total) - coalesce(sum(200 * source_size) FILTER (WHERE capped), 0) AS rest, sum(weight) FILTER (WHERE NOT capped) AS weights FROM w JOIN c USING (source)),
t AS (SELECT source, source_size, rank, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / (100 * weights)::DOUBLE END AS target,
        (source_size + 63) // 64 AS blocks, (150 * total + 3200) // 6400 AS mix FROM w JOIN c USING (source), f),
q AS (SELECT source, mix, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank) AS place FROM (SELECT *, unnest(range(1, 2 * blocks + 1)) AS k FROM t)),
seats AS (SELECT source, count(*) FILTER (WHERE place <= mix) AS seats FROM q GROUP BY source),
line AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM d),
pieces AS (SELECT *, unnest(range(lo // 64, (lo + size - 1) // 64 + 1)) AS block FROM line WHERE size > 0),
b AS (SELECT source, block, row_number() OVER (PARTITION BY source ORDER BY ('0x' || md5('7:block:' || source || ':' || block)[1:15])::BIGINT, block) - 1 AS place
      FROM (SELECT DISTINCT source, block FROM pieces)),
times AS (SELECT b.source, block, (place < coalesce(seats, 0))::INT + (place + blocks < coalesce(seats, 0))::INT AS times FROM b JOIN t USING (source) LEFT JOIN seats USING (source)),
taken AS (SELECT doc_id, sum((least(lo + size, 64 * (block + 1)) - greatest(lo, 64 * block)) * times)::BIGINT AS taken FROM pieces JOIN times USING (source, block) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM d JOIN t USING (source) LEFT JOIN taken USING (doc_id)
"""
