"""Chat formatting from reply trees.

Self-joins by doubling find each message's root, depth and score in as many rounds as the
depth has bits; the best branches of each tree are formatted, one conversation each.
Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.llm.scratch import materialize

#: A turn is OPEN role ] text CLOSE; "<", "[" and "]" occur in no escaped role or text.
OPEN, MIDDLE, CLOSE = "<s>[", "]", "</s>"
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))


def escape(x: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, x)


def unescape(x: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), x)


def chain(rows: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """Conversations that are lists, as reply trees: each row answers the one before it."""
    w = Window.partitionBy(tree).orderBy(F.col(turn).asc_nulls_first(), role, text)
    node = F.row_number().over(w).cast("long")
    return rows.select(
        F.col(tree).alias("tree_id"), node.alias("node_id"), F.col(role).alias("role"), F.col(text).alias("text")
    ).select(
        "tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree_id, branch, depth, node_id for every message on the best ``branches`` paths of each tree.

    A path's score is the sum of its messages' scores (null: 0); ties go to the longer path,
    then to the smaller leaf. A message whose parent isn't there is a root; messages on a
    cycle have no root and are left out. (tree_id, node_id) is a key.
    """
    small = nodes.select("tree_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    leaves = small.alias("a").join(
        small.alias("b"),
        F.col("a.tree_id").eqNullSafe(F.col("b.tree_id")) & (F.col("a.node_id") == F.col("b.parent_id")),
        "left_anti",
    )
    columns = ["tree_id", "node_id", "up", "score", "depth"]
    start = small.select("tree_id", "node_id", F.col("parent_id").alias("up"), "score", F.lit(1).cast("long").alias("depth"))
    rooted, active = start.filter("up is null"), start.filter("up is not null")
    levels, left = [], -1
    # Only messages that have not met their root yet take part in the next round.
    while (now := active.count()) and now != left:
        left = now
        levels.append(active)
        a, b = active.alias("a"), rooted.unionByName(active).alias("b")
        joined = a.join(b, F.col("a.tree_id").eqNullSafe(F.col("b.tree_id")) & (F.col("a.up") == F.col("b.node_id")), "left")
        after = materialize(
            joined.select(
                "a.tree_id", "a.node_id", F.col("b.up").alias("up"),
                (F.col("a.score") + F.coalesce("b.score", F.lit(0.0))).alias("score"),
                (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"),
            )
        )
        rooted, active = rooted.unionByName(after.filter("up is null").select(columns)), after.filter("up is not null")
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), F.desc("depth"), "node_id")
    ends = rooted.alias("r").join(
        leaves.alias("l"),
        F.col("r.tree_id").eqNullSafe(F.col("l.tree_id")) & (F.col("r.node_id") == F.col("l.node_id")),
        "left_semi",
    )
    ends = ends.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches)
    on = ends.select("tree_id", "branch", "node_id")
    for level in reversed(levels):
        s, up = on.alias("s"), level.alias("u")
        more = s.join(up, F.col("s.tree_id").eqNullSafe(F.col("u.tree_id")) & (F.col("s.node_id") == F.col("u.node_id")))
        on = on.unionAll(more.select("s.tree_id", "s.branch", F.col("u.up").alias("node_id")))
        on = materialize(on)
    s, r = on.alias("s"), rooted.alias("r")
    both = s.join(r, F.col("s.tree_id").eqNullSafe(F.col("r.tree_id")) & (F.col("s.node_id") == F.col("r.node_id")))
    return both.select("s.tree_id", "s.branch", "r.depth", "s.node_id")


def format_chats(nodes: DataFrame, branches: int = 1, learn_from: str = "assistant") -> DataFrame:
    """tree_id, branch, formatted, loss_spans (array of start, length in code points of formatted).

    nodes: tree_id, node_id, parent_id, role, text, score. Null roles and texts are empty.
    loss_spans cover the escaped texts of the role ``learn_from``, in order. A null tree_id
    is a tree like any other; messages alike in tree and node are put one after another; an
    empty table gives no rows; other columns, whatever their names, are not looked at. One
    conversation becomes one string, so one task holds its texts, however long.
    """
    on, n = paths(nodes, branches).alias("p"), nodes.alias("n")
    turns = on.join(n, F.col("p.tree_id").eqNullSafe(F.col("n.tree_id")) & (F.col("p.node_id") == F.col("n.node_id")))
    turns = turns.select(
        "p.tree_id", "p.branch", "p.depth",
        (F.coalesce("n.role", F.lit("")) == learn_from).alias("learn"),
        escape(F.coalesce("n.role", F.lit(""))).alias("role"), escape(F.coalesce("n.text", F.lit(""))).alias("text"),
    )
    head = F.char_length("role") + len(OPEN) + len(MIDDLE)
    turns = turns.select(
        "tree_id", "branch", "depth", "learn", head.alias("head"), F.char_length("text").alias("length"),
        F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE)).alias("turn"),
    )
    before = Window.partitionBy("tree_id", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + F.col("head")
    turns = turns.withColumn("start", start.cast("int"))
    out = turns.groupBy("tree_id", "branch").agg(
        F.sort_array(F.collect_list(F.struct("depth", "turn", "learn", "start", "length"))).alias("t")
    )
    return out.select(
        "tree_id", "branch",
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """tree_id, branch, turns (array of role, text), loss_text, from formatted and loss_spans alone."""
    parts = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    pattern = r"(?s)^<s>\[([^\]]*)\](.*)$"
    return formatted.select(
        "tree_id", "branch", "formatted",
        F.transform(parts, lambda x: F.struct(
            unescape(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(F.regexp_extract(x, pattern, 2)).alias("text")
        )).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(
            F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "").alias("loss_text"),
    )


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(
        spark.range(2, numPartitions=1).select(
            F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
            F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
            F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"),
        )
    )
    nodes = materialize(chain(rows, "conv_id", "turn", "role", "text"))
    out = read_back(format_chats(nodes))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + 9 + length(regexp_replace(role || text, '[^~<\\[\\]]', '', 'g')) AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
