"""A Merkle manifest of a dataset: a digest of each row, a tree of digests for each language, and one over these trees' roots.

The nodes are stored as Parquet, a partition for each level, in runs: a row holds up to RUN
neighbouring nodes of a tree. Leaves are sorted over partitions and numbered; from there each
level reads the one before it from its files and writes its own. Two nodes that make a third
always lie in one run, so no rows are moved; only where a run has come down to one node are
these gathered to runs again. Proofs are taken from the same store, from the top down: a run's
levels are merged by its place in the tree, with the proofs of the run's own top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm import ranks
from postlens.llm.scratch import discard, materialize, shared_folder

STEPS = 8  # levels of a run
RUN = 1 << STEPS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def leaf(*fields: Column | str) -> Column:
    """The digest of a row: of each field its UTF-8 bytes' count, a colon and the field, or a hyphen if it is null."""
    parts = []
    for f in fields:
        text = (F.col(f) if isinstance(f, str) else f).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(*parts)


class Tree:
    """Trees over leaves, with their nodes in a store. leaves: tree (not null), place (from 0), node, n (leaves of the tree), item (what comes back with a leaf).

    ``store`` has level, tree, run, n (nodes of the tree at this level), nodes and, at level 0,
    items. ``tops``: tree, node and depth, the level of the last node left.
    """

    def __init__(self, leaves: DataFrame):
        self.spark, self.path = leaves.sparkSession, shared_folder(leaves.sparkSession)
        self._write(self._gathered(leaves), 0)
        most = self._level(0).agg(F.max("n")).first()[0] or 1
        self.levels = (most - 1).bit_length() + 1
        pairs = "transform(sequence(0, (size(nodes) - 1) div 2), i -> sha2(cast(concat(nodes[2 * i], coalesce(get(nodes, 2 * i + 1), '')) as binary), 256))"
        for level in range(1, self.levels):
            nodes = self._level(level - 1).filter("n > 1").select("tree", "run", F.expr("(n + 1) div 2").alias("n"), F.expr(pairs).alias("nodes"))
            if level % STEPS == 0:  # runs are down to a node each
                nodes = self._gathered(nodes.select("tree", F.col("run").alias("place"), F.col("nodes")[0].alias("node"), "n"))
            self._write(nodes, level)
        self.tops = self.store().filter("n = 1").select("tree", F.col("nodes")[0].alias("node"), F.col("level").alias("depth"))

    def _gathered(self, nodes: DataFrame) -> DataFrame:
        one = F.struct(*[c for c in ("place", "node", "item") if c in nodes.columns])
        runs = nodes.groupBy("tree", F.expr(f"place div {RUN}").alias("run"), "n").agg(F.sort_array(F.collect_list(one)).alias("s"))  # RUN nodes at most
        items = [F.transform("s", lambda x: x["item"]).alias("items")] if "item" in nodes.columns else []
        return runs.select("tree", "run", "n", F.transform("s", lambda x: x["node"]).alias("nodes"), *items)

    def _write(self, nodes: DataFrame, level: int) -> None:
        nodes.write.parquet(f"{self.path}/level={level}")
        if not level:
            self.schema = nodes.withColumn("level", F.lit(0)).schema

    def _level(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={level}")

    def store(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def proofs(self, above: DataFrame) -> DataFrame:
        """tree, place, node, item and, for each leaf, path: its siblings (left, right; empty if there is none) from the leaf up; then what above says of the tree.

        above: tree, depth, and other columns, one row for each tree.
        """
        facts = [c for c in above.columns if c not in ("tree", "depth")]
        known = None  # of the runs' own tops, one tier up: tree, place, up, depth, facts
        for base in range((self.levels - 1) // STEPS * STEPS, -1, -STEPS):
            tier = self.store().filter((F.col("level") >= base) & (F.col("level") < base + STEPS))
            one = F.struct("level", "nodes")
            runs = tier.groupBy("tree", "run").agg(F.sort_array(F.collect_list(one)).alias("s"), *([F.first("items", ignorenulls=True).alias("items")] if base == 0 else []))  # STEPS rows
            runs = runs.select("tree", "run", F.transform("s", lambda x: x["nodes"]).alias("levels"), *(["items"] if base == 0 else []))
            # Trees that end in this tier begin here; the others come from the tier above.
            begun = above.filter((F.col("depth") >= base) & (F.col("depth") < base + STEPS)).select(
                "tree", F.lit(0).cast("long").alias("run"), F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("up"), "depth", *facts
            )
            if known is not None:
                begun = begun.unionByName(known.select("tree", F.col("place").alias("run"), F.col("path").alias("up"), "depth", *facts))
            runs = runs.join(begun, ["tree", "run"])
            sibling = "get(levels[l], shiftright(p, l) ^ 1)"
            side = lambda parity: f"if(shiftright(p, l) % 2 = {parity}, coalesce({sibling}, ''), '')"
            path = f"concat(transform(sequence(0, least({STEPS}, depth - {base}) - 1, 1), l -> named_struct('left', {side(1)}, 'right', {side(0)})), up)"
            path = f"if(depth = {base}, up, {path})"
            item = ", 'item', items[p]" if base == 0 else ""
            made = F.explode(F.expr(f"transform(sequence(0, size(levels[0]) - 1), p -> named_struct('p', p, 'node', levels[0][p]{item}, 'path', {path}))"))
            rows = runs.select("tree", "run", "depth", *facts, made.alias("x"))
            columns = ["tree", (F.col("run") * RUN + F.col("x.p")).alias("place"), F.col("x.node").alias("node"), F.col("x.path").alias("path"), "depth", *facts]
            known = rows.select(*columns, *([F.col("x.item").alias("item")] if base == 0 else []))
            if base:
                known = materialize(known)  # RUN times fewer rows than the tier below
        return known


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, x: digest(x["left"], node, x["right"]))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep's columns, leaf, subroot, root, path (siblings from the leaf to the root).

    Rows of one tree_col are a tree, in the order of id and leaf (null first); null is a tree of
    its own, before the others. Repeated rows are leaves of their own, side by side; rows of one
    id stand in the order of their digests. Nulls differ from empty texts in a leaf. Long texts
    are hashed whole in the pass that reads them. An empty table gives no rows and has no root.
    Columns that aren't named may have any name.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    keep = keep or {}
    rows = docs.select(named(tree_col).alias("tree"), F.col(id_col).alias("doc_id"), leaf(*fields).alias("node"), F.struct(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in keep.items()]).alias("item"))
    rows = materialize(rows)
    runs = ranks.sorted_runs(rows, "tree", "doc_id", "node")
    leaves = ranks.placed(runs, ranks.parts(runs, "tree"), "tree").select("tree", "place", "node", F.col("_n").alias("n"), "item")
    trees = Tree(leaves)
    discard(rows, runs)
    tops = materialize(trees.tops)
    order = ranks.sorted_runs(tops.select(F.lit("").alias("all"), F.col("tree").alias("name"), "node", "depth"), "all", "name")
    order = ranks.placed(order, ranks.parts(order, "all"), "all").select(
        F.col("all").alias("tree"), "place", "node", F.col("_n").alias("n"), F.struct("name", "depth").alias("item")
    )
    forest = Tree(order)
    roots = forest.proofs(forest.tops.select("tree", "depth", F.col("node").alias("root")))
    roots = materialize(roots.select(F.col("item.name").alias("tree"), F.col("item.depth").alias("depth"), F.col("node").alias("subroot"), "root", F.col("path").alias("last")))
    out = trees.proofs(roots)
    return out.select("item.doc_id", *[F.col(f"item.{k}").alias(k) for k in keep], F.col("node").alias("leaf"), "subroot", "root", F.concat("path", "last").alias("path"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    claimed = F.when(tampered, leaf(*changed))
    out = manifest(docs, keep={"claimed": claimed})
    out = out.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("path")))
    siblings = F.flatten(F.transform("path", lambda x: F.array(x["left"], x["right"])))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS tree, n_chars, coalesce(strlen(source)::VARCHAR || ':' || source, '-') AS s,
    coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS l, coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS t,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') AS i FROM documents),
e AS (SELECT *, coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS c,
        coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') AS c1 FROM d),
leaves AS (SELECT doc_id, tree, sha256(i || s || l || c || t) AS leaf, sha256(i || s || l || c1 || t) AS other,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place FROM e),
up AS (
  SELECT tree, 0 AS lv, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY tree
  UNION ALL
  SELECT tree, lv + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM up WHERE len(nodes) > 1),
subroots AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM up WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS lv, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT lv + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM top WHERE len(nodes) > 1),
steps AS (
  SELECT doc_id, 0 AS part, lv, (place >> lv) % 2 AS odd, coalesce(nodes[xor(place >> lv, 1) + 1], '') AS sibling
  FROM leaves JOIN up USING (tree) WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, 1, lv, (s.place >> lv) % 2, coalesce(nodes[xor(s.place >> lv, 1) + 1], '')
  FROM leaves JOIN subroots s USING (tree), top WHERE len(nodes) > 1),
paths AS (SELECT doc_id, list((CASE WHEN odd = 1 THEN '<' ELSE '>' END) || sibling ORDER BY part, lv) AS path FROM steps GROUP BY doc_id),
bytes AS (SELECT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT) AS digits FROM leaves),
bits AS (SELECT doc_id, list_prepend(4294967295::BIGINT, flatten(list_transform(digits, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM bytes),
crc AS (SELECT doc_id, xor(4294967295, list_reduce(steps, lambda a, x:
    CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc FROM bits),
done AS (SELECT l.doc_id, l.leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, coalesce(path, []::VARCHAR[]) AS path,
    CASE WHEN crc % 7 = 0 THEN other ELSE leaf END AS claimed
  FROM leaves l JOIN subroots USING (tree) JOIN crc USING (doc_id) LEFT JOIN paths USING (doc_id)),
folds AS (SELECT *, list_reduce(list_prepend(claimed, path), lambda a, s: CASE WHEN s[1] = '<' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root
  FROM done)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folds
"""
