"""Removal of repeated text by sorted suffixes, and passages of words that occur elsewhere.

A text is a sequence of units: bytes, or words. A unit is repeated if a string of
``length`` units that covers it starts at two places or more. Sorting the suffixes at every
unit of a corpus is out of reach, so suffixes are sorted at anchors only, and what is known
of an anchor settles the places before it:

1. The anchor of a place is the place of the smallest hash among the next ``window`` places.
   It depends on the ``length`` units from the place on alone, so equal strings have equal
   anchors, and the ``shared`` units after the anchor are part of both.
2. Anchors whose shared units occur once are dropped by a count. Anchors with equal
   surroundings settle each other; one of them stands for all of them.
3. What is left, anchors with equal shared units but different surroundings, is sorted
   group by group: multikey quicksort on words down to SHALLOW bytes, then a blind trie
   for each set of suffixes that still agree. Each interval of the sorted suffixes with a
   common prefix is then matched with the common lengths to the left of the anchor: a
   place is repeated if what both sides share adds up to ``length``.

A group of more than MOST surroundings is dealt out first. Two places that match share l units
to the left and r to the right of their anchors, and l + r is known; so they share one of a
few pairs of shorter strings, and a group for each of these pairs of strings is sorted alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import jaccard
from postlens.llm.scratch import discard, materialize, small_batches

SLICE = 1 << 19
SHALLOW = 16
#: Groups of more surroundings are dealt out by steps of the first, then of the second share of what is not shared.
MOST, STEPS = 20_000, (0.2, 0.04)
BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Rule:
    """length, window, gram: in units; width: bytes of a unit as it is compared (1: bytes, 8: hashes of words)."""

    length: int
    window: int
    gram: int
    width: int

    @property
    def shared(self) -> int:
        return self.length - self.window + 1

    def units(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint8) if self.width == 1 else jaccard.long_words(data)

    def raw(self, units: np.ndarray) -> bytes:
        return units.tobytes() if self.width == 1 else units.astype(">u8").tobytes()


BYTES, WORDS = Rule(400, 200, 16, 1), Rule(50, 25, 2, 8)
LENGTH = BYTES.length


def u64(x: int) -> np.uint64:
    return np.uint64(x % (1 << 64))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, u64(b), np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> u64(31))) * u64(0xBF58476D1CE4E5B9)
    return h ^ (h >> u64(29))


def anchors(rule: Rule, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts that lie one after another in data (at most 2^24 units): runs of places with one anchor.

    Returns first place, last place, anchor, hash of the shared units, hash of the surroundings.
    """
    none, length, window, gram = np.zeros(0, np.int64), rule.length, rule.window, rule.gram
    up, down = powers(SLICE * 2)
    valid = np.zeros(len(data) + 1, bool)
    for s, e in zip(starts, ends, strict=True):
        if e - s >= length:
            valid[s : e - length + 1] = True
    if not valid.any():
        return none, none, none, none, none
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + u64(1)) * up[: len(data)], out=sums[1:])

    def hashed(at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (sums[at + size] - sums[at]) * down[at]

    key = mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
    key = (key >> u64(24) << u64(24)) | np.arange(len(key), dtype=np.uint64)
    blocks = np.full(-(-len(key) // window) * window, u64(-1), np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, window)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: len(key) - window + 1], left[window - 1 : len(key)])
    places = np.flatnonzero(valid[: len(least)])
    anchor = (least[places] & u64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(places), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (places[1:] != places[:-1] + 1)
    at = np.flatnonzero(new)
    first, last, anchor = places[at], places[np.append(at[1:], len(places)) - 1], anchor[at]
    size = last - first + length
    around = hashed(first, size) + (anchor - first).astype(np.uint64) * u64(0xD6E8FEB86659FD93)
    around = mix(around + size.astype(np.uint64) * u64(0xA0761D6478BD642F))
    return first, last, anchor, mix(hashed(anchor, rule.shared)).view(np.int64), around.view(np.int64)


def _anchor_rows(rule: Rule):
    def rows(parts: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
        ends = np.cumsum([len(x) for _, _, x in parts])
        starts = np.concatenate([[0], ends[:-1]])
        first, last, anchor, shared, around = anchors(rule, np.concatenate([x for *_, x in parts]), starts, ends)
        of = np.searchsorted(starts, first, "right") - 1 if len(first) else first
        uid, base = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
        return pd.DataFrame({
            "shared": shared, "around": around, "uid": uid[of], "first": first - starts[of] + base[of],
            "left": (anchor - first).astype(np.int32), "places": (last - first + 1).astype(np.int32),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, size = [], 0
            for uid, text in zip(batch["uid"], batch["text"], strict=True):
                data = rule.units(text.encode("utf-8", "surrogatepass"))
                for base in range(0, max(1, len(data) - rule.length + 1), SLICE):
                    piece = data[base : base + SLICE + rule.length - 1]
                    if size + len(piece) > SLICE * 3 // 2 and parts:
                        yield rows(parts)
                        parts, size = [], 0
                    parts.append((uid, base, piece))
                    size += len(piece)
            if parts:
                yield rows(parts)

    return run


def lcp(a: int, b: int, bytes_: int) -> int:
    """Common first bytes of two strings of bytes_ bytes, given as numbers."""
    return bytes_ - ((a ^ b).bit_length() + 7) // 8


class Node:
    """A branch of a blind trie: the length that all below share, any one below, and branches by the next byte."""

    __slots__ = ("depth", "one", "to")

    def __init__(self, depth: int, one: int):
        self.depth, self.one, self.to = depth, one, {}


def blind_trie(members: list[int], texts: list[bytes], common) -> list[int]:
    """The members in the order of their texts. common(i, j): the length that two texts share.

    A text first goes down by the bytes at the branches alone; one comparison with the
    member met there tells where it really leaves the path.
    """
    byte = lambda i, d: texts[i][d] if d < len(texts[i]) else -1  # noqa: E731  a text that ends comes first
    root: Node | list[int] = [members[0]]
    for i in members[1:]:
        node = root
        while isinstance(node, Node):
            node = node.to.get(byte(i, node.depth)) or node.one
            if isinstance(node, int):
                break
        met = node if isinstance(node, int) else node[0]
        depth, parent, node = common(i, met), None, root
        while isinstance(node, Node) and node.depth < depth:
            parent, node = node, node.to.get(byte(i, node.depth))
        if node is None:
            parent.to[byte(i, parent.depth)] = [i]
        elif isinstance(node, Node) and node.depth == depth:
            k = byte(i, depth)
            if k in node.to:  # equal texts that end here
                node.to[k].append(i)
            else:
                node.to[k] = [i]
        elif isinstance(node, list) and len(texts[i]) == len(texts[met]) == depth:
            node.append(i)
        else:
            branch = Node(depth, met)
            branch.to = {byte(met, depth): node, byte(i, depth): [i]}
            if parent is None:
                root = branch
            else:
                parent.to[byte(i, parent.depth)] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, Node):
            stack += [node.to[k] for k in sorted(node.to, reverse=True)]
        else:
            out += node
    return out


def sort_suffixes(texts: list[bytes], common) -> list[int]:
    """Indices in the order of texts: multikey quicksort on words to SHALLOW bytes, then blind tries."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(texts))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2:
            out += members
        elif depth >= SHALLOW:
            out += blind_trie(members, texts, common)
        else:
            words = [texts[i][depth : depth + 8] for i in members]
            pivot = words[len(words) // 2]
            pairs = list(zip(words, members, strict=True))
            same = [i for w, i in pairs if w == pivot]
            stack.append(([i for w, i in pairs if w > pivot], depth))
            stack.append((same, depth + 8) if len(pivot) == 8 else (same, SHALLOW))
            stack.append(([i for w, i in pairs if w < pivot], depth))
    return out


def settle(rule: Rule, lefts: list[bytes], rights: list[bytes], places: list[int], known: list[bool]) -> list[list[tuple[int, int]]]:
    """For each anchor of a group, the intervals of distances (from the anchor back to a place) that are repeated.

    lefts: the units from the first place to the anchor; rights: the units after the shared
    ones to ``length`` units after the last place. known anchors need no answer.
    """
    n, unit = len(lefts), rule.width
    width = (rule.window - 1) * unit
    back = [x[::-1] for x in lefts]
    left_no = [int.from_bytes(x.ljust(width, b"\0"), "big") for x in back]
    right_no = [int.from_bytes(x.ljust(width, b"\0"), "big") for x in rights]
    common_right = lambda i, j: min(lcp(right_no[i], right_no[j], width), len(rights[i]), len(rights[j]))
    order = sort_suffixes(rights, common_right)
    height = [common_right(i, j) // unit for i, j in zip(order, order[1:], strict=False)]
    rank = {i: k for k, i in enumerate(sorted(range(n), key=back.__getitem__))}
    farthest = [len(x) // unit for x in lefts]
    nearest = [far - p + 1 for far, p in zip(farthest, places, strict=True)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def visit(a: int, b: int, depth: int) -> None:
        need = rule.window - 1 - depth
        if not any(not known[i] and farthest[i] >= need for i in order[a:b]):
            return
        members = sorted(order[a:b], key=rank.__getitem__)
        side = [min(lcp(left_no[i], left_no[j], width) // unit, farthest[i], farthest[j]) for i, j in zip(members, members[1:], strict=False)]
        for k, i in enumerate(members):
            if not known[i]:
                best = max(side[k - 1] if k else -1, side[k] if k < len(side) else -1)
                lo, hi = max(nearest[i], need), min(farthest[i], best)
                if lo <= hi:
                    out[i].append((lo, hi))

    # The intervals of the sorted suffixes with a common prefix, the longest prefix first.
    stack: list[tuple[int, int]] = []  # start, depth
    for k in range(1, n + 1):
        h, start = height[k - 1] if k < n else -1, k - 1
        while stack and stack[-1][1] > h:
            start, depth = stack.pop()
            visit(start, k, depth)
        if k < n and (not stack or stack[-1][1] < h):
            stack.append((start, h))
    return out


def _settle_groups(rule: Rule):
    """Rows come sorted by key; a group may go over several batches."""

    def group(g: pd.DataFrame) -> list[tuple[int, int, int]]:
        found = settle(rule, list(g["before"]), list(g["after"]), list(g["places"]), list(g["known"]))
        # All places of an anchor lie within a window, so their strings overlap: one span holds them.
        return [
            (uid, first + left - max(hi for _, hi in spans), first + left - min(lo for lo, _ in spans) + rule.length)
            for uid, first, left, spans in zip(g["uid"], g["first"], g["left"], found, strict=True)
            if spans
        ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            at = np.flatnonzero(np.diff(batch["key"].to_numpy())) + 1
            cuts = [0, *at.tolist()]
            rows = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in group(batch.iloc[a:b])]
            rest = batch.iloc[cuts[-1] :]
            yield pd.DataFrame(rows, columns=["uid", "start", "end"])
        if rest is not None and len(rest):
            yield pd.DataFrame(group(rest), columns=["uid", "start", "end"])

    return run


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts in compressed form, as they are shuffled twice."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield batch.assign(packed=[squeeze(x.encode("utf-8", "surrogatepass")) for x in batch["text"]]).drop(columns="text")


def _cut(rule: Rule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The units around each anchor, without those that its group shares."""
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for packed, wanted in zip(batch["packed"], batch["wanted"], strict=True):
                data = rule.units(expand(packed))
                for w in wanted:
                    a = w["first"] + w["left"]
                    after = data[a + rule.shared : w["first"] + w["places"] - 1 + rule.length]
                    rows.append((w["shared"], w["uid"], w["first"], w["left"], w["places"], w["known"], rule.raw(data[w["first"] : a]), rule.raw(after)))
            yield pd.DataFrame(rows, columns=["shared", "uid", "first", "left", "places", "known", "before", "after"])

    return run


def _runs(found, rule: str) -> list[list[int]]:
    """The union of the spans of a rule, as sorted disjoint spans."""
    runs: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in found if x["rule"] == rule) if found is not None else ():
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        kept, spans, passages = [], [], []
        for packed, found in zip(batch["packed"], batch["found"], strict=True):
            data, runs = expand(packed), _runs(found, "bytes")
            at = [0, *[x for r in runs for x in r], len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
            spans.append([x for r in runs for x in r])
            passages.append([x for r in _runs(found, "words") for x in r])
        yield pd.DataFrame({"doc_id": batch["doc_id"], "kept": kept, "spans": spans, "passages": passages})


PLACE = "shared long, around long, uid long, first long, left int, places int"


def _dealt(groups: DataFrame, rule: Rule, most: int) -> tuple[DataFrame, DataFrame]:
    """Contexts with a key by which they are sorted, in groups of at most ``most``, and those of groups that stay larger.

    Places match if l + r is at least window - 1. For a step k some multiple i k of it is at
    most l and above l - k, so both share i k units to the left and window - k - i k to the
    right: a group for each i, of contexts that share these.
    """
    out, large = [], groups.withColumn("key", F.col("shared"))
    for share in (0.0, *STEPS):
        if share:
            step = max(1, round(rule.window * share))
            far, near = F.expr(f"i * {step * rule.width}"), F.expr(f"{(rule.window - step) * rule.width} - i * {step * rule.width}")
            each = large.drop("key", "kinds").dropDuplicates(["shared", "uid", "first"])  # it may be in several groups
            each = each.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit((rule.window - 1) // step))))
            each = each.withColumn("near", F.greatest(near, F.lit(0))).filter((F.octet_length("before") >= far) & (F.octet_length("after") >= F.col("near")))
            last, next_ = F.substring("before", F.octet_length("before") - far + 1, far), F.substring("after", F.lit(1), F.col("near"))
            large = each.withColumn("key", F.xxhash64("shared", "i", last, next_)).drop("i", "near")
            large = materialize(large)
        kinds = materialize(large.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
        out.append(large.join(kinds.filter(F.col("kinds") <= most).select("key"), "key"))
        large = large.join(kinds.filter(F.col("kinds") > most), "key")
        if kinds.filter(F.col("kinds") > most).isEmpty():
            break
    small = out[0].drop("kinds")
    for x in out[1:]:
        small = small.unionByName(x.drop("kinds"))
    return small, large.drop("key", "kinds").dropDuplicates(["shared", "uid", "first"])


def _whole(contexts: DataFrame, rule: Rule) -> DataFrame:
    """Spans of contexts whose strings are compared whole, a row for each, by two hashes: nothing is left to sort."""
    each = F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("k")
    rows = contexts.select("uid", "first", "known", "left", "shared", "before", "after", each)
    rows = rows.select(
        "uid", "first", "known", "k", (F.col("left") - F.col("k")).alias("back"), "shared",
        F.expr(f"substring(before, k * {rule.width} + 1)").alias("b"), F.expr(f"substring(after, 1, ({rule.window - 1} - (left - k)) * {rule.width})").alias("a"),
    )
    rows = rows.select(
        "uid", "first", "known", "k", F.xxhash64("shared", "back", "b", "a").alias("h"), F.xxhash64("a", "b", "back", "shared").alias("i")
    )
    often = materialize(rows.groupBy("h", "i").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return rows.filter("not known").join(often, ["h", "i"]).select(
        "uid", (F.col("first") + F.col("k")).alias("start"), (F.col("first") + F.col("k") + rule.length).alias("end")
    )


def repeated_spans(rows: DataFrame, rule: Rule) -> DataFrame:
    """uid, start, end (in units, overlapping) of strings of rule.length units that start at two places or more.

    rows: uid, text (not null). Tables that joins by a frequent key read are written first, so
    that Spark can split the key's rows.
    """
    long = rows.filter(F.octet_length("text") >= (rule.length if rule.width == 1 else 2 * rule.length - 1))
    every = materialize(long.select("uid", "text").mapInPandas(_anchor_rows(rule), PLACE))
    often = materialize(every.groupBy("shared").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    places = materialize(every.join(often, "shared"))
    discard(every, often)
    kinds = materialize(places.groupBy("shared", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "first", "left", "places")).alias("one")
    ))
    twice = materialize(kinds.filter("n > 1").select("shared", "around"))
    whole = places.join(twice, ["shared", "around"]).select(
        "uid", F.col("first").alias("start"), (F.col("first") + F.col("places") - 1 + rule.length).alias("end")
    )
    whole = materialize(whole)
    mixed = kinds.groupBy("shared").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    mixed = materialize(mixed.filter("kinds > 1 and least = 1").select("shared"))
    asked = materialize(kinds.join(mixed, "shared").select("shared", (F.col("n") > 1).alias("known"), "one.*"))
    discard(places, twice, mixed, kinds)
    wanted = asked.groupBy("uid").agg(
        F.collect_list(F.struct("shared", "uid", "first", "left", "places", "known")).alias("wanted")
    )  # a text's own anchors
    cut = rows.select("uid", "text").mapInPandas(_pack, "uid long, packed binary").join(wanted, "uid")
    contexts = cut.mapInPandas(
        _cut(rule), "shared long, uid long, first long, left int, places int, known boolean, before binary, after binary"
    )
    contexts = materialize(contexts.dropDuplicates(["shared", "uid", "first"]))
    discard(asked)
    small, large = _dealt(contexts, rule, MOST)
    sorted_ = small.repartition("key").sortWithinPartitions("key")
    part = sorted_.mapInPandas(_settle_groups(rule), "uid long, start long, end long")
    spans = materialize(whole.unionByName(part).unionByName(_whole(large, rule)))
    discard(contexts, whole)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: Rule | None = None) -> DataFrame:
    """One row per input row: doc_id, kept (binary), spans (removed bytes: start, end, start, end ...), passages.

    Strings are compared within and between rows and never cross rows; rows that repeat a
    text repeat its strings. Null texts are empty; texts under LENGTH bytes stay whole; long
    texts are taken whole, in slices; an empty table gives no rows; other columns of docs are
    not looked at. With a rule of words, such as WORDS, passages holds the words, in the same
    form, that lie in a passage of that many words which occurs at another place too, whatever
    its case and spacing; they are not removed for it.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Ids go through pandas as text, which keeps nulls and large numbers as they are.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text.alias("text"))
    # Rows alike in id and text share a uid, and so their spans.
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows, BYTES).withColumn("rule", F.lit("bytes"))
    if passages:
        spans = spans.unionByName(repeated_spans(rows, passages).withColumn("rule", F.lit("words")))
    kind = docs.schema[id_col].dataType.simpleString()
    packed = rows.mapInPandas(_pack, "doc_id string, uid long, packed binary")
    found = spans.groupBy("uid").agg(F.collect_set(F.struct("rule", "start", "end")).alias("found"))  # a text's own spans
    out = packed.join(found, "uid", "left").mapInPandas(_remove, "doc_id string, kept binary, spans array<long>, passages array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def covered(spans: str):
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def query(spark, sf_dir):
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passages=WORDS)
    return out.select(
        "doc_id", (F.octet_length("kept") + covered("spans")).cast("long").alias("n_bytes"), covered("spans").alias("n_removed"),
        F.expr("cast(size(spans) div 2 as long)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.expr("cast(size(passages) div 2 as long)").alias("n_passages"), covered("passages").alias("n_passage_words"),
    )
