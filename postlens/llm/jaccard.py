"""N-gram Jaccard join with set relations.

Sets of word shingles are put in one order, rare first, and two sets that reach the
threshold share a shingle among their first ones (the prefix). Postings of prefixes are
grouped by shingle, as index lists.

* Answers are derived from similar sets: of each list, the set that lies in the most lists
  is the pivot. Every set is compared with its best pivot once, and what links with one
  pivot is connected. Where two sets of one pivot still have to be compared, both are put as
  the pivot's shingles they lack and those they have besides, and compared by these
  differences alone.
* Lists are cut into blocks ordered by size and position of the shingle; a block is skipped
  if its sizes and positions rule out that a partner reaches the threshold. Sets that are
  already linked to each other, over others if need be, are not compared again: a list of
  one component goes as a whole, and the members of a list's largest component only meet
  those outside it.

Equal sets are one set throughout. No pairs within a group of copies are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.llm.scratch import discard, give_back, materialize, small_batches

MOST_SEEN = 200_000
SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15
SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
BLOCK = 64
MOST_BITS = 8_192
#: A list of more sets is processed by pairs of parts rather than whole.
PART = 2_000
#: The list of a shingle that more texts have is dealt out by set, in salted parts of about this many.
SALTED = 5_000
PACK = 1 << 31
RECENT = 8 << 20


def u64(x: int) -> np.uint64:
    return np.uint64(x % (1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> u64(33))) * u64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> u64(33))) * u64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> u64(33))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, u64(b), np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Place and 64-bit hash of each word, from sums of weighted bytes up to its ends."""
    text = np.frombuffer(b" " + data.lower() + b" ", np.uint8)
    up, down = powers(1 << (len(text) - 1).bit_length())
    space = SPACES[text]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + u64(1)) * up[: len(text)], out=sums[1:])
    return start - 1, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about SLICE bytes."""
    part, size = [], 0
    for x in texts:
        if part and size + len(x) > SLICE:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x) + 1
    if part:
        yield part


def long_words(data: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, taken in slices that end at a space."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        cut = re.compile(rb"[ \t-\r]").search(data, min(at + SLICE, len(data)))
        end = cut.start() if cut else len(data)
        out.append(word_hashes(data[at:end])[1])
        at = end + 1
    return np.concatenate(out)


def _shingled(h: np.ndarray, n: int) -> np.ndarray:
    out = np.full(max(0, len(h) - n + 1), u64(n), np.uint64)
    for k in range(n):
        out = out * u64(BASE) + h[k : len(h) - n + 1 + k]
    return mix(out)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted hashes; fewer words than size make one shingle."""
    out: list[np.ndarray] = []
    for part in pieces(texts):
        if len(part) == 1 and len(part[0]) > SLICE:
            words, bounds = long_words(part[0]), [0, None]
        else:
            at, words = word_hashes(b" ".join(part))
            bounds = np.searchsorted(at, np.cumsum([0] + [len(x) + 1 for x in part])).tolist()
        whole = _shingled(words, size)
        for a, b in zip(bounds, bounds[1:], strict=False):
            b = len(words) if b is None else b
            h = np.sort(whole[a : b - size + 1]) if b - a >= size else _shingled(words[a:b], b - a) if b > a else words[:0]
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h)
    return out


def need(n: int, percent: int) -> int:
    """The least intersection that a set of n shingles can have with a partner."""
    return (percent * n + 99) // 100


def set_id(s: np.ndarray) -> int:
    one = int(mix(s ^ u64(0xA0761D6478BD642F)).sum(dtype=np.uint64))
    two = int(mix(s).sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15
    return int(u64(one ^ two % (1 << 64)).view(np.int64))


def signature(s: np.ndarray) -> bytes:
    """Parity bits, as many as the set has shingles or up to twice as many, MOST_BITS at most: fewer bits differ than shingles."""
    bits = min(MOST_BITS, max(64, 1 << (len(s) - 1).bit_length())) if len(s) else 64
    return np.packbits(np.bincount((s & u64(bits - 1)).astype(np.int64), minlength=bits) % 2 == 1, bitorder="little").tobytes()


def differ(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the shingles in which two sets differ, from their signatures as words."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def may_link(n1: int, n2: int, differing: int, percent: int) -> bool:
    """n1 + n2 - 2 common is what differs, and 100 common >= percent (n1 + n2 - common)."""
    return (100 + percent) * (n1 + n2 - differing) >= 2 * percent * (n1 + n2)


def _data(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _profiles(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each text (its set), and one for each shingle that is frequent in the batch."""
        for batch in batches:
            sets = shingle_sets([_data(t) for t in batch["text"]], size)
            yield pd.DataFrame({
                "uid": batch["uid"], "doc_id": batch["doc_id"], "n": [len(s) for s in sets],
                "sid": pd.array([set_id(s) if len(s) else None for s in sets], "Int64"), "sig": [signature(s) for s in sets],
                "h": None, "c": None,
            })
            h, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = c >= max(4, len(sets) // 500)
            yield pd.DataFrame({"uid": None, "doc_id": None, "n": None, "sid": None, "sig": None, "h": h[often].view(np.int64), "c": c[often]})
        powers.cache_clear()
        give_back()

    return run


def ordered(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set rare first: shingles that are not among the frequent ones by hash, then those by frequency."""
    if not len(hot):
        return s
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    known = hot[at] == s
    late = s[known][np.argsort(rank[at[known]], kind="stable")]
    return np.concatenate([s[~known], late])


def _postings(shared, size: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, rank, salts = shared.value
        seen: set[int] = set()
        for batch in batches:
            hs, ids, ns, at = [], [], [], []
            for s in shingle_sets([_data(t) for t in batch["text"]], size):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(sid)
                first = ordered(s, hot, rank)[: len(s) - need(len(s), percent) + 1]
                hs.append(first)
                ids.append(sid)
                ns.append(len(s))
                at.append(len(first))
            if hs:
                pos = np.concatenate([np.arange(k) for k in at])
                h, sid = np.concatenate(hs), np.repeat(np.array(ids, np.int64), at)
                salt = np.zeros(len(h), np.int32)
                if len(hot):
                    where = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    salted = (hot[where] == h) & (salts[where] > 0)
                    salt[salted] = 1 + sid[salted].view(np.uint64) % salts[where[salted]].astype(np.uint64)
                yield pd.DataFrame({
                    "h": h.view(np.int64), "salt": salt, "sid": sid,
                    "np": np.repeat(np.array(ns, np.int64), at) * PACK + pos,
                })
        powers.cache_clear()
        give_back()

    return run


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts in compressed form: a third of what the hashes of their shingles take."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield batch.assign(packed=[squeeze(_data(t)) for t in batch["text"]]).drop(columns="text")


def _unpacked(packed, size: int) -> Iterator[np.ndarray]:
    """The sets of compressed texts in turn; about SLICE bytes of text are expanded at a time."""
    expand = zstandard.ZstdDecompressor().decompress
    part, total = [], 0
    for x in packed:
        part.append(expand(x))
        total += len(part[-1])
        if total > SLICE:
            yield from shingle_sets(part, size)
            part, total = [], 0
    yield from shingle_sets(part, size)


class Recent:
    """Sets by id, made from compressed texts and kept while they take at most RECENT bytes."""

    def __init__(self, size: int):
        self.size, self.sets, self.bytes = size, {}, 0

    def get(self, sid: int, packed: bytes) -> np.ndarray:
        s = self.sets.get(sid)
        if s is None:
            s = next(_unpacked([packed], self.size))
            if self.bytes > RECENT:
                self.sets.clear()
                self.bytes = 0
            self.sets[sid] = s
            self.bytes += s.nbytes
        return s


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _compare_pivots(size: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sets that link with their pivots."""
        pivots = Recent(size)
        for batch in batches:
            rows = []
            for sid, pivot, s, y in zip(batch["sid"], batch["pivot"], _unpacked(batch["packed"], size), batch["other"], strict=True):
                p = pivots.get(pivot, y)
                if linked(len(np.intersect1d(s, p, True)), len(s), len(p), percent):
                    rows.append((sid, pivot))
            yield pd.DataFrame(rows, columns=["a", "b"], dtype=np.int64)

    return run


def _differences(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sets as what their pivots have (as places in the pivot) and they lack, and what they have besides."""
        pivots = Recent(size)
        for batch in batches:
            rows = []
            for sid, n, pivot, s, y in zip(batch["sid"], batch["n"], batch["pivot"], _unpacked(batch["packed"], size), batch["other"], strict=True):
                p = pivots.get(pivot, y)
                less = np.flatnonzero(~np.isin(p, s, assume_unique=True)).astype(np.int32)
                rows.append((sid, n, pivot, len(p), less.tobytes(), np.setdiff1d(s, p, True).tobytes()))
            yield pd.DataFrame(rows, columns=["sid", "n", "pivot", "n_pivot", "less", "more"])

    return run


def _viable(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sets and the pivots they meet that may link by their sizes and signatures."""
        of = lambda x: np.frombuffer(x, np.uint64)
        for b in batches:
            keep = [
                may_link(n1, n2, differ(of(x), of(y)), percent)
                for n1, n2, x, y in zip(b["n"], b["n_pivot"], b["sig"], b["sig_pivot"], strict=True)
            ]
            yield b.loc[np.array(keep, bool), ["sid", "pivot", "k", "pw"]]

    return run


def pairs_of_list(sid, n, pos, comp, sig, percent: int, other=None) -> list[tuple[int, int]]:
    """Pairs of an index list (or of two of its parts) that may link and are not known to be connected.

    Members are ordered by size and position and taken in blocks; of two blocks only the
    smallest and largest sizes and the first positions decide whether they are skipped.
    """

    def blocks(sid, n, pos, comp, sig):
        o = np.lexsort((pos, n))
        return [tuple(x[o[k : k + BLOCK]] for x in (sid, n, pos, comp, sig)) for k in range(0, len(o), BLOCK)]

    mine = blocks(sid, n, pos, comp, sig)
    theirs = mine if other is None else blocks(*other)
    out = []
    for k, (s1, n1, p1, c1, g1) in enumerate(mine):
        for j, (s2, n2, p2, c2, g2) in enumerate(theirs[k:] if other is None else theirs):
            if 100 * n1[-1] < percent * n2[0]:
                break
            if 100 * n2[-1] < percent * n1[0]:
                continue
            # At most what lies from the shared shingle on can be common.
            most = min((n1 - p1).max(), (n2 - p2).max())
            if (100 + percent) * most < percent * (n1[0] + n2[0]):
                continue
            rest = np.minimum((n1 - p1)[:, None], (n2 - p2)[None, :])
            good = (c1[:, None] != c2[None, :]) & ((100 + percent) * rest >= percent * (n1[:, None] + n2[None, :]))
            if other is None and j == 0:
                good = np.triu(good)
            for a, b in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
                if may_link(n1[a], n2[b], differ(g1[a], g2[b]), percent):
                    x, y = int(s1[a]), int(s2[b])
                    out.append((x, y) if x < y else (y, x))
    return out


def _list_pairs(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lists come sorted by key; a list is matched within, or its part x with its part y."""
        seen: set[tuple[int, int]] = set()

        def pairs(rows: dict[str, np.ndarray], cuts: list[int]) -> pd.DataFrame:
            start = np.array(cuts[:-1])
            if not len(start):
                return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
            open_ = np.minimum.reduceat(rows["comp"], start) != np.maximum.reduceat(rows["comp"], start)
            new = []
            for k in np.flatnonzero(open_).tolist():
                a, b = cuts[k], cuts[k + 1]
                own = [rows[c][a:b] for c in ("sid", "n", "pos", "comp")]
                own.append(np.array([None, *(np.frombuffer(x, np.uint64) for x in rows["sig"][a:b])], object)[1:])
                if rows["x"][a] == rows["y"][a]:
                    found = pairs_of_list(*own, percent)
                else:
                    first = rows["part"][a:b] == rows["x"][a]
                    found = pairs_of_list(*[c[first] for c in own], percent, [c[~first] for c in own])
                if len(seen) > MOST_SEEN:
                    seen.clear()
                new += [p for p in set(found) if p not in seen]
                seen.update(found)
            return pd.DataFrame(new, columns=["a", "b"], dtype=np.int64)

        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = batch[["h", "x", "y"]].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            yield pairs({c: batch[c].to_numpy() for c in batch.columns}, cuts)
            rest = batch.iloc[cuts[-1] :]
        if rest is not None and len(rest):
            yield pairs({c: rest[c].to_numpy() for c in rest.columns}, [0, len(rest)])

    return run


def _compare_differences(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of one pivot: common = pivot - (what either lacks) + (what both have besides)."""
        of = lambda x, kind=np.uint64: np.frombuffer(x, kind)
        for b in batches:
            keep = []
            for np_, n1, n2, l1, l2, m1, m2 in zip(b["n_pivot"], b["n1"], b["n2"], b["l1"], b["l2"], b["m1"], b["m2"], strict=True):
                common = np_ - len(np.union1d(of(l1, np.int32), of(l2, np.int32))) + len(np.intersect1d(of(m1), of(m2), True))
                keep.append(linked(common, n1, n2, percent))
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _compare_sets(size: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent = Recent(size)
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"], strict=True):
                s, t = recent.get(a, x), recent.get(b, y)
                keep.append(linked(len(np.intersect1d(s, t, True)), len(s), len(t), percent))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for the nodes of edges a, b.

    Labels go to neighbours and are then looked up once in themselves, so chains shorten by
    half in each round. Every round is written to the shared folder and replaces the last.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(edges.select(F.inline(ways)).distinct())
    labels = last = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        new = labels.join(near.select(F.col("a").alias("node"), "m"), "node").select("node", "comp", F.least("comp", "m").alias("to"))
        up = new.select(F.col("node").alias("to"), F.col("to").alias("far"))
        after = new.join(up, "to").select("node", F.col("comp").alias("old"), F.least("to", "far").alias("comp"))
        after = materialize(after)
        discard(last)
        labels, last = after.select("node", "comp"), after
        if after.filter("old <> comp").isEmpty():
            discard(both)
            return labels


def _fetch(rows: DataFrame, profiles: DataFrame, needed: DataFrame, best: DataFrame, broadcast_rows: int) -> DataFrame:
    """sid, n, pivot (the set itself where it has none), is_pivot, packed text of the needed sets, each from one of its texts."""
    chiefs = best.select(F.col("pivot").alias("sid")).distinct().withColumn("is_pivot", F.lit(True))
    wanted = profiles.filter("n > 0").join(needed, "sid", "left_semi").groupBy("sid").agg(F.min("uid").alias("uid"), F.min("n").alias("n"))
    wanted = wanted.join(best, "sid", "left").withColumn("pivot", F.coalesce("pivot", "sid")).join(chiefs, "sid", "left").withColumn("is_pivot", F.coalesce("is_pivot", F.lit(False)))
    wanted = materialize(wanted)
    if wanted.count() <= broadcast_rows:
        found = rows.select("uid", "text").join(F.broadcast(wanted), "uid")
        out = found.mapInPandas(_pack, "uid long, sid long, n long, pivot long, is_pivot boolean, packed binary")
    else:
        out = rows.select("uid", "text").mapInPandas(_pack, "uid long, packed binary").join(wanted, "uid")
    out = out.select("sid", "n", "pivot", "is_pivot", "packed")
    return out.dropDuplicates(["sid"]) if not profiles.groupBy("uid").count().filter("count > 1").isEmpty() else out


def dealt(lists: DataFrame, part: int, broadcast_rows: int) -> DataFrame:
    """The members of lists that are not all connected yet, as groups h, x, y to be matched.

    lists: h, sid, np (size and position), comp (null: the set alone). A list of at most
    ``part`` sets is one group. A longer one is dealt out by the hash of the set: those
    outside its largest component as all pairs x <= y of their parts, and each part of the
    largest component, which need not meet itself, with each part of the others. Lists of
    one component give no rows.
    """
    members = lists.withColumn("comp", F.coalesce("comp", "sid"))
    by_comp = members.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"))
    open_ = by_comp.groupBy("h").agg(
        F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("m")
    ).filter("k > 1")
    open_ = materialize(open_.select("h", F.col("top.comp").alias("top"), F.col("top.c").alias("d"), "m"))
    if open_.count() <= broadcast_rows:
        open_ = F.broadcast(open_)
    members = members.join(open_, "h")
    n_others = F.expr(f"cast(greatest(1, 1 + (m - d - 1) div {part}) as int)")
    n_main = F.expr(f"cast(1 + (d - 1) div {part} as int)")
    members = members.select("h", "sid", F.expr(f"np % {PACK}").alias("pos"), "comp", (F.col("comp") == F.col("top")).alias("main"),
                             "m", n_others.alias("o"), n_main.alias("n"))
    own = F.pmod(F.xxhash64("sid"), F.when(F.col("main"), F.col("n")).otherwise(F.col("o"))).cast("int")
    whole = F.col("m") <= part
    own = F.when(whole, 0).when(F.col("main"), F.col("o") + own).otherwise(own)
    members = members.withColumn("part", own)
    groups = (
        F.when(whole, F.expr("array(named_struct('x', 0, 'y', 0))"))
        .when(F.col("main"), F.expr("transform(sequence(0, o - 1), x -> named_struct('x', x, 'y', part))"))
        .otherwise(F.expr("""concat(transform(sequence(0, o - 1), z -> named_struct('x', least(part, z), 'y', greatest(part, z))),
                                    transform(sequence(0, n - 1), z -> named_struct('x', part, 'y', o + z)))"""))
    )
    return members.select("h", "sid", "pos", "comp", "part", F.inline(groups))


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    frequent: int = 65_536,
    broadcast_rows: int = 500_000,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, uid (a hash of id and text).

    Two rows link if 100 * common >= percent * (shingles of both); component_id is the
    smallest doc_id that links lead to. Null and wordless texts have no shingles and stay
    alone, with their own doc_id; null ids are no smallest id unless all ids are null;
    repeated rows link like copies. An empty table gives no rows; other columns of docs are
    not looked at. Texts of any length are read whole, in slices. ``frequent`` shingles (a
    bound on what is broadcast) come last in the order of shingles; they and the other bounds
    on what is broadcast change the work, not the result.
    """
    small_batches(docs.sparkSession)
    sc, kind = docs.sparkSession.sparkContext, docs.schema[id_col].dataType.simpleString()
    # Ids go through pandas as text, which keeps nulls and large numbers as they are.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    made = rows.mapInPandas(_profiles(size), "uid long, doc_id string, n long, sid long, sig binary, h long, c long")
    made = materialize(made.withColumn("doc_id", F.col("doc_id").cast(kind)))
    profiles = made.filter("h is null").select("uid", "doc_id", "n", "sid")
    top = made.filter("h is not null").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(frequent)
    top = np.array([tuple(r) for r in top.collect()], np.int64).reshape(-1, 2)  # at most `frequent` rows
    hot = top[:, 0].astype(np.int64).view(np.uint64)
    order = np.argsort(hot)
    salts = np.where(top[:, 1] > SALTED, 1 + top[:, 1] // SALTED, 0)
    shared = sc.broadcast((hot[order], (-np.arange(len(hot)))[order], salts[order]))

    # One shuffle: equal sets of a list fall together, and lists of one set go. The long lists of
    # frequent shingles are salted by set, so no task gets a whole one.
    lists = rows.select("text").mapInPandas(_postings(shared, size, percent), "h long, salt int, sid long, np long").repartition("h", "salt")
    lists = lists.groupBy("h", "salt", "sid").agg(F.first("np").alias("np"))
    several = (F.count(F.lit(1)).over(Window.partitionBy("h", "salt")) > 1) | (F.col("salt") > 0)
    lists = materialize(lists.withColumn("several", several).filter("several").select("h", "sid", "np"))

    # The pivot of a list lies in the most lists; a set's pivot is the one it meets most often and may link with.
    weight = materialize(lists.groupBy("sid").agg(F.count(F.lit(1)).alias("w")))
    signs = made.filter("n > 0").select("sid", "n", "sig").join(weight, "sid", "left_semi").groupBy("sid").agg(
        F.first("n").alias("n"), F.first("sig").alias("sig"))
    signs = materialize(signs)
    sizes = signs.agg(F.sum(F.octet_length("sig") + 64)).first()[0] or 0
    few = sizes <= broadcast_bytes  # else what follows is shuffled by set
    few_weights = weight.count() * 64 <= broadcast_bytes
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    size_of = F.expr(f"np div {PACK}").alias("size")
    heavy = lists.select("h", "sid", size_of).join(F.broadcast(weight) if few_weights else weight, "sid")
    chiefs = materialize(heavy.groupBy("h").agg(F.max(F.struct("w", "sid", "size")).alias("p"), F.count(F.lit(1)).alias("m")).filter("m > 1"))
    met = lists.select("h", "sid", size_of).join(chiefs, "h")
    met = met.filter(100 * F.least("size", "p.size") >= percent * F.greatest("size", "p.size"))  # else they can't link
    met = met.select("sid", F.col("p.sid").alias("pivot"), F.col("p.w").alias("pw")).filter("pivot <> sid").groupBy("sid", "pivot").agg(F.count(F.lit(1)).alias("k"), F.max("pw").alias("pw"))
    met = met.join(small(signs), "sid").join(small(signs.toDF("pivot", "n_pivot", "sig_pivot")), "pivot")
    met = met.mapInPandas(_viable(percent), "sid long, pivot long, k long, pw long")
    best = materialize(met.groupBy("sid").agg(F.max(F.struct("k", "pw", "pivot")).alias("p")).select("sid", F.col("p.pivot").alias("pivot")))
    needed = best.select("sid").unionAll(best.select("pivot")).distinct()
    sets = materialize(_fetch(rows, profiles, needed, best, broadcast_rows))

    other = materialize(sets.filter("is_pivot").select(F.col("sid").alias("pivot"), F.col("packed").alias("other")))
    compared = sets.filter("pivot <> sid").select("sid", "pivot", "packed").join(other, "pivot")
    links = materialize(compared.mapInPandas(_compare_pivots(size, percent), "a long, b long"))
    known = components(links)

    members = dealt(lists.join(small(known.withColumnRenamed("node", "sid")), "sid", "left"), PART, broadcast_rows)
    if few:  # signatures are looked up after the shuffle
        members = members.repartition("h", "x", "y").join(small(signs), "sid")
    else:
        members = members.join(signs, "sid").repartition("h", "x", "y")
    members = members.sortWithinPartitions("h", "x", "y")
    pairs = materialize(members.mapInPandas(_list_pairs(percent), "a long, b long").distinct())
    discard(lists, chiefs, weight, signs)
    paired = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    lacking = materialize(paired.join(sets.select("sid"), "sid", "left_anti"))
    if not lacking.isEmpty():
        sets = sets.unionByName(materialize(_fetch(rows, profiles, lacking, best, broadcast_rows)))

    # Only the sets of these pairs are shuffled.
    sided = pairs.join(best.toDF("a", "pa"), "a", "left").join(best.toDF("b", "pb"), "b", "left")
    sided = materialize(sided.withColumn("alike", F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))))
    asked = materialize(sided.select(F.explode(F.array("a", "b")).alias("sid"), "alike").distinct())
    brief = (lambda x: F.broadcast(x)) if asked.count() <= broadcast_rows else (lambda x: x)
    delta = sets.select("sid", "n", "pivot", "packed").join(brief(asked.filter("alike").select("sid")), "sid", "left_semi")
    delta = delta.join(other, "pivot").mapInPandas(
        _differences(size), "sid long, n long, pivot long, n_pivot long, less binary, more binary"
    )
    delta = materialize(delta)
    one = delta.toDF("a", "n1", "pivot", "n_pivot", "l1", "m1")
    two = delta.select("sid", "n", "less", "more").toDF("b", "n2", "l2", "m2")
    alike = sided.filter("alike").select("a", "b").join(one, "a").join(two, "b")
    more = alike.select("a", "b", "n_pivot", "n1", "n2", "l1", "l2", "m1", "m2").mapInPandas(_compare_differences(percent), "a long, b long")
    texts = sets.select("sid", "packed").join(brief(asked.filter("not alike").select("sid")), "sid", "left_semi")
    far = sided.filter("not alike").select("a", "b").join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a")
    more = more.unionAll(far.mapInPandas(_compare_sets(size, percent), "a long, b long"))
    comp = components(links.unionAll(more))
    discard(links, pairs, sided, asked, delta, other, sets, best)

    ids = profiles.filter("n > 0").join(comp.withColumnRenamed("node", "sid"), "sid", "left")
    ids = ids.select("uid", "doc_id", "n", F.coalesce("comp", "sid").alias("comp"))
    # Written first, so that the join with it can split a large component.
    least = materialize(ids.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    out = ids.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "uid", "comp")
    alone = profiles.filter("n = 0")
    alone = alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "uid", F.lit(None).cast("long").alias("comp"))
    return out.unionAll(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, **options) -> DataFrame:
    """docs, all columns as they are, with one row of each component: that of the smallest id, nulls last.

    Rows without words stay. Of rows alike in id and text one stays, whether they have words or not.
    """
    found = materialize(jaccard_join(docs, id_col, text_col, **options).select("uid", "doc_id", "comp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("f")
    first = found.filter("comp is not null").groupBy("comp").agg(first).select("comp", F.col("f.uid").alias("first"))
    gone = found.join(first, "comp").filter("uid <> first").select("uid").distinct()
    gone = materialize(gone)
    twice = not found.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    if gone.count() <= broadcast_rows:  # else the texts are shuffled by uid
        gone = F.broadcast(gone)
    # The key is made beside the columns of docs, whatever their names.
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("uid"))
    rows = rows.join(gone, "uid", "left_anti")
    if twice:
        rows = rows.dropDuplicates(["uid"])
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir):
    out = jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
"""
