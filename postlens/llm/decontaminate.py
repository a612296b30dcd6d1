"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed once, in segments of about SEGMENT bytes of text: a row for each term of
a segment, with its sorted places, and a row for each document. The index is a table in the
shared folder. Windows of the test items are a table too, and never meet on the driver:

1. The terms' frequencies in the whole corpus order each window's terms, rarest first.
2. A window is sent to the segments that the index gives for its rarest term (for proximity,
   for its few rarest terms).
3. Segment by segment, the list of the rarest term, shifted by the term's offset, gives the
   places where the window can start, and the other terms' lists, shifted alike, are
   intersected with it from rare to frequent. A place where all terms meet is an exact phrase
   match; one where all but a few meet is a proximity match.

Only terms of the test items are indexed, as long as there are few enough to tell the tasks.
Terms are compared by 64-bit hashes. Texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import jaccard
from postlens.llm.scratch import discard, give_back, materialize, small_batches

WINDOW = 10
#: Bytes of words: digits, lower-case letters and all of non-ASCII text; A-Z are lower-cased, the rest are spaces.
WORD_BYTES = bytes(
    c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
SEGMENT = 8 << 20
INDEX = "segment long, doc_no int, doc_id string, uid long, n_words long, begin long, term long, n long, places binary"
FOUND = "segment long, doc_no int, spans array<int>, exact array<long>, near array<long>"


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES) if text else b""


def term_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words in order; long texts are read in slices."""
    out: list[np.ndarray] = []
    for part in jaccard.pieces(texts):
        if len(part) == 1:
            out.append(jaccard.long_words(part[0]))
        else:
            at, words = jaccard.word_hashes(b" ".join(part))
            bounds = np.searchsorted(at, np.cumsum([0] + [len(x) + 1 for x in part]))
            out += [words[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


def _segments(shared, gap: int):
    """Index rows of documents. Postings have doc_no -1; documents lie ``gap`` places apart, so no window spans two."""

    def rows(segment: int, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        hashes = term_hashes([_bytes(t) for t in part["text"]])
        lengths = np.array([len(h) for h in hashes], np.int64)
        begins = gap + np.cumsum(lengths + gap) - lengths - gap
        yield pd.DataFrame({
            "segment": segment, "doc_no": np.arange(len(part), dtype=np.int32), "doc_id": list(part["doc_id"]), "uid": list(part["uid"]),
            "n_words": lengths, "begin": begins, "term": 0, "n": 0, "places": b"",
        })
        h = np.concatenate(hashes).view(np.int64)
        at = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(len(h))
        if shared is not None and len(h):
            known = shared.value
            here = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
            h, at = h[here], at[here]
        order = np.argsort(h, kind="stable")
        terms, first = np.unique(h[order], return_index=True)
        lists = np.split(at[order].astype(np.int32), first[1:]) if len(terms) else []
        yield pd.DataFrame({
            "segment": segment, "doc_no": np.int32(-1), "doc_id": None, "uid": 0, "n_words": 0, "begin": 0, "term": terms,
            "n": [len(x) for x in lists], "places": [x.tobytes() for x in lists],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            sizes = np.cumsum([len(t) if t is not None else 0 for t in batch["text"]])
            for _, part in batch.groupby(sizes // SEGMENT, sort=False):
                held.append(part)
                size += sum(len(t) if t is not None else 0 for t in part["text"])
                if size >= SEGMENT:
                    yield from rows(segment, pd.concat(held))
                    segment, held, size = segment + 1, [], 0
        if held:
            yield from rows(segment, pd.concat(held))
        del held
        jaccard.powers.cache_clear()
        give_back()

    return run


def _item_windows(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The distinct windows of each item."""
        for batch in batches:
            out = set()
            for item, h in zip(batch["item"], term_hashes([_bytes(t) for t in batch["text"]]), strict=True):
                terms = h.view(np.int64).tolist()
                out |= {(item, tuple(terms[i : i + size])) for i in range(max(1, len(terms) - size + 1) if terms else 0)}
            yield pd.DataFrame({"item": [i for i, _ in out], "terms": [list(t) for _, t in out]})

    return run


def runs(spans: Iterator[tuple[int, int]]) -> list[int]:
    """The union of intervals, as start, end, start, end ... of sorted disjoint intervals."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(b, out[-1])
        else:
            out += [a, b]
    return out


class Segment:
    """The postings of one segment: places by term, and the term at each place."""

    def __init__(self, docs: pd.DataFrame, postings: pd.DataFrame, gap: int):
        docs, postings = docs.sort_values("doc_no"), postings.sort_values("term")
        self.doc_no, self.begin, self.n_words = (docs[c].to_numpy() for c in ("doc_no", "begin", "n_words"))
        self.terms = postings["term"].to_numpy()
        lists = [np.frombuffer(x, np.int32) for x in postings["places"]]
        self.counts = np.array([len(x) for x in lists], np.int64)
        self.places = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self.at = np.full(int(self.begin[-1] + self.n_words[-1]) + 2 * gap, -1, np.int32)
        self.at[self.places] = np.repeat(np.arange(len(lists), dtype=np.int32), self.counts)

    def local(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of terms in this segment; -3 for those it lacks."""
        k = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return np.where(self.terms[k] == terms, k, -3) if len(self.terms) else np.full(terms.shape, -3)

    def candidates(self, seed: np.ndarray, offset: np.ndarray, window: np.ndarray, size: int, most: int = 1_000_000):
        """(window, start) for each place of the seed terms, shifted by their offsets; in blocks of about ``most`` rows."""
        block = np.cumsum(self.counts[seed]) // most
        for b in np.unique(block):
            k = block == b
            n = self.counts[seed[k]]
            each = np.repeat(np.arange(k.sum()), n)
            within = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            start = self.places[self.offsets[seed[k]][each] + within].astype(np.int64) - offset[k][each]
            good = (start >= 0) & (start + size <= len(self.at))
            yield window[k][each][good], start[good]


def _search(size: int, misses: int):
    def run(postings: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        """Matches of the windows that are sent to one segment."""
        none = pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}).astype({"segment": "int64", "doc_no": "int32", "spans": object, "exact": object, "near": object})
        if not len(postings) or not len(wanted):
            return none
        is_doc = postings["doc_no"] >= 0
        s = Segment(postings[is_doc], postings[~is_doc], size)
        lengths = np.array([len(x) for x in wanted["terms"]])
        terms, offsets = np.full((len(wanted), size), -2, np.int64), np.zeros((len(wanted), size), np.int64)
        for i, (t, o) in enumerate(zip(wanted["terms"], wanted["offsets"], strict=True)):
            terms[i, : len(t)], offsets[i, : len(o)] = t, o
        local = np.where(np.arange(size) < lengths[:, None], s.local(terms), -2)
        seeds, found = wanted["seeds"].to_numpy(), []
        for j in range(misses + 1):
            mine = np.flatnonzero((seeds >> j & 1 > 0) & (local[:, j] >= 0) & ((lengths == size) | (j == 0)))
            for window, start in s.candidates(local[mine, j], offsets[mine, j], mine, size):
                limit = np.where(lengths[window] == size, misses, 0)
                wrong = np.zeros(len(window), np.int64)
                for k in range(size):  # from rare to frequent
                    t = local[window, k]
                    wrong += (s.at[start + offsets[window, k]] != t) & (t != -2)
                    keep = wrong <= limit
                    window, start, wrong, limit = window[keep], start[keep], wrong[keep], limit[keep]
                found.append((window, start, wrong == 0))
        if not found:
            return none
        window, start, exact = (np.concatenate([f[i] for f in found]) for i in range(3))
        doc = np.searchsorted(s.begin, start, "right") - 1
        inside = (doc >= 0) & (start + lengths[window] <= s.begin[doc] + s.n_words[doc])  # gaps count as misses only
        window, start, exact, doc = window[inside], start[inside], exact[inside], doc[inside]
        wid, out = wanted["wid"].to_numpy(), []
        order = np.argsort(doc, kind="stable")
        for k in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
            d, e = doc[k[0]], k[exact[k]]
            a = start[e] - s.begin[d]
            spans = runs(zip(a.tolist(), (a + lengths[window[e]]).tolist(), strict=True))
            near = np.unique(wid[window[k[lengths[window[k]] == size]]]) if misses else wid[:0]
            out.append((postings["segment"].iloc[0], s.doc_no[d], spans, np.unique(wid[window[e]]).tolist(), near.tolist()))
        return pd.DataFrame(out, columns=list(none.columns)) if out else none

    return run


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spans = [runs((a, b) for x in lists for a, b in zip(x[::2].tolist(), x[1::2].tolist(), strict=True)) for lists in batch["spans"]]
        yield batch.assign(spans=spans)


def _index(docs: DataFrame, benchmark: DataFrame, id_col: str | None, text_col: str, item_col: str, item_text_col: str, misses: int,
           broadcast_terms: int, broadcast_rows: int, block_windows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents of the index, the matches (FOUND, one row a document), and the items of each window (wid, item)."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    owners = items.mapInPandas(_item_windows(WINDOW), "item string, terms array<long>").withColumn("wid", F.xxhash64("terms"))
    owners = materialize(owners)
    windows = materialize(owners.groupBy("wid").agg(F.first("terms").alias("terms")))
    terms = materialize(windows.select(F.explode("terms").alias("term")).distinct())
    shared = None
    if terms.count() <= broadcast_terms:
        shared = sc.broadcast(np.sort(np.array([r.term for r in terms.collect()], np.int64)))  # at most broadcast_terms numbers

    doc_id = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(text_col).alias("uid"), F.col(text_col).alias("text"))
    index = materialize(rows.mapInPandas(_segments(shared, WINDOW), INDEX))
    postings = index.filter("doc_no < 0")

    # The terms of each window, rarest in the corpus first.
    counts = materialize(postings.groupBy("term").agg(F.sum("n").alias("f")))
    each = windows.select("wid", F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left")
    ranked = each.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "offset", "term"))).alias("t"))  # WINDOW terms
    ranked = materialize(ranked.select("wid", F.expr("transform(t, x -> x.f)").alias("f"), F.expr("transform(t, x -> x.offset)").alias("offsets"), F.expr("transform(t, x -> x.term)").alias("terms")))
    n_windows = ranked.count()
    small = (lambda x: F.broadcast(x)) if n_windows * (misses + 1) <= broadcast_rows else (lambda x: x)
    # With at most `misses` wrong terms, one of the misses + 1 rarest is right.
    tried = F.when(F.size("terms") == WINDOW, F.slice("terms", 1, misses + 1)).otherwise(F.slice("terms", 1, 1))
    seeds = ranked.select("wid", F.posexplode(tried).alias("j", "term"))
    sent = postings.select("segment", "term").join(small(seeds), "term").groupBy("segment", "wid").agg(F.bit_or(F.expr("shiftleft(1, j)")).alias("seeds"))
    blocks = 1 + n_windows // block_windows
    sent = materialize(sent.join(small(ranked.drop("f")), "wid").withColumn("block", F.pmod("wid", F.lit(blocks)).cast("int")))
    asked = materialize(sent.select("segment", "block").distinct())
    parts = index.select("segment", "doc_no", "n_words", "begin", "term", "places").join(asked, "segment")
    found = parts.groupBy("segment", "block").cogroup(sent.groupBy("segment", "block")).applyInPandas(_search(WINDOW, misses), FOUND)
    found = found.groupBy("segment", "doc_no").agg(
        F.collect_list("spans").alias("spans"), F.flatten(F.collect_list("exact")).alias("exact"), F.flatten(F.collect_list("near")).alias("near")
    )  # a document's matches from each block
    kinds = "segment long, doc_no int, spans array<int>, exact array<long>, near array<long>"
    found = materialize(found.mapInPandas(_merged, kinds))
    owners_ = materialize(owners.select("wid", "item").distinct())
    docs_ = materialize(index.filter("doc_no >= 0").select("segment", "doc_no", "doc_id", "uid", "n_words"))
    discard(index, owners, windows, terms, counts, ranked, sent, asked)
    return docs_, found, owners_


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    misses: int = 2,
    broadcast_terms: int = 4_000_000,
    broadcast_rows: int = 200_000,
    block_windows: int = 100_000,
) -> DataFrame:
    """One row per input row: doc_id, n_words, spans, items, near.

    spans are the hit words as start, end, start, end ... (ends exclusive) in word numbers;
    items the ids of the test items of which a window occurs; near those of which a window of
    ten words occurs with at most ``misses`` other words in their places. Null and empty
    texts have no words; texts of any length are read whole; null item ids count as empty
    strings; repeated items and rows count each for itself; without documents there are no
    rows, without items nothing is hit. Other columns are not looked at. The other parameters
    bound what is broadcast and how many windows meet a segment at once, not the result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows, found, owners = _index(docs, benchmark, id_col, text_col, item_col, item_text_col, misses, broadcast_terms, broadcast_rows, block_windows)
    key = ["segment", "doc_no"]

    def items(wids: str, name: str) -> DataFrame:
        each = found.select(*key, F.explode(wids).alias("wid")).join(owners, "wid")
        return each.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias(name))

    out = rows.join(found.select(*key, "spans"), key, "left").join(items("exact", "items"), key, "left").join(items("near", "near"), key, "left")
    empty = lambda c, t: F.coalesce(c, F.lit([]).cast(f"array<{t}>")).alias(c)
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", empty("spans", "int"), empty("items", "string"), empty("near", "string"))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_terms: int = 4_000_000,
    broadcast_rows: int = 200_000,
    block_windows: int = 100_000,
) -> DataFrame:
    """The rows of docs, all columns as they are, in which no window of a test item occurs.

    Rows with null and empty texts stay; repeated rows stay or go alike; without items all
    rows stay; an empty table gives no rows.
    """
    rows, found, _ = _index(docs, benchmark, None, text_col, item_col, item_text_col, 0, broadcast_terms, broadcast_rows, block_windows)
    hit = found.filter(F.size("exact") > 0).select("segment", "doc_no")
    gone = materialize(rows.join(hit, ["segment", "doc_no"]).select("uid").distinct())
    if gone.count() <= broadcast_rows:  # else the texts are shuffled by uid
        gone = F.broadcast(gone)
    # The key is made beside the columns of docs, whatever their names.
    kept = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("uid")).join(gone, "uid", "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir):
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_hit", hit)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near_items"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN win ON win.n = grams.n AND win.g = array_to_string(w[i:i + grams.n - 1], ' ')),
cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
wt AS (SELECT item_id, g, unnest(string_split(g, ' ')) AS t, unnest(range(10)) AS p FROM win WHERE n = 10),
gt AS (SELECT doc_id, i, unnest(w[i:i + 9]) AS t, unnest(range(10)) AS p
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM d WHERE len(w) >= 10)),
nears AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_near FROM (
          SELECT doc_id, i, item_id, g FROM gt JOIN wt USING (t, p) GROUP BY ALL HAVING count(*) >= 8) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN nears USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
