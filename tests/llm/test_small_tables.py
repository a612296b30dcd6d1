"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain Python."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postlens.llm import chat, decontaminate, jaccard, quality, scratch, sharding, warc

DOCS = "doc_id long, text string, source string, n string, shard string, words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "n", "s", "w") for i, t, s in rows], DOCS)


def lines(seed, n, words):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 90))) for _ in range(n)]


ODD = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, "one", None), (3, "one", None), (4, " \n\t ", "b"), (5, "x" * 20_000, "b"), (None, "one two", "b")]


def test_quality(spark):
    words = "a bb ccc dd ee # $".split()
    rows = ODD + [(i + 10, "\n".join(t.split(" ", 9)), f"h{i % 3}") for i, t in enumerate(lines(1, 60, words))]
    got = quality.quality(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(hit)))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r.doc_id), *(r[c] for c in cols)) for r in got) == sorted(want)
    assert quality.quality(frame(spark, rows).limit(0)).count() == 0
    assert all(not r.kept for r in got if r.base_failed)


def test_host_verdicts(spark):
    good, bad = "word " * 10 + "alpha beta gamma delta " * 0, "## $$ && "
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text, "fine") for i in range(40)] + [(100 + i, text + " " + bad * 20, "spam") for i in range(30)] + [(200, text, "spam"), (201, text + bad * 9, "fine")]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    assert got[100].host_rejected and not got[100].kept  # a failing document of a rejected host
    assert got[200].kept and got[0].kept and got[201].kept  # clean ones, and those of other hosts, stay
    assert good


def test_hosts_beyond_the_broadcast(spark):
    rows = ODD + [(i + 10, t, f"h{i % 3}") for i, t in enumerate(lines(4, 40, ["a", "bb", "#"]))]
    shape = lambda **o: sorted(map(str, quality.quality(frame(spark, rows), **o).select("doc_id", "host_docs", "host_rejected", "kept").collect()))
    assert shape(broadcast_rows=0) == shape()


def test_sharding_against_a_walk_round_the_ring(spark):
    rows = ODD + [(i + 10, t, "s") for i, t in enumerate(lines(2, 200, "a b c é".split()))]
    got = sharding.shard(frame(spark, rows), shards=4, vnodes=8).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    place = lambda x, n: int(hashlib.md5(x.encode()).hexdigest()[:n], 16)
    nodes = sorted((place(f"node:{s}:{k}", 3), s, k) for s in range(4) for k in range(8))
    left = {s: len(rows) // 4 + (s < len(rows) % 4) for s in range(4)}
    arcs = defaultdict(list)
    for i, t, _ in rows:
        crc = zlib.crc32((t or "").encode())
        key = f"{'' if i is None else i}:{crc}"
        p = hashlib.md5(key.encode()).hexdigest()[:13]
        arcs[sum(1 for c, *_ in nodes if c < int(p[:3], 16)) % len(nodes)].append((p, i is not None, i or 0, crc, len((t or "").encode()) + 1))
    want = Counter()
    queue = {a: sorted(v) for a, v in arcs.items()}
    for hop in range(4):
        for a in sorted(queue):
            met = list(dict.fromkeys(s for _, s, _ in nodes[a:] + nodes[:a]))[hop]
            take, queue[a] = queue[a][: left[met]], queue[a][left[met] :]
            left[met] -= len(take)
            want.update((x[3], x[4], met) for x in take)
    assert Counter((r.text_crc32, r.size, r.shard) for r in got) == want
    assert sharding.shard(frame(spark, rows).limit(0)).count() == 0


def test_reply_trees(spark):
    nodes = [  # a tree with two branches, an orphan, a cycle, a null tree
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "short", 1.0), (1, 3, 1, "assistant", "a</s>~1[b]", 2.0), (1, 4, 3, None, None, None),
        (2, 9, 8, "assistant", "lost", 0.0), (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "y", 0.0), (None, 1, None, "assistant", "n", None),
    ]
    df = spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    got = {r.tree_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert set(got) == {1, 2, None}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "q"), ("assistant", "a</s>~1[b]"), ("", "")]
    assert got[1].loss_text == "a</s>~1[b]" and got[2].loss_text == "lost" and got[None].loss_text == "n"
    two = chat.format_chats(df, branches=2).filter("tree_id = 1").orderBy("branch").collect()
    assert len(two) == 2 and "short" in two[1].formatted
    assert chat.format_chats(df.limit(0)).count() == 0
    clash = df.withColumns({"branch": F.lit("x"), "depth": F.lit(3), "turn": F.lit(None).cast("int"), "formatted": F.lit("")})
    assert sorted(map(str, chat.format_chats(clash).collect())) == sorted(map(str, chat.format_chats(df).collect()))
    long = df.withColumn("text", F.when(F.col("node_id") == 3, F.repeat(F.lit("a[~]é"), 200_000)).otherwise(F.col("text")))
    assert chat.read_back(chat.format_chats(long)).filter("tree_id = 1").first().loss_text == "a[~]é" * 200_000


def test_long_chain(spark):
    df = spark.range(300).select(F.lit(5).alias("c"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.read_back(chat.format_chats(chat.chain(df, "c", "turn", "role", "text"))).first()
    assert [t.text for t in r.turns] == [str(i) for i in range(300)]
    assert r.loss_text == "".join(str(i) for i in range(1, 300, 2))


def components(rows, percent=80):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                comp[find(a)] = find(b)
    ids = defaultdict(list)
    for k in range(len(rows)):
        ids[find(k)].append(rows[k][0])
    out = []
    for k, (i, *_) in enumerate(rows):
        known = [x for x in ids[find(k)] if x is not None]
        out.append((str(i), len(sets[k]), str(min(known) if known and sets[k] else i)))
    return sorted(out)


@pytest.mark.parametrize("part,few,salted", [(2_000, 500_000, 5_000), (3, 0, 2)])
def test_jaccard(spark, monkeypatch, part, few, salted):
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "SALTED", salted)
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows, doc = list(ODD) + [(6, "ONE", "c"), (7, "one two", "d")], 10
    for length in (8, 30, 120):
        base = [r.choice(words) for _ in range(length)]
        for _ in range(30):  # copies with more and more edits, chains of links among them
            t = list(base)
            for _ in range(r.randint(0, max(1, length // 25))):
                t[r.randrange(len(t))] = r.choice(words)
            if r.random() < 0.3:
                base = t
            rows.append((doc, " ".join(t), "s"))
            doc += 1
    common = " ".join(words[:12])
    rows += [(doc + i, common + " " + " ".join(r.choice(words) for _ in range(20)), "s") for i in range(40)]  # a shared passage
    rows.append((doc + 50, " ".join(f"v{i % 997} u{i % 1009}" for i in range(30_000)), "s"))  # a very long text
    got = jaccard.jaccard_join(frame(spark, rows), broadcast_rows=few, broadcast_bytes=few << 7).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == components(rows)


def test_linked_lists_are_not_dealt_out(spark):
    """A list of one component adds no row; a large component meets only those outside it, once each."""
    rows = [(1, i, 7, 0) for i in range(50)] + [(2, i, 7, 0) for i in range(50)] + [(2, 90, 7, None), (2, 91, 7, None)] + [(3, i, 7, i) for i in range(4)]
    lists = spark.createDataFrame(rows, "h long, sid long, np long, comp long")
    got = jaccard.dealt(lists, 10, 100).collect()
    assert {r.h for r in got} == {2, 3}
    groups = defaultdict(set)
    for r in got:
        groups[r.h, r.x, r.y].add(r.sid)
    met = Counter(frozenset((a, b)) for k, g in groups.items() if k[0] == 2 for a in g for b in g if a < b and (a >= 90) + (b >= 90) == 1)
    assert len(met) == 100 and set(met.values()) == {1}
    assert sum(r.h == 2 and r.sid < 50 for r in got) == 50
    assert any({90, 91} <= g for g in groups.values())
    assert groups[3, 0, 0] == {0, 1, 2, 3}


def test_jaccard_edges(spark):
    assert jaccard.jaccard_join(frame(spark, ODD).limit(0)).count() == 0
    kept = jaccard.one_of_each(frame(spark, ODD + [(9, "one", "z")])).collect()
    assert sorted(str(r.doc_id) for r in kept if r.text == "one") == ["3"]
    assert kept[0].__fields__ == [c.split()[0] for c in DOCS.split(", ")]
    rows = [(i, "same words in every row of this", "a") for i in range(50)]
    assert {r.component_id for r in jaccard.jaccard_join(frame(spark, rows)).collect()} == {0}


def test_pieces_of_long_texts(monkeypatch):
    text = (" ".join(f"w{i % 37}" for i in range(500))).encode()
    whole = [x.tolist() for x in jaccard.shingle_sets([text, b"", b"a b", b"  "], 5)]
    monkeypatch.setattr(jaccard, "SLICE", 64)
    assert [x.tolist() for x in jaccard.shingle_sets([text, b"", b"a b", b"  "], 5)] == whole


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def found(text, items, misses=0):
    w = words_of(text)
    hit, ids, near = set(), set(), set()
    for i, t in items:
        q = words_of(t)
        for k in range(max(1, len(q) - 9) if q else 0):
            x = q[k : k + 10]
            for s in range(len(w) - len(x) + 1):
                wrong = sum(a != b for a, b in zip(w[s : s + len(x)], x, strict=True))
                if not wrong:
                    hit |= set(range(s, s + len(x)))
                    ids.add("" if i is None else str(i))
                if len(x) == 10 and wrong <= misses:
                    near.add("" if i is None else str(i))
    return len(w), sorted(hit), sorted(ids), sorted(near)


@pytest.mark.parametrize("few,segment,options", [(False, 8 << 20, {}), (True, 60, {"broadcast_terms": 0, "broadcast_rows": 0, "block_windows": 9})])
def test_decontaminate(spark, monkeypatch, few, segment, options):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)  # tasks get the value that their function was made with
    monkeypatch.setattr(jaccard, "SLICE", 64 if few else 1 << 18)
    r = random.Random(5)
    words = ["a", "b", "c", "dd", "Eé", "9"]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate((3, 9, 10, 11, 25, 40, 12))] + [(None, "zz"), (50, None), (51, ""), (3, "dd dd dd")]
    long = " ".join(f"n{i % 8999}" for i in range(30_000))
    rows = list(ODD) + [(20, "zz! ZZ", "a"), (21, f"{long} {items[4][1]} {long}", "very long")]
    for i in range(40):
        t = [r.choice(words) for _ in range(r.randint(0, 40))]
        q = (r.choice(items)[1] or "").split()
        if len(q) > 2 and r.random() < 0.5:
            q[r.randrange(len(q))] = "x"
        t[r.randint(0, len(t)) :] = q
        rows.append((30 + i, "-".join(t), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, rows), bench, **options).collect()
    shape = lambda x: (str(x[0]), *x[1:])
    mine = sorted(shape((g.doc_id, g.n_words, [k for a, b in zip(g.spans[::2], g.spans[1::2], strict=True) for k in range(a, b)], sorted(g.items), sorted(g.near))) for g in got)
    assert mine == sorted(shape((i, *found(t, items, 2))) for i, t, _ in rows)
    clean = decontaminate.drop_contaminated(frame(spark, rows), bench, **options).collect()
    assert Counter((x.doc_id, x.text) for x in clean) == Counter((i, t) for i, t, _ in rows if not found(t, items)[1])
    assert decontaminate.decontaminate(frame(spark, rows).limit(0), bench).count() == 0
    assert all(not g.items for g in decontaminate.decontaminate(frame(spark, rows), bench.limit(0)).collect())


def test_warc(spark, tmp_path):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    huge = "".join(random.Random(3).choices("abcdefgh é", k=1_000)) * 17_500
    rows = [(11, "u", huge), (3, "http://x/\r\ny", long), (1, None, long), (2, "u", long), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", long + "!"), (8, "u", "z" * 99), (9, "u", "z" * 100), (10, "u", "z" * 100)]
    pages = spark.createDataFrame([(*x, "r") for x in rows], "page_id long, url string, html string, record_type string")
    for few in (200_000, 0):
        path = scratch.shared_folder(spark)
        warc.write_archives(pages, path, broadcast_rows=few, file_bytes=400)
        files = [f.removeprefix("file:") for f in spark.read.text(path).inputFiles()]
        whole = [gzip.decompress(Path(f.removeprefix("//")).read_bytes()) for f in files]  # as other readers see them
        assert sum(x.count(b"WARC-Record-ID") for x in whole) == len(rows) and len(files) > 5
        got = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
        assert len(got) == len(rows)
        for i, _, t in rows:
            data = (t or "").encode()
            r = got["" if i is None else str(i)]
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
            same = min((j for j, _, u in rows if u == t and j is not None), default=None)
            first = same if len(data) >= 100 and i is not None else i
            assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", str(first)))
    path = scratch.shared_folder(spark)
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_near_matches_lie_inside_one_document(spark):
    item = [f"q{i}" for i in range(10)]
    texts = ["other words", " ".join(item[1:] + ["end"]), "more words", " ".join(["begin", *item[:8]]), " ".join(item[:9] + ["x"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for few in (docs, docs.filter("doc_id = 1"), docs.filter("doc_id = 4")):
        got = decontaminate.decontaminate(few, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
        assert {r.doc_id: r.near for r in got} == {r.doc_id: ["7"] if r.doc_id == 4 else [] for r in few.collect()}
