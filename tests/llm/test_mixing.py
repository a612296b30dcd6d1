"""The mix against apportionment in plain Python."""

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import pytest

from postlens.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, row string, block string, shards string, target string"


def fair_targets(sizes, weights, percent, times):
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    w = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    out, free, left = {}, set(names), percent * sum(sizes.values()) / 100
    while True:
        share = {x: left * w[x] / sum(w[y] for y in free) for x in free}
        over = {x for x in free if share[x] > times * sizes[x]}
        if not over:
            return names, out | share
        for x in over:
            out[x] = float(times * sizes[x])
            left -= out[x]
        free -= over


def highest_quotients(names, targets, blocks, seats, times):
    heap = [(-targets[x], i, 1) for i, x in enumerate(names) if blocks[x]]
    heapq.heapify(heap)
    got = Counter()
    while seats and heap:
        q, i, k = heapq.heappop(heap)
        x = names[i]
        got[x], seats = got[x] + 1, seats - 1
        if k < times * blocks[x]:
            heapq.heappush(heap, (-targets[x] / (2 * k + 1), i, k + 1))
    return got


def draw(*what):
    return int(hashlib.md5(":".join(map(str, what)).encode()).hexdigest()[:15], 16)


def expected(rows, seed, weights, percent, times, block):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((draw(seed, "document", *([] if i is None else [i])), i is not None, i or 0, words(t)))
    sizes = {s: sum(x[3] for x in v) for s, v in by.items()}
    names, targets = fair_targets(sizes, weights, percent, times) if sum(sizes.values()) else (sorted(sizes, key=str), dict.fromkeys(sizes, 0.0))
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    seats = highest_quotients(names, targets, blocks, (percent * sum(sizes.values()) + 50 * block) // (100 * block), times)
    for s, docs in by.items():
        key = "~" if s is None else f"={s}"
        order = sorted(range(blocks[s]), key=lambda b: (draw(seed, "block", key, b), b))
        taken = Counter(order[k % blocks[s]] for k in range(seats[s]))
        lo = 0
        for _, known, i, n in sorted(docs):
            yield i if known else None, n, sizes[s], round(targets[s], 6), sum(taken[k // block] for k in range(lo, lo + n))
            lo += n


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "r", "b", "s", "t") for r in rows], SCHEMA)


CASES = [
    (7, (5, 2, 1), 150, 2, 8, [("a", 60), ("b", 5), (None, 9), ("", 3), ("é", 20), ("Z", 1)]),
    (3, (1,), 40, 1, 5, [(f"s{i}", 1 + i % 4) for i in range(30)]),  # many small sources: rounding lacks or exceeds by several seats
    (1, (100, 1, 1, 1), 190, 2, 3, [(f"s{i}", 2) for i in range(17)]),
]


@pytest.mark.parametrize("seed,weights,percent,times,block,sources", CASES)
def test_words_taken(spark, seed, weights, percent, times, block, sources):
    r = random.Random(seed)
    rows = [(100 * k + i, " ".join("w" * r.randrange(25)) if i % 9 else r.choice([None, "", " \n"]), s) for k, (s, n) in enumerate(sources) for i in range(n)]
    rows += [(None, "one two three", "a"), (5, None, None)] + [(500_000 + i, "same same", "a") for i in range(5)]
    r.shuffle(rows)
    docs, pieces = mixing.mix(frame(spark, rows), seed, weights, percent, times, block, shards=4)
    got = docs.collect()
    want = list(expected(rows, seed, weights, percent, times, block))
    assert Counter((x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken) for x in got) == Counter(want)
    assert all(x.taken <= times * x.size for x in got)
    near = defaultdict(int)
    for (i, n, whole, target, taken), s in zip(sorted(want, key=str), sorted(rows, key=str), strict=True):
        near[whole, target] += taken
    parts = pieces.collect()
    assert sum(p.n_words for p in parts) == sum(x.taken for x in got)
    assert set(p.shard for p in parts) <= set(range(4))
    seen = Counter((p.doc_id, p.from_word) for p in parts)
    assert max(seen.values()) <= times or None in {p.doc_id for p in parts}


def test_shards_get_even_parts(spark):
    rows = [(i, "w " * 40, "ab"[i % 2]) for i in range(60)]
    _, pieces = mixing.mix(frame(spark, rows), block=8, shards=5)
    sizes = Counter()
    for p in pieces.collect():
        sizes[p.shard] += p.n_words
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 4 * 8


def test_repeated_rows_and_no_words(spark):
    rows = [(1, "a b c", "s")] * 40 + [(2, "", "s"), (3, None, None)]
    docs, _ = mixing.mix(frame(spark, rows), block=4)
    got = docs.collect()
    assert len(got) == 42 and sum(x.taken for x in got) == 45 * 4 and all(x.taken <= 6 for x in got)
    for few in ([(2, "", "s"), (3, None, None)], []):
        docs, pieces = mixing.mix(frame(spark, few))
        assert [x.taken for x in docs.collect()] == [0] * len(few) and pieces.collect() == []
