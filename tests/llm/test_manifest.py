"""Merkle trees against lists of digests."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postlens.llm import manifest, ranks

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place string, node int, n string, item string, level int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields):
    return digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, k):
    out = []
    for nodes in tree[:-1]:
        other = nodes[k ^ 1] if k ^ 1 < len(nodes) else ""
        out.append(("", other) if k % 2 == 0 else (other, ""))
        k //= 2
    return out


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(((r[0] is not None, r[0] or 0), leaf(r)))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([d for _, d in sorted(by[x])]) for x in names}
    top = levels([trees[x][-1][0] for x in names])
    for k, x in enumerate(names):
        for i, ((known, doc_id), d) in enumerate(sorted(by[x])):
            yield doc_id if known else None, d, trees[x][-1][0], top[-1][0], tuple(path(trees[x], i) + path(top, k))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "p", 1, "n", "i", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("steps,sizes", [(1, (5,)), (2, (1, 2, 4, 5, 16, 17, 70)), (8, (40, 3))])
def test_trees_and_proofs(spark, monkeypatch, steps, sizes):
    monkeypatch.setattr(manifest, "STEPS", steps)
    monkeypatch.setattr(manifest, "RUN", 1 << steps)
    r, ids = random.Random(steps), itertools.count()
    langs = [None, "", "é", "z", "en", "EN", "\U0001f600"]
    rows = [(next(ids), "s", lang, 3, r.choice(["", "ü", None])) for lang, n in zip(langs, sizes, strict=False) for _ in range(n)]
    rows += [(7, None, "en", None, "same"), (7, None, "en", None, "same"), (7, "-", "en", None, "other"), (None, "s", "en", 1, None), (None, "s", None, 1, "x" * 100_000)]
    r.shuffle(rows)
    got = manifest.manifest(frame(spark, rows), keep={"claimed": F.upper("text")}).withColumn("folded", manifest.folded(F.col("leaf"), F.col("path"))).collect()
    assert Counter((x.doc_id, x.leaf, x.subroot, x.root, tuple(tuple(s) for s in x.path)) for x in got) == Counter(expected(rows))
    assert all(x.folded == x.root for x in got)
    assert Counter(x.claimed for x in got) == Counter(t[4].upper() if t[4] is not None else None for t in rows)


def test_one_row_and_none(spark):
    got = manifest.manifest(frame(spark, [(1, None, None, None, None)])).collect()
    assert [(x.leaf, x.subroot, x.root, x.path) for x in got] == [(digest("1:1----"),) * 3 + ([],)]
    assert manifest.manifest(frame(spark, []).limit(0)).collect() == []


def test_a_changed_row_is_found(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(30)]
    changed = F.when(F.col("doc_id") == 11, manifest.leaf("doc_id", "source", "lang", F.lit(0), "text"))
    out = manifest.manifest(frame(spark, rows), keep={"claimed": changed})
    out = out.withColumn("ok", manifest.folded(F.coalesce("claimed", "leaf"), F.col("path")) == F.col("root")).collect()
    assert {x.doc_id for x in out if not x.ok} == {11}


def test_places_and_sums_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(1)
    rows = [(r.choice("aaab"), r.randrange(9), r.randrange(5)) for _ in range(300)] + [("a", 4, 2)] * 200
    runs = ranks.sorted_runs(spark.createDataFrame(rows, "g string, k long, v long").repartition(7), "g", "k")
    got = ranks.placed(runs, ranks.parts(runs, "g", "v"), "g", "v").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 500 and len({x[ranks.PART] for x in got}) > 1
    for g in "ab":
        mine = sorted((x for x in got if x.g == g), key=lambda x: x.place)
        assert [x.place for x in mine] == list(range(len(mine)))
        assert [x.k for x in mine] == sorted(x.k for x in mine)
        assert [x.before_v for x in mine] == [0, *itertools.accumulate(x.v for x in mine)][:-1]
        assert {x.all_v for x in mine} == {sum(x.v for x in mine)}
