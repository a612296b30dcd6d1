"""Fill-in-middle against regular expressions over code points."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import infill

SCHEMA = "doc_id long, text string, n string, form string, output string"


def draws(doc_id, seed=7):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def expected(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines, h = re.findall(r"[^\n]*\n|[^\n]+", text), draws(doc_id)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_rows():
    r = random.Random(3)
    signs = ["a", "\n", "<", "P", "S", "M", ">", "é", "中", "😀", "\r\n", " ", "\x00"]
    texts = [None, "", "\n", "\n\n", "a", "a\n", "<P>", "x<S", "<<M>", "<P<S", "<P\n>", "é" * 700 + "\n" + "中" * 300, "x" * 255 + "<S>y", "y" * 254 + "\n" + "z" * 257]
    texts += ["".join(r.choices(signs, weights=[9, 4, 1, 1, 1, 1, 1, 4, 4, 4, 1, 1, 1], k=r.randrange(1, 900))) for _ in range(120)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "\n\n"), (3, "\n\n"), (None, "a\nb\nc"), (-5, "a\nb\nc")]


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0)])
def test_forms_and_cuts(spark, rate, spm):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, "n", "f", "o") for i, t in rows], SCHEMA)
    out = infill.fill_in_middle(df, rate=rate, spm=spm)
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got])) == sorted(
        map(str, [(i, *expected(i, t, rate, spm)) for i, t in rows])
    )
    assert sorted(map(str, [(r.doc_id, r.back) for r in got])) == sorted(map(str, [(i, t or "") for i, t in rows]))
    assert {r.form for r in got} == ({"plain", "psm", "spm"} if spm else {"plain", "psm"})


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(8, "é<\n" * 400_000, "", "", "")], SCHEMA)
    r = infill.fill_in_middle(df).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(8, "é<\n" * 400_000)
    assert infill.fill_in_middle(df.limit(0)).collect() == []


def test_three_bytes_decide_the_state():
    for kinds in itertools.product(range(infill.KINDS), repeat=infill.BACK):
        ends = set()
        for state in range(7):
            for k in kinds:
                state = infill.TO[state * infill.KINDS + k]
            ends.add(int(state))
        assert len(ends) == 1


@pytest.mark.parametrize("lane", [3, 4, 7, 64])
def test_lanes_of_any_length(lane):
    texts = [t or "" for _, t in odd_rows()]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    made = infill.Texts(np.frombuffer(b"".join(raw), np.uint8), bounds, lane)
    lines = [re.findall(r"[^\n]*\n|[^\n]+", t) for t in texts]
    assert made.n.tolist() == [len(x) for x in lines]
    assert made.marked.tolist() == [bool(re.search("<[PSM]>", t)) for t in texts]
    where = [(i, k) for i, x in enumerate(lines) for k in range(len(x) + 1)]
    at, points = made.cut(*map(np.array, zip(*where, strict=True)))
    for (i, k), a, p in zip(where, at, points, strict=True):
        head = "".join(lines[i][:k])
        assert (a - bounds[i], p) == (len(head.encode()), len(head))


def test_bytes_that_are_no_text():
    """Stray continuation bytes count as code points, and nothing is lost."""
    raw = b"\x80\x80\n\xe4\xb8\n<P\xff>\n"
    made = infill.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 3)
    assert made.n.tolist() == [3] and made.marked.tolist() == [False]
    assert [x.tolist() for x in made.cut(np.array([0, 0]), np.array([1, 3]))] == [[3, len(raw)], [3, 10]]
