import hashlib
import time

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm import sentencepiece as sp

MODEL = sp.load_model(sp.model_path())
TABLE = sp.Table(MODEL)
LIB = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def same(text):
    ids = LIB.encode(text or "", add_bos=True, add_eos=True)
    got = np.frombuffer(TABLE.encode(text), "<u4").tolist()
    assert got == ids, repr(text)
    assert TABLE.decode(TABLE.encode(text)) == LIB.decode(ids)


def test_known_texts():
    for t in (None, "", " ", "  ", "  a  b ", "a\tb\n c", "▁x▁", "ﬁ \xe9 é", "x\x00y", "日本龘", "a" * 999,
              "<s>x</s>", "\n\n", " \n ", "x\n", "\U0001f600\U0001f600 z", "0123456789 " * 30, "The " + "ab" * 400):
        same(t)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdehilnorst  \n▁.,!'0129"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts(text):
    same(text)


def test_query_rows(spark):
    rows = [(1, "Hello  there", "x"), (1, "Hello  there", "x"), (None, None, "y"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, sp.digests(docs, MODEL).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = LIB.encode(t or "", add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIB.decode(ids).encode())))
    assert got == sorted(want, key=str)
    assert sp.digests(docs.limit(0), MODEL).count() == 0


def test_many_texts_side_by_side():
    """Neighbours don't touch each other: marks and line ends at both ends, bytes, long words, and texts cut into slices."""
    texts = [None, "a ", " b", "", "\n", "x\n", "\ny", "  ", "日本龘 é", "龘龘", "Grüße, мир", "ab" * 300 + " tail", " " * 100, "\ue000", "end"]
    got = [np.frombuffer(x, "<u4").tolist() for x in TABLE.encode_all(texts)]
    assert got == [LIB.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    small, sp.SLICE = sp.SLICE, 7
    try:
        for t in texts:
            same(t)
        same("one two  three\nfour\n\n five▁six " * 5)
    finally:
        sp.SLICE = small


def test_pairs_are_asked_again_after_the_table_was_emptied():
    asked = []
    pairs = sp.Pairs(lambda a, b: asked.append((a, b)) or a < b, 1_000)
    small, sp.MOST_PAIRS = sp.MOST_PAIRS, 5
    try:
        a, b = np.arange(20) % 7, np.arange(20) % 5
        for _ in range(3):
            assert pairs(a, b).tolist() == (a < b).tolist()
    finally:
        sp.MOST_PAIRS = small
    assert len(asked) > 20 and (pairs.table >= 0).sum() <= 5


def test_words_that_never_recur_are_cheap():
    """Distinct words side by side take less than half the time that they take one by one."""
    rng = np.random.default_rng(5)
    parts = ["th", "on", "er", "nd", "ent", "in", "ed", "ou", "an", "re", "ing", "sh", "tion", "ly", "and", "or"]
    words = ["".join(parts[k] for k in row) for row in rng.integers(0, len(parts), (200_000, 6))]
    texts = [" ".join(words[i : i + 400]) for i in range(0, len(words), 400)]
    TABLE.encode_all(texts[:50])
    began = time.process_time()
    got = TABLE.encode_all(texts)
    took = time.process_time() - began
    assert [np.frombuffer(x, "<u4").tolist() for x in got[:20]] == [LIB.encode(t, add_bos=True, add_eos=True) for t in texts[:20]]
    began = time.process_time()
    for w in words[:20_000]:
        TABLE.tokens(sp.MARK + w)
    assert took < 10 * (time.process_time() - began) / 2
