import hashlib
import random
import re
from collections import Counter

import pytest

from postlens.llm import repeats


def brute(texts, n=repeats.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + n] for d in data for p in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        upto = 0
        for p in range(len(d) - n + 1):
            if seen[d[p : p + n]] > 1:
                for q in range(max(p, upto), p + n):
                    gone[q] = True
                upto = p + n
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, kept))
    return out


def make(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(400)
    out = [None, "", "x" * 399, "x" * 400, "y" * 401, "ab" * 500, base, base, text(300)]
    for _ in range(25):  # near copies: edits here and there
        t = base.split(" ")
        for _ in range(r.randint(1, 6)):
            t[r.randrange(len(t))] = word()
        out.append(" ".join(t))
    for n in (395, 399, 400, 401, 420, 600, 900):  # passages of about the length
        at = r.randint(0, 400)
        out += [text(r.randint(0, 40)) + base[at : at + n] + text(r.randint(0, 40)) for _ in range(2)]
    t = text(120)
    out.append(t + text(20) + t)  # within one text
    return out


def passages(texts, n=repeats.WORDS.length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in texts]
    seen = Counter(tuple(w[p : p + n]) for w in words for p in range(len(w) - n + 1))
    return [len({q for p in range(len(w) - n + 1) if seen[tuple(w[p : p + n])] > 1 for q in range(p, p + n)}) for w in words]


@pytest.mark.parametrize("seed,most", [(1, 20_000), (2, 20_000), (3, 2)])
def test_against_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(repeats, "MOST", most)
    texts = make(seed)
    t = texts[8].split()
    for k, n in enumerate((48, 49, 50, 51)):  # short passages, of another case and spacing
        texts.append(f"other words stand {k} " + "\n ".join(t[k * 60 : k * 60 + n]).upper().replace("É", "é") + f" and {k}")
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, passages=repeats.WORDS).collect()}
    words = passages(texts)
    assert words[-4:] == [0, 0, 50, 51]
    for i, (n, removed, runs, kept) in enumerate(brute(texts)):
        assert bytes(got[i].kept) == kept, i
        assert len(got[i].spans) == 2 * runs
        assert sum(b - a for a, b in zip(got[i].passages[::2], got[i].passages[1::2], strict=True)) == words[i], i


def test_repeated_and_null_rows(spark):
    t = "".join(random.Random(5).choice("abcdef") for _ in range(500))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None), (4, t[:300])], "doc_id long, text string")
    rows = repeats.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), len(r.kept)) for r in rows) == [("1", 0), ("1", 0), ("4", 300), ("None", 0), ("None", 0)]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 1000)
    repeats.powers.cache_clear()
    r = random.Random(7)
    a = "".join(r.choice("abcdefgh") for _ in range(5000))
    texts = [a, a[700:3900] + "z" * 30, a[::-1]]
    parts = list(repeats._anchor_rows(repeats.BYTES)(iter([__import__("pandas").DataFrame({"uid": [1, 2, 3], "text": texts})])))
    assert sum(p["places"].sum() for p in parts) == sum(len(t) - repeats.LENGTH + 1 for t in texts)
    repeats.powers.cache_clear()


def test_sorting():
    r = random.Random(3)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += [b"a" * 30 + x for x in texts[:100]]

    def common(i, j):
        n = 0
        for x, y in zip(texts[i], texts[j]):
            if x != y:
                break
            n += 1
        return n

    order = repeats.sort_suffixes(texts, common)
    assert [texts[i] for i in order] == sorted(texts)
    assert hashlib.sha256(b"").hexdigest()
