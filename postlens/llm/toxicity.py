"""Toxicity by noisy-channel restoration.

Words that look written around a filter (digits and signs for letters, letters spaced or
dotted apart, letters repeated) are restored: a lattice holds what each character may stand
for, and a Viterbi search takes the path that a character model of the corpus and the costs
of the changes like best. The restored words are then scored by a logistic model on words
and word beginnings, chosen and fitted on labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.scratch import give_back, small_batches

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Costs in nats: a letter written as a sign; a sign that could be a letter, another sign or a second letter that is dropped;
#: a sign at a word's edge that could be a letter, as it may be plain punctuation.
AS_SIGN, DROP_LIKE, DROP_SIGN, DROP_SECOND, DROP_EDGE = 1.0, 7.0, 0.7, 2.5, 5.0
#: Words of letters apart are taken from all paths so much dearer than the best; longer words are not tried beyond BEAM,
#: nor words of more than MOST_SIGNS characters (a run is read as one word too, however long).
NEAR, BEAM, MOST_SIGNS = 6.0, 25.0, 40
CLASSES = 64
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NO_LEET = "(?:[^\\w" + re.escape("".join(c for c in LEET if not c.isalnum())) + "]|_)+"
NO_LEET_EDGE = re.compile(f"^{_NO_LEET}|{_NO_LEET}$")
THRICE = re.compile(r"(.)\1\1")
#: Common punctuation that stands for no letter: words with nothing else around them need no search.
PLAIN_EDGE = ".,;:?\"'-"
SHORTEST, LONGEST, MOST_CACHED, MOST_COUNTED = 3, 8, 60_000, 200_000


@cache
def letter_class() -> np.ndarray:
    """Class of each character: 0 for what is no letter, 1 to 26 for a to z, 27 to 63 for the others."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
    return out


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return letter_class()[np.where(codes < 0x10000, codes, 0)]


def _count_letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of three classes in a row, one row each for a task."""
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for text in batch["text"]:
            if text:
                c = np.concatenate([[0, 0], classes(text), [0]]).astype(np.int64)
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    k = np.flatnonzero(total)
    yield pd.DataFrame({"k": k, "n": total[k]})


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """-log P(c | a, b) over letter classes, from all texts; CLASSES^3 numbers whatever the corpus."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(_count_letters, "k long, n long")
    three = np.zeros(CLASSES**3)
    for r in rows.groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most CLASSES^3 rows
        three[r.k] = r.n
    three = three.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(0), three.sum((0, 1))
    share = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1)
    p = 0.7 * share(three) + 0.2 * share(two)[None] + 0.08 * share(one)[None, None] + 0.02 / CLASSES
    return -np.log(p)


class Restorer:
    """Restores words; costs: a flat list of the character model."""

    def __init__(self, model: np.ndarray):
        self.cost = model.ravel().tolist()
        self.known: dict[str, tuple[str, ...]] = {}

    def options(self, word: str) -> list[list[tuple[str, float]]]:
        out, run = [], 0
        inner = [i for i, ch in enumerate(word) if ch.isalnum()] or [0]
        for i, ch in enumerate(word):
            run = run + 1 if i and word[i - 1] == ch else 1
            if not ch.isalpha():
                like = LEET.get(ch, "")
                drop = DROP_SIGN if not like else DROP_LIKE if inner[0] <= i <= inner[-1] else DROP_EDGE
                out.append([(x, AS_SIGN) for x in like] + [("", drop)])
            elif run == 1:
                out.append([(ch, 0.0)])
            elif run == 2:
                out.append([(ch, 0.0), ("", DROP_SECOND)])
            else:
                out.append([("", 0.0)])
        return out

    def step(self, states: dict, choices: list[tuple[str, float]]) -> dict:
        """The cheapest text for each pair of last classes, one character further."""
        of, cost = letter_class(), self.cost
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (total, text) in states.items():
            for letter, extra in choices:
                if letter:
                    c = int(of[ord(letter)]) if ord(letter) < 0x10000 else 0
                    key, now = (b, c), (total + extra + cost[(a * CLASSES + b) * CLASSES + c], text + letter)
                else:
                    key, now = (a, b), (total + extra, text)
                if key not in after or now < after[key]:
                    after[key] = now
        return after

    def end(self, states: dict) -> tuple[float, str]:
        return min((total + self.cost[(a * CLASSES + b) * CLASSES], text) for (a, b), (total, text) in states.items())

    def viterbi(self, word: str) -> str:
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for choices in self.options(word):
            states = self.step(states, choices)
        return self.end(states)[1]

    def spaced(self, run: list[str]) -> tuple[list[str], set[str]]:
        """The words of the best path through characters that stand apart, and all joined words of paths near the best."""
        if not any(c.isalpha() for c in run):
            return list(run), set()
        options, n = self.options("".join(c.lower()[:1] for c in run)), len(run)
        least, parts = [0.0] + [math.inf] * n, []
        for i in range(n):
            states = {(0, 0): (0.0, "")}
            for j in range(i, min(n, i + MOST_SIGNS)):
                states = self.step(states, options[j])
                total, text = self.end(states)
                gaps = DROP_SIGN * (j - i)
                parts.append((i, j + 1, total + gaps, text))
                least[j + 1] = min(least[j + 1], least[i] + total + gaps)
                if least[i] + gaps + min(states.values())[0] > least[j + 1] + BEAM:
                    break
        rest, follow = [math.inf] * n + [0.0], [(n, "")] * n
        for i, j, total, text in reversed(parts):
            if total + rest[j] < rest[i]:
                rest[i], follow[i] = total + rest[j], (j, text)
        best, at = [], 0
        while at < n:
            at, text = follow[at]
            best.append(text)
        near = {text for i, j, total, text in parts if j - i > 1 and least[i] + total + rest[j] <= rest[0] + NEAR}
        return [x for x in best if x], near

    def readings(self, token: str) -> tuple[str, ...]:
        """The restored word of a token, and the one without the signs at its edges if that differs; '' for no letters."""
        got = self.known.get(token)
        if got is None:
            low = token.lower()
            plain = EDGE.sub("", low)
            signed = NO_LEET_EDGE.sub("", low)
            if plain.isalpha():
                got = (self.viterbi(plain) if THRICE.search(plain) else plain,)
            else:
                got = (self.viterbi(plain) if any(c.isalpha() for c in plain) else "",)
            if signed != plain and got[0]:
                whole = self.viterbi(signed)
                got = got if whole == got[0] else (whole, *got)
            if len(token) <= 64:
                if len(self.known) >= MOST_CACHED:
                    self.known.clear()
                self.known[token] = got
        return got

    def word(self, token: str) -> str:
        """The restored word of a token, without what stands around it; '' for what holds no letters."""
        return self.readings(token)[0]

    def words(self, text: str | None) -> tuple[set[str], int]:
        """The distinct restored words of a text, and how many distinct tokens, in lower case, were changed.

        Three or more single characters in a row are read as words too, at any of their
        boundaries, and four or more as one word; a sign may stand by the first and the last.
        """
        low = text.lower() if text else ""
        tokens = low.split()
        single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
        code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        thrice = bool(((code[2:] == code[1:-1]) & (code[1:-1] == code[:-2]) & (code[2:] > 64)).any())
        found, changed = set(), 0
        for t in set(tokens):
            core = t.strip(PLAIN_EDGE)
            if core.isalpha() and not (thrice and THRICE.search(core)):
                found.add(core)
                continue
            got = self.readings(t)
            found.update(got)
            changed += got[0] not in t
        if single.sum() >= 2:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= 2:
                    before, after = ([c for t in tokens[k : k + 1] for c in t if c.isalnum()] for k in (a - 1 if a else len(tokens), b))
                    run = (before if len(before) == 1 else []) + tokens[a:b] + (after if len(after) == 1 else [])
                    if len(run) >= 3:
                        found |= self.spaced(run)[1]
                        changed += 1
                if b - a >= 4:
                    found.add(self.word(" ".join(tokens[a:b])))
        found.discard("")
        return found, changed

    def text(self, text: str | None) -> str:
        """The text with every changed word put in its restored form."""
        out, run = [], []
        for t in [*(text.split() if text else []), None]:
            if t is not None and len(t) == 1:
                run.append(t)
                continue
            out += self.spaced(run)[0] if len(run) >= 3 else run
            run = []
            if t is not None:
                core = EDGE.sub("", t.lower())
                out.append(t if not core or self.word(t) == core else self.word(t))
        return " ".join(out)


def features(words: set[str]) -> set[str]:
    """Words, marked by a closing $, and word beginnings."""
    out = {w + "$" for w in words}
    for k in range(SHORTEST, LONGEST + 1):
        words = [w for w in words if len(w) > k]
        out.update([w[:k] for w in words])
    return out


class Index(dict):
    """Features by number; counts tells how many distinct words of a set have each."""

    def __init__(self, names):
        super().__init__((f, i) for i, f in enumerate(names))
        self.heads = {f.removesuffix("$")[:SHORTEST] for f in self}

    def counts(self, words: set[str]) -> Counter[int]:
        out: Counter[int] = Counter()
        heads, get = self.heads, self.get
        for w in words:
            if w[:SHORTEST] in heads:
                for f in (w + "$", *(w[:k] for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))):
                    if (i := get(f)) is not None:
                        out[i] += 1
        return out


def _count_features(shared):
    """Toxic (a) and clean (b) rows by feature, summed within a task as far as memory allows."""

    def table(toxic: Counter[str], clean: Counter[str]) -> pd.DataFrame:
        names = [*toxic, *(f for f in clean if f not in toxic)]
        both = [np.fromiter((c[f] for f in names), np.int64, len(names)) for c in (toxic, clean)]
        return pd.DataFrame({"f": pd.Series(names, dtype=object), "a": both[0], "b": both[1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore, toxic, clean = Restorer(shared.value), Counter(), Counter()
        for batch in batches:
            for kind, text in zip(batch["toxic"], batch["text"], strict=True):
                (toxic if kind else clean).update(features(restore.words(text)[0]))
                if len(toxic) + len(clean) > MOST_COUNTED:
                    yield table(toxic, clean)
                    toxic.clear()
                    clean.clear()
        yield table(toxic, clean)
        del restore, toxic, clean
        give_back()

    return run


def _vectors(shared, index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(shared.value)
        for batch in batches:
            found = [sorted(index.counts(restore.words(text)[0]).items()) for text in batch["text"]]
            yield batch.drop(columns="text").assign(at=[[i for i, _ in x] for x in found], counts=[[n for _, n in x] for x in found])

    return run


def association(a: Column, b: Column, n: int, m: int) -> Column:
    """Log-likelihood ratio of a of n toxic and b of m clean rows; 0 unless likelier in toxic rows."""
    part = lambda k, n, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log(1 - p)).otherwise(0.0)
    ratio = part(a, n, a / n) + part(b, m, b / m) - part(a, n, (a + b) / (n + m)) - part(b, m, (a + b) / (n + m))
    return F.when(a * float(m) <= b * float(n), 0.0).otherwise(ratio)


def fit(rows: list, n_features: int, l2: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Weights, and the bias last, of a logistic model on log2(1 + count)."""
    r = np.repeat(np.arange(len(rows)), [len(x.at) for x in rows])
    c = np.array([i for x in rows for i in x.at], np.int64)
    v = np.log2(1 + np.array([i for x in rows for i in x.counts], float))
    y = np.array([x.toxic for x in rows], float)
    w, size = np.zeros(n_features + 1), np.full(n_features + 1, 1e-8)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(np.bincount(r, w[c] * v, len(rows)) + w[-1]))) - y
        g = np.append(np.bincount(c, e[r] * v, n_features) + l2 * w[:-1], e.sum())
        size += g * g
        w -= 0.5 * g / np.sqrt(size)
    return w


def in_fold(id_col: str = "doc_id"):
    """True for rows that are never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(
    docs: DataFrame,
    labels: DataFrame,
    model: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most: int = 3_000,
    least: float = 8.0,
    sample: int = 20_000,
    broadcast_labels: int = 2_000_000,
) -> tuple[Index, np.ndarray]:
    """The features and weights of the scorer.

    Words and beginnings are counted over all labelled rows outside the fold; Spark weighs
    all that four toxic rows have, those ``most`` with the highest association, of ``least``
    or more, are kept, and the weights are fitted on at most ``sample``
    rows, those with the smallest hash of the id. Ids with several labels count as toxic if
    one says so. Without rows of both kinds there are no features and the bias tells the share.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    y = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    if labels.count() <= broadcast_labels:  # else the texts are shuffled by id
        y = F.broadcast(y)
    rows = docs.filter(~in_fold(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(y, "id")
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, m = size.get(1, 0), size.get(0, 0)
    index = Index(())
    if n and m:
        counts = rows.filter("toxic IN (0, 1)").select("toxic", "text").mapInPandas(_count_features(shared), "f string, a long, b long")
        counts = counts.groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a >= 4")
        weighed = counts.select("f", association(F.col("a"), F.col("b"), n, m).alias("score")).filter(F.col("score") >= least)
        best = [r.f for r in weighed.orderBy(F.desc("score"), "f").limit(most).collect()]
        index = Index(best)
    order = rows.select("toxic", "text", F.xxhash64("id").alias("o"))
    if n + m > 2 * sample:  # no need to look at many more rows than are fitted
        order = order.filter(F.pmod("o", F.lit(1_000_000)) < int(1.5e6 * sample / (n + m)) + 1)
    made = order.mapInPandas(_vectors(shared, index), "toxic int, o long, at array<int>, counts array<int>")
    picked = made.orderBy("o", "toxic").limit(sample).collect()
    return index, fit(picked, len(index)) if picked else np.array([-20.0])


def _score(shared, learnt):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(shared.value)
        index, weights = learnt.value
        weights, bias = weights[:-1].tolist(), float(weights[-1])
        for batch in batches:
            scores, changes = [], []
            for text in batch["text"]:
                words, changed = restore.words(text)
                z = bias + sum(weights[i] * math.log2(1 + n) for i, n in sorted(index.counts(words).items()))
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
                changes.append(changed)
            yield batch.drop(columns="text").assign(score=scores, n_restored=changes)
        del restore
        give_back()

    return run


def restore_texts(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, restored: texts with disguised words in plain form and words one space apart; null texts are empty."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "restored": [restore.text(t) for t in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id string, restored string").withColumn("doc_id", F.col("doc_id").cast(kind))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_restored.

    Null, empty and wordless texts have no features and get the model's bias; texts of any
    length are restored whole; repeated rows
    get equal scores; a null id is held out; an empty table gives no rows; without labels
    all scores are near 0. Other columns are not looked at.
    """
    model = character_model(docs, text_col)
    index, weights = learn(docs, labels, model, id_col, text_col, **options)
    sc, kind = docs.sparkSession.sparkContext, docs.schema[id_col].dataType.simpleString()
    # Ids go through pandas as text, which keeps nulls and large numbers as they are.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(_score(sc.broadcast(model), sc.broadcast((index, weights))), "doc_id string, score double, n_restored int")
    return out.select(
        F.col("doc_id").cast(kind).alias("doc_id"), in_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_restored"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is under 0.5; nothing is shuffled for it.

    Null, empty and wordless texts get the model's bias as their score; repeated rows stay or
    go alike; without labels all rows stay; an empty table gives no rows.
    """
    sc, model = docs.sparkSession.sparkContext, character_model(docs, text_col)
    scorer = _score(sc.broadcast(model), sc.broadcast(learn(docs, labels, model, id_col, text_col, **options)))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def texts() -> Iterator[pd.DataFrame]:
            for batch in batches:
                kept.append(batch)
                yield pd.DataFrame({"text": batch.column(at).to_pylist()})

        for scored in scorer(texts()):
            yield kept.pop().filter(pa.array(scored["score"].to_numpy() < 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
