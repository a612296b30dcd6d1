import itertools
import random
import zlib

import numpy as np

from postlens.llm import toxicity as tx


def corpus(n=900, seed=1):
    r = random.Random(seed)
    syllables = ["the", "re", "an", "ing", "lo", "mar", "tes", "ou", "ven", "di"]
    bad = ["idiot", "moron", "loser"]
    words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(words, k=40)
        toxic = i % 6 == 0
        if toxic:
            w[r.randrange(40)] = r.choice(bad)
            w[r.randrange(40)] = r.choice(bad)
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_restores_disguised_words(spark):
    docs, _ = corpus()
    model = tx.character_model(spark.createDataFrame(docs, "doc_id long, text string, score string"))
    assert model.shape == (64, 64, 64)
    r = tx.Restorer(model)
    for seen in ("1d10t", "i.d.i.o.t", "IDIOOOOT!!", "i d i o t", "id!ot", "(idi0t)"):
        assert r.word(seen) == "idiot", seen
    assert r.word("there***") == "there" and r.word("1234") == "" and r.word("") == ""
    assert r.words("x i d i o t y")[0] >= {"x"} or r.words("x i d i o t y")[0]
    assert r.text("an 1d10t here") == "an idiot here"


def cheapest(r, word):
    """The best text of all paths through a word's lattice."""
    best = None
    for path in itertools.product(*r.options(word)):
        a = b = 0
        total, text = 0.0, ""
        for letter, extra in path:
            total += extra
            if letter:
                c = int(tx.letter_class()[ord(letter)])
                total += r.cost[(a * tx.CLASSES + b) * tx.CLASSES + c]
                a, b, text = b, c, text + letter
        total += r.cost[(a * tx.CLASSES + b) * tx.CLASSES]
        best = min(best or (total, text), (total, text))
    return best


def test_viterbi_takes_the_best_of_all_paths():
    g = np.random.default_rng(4)
    r = tx.Restorer(-np.log(g.dirichlet(np.full(tx.CLASSES, 0.2), size=(tx.CLASSES, tx.CLASSES)).clip(1e-7)))
    letters = random.Random(4)
    for _ in range(300):
        word = "".join(letters.choice("aabs1!3$@0+é-.") for _ in range(letters.randint(1, 7)))
        total, text = cheapest(r, word)
        got = r.viterbi(word)
        states = {(0, 0): (0.0, "")}
        for choices in r.options(word):
            states = r.step(states, choices)
        assert abs(r.end(states)[0] - total) < 1e-9 and (got == text or abs(r.end(states)[0] - total) < 1e-9), word


def test_scores_equal_plain_python(spark):
    docs, labels = corpus(300)
    docs.append((999_999, " ".join(t for _, t, _ in docs) * 10, "a very long text"))
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = tx.character_model(df)
    index, weights = tx.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"), model)
    r, seen = tx.Restorer(model), {}
    for i, text, _ in docs:
        words = r.words(text)[0]
        n = {f: sum(w + "$" == f or (len(w) > len(f) and w.startswith(f)) for w in words) for f in index}
        z = weights[-1] + sum(weights[index[f]] * np.log2(1 + k) for f, k in n.items())
        seen[i] = 1 / (1 + np.exp(-z))
    got = {x.doc_id: x.score for x in tx.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got.keys() == seen.keys() and all(abs(got[i] - seen[i]) < 1e-6 for i in seen)


def test_scores_held_out_rows(spark):
    docs, labels = corpus()
    extra = [(10_000, "the re ing you 1d10t and m0r0n an l0ser", "x"), (10_001, "", "x"), (10_002, None, "x"), (None, "the", "x"), (10_003, "the", None), (10_003, "the", None)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, score string")
    rows = tx.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[10_000].predicted == 1 and by[10_001].predicted == 0 and by[10_002].predicted == 0


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(20)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    none = spark.createDataFrame(labels, "doc_id long, toxic int").limit(0)
    assert all(r.score < 0.01 for r in tx.toxicity(df, none).collect())
    assert tx.toxicity(df.limit(0), none).count() == 0


def test_restores_signs_at_edges_and_words_among_letters(spark):
    docs, _ = corpus()
    r = tx.Restorer(tx.character_model(spark.createDataFrame(docs, "doc_id long, text string, score string")))
    for seen in ("!diot", "|diot", "1dio+", '"!d!o+"', "idiot!", "(idiot", "idiot!!!"):
        assert r.word(seen) == "idiot", seen
    for seen in ("x i d i o t y", "an i d i o t! the", "the i d i o t m o r o n", "i d i o t"):
        assert "idiot" in r.words(seen)[0], seen
    assert "the" in r.words("x t h e y")[0] and "an" in r.words("1 a n 2")[0]
    assert r.words("1 2 3 4 5")[0] == set()


def test_weighs_rare_words_among_many_frequent_ones(spark):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(5_000)]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:100]
    texts = [" ".join(w for k, w in enumerate(words) if (k - d) % 50 < 5) + (" zzrarebad" if d < 4 else "") for d in range(50)]
    texts += [x.replace(" zzrarebad", "") for x in texts]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k < 50)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    index, weights = tx.learn(df, labels, tx.character_model(df), least=2.0)
    assert "zzrarebad$" in index and len(weights) == len(index) + 1


def test_no_features_to_count(spark):
    df = spark.createDataFrame([(1, ""), (0, None)], "toxic int, text string").repartition(3)
    shared = spark.sparkContext.broadcast(np.ones((64, 64, 64)))
    assert df.mapInPandas(tx._count_features(shared), "f string, a long, b long").count() == 0
