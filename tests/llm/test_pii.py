import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from postlens.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def texts():
    r = random.Random(4)
    out = [None, "", "é\U0001f600 x@y.zz 1.2.3.4", "a@b.c_x@d.e a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.1.1.0000001",
           "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "+1 (017) 555-7713, +12 3 +123456789012345678 +1.2.3.4.5.6.7.8.9",
           "%+-@a-b.c", "1" * 3000, "a" * 5000 + "@b", "0 " * 40, "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6"]
    alphabet = "0123456789 .-+@ab()é_%"
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(5, 300))) for _ in range(300)]
    return out


def test_base_spans_against_python(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, id string")
    for r in pii.find_spans(docs).collect():
        want = brute(rows[r.doc_id][1] or "")
        assert [(x.start, x.order, x.end, x.kind) for x in r.base] == want, rows[r.doc_id][1]
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}


def test_learns_to_add_alike_spans(spark):
    r = random.Random(2)
    rows = []
    for i in range(600):
        number = "".join(r.choice("0123456789") for _ in range(3)), "".join(r.choice("0123456789") for _ in range(4))
        rows.append((i, f"word call +1 ({number[0]}) 555-{number[1]} then {r.randint(1, 99999999)} other"))
    rows.append((1000, "word call 1 (123) 555-0199 then other"))
    rows.append((1001, "nothing 20240101 here"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in pii.find_spans(docs).collect()}
    assert [x.kind for x in got[1000].spans] == ["number"] and not got[1000].base
    assert not got[1001].spans
    clean = {x.doc_id: x.text for x in pii.redact(docs).collect()}
    assert clean[1000] == "word call [NUMBER] then other"
    assert clean[0].startswith("word call [PHONE] then ")


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.cc"), (1, None), (1, "a@b.cc"), (1, "a@b.cc")], "doc_id long, text string")
    rows = pii.redact(docs).collect()
    assert sorted(str(x.text) for x in rows) == ["None", "[EMAIL]", "[EMAIL]", "[EMAIL]"]
    assert pii.find_spans(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def spelled_corpus(n):
    """Secrets and spelled-out addresses beside what only looks like them."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(4, 9)))
    forms = [
        lambda: f"the api_key={''.join(r.choice('abXY') + r.choice('0123456789') for _ in range(6))} leaked",
        lambda: f"the {r.choice(['token', 'password'])}: {r.choice(['something', 'whatever', 'unlimited'])} else",
        lambda: f"write to {word()}.{word()} at {word()} dot {word()} dot {r.choice(['org', 'com'])} today",
        lambda: f"or {word()} [at] {word()}.{r.choice(['org', 'com'])}, thanks",
        lambda: f"visit {r.choice(['us', 'me', 'them'])} at {word()}.com or {r.choice(['us', 'me'])} at {word()} dot com",
    ]
    return [(100 + i, forms[i % len(forms)]()) for i in range(n)]


def test_secrets_and_spelled_out_addresses(spark):
    """The model of a corpus judges texts of another table, and of its own."""
    rows = [(1, "the api_key=9fQ2x7Lm4Zt8 leaked"), (2, "write to jane.roe at mail dot example dot org today"), (3, "or joe [at] example.com, thanks"),
            (4, "he looked at the dot product, and the password: something else"), (5, "visit us at example.com or us at example dot com")]
    kind = "doc_id long, text string"
    model = pii.learn(spark.createDataFrame(spelled_corpus(400), kind))
    for docs, given in ((rows, model), (rows + spelled_corpus(400), None)):
        got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(docs, kind), model=given).collect()}
        assert got[1] == "the [SECRET] leaked" and got[2] == "write to [ADDRESS] today" and got[3] == "or [ADDRESS], thanks"
        assert got[4] == rows[3][1] and got[5] == rows[4][1]


def test_strict_rules_alone_add_nothing(spark):
    """One secret is no corpus to learn from; without trees only base spans stand."""
    docs = spark.createDataFrame([(1, "the api_key=9fQ2x7Lm4Zt8 leaked, a@b.cc")], "doc_id long, text string")
    assert [x.kind for x in pii.find_spans(docs).first().spans] == ["email"]


def brute_forest(rows, rounds=10, depth=2, rate=0.5, l2=1.0, least=3):
    """Scores of all rows by trees of the rows for fit; rows: (x, y, for fit)."""
    raw = [0.0] * len(rows)
    for _ in range(rounds):
        g = [y - 1 / (1 + math.exp(-s)) for (_, y, _), s in zip(rows, raw)]
        h = [1 / (1 + math.exp(-s)) * (1 - 1 / (1 + math.exp(-s))) for s in raw]
        nodes = [(list(range(len(rows))), 0.0)]
        for _ in range(depth):
            after = []
            for inside, value in nodes:
                fit = [i for i in inside if rows[i][2]]
                best = None
                for f in range(len(rows[0][0])):
                    for v in sorted({rows[i][0][f] for i in fit})[:-1]:
                        sides = [[i for i in fit if rows[i][0][f] <= v], [i for i in fit if rows[i][0][f] > v]]
                        if min(map(len, sides)) < least:
                            continue
                        sums = [(sum(g[i] for i in side), sum(h[i] for i in side)) for side in sides]
                        gain = sum(a * a / (b + l2) for a, b in sums) - sum(a for a, _ in sums) ** 2 / (sum(b for _, b in sums) + l2)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, f, v, [rate * a / (b + l2) for a, b in sums])
                if best is None or best[0] <= 1e-6:
                    after.append((inside, value))
                    continue
                _, f, v, values = best
                after.append(([i for i in inside if rows[i][0][f] <= v], values[0]))
                after.append(([i for i in inside if rows[i][0][f] > v], values[1]))
            nodes = after
        for inside, value in nodes:
            for i in inside:
                raw[i] += value
    return raw


def test_trees_scores_thresholds_and_added_spans_against_python(spark):
    r = random.Random(21)
    rows = spelled_corpus(150)
    rows += [(1000 + i, f"call {r.choice(['+1', '1', '', '+'])} ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)} or {r.randint(1, 10**16)} x") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = pii.judged_rows(docs, "doc_id", "text", ["doc_id"])
    model = pii.fit(table.select(F.inline("candidates")), precision=0.9, prior=4.0)
    c = table.select("row.doc_id", F.inline("candidates"))
    c = c.withColumn("s", pii.score(model.forests, F.col("x"), F.col("fold"))).withColumn("step", pii.step(F.col("s"))).collect()
    want = [None] * len(c)
    for fold in (0, 1):
        raw = brute_forest([(x.x, x.y, x.fold != fold) for x in c])
        want = [s if x.fold == fold else w for x, s, w in zip(c, raw, want)]
    assert all(abs(x.s - w) < 1e-6 for x, w in zip(c, want)) and len({round(w, 3) for w in want}) > 10
    bounds = []
    for g in range(len(pii.GENERATORS)):
        good = None
        for least in sorted({x.step for x in c if x.step >= 0}):
            every, mine = [x for x in c if x.step >= least], [x for x in c if x.step >= least and x.x[0] == g]
            share = (sum(x.y for x in mine) + 4.0 * sum(x.y for x in every) / len(every)) / (len(mine) + 4.0)
            if share >= 0.9 and good is None:
                good = least
        bounds.append(good)
    assert model.bounds == bounds and any(b is not None for b in bounds)
    names = list(pii.GENERATORS)
    added = {(x.doc_id, x.start, x.end, names[x.x[0]]) for x in c if bounds[x.x[0]] is not None and x.step >= bounds[x.x[0]] and not x.hit}
    got = pii.find_spans(docs, precision=0.9, prior=4.0).select("doc_id", F.inline("spans")).filter(~F.col("kind").isin(*pii.KINDS)).collect()
    assert {(x.doc_id, x.start, x.end, x.kind) for x in got} == added and added
    for g, name in enumerate(names):
        mine = [x for x in c if x.x[0] == g]
        assert (model.report[name]["candidates"], model.report[name]["confirmed"]) == (len(mine), sum(x.y for x in mine))


def test_draws_the_same_share_of_each_generator(spark):
    rows = [(i, "ring 12-34-56-78 now" if i % 50 else "token=a1b2c3d4e5") for i in range(2000)]
    table = pii.judged_rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", ["doc_id"])
    got = pii.draw(table.select(F.inline("candidates")), 400).groupBy(F.col("x")[0].alias("g")).count().collect()
    assert {r.g: r["count"] for r in got} == {0: 100, 1: 100, 3: 40}


def test_learns_secrets_from_confirmed_ones(spark):
    r = random.Random(3)
    value = lambda: "".join(r.choice("abcdefXYZ") + r.choice("0123456789") for _ in range(8))
    rows = [(i, f"login with password={value()} and token: {r.choice(['something', 'whatever', 'unknownword'])} here") for i in range(500)]
    rows.append((1000, "login with password=1-abcd-2-efgh-3-4-5-6-7-8 and go"))  # no letter beside a digit
    got = {x.doc_id: [s.kind for s in x.spans] for x in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ["secret"] for i in range(500)) and "secret" in got[1000]


def test_thresholds_count_all_candidates(spark):
    r = random.Random(6)
    rows = [(i, f"word call +1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)} then {r.randint(1, 99999999)} other") for i in range(600)]
    rows.append((1000, "word call 1 (123) 555-0199 then other"))
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), sample=150).filter("doc_id = 1000").first()
    assert [x.kind for x in got.spans] == ["number"]


def test_proposes_numbers_in_ones_and_twos(spark):
    docs = spark.createDataFrame([("ring 06 12 34 56 78 now",), ("ring 12-34-56-78 now",), ("ring 01.23.45.67.89 now",)], "text string")
    got = [{c.x[0] for c in r.candidates} for r in pii.with_candidates(docs).collect()]
    assert got == [{0, 1}, {0, 1}, {0}]


def redacted(text, spans):
    out, end = [], 0
    for start, _, stop, kind in sorted(spans):
        if start >= end:
            out.append(text[end:start] + f"[{kind.upper()}]")
        end = max(end, stop)
    return "".join(out) + text[end:]


def many(n):
    r = random.Random(8)
    kinds = ["x{0}@host.org é", "\U0001f600 +1 ({0}) 555-0199 1.2.3.4", "1.2.3.4@b.cc", "4111 1111 1111 1111x", "token=a1b2c3d4e5{0} word"]
    return " ".join(r.choice(kinds).format(r.randint(100, 999)) for _ in range(n))


def test_long_texts_with_many_matches(spark):
    """More matches than a block of running sums holds, and spans over the edges of pieces."""
    rows = [(n, many(n), "kept") for n in (1, 40, 64, 65, 129, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __runs string")
    found = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find_spans(docs).collect()}
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    for n, text, _ in rows:
        assert [x for x in found[n] if x[1] < 4] == brute(text)
        assert got[n].text == redacted(text, found[n]) and got[n]["__runs"] == "kept"


def test_surroundings_of_candidates_in_long_texts(spark):
    text = many(600)
    row = pii.with_candidates(spark.createDataFrame([(text,)], "text string")).first()

    def char_class(c):
        return 0 if not c else 1 if re.match("[A-Za-z]", c) else 2 if re.match("[0-9]", c) else 3 if c.isspace() else 4

    assert len(row.candidates) > 600 and len(text) > 10 * pii.PIECE
    for c in row.candidates:
        assert (c.x[7], c.x[8]) == (char_class(text[max(c.start - 1, 0) : c.start]), char_class(text[c.end : c.end + 1]))


def test_running_and_overlaps_against_python(spark):
    r = random.Random(9)
    rows = []
    for i in range(120):
        spans = sorted((s, s + r.randint(1, 12)) for s in (r.randint(0, 900) for _ in range(r.choice([0, 1, 2, 3, 4, 63, 64, 65, 130]))))
        rows.append((i, spans, [(s, s + r.randint(1, 30)) for s in (r.randint(0, 950) for _ in range(20))]))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"id int, spans {kind}, cs {kind}")
    df = df.withColumn("reach", pii._reach(F.col("spans")))
    df = df.withColumn("got", F.transform("cs", lambda c: pii._overlaps(c, F.col("spans"), F.col("reach"))))
    for x in df.collect():
        _, spans, cs = rows[x.id]
        assert x.reach == [max(e for _, e in spans[: i + 1]) for i in range(len(spans))]
        assert x.got == [any(s < ce and cs_ < e for s, e in spans) for cs_, ce in cs]
