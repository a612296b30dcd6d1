"""Personal data by boosted candidates.

Base rules find e-mail addresses, IP addresses, card and phone numbers. Besides, generators
with high recall propose spans, overlapping ones too; boosted trees judge each by its form
and its surroundings, and spans above a threshold calibrated for their generator are added.
The trees learn which candidates are confirmed, from features that leave out most of what the
confirming rules test (the leading plus, endings, a letter beside a digit), so they add what
looks and stands alike; a number of a card's length that fails its check is told apart. Numbers are confirmed by the base rules; these cannot confirm spelled-out
addresses and secrets, for which strict rules label what is certain. Rules only label: which
candidates are added the trees decide, and each candidate is judged by trees fitted on the
other half of the strings, so that its own confirmation is hidden from them.
Only DataFrame functions are used, and texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.scratch import discard, materialize

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the contract's patterns with the same matches: a run of characters is
# tried from its first character (or where the last match ended), not from each.
LOCAL = "[A-Za-z0-9._%+-]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": "[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that a text may hold a match at all.
MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(PATTERNS["card"]),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
AT, DOT = (rf"(?: {x} | ?[(\[]{x}[)\]] ?)" for x in ("at", "dot"))
HOST = rf"[A-Za-z0-9-]{{1,63}}(?:(?:\.|{DOT})[A-Za-z0-9-]{{1,63}}){{0,4}}"
#: High-recall generators: numbers in any grouping, addresses spelled out, assigned secrets. the
#: lengths of names and labels in addresses, which mail and name servers bound; nothing else is cut.
GENERATORS = {
    "number": r"[(]?[0-9][0-9 ()./-]{5,}[0-9]",
    "long_number": "[0-9](?:[ -]?[0-9]){7,}+",
    "address": rf"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{{1,64}}(?:{AT}{HOST}(?:\.|{DOT})|@{HOST}{DOT})[A-Za-z]{{2,63}}+",
    "secret": r"(?i)(?<![A-Za-z])(?:token|secret|password|api_?key|key) ?[=:] ?[\"']?[A-Za-z0-9+/_-]{8,}+",
}
GENERATOR_MAY = {
    "number": lambda t: t.rlike("[0-9][0-9 ()./-]{5}"),
    "long_number": lambda t: t.rlike("[0-9](?:[ -]?[0-9]){7}"),
    "address": lambda t: t.rlike(rf"{AT}|@{HOST}{DOT}"),
    "secret": lambda t: t.rlike("[=:] ?[\"']?[A-Za-z0-9+/_-]{8}"),
}
#: Endings of addresses that are no English words, and words before " at " that are no names.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|uk|de|fr|nl|es|pt|pl|se|fi|dk|ch|cz|hu|ro|gr|eu|ru|ua|cn|jp|kr|br|ar|mx|ca|au|nz|za|ie|il|tr|dev|app"
NO_NAME = "us|me|him|her|them|it|one|all|out|up|now|here|online|available|visit|look|looks|looked|looking|is|are|was|were|site|page|website"
#: Strict rules that label candidates of the generators that no base rule can confirm. Plain " at " needs a spelled-out dot and
#: a known ending (else "us at host.com" counts); a secret's value has a letter beside a digit, and a mere key is long.
SURE = {
    "address": lambda m: m.rlike(rf"(?i)[(\[]at[)\]]|@| at .*{DOT}") & m.rlike(rf"(?i)(?:\.|{DOT})(?:{ENDINGS})$") & ~m.rlike(rf"(?i)^(?:{NO_NAME}) at "),
    "secret": lambda m: m.rlike(r"[=:].*(?:[A-Za-z][0-9]|[0-9][A-Za-z])") & (~m.rlike("(?i)^key") | m.rlike(r"[=:] ?[\"']?[^ \"']{16}")),
}
FEATURES = ("generator", "digits", "length", "groups", "letters", "longest", "signs", "before", "after", "cue", "spelled", "check")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: an expression named inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """The running results of combine over an array of ints of 0 or more.

    Each element added to an array copies it, so long arrays are taken in blocks: the results
    of whole blocks come first, then each block goes on from what lies before it.
    """

    def steps(part: Column, first: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda a, v: F.concat(a, F.array(combine(F.element_at(a, -1), v))))

    def in_blocks(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / block).cast("int"), F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * block + 1, F.lit(block)))
        return let(parts, lambda ps: F.flatten(F.zip_with(ps, before(ps), lambda p, first: go_on(F.coalesce(p, none), first))))

    def before(parts: Column) -> Column:
        return steps(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), combine)), F.lit(0))

    def go_on(part: Column, first: Column) -> Column:
        return F.slice(steps(part, first), F.lit(2), F.size(part))

    none = F.array().cast("array<int>")
    return let(values, in_blocks)


def matches(text: Column, pattern: str, may: Column) -> Column:
    """Array of start, end (code points), match of all matches: what lies between them gives the places."""

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        ends = running(F.zip_with(found, gaps, lambda m, g: F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0))), lambda a, b: a + b)
        spans = F.zip_with(found, ends, lambda m, e: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("match")))
        return F.filter(spans, lambda x: x["match"].isNotNull())

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(may, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


PIECE = 1024


def pieces(text: Column) -> Column:
    """The text in pieces of 1,024 code points: a substring far into a long text walks all that lies before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to before end, by way of the pieces that hold them."""
    first = F.floor(start / PIECE).cast("int")
    held = F.array_join(F.slice(parts, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
    return F.substring(held, start - first * PIECE + 1, end - start)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    values = F.transform(F.regexp_extract_all(F.reverse(_digits(x)), F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": lambda m: F.char_length(_digits(m)).between(12, 19) & luhn(m),
    "phone": lambda m: F.char_length(_digits(m)).between(9, 15),
}


def _named(spans: Column, kind: str, order: int) -> Column:
    return F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def with_base(rows: DataFrame) -> DataFrame:
    """Adds an array of the base spans for each kind, named as the kind."""
    text = F.col("text")
    found = rows.withColumns({k: matches(text, PATTERNS[k], MAY[k](text)) for k in KINDS})

    def valid(kind: str) -> Column:
        return F.filter(kind, lambda x: VALID[kind](x["match"]))

    return found.withColumns({k: _named(valid(k), k, i) for i, k in enumerate(KINDS)})


def with_candidates(rows: DataFrame) -> DataFrame:
    """Adds candidates: array of start, end, the features by which they are judged, whether a strict rule confirms them, and the fold."""
    text = F.col("text")
    rows = rows.withColumns({f"g_{g}": matches(text, p, GENERATOR_MAY[g](text)) for g, p in GENERATORS.items()})

    def char_class(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\s"), 3).otherwise(4)

    def judged(x: Column, no: int, generator: str, parts: Column) -> Column:
        return let(cut(parts, F.greatest(x["start"] - 24, F.lit(0)), x["start"]), lambda before: features(x, no, generator, before, cut(parts, x["end"], x["end"] + 1)))

    def features(x: Column, no: int, generator: str, before: Column, after: Column) -> Column:
        m, start, end = x["match"], x["start"], x["end"]
        runs = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda r: F.char_length(r))
        cap = lambda c, n: F.least(c, F.lit(n)).cast("int")
        values = (
            F.lit(no), cap(F.char_length(_digits(m)), 40), cap(F.char_length(m), 60), cap(F.size(runs), 12),
            cap(F.regexp_count(m, F.lit("[A-Za-z]")), 60), cap(F.coalesce(F.array_max(runs), F.lit(0)), 40),
            F.regexp_count(m, F.lit("[()]")).cast("int").between(1, 9).cast("int") + 2 * F.regexp_count(m, F.lit("-")).between(1, 9).cast("int")
            + 4 * F.regexp_count(m, F.lit("[.]")).between(1, 9).cast("int"),
            char_class(F.substring(before, -1, 1)), char_class(after),
            F.when(before.rlike("(?i)call|phone|tel|fax"), 1).when(before.rlike("(?i)card|visa|pay"), 2).when(before.rlike("(?i)mail|contact"), 3)
            .when(before.rlike("(?i)token|secret|key|pass"), 4).otherwise(0),
            F.when(m.rlike(r"[(\[]at[)\]]"), 2).when(m.contains(" at "), 1).otherwise(0) + 3 * m.rlike(DOT).cast("int")
            + 6 * m.rlike(f"(?i)^(?:{NO_NAME})(?: at |@)").cast("int"),
            F.when(VALID["card"](m), 2).when(F.char_length(_digits(m)).between(12, 19), 0).otherwise(1),
        )
        sure = SURE[generator](m) if generator in SURE else F.lit(False)
        fold = F.pmod(F.xxhash64(m), F.lit(2)).cast("int")  # by the string, so that no copy of a candidate is in the other fold
        return F.struct(start.alias("start"), end.alias("end"), F.array(*[v.cast("int") for v in values]).alias("x"), sure.alias("sure"), fold.alias("fold"))

    def proposed(no: int, generator: str, parts: Column) -> Column:
        return F.transform(f"g_{generator}", lambda x: judged(x, no, generator, parts))

    found = F.greatest(*[F.size(f"g_{g}") for g in GENERATORS]) > 0
    every = let(F.when(found, pieces(text)).otherwise(F.array().cast("array<string>")), lambda parts: F.concat(*[proposed(i, g, parts) for i, g in enumerate(GENERATORS)]))
    rows = rows.withColumn("candidates", every)
    return rows.drop(*[f"g_{g}" for g in GENERATORS])


class Tree:
    """A split, or a leaf if feature is None."""

    def __init__(self, value: float, feature: int | None = None, most: int = 0, low: Tree | None = None, high: Tree | None = None):
        self.value, self.feature, self.most, self.low, self.high = value, feature, most, low, high

    def column(self, x: Column, result: Callable[[Tree], Column]) -> Column:
        if self.feature is None:
            return result(self)
        return F.when(x[self.feature] <= self.most, self.low.column(x, result)).otherwise(self.high.column(x, result))


@dataclass
class Model:
    """Boosted trees for each fold, fitted on the other one, and the generators' least steps of the score.

    report tells of all candidates, each judged by trees that have not seen its string: for each
    generator how many there are, are confirmed, are chosen, and are both.
    """

    forests: list[list[Tree]]
    bounds: list[int | None]
    report: dict[str, dict[str, int]]

    def chooses(self, c: Column) -> Column:
        bound = F.get(F.array(*[F.lit(b).cast("int") for b in self.bounds]), c["x"][0])
        return F.coalesce(step(score(self.forests, c["x"], c["fold"])) >= bound, F.lit(False))


def score(forests: list[list[Tree]], x: Column, fold: Column) -> Column:
    first, second = (reduce(lambda a, t: a + t.column(x, lambda leaf: F.lit(float(leaf.value))), trees, F.lit(0.0)) for trees in forests)
    return F.when(fold == 0, first).otherwise(second)


def step(raw: Column) -> Column:
    """The score in steps of 0.1, -100 to 100."""
    return F.floor(F.greatest(F.least(raw, F.lit(10.0)), F.lit(-10.0)) * 10).cast("int")


def best_split(bins: list, l2: float, least: int) -> tuple[float, int, int, float, float] | None:
    """Gain, feature, bound and the values of both sides; bins: f, v, g, h, n sorted by f, v."""
    best = None
    for f in sorted({b.f for b in bins}):
        mine = [b for b in bins if b.f == f]
        g, h, n = (sum(getattr(b, k) for b in mine) for k in "ghn")
        a = c = m = 0.0
        for b in mine[:-1]:
            a, c, m = a + b.g, c + b.h, m + b.n
            if m >= least and n - m >= least:
                gain = a * a / (c + l2) + (g - a) ** 2 / (h - c + l2) - g * g / (h + l2)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, b.v, a / (c + l2), (g - a) / (h - c + l2))
    return best


def boost(sample: DataFrame, rounds: int = 10, depth: int = 2, rate: float = 0.5, l2: float = 1.0, least: int = 3) -> list[list[Tree]]:
    """Boosted trees for the logistic loss, for each fold from the rows of the other; sample: x (array of small integers), y, fold (0 or 1).

    Spark sums gradients by node, feature and value, for both folds in one job; the driver sees
    these sums alone, at most nodes x features x 61 rows, and picks the splits.
    """
    forests: list[list[Tree]] = [[], []]
    for _ in range(rounds):
        roots = [Tree(0.0), Tree(0.0)]
        for _ in range(depth):
            leaves: list[Tree] = []

            def number(t: Tree, leaves=leaves) -> Column:
                leaves.append(t)
                return F.lit(len(leaves) - 1)

            nodes = [r.column(F.col("x"), number) for r in roots]
            node = F.when(F.col("fold") == 1, nodes[0]).otherwise(nodes[1])
            p = 1 / (1 + F.exp(-score(forests, F.col("x"), 1 - F.col("fold"))))
            bins = sample.select(node.alias("node"), (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), F.posexplode("x").alias("f", "v"))
            bins = bins.groupBy("node", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
            bins = sorted(bins.collect(), key=lambda b: (b.node, b.f, b.v))
            for i, leaf in enumerate(leaves):
                if (s := best_split([b for b in bins if b.node == i], l2, least)) and s[0] > 1e-6:
                    leaf.feature, leaf.most, leaf.low, leaf.high = s[1], s[2], Tree(rate * s[3]), Tree(rate * s[4])
        for trees, root in zip(forests, roots):
            trees.append(root)
    return forests


def thresholds(counts: list, precision: float, prior: float) -> list[int | None]:
    """For each generator the lowest step of the score from which on its confirmed share is at least ``precision``.

    The share of few candidates is drawn towards that of all generators from the same step on,
    which counts as ``prior`` candidates more. Steps below even odds (0) don't count: what the
    trees hold unlikely is not let in by a share that others earn. None where no step reaches
    it. counts: g, s, y, n.
    """
    out: list[int | None] = [None] * len(GENERATORS)
    good, total = [0] * len(GENERATORS), [0] * len(GENERATORS)
    for s in sorted({r.s for r in counts if r.s >= 0}, reverse=True):
        for r in counts:
            if r.s == s:
                good[r.g], total[r.g] = good[r.g] + r.y, total[r.g] + r.n
        pooled = sum(good) / sum(total)
        for g in range(len(GENERATORS)):
            if good[g] + prior * pooled >= precision * (total[g] + prior):
                out[g] = s
    return out


def draw(candidates: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` candidates, the same share for each generator: those with the smallest hashes.

    The hashes are cut by the generators' counts before anything is sorted.
    """
    share = sample // len(GENERATORS)
    counts = {r.g: r.n for r in candidates.groupBy(F.col("x")[0].alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = 1 << 30
    most = F.array(*[F.lit(min(scale, 2 * share * scale // counts.get(g, 1) + 1)) for g in range(len(GENERATORS))])
    near = candidates.filter(F.pmod("o", F.lit(scale)) < F.get(most, F.col("x")[0]))
    order = Window.partitionBy(F.col("x")[0]).orderBy(F.pmod("o", F.lit(scale)), "o", "x", "y")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= share).select("x", "y", "fold")


def fit(candidates: DataFrame, sample: int = 20_000, precision: float = 0.95, prior: float = 10.0) -> Model:
    """Trees from at most ``sample`` of the candidates (o, x, y, fold), thresholds from all; chooses nothing where a fold has only one sort."""
    train = materialize(draw(candidates, sample))
    sorts = train.select("fold", "y").distinct().count()
    forests = boost(train) if sorts == 4 else [[], []]
    discard(train)
    x = F.col("x")
    counts = candidates.groupBy(x[0].alias("g"), step(score(forests, x, F.col("fold"))).alias("s")).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    counts = counts.collect()  # at most generators x 201 rows
    bounds = thresholds(counts, precision, prior) if sorts == 4 else [None] * len(GENERATORS)
    report = {}
    for g, name in enumerate(GENERATORS):
        mine = [r for r in counts if r.g == g]
        above = [r for r in mine if bounds[g] is not None and r.s >= bounds[g]]
        report[name] = {"candidates": sum(r.n for r in mine), "confirmed": sum(r.y for r in mine), "chosen": sum(r.n for r in above), "both": sum(r.y for r in above)}
    return Model(forests, bounds, report)


def _reach(spans: Column) -> Column:
    """For each of the spans, in order of start, how far it or one before it goes."""
    return running(F.transform(spans, lambda b: b["end"]), lambda a, b: F.greatest(a, b))


def _overlaps(c: Column, spans: Column, reach: Column) -> Column:
    """Whether c overlaps one of the spans, in order of start: the last that starts before c ends is found by halving."""

    def halve(a: Column, _: Column) -> Column:
        middle = F.shiftright(a["low"] + a["high"], 1)
        right = (a["low"] < a["high"]) & F.coalesce(F.get(spans, middle)["start"] < c["end"], F.lit(False))
        return F.struct(F.when(right, middle + 1).otherwise(a["low"]).alias("low"), F.when(right, a["high"]).otherwise(middle).alias("high"))

    state = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    before = F.aggregate(F.sequence(F.lit(1), F.char_length(F.bin(F.size(spans)))), state, halve, lambda a: a["low"])
    return F.coalesce(F.get(reach, before - 1) > c["start"], F.lit(False))


def judged_rows(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """A written table of row (the columns to keep), base and labelled candidates: all that texts are read for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    rows = with_base(rows)
    rows = with_candidates(rows.withColumn("base", F.array_sort(F.concat(*KINDS))).drop(*KINDS))

    def labelled(c: Column, reach: Column) -> Column:
        return let(_overlaps(c, F.col("base"), reach), lambda hit: F.struct(
            F.xxhash64("id", c["start"], c["end"]).alias("o"), *[c[k].alias(k) for k in ("start", "end", "x", "fold")],
            hit.alias("hit"), (hit | c["sure"]).cast("int").alias("y"),
        ))

    labels = let(_reach(F.col("base")), lambda reach: F.transform("candidates", lambda c: labelled(c, reach)))
    return materialize(rows.select("row", "base", labels.alias("candidates")))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """The model of a corpus, for texts of others; options: those of fit."""
    rows = judged_rows(docs, id_col, text_col, [id_col])
    model = fit(rows.select(F.inline("candidates")), **options)
    discard(rows)
    return model


def find_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, model: Model | None = None, **options
) -> DataFrame:
    """The rows of docs (or the columns of them to ``keep``) with two more: base and spans, arrays of start, order, end, kind in order.

    spans holds the base spans and the added ones (kinds: the generators' names), which
    overlap no base span and which the trees choose. Texts of any length are read whole, and
    once: what is found and kept goes to a table below spark.checkpoint.dir that the result reads.
    Without a model (see learn) one is fitted on docs; options: those of fit. With so few
    candidates that a fold has only one sort, it adds nothing. Null and empty texts have no
    spans; repeated rows get equal spans; an empty table gives no rows; columns of docs named
    like the new ones are replaced.
    """
    keep = docs.columns if keep is None else keep
    rows = judged_rows(docs, id_col, text_col, keep)
    model = fit(rows.select(F.inline("candidates")), **options) if model is None else model
    names = F.array(*[F.lit(g) for g in GENERATORS])
    added = F.transform(
        F.filter("candidates", lambda c: ~c["hit"] & model.chooses(c)),
        lambda c: F.struct(
            c["start"].alias("start"), (F.lit(len(KINDS)) + c["x"][0]).alias("order"), c["end"].alias("end"), names[c["x"][0]].alias("kind")
        ),
    )
    out = rows.select("row", "base", F.array_sort(F.concat("base", added)).alias("spans"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep if c not in ("base", "spans")], "base", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the texts' spans replaced by [KIND]; overlapping spans become one, named by the first. Null texts stay null."""
    found = find_spans(docs, id_col, text_col, **options)
    text, spans = F.col(text_col), F.col("spans")

    def runs(reach: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, n: run(F.get(spans, i), F.get(reach, F.coalesce(F.get(at, n + 1), F.size(spans)) - 1))))

    def run(first: Column, end: Column) -> Column:
        return F.struct(first["start"].alias("start"), end.alias("end"), first["kind"].alias("kind"))

    def clean(runs: Column, parts: Column) -> Column:
        end = lambda i: F.coalesce(F.get(runs, i)["end"], F.lit(0))
        shown = F.transform(runs, lambda x, i: F.concat(cut(parts, end(i - 1), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(shown, ""), cut(parts, end(F.size(runs) - 1), F.char_length(text)))

    redacted = let(let(_reach(spans), runs), lambda r: let(pieces(text), lambda parts: clean(r, parts)))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, redacted).otherwise(text)).select(*docs.columns)


def query(spark, sf_dir):
    out = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
