"""Quality rules with host verdicts.

Rule failures are counted by document, summed by host, shrunk towards an empirical beta
prior, and the hosts' verdicts are joined back. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.scratch import materialize

SPACES = r"[ \t\n\x0B\f\r]+"
SYMBOLS = r"[#*$%&|<>]"
RULES = ("few_words", "repeats", "symbols", "same_lines", "word_length")


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host and the counts of the rules for every row; a null text has no words.

    Windows of three words are compared by a 64-bit hash within one document. Most texts
    repeat none, which a hash set tells; only the others are sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        "host",
        F.array_remove(F.split("text", SPACES), "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length("text") - F.regexp_count("text", F.lit(r"[ \t\n\x0B\f\r]"))).cast("long").alias("word_chars"),
    )
    rows = rows.select(
        "doc_id",
        "host",
        "n_symbols",
        "word_chars",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
        ).alias("h"),
    )
    kept = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    # The sorted windows, null where none repeats.
    rows = rows.select(
        *kept,
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).alias("s"),
    )

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x["h"] == y["h"], F.lit(False))

    rows = rows.select(
        *kept, F.filter("s", lambda x, j: same(x, F.get("s", j - 1)) | same(x, F.get("s", j + 1))).alias("s")
    )
    rows = rows.select(*kept, F.sort_array(F.transform("s", lambda x: x["i"])).alias("p"))
    # Each repeated window covers three words, less those that the next one covers too.
    rows = rows.select(
        *kept, F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3)))).alias("p")
    )
    covered = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failures(
    rows: DataFrame, min_words: int = 50, repeat_percent: int = 50, symbol_percent: int = 10, line_percent: int = 30
) -> DataFrame:
    """A boolean fails_<rule> for each of RULES; the first two are the base rules."""
    n = F.col("n_words")
    return rows.withColumns(
        {
            "fails_few_words": n < min_words,
            "fails_repeats": F.col("n_repeat_words") * 100 > n * repeat_percent,
            "fails_symbols": F.col("n_symbols") * 100 > n * symbol_percent,
            "fails_same_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * line_percent,
            "fails_word_length": (F.col("word_chars") > n * 20) | (F.col("word_chars") < n * 2),
        }
    )


def host_verdicts(rows: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, host_docs, host_rejected.

    For each rule, the hosts' rates give a beta prior by the method of moments: mean m and
    strength k = m(1-m)/v - 1. A host's rate becomes (failures + m k) / (documents + k);
    a host is rejected if a rule's rate is above max_rate. Without spread (v = 0, or one
    host) k is 0 and the plain rate counts.
    """
    hosts = rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"),
        *[F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES],
    )
    rate = {r: F.col(r) / F.col("host_docs") for r in RULES}
    prior = hosts.agg(
        *[F.avg(x).alias(f"m_{r}") for r, x in rate.items()], *[F.var_pop(x).alias(f"v_{r}") for r, x in rate.items()]
    )  # one row
    hosts = hosts.join(F.broadcast(prior))

    def shrunk(r: str) -> Column:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        k = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(0.0))).otherwise(F.lit(0.0))
        return (F.col(r) + m * k) / (F.col("host_docs") + k)

    rejected = F.greatest(*[shrunk(r) for r in RULES]) > max_rate
    return hosts.select("host", "host_docs", rejected.alias("host_rejected"))


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = 0.5,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row per input row: counts, rule failures, the host's verdict and ``kept``.

    A document is dropped if it fails a base rule, or if its host is rejected and it fails
    any other rule itself; clean documents of a rejected host stay. Null and empty texts
    have no words and fail; rows of a null host form a host of their own; repeated rows
    count as often as they occur; long texts are read whole; an empty table gives an empty
    result; other columns of docs are not looked at. Verdicts of at most ``broadcast_rows``
    hosts go to the documents; of more, both sides are shuffled by host, as plain tables, so
    that Spark can split the rows of a large host.
    """
    rows = materialize(failures(measures(docs, id_col, text_col, host_col)))
    rows = rows.withColumn("host", F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit("")))
    verdicts = materialize(host_verdicts(rows, max_rate))
    if verdicts.count() <= broadcast_rows:
        verdicts = F.broadcast(verdicts)
    joined = rows.join(verdicts, "host")
    base = F.col("fails_few_words") | F.col("fails_repeats")
    soft = F.col("fails_symbols") | F.col("fails_same_lines") | F.col("fails_word_length")
    return joined.withColumns(
        {"base_failed": base, "soft_failed": soft, "kept": ~base & ~(F.col("host_rejected") & soft)}
    )


def query(spark, sf_dir):
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "soft_failed", "host_docs", "host_rejected",
    )


SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM documents),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
win AS (SELECT doc_id, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM tok
        WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
cnt AS (SELECT doc_id, i, CASE WHEN w3 IS NOT NULL AND
          count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 THEN 1 ELSE 0 END AS rep FROM win),
cov AS (SELECT doc_id, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c
        FROM cnt),
reps AS (SELECT doc_id, sum(c)::BIGINT AS n_repeat_words FROM cov GROUP BY doc_id),
m AS (SELECT doc_id, coalesce('=' || source, '') AS host, len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM words LEFT JOIN reps USING (doc_id)),
f AS (SELECT *, n_words < 50 AS f1, n_repeat_words * 100 > n_words * 50 AS f2, n_symbols * 100 > n_words * 10 AS f3,
        n_dup_lines * 100 > n_lines * 30 AS f4, word_chars > n_words * 20 OR word_chars < n_words * 2 AS f5 FROM m),
h AS (SELECT host, count(*)::BIGINT AS host_docs, sum(f1::INT)::DOUBLE AS c1, sum(f2::INT)::DOUBLE AS c2,
        sum(f3::INT)::DOUBLE AS c3, sum(f4::INT)::DOUBLE AS c4, sum(f5::INT)::DOUBLE AS c5 FROM f GROUP BY host),
long AS (SELECT host, host_docs, unnest([c1, c2, c3, c4, c5]) AS c, generate_subscripts([c1, c2, c3, c4, c5], 1) AS r
         FROM h),
prior AS (SELECT r, avg(c / host_docs) AS m, var_pop(c / host_docs) AS v FROM long GROUP BY r),
k AS (SELECT r, m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) ELSE 0 END AS k FROM prior),
verdict AS (SELECT host, host_docs, max((c + m * k) / (host_docs + k)) > 0.5 AS host_rejected
            FROM long JOIN k USING (r) GROUP BY host, host_docs)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 OR f2) AS base_failed,
       NOT (f1 OR f2) AND NOT (host_rejected AND (f3 OR f4 OR f5)) AS kept, (f3 OR f4 OR f5) AS soft_failed,
       host_docs, host_rejected
FROM f JOIN verdict USING (host)
"""
