"""The corpus pipeline: STAGES in order, each from documents to documents, the last to token digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import decontaminate, jaccard, pii, sentencepiece, toxicity
from postlens.llm.scratch import discard, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with a toxicity score of 0.5 or more go.

    Null and empty texts have the model's bias as score and stay; repeated rows go alike.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of linked documents the one with the smallest doc_id stays.

    Null and wordless texts stay; of rows alike in id and text one stays.
    """
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents in which a window of a benchmark item occurs go.

    Null and empty texts stay; repeated rows go alike.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: spans of personal data are replaced by their kind; n_chars follows the text.

    No row goes; null texts stay null, with a null n_chars.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the token ids of each text and the text decoded from them, as digests.

    One row for each document; null texts are empty. Every stage takes texts of any length
    whole and gives an empty table for one.
    """
    return sentencepiece.digests(docs, sentencepiece.load_model(sentencepiece.model_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("sentencepiece", tokenize),
]

#: The toxicity model and Viterbi search can't be put in SQL; tests/llm compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)  # a stage's table is read by the next one alone
    return STAGES[-1][1](spark, docs, sf_dir)
