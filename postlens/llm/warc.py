"""WARC archives with revisit records.

Payload digests are grouped, the record with the smallest id of equal payloads is written
in full and the others as revisits that refer to it; reading joins revisits back to their
responses. Each record is a gzip member of its own, so a reader can start at any. Archives are
written and committed by Spark's own text writer, which keeps the bytes as they are, and
rolled by bytes. Reading splits them at the members, whatever the size of a file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.scratch import materialize, shared_folder, small_batches

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string, declared_digest string"


def _lines(*lines: Column | str) -> Column:
    return F.concat(*[x for line in lines for x in (F.lit(line) if isinstance(line, str) else line, F.lit(END))])


#: The head of every gzip member here; no compressed data holds these ten bytes but by a chance of 2^-80 a place.
MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    return MEMBER + squeeze.compress(data) + squeeze.flush() + struct.pack("<II", zlib.crc32(data), len(data) % (1 << 32))


def _members(file_bytes: int):
    """Records as gzip members without their last byte, a zero; and which file of the task each goes to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, size = 0, 0
        for batch in batches:
            members, rolls = [], []
            for record in batch["record"]:
                m = member(record.encode("utf-8", "surrogatepass"))
                m = m if m[-1] == 0 else m + member(b"")  # a record of 16 MiB or more
                if size and size + len(m) > file_bytes:
                    roll, size = roll + 1, 0
                size += len(m)
                members.append(m[:-1])
                rolls.append(roll)
            yield pd.DataFrame({"value": members, "roll": rolls})

    return run


def firsts(heads: DataFrame, min_bytes: int) -> DataFrame:
    """digest, first_id for the payloads that occur more than once; heads: digest, size, id."""
    shared = heads.filter(F.col("size") >= min_bytes).groupBy("digest")
    return shared.agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 100,
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = 256 << 20,
    broadcast_rows: int = 200_000,
) -> None:
    """Writes one record per row below path, deduplicated by payload.

    Payloads under min_bytes are never shared. A null payload is empty, a null url empty;
    a row with a null id is written in full with an empty id. Rows that repeat an id and
    its payload are all responses; of equal payloads the one with the smallest id is the
    response, whatever the rows' order. Long payloads are written whole. An empty table gives
    archives without records; other columns are not looked at. Files hold at most file_bytes,
    or one record.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    first = materialize(firsts(rows.select("id", "digest", "size"), min_bytes))
    if first.count() <= broadcast_rows:  # else the payloads are shuffled by digest
        first = F.broadcast(first)
    rows = rows.join(first, "digest", "left")

    revisit = F.coalesce(F.col("first_id") != F.col("id"), F.lit(False))
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit(">"))
    http = _lines(
        "HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("size").cast("string")), ""
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    record = F.concat(
        _lines("WARC/1.1", F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"))),
        _lines(
            F.concat(F.lit("WARC-Record-ID: "), urn("id")),
            f"WARC-Date: {date}",
            F.concat(F.lit("WARC-Target-URI: "), F.translate("url", "\r\n", "")),
            F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        ),
        F.when(revisit, _lines(F.concat(F.lit("WARC-Refers-To: "), urn("first_id")), f"WARC-Profile: {PROFILE}")).otherwise(""),
        _lines("Content-Type: application/http; msgtype=response", F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")), ""),
        F.col("block"),
    )
    out = rows.withColumn("block", block).select(F.concat(record, F.lit(END + END)).alias("record"))
    members = out.mapInPandas(_members(file_bytes), "value binary, roll int").select(F.col("value").cast("string").alias("value"), "roll")
    members.write.option("lineSep", "\0").option("compression", "none").partitionBy("roll").text(path)


def _head(record: bytes) -> tuple[dict[str, str], bytes]:
    lines, _, block = record.partition(b"\r\n\r\n")
    named = [x.partition(":") for x in lines.decode("utf-8", "replace").split(END)]
    return {name.strip().lower(): value.strip() for name, _, value in named}, block


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    inner = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    for batch in batches:
        rows = []
        for packed in batch["packed"]:
            if not packed:
                continue  # before a file's first member
            record = zlib.decompress(MEMBER + packed, 31)
            if not record:
                continue
            head, block = _head(record)
            kind, refers = head["warc-type"], head.get("warc-refers-to")
            body = block[: int(head["content-length"])].partition(b"\r\n\r\n")[2]
            full = kind == "response"
            rows.append((
                inner(head["warc-record-id"]), kind, head["warc-target-uri"], inner(refers) if refers else None,
                len(body) if full else None, hashlib.sha256(body).hexdigest() if full else None,
                head["warc-payload-digest"].removeprefix("sha256:"),
            ))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"payload_bytes": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, uri, refers_to, payload_bytes, payload_digest, declared_digest of each record.

    A revisit gets the bytes and the digest that were measured on the response to which it
    refers, and nulls where that isn't in the archives or its digest differs.
    """
    small_batches(spark)
    # Split at the heads of members, so that files of any size are read by many tasks, record by record.
    packed = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MEMBER.decode("latin-1")).text(path)
    found = materialize(packed.select(F.col("value").cast("binary").alias("packed")).mapInPandas(_parse, SCHEMA))
    full = found.filter("record_type = 'response'")
    cited = full.select(
        F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest"), "payload_bytes", "payload_digest"
    ).distinct()
    back = found.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    back = back.join(cited, ["refers_to", "declared_digest"], "left")
    return full.unionByName(back)


def query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_folder(spark)
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(
        F.nullif("record_id", F.lit("")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
