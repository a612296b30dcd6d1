"""Log folders as DataFrames of numbered lines, for batch and streams.

Files are read in splits, so a log of any size is spread over tasks. A line's number in its
log comes from its place in its split and the line counts of the splits before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.functions.lines import parse_ban
from postlens.functions.text import after_label, tai64n

#: Roles and the direction that a log's mail has if no connection tells it.
ROLES = {"smtp": "in", "submission": "out", "smtps": "out", "send": None}
LINE = "logdir string, file string, is_current boolean, year int, seq long, line string"


def check_roles(logdirs: dict[str, str]) -> dict[str, str]:
    """Folder to role; the queue log comes last, as it is matched with the others."""
    for folder, role in logdirs.items():
        if role not in ROLES:
            raise ValueError(f"unknown role {role!r} of {folder}")
    return dict(sorted(logdirs.items(), key=lambda x: x[1] == "send"))


def _path(spark: SparkSession, path: str):
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return to, to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _unfinished(spark: SparkSession, path: str) -> bool:
    """Whether a file's last byte is no line end, as its last line may still be written; False for no file."""
    to, fs = _path(spark, path)
    if not fs.exists(to) or not (size := fs.getFileStatus(to).getLen()):
        return False
    f = fs.open(to)
    try:
        f.seek(size - 1)
        return f.read() != 10
    finally:
        f.close()


def _numbered(spark: SparkSession, folder: str, glob: str, live: str, wanted: Column) -> DataFrame:
    """LINE's columns: the lines of a folder's files, rotated ones by name, then the live one.

    Lines end at line feeds alone; bad bytes are replaced; empty lines and the live file's
    unterminated end are left out. A missing folder or no file gives no rows.
    """
    to, fs = _path(spark, folder)
    if not fs.exists(to):
        return spark.createDataFrame([], LINE)
    meta = lambda c: F.col(f"_metadata.{c}")
    rows = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(folder).select(
        F.lit(folder.rstrip("/").rpartition("/")[2]).alias("logdir"), meta("file_name").alias("file"), (meta("file_name") == live).alias("is_current"),
        F.year(meta("file_modification_time")).alias("year"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value",
    ).filter(wanted)
    splits = rows.groupBy("file", "is_current", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("one").orderBy("is_current", "file", "block")  # one row a split
    splits = splits.withColumn("one", F.lit(1)).select(
        "file", "block", "first", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("one")).alias("total"),
    )
    rows = rows.join(splits, ["file", "block"]).withColumn("seq", F.col("before") + F.col("at") - F.col("first") + 1)
    if _unfinished(spark, f"{folder.rstrip('/')}/{live}"):
        rows = rows.filter(F.col("seq") < F.col("total"))
    rows = rows.withColumn("line", F.make_valid_utf8("value")).filter(F.length("line") > 0)
    return rows.select(*[c.split()[0] for c in LINE.split(", ")])


def read_multilog(spark: SparkSession, folder: str) -> DataFrame:
    """LINE's columns with ts and text of a multilog folder: files @*.s by name, then current.

    Lines without a label have a null ts and text.
    """
    rows = _numbered(spark, folder, "{@*.s,current}", "current", F.lit(True))
    return rows.withColumns({"ts": tai64n(F.col("line")), "text": after_label(F.col("line"))})


def _split(live_path: str) -> tuple[str, str]:
    folder, _, name = live_path.rpartition("/")
    return folder or ".", name


def read_syslog(spark: SparkSession, live_path: str) -> DataFrame:
    """LINE's columns of a syslog file and its rotations name-*, packed ones too; year is that of the file's last change."""
    folder, name = _split(live_path)
    file = F.col("_metadata.file_name")
    return _numbered(spark, folder, f"{name}*", name, (file == name) | F.startswith(file, F.lit(f"{name}-")))


def read_bans(spark: SparkSession, path: str) -> DataFrame:
    """ts, jail, ip, action of one fail2ban log, which is read whole each time; no rows if it is missing."""
    folder, name = _split(path)
    rows = _numbered(spark, folder, name, name, F.col("_metadata.file_name") == name)
    return parse_ban(rows).filter("action is not null").select("ts", "jail", "ip", "action")


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of line, file, for files that are moved into folder when complete."""
    rows = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.make_valid_utf8("value").alias("line")).filter(F.length("line") > 0)
