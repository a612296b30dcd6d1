"""A stream of logs that grow: every line once, in order, over rotations and restarts.

Each log is one line of bytes: its rotated files by name, then the live one. The stream's
offset holds, for each log, how far it has been read. A file is known by its first bytes, not
by its name, so a live file is found again after it has been renamed, and one that was cut or
replaced is read from its beginning. An offset also lists the ranges of bytes that lead up to
it, so a batch that runs again reads the same bytes, wherever they are by then.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LINE = "logdir string, file string, is_current boolean, year int, seq long, line string"
PASS, SPLIT, MARKED = 64 << 20, 8 << 20, 512
#: seq is the file's number in its log times this, plus the line's place in the file.
FILE = 1 << 40
BLOCK, BATCH = 1 << 16, 10_000


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in [begin, end); the range that was planned began at first."""

    logdir: str
    file: str
    number: int
    mark: str
    marked: int
    year: int
    first: int
    begin: int
    end: int | None

    def __init__(self, *values):
        self.logdir, self.file, self.number, self.mark, self.marked, self.year, self.first, self.begin, self.end = values


class Folder:
    """The files of one log. Rotated files may be packed (.gz); places in these are of what is unpacked."""

    def __init__(self, uri: str, live: str, rotated: str):
        self.fs, self.path = arrow_fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (arrow_fs.LocalFileSystem(), uri)
        self.live, self.pattern = live, rotated

    def files(self) -> list[arrow_fs.FileInfo]:
        """Rotated files by name, then the live one; none if there is no folder."""
        every = self.fs.get_file_info(arrow_fs.FileSelector(self.path, allow_not_found=True))
        every = [f for f in every if f.type == arrow_fs.FileType.File]
        rotated = sorted((f for f in every if f.base_name != self.live and fnmatch.fnmatchcase(f.base_name, self.pattern)), key=lambda f: f.base_name)
        return rotated + [f for f in every if f.base_name == self.live]

    def stream(self, name: str, begin: int = 0):
        """The file's bytes from begin on."""
        path = f"{self.path}/{name}"
        if name.endswith(".gz"):
            f = self.fs.open_input_stream(path, compression="gzip")
            while begin:
                begin -= len(f.read(min(begin, 1 << 20))) or begin
            return f
        f = self.fs.open_input_file(path)
        f.seek(begin)
        return f

    def mark(self, name: str, size: int) -> str:
        """A digest of the file's first bytes; empty if it has fewer."""
        with self.stream(name) as f:
            head = f.read(size)
        return hashlib.sha256(head).hexdigest()[:32] if len(head) == size else ""

    def last_line_end(self, name: str, begin: int, end: int, size: int) -> int:
        """The last line end in (begin, end], or else the first one after; begin if there is none."""
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            at = end
            while at > begin:
                low = max(begin, at - BLOCK)
                f.seek(low)
                if (k := f.read(at - low).rfind(b"\n")) >= 0:
                    return low + k + 1
                at = low
            f.seek(end)
            at = end
            while at < size and (block := f.read(min(BLOCK, size - at))):
                if (k := block.find(b"\n")) >= 0:
                    return at + k + 1
                at += len(block)
        return begin


#: How far a log has been read: the last rotated file that is done, and of the file that is not done its number, what has been read, and its first bytes.
START = {"done": "", "number": 0, "byte": 0, "mark": "", "marked": 0}


def advance(folder: Folder, logdir: str, at: dict, most: int) -> tuple[dict, list[list]]:
    """The place after the next pass, and the ranges that it reads: at most ``most`` bytes, but a whole line and a whole packed file at least.

    A live file's last line waits for its end; a rotated file's last line needs none.
    """
    ranges: list[list] = []
    number, byte, known = at["number"], at["byte"], bool(at["byte"])
    for f in folder.files():
        name, live, packed = f.base_name, f.base_name == folder.live, f.base_name.endswith(".gz")
        if not live and name <= at["done"]:
            continue
        if most <= 0:
            break
        same = known and (packed or f.size >= byte) and folder.mark(name, at["marked"]) == at["mark"]
        begin = byte if same else 0
        if not same or ranges:
            number += bool(known or ranges or at["done"])
        size = None if packed else f.size
        end = size
        if size is not None and (live or size - begin > most):
            end = folder.last_line_end(name, begin, min(size, begin + most), size)
            if not live and end == begin:
                end = size
        if packed or end > begin:
            marked = at["marked"] if same and packed else MARKED if packed else min(end, MARKED)
            mark = folder.mark(name, marked)
            if packed and not mark:  # fewer bytes than that
                with folder.stream(name) as g:
                    marked = len(g.read(MARKED))
                mark = folder.mark(name, marked)
            ranges.append([logdir, name, number, mark, marked, f.mtime.year if f.mtime else 0, begin, end])
            most -= (end or f.size) - (0 if packed else begin)
        if not live and (packed or end == size):
            at = {**START, "done": name, "number": number}
            known = known and not same
        elif end > begin:
            at = {"done": at["done"], "number": number, "byte": end, "mark": ranges[-1][3], "marked": ranges[-1][4]}
            break
    return at, ranges


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        root = options["path"].rstrip("/")
        live, rotated = options.get("live", "current"), options.get("rotated", "@*.s")
        names = [x for x in options.get("logdirs", "").split(",") if x]
        self.folders = {x: Folder(f"{root}/{x}", live, rotated) for x in names} or {root.rpartition("/")[2]: Folder(root, live, rotated)}
        self.most, self.split = int(options.get("maxBytesPerTrigger", PASS)), int(options.get("splitBytes", SPLIT))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"n": 0, "logs": {}, "ranges": []}

    def latestOffset(self) -> dict:
        now = self.at or self.initialOffset()
        logs, ranges = dict(now["logs"]), []
        for logdir, folder in self.folders.items():
            try:
                logs[logdir], new = advance(folder, logdir, logs.get(logdir, START), self.most)
            except FileNotFoundError:  # renamed just now
                continue
            ranges += new
        if ranges:
            self.at = {"n": now["n"] + 1, "logs": logs, "ranges": ranges}
        return self.at or now

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """After a restart Spark asks for the last batch before it asks for anything new, so the place is known again."""
        self.at = end
        if start["n"] == end["n"]:
            return []
        if start["n"] + 1 != end["n"]:
            raise ValueError(f"pass {end['n']} can't follow pass {start['n']}")
        out = []
        for *what, begin, to in end["ranges"]:
            cuts = [begin] if to is None else list(range(begin, to, self.split))
            out += [Piece(*what, begin, a, b) for a, b in zip(cuts, [*cuts[1:], to], strict=True)]
        return out

    def read(self, p: Piece) -> Iterator[pa.RecordBatch]:
        folder = self.folders[p.logdir]
        name = next((n for n in [p.file, *(f.base_name for f in folder.files())] if _is(folder, n, p)), None)
        if name is None:
            raise FileNotFoundError(f"{p.logdir}: the file that was {p.file} is gone, with lines that were not read")
        rows: list[tuple[int, str]] = []
        columns = [x.split()[0] for x in LINE.split(", ")]

        def batch() -> pa.RecordBatch:
            n = len(rows)
            seq, text = zip(*rows, strict=True)
            fixed = [pa.array([v] * n, t) for v, t in ((p.logdir, pa.string()), (p.file, pa.string()), (p.file == folder.live, pa.bool_()), (p.year, pa.int32()))]
            return pa.RecordBatch.from_arrays([*fixed, pa.array(seq, pa.int64()), pa.array(text, pa.string())], columns)

        for at, line in _lines(folder, name, p):
            if line:
                rows.append((p.number * FILE + at, line.decode("utf-8", errors="replace")))
            if len(rows) == BATCH:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


def _is(folder: Folder, name: str, p: Piece) -> bool:
    try:
        return folder.mark(name, p.marked) == p.mark
    except FileNotFoundError:
        return False


def _lines(folder: Folder, name: str, p: Piece) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines that begin in the piece; a line that began before it is another piece's."""
    skip = p.begin > p.first
    at = p.begin - skip
    with folder.stream(name, at) as f:
        rest = b""
        while p.end is None or at < p.end:
            block = f.read(BLOCK)
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if not skip and (p.end is None or at < p.end):
                    yield at, line
                skip, at = False, at + len(line) + 1
            if not block:
                if rest and not skip and (p.end is None or at < p.end):
                    yield at, rest
                return


class GrowingLogs(DataSource):
    """Format "growing_logs". Options: path; logdirs, names of folders below it, comma-separated (none: path itself);
    live and rotated, the live file's name and a pattern of the others' names; maxBytesPerTrigger, for each log.

    path may be a URI of any store that pyarrow opens.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def follow(spark: SparkSession, path: str, logdirs: list[str] | None = None, live: str = "current", rotated: str = "@*.s", most: int = PASS, split: int = SPLIT) -> DataFrame:
    """LINE's columns of the logs below path, as a stream. seq grows along a log, with gaps; a missing folder has no lines yet.

    For a syslog file: path is its folder, live its name, rotated its name and "-*".
    """
    spark.dataSource.register(GrowingLogs)
    options = {"path": path, "logdirs": ",".join(logdirs or []), "live": live, "rotated": rotated, "maxBytesPerTrigger": str(most), "splitBytes": str(split)}
    return spark.readStream.format("growing_logs").options(**options).load()
