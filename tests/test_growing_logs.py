"""Logs that grow, rotate, are cut and packed between passes, against all lines ever written."""

import gzip
import random

import pytest

from postlens.sources import growing
from postlens.sources.growing import Folder, Reader, advance


class Log:
    """A writer that keeps what it wrote."""

    def __init__(self, folder, live="current"):
        self.folder, self.live, self.lines, self.n = folder, folder / live, [], 0
        folder.mkdir(exist_ok=True)

    def write(self, text, whole=True):
        with self.live.open("ab") as f:
            f.write((text + "\n" * whole).encode())

    def line(self, size=20):
        self.lines.append(f"@{len(self.lines):08d} " + "x" * size)
        self.write(self.lines[-1])

    def rotate(self, name=None, packed=False):
        self.n += 1
        data, to = self.live.read_bytes(), self.folder / (name or f"@{self.n:08d}.s")
        self.live.unlink()
        to.write_bytes(data) if not packed else to.with_name(to.name + ".gz").write_bytes(gzip.compress(data))


def read(reader, start, end):
    return [x for p in reader.partitions(start, end) for b in reader.read(p) for x in b.to_pylist()]


def options(folder, **more):
    return {"path": str(folder), **{k: str(v) for k, v in more.items()}}


@pytest.mark.parametrize("seed", range(6))
def test_every_line_once_in_order(tmp_path, seed):
    """Readers are thrown away between passes, as by a restart; batches are read again after more rotations."""
    r, log = random.Random(seed), Log(tmp_path / "log")
    place, got, half = None, [], None
    for _ in range(60):
        for _ in range(r.randrange(6)):
            if half is not None:
                log.write(half[20:])
                log.lines.append(half)
                half = None
            log.line(r.randrange(40))
        if half is None and r.random() < 0.3:
            half = f"@{len(log.lines):08d} half a line, at first"
            log.write(half[:20], whole=False)
        if half is None and log.live.exists() and r.random() < 0.3:
            log.rotate()
        reader = Reader(options(log.folder, maxBytesPerTrigger=r.choice([30, 200, 10_000]), splitBytes=r.choice([7, 50, 1_000])))
        if place:
            reader.partitions(place, place)
        start, end = place or reader.initialOffset(), reader.latestOffset()
        first = read(reader, start, end)
        if r.random() < 0.5 and half is None and log.live.exists():
            log.rotate()
            again = Reader(options(log.folder))
            assert read(again, start, end) == first
        got, place = got + first, end
    for _ in range(200):
        reader = Reader(options(log.folder))
        reader.partitions(place, place)
        end = reader.latestOffset()
        got, place = got + read(reader, place, end), end
    assert [x["line"] for x in got] == log.lines
    assert [x["seq"] for x in got] == sorted({x["seq"] for x in got})
    assert {x["logdir"] for x in got} == {"log"}


def test_a_cut_file_is_read_from_its_beginning(tmp_path):
    folder = Folder(str(tmp_path), "current", "@*.s")
    live = tmp_path / "current"
    live.write_text("one\ntwo\n")
    at, ranges = advance(folder, "x", growing.START, 1_000)
    assert ranges[0][-2:] == [0, 8]
    assert advance(folder, "x", at, 1_000) == (at, [])
    live.write_text("new\n")
    cut, ranges = advance(folder, "x", at, 1_000)
    assert ranges[0][-2:] == [0, 4] and cut["number"] == at["number"] + 1
    live.write_text("another, longer than before\nand more\n")
    assert advance(folder, "x", at, 1_000)[1][0][-2:] == [0, 37]


def test_bounded_passes_and_long_lines(tmp_path):
    live = tmp_path / "current"
    live.write_bytes(b"".join(b"%098d\n" % i for i in range(3_000)) + b"y" * 70_000 + b"\nlast\n")
    folder, at, passes, seen = Folder(str(tmp_path), "current", "@*.s"), growing.START, 0, []
    while True:
        at, ranges = advance(folder, "x", at, 1_000)
        if not ranges:
            break
        seen += ranges
        passes += 1
    assert all(x[-1] - x[-2] <= 1_000 for x in seen[:-2]) and passes > 290
    assert [x[-2] for x in seen[1:]] == [x[-1] for x in seen[:-1]] and at["byte"] == live.stat().st_size


def test_control_characters_bad_bytes_and_other_files(tmp_path):
    (tmp_path / "lock").write_text("no\n")
    (tmp_path / "state").write_text("no\n")
    (tmp_path / "@2.s").write_bytes(b"b\r\x0c\xc2\x85 c\n\n\xff\n")
    (tmp_path / "@1.s").write_bytes(b"a without end")
    reader = Reader(options(tmp_path))
    rows = read(reader, reader.initialOffset(), reader.latestOffset())
    assert [x["line"] for x in rows] == ["a without end", "b\r\x0c\x85 c", "�"]
    assert not any(x["is_current"] for x in rows)
    gone = Reader(options(tmp_path / "nothing"))
    assert gone.latestOffset() == gone.initialOffset()


def test_packed_rotations_of_a_syslog(tmp_path):
    log = Log(tmp_path / "l", "mail.log")
    reader = lambda: Reader(options(log.folder, live="mail.log", rotated="mail.log-*"))
    place, got = None, []
    for k in range(4):
        for _ in range(3):
            log.line(300)
        one = reader()
        if place:
            one.partitions(place, place)
        start, end = place or one.initialOffset(), one.latestOffset()
        got, place = got + read(one, start, end), end
        log.line()
        if k % 2:
            log.rotate(f"mail.log-2026090{k}", packed=True)
    one = reader()
    one.partitions(place, place)
    got += read(one, place, one.latestOffset())
    assert [x["line"] for x in got] == log.lines
    assert [x["seq"] for x in got] == sorted({x["seq"] for x in got})


def test_stream_over_two_logs_and_restarts(spark, tmp_path):
    logs = [Log(tmp_path / "root" / x) for x in ("a", "b") if (tmp_path / "root").mkdir(exist_ok=True) is None]
    table, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for k in range(3):
        for i, log in enumerate(logs):
            for _ in range(3 + i):
                log.line()
            if k == i:
                log.rotate()
                log.line()
        rows = growing.follow(spark, str(tmp_path / "root"), ["a", "b"], split=40)
        rows.writeStream.option("checkpointLocation", mark).format("parquet").option("path", table).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(table).orderBy("logdir", "seq").collect()
    assert [x.line for x in got if x.logdir == "a"] == logs[0].lines
    assert [x.line for x in got if x.logdir == "b"] == logs[1].lines
