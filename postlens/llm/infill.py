"""Fill-in-middle: texts cut at line ends, their parts put in order around sentinels.

A table-driven automaton over UTF-8 bytes knows at once how many continuation bytes a code
point still lacks, whether a line begins, and how much of a sentinel it has seen. It reads
each text once, in lanes of a few hundred bytes side by side, and keeps a lane's counted
transitions only: code points, lines, sentinels. These give a text's number of lines, hence
its cuts; a second pass reads just the lanes that hold a cut, up to it.

Three bytes decide the automaton's state, whatever it was before, so a lane that begins
inside a text starts from the three bytes before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.scratch import give_back, small_batches

# The sentinels; each is an opening sign, one of the letters and a closing sign.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

LANE, BACK = 256, 3  # bytes in a lane; bytes that decide a state
BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

LINE_START, INSIDE, OPENED, LETTER, LACKS_1, LACKS_2, LACKS_3 = range(7)
OTHER, LINE_END, OPENING, NAME, CLOSING, CONTINUES, LEADS_2, LEADS_3, LEADS_4 = range(9)
KINDS = 9
POINT, LINE, SENTINEL = 1, 1 << 20, 1 << 40  # a transition's counts, added as one number


def _kinds() -> np.ndarray:
    """The kind of each byte."""
    kind = np.zeros(256, np.uint8)
    kind[ord("\n")], kind[ord("<")], kind[ord(">")] = LINE_END, OPENING, CLOSING
    kind[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = NAME
    kind[0x80:0xC0], kind[0xC0:0xE0], kind[0xE0:0xF0], kind[0xF0:] = CONTINUES, LEADS_2, LEADS_3, LEADS_4
    return kind


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the counts of every transition, at state * KINDS + kind.

    A continuation byte that nothing asked for counts as a code point of its own.
    """
    after = {LINE_END: LINE_START, OPENING: OPENED, LEADS_2: LACKS_1, LEADS_3: LACKS_2, LEADS_4: LACKS_3}
    lacks = {LACKS_1: INSIDE, LACKS_2: LACKS_1, LACKS_3: LACKS_2}
    to, counts = np.zeros(7 * KINDS, np.uint8), np.zeros(7 * KINDS, np.int64)
    for state in range(7):
        for kind in range(KINDS):
            edge = state * KINDS + kind
            continued = kind == CONTINUES and state in lacks
            to[edge] = lacks[state] if continued else LETTER if (state, kind) == (OPENED, NAME) else after.get(kind, INSIDE)
            counts[edge] = (not continued) * POINT + (state == LINE_START) * LINE + ((state, kind) == (LETTER, CLOSING)) * SENTINEL
    return to, counts


KIND, (TO, COUNTS) = _kinds(), _tables()


def entered(kinds: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state in which each lane is entered; first: it begins a text."""
    state = np.full(len(start), INSIDE, np.uint8)
    for back in range(BACK, 0, -1):
        state = TO[state * KINDS + kinds[np.maximum(start - back, 0)]]
    return np.where(first, LINE_START, state).astype(np.uint8)


def counted(kinds: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The counted transitions of each lane, all lanes a byte at a time, the long ones first."""
    order = np.argsort(-size, kind="stable")
    at, state, seen = start[order], state[order], np.zeros(len(order), np.int64)
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)))  # lanes with more than so many bytes
    for step, n in enumerate(live):
        edge = state[:n] * KINDS + kinds[at[:n] + step]
        state[:n] = TO[edge]
        seen[:n] += COUNTS[edge]
    out = np.empty_like(seen)
    out[order] = seen
    return out


def located(kinds: np.ndarray, start: np.ndarray, state: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and code points of each lane before its line number ``line`` (from 0), which begins in it."""
    offset, points = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    lane, seen, step = np.arange(len(start)), np.zeros(len(start), np.int64), 0
    while len(lane):
        edge = state * KINDS + kinds[start + step]
        here = (state == LINE_START) & (seen // LINE == line)
        offset[lane[here]], points[lane[here]] = step, seen[here] & (LINE - 1)
        on = ~here
        lane, start, line = lane[on], start[on], line[on]
        seen, state = seen[on] + COUNTS[edge[on]] % SENTINEL, TO[edge[on]]
        step += 1
    return offset, points


class Texts:
    """The lanes of many texts, which lie one after another in data, and what the first pass counts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lane: int = LANE):
        self.bounds, lengths = bounds, np.diff(bounds)
        lanes = -(-lengths // lane)
        self.lanes = np.concatenate([[0], np.cumsum(lanes)])  # a text's first lane
        text = np.repeat(np.arange(len(lengths)), lanes)
        place = np.arange(self.lanes[-1]) - self.lanes[text]
        self.kinds, self.start = KIND[data], bounds[text] + place * lane
        self.state = entered(self.kinds, self.start, place == 0)
        counts = counted(self.kinds, self.start, np.minimum(bounds[text + 1] - self.start, lane), self.state)
        so_far = lambda n: np.concatenate([[0], np.cumsum(n)])
        self.points, self.lines = so_far(counts % LINE), so_far(counts // LINE % (SENTINEL // LINE))
        marks = so_far(counts // SENTINEL)[self.lanes]
        self.n, self.marked = np.diff(self.lines[self.lanes]), np.diff(marks) > 0

    def cut(self, text: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (in data) and code points (of the text) before the line of each text, or before its end after the last."""
        end = line >= self.n[text]
        before = self.points[self.lanes[text]]
        at, points = self.bounds[text + 1].copy(), self.points[self.lanes[text + 1]] - before
        goal = (self.lines[self.lanes[text]] + line)[~end]
        lane = np.searchsorted(self.lines, goal, side="right") - 1
        offset, within = located(self.kinds, self.start[lane], self.state[lane], goal - self.lines[lane])
        at[~end], points[~end] = self.start[lane] + offset, self.points[lane] + within - before[~end]
        return at, points


def _draws(seed: int, ids: list) -> np.ndarray:
    """Four numbers for each id."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


OUT = "doc_id {}, n long, form string, prefix_chars long, middle_chars long, output binary"


def _rearrange(seed: int, rate: int, spm: int):
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            held = column.buffers()[2]
            data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
            texts, whole = Texts(data, offsets - offsets[0]), memoryview(data)
            draws = _draws(seed, ids.to_pylist())
            plain = (np.diff(offsets) == 0) | texts.marked | (draws[:, 2] % 100 >= rate)
            cut = np.flatnonzero(~plain)
            drawn = np.sort(draws[cut, :2] % (texts.n[cut, None] + 1), axis=1)
            (one, head), (two, upto) = texts.cut(cut, drawn[:, 0]), texts.cut(cut, drawn[:, 1])
            ends, outputs = texts.bounds, [b""] * len(column)
            for i in np.flatnonzero(plain):
                outputs[i] = bytes(whole[ends[i] : ends[i + 1]])
            first_suffix = draws[cut, 3] % 100 < spm
            for i, a, b, back in zip(cut, one, two, first_suffix, strict=True):
                prefix, middle, suffix = whole[ends[i] : a], whole[a:b], whole[b : ends[i + 1]]
                outputs[i] = b"".join((s, suffix, p, prefix, m, middle) if back else (p, prefix, s, suffix, m, middle))
            form = np.full(len(column), "plain", object)
            form[cut] = np.where(first_suffix, "spm", "psm")
            chars = np.zeros((2, len(column)), np.int64)
            chars[0, cut], chars[1, cut] = head, upto - head
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(texts.n), pa.array(form, pa.string()), *(pa.array(c, mask=plain) for c in chars), pa.array(outputs, pa.binary())], names
            )
        give_back()

    return run


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    Of the four numbers that the seed and the id give, two choose the cuts, one whether the
    text is rearranged (``rate`` percent are), one whether the suffix comes first (``spm``
    percent). A text that is empty or holds a sentinel stays as it is (form "plain", no
    character counts), a null text is empty, a null id is hashed as no digits. Rows with one
    id get the same numbers, and repeated rows the same output. Texts of any length are cut
    whole; an empty table gives no rows; other columns of docs are not looked at. Batches of
    texts are bounded by rows and bytes (what the session has set stays), a text is never split.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not spark.conf.get(BYTES_PER_BATCH, None):
        spark.conf.set(BYTES_PER_BATCH, str(32 << 20))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(_rearrange(seed, rate, spm), OUT.format(rows.schema["doc_id"].dataType.simpleString()))
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle has rearranged; null if output or form is, and for a form that isn't one of its own."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def query(spark, sf_dir):
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts,
             sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, CASE WHEN parts[-1] = '' THEN len(parts) - 1 ELSE len(parts) END::BIGINT AS n,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
      FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(parts[1:a], chr(10)) || CASE WHEN a > 0 AND a < len(parts) THEN chr(10) ELSE '' END AS prefix,
        array_to_string(parts[1:b], chr(10)) || CASE WHEN b > 0 AND b < len(parts) THEN chr(10) ELSE '' END AS head FROM c),
q AS (SELECT *, substr(head, length(prefix) + 1) AS middle, substr(text, length(head) + 1) AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM q
"""
