"""SentencePiece encoding and decoding for models of merge type (BPE with byte fallback).

Encoding fills a table with the one last token of every prefix. An automaton gives the
pieces that end at a place; the right one is the only piece that is compatible with the
last token of the prefix before it, that is, whose pair merges to just these two tokens.
The ids are then read off backwards. This takes time in proportion to the text, with no
merge queue.

No piece holds a word mark after another character, or a line end, so merges never cross
these places and a text falls into parts that are encoded for themselves. The parts of many
texts are filled side by side, one place of each at a time, as numpy arrays; the answers for
pairs of tokens are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from postlens.llm.scratch import give_back, small_batches

MARK = "▁"
#: Characters that are encoded at once, and the longest part that is filled side by side with others.
SLICE, LONGEST = 1 << 18, 64
#: Pair tests kept by a Python worker, in a table of SLOTS numbers (8 MB), and those of longer parts.
MOST_PAIRS, SLOTS, MOST_LONG = 500_000, 1 << 20, 50_000


class Pairs:
    """Which pairs of ids are compatible: a hash table with open addresses, asked for many pairs at once."""

    def __init__(self, test: Callable[[int, int], bool], n_ids: int):
        self.test, self.n, self.known = test, n_ids, 0
        self.table = np.full(SLOTS, -1, np.int64)  # 2 * pair + answer

    def _held(self, keys: np.ndarray) -> np.ndarray:
        """What the table holds for each key; negative where it is not known."""
        slots = (keys * 0x9E3779B1 >> 12) & (SLOTS - 1)
        held = self.table[slots]
        other = np.flatnonzero((held >> 1 != keys) & (held >= 0))
        while len(other):
            slots[other] = at = (slots[other] + 1) & (SLOTS - 1)
            held[other] = now = self.table[at]
            other = other[(now >> 1 != keys[other]) & (now >= 0)]
        return held

    def _keep(self, key: int, answer: bool) -> None:
        if self.known >= MOST_PAIRS:
            self.table.fill(-1)
            self.known = 0
        slot = (key * 0x9E3779B1 >> 12) & (SLOTS - 1)
        while self.table[slot] >= 0:
            slot = (slot + 1) & (SLOTS - 1)
        self.table[slot] = 2 * key + answer
        self.known += 1

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.n + b
        held = self._held(keys)
        new = np.flatnonzero(held < 0)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            answers = [self.test(*divmod(k, self.n)) for k in fresh.tolist()]
            held[new] = np.array(answers)[back]
            for k, ok in zip(fresh.tolist(), answers, strict=True):
                self._keep(k, ok)
        return held & 1 == 1


class Table:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = proto.SentencePiece
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must be of merge type with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model must keep texts as they are, but for a space in front")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("user-defined pieces and marks inside pieces are not supported")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        ends = "" if any("\n" in p for p in self.ids) else "\n"
        self.ends = ord(ends) if ends else None
        self.cut = re.compile(f"(?<=[^{MARK}]){MARK}" + (f"|{ends}" if ends else ""))
        self.long_pairs: dict[tuple[str, str], bool] = {}
        self._number(len(proto.pieces))
        text = {i: p.piece.replace(MARK, " ").encode() for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        text |= {i: bytes([b]) for b, i in self.byte.items()}
        text[proto.trainer_spec.unk_id] = proto.trainer_spec.unk_surface.encode()
        self.text = [text.get(i, b"") for i in range(len(proto.pieces))]
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}

    def _number(self, none: int) -> None:
        """The automaton as arrays: its next states, and the longest piece that ends at each. none: the id that stands for no piece."""
        names = [p for p, _ in sorted(self.ids.items(), key=lambda x: x[1])]
        letters = {c: k for k, c in enumerate(sorted({c for p in names if len(p) > 1 for c in p}), 1)}
        self.none, self.width = none, len(letters) + 1
        self.top = max(map(ord, {c for p in names for c in p})) + 1  # stands for all characters from here on
        self.kind, self.alone = np.zeros(self.top + 1, np.uint16), np.full(self.top + 1, none, np.int32)
        for c, k in letters.items():
            self.kind[ord(c)] = k
        for p in names:
            if len(p) == 1:  # a character without a kind is no part of longer pieces
                self.alone[ord(p)] = self.ids[p]
        begins = sorted({p[:k] for p in names for k in range(len(p) + 1) if len(p) > 1 or p in letters}, key=len)
        state = {p: i for i, p in enumerate(begins)}
        # A state that no piece goes on from shares the row of the longest ending that one goes on from.
        inner = sorted({state[p[:-1]] for p in begins[1:]})
        row = np.full(len(begins), -1, np.int32)
        row[inner] = np.arange(len(inner))
        steps = np.zeros((len(inner), self.width), np.uint16 if len(begins) < 1 << 16 else np.int32)
        self.longest, self.shorter = np.full(len(begins), none, np.int32), np.full(none + 1, none, np.int32)
        self.size = np.ones(none + 1, np.int32)
        fail = np.zeros(len(begins), np.int64)
        for size, group in groupby(begins[1:], key=len):
            level = list(group)
            to = np.array([state[p] for p in level])
            before, letter = np.array([state[p[:-1]] for p in level]), np.array([letters[p[-1]] for p in level])
            if size > 1:
                fail[to] = steps[row[fail[before]], letter]
            steps[row[before], letter] = to
            self.longest[to] = self.longest[fail[to]]
            for p, i in zip(level, to.tolist(), strict=True):
                if (name := self.ids.get(p)) is not None:
                    self.shorter[name], self.longest[i], self.size[name] = self.longest[i], name, size
            # What does not go on from here goes on from the longest ending that is a beginning.
            # All states of fewer characters are complete by now; these get their own steps with the next level.
            own = row[to] >= 0
            steps[row[to[own]]] = steps[row[fail[to[own]]]]
            row[to[~own]] = row[fail[to[~own]]]
        self.next, self.row = steps.ravel(), row * self.width
        self.name = [""] * (none + 1)
        for p, i in self.ids.items():
            self.name[i] = p
        # What is no piece merges with nothing, as if the part began after it.
        self.together = Pairs(lambda a, b: b == none or self._compatible(self.name[a], self.name[b]), none + 1)
        self.byte_ids = np.array([self.byte[b] for b in range(256)], np.uint32)

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging, best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, a: str, b: str) -> bool:
        return self.merged(a + b) == ([a, b] if a else [b])

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        known = self.long_pairs.get(key)
        if known is None:
            if len(self.long_pairs) >= MOST_LONG:
                self.long_pairs.clear()
            known = self.long_pairs[key] = self._compatible(a, b)
        return known

    def tokens(self, part: str) -> list[str]:
        """The tokens of a part, from the table of each prefix's last token."""
        last, state = [""], 0
        for end, c in enumerate(part, 1):
            code = min(ord(c), self.top)
            kind = int(self.kind[code])
            state = int(self.next[int(self.row[state]) + kind])
            piece = int(self.longest[state]) if kind else int(self.alone[code])
            while piece != self.none and not self.compatible(last[end - int(self.size[piece])], self.name[piece]):
                piece = int(self.shorter[piece])
            last.append(self.name[piece] or c)  # a character that is no piece is spelled in bytes
        out, end = [], len(part)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _fill(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, token: np.ndarray) -> None:
        """Puts the tokens of the parts at their last places."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order].astype(np.int64), size[order].astype(np.int64)
        base = np.cumsum(size + 1) - size - 1  # of each part's prefixes, the empty one first
        last, state = np.full(int((size + 1).sum()), self.none, np.int32), np.zeros(len(size), self.next.dtype)
        kind = self.kind[np.minimum(codes, self.top)]
        apart = not kind.all()
        for j, n in enumerate(np.searchsorted(-size, -np.arange(size[0])).tolist()):  # n parts are longer than j
            letter = kind[start[:n] + j]
            state = self.next[self.row[state[:n]] + letter]
            piece = self.longest[state]
            if apart and len(odd := np.flatnonzero(letter == 0)):
                piece[odd] = self.alone[np.minimum(codes[start[odd] + j], self.top)]
            prefix = base[:n] + j + 1
            wrong = np.flatnonzero(~self.together(last[prefix - self.size[piece]], piece))
            while len(wrong):
                piece[wrong] = other = self.shorter[piece[wrong]]
                wrong = wrong[~self.together(last[prefix[wrong] - self.size[other]], other)]
            last[prefix] = piece
        while len(start):
            got = last[base + size]
            token[start + size - 1] = got
            size = size - self.size[got]
            more = size > 0
            start, base, size = start[more], base[more], size[more]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of texts that have marks for spaces and one in front; none is empty."""
        whole = "".join(chunks)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([0, *map(len, chunks)])
        mark = codes == ord(MARK)
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        if self.ends is not None:
            end = codes == self.ends
            begins |= end
            begins[1:] |= end[:-1]
        begins[bounds[:-1]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(codes)))
        token = np.full(len(codes), -1, np.int32)
        short = size <= LONGEST
        if short.any():
            self._fill(codes, start[short], size[short], token)
        for a, n in zip(start[~short].tolist(), size[~short].tolist(), strict=True):
            for t in self.tokens(whole[a : a + n]):
                a += len(t)
                token[a - 1] = self.ids.get(t, self.none)
        at = np.flatnonzero(token >= 0)
        ids, bounds = token[at].astype("<u4"), np.searchsorted(at, bounds)
        spelled = ids == self.none
        if spelled.any():  # characters that are no pieces, in bytes
            chars = codes[at[spelled]]
            times = np.ones(len(ids), np.int64)
            times[spelled] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
            data = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            ids, bounds = np.repeat(ids, times), np.concatenate([[0], np.cumsum(times)])[bounds]
            ids[np.repeat(spelled, times)] = self.byte_ids[np.frombuffer(data, np.uint8)]
        return [ids[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]

    def _chunks(self, text: str) -> Iterator[str]:
        """The text with marks for spaces, cut at begins of parts after each SLICE characters."""
        whole, at = MARK + text.replace(" ", MARK), 0
        while at < len(whole):
            cut = self.cut.search(whole, at + SLICE)
            end = cut.start() if cut else len(whole)
            yield whole[at:end]
            at = end

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """All ids of each text, with those of begin and end, as little-endian 32-bit integers."""
        out, held, size = [], [], 0

        def flush() -> None:
            for (i, _), ids in zip(held, self._encode([x for _, x in held]), strict=True):
                out[i].append(ids)

        for i, text in enumerate(texts):
            out.append([])
            for chunk in self._chunks(text) if text else ():
                held.append((i, chunk))
                size += len(chunk)
                if size >= SLICE:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.bos, self.eos))
        return [b"".join([begin, *x, end]) for x in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes | None) -> str:
        """The text of ids: control ids are silent and the space in front goes; stray bytes become U+FFFD."""
        if not ids:
            return ""
        out = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.removeprefix(b" ").decode("utf-8", "replace")


_tables: dict[int, Table] = {}


def table(shared) -> Table:
    """The worker's table of a broadcast model; made once for all tasks of the worker."""
    model = shared.value
    if (key := hash(model)) not in _tables:
        _tables[key] = Table(model)
        give_back()
    return _tables[key]


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers, with begin and end), one row per input row.

    Null and empty texts give begin and end only; an empty table gives no rows; repeated rows
    give repeated rows; long texts are taken whole; other columns of docs are not looked at.
    The model file is read on the driver and sent to the tasks.
    """
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table(shared)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": t.encode_all(batch["text"])})

    # Ids go through pandas as text, which keeps nulls and large numbers as they are.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id string, ids binary").withColumn("doc_id", F.col("doc_id").cast(kind))


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, decoded, from doc_id and ids; null ids give an empty text."""
    shared, kind = encoded.sparkSession.sparkContext.broadcast(model), encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table(shared)
        for batch in batches:
            yield batch.assign(decoded=[t.decode(x) for x in batch["ids"]])

    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    out = rows.mapInPandas(run, "doc_id string, ids binary, decoded string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode and then decode give, one row per input row.

    Both are done in one Python step. Null and empty texts give begin and end only and decode
    to an empty text; long texts are taken whole; repeated rows give repeated rows; an empty
    table gives no rows; other columns of docs are not looked at.
    """
    small_batches(docs.sparkSession)
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table(shared)
        for batch in batches:
            ids = t.encode_all(batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [t.decode(x) for x in ids]})
        give_back()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id string, ids binary, decoded string").select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir, path: str | None = None):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_model(path or model_path()))
