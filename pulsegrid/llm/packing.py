"""Packing documents into fixed windows by the sum-of-squares rule.

A document becomes token ids with an end id; pieces of a whole window leave at once.  The rest goes to the fill
level that minimises the sum over levels of the squared number of windows filled to that level.  Levels are steps of
``UNIT`` tokens; N, the level array, counts the windows of each, and each level keeps a stack of its windows.
Moving a window from level h to g changes the sum by (1 - 2 N[h]) + (2 N[g] + 1); the first part is left out
for a new window, the second for one that the rule closes because less than a step is free.
Beyond ``MOST_OPEN`` part-filled windows the fullest is closed by pieces cut from the least filled, so a task
holds a bounded number of windows.  Every task packs the rows of its own partition, so nothing is gathered in one place.
At its end the part-filled windows are emptied into one another in the same way, and the tokens that are left, less than a window,
are cut into sequences of 1024, 512, 256, ... tokens, which need no padding.  So padding is below
``UNIT`` tokens a sequence, whatever the number of partitions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import small_batches

WINDOW = 2048
END_ID = 1
UNIT = 8
MOST_OPEN = 256
CACHE_BYTES = 64 << 20  # of each of two generations of words
KEPT_CHARS = 256  # longer pieces are not kept

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("padded_to", T.LongType()), T.StructField("closed_by", T.StringType()),
])


# The pre-tokenizer's pattern as the tokenizer file states it, its letters and numbers below U+0250 spelled out.
LETTERS, NUMBERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PIECES = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^ \\t\\n{LETTERS}{NUMBERS}]+"
#: Characters for which lowering ASCII letters first, or another library's idea of white space, could matter; special tokens' opening.
PLAIN = r"[\x00-\x08\x0b-\x1f\x7f-\xa0\u0250-\U0010ffff]|<\|"


class WordTokenizer:
    """Ids of a tokenizer that lowers case, drops white space and marks the last token of a word.

    Plain texts are cut into the tokenizer's own pieces, each of which is one word, and new pieces are encoded together;
    other texts are cut at blanks and line feeds only, which no piece crosses, and new chunks are encoded each by itself.
    Known pieces are kept in two generations of bounded size: when one is full it becomes the older one, and what
    is met again moves from there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        ends = [False] * self.tok.get_vocab_size()
        for word, i in self.tok.get_vocab().items():
            ends[i] = word.endswith("</w>")
        self.ends = np.array(ends)
        self.pieces, self.odd = re.compile(PIECES).findall, re.compile(PLAIN).search
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: list[str], chunks: list[str]) -> None:
        """Encode new words, blank between them, where each ends with its last token; and new chunks one by one."""
        for k in range(0, len(words), 2048):
            part = words[k : k + 2048]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                raw, last = ids.tobytes(), 0
                for w, c in zip(part, (4 * cut).tolist()):
                    self.known[w] = raw[last:c]
                    last = c
            else:
                chunks = chunks + part
        for k in range(0, len(chunks), 2048):
            part = chunks[k : k + 2048]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.held > CACHE_BYTES:
            self.older, self.known, self.held = self.known, {"": b""}, 0
        known, older = self.known, self.older
        cut, words, chunks = [], set(), set()
        for t in texts:
            odd = self.odd(t)
            cut.append(t.replace("\n", " ").split(" ") if odd else self.pieces(t.encode().lower().decode()))
            (chunks if odd else words).update(cut[-1])
        new = words.union(chunks).difference(known)
        again = [w for w in new if w in older]
        known.update((w, older[w]) for w in again)
        new.difference_update(again)
        self.learn(sorted(new & words), sorted(new - words))
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        self.held += 150 * len(new) + 3 * sum(map(len, new)) + 100 * len(again)
        for w in [w for w in new if len(w) > KEPT_CHARS]:
            del known[w]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that later tasks find its cache."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def halves(piece: tuple, at: int) -> tuple[tuple, tuple]:
    """A piece (doc, start, ids, tokens of the document) cut after ``at`` ids."""
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * at], total), (doc, start + at, ids[4 * at :], total)


class SumOfSquares:
    """The level array and the part-filled windows of one partition.

    A window is [fill, [(piece, length), ...]]; its level is its fill in steps of ``unit``, rounded up.
    """

    def __init__(self, window: int = WINDOW, unit: int = UNIT, most_open: int = MOST_OPEN, cut=halves):
        self.size, self.unit, self.top, self.most_open, self.cut = window, unit, -(-window // unit), most_open, cut
        self.count = np.zeros(self.top + 1, dtype=np.int64)
        self.fill = np.zeros(self.top + 1, dtype=np.int64)  # of the window that a level would give
        self.fill[1:] = window + 1
        self.stack: list[list] = [[] for _ in range(self.top + 1)]
        self.n_open, self.closed = 0, []

    def _keep(self, target: list) -> None:
        level = -(-target[0] // self.unit)
        self.stack[level].append(target)
        self.count[level] += 1
        self.fill[level] = target[0]
        self.n_open += 1

    def _take(self, level: int) -> list:
        stack = self.stack[level]
        target = stack.pop()
        self.count[level] -= 1
        self.fill[level] = stack[-1][0] if stack else self.size + 1
        self.n_open -= 1
        return target

    def place(self, length: int, piece) -> None:
        """Put a piece of less than a window where the sum of squares becomes least."""
        n, after = self.count, self.fill + length
        to = np.minimum(-(-after // self.unit), self.top)
        cost = np.where(to < self.top, 2 * n[to] + 1, 0) + 1 - 2 * n
        cost[0] -= 1  # a new window leaves no level
        cost[to == np.arange(self.top + 1)] = 0
        cost[after > self.size] = np.iinfo(np.int64).max
        h = int(self.top - np.argmin(cost[::-1]))  # ties to the fuller window
        target = self._take(h) if h else [0, []]
        target[1].append((piece, length))
        target[0] += length
        if self.size - target[0] < self.unit:
            self.closed.append(("rule", target[1], self.size))
        else:
            self._keep(target)
            if self.n_open > self.most_open:
                self._close_fullest("bound")

    def _close_fullest(self, why: str) -> None:
        """Fill the fullest window with pieces of the least filled ones."""
        target = self._take(int(np.flatnonzero(self.count)[-1]))
        while target[0] < self.size and self.n_open:
            donor = self._take(int(np.flatnonzero(self.count)[0]))
            piece, length = donor[1].pop()
            room = self.size - target[0]
            if length > room:
                piece, rest = self.cut(piece, room)
                donor[1].append((rest, length - room))
            moved = min(length, room)
            target[1].append((piece, moved))
            target[0] += moved
            donor[0] -= moved
            if donor[0]:
                self._keep(donor)
        if target[0] == self.size:
            self.closed.append((why, target[1], self.size))
        else:
            self._split(target)

    def _split(self, target: list) -> None:
        """Sequences of falling powers of two, which need no padding, of what is left of a partition."""
        left, pieces = target[0], target[1][::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            room, sequence = size, []
            while room:
                piece, length = pieces.pop()
                if length > room:
                    piece, rest = self.cut(piece, room)
                    pieces.append((rest, length - room))
                    length = room
                sequence.append((piece, length))
                room -= length
            self.closed.append(("tail", sequence, size))
            left -= size

    def full(self) -> list[tuple]:
        """(what closed it, pieces, padded length) of the windows closed since the last call."""
        out, self.closed = self.closed, []
        return out

    def drain(self) -> list[tuple]:
        while self.n_open:
            self._close_fullest("end")
        return self.full()


def _pack(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, bins, seq = tokenizer(path), SumOfSquares(window), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        end = np.array([END_ID], dtype="<u4").tobytes()

        def rows(done: list[tuple]) -> pa.RecordBatch:
            nonlocal seq
            cols: list[list] = [[] for _ in SCHEMA]
            for why, pieces, size in done:
                at = 0
                for (doc, start, ids, total), length in pieces:
                    for c, v in zip(cols, (doc, start, length, zlib.crc32(ids), total, seq, at, size, why)):
                        c.append(v)
                    at += length
                seq += 1
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], names=SCHEMA.names)

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(docs), 256):
                part = [t or "" for t in texts.slice(lo, 256).to_pylist()]
                for doc, ids in zip(docs[lo : lo + 256], tok.encode(part)):
                    ids += end
                    total = len(ids) // 4
                    whole = total - total % window
                    for s in range(0, whole, window):
                        bins.closed.append(("whole", [((doc, s, ids[4 * s : 4 * (s + window)], total), window)], window))
                    if whole < total:
                        bins.place(total - whole, (doc, whole, ids[4 * whole :], total))
            if done := bins.full():
                yield rows(done)
        if done := bins.drain():
            yield rows(done)

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to, closed_by.

    padded_to is the window, or the length itself of a power of two at the end of a partition; closed_by tells what ended the
    sequence: whole (one piece fills it), rule, bound (too many were open), end or tail (the partition's end).

    A null or empty text is its end id alone; a text longer than a window fills whole windows first; null ids
    and repeated rows are packed like others; an empty table gives no rows; other columns are ignored.  Every
    task is one input partition, so hot sources do not matter and a lost executor repeats single partitions.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pack(tokenizer_path, window), SCHEMA)
