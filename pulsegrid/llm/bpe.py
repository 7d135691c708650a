"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can be last in its BPE encoding.  The automaton of
the vocabulary (a trie with suffix links) reports every token that is a suffix of the prefix; such a token t is the
last one if the last token of what precedes it and t are compatible, that is, if BPE of the two put together
leaves them apart.  Following the stored last tokens back from the whole word gives its exact ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import KEPT_CHARS, LETTERS, NUMBERS, PLAIN
from .tables import small_batches

CACHE_BYTES = 128 << 20  # of encoded words, and of pairs found compatible or not, in a worker; beyond, they begin anew
PAIR_BYTES = 250
#: The byte-level pre-tokenizer's pattern, and the same for plain texts with its classes spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^ \\t\\n{LETTERS}{NUMBERS}]+|[ \\t\\n]+(?![^ \\t\\n])|[ \\t\\n]+"
#: White space that the regex library counts and Unicode's White_Space does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PrefixEncoder:
    """Vocabulary, merges and automaton of one tokenizer file; words already encoded are kept up to a bound."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # merged token -> (rank, left, right)
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault((a, b), k)
            self.parts.setdefault(c, (k, a, b))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(back[c] for c in token)
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.to_chars = {b: chars[b] for b in range(256)}
        self.apart: dict[tuple[int, int], bool] = {}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.words, self.plain_words, self.odd = regex.compile(PATTERN).findall, re.compile(PLAIN_PATTERN).findall, re.compile(PLAIN).search
        self.known = _Words(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps a and b apart: no merge across the border comes before those that built a and b.

        Undo the merges at the border from the latest back.  While pieces x | y face each other, x lasts until
        the merge that takes it into a, y likewise; a merge of x and y that is earlier than both would have
        come first.  Among equal merges the one further left comes first.
        """
        found = self.apart.get((a, b))
        if found is not None:
            return found
        parts, rank = self.parts, self.rank
        x, y = a, b
        x_until = y_until = len(rank)
        ok = True
        while True:
            m = rank.get((x, y))
            if m is not None and m < x_until and m <= y_until:
                ok = False
                break
            of_x, of_y = parts.get(x), parts.get(y)
            if of_y is not None and (of_x is None or of_y[0] >= of_x[0]):
                y_until, y = of_y[0], of_y[1]
            elif of_x is not None:
                x_until, x = of_x[0], of_x[2]
            else:
                break
        if len(self.apart) * PAIR_BYTES > CACHE_BYTES:
            self.apart = {}
        self.apart[a, b] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        s = word.encode().decode("latin-1").translate(self.to_chars)
        last = [-1] * (len(s) + 1)
        size = self.bytes
        for end, (n, token) in self.automaton.iter(s):
            end += 1
            at = end - n
            if last[end] < 0 and (not at or (last[at] >= 0 and self.compatible(last[at], token))):
                if at or self.whole(token):
                    last[end] = token
        ids, at = [], len(s)
        while at:
            ids.append(last[at])
            at -= len(size[last[at]])
        return ids[::-1]

    def whole(self, token: int) -> bool:
        """Whether BPE of the token's own bytes is that token: its two parts are merged by its own rule."""
        part = self.parts.get(token)
        if part is None:
            return True
        key = (token, -1)
        if key not in self.apart:
            self.apart[key] = self.whole(part[1]) and self.whole(part[2]) and self._joins(part[1], part[2], part[0])
        return self.apart[key]

    def _joins(self, a: int, b: int, at: int) -> bool:
        """Whether a and b stay apart until merge ``at`` joins them."""
        parts, rank, x, y = self.parts, self.rank, a, b
        x_until = y_until = at
        first = True
        while True:
            m = rank.get((x, y))
            if m is not None and not first and m < x_until and m <= y_until:
                return False
            first = False
            of_x, of_y = parts.get(x), parts.get(y)
            if of_y is not None and (of_x is None or of_y[0] >= of_x[0]):
                y_until, y = of_y[0], of_y[1]
            elif of_x is not None:
                x_until, x = of_x[0], of_x[2]
            else:
                return True

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.known.held > CACHE_BYTES:
            self.known = _Words(self)
        if not self.odd(text):
            return b"".join(map(self.known.__getitem__, self.plain_words(text)))
        out = []
        for part in self.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(self.known.__getitem__, self._words(part))
        return b"".join(out)

    def _words(self, text: str) -> list[str]:
        if any(c in text for c in SEPARATORS):  # stand-ins of the class that the pattern means: a control character
            marked = text.translate({ord(c): "\x00" for c in SEPARATORS})
            cut, at = [], 0
            for w in self.words(marked):
                cut.append(text[at : at + len(w)])
                at += len(w)
            return cut
        return self.words(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


class _Words(dict):
    def __init__(self, encoder: PrefixEncoder):
        self.encoder, self.held = encoder, 0  # about so many bytes

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.encoder.encode_word(word), dtype="<u4").tobytes()
        if len(word) <= KEPT_CHARS:
            self[word] = out
            self.held += 200 + 4 * len(word) + len(out)
        return out


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, of encoding and decoding its text.

    A null text counts as empty: no tokens, digests of nothing.  Ids may be null or repeated; an empty table
    gives no rows; other columns are ignored.  One scan, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for lo in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(lo, 256).to_pylist():
                    ids = enc.encode(text or "")
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=SCHEMA.names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its token ids, for use as input of other jobs; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            ids = [np.frombuffer(enc.encode(t or ""), dtype="<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")
