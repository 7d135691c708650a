"""Vectorised words and hashes over Arrow string batches.

A batch's UTF-8 bytes are taken as one numpy array.  A polynomial prefix hash gives every word's 64-bit hash
without a Python object per word: with P[i] the sum of c[j] * B**j for j < i, the word [s, e) hashes to
(P[e] - P[s]) * B**-s, all modulo 2**64 (B is odd, so it has an inverse).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 18

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling; those of a block are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64)
        while len(have) < max(n, BLOCK_BYTES + 1):
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if n <= BLOCK_BYTES + 1:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, token, shape = (np.zeros(256, dtype=np.uint8) for _ in range(3))
    for b in range(256):
        c = chr(b)
        if b >= 128:
            word[b], token[b], shape[b] = b, b, ord("a")
        elif c.isalnum():
            word[b], token[b] = ord(c.lower()), b
            shape[b] = ord("0") if c.isdigit() else ord("A") if c.isupper() else ord("a")
        elif c not in " \t\n\r\f\v\0":
            token[b], shape[b] = b, b
    return word, token, shape


WORD, TOKEN, SHAPE = _tables()  # byte -> folded byte, 0: separator


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, whole[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, ...]:
    """(row of each word, its hash, start, end); words are maximal runs of bytes that ``table`` keeps.

    A longer text than a block is cut between words, so that what is held besides the words stays small.
    """
    n = len(buf)
    if n > 2 * BLOCK_BYTES:
        cuts, look = [0], BLOCK_BYTES
        while look < n - BLOCK_BYTES:
            gap = np.flatnonzero(table[buf[look : look + BLOCK_BYTES]] == 0)
            look += int(gap[0]) if len(gap) else BLOCK_BYTES
            if len(gap):
                cuts.append(look)
                look += BLOCK_BYTES
        if len(cuts) > 1:
            parts = []
            for lo, hi in zip(cuts, [*cuts[1:], n]):
                inner = offs[(offs > lo) & (offs < hi)] - lo
                _, h, s, e = _words(buf[lo:hi], np.concatenate([[0], inner, [hi - lo]]), table)
                parts.append((h, s + lo, e + lo))
            h, s, e = (np.concatenate(x) for x in zip(*parts))
            return np.searchsorted(offs, s, "right") - 1, h, s, e
    return _words(buf, offs, table)


def _words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, np.zeros(0, np.uint64), e, e
    low = table[buf]
    inside = low > 0
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(low.astype(np.uint64) * powers(BASE, n), out=prefix[1:])
    h = mix((prefix[e] - prefix[s]) * powers(INVERSE, n)[s])
    return np.searchsorted(offs, s, "right") - 1, h, s, e


def shapes(buf: np.ndarray, offs: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of each token's shape: letter case, digits and marks, with runs of one kind counted once."""
    n = len(buf)
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    kind = SHAPE[buf]
    keep = np.ones(n, dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[s] = True
    rank = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(keep, out=rank[1:])
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(np.where(keep, kind.astype(np.uint64) * powers(BASE, n + 1)[rank[:-1]], 0), out=prefix[1:], dtype=np.uint64)
    return mix((prefix[e] - prefix[s]) * powers(INVERSE, n + 1)[rank[s]], 7)


def distinct(row: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (row, value) with their counts; value below 2**bits, row below 2**(64-bits)."""
    key = np.sort((row.astype(np.uint64) << np.uint64(bits)) | value)
    if len(key) == 0:
        return row[:0], value[:0], row[:0]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(bits)).astype(np.int64), key & np.uint64((1 << bits) - 1), count


def row_sums(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=value, minlength=n) if len(row) else np.zeros(n)
