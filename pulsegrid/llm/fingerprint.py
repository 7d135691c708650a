"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraph pieces: at line ends, at sentence ends and bars, and after eight words.  Each piece's
digest, with its occurrence number mixed in, goes to three cells that hold a count and a sum of digests; sixteen bits of
a digest check the others.  Two sketches of one size subtract cell by cell; what both texts share cancels, and cells that
hold one digest are peeled until nothing is left: the digests of either text alone are then known.

The size follows the number of pieces, and is raised until the sketch can be peeled by itself.  So a fingerprint alone
gives back its digests, and any two can be compared from their strings (``likeness``): those of one size are subtracted and
peeled; if that fails or the sizes differ, both are peeled, built again as one larger size and subtracted, larger again after a
failure.  With d differing digests of n and m, the likeness is their Jaccard index (n + m - d) / (n + m + d).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .tables import small_batches

SIZES = np.array([3, 6, 9, *(3 * x << k for k in range(40) for x in (4, 5, 6, 7))])  # cells
VALUE = np.uint64((1 << 48) - 1)  # the bits of a digest that its upper ones check
PIECE_WORDS = 8
BLOCK_CHARS = 1 << 20
ENDS = np.zeros(256, dtype=bool)
ENDS[list(b".!?|;:")] = True

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(digests, offsets by text) of all paragraph pieces; repeats within a text get digests of their own."""
    found_rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, _, buf, offs in textvec.blocks(pa.array(texts, pa.large_string())):
        row, h, s, e = textvec.words(buf, offs, textvec.TOKEN)
        n = len(h)
        if not n:
            continue
        lines = np.concatenate([[0], np.cumsum(buf == 10)])[s]
        new = np.ones(n, dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (lines[1:] != lines[:-1]) | ENDS[buf[e[:-1] - 1]]
        at = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        start = np.flatnonzero(at % PIECE_WORDS == 0)
        digest = textvec.mix(np.add.reduceat(h * textvec.powers(textvec.BASE, PIECE_WORDS)[at % PIECE_WORDS], start), 11)
        row = row[start]
        order = np.lexsort((digest, row))
        d, r = digest[order], row[order]
        k = np.arange(len(d))
        first = np.ones(len(d), dtype=bool)
        first[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
        again = (k - np.maximum.accumulate(np.where(first, k, 0))).astype(np.uint64)
        value = textvec.mix(d + again * np.uint64(0xD6E8FEB86659FD93), 12) & VALUE
        order = np.lexsort((value, r))
        value, r = value[order], r[order]
        one = np.ones(len(r), dtype=bool)
        one[1:] = (value[1:] != value[:-1]) | (r[1:] != r[:-1])
        found.append(checked(value[one]))
        found_rows.append(r[one] + lo)
    rows = np.concatenate(found_rows)
    return np.concatenate(found), np.searchsorted(rows, np.arange(len(texts) + 1))


def checked(value: np.ndarray) -> np.ndarray:
    """48 bits with 16 that check them above."""
    return value | (textvec.mix(value, 13) & ~VALUE)


def cells_of(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The three cells, one in each third of the size."""
    third = (size // 3).astype(np.uint64)
    return np.stack([((textvec.mix(key, 14 + j) >> np.uint64(32)) * third >> np.uint64(32)) + np.uint64(j) * third for j in range(3)]).astype(np.int64)


def enough(digests: np.ndarray) -> np.ndarray:
    """The least size that is likely to be peeled of so many digests."""
    return SIZES[np.searchsorted(SIZES, 1.3 * digests + 2)]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Sketches:
    """Sketches of the given sizes, cell by cell: count and sum of digests modulo 2**64."""

    def __init__(self, size: np.ndarray):
        self.size = size.astype(np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.count, self.key = np.zeros(self.size.sum(), np.int64), np.zeros(self.size.sum(), np.uint64)

    def add(self, which: np.ndarray, key: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Add (or with sign -1 take away) digests to sketches; the cells touched."""
        at = (cells_of(key, self.size[which]) + self.base[which]).ravel()
        wide = sign.astype(np.int64)
        np.add.at(self.count, at, np.tile(wide, 3))
        np.add.at(self.key, at, np.tile(key * wide.view(np.uint64), 3))
        return at

    def text(self, i: int) -> str:
        part = slice(self.base[i], self.base[i] + self.size[i])
        return base64.b64encode(self.count[part].astype("<i2").tobytes() + self.key[part].astype("<u8").tobytes()).decode()

    @staticmethod
    def read(text: str) -> Sketches:
        raw = base64.b64decode(text)
        out = Sketches(np.array([len(raw) // 10]))
        out.count, out.key = np.frombuffer(raw, "<i2", len(raw) // 10).astype(np.int64), np.frombuffer(raw, "<u8", offset=len(raw) // 5).copy()
        return out

    def minus(self, a: np.ndarray, b: np.ndarray) -> Sketches:
        """Sketches a[i] less b[i], which are of one size."""
        out = Sketches(self.size[a])
        x, y = spans(self.base[a], out.size), spans(self.base[b], out.size)
        out.count, out.key = self.count[x] - self.count[y], self.key[x] - self.key[y]
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which sketch, digest, sign) recovered, and by sketch whether nothing is left; empties the sketches."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        got: list[tuple] = []
        at = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(64 + 4 * int(self.size.max(initial=0))):
            at = at[np.abs(self.count[at]) == 1]
            sign, which = self.count[at], owner[at]
            key = self.key[at] * sign.view(np.uint64)
            pure = checked(key & VALUE) == key
            pure &= (cells_of(key, self.size[which]) == at - self.base[which]).any(axis=0)
            key, sign, which = key[pure], sign[pure], which[pure]
            if not len(key):
                break
            order = np.lexsort((key, which))
            which, key, sign = which[order], key[order], sign[order]
            one = np.ones(len(key), dtype=bool)
            one[1:] = (key[1:] != key[:-1]) | (which[1:] != which[:-1])
            which, key, sign = which[one], key[one], sign[one]
            got.append((which, key, sign))
            at = self.add(which, key, -sign)  # a cell may come twice; its digest is then taken once
        clean = np.bincount(owner[(self.count != 0) | (self.key != 0)], minlength=len(self.size)) == 0
        parts = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return (*parts, clean)


def sketch(digests: np.ndarray, offs: np.ndarray, which: np.ndarray, size: np.ndarray) -> Sketches:
    """Sketches of the sets ``which``, of the given sizes."""
    many = np.diff(offs)[which]
    out = Sketches(size)
    out.add(np.repeat(np.arange(len(which)), many), digests[spans(offs[which], many)], np.ones(many.sum(), np.int64))
    return out


def prints(digests: np.ndarray, offs: np.ndarray) -> Sketches:
    """The fingerprint of every set: the smallest size from which it can be peeled alone, from ``enough`` on."""
    size = enough(np.diff(offs))
    todo = np.arange(len(size))
    while len(todo):
        todo = todo[~sketch(digests, offs, todo, size[todo]).peel()[3]]
        size[todo] = SIZES[np.searchsorted(SIZES, size[todo]) + 1]
    return sketch(digests, offs, np.arange(len(size)), size)


def differences(digests: np.ndarray, offs: np.ndarray, a: np.ndarray, b: np.ndarray, base: Sketches) -> np.ndarray:
    """Size of the symmetric difference of sets a[i] and b[i], by subtracting and peeling, larger after a failure."""
    out = np.full(len(a), -1, dtype=np.int64)
    many = np.diff(offs)

    def settle(todo: np.ndarray, gap: Sketches) -> None:
        which, _, _, clean = gap.peel()
        out[todo[clean]] = np.bincount(which, minlength=len(todo))[clean]

    same = np.flatnonzero((base.size[a] == base.size[b]) & (np.abs(many[a] - many[b]) <= base.size[a]))
    settle(same, base.minus(a[same], b[same]))
    todo = np.flatnonzero(out < 0)
    size = enough(many[a] + many[b])
    while len(todo):
        n = len(todo)
        settle(todo, sketch(digests, offs, np.concatenate([a[todo], b[todo]]), np.tile(size[todo], 2)).minus(np.arange(n), np.arange(n) + n))
        todo = todo[out[todo] < 0]
        size[todo] = SIZES[np.searchsorted(SIZES, size[todo]) + 1]
    return out


def jaccard(n: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of sets of n and m with d differing; two empty sets are alike 1."""
    return np.where(n + m > 0, (n + m - d) / np.maximum(n + m + d, 1), 1.0)


def digests_of(fingerprint: str) -> np.ndarray:
    """The paragraph digests that a fingerprint holds."""
    return Sketches.read(fingerprint).peel()[1]


def likeness(one: str, other: str) -> float:
    """Of two fingerprints, from their strings alone."""
    a, b = Sketches.read(one), Sketches.read(other)
    x, y = digests_of(one), digests_of(other)
    base = Sketches(np.concatenate([a.size, b.size]))
    base.count, base.key = np.concatenate([a.count, b.count]), np.concatenate([a.key, b.key])
    d = differences(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), np.array([0]), np.array([1]), base)
    return float(jaccard(np.array(len(x)), np.array(len(y)), d)[0])


def edit(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many characters, or all, from the start of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare(texts: list[str]) -> list[tuple]:
    """The output columns after doc_id for texts[:-1], each with its successor."""
    n = len(texts) - 1
    edited = [edit(t, f) for t, f in zip(texts, texts[1:])]
    digests, offs = pieces(texts + edited)
    base = prints(digests, offs)
    i = np.arange(n)
    a, b = np.concatenate([i, i]), np.concatenate([i + n + 1, i + 1])
    d = differences(digests, offs, a, b, base)
    like = jaccard(np.diff(offs)[a], np.diff(offs)[b], d)
    return [(len(texts[j]), hashlib.sha256(edited[j].encode()).hexdigest(), base.text(j), base.text(n + 1 + j), float(like[j]), float(like[n + j])) for j in range(n)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, chars, bucket = [], [], 0, None  # rows of a bucket whose successor may still come

    def flush(following: str | None) -> pa.RecordBatch:
        """Results of all held rows but the last, or of all if what follows it is given."""
        nonlocal ids, texts, chars
        if following is not None:
            done, rows, ids, texts = ids, compare([*texts, following]), [], []
        else:
            done, rows, ids, texts = ids[:-1], compare(texts), ids[-1:], texts[-1:]
        chars = len(texts[0]) if texts else 0
        return pa.RecordBatch.from_arrays([pa.array(list(c), f) for c, f in zip(zip(*((i, *r) for i, r in zip(done, rows))), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=SCHEMA.names)

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for doc, text, ob, halo in zip(*(part.column(k).to_pylist() for k in range(4))):
                if halo:
                    if ids and ob == bucket:  # the first halo row of the bucket ends it
                        yield flush(text or "")
                    continue
                bucket = ob
                ids.append(doc)
                texts.append(text or "")
                chars += len(texts[-1])
                if chars > BLOCK_CHARS and len(ids) > 1:
                    yield flush(None)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, buckets_per_part: int = 4) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller id, after the last the first; null ids come last and equal ids
    in order of text.  A null text counts as empty; two texts without a word are alike 1.0; an empty table gives no
    rows; other columns are ignored.  Ids are cut into ranges by quantiles; a range gets, besides its rows, a
    copy of the row that follows it, so every text is shuffled once and a task never needs another's rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * buckets_per_part
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_k"))
    rows = rows.withColumn("_d", F.col("_k").cast("double"))
    cuts = rows.agg(F.percentile_approx("_d", F.lit([i / n for i in range(1, n)]) if n > 1 else F.lit([0.5]), 100 * n)).first()[0]
    if not cuts:
        return spark.createDataFrame([], SCHEMA)
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_d", outputCol="_b").transform(rows).withColumn("_ob", (F.lit(len(splits)) - F.col("_b")).cast("int"))
    heads = sorted((r["_ob"], r["head"]) for r in rows.groupBy("_ob").agg(F.max("_k").alias("head")).collect())  # one row per range
    before = [heads[i - 1][0] for i in range(len(heads))]
    marks = spark.createDataFrame([(h, p) for (_, h), p in zip(heads, before)], "_k long, _before int")
    dealt = rows.join(F.broadcast(marks), "_k", "left").withColumn("_to", F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_ob").alias("ob"), F.lit(False).alias("halo")))).otherwise(F.array(F.struct(F.col("_ob").alias("ob"), F.lit(False).alias("halo")), F.struct(F.col("_before").alias("ob"), F.lit(True).alias("halo")))))
    dealt = dealt.select("doc_id", "text", "_k", F.explode("_to").alias("_to")).select("doc_id", "text", "_to.ob", "_to.halo", "_k")
    dealt = dealt.repartition(parts, "ob").sortWithinPartitions("ob", "halo", F.col("_k").desc(), "text")
    return dealt.select("doc_id", "text", "ob", "halo").mapInArrow(_run, SCHEMA)
