"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A text is a weighted set: its shingles of five words with their counts.  Every shingle of weight w is a Poisson
process of rate w, seeded by its hash, whose arrivals fall on random registers; a register keeps the
earliest arrival.  Two texts agree in a register with the probability Jaccard similarity of their weighted
sets.  A shingle's arrivals come in order of time, so it is dropped once it is later than all registers.

1. One scan gives each text's digest, band keys and 16-bit register values.  Equal texts are one row from here.
2. Texts that share a band key are compared by registers within the task that holds their bucket; only links that
   join parts not yet joined there (a forest, fewer than the rows) are emitted.  Large buckets are cut into blocks.  A block
   is compared with the bucket's least text and within itself; only what is not joined to the least text by then
   meets the other blocks.  So no link is lost, none is hot, and a row of a large group of copies is sent about once.
3. Components of these links are families.  The families' texts are read again and compared exactly, in blocks of bounded
   bytes likewise, and again a forest of the links at or above the similarity is emitted.
4. Components of the exact links are the classes.

Step 2 lets pairs through far below the similarity (``slack``), so a family holds every link its members have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .components import components
from .scratch import Scratch
from .tables import columns, small_batches


BROADCAST_ROWS = 500_000
BROADCAST_SLICES = 8


@dataclass(frozen=True)
class Params:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5
    slack: float = 0.17  # registers may agree this much less than the similarity: over four standard deviations
    block: int = 512  # texts compared at once
    block_bytes: int = 4 << 20  # and their size

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 44-bit shingle, count), sorted; a text of fewer than k words is one shingle of all of them."""
    row, h, _, _ = textvec.words(buf, offs)
    n = len(offs) - 1
    many = np.bincount(row, minlength=n)
    parts_row, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(h) >= k:
        power = textvec.powers(textvec.BASE, k)
        value = sum(h[j : len(h) - k + 1 + j] * power[j] for j in range(k))
        whole = row[: len(h) - k + 1] == row[k - 1 :]
        parts_row.append(row[: len(h) - k + 1][whole])
        parts.append(textvec.mix(value[whole], 21))
    short = np.flatnonzero((many > 0) & (many < k))
    if len(short):
        begin = np.cumsum(many) - many
        for i in short:
            w = h[begin[i] : begin[i] + many[i]]
            parts_row.append(np.array([i]))
            parts.append(textvec.mix((w * textvec.powers(textvec.BASE, k)[: len(w)]).sum(keepdims=True, dtype=np.uint64), 22))
    return textvec.distinct(np.concatenate(parts_row), np.concatenate(parts) >> np.uint64(20), 44)


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the high bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m register values: the 32-bit mark of the shingle that arrived first; ~0 where nothing did.

    Round r takes every shingle's r-th arrival; shingles later than all registers of their text drop out.
    Time and mark share a word, the time's bits above (a positive float's bits order as it does).
    """
    best = np.full(n * m, np.uint64(2**64 - 1))
    time = np.zeros(len(element))
    weight = weight.astype(np.float64)
    r = 0
    while len(element):
        draw = textvec.mix(element, 100 + r)
        time = time - np.log(uniform(draw)) / weight
        at = row * m + ((textvec.mix(draw, 31) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        word = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (textvec.mix(element, 32) >> np.uint64(32))
        np.minimum.at(best, at, word)
        latest = (best.reshape(n, m).max(axis=1) >> np.uint64(32)).astype(np.uint32)
        late = latest.view(np.float32).astype(np.float64)
        late[latest == 2**32 - 1] = np.inf
        keep = time < late[row]
        row, element, weight, time = row[keep], element[keep], weight[keep], time[keep]
        r += 1
    return (best.reshape(n, m) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared i of 1 / sum over j of max(x[j] / x[i], y[j] / y[i]), by order of the ratio x / y."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    # j with a ratio at or above i's counts by x, below by y
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])[np.searchsorted(ratio, ratio, "left")]
    below = np.concatenate([[0.0], np.cumsum(y)])[np.searchsorted(ratio, ratio, "left")]
    return float((1 / ((above + only_x) / x + (below + only_y) / y)).sum())


class Forest:
    """Union-find over places 0..n-1 that tells whether a link joined anything."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def labels(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def likely_pairs(sig: np.ndarray, which: np.ndarray, to: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of a row of ``which`` and one for which ``to`` holds, most alike first, whose registers agree in at least this share."""
    out = []
    for i in which:
        same = (sig == sig[i]).mean(axis=1)
        ok = (same >= least) & to
        ok[i] = False
        out += [(s, int(i), int(j)) for j, s in zip(np.flatnonzero(ok), same[ok])]
    return [(i, j) for _, i, j in sorted(out, key=lambda p: (-p[0], p[1], p[2]))]


SIGNATURE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("doc", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()), T.StructField("size", T.LongType())])


def _sign(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids, texts = batch.columns
            for lo, hi, buf, offs in textvec.blocks(texts):
                row, element, count = shingles(buf, offs, p.words)
                full = signatures(row, element, count, hi - lo, p.registers)
                power = textvec.powers(textvec.BASE, p.rows)
                keys = textvec.mix((full.reshape(hi - lo, p.bands, p.rows).astype(np.uint64) * power).sum(axis=2, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 33).view(np.int64)
                some = np.bincount(row, minlength=hi - lo) > 0
                small = (full & np.uint32(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays([digests.slice(lo, hi - lo), ids.slice(lo, hi - lo), pa.array([k if s else [] for k, s in zip(keys, some)], pa.list_(pa.int64())), pa.array([s.tobytes() for s in small], pa.binary()), pa.array(np.diff(offs))], names=SIGNATURE.names)

    return run


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first ``keys`` columns, from sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:keys] != r[:keys]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


LINK = "a long, b long, rest boolean"
BLOCK, LEAST, REST, ANY = 2, 3, 0, 1  # roles of a row


def _links(decide):
    """From sorted rows (key, i, j, role, id, payload): links (a, b), and as (key, id) what a block leaves to compare with others.

    ``decide(group, forest, which, to)`` joins rows of ``which`` and rows for which ``to`` holds, and gives the joins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            cols = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "rest"])

        for group in in_groups(batches, 3):
            group = [r for k, r in enumerate(group) if not k or r[3:5] != group[k - 1][3:5]]  # repeated rows
            role, ids = np.array([r[3] for r in group]), [r[4] for r in group]
            forest = Forest(len(group))
            if role[0] == REST:  # against another block
                decide(group, forest, np.flatnonzero(role == REST), role == ANY, out)
            else:
                every = np.ones(len(group), dtype=bool)
                if len(group) > 1:
                    decide(group, forest, np.zeros(1, np.int64), every, out)
                apart = np.array([k for k in range(1, len(group)) if forest.root(k)], dtype=np.int64)
                if len(apart):
                    decide(group, forest, apart, every, out)
                if role[0] == LEAST:
                    out += [(group[0][0], ids[k], True) for k in apart.tolist() if forest.root(k)]
            if len(out) > 50_000:
                yield table()
        yield table()

    return run


def _bucket_links(p: Params):
    """Joins by registers; the payload is a signature."""
    least = p.similarity - p.slack

    def decide(group: list[tuple], forest: Forest, which: np.ndarray, to: np.ndarray, out: list[tuple]) -> None:
        sig = np.frombuffer(b"".join(r[5] for r in group), "<u2").reshape(len(group), -1)
        out += [(group[i][4], group[j][4], False) for i, j in likely_pairs(sig, which, to, least) if group[i][4] != group[j][4] and forest.join(i, j)]

    return _links(decide)


class Overlaps:
    """The shingles of a group of texts, and for pairs of them a bound of the similarity that is exact where no shingle repeats in either."""

    COLUMNS, FEW = 4096, 64  # dense columns at once; texts up to which a shingle's pairs are listed

    def __init__(self, texts: list[str], k: int):
        rows, elements, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, _, buf, offs in textvec.blocks(pa.array(texts, pa.large_string())):
            row, element, count = shingles(buf, offs, k)
            rows.append(row + lo)
            elements.append(element)
            counts.append(count)
        self.n, self.row, self.count = len(texts), np.concatenate(rows), np.concatenate(counts).astype(np.float64)
        self.begin = np.searchsorted(self.row, np.arange(self.n + 1))
        self.element = np.unique(np.concatenate(elements), return_inverse=True)[1]
        self.total = np.bincount(self.row, weights=self.count, minlength=self.n)
        self.repeats = np.bincount(self.row[self.count > 1], minlength=self.n) > 0

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.begin[i], self.begin[i + 1])
        return self.element[part], self.count[part]

    def shared(self, which: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matrices which x to: shared shingles, and the sums of either side's counts of them."""
        place = np.full((2, self.n), -1)
        place[0, which], place[1, to] = np.arange(len(which)), np.arange(len(to))
        sides = [np.flatnonzero(p[self.row] >= 0) for p in place]
        df = np.stack([np.bincount(self.element[s], minlength=self.element.max(initial=0) + 1) for s in sides])
        met = (df > 0).all(axis=0)
        out = np.zeros((3, len(which), len(to)))
        few = met & (df.max(axis=0) <= self.FEW)
        a, b = (s[few[self.element[s]]] for s in sides)
        b = b[np.argsort(self.element[b], kind="stable")]
        low, high = (np.searchsorted(self.element[b], self.element[a], side) for side in ("left", "right"))
        for lo in range(0, len(a), 1 << 15):  # at most FEW pairs each
            some = slice(lo, lo + (1 << 15))
            left, right = np.repeat(a[some], (high - low)[some]), b[spans(low[some], (high - low)[some])]
            cell = place[0, self.row[left]] * len(to) + place[1, self.row[right]]
            for k, weight in enumerate((None, self.count[left], self.count[right])):
                out[k] += np.bincount(cell, weights=weight, minlength=out[k].size).reshape(out[k].shape)
        many = np.flatnonzero(met & ~few)
        a, b = (s[np.isin(self.element[s], many)] for s in sides)
        weighted = bool((self.count[a] > 1).any() or (self.count[b] > 1).any())
        for lo in range(0, len(many), self.COLUMNS):
            chunk = many[lo : lo + self.COLUMNS]
            dense = []
            for p, s in zip(place, (a, b)):
                s = s[(self.element[s] >= chunk[0]) & (self.element[s] <= chunk[-1])]
                at = p[self.row[s]], np.searchsorted(chunk, self.element[s])
                ones = np.zeros((int(p.max()) + 1, len(chunk)), np.float64 if weighted else np.float32)
                counts = np.zeros_like(ones) if weighted else None
                ones[at] = 1
                if weighted:
                    counts[at] = self.count[s]
                dense.append((ones, counts))
            (one_a, n_a), (one_b, n_b) = dense
            both = one_a @ one_b.T
            out[0] += both
            out[1] += n_a @ one_b.T if weighted else both
            out[2] += one_a @ n_b.T if weighted else both
        return out[0], out[1], out[2]

    def bounds(self, which: np.ndarray, to: np.ndarray) -> np.ndarray:
        """At least the probability Jaccard similarity of every pair.

        A shared i adds at most max(x[i], y[i]) / sum over j of max(x[j], y[j]); the maximum is at most x[i] + y[i] - 1.
        """
        common, x, y = self.shared(which, to)
        most = x + y - common
        return most / np.maximum(self.total[which][:, None] - x + self.total[to][None, :] - y + most, 1e-9)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _exact_links(p: Params):
    """Joins by exact similarity; the payload is a text.  Pairs are ruled out by the bound, whole blocks at a time."""
    last: list = [None, None]  # the group whose shingles are at hand

    def decide(group: list[tuple], forest: Forest, which: np.ndarray, to: np.ndarray, out: list[tuple]) -> None:
        if last[0] is not group:
            last[:] = group, Overlaps([r[5] for r in group], p.words)
        sets = last[1]
        others = np.flatnonzero(to)
        near = sets.bounds(which, others) >= p.similarity - 1e-12
        near &= ~(np.isin(others, which)[None, :] & (others[None, :] <= which[:, None]))  # each unordered pair once
        for a, b in np.argwhere(near).tolist():
            i, j = int(which[a]), int(others[b])
            if group[i][4] == group[j][4] or forest.root(i) == forest.root(j):
                continue
            if not (sets.repeats[i] or sets.repeats[j]) or probability_jaccard(sets.of(i), sets.of(j)) >= p.similarity:
                forest.join(i, j)
                out.append((group[i][4], group[j][4], False))

    return _links(decide)


def compared(members: DataFrame, payload: str, judge, p: Params, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join all that ``judge`` joins within each key of ``members`` (key, blocks, least, id, payload)."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64(F.lit(41), F.col("id")), F.col("blocks")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)

    def judged(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", F.when(F.col("role") == LEAST, -1).otherwise(F.col("role")), "id")
        return scratch.save(rows.select("key", "i", "j", "role", "id", payload).mapInArrow(judge, LINK), "linked")

    is_least = (F.col("blocks") > 1) & (F.col("id") == F.col("least"))  # it goes to every block of its group
    rows = members.select("key", "id", payload, F.when(is_least, LEAST).otherwise(BLOCK).alias("role"), F.explode(F.when(is_least, upto(F.col("blocks"))).otherwise(F.array(own))).alias("i"), F.lit(-1).alias("j"))
    first = judged(rows)
    links = first.where("not rest").select("a", "b")
    rest = first.where("rest").select(F.col("a").alias("key"), F.col("b").alias("id")).distinct()
    if rest.isEmpty():
        return links
    many = rest.groupBy("key").agg(F.ceil(F.count("*") / p.block).cast("int").alias("parts"))
    members = members.join(many, "key")
    part = F.pmod(F.xxhash64(F.lit(43), F.col("id")), F.col("parts")).cast("int")
    left = members.join(rest, ["key", "id"]).select("key", "id", payload, F.lit(REST).alias("role"), part.alias("i"), F.explode(upto(F.col("blocks"))).alias("j"))
    every = members.select("key", "id", payload, F.lit(ANY).alias("role"), F.explode(upto(F.col("parts"))).alias("i"), own.alias("j"))
    return links.unionByName(judged(left.unionByName(every)).select("a", "b"))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def text_classes(rows: DataFrame, p: Params, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """From (doc, text): (digest, doc) of every row with a text, and of every digest its class.

    The second table is (digest, class_id, class_texts, keeps), keeps marking the digest whose ``least`` is
    the class_id, one per class.
    """
    small_batches(rows.sparkSession)
    hashed = rows.where("text is not null").select(_digest("text").alias("digest"), "doc", "text")
    signed = scratch.save(hashed.mapInArrow(_sign(p), SIGNATURE), "signed")
    texts = signed.groupBy("digest").agg(F.min("doc").alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    texts = scratch.save(texts.withColumn("id", F.monotonically_increasing_id()), "texts")

    def blocks(*enough: Column) -> Column:
        return F.greatest(F.lit(1), *(F.ceil(x).cast("int") for x in enough)).alias("blocks")

    keys = texts.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1").select("key", "least", blocks(F.col("n") / p.block))
    members = keys.join(shared, "key").join(texts.select("id", "sig"), "id").select("key", "blocks", "least", "id", "sig")
    family = components(compared(members, "sig", _bucket_links(p), p, scratch), scratch)

    # the label is the family's least id
    placed = family.join(texts.select("id", "digest", F.col("least").alias("_l"), "size"), "id")
    sizes = placed.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("label", blocks(F.col("n") / p.block, F.col("bytes") / p.block_bytes))
    named = placed.join(sizes, "label").select(F.col("label").alias("key"), "blocks", F.col("label").alias("least"), "id", F.col("digest").alias("_d"), "_l")
    named = scratch.save(named, "named")
    # slices of few rows of 60 bytes, each broadcast to a scan, spare all other texts the exchange; beyond, both sides are exchanged
    slices = -(-named.count() // BROADCAST_ROWS)
    slice_of = F.pmod(F.xxhash64(F.lit(47), "_d"), F.lit(max(1, slices)))
    near = [F.broadcast(named.where(slice_of == k)) for k in range(slices)] if 0 < slices <= BROADCAST_SLICES else [named]
    wanted = [hashed.join(x, (F.col("digest") == F.col("_d")) & F.col("doc").eqNullSafe(F.col("_l"))).select("key", "blocks", "least", "id", "text") for x in near]
    joined = components(compared(reduce(DataFrame.unionByName, wanted), "text", _exact_links(p), p, scratch), scratch)

    placed = texts.select("id", "digest", "least").join(joined, "id", "left").withColumn("label", F.coalesce("label", "id"))
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "id"))
    whole = placed.groupBy("label").agg(best.alias("best"), F.count("*").alias("class_texts"))
    found = placed.join(whole, "label").select("digest", F.col("best.least").alias("class_id"), "class_texts", (F.col("id") == F.col("best.id")).alias("keeps"))
    return signed.select("digest", "doc"), scratch.save(found, "classes")


def classes(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_texts (different texts in its class).

    class_id is the least id in the class.  Equal texts are of one class, whatever they hold; texts without a
    word are alike only if equal; a null text is alike to nothing: its class_id is its own id and class_texts 0.
    Null ids are a class_id only if the class has no other; rows may repeat; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    each, found = text_classes(rows, params, Scratch(docs.sparkSession, "near"))
    out = each.join(found, "digest").select(F.col("doc").alias("doc_id"), "class_id", F.col("class_texts").cast("long").alias("class_texts"))
    return out.unionByName(rows.where("text is null").select(F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("class_texts")))


def keep_one(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each class (that of the least id), all columns; rows with a null text stay."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    _, found = text_classes(rows, params, Scratch(docs.sparkSession, "near"))
    kept = found.where("keeps").select(F.col("digest").alias("_digest"), F.col("class_id").alias("_doc"))
    packed = docs.select(F.struct(*columns(docs)).alias("row"), _digest(text_col).alias("_digest"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_doc"))
    kept = kept.withColumn("_doc", F.coalesce("_doc", F.lit(-(1 << 63))))
    one = packed.where(F.col("row")[text_col].isNotNull()).join(kept, ["_digest", "_doc"], "left_semi").dropDuplicates(["_digest", "_doc"])
    return one.unionByName(packed.where(F.col("row")[text_col].isNull())).select("row.*")
