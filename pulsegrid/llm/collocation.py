"""Collocations from a weighted de Bruijn graph of words.

A position of a piece stands for the longest gram that begins there, up to ``longest`` words: as an edge between the two overlapping nodes
one word shorter, or, at a piece's end, as a correction of fewer words.  Equal edges are added up, edges of at least ``least``
occurrences are compacted along unary paths of constant weight, and shorter counts follow downwards: the count of a gram is the flow
out of its node (the edges that begin with it) plus the pieces that end with it.

Two scans of the texts.  The first counts words, and pairs by hash: pairs of fewer than ``least`` occurrences can be in no phrase
sought, so the second cuts pieces there, and only what is left becomes edges.  Which pairs to keep is a bitmap of a fixed
2**27 bits; where two pairs share a bit both are kept, which costs work but changes no count.  A task adds up what it counts and hands it on
as Arrow blocks, one for each part of the hash range; a part is merged where its blocks meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textvec
from .scratch import Scratch
from .tables import small_batches

BREAK, GAP, LETTER = 0, 1, 2
KIND = np.full(256, LETTER, dtype=np.uint8)
KIND[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
KIND[list(b" \t")] = GAP
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
BLOCK_BYTES = 1 << 22
HELD_PAIRS = 1 << 21
HELD_GRAMS = 1 << 20
FILTER_BITS = 27
SEGMENT = 256  # edges of a compacted path in one row


class Block:
    """The words of some rows: ids into ``names``, whether the next word is of the same piece, and the row of each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        kind = KIND[buf]
        letter = kind == LETTER
        letter_edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(buf))]
        cut = np.unique(inner[letter[inner] & letter[inner - 1]])  # words that touch across two rows
        letter_edges = np.sort(np.concatenate([letter_edges, cut, cut]))
        self.start, end = letter_edges[::2], letter_edges[1::2]
        self.size = end - self.start
        self.row = np.searchsorted(offs, self.start, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == BREAK), self.start)
        self.joined = np.zeros(len(self.start), dtype=bool)
        self.joined[:-1] = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])
        self.body = FOLD[buf[letter]]
        words = pa.LargeStringArray.from_buffers(len(self.size), pa.py_buffer(np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)), pa.py_buffer(self.body)).dictionary_encode()
        self.ids, self.names = words.indices.to_numpy().astype(np.int64), words.dictionary

    def grams(self, first: np.ndarray, words: np.ndarray) -> pa.Array:
        """Space-joined texts of so many words from word ``first`` on."""
        at = np.cumsum(self.size) - self.size + np.arange(len(self.size))  # starts when one space parts all words
        spaced = np.full(len(self.body) + len(self.size), 32, dtype=np.uint8)
        spaced[np.arange(len(self.body)) + np.repeat(np.arange(len(self.size)), self.size)] = self.body
        last = first + words - 1
        size = at[last] + self.size[last] - at[first]
        out = np.concatenate([[0], np.cumsum(size)])
        taken = spaced[np.arange(out[-1]) + np.repeat(at[first] - out[:-1], size)]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(out.astype(np.int64)), pa.py_buffer(taken)).cast(pa.string())


def hashes(names: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, equal everywhere."""
    names = names.cast(pa.large_string())
    offs = np.frombuffer(names.buffers()[1], dtype=np.int64)[names.offset : names.offset + len(names) + 1]
    size = np.diff(offs)
    if not len(names) or not size.any():
        return np.zeros(len(names), np.uint64)
    buf = np.frombuffer(names.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
    at = np.arange(len(buf)) - np.repeat(offs[:-1] - offs[0], size)
    value = (buf.astype(np.uint64) + np.uint64(1)) * textvec.powers(textvec.BASE, int(size.max()))[at]
    out = np.zeros(len(names), np.uint64)
    out[size > 0] = np.add.reduceat(value, (offs[:-1] - offs[0])[size > 0])
    return textvec.mix(out, 21)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[Block, np.ndarray, pa.Array]]:
    """(words, code of the language of each, languages) of runs of rows; a single longer text is one block."""
    langs = batch.column("lang").cast(pa.string()).dictionary_encode()
    codes = langs.indices.to_numpy().astype(np.int64)
    for lo, _, buf, offs in textvec.blocks(batch.column("text"), BLOCK_BYTES):
        block = Block(buf, offs)
        if len(block.ids):
            yield block, codes[lo + block.row], langs.dictionary


def pair_hashes(block: Block, lang: np.ndarray, langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first words of pairs within a piece, hash of language and both words)."""
    first = np.flatnonzero(block.joined)
    word, tongue = hashes(block.names), hashes(langs)
    a, b = word[block.ids[first]], word[block.ids[first + 1]]
    return first, textvec.mix(textvec.mix(a, 22) + textvec.mix(b, 23) * np.uint64(3) + textvec.mix(tongue[lang[first]], 24) * np.uint64(5), 25)


def added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their n."""
    if not len(key):
        return key, n
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


class Tally:
    """Counts of a task by (lang, gram), handed on as Arrow blocks by part of the hash range."""

    def __init__(self, parts: int):
        self.parts, self.held, self.rows = parts, [], 0

    def add(self, lang: pa.Array, gram: pa.Array, n: np.ndarray) -> None:
        self.held.append(pa.table({"lang": lang.cast(pa.string()), "gram": gram.cast(pa.string()), "n": pa.array(n, pa.int64())}))
        self.rows += len(n)
        if self.rows > HELD_GRAMS:
            self.held = [summed(self.held)]
            self.rows = len(self.held[0])

    def full(self) -> bool:
        return self.rows > HELD_GRAMS // 2

    def blocks(self) -> tuple[pa.Array, pa.Array]:
        """(part, block) of all that is held, which is then forgotten."""
        table = summed(self.held).combine_chunks()
        part = (hashes(table.column("gram").chunk(0)) % np.uint64(self.parts)).astype(np.int64) if len(table) else np.zeros(0, np.int64)
        order = np.argsort(part, kind="stable")
        table, (found, at) = table.take(pa.array(order)), np.unique(part[order], return_index=True)
        self.held, self.rows = [], 0
        return pa.array(found, pa.int32()), pa.array([packed(table.slice(a, b - a)) for a, b in zip(at, [*at[1:], len(table)])], pa.binary())


def summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "gram"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["lang", "gram", "n"])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def merged(key: tuple, table: pa.Table) -> pa.Table:
    """For applyInArrow by part: (lang, gram, words, n) of its blocks."""
    out = summed([pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("block").combine_chunks()])
    words = pc.add(pc.count_substring(out.column("gram"), " "), 1).cast(pa.int32())
    return pa.table({"lang": out.column("lang"), "gram": out.column("gram"), "words": words, "n": out.column("n")})


MERGED = "lang string, gram string, words int, n long"


def counting(slice_bits: int, parts: int) -> Callable:
    """For mapInArrow: rows (part, block) with counted words, and rows (slice, pairs) with hashed pairs of a part of the hash range."""

    def rows(height: int, **cols) -> pa.RecordBatch:
        kinds = {"part": pa.int32(), "block": pa.binary(), "slice": pa.int32(), "pairs": pa.binary()}
        return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(height, t)) for c, t in kinds.items()], names=list(kinds))

    def words(tally: Tally) -> pa.RecordBatch:
        part, block = tally.blocks()
        return rows(len(part), part=part, block=block)

    def pairs(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = (key >> np.uint64(64 - slice_bits)).astype(np.int64)
        rest = ((key << np.uint64(slice_bits)) >> np.uint64(32)).astype("<u4")
        n = np.minimum(n, 2**32 - 1).astype("<u4")
        found, at = np.unique(part, return_index=True)
        ends = [*at[1:], len(part)]
        return rows(len(found), slice=pa.array(found, pa.int32()), pairs=pa.array([rest[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, tally = [], 0, Tally(parts)
        for batch in batches:
            for block, lang, langs in blocks(batch):
                key, n = np.unique(lang * len(block.names) + block.ids, return_counts=True)
                tally.add(langs.take(pa.array(key // len(block.names))), block.names.take(pa.array(key % len(block.names))), n)
                _, pair = pair_hashes(block, lang, langs)
                held.append(added(pair, np.ones(len(pair), np.int64)))
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    held = [added(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield pairs(*held[0])
                        held, size = [], 0
                if tally.full():
                    yield words(tally)
        if size:
            yield pairs(*added(*map(np.concatenate, zip(*held))))
        if tally.rows:
            yield words(tally)

    return run


def frequent(least: int, slice_bits: int) -> Callable:
    """For applyInArrow by slice: the bits of the pairs of at least so many occurrences."""
    bits = FILTER_BITS - slice_bits

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rest, n = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for blob in table.column("pairs").to_pylist():
            both = np.frombuffer(blob, "<u4")
            rest.append(both[: len(both) // 2])
            n.append(both[len(both) // 2 :].astype(np.int64))
        rest, n = added(np.concatenate(rest), np.concatenate(n))
        mask = np.zeros(1 << bits, dtype=bool)
        mask[rest[n >= least] >> np.uint32(32 - bits)] = True
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())})

    return run


def edges(kept, longest: int, parts: int) -> Callable:
    """For mapInArrow: rows (part, block) with counts of the longest gram of each position after pieces are cut at pairs that ``kept`` lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, tally = np.frombuffer(kept.value, np.uint8), Tally(parts)
        for batch in batches:
            for block, lang, langs in blocks(batch):
                first, pair = pair_hashes(block, lang, langs)
                bit = pair >> np.uint64(64 - FILTER_BITS)
                more = np.zeros(len(block.ids) + longest, dtype=np.int64)
                more[first] = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                ahead = np.zeros_like(more)
                for _ in range(longest - 1):
                    ahead[:-1] = more[:-1] * (1 + ahead[1:])
                at = np.flatnonzero(ahead)
                if not len(at):
                    continue
                words, ids = ahead[at] + 1, np.concatenate([block.ids + 1, np.zeros(longest, np.int64)])
                key = lang[at]
                for k in range(longest):
                    key = key * (len(block.names) + 1) + np.where(words > k, ids[at + k], 0)
                    _, where, key, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                at, words = at[where], words[where]
                tally.add(langs.take(pa.array(lang[at])), block.grams(at, words), n)
                if tally.full():
                    yield pa.RecordBatch.from_arrays(list(tally.blocks()), names=["part", "block"])
        if tally.rows:
            yield pa.RecordBatch.from_arrays(list(tally.blocks()), names=["part", "block"])

    return run


def shorter(side: int) -> str:
    """SQL for a gram without its last (side 1) or first (side -1) word."""
    return f"substring_index(gram, ' ', {side} * (size(split(gram, ' ')) - 1))"


def compacted(heavy: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """(lang, n, words): edges (lang, gram, n) joined along nodes with one edge in and one out of equal n; SEGMENT edges to a row.

    Every edge looks for the head of its path by pointer doubling.  Edges on a cycle find none and stay single.
    """
    node = longest - 1
    ends = heavy.select("*", F.substring_index("gram", " ", node).alias("tail"), F.substring_index("gram", " ", -node).alias("tip"))
    into = ends.groupBy("lang", F.col("tip").alias("node")).agg(F.count("*").alias("c"), F.max("gram").alias("up"), F.max("n").alias("n")).where("c = 1").drop("c")
    out = ends.groupBy("lang", F.col("tail").alias("node")).agg(F.count("*").alias("c"), F.max("gram").alias("gram"), F.max("n").alias("n")).where("c = 1").drop("c")
    links = into.join(out, ["lang", "node", "n"]).where("up <> gram").select("lang", "gram", "up")
    far = heavy.join(links, ["lang", "gram"], "left").select("lang", "gram", "n", F.coalesce("up", "gram").alias("head"), F.col("up").isNotNull().cast("long").alias("rank"))
    far, reach, linked = scratch.save(far, "links"), 1, None
    while True:
        moving = far.where("rank > 0").count() if linked is None else far.where("moving").count()
        linked = moving if linked is None else linked
        if not moving or reach > linked:
            break
        to = far.select("lang", F.col("gram").alias("head"), F.col("head").alias("_head"), F.col("rank").alias("_rank"))
        next_ = far.join(to, ["lang", "head"]).select("lang", "gram", "n", F.col("_head").alias("head"), (F.col("rank") + F.col("_rank")).alias("rank"), (F.col("_rank") > 0).alias("moving"))
        far, reach = scratch.save(next_, "doubled"), reach * 2
    lone = F.col("moving") if moving else F.lit(False)
    far = far.withColumn("head", F.when(lone, F.col("gram")).otherwise(F.col("head"))).withColumn("rank", F.when(lone, 0).otherwise(F.col("rank")))
    runs = far.groupBy("lang", "head", F.floor(F.col("rank") / SEGMENT).alias("part")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("run"))
    rest = F.transform(F.slice("run", F.lit(2), F.size("run")), lambda e: F.substring_index(e["gram"], " ", -1))
    return runs.select("lang", "n", F.concat(F.split(F.col("run")[0]["gram"], " "), rest).alias("words"))


class Graph:
    """Counts of the phrases of ``docs`` by language: ``paths``, ``totals`` and ``levels``, the grams of 1 to ``longest`` words.

    Grams of two words and more are whole where they have ``least`` occurrences; rarer ones may be missing.
    """

    def __init__(self, docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text"):
        spark = docs.sparkSession
        small_batches(spark)
        scratch = Scratch(spark, "phrases")
        texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.length("text") > 0)
        shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
        bits, parts = min(16, max(6, shuffles.bit_length())), 4 * shuffles
        counted = scratch.save(texts.mapInArrow(counting(bits, parts), "part int, block binary, slice int, pairs binary"), "counted")
        words = counted.where("part is not null").select("part", "block").groupBy("part").applyInArrow(merged, MERGED).drop("words")
        words = scratch.save(words, "words")
        self.totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
        masks = counted.where("slice is not null").select("slice", "pairs").groupBy("slice").applyInArrow(frequent(least, bits), "slice int, bits binary")
        empty = bytes((1 << FILTER_BITS - bits) // 8)
        found = {r["slice"]: bytes(r["bits"]) for r in masks.collect()}  # 2**27 bits together, whatever the input
        kept = spark.sparkContext.broadcast(b"".join(found.get(k, empty) for k in range(1 << bits)))
        grams = texts.mapInArrow(edges(kept, longest, parts), "part int, block binary").groupBy("part").applyInArrow(merged, MERGED)
        grams = scratch.save(grams, "grams")
        scratch.drop(counted)
        whole = grams.where(F.col("words") == longest).drop("words")
        self.paths = scratch.save(compacted(whole.where(F.col("n") >= least), longest, scratch), "paths")
        on_path = self.paths.select("lang", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - longest + 1)).alias("at"))
        on_path = on_path.select("lang", F.array_join(F.slice("words", F.col("at"), F.lit(longest)), " ").alias("gram"), "n")
        self.levels = {1: words, longest: on_path}
        above = on_path.unionByName(whole.where(F.col("n") < least))
        for k in range(longest - 1, 1, -1):
            flow = above.select("lang", F.substring_index("gram", " ", k).alias("gram"), "n")
            above = self.levels[k] = scratch.save(flow.unionByName(grams.where(F.col("words") == k).drop("words")).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"level{k}")
        self.least, self.longest = least, longest

    def phrases(self, k: int) -> DataFrame:
        """(lang, gram, n) of the grams of k words with at least ``least`` occurrences."""
        return self.levels[k].where(F.col("n") >= self.least)


def passages(graph: Graph) -> DataFrame:
    """(lang, passage, words, n): the compacted paths, runs of ``longest`` words and more whose grams all occur n times."""
    return graph.paths.select("lang", F.array_join("words", " ").alias("passage"), F.size("words").alias("words"), "n")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, cover: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    a counts the phrase, l and r its two parts at the cut of lowest score floor(1000 * a * n / (l * r)), ties to the earliest cut, n all words of the language.
    A phrase that a longer one contains with 100 * its count >= ``cover`` * a is dropped: one word longer is enough to look at, as all parts
    of a phrase occur at least as often as it.  A null language is ``und``; null, empty and blank texts have no words; repeated
    rows count as often as they are there; an empty table gives no rows; ids and other columns are ignored.
    """
    graph = Graph(docs, least, longest, lang_col, text_col)
    found = [graph.phrases(k).withColumn("words", F.lit(k)) for k in range(1, longest + 1)]
    every = found[1]
    for more in found[2:]:
        every = every.unionByName(more)
    inner = every.where("words > 2").select("lang", "n", F.expr(f"explode(array({shorter(1)}, {shorter(-1)}))").alias("gram")).groupBy("lang", "gram").agg(F.max("n").alias("over"))
    kept = every.join(inner, ["lang", "gram"], "left").where(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("n"))).select("lang", "gram", F.col("n").alias("a"), "words")
    parts = found[0]
    for more in found[1:-1]:
        parts = parts.unionByName(more)
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(gram, ' ', cut)"), "right": F.expr("substring_index(gram, ' ', cut - words)")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("gram").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr("(1000 * cast(a as decimal(19, 0)) * cast(total as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.join(graph.totals, "lang").select("lang", F.col("gram").alias("phrase"), "a", F.struct(score.cast("long").alias("score"), "cut", "l", "r", F.col("total").alias("n")).alias("best"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min("best").alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
