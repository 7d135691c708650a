"""Language identification by cross-parsing entropy.

Each language's labelled text becomes a suffix automaton, whose paths from the root spell exactly the substrings
of that text.  A document is parsed, from left to right, into phrases: each the longest match in the automaton,
read by walking until no transition is left and starting anew there.  The fewer phrases per byte, the closer the
text; the language needing the fewest wins.  Text is folded to lower-case bytes with everything but letters as
one kind of gap.

A walk is sequential, so many are made in step, as numpy arrays over all languages.  A text is cut into lanes that are
parsed at once, each as if a phrase began with it.  Then the phrase that is open at a lane's end is followed into the
next lane until a phrase begins where one begins there already: from that place on both parses are the same.  Where
they do not meet before the lane ends, the next lane is mended in turn, so the counts are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .tables import small_batches

GAP = 32
STATE_BYTES = 2 * 64 * 4  # of the table by character learned: at most two states, about 64 kinds of bytes of four bytes each


def _fold_table() -> np.ndarray:
    table = np.full(256, GAP, dtype=np.uint8)
    for b in range(256):
        if b >= 128:
            table[b] = b
        elif chr(b).isalpha():
            table[b] = ord(chr(b).lower())
    return table


FOLD = _fold_table()


@dataclass(frozen=True)
class Params:
    max_chars: int = 8_000  # labelled text per language
    sample_rows: int = 150  # labelled documents per language, about
    table_bytes: int = 64 << 20  # of the model; where many languages would pass it, each learns from less text
    lane: int = 512


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:  # q also ends longer substrings that the new position does not: split it
                half = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = half
                    p = link[p]
                link[q] = link[cur] = half
        last = cur
    return nxt


def folded(text: str) -> bytes:
    raw = FOLD[np.frombuffer(text.encode(), dtype=np.uint8)]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != GAP) | (raw[:-1] != GAP)
    return raw[keep].tobytes()


@dataclass(frozen=True)
class Model:
    """``step[state, kind]`` is the next state or -1; ``root[k]`` the root of language k; ``kind`` maps folded bytes."""

    langs: list[str]
    step: np.ndarray
    root: np.ndarray
    kind: np.ndarray
    lane: int

    @staticmethod
    def build(texts: dict[str, bytes], lane: int = 512) -> Model:
        langs = sorted(texts)
        seen = sorted({*b"".join(texts.values())})
        kind = np.zeros(256, dtype=np.uint8)  # 0: a byte that no language has
        kind[seen] = np.arange(1, len(seen) + 1)
        tables, root, n = [], [], 0
        for lang in langs:
            nxt = suffix_automaton(texts[lang])
            table = np.full((len(nxt), len(seen) + 1), -1, dtype=np.int32)
            for state, moves in enumerate(nxt):
                for c, to in moves.items():
                    table[state, kind[c]] = to + n
            root.append(n)
            n += len(nxt)
            tables.append(table)
        tables.append(np.full((1, len(seen) + 1), -1, dtype=np.int32))  # the sink: no phrase is under way
        step = np.concatenate(tables)
        return Model(langs, step, np.array(root, dtype=np.int32), kind, lane)

    def phrases(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by language and row, folded bytes by row)."""
        n, k = len(offs) - 1, len(self.langs)
        raw = FOLD[buf]
        keep = np.ones(len(raw), dtype=bool)
        keep[1:] = (raw[1:] != GAP) | (raw[:-1] != GAP)
        starts = offs[:-1][offs[:-1] < offs[1:]]
        keep[starts] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        offs = at[offs]
        codes = self.kind[raw[keep]]
        size = np.diff(offs)
        count = -(-size // self.lane)
        row = np.repeat(np.arange(n), count)
        begin = offs[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * self.lane
        length = np.minimum(self.lane, offs[row + 1] - begin)
        sink = len(self.step) - 1
        flat, width = self.step.ravel(), self.step.shape[1]
        first = np.where(self.step[self.root] >= 0, self.step[self.root], sink)

        # every lane as if a phrase began with it
        order = np.argsort(-length, kind="stable")
        longest = length[order]
        state = np.full((k, len(row)), sink, dtype=np.int32)
        starts = np.zeros((k, len(codes)), dtype=bool)  # where phrases begin
        live = np.searchsorted(-longest, -np.arange(self.lane), "left")  # lanes longer than t
        for t in range(int(longest[0]) if len(longest) else 0):
            m = live[t]
            at = begin[order[:m]] + t
            c = codes[at]
            to = flat[state[:, :m] * width + c]
            dead = to < 0
            starts[:, at] = dead
            state[:, :m] = np.where(dead, first[:, c], to)
        alone = np.empty_like(state)  # the state at a lane's end
        alone[:, order] = state
        before = np.zeros((k, len(codes) + 1), dtype=np.int32)
        np.cumsum(starts, axis=1, out=before[:, 1:])
        found = before[:, begin + length] - before[:, begin]

        # what is open at a lane's end goes on into the next one
        end = alone.copy()
        follows = np.zeros(len(row) + 1, dtype=bool)
        follows[1:-1] = row[1:] == row[:-1]
        lang, lane = np.nonzero(np.broadcast_to(follows[:-1], (k, len(row))))
        while len(lane):
            s, new, t = end[lang, lane - 1], np.zeros(len(lane), np.int32), 0
            changed_lang, changed = [], []
            while len(lane):
                over = length[lane] <= t
                at = begin[lane] + t
                at[over] = 0
                c = codes[at]
                to = flat[s * width + c]
                dead = to < 0
                met = dead & starts[lang, at] & ~over
                gone = over | met
                if gone.any():
                    j, i = lang[gone], lane[gone]
                    stop = np.where(met[gone], alone[j, i], s[gone])
                    found[j, i] = new[gone] + np.where(met[gone], before[j, begin[i] + length[i]] - before[j, at[gone]], 0)
                    other = (stop != end[j, i]) & follows[i + 1]
                    end[j, i] = stop
                    changed_lang.append(j[other])
                    changed.append(i[other] + 1)
                    stay = ~gone
                    lang, lane, s, new, c, to, dead = (x[stay] for x in (lang, lane, s, new, c, to, dead))
                new += dead
                s = np.where(dead, first[lang, c], to)
                t += 1
            lang, lane = np.concatenate(changed_lang), np.concatenate(changed)
        out = np.zeros((k, n))
        for j in range(k):
            out[j] = np.bincount(row, weights=found[j], minlength=n)
        return out, size

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        langs, score = [], np.zeros(len(texts))
        for lo, hi, buf, offs in textvec.blocks(texts, 1 << 19):
            lettered = np.diff(np.concatenate([[0], np.cumsum(FOLD[buf] != GAP)])[offs]) > 0
            ascii_letters = np.diff(np.concatenate([[0], np.cumsum((FOLD[buf] != GAP) & (buf < 128))])[offs]) > 0
            for i in np.flatnonzero(lettered & ~ascii_letters):
                lettered[i] = any(ch.isalpha() for ch in buf[offs[i] : offs[i + 1]].tobytes().decode())
            if not self.langs:
                langs += ["und"] * (hi - lo)
                continue
            count, size = self.phrases(buf, offs)
            rate = count / np.maximum(size, 1)
            best = rate.argmin(axis=0)
            shares = np.exp(-8 * (rate - rate.min(axis=0)) / np.maximum(rate.min(axis=0), 1e-9))
            langs += [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)]
            score[lo:hi] = np.where(lettered, 1 / shares.sum(axis=0), 0)
        return langs, score


def fill(parts: list[str], room: int, least: int = 8) -> list[str]:
    """The beginnings of ``parts`` in their order, equally far each, of ``room`` characters together or all there are.

    None gets more than an eighth of the room unless the parts would not fill it so.
    """
    cap = max(1, room // least)
    while sum(min(len(x), cap) for x in parts) < min(room, sum(map(len, parts))):
        cap *= 2
    out = []
    for x in parts:
        if room > 0:
            out.append(x[: min(cap, room)])
            room -= len(out[-1])
    return out


def fit(docs: DataFrame, eligible: Column, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from at most ``max_chars`` characters per language, of about ``sample_rows`` of its documents.

    The documents of least hash are taken, each once; a language's share of them is set from its count, and its first
    document is always among them, so no language is gathered as a group and none that has a text with a letter is left out.
    A document teaches by a stretch that starts at a letter, in one longer than ``max_chars`` at a place chosen by hash.
    Where 16 such stretches would fill the room for a language, all of its stretches are shortened alike, so the driver gets
    at most about 16 times ``max_chars`` of it.  Rows with null language or text, those where ``eligible`` fails and texts without a letter teach nothing.
    """
    pool = docs.where(eligible & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    pool = pool.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit(29), F.col(id_col), F.col(text_col)), F.lit(1 << 30)).alias("pick"))
    counts = {r["lang"]: r for r in pool.groupBy("lang").agg(F.approx_count_distinct("pick").alias("n"), F.min("pick").alias("first")).collect()}
    if not counts:
        return Model.build({}, params.lane)
    chars = max(64, min(params.max_chars, params.table_bytes // (len(counts) * STATE_BYTES)))
    take = {lang: min(chars, -(-16 * chars // min(params.sample_rows, max(1, r["n"])))) for lang, r in counts.items()}
    room = F.create_map(*[F.lit(x) for pair in sorted(take.items()) for x in pair])[F.col("lang")]
    limits = F.create_map(*[x for lang, r in sorted(counts.items()) for x in (F.lit(lang), F.lit(max(r["first"], int((1 << 30) * min(1.0, params.sample_rows / max(1, r["n"]))))))])
    start = F.pmod(F.xxhash64(F.lit(31), F.col("pick")), F.greatest(F.length("text") - room + 1, F.lit(1))) + 1
    at_letter = lambda x: F.regexp_replace(x, r"^\P{L}+", "")
    stretch = at_letter(F.substring("text", start.cast("int"), room))
    stretch = F.when(stretch != "", stretch).otherwise(F.substring(at_letter(F.col("text")), F.lit(1), room))
    rows = pool.where(F.col("pick") <= limits[F.col("lang")]).select("lang", "pick", stretch.alias("text"))
    rows = rows.groupBy("lang", "pick").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: r["pick"]):
        texts.setdefault(r["lang"], []).append(r["text"])
    return Model.build({lang: bytes([GAP]).join(folded(x) for x in fill(parts, chars)) for lang, parts in texts.items()}, params.lane)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score in 0..1.

    Null texts and texts without a letter are ``und`` with score 0; ids may be null or repeated; an empty table
    gives no rows; other columns are ignored.  One scan, no shuffle.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
