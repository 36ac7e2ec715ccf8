"""Language-model scoring by online logistic context mixing.

A text is the bytes of its lower-cased (A-Z) form and an end symbol; each symbol is a path of binary decisions through a
fixed prefix code. Three predictors look up each decision under a hashed context (the last two symbols, the last four, the
word so far), in counts over all training texts. Their log odds are summed with weights that the decision's depth gates;
the sum is a logistic mixture. The weights belong to the document: they begin alike and are corrected by the error of what
has been predicted, stretch by stretch, so each symbol is predicted with what the text before it has taught.

The last stage refines word by word: the spelled word's probability is mixed with that of the whole word from its count in
the training texts. How much either is trusted follows from how they have done on the document's last words. The counts of
words are kept for all distinct words, in a table that grows with the corpus; the tables of short contexts are hashed and
have a size that grows with the training text up to a bound.

Counts are sums of integers and a document's score depends on them and its text alone, so it is the same however the table
is partitioned. Long texts are taken in pieces that carry their contexts and weights over.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphledger.llm import common as C

END, PAD = 256, 257
#: Bits of each predictor's table (the last two symbols, the last four, the word so far): one place for so many bytes of
#: training text, within these bounds.
TABLE_BITS, PLACE_BYTES = ((16, 20), (16, 21), (16, 21)), 64
#: Words whose counts are broadcast, the most frequent ones; the others are looked up by a join.
KNOWN_WORDS = 1 << 18
#: Bytes of text that one counting task takes, or so.
TASK_BYTES = 64 << 20
_CHUNK = 1 << 16
#: Bytes of text that one numpy step works on; longer texts are cut into such pieces, between words where they can be.
_BLOCK = 1 << 16
#: Symbols of a document between two corrections of its weights: short stretches at first.
_STRETCHES = np.cumsum([0, 32, 32, 64, 64, 128, 128, 256, 256, 512, 512, 1024, 1024])
_LONG = 2048
_GATES = 8
#: Weights of the predictors that a document begins with, and the steps of their correction.
_BEGIN, _RATE, _STEP = (0.25, 0.45, 0.40), 0.35, 0.08
#: Words that say how far whole-word counts are trusted, how much each says, and the trust to begin with (log odds).
_RECENT, _SAYS, _TRUST = 48, 0.35, -0.5
#: Bytes from frequent to rare in written text; the others follow by value.
FREQUENT = " enitarhsodlucmgpbv.,fwyqzk\n'-xj0123456789\"();:!?_/*#|&%$@+=<>[]{}~^`\\\t\r"


@lru_cache(maxsize=1)
def code() -> tuple[np.ndarray, ...]:
    """Length, first place in the path table, path nodes, path bits and node depth of a prefix code over 257 symbols."""
    order = [b for b in FREQUENT.encode()]
    order[12:12] = [0xC3]
    order[26:26] = [0xA9, 0xA8, 0xB3, 0xBC, 0xA4, 0xB6, 0x9F, 0xA7, 0xAA, 0xAD, 0xB1]
    order += [s for s in [*range(0xA0, 0xC0), 0xC2, 0xC5, END] if s not in set(order)]
    order += [s for s in range(257) if s not in set(order)]
    heap = [(0.9**rank + 1e-5, s, s) for rank, s in enumerate(order)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    for node in range(257, 513):
        for bit in (0, 1):
            w, _, x = heapq.heappop(heap)
            up[x] = (node, bit)
            total = w if bit == 0 else total + w  # noqa: F821
        heapq.heappush(heap, (total, node, node))
    paths = []
    for s in range(257):
        path, x = [], s
        while x in up:
            path.append((up[x][0] - 257, up[x][1]))
            x = up[x][0]
        paths.append(path[::-1])
    length = np.array([*(len(p) for p in paths), 0])  # a pad has no decisions
    nodes = np.array([n for p in paths for n, _ in p], np.uint8)
    bits = np.array([b for p in paths for _, b in p], np.uint8)
    depth = np.zeros(256, np.int64)
    for p in paths:
        for d, (n, _) in enumerate(p):
            depth[n] = d
    return length, np.cumsum(length) - length, nodes, bits, depth


@lru_cache(maxsize=1)
def path_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each place in the path table: its node's offset in a predictor's table, and twice that plus the bit.

    A context starts at a multiple of 16; the nodes of the first four levels lie right behind it, so that most decisions
    on a symbol touch the same piece of memory. Deeper nodes lie anywhere.
    """
    _, _, nodes, bits, depth = code()
    h = (C.mix64((nodes.astype(C.U64) + C.U64(1)) * C.U64(0xA0761D6478BD642F)) >> C.U64(40)).astype(np.int64)
    near = sorted({int(n) for n in nodes if depth[n] < 4}, key=lambda n: (depth[n], n))
    for rank, n in enumerate(near):
        h[nodes == n] = rank
    return h, h * 2 + bits


@dataclass
class Piece:
    """Whole rows lo to hi of a column, or a part of row lo; `lead` is the four bytes before a part that isn't the first."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray
    at: int = 0
    lead: np.ndarray | None = None
    last: bool = True


def pieces(column: pa.Array, limit: int = _BLOCK) -> Iterator[Piece]:
    for lo, hi, buf, offs in C.blocks(column, limit):
        if len(buf) <= 2 * limit:
            yield Piece(lo, hi, buf, offs)
            continue
        at, n = 0, len(buf)  # a long text: one row
        while at < n:
            stop = min(n, at + limit)
            if stop < n:
                blank = np.flatnonzero(~C.NONBLANK_BYTES[buf[at:stop]])
                # a word that is longer than a piece stays whole
                more = np.flatnonzero(~C.NONBLANK_BYTES[buf[stop:]]) if not len(blank) else blank
                stop = at + int(blank[-1]) + 1 if len(blank) else stop + int(more[0]) + 1 if len(more) else n
            lead = None
            if at:
                lead = np.full(4, PAD, np.uint32)
                before = C.LOWER[buf[max(0, at - 4) : at]]
                lead[4 - len(before) :] = before
            yield Piece(lo, hi, buf[at:stop], np.array([0, stop - at]), at, lead, stop == n)
            at = stop


def symbols(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Four symbols before each row, its lower-cased bytes and its end; which of these are predicted; the place of each row."""
    n, rows = len(piece.buf), len(piece.offs) - 1
    s = np.full(n + 5 * rows, PAD, np.uint32)
    first = piece.offs[:-1] + np.arange(0, 5 * rows, 5)
    s[np.arange(n) + np.repeat(np.arange(4, 4 + 5 * rows, 5), np.diff(piece.offs))] = C.LOWER[piece.buf]
    if piece.last:
        s[piece.offs[1:] + np.arange(4, 4 + 5 * rows, 5)] = END
    told = s != PAD
    if piece.lead is not None:
        s[:4] = piece.lead
        told[:4] = False
    return s, told, first


def contexts(s: np.ndarray) -> list[np.ndarray]:
    """The hashed context of each symbol for each predictor; pads keep it from looking beyond the row's start."""
    one = np.zeros_like(s)
    one[1:] = s[:-1]
    two = one * np.uint32(0x9E3779B1)
    two[1:] += s_shift(s, 2) * np.uint32(0x85EBCA77)
    four = two.copy()
    four[2:] += s_shift(s, 3)[1:] * np.uint32(0xC2B2AE3D)
    four[3:] += s_shift(s, 4)[2:] * np.uint32(0x27D4EB2F)
    blank = (one >= END) | (one == 32) | ((one >= 9) & (one <= 13))
    at = np.arange(len(s))
    word = C.PrefixHash(C.BYTE64[s & 255]).of(np.maximum.accumulate(np.where(blank, at, 0)), at) >> C.U64(40)
    out = []
    for h in (two, four):
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append((h >> np.uint32(8)).astype(np.int64) << 4)
    return [*out, word.astype(np.int64) << 4]


def s_shift(s: np.ndarray, by: int) -> np.ndarray:
    """The symbols `by` places back, from place 1 on; 0 before the start."""
    out = np.zeros(len(s) - 1, s.dtype)
    out[by - 1 :] = s[:-by]
    return out


def decisions(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each binary decision: its symbol's place in s, and its place in the path table."""
    length, first, _, _, _ = code()
    n = length[s]
    ends = np.cumsum(n)
    at = np.repeat(np.arange(len(s), dtype=np.int32), n)
    return at, np.arange(len(at), dtype=np.int32) - (ends - n - first[s]).astype(np.int32)[at]


def _odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -8, 8).astype(np.float32)


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, which = np.unique(np.concatenate([h for h, _ in counts]), return_inverse=True)
    return h, np.bincount(which, np.concatenate([n for _, n in counts]), len(h)).astype(np.int64)


def _count(table_bits: tuple[int, ...]):
    """(text) to rows (kind, key, n, payload): word counts (0) and chunks of the decision counts (1)."""

    def rows(kind: int, key, n, payload=None) -> pa.RecordBatch:
        key = pa.array(key, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind), pa.int32()), key, pa.array(n, pa.int64()), pa.nulls(len(key), pa.binary()) if payload is None else pa.array(payload, pa.binary())], names=["kind", "key", "n", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << b, np.uint32) for b in table_bits]
        ends, words = 0, []
        for batch in batches:
            for piece in pieces(batch.column(0)):
                words.append(np.unique(C.hashed_words(piece.buf, piece.offs, C.NONBLANK_BYTES)[0], return_counts=True))
                s, told, _ = symbols(piece)
                at, path = decisions(s[told])
                hashed = path_tables()[1][path]
                for table, c, b in zip(tables, contexts(s), table_bits, strict=True):
                    np.add.at(table, ((c[told] * 2)[at] + hashed) & ((2 << b) - 1), np.uint32(1))
                ends += len(piece.offs) - 1 if piece.last else 0
                if len(words) > 64:
                    words = [_added(words)]
                    if len(words[0][0]) > 1 << 16:
                        yield rows(0, C.signed(words[0][0]), words[0][1])
                        words = []
        if words:
            h, n = _added(words)
            yield rows(0, C.signed(h), n)
        if ends:
            yield rows(0, [0], [ends])  # no word hashes to 0: this is the end token
        for i, table in enumerate(tables):
            for k in range(0, len(table), _CHUNK):
                part = table[k : k + _CHUNK]
                if part.any():
                    yield rows(1, [i << 40 | k], [0], [part.tobytes()])

    return run


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, payload) rows to one row for each key: the log odds of the summed counts, in steps of a sixteenth."""
    key, total = None, None

    def made() -> pa.RecordBatch:
        pair = total.reshape(-1, 2)
        step = np.round(_odds(pair[:, 0], pair[:, 1]) * 15.9).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([step.tobytes()], pa.binary())], names=["key", "odds"])

    for batch in batches:
        for k, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(payload.as_buffer(), np.uint32)
            if k == key:
                total += part
            else:
                if key is not None:
                    yield made()
                key, total = k, part.astype(np.float64)
    if key is not None:
        yield made()


class WordTable:
    """Open addressing over 64-bit word hashes; finds the places of many at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.zeros(1 << self.bits, C.U64)
        self.at = np.zeros(1 << self.bits, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.at[slot[won]] = keys[left[won]], left[won]
            left = np.delete(left, won)
            self.probes += 1

    def _slot(self, h: np.ndarray, probe: int) -> np.ndarray:
        return ((h * C.U64(0x9E3779B97F4A7C15) >> C.U64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is unknown."""
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        for probe in range(self.probes):
            slot = self._slot(h[left], probe)
            there = self.keys[slot]
            hit = there == h[left]
            out[left[hit]] = self.at[slot[hit]]
            left = left[~hit & (there != 0)]
            if not len(left):
                break
        return out


class Model:
    """What scoring needs: log odds of the three tables in sixteenths, and the frequent words with their counts."""

    def __init__(self, odds: list[np.ndarray], words: np.ndarray, logs: np.ndarray) -> None:
        self.odds, self.words, self.logs = odds, words, logs
        self.bits = [int(len(o)).bit_length() - 1 for o in odds]

    def symbol_logs(self, piece: Piece, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each symbol (0 where it isn't predicted), and the first place of each row; corrects the
        rows' weights (rows, gates, predictors) in place."""
        _, _, nodes, bits, depth = code()
        s, told, first = symbols(piece)
        rows = len(first)
        place = np.flatnonzero(told)
        row = (np.searchsorted(first, place, "right") - 1).astype(np.int32)
        order = place - first[row] - 4 + piece.at
        stretch = np.where(order < _STRETCHES[-1], np.searchsorted(_STRETCHES, order, "right"), len(_STRETCHES) + (order - _STRETCHES[-1]) // _LONG)
        turn = np.argsort(stretch.astype(np.uint16) if len(stretch) and stretch.max() < 1 << 16 else stretch, kind="stable")
        place, row, stretch = place[turn], row[turn], stretch[turn]
        at, path = decisions(s[place])
        gate = row[at] * _GATES + np.minimum(depth, _GATES - 1).astype(np.int32)[nodes][path]
        bit = bits[path].astype(np.float32)
        hashed = path_tables()[0][path]
        x = [odds[(c[place][at] + hashed) & ((1 << b) - 1)].astype(np.float32) * np.float32(1 / 15.9) for c, b, odds in zip(contexts(s), self.bits, self.odds, strict=True)]
        w = weights.reshape(rows * _GATES, len(x))
        cost = np.empty(len(at), np.float32)
        edges = np.searchsorted(at, np.concatenate([[0], np.flatnonzero(np.diff(stretch)) + 1, [len(place)]])) if len(place) else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            g = gate[lo:hi]
            now = w.astype(np.float32)
            z = now[g, 0] * x[0][lo:hi]
            for k in (1, 2):
                z += now[g, k] * x[k][lo:hi]
            np.clip(z, -14, 14, out=z)
            e = np.exp(-z)
            p = 1 / (1 + e)
            cost[lo:hi] = np.log(p) - (1 - bit[lo:hi]) * z  # log of p or of 1 - p = p e^-z
            error = bit[lo:hi] - p
            n = np.bincount(g, minlength=len(w)) + 8.0
            for k in range(len(x)):
                w[:, k] += np.clip(_RATE * np.bincount(g, error * x[k][lo:hi], len(w)) / n, -_STEP, _STEP)
        logs = np.zeros(len(s))
        logs[place] = np.bincount(at, cost, len(place)) / np.log(10)
        return logs, first


def _mixed(trust, spelled, whole):
    """log10 of the mixture of 10 ** spelled and 10 ** whole; trust: log odds of the latter."""
    a, b = spelled - np.log1p(np.exp(trust)) / np.log(10), whole - np.log1p(np.exp(-trust)) / np.log(10)
    top = np.maximum(a, b)
    return top + np.log10(10 ** (a - top) + 10 ** (b - top))


def trusts(gain: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Log odds of each word's whole-word count, from the gains of the _RECENT words before it; `before` go ahead of them."""
    total = np.concatenate([[0.0], np.cumsum(np.concatenate([before, gain]))])
    end = np.arange(len(before), len(before) + len(gain))
    return np.clip(_TRUST + _SAYS * (total[end] - total[np.maximum(0, end - _RECENT)]), -8, 8)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = WordTable(model.words)
        for batch in batches:
            n = len(batch)
            score, base = np.zeros(n), np.zeros(n)
            n_tokens, n_known, n_bytes = (np.zeros(n, np.int64) for _ in range(3))
            rare: list[tuple[np.ndarray, ...]] = []
            weights, gains = np.zeros(0), np.zeros(0)
            for piece in pieces(batch.column(batch.num_columns - 1)):
                lo, rows = piece.lo, len(piece.offs) - 1
                if not piece.at:
                    weights, gains = np.tile(np.array(_BEGIN), (rows, _GATES, 1)), np.zeros(0)
                logs, first = model.symbol_logs(piece, weights)
                score[lo : lo + rows] += np.add.reduceat(logs, first)
                h, start, stop, per_row = C.hashed_words(piece.buf, piece.offs, C.NONBLANK_BYTES)
                row = np.repeat(np.arange(rows), per_row)
                shift = 4 + 5 * row
                spelled = np.add.reduceat(logs, np.stack([start + shift, stop + shift], 1).ravel())[::2] if len(h) else np.zeros(0)
                found = known.find(h)
                hit = found >= 0
                whole = model.logs[found] if len(model.logs) else np.zeros(len(h))
                gain = np.where(hit, np.clip((whole - spelled) * np.log(10), -3, 3), 0.0)
                trust = np.zeros(len(h))
                ends = np.cumsum(per_row)
                for r in np.flatnonzero(per_row):
                    part = slice(ends[r] - per_row[r], ends[r])
                    trust[part] = trusts(gain[part], gains)
                gains = np.concatenate([gains, gain[-_RECENT:]])[-_RECENT:]
                score[lo : lo + rows] += np.bincount(row[hit], (_mixed(trust, spelled, whole) - spelled)[hit], rows)
                base[lo : lo + rows] += np.bincount(row[hit], whole[hit], rows)
                n_known[lo : lo + rows] += np.bincount(row[hit], minlength=rows)
                n_tokens[lo : lo + rows] += per_row
                n_bytes[lo : lo + rows] += np.diff(piece.offs)
                rare.append((lo + row[~hit], C.signed(h[~hit]), trust[~hit].astype(np.float32), spelled[~hit].astype(np.float32)))
            row, *fields = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
            value = pa.StructArray.from_arrays([pa.array(f) for f in fields], names=["key", "trust", "spelled"])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (n_tokens, n_known, base, score, n_bytes)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value)], names=[*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score", "n_bytes", "rare"])

    return run


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words (key, n) of the greatest counts, at most `most`; a step of counts is in or out as a whole, so that only
    what is taken goes to the driver."""
    step = F.floor(F.log2("n") * 16)
    taken, least = 0, None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.step):
        taken += r.k
        if taken > most:
            break
        least = r.step
    return words.where(step >= least) if least is not None else words.limit(0)


def score(docs: DataFrame, held_out: Column, *, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for each row of docs.

    Learns from the rows where held_out is false. A null text is empty: one end token. Equal rows are counted and scored
    each. Without training rows every count is 0, the tables are empty and each decision costs one bit at first. Reads
    doc_id and text; other columns are ignored. bits_per_byte takes all bits, those of the end too, over the bytes of the
    text; a text without bytes has none (null). A text is taken in pieces; a single word has to fit in a task.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    train = rows.where(~F.col("held_out")).select("text")
    # a task's tables have a fixed size, so a task takes more text than a scan's usual share, if all cores have work
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    train = train.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    table_bits = tuple(min(most, max(least, (size // PLACE_BYTES).bit_length())) for least, most in TABLE_BITS)
    counted = C.checkpoint(train.mapInArrow(_count(table_bits), "kind int, key long, n long, payload binary"))
    words = C.checkpoint(counted.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, kinds = total.n or 0, total.v
    floor = n_all + 0.5 * (kinds + 1)
    chunks = counted.where("kind = 1").select("key", "payload").repartition("key").sortWithinPartitions("key").mapInArrow(_add_chunks, "key long, odds binary")
    odds = [np.zeros(1 << b, np.int8) for b in table_bits]
    for key, step in chunks.toLocalIterator():  # of bounded size, whatever the corpus
        part = np.frombuffer(step, np.int8)
        at = (key & ((1 << 40) - 1)) // 2
        odds[key >> 40][at : at + len(part)] = part
    top = _frequent(words.where("key <> 0"), known_words).toPandas()
    n_top = top["n"].to_numpy(np.float64)
    ends = words.where("key = 0").first()
    ends = ends.n if ends else 0
    model = Model(odds, top["key"].to_numpy(np.int64).view(C.U64), np.log10((n_top + 0.5) / floor))
    shared = spark.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)["doc_id"]
    scored = rows.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, rare array<struct<key:long,trust:float,spelled:float>>")
    scored = C.checkpoint(scored.withColumn("uid", F.monotonically_increasing_id()))
    # rarer words: their counts come by a join, and with them what the last stage makes of the word
    rest = scored.select("uid", F.inline("rare")).join(words, "key", "left").select("uid", F.coalesce("n", F.lit(0)).alias("n"), "trust", "spelled")
    share = F.when(F.col("n") > 0, (F.col("n") + 0.5) / floor).otherwise(0.0)
    e = F.exp(F.col("trust").cast("double"))
    gain = F.log10((1 + e * F.least(share * F.pow(F.lit(10.0), -F.col("spelled").cast("double")), F.lit(1e250))) / (1 + e))
    rest = rest.groupBy("uid").agg(F.sum(F.log10((F.col("n") + 0.5) / floor)).alias("rest"), F.count_if(F.col("n") > 0).alias("more"), F.sum(gain).alias("gain"))
    end_log = float(np.log10((ends + 0.5) / floor))
    out = scored.join(rest, "uid", "left")
    return out.select(
        "doc_id",
        "held_out",
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rest", F.lit(0.0)) + F.lit(end_log)).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
        (-(F.col("score") + F.coalesce("gain", F.lit(0.0))) / math.log10(2) / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))).alias("bits_per_byte"),
    )
