"""Suffix-array dedup by distributed prefix doubling on synchronising positions.

Sorting every byte position of the corpus would shuffle many times its size. The doubling therefore runs on few positions:

1. Anchors. Every `length`-byte string picks one of its positions, where its least `gram`-byte string starts (a minimizer);
   equal strings pick the same place. The first rank of an anchor is its gram. Anchors with a rank of their own are done.
2. The second rank is the pair of the gram and the text around it, as far as the strings reach that pick this anchor.
   Anchors that share this rank are repeated as a whole. Anchors whose rank is unique, but whose gram isn't, stay open.
3. Open anchors (the edges of repeated passages) are spread out to the positions where their strings start, and prefix
   doubling runs on these: a position starts with the rank of its `length` / 4 bytes. A round at offset h makes the pair
   (rank of p, rank of p + h), Spark brings equal pairs together, and the pair is the position's next rank. A pair that is
   alone is dropped: no longer string that begins there occurs twice. The rounds are at offsets `length` / 4 and
   `length` / 2; the positions that are left then begin strings that occur twice. As a rank depends on the text alone, a
   position carries the rank of its partner at the next offset with it, in place of looking it up among the others.

A rank is a 64-bit fingerprint, not an ordinal, so no rank needs a global order; sorting is by key within Spark's
exchanges. One anchor of each kind of surroundings stands for its copies, so pairs are counted over distinct texts around
an anchor. Strings are judged on the input, matches never cross documents, and copies of a text count as occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphledger.llm import common as C

LENGTH, GRAM = 200, 96
_PAIR = C.U64(0x9FB21C651E98DF25)


def anchors_of(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, gram hash): strings that start at first to last pick the anchor. All are byte positions."""
    none = np.zeros(0, np.int64)
    n, width = len(buf), length - gram + 1
    if n < length:
        return none, none, none, none, none.view(C.U64)
    ph = C.PrefixHash(C.BYTE64[buf])
    h = C.mix64(ph.windows(gram))
    bits = C.U64(max(1, int(len(h)).bit_length()))
    keys = (h >> bits << bits) | np.arange(len(h), dtype=C.U64)  # ties go to the leftmost
    pick = _sliding_min(keys, width)[: n - length + 1] & ((C.U64(1) << bits) - C.U64(1))
    start = np.arange(n - length + 1)
    row = np.searchsorted(offs, start, "right") - 1
    inside = start + length <= offs[row + 1]
    start, pick, row = start[inside], pick[inside].astype(np.int64), row[inside]
    if not len(start):
        return none, none, none, none, none.view(C.U64)
    new = np.ones(len(start), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[first], pick[first], start[first], start[last], h[pick[first]]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _anchor_batches(batches: Iterator[pa.RecordBatch], length: int, gram: int):
    """(tid, gram, ctx, at) of the anchors of each block of (tid, text); at: first start << 16 | anchor - first << 8 | last - first."""
    for batch in batches:
        tid = np.asarray(batch.column(0))
        for lo, hi, buf, offs in C.blocks(batch.column(1)):
            row, anchor, first, last, g = anchors_of(buf, offs, length, gram)
            if len(row):
                shape = (anchor - first) << 8 | (last - first)
                ctx = C.mix64(C.PrefixHash(C.BYTE64[buf]).of(first, last + length) + shape.astype(C.U64) * C.BYTE64[7])
                yield tid[lo:hi][row], g, ctx, (first - offs[row]) << 16 | shape
        yield None


def _count_ranks(length: int, gram: int):
    """(tid, text) to (gram, ctx, n), counted within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for found in _anchor_batches(batches, length, gram):
            if found is not None:
                got.append(found[1:3])
                continue
            if got:
                g, ctx = (np.concatenate(x) for x in zip(*got, strict=True))
                ctx, first, n = np.unique(ctx, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(g[first])), pa.array(C.signed(ctx)), pa.array(n)], names=["gram", "ctx", "n"])
                got = []

    return run


def _list_anchors(length: int, gram: int):
    """(tid, text) to (ctx, tid, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _anchor_batches(batches, length, gram):
            if found is not None:
                tid, _, ctx, at = found
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(ctx)), pa.array(tid), pa.array(at)], names=["ctx", "tid", "at"])

    return run


def _first_pairs(length: int):
    """(tid, text, open array<at>) to (pair, next, tid, p) for each position p where a string of an open anchor starts: the
    pair of the ranks of length / 4 bytes at p and at the first offset, length / 4, and the same pair of the position that
    the second round needs, at offset length / 2."""
    h = length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, opened = np.asarray(batch.column(0)), batch.column(2)
            per_row, at = np.asarray(opened.value_lengths()), np.asarray(opened.flatten())
            done = np.cumsum(per_row)
            for lo, hi, buf, offs in C.blocks(batch.column(1)):
                own = slice(done[lo] - per_row[lo], done[hi - 1])
                row = np.repeat(np.arange(hi - lo), per_row[lo:hi])
                # strings of different anchors start at different places
                size = (at[own] & 255) + 1
                p = np.repeat((at[own] >> 16) + offs[row] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                row = np.repeat(row, size)
                sums = C.PrefixHash(C.BYTE64[buf])
                pair, following = (C.mix64(sums.of(q, q + h) * _PAIR + sums.of(q + h, q + 2 * h)) for q in (p, p + 2 * h))
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(pair)), pa.array(C.signed(following)), pa.array(tid[lo:hi][row]), pa.array((p - offs[row]).astype(np.int32))], names=["pair", "next", "tid", "p"])

    return run


def _repeated(pairs: DataFrame) -> DataFrame:
    """The rows whose pair other positions have too."""
    twice = pairs.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1").select("pair")
    return pairs.join(twice, "pair")


def _runs(length: int):
    """(tid, p) sorted to (tid, start, stop): runs of successive positions, as far as their strings reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, p = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
            new = np.ones(len(p), bool)
            new[1:] = (tid[1:] != tid[:-1]) | (p[1:] > p[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(p))[: len(first)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(tid[first]), pa.array(p[first]), pa.array(p[last] + length)], names=["tid", "start", "stop"])

    return run


def repeated_spans(texts: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(tid, spans) for rows (tid, text), where tid stands for the text's content: [start, stop) byte spans, sorted, that
    are covered by `length`-byte strings which start elsewhere too."""
    if not gram < length <= gram + 256 or length % 4:
        raise ValueError("length has to be a multiple of 4, and length - gram from 1 to 256")
    # ranks: how many anchors share the gram and what is around it, and how many kinds of surroundings a gram has
    contexts = texts.mapInArrow(_count_ranks(length, gram), "gram long, ctx long, n long").repartition("gram").groupBy("gram", "ctx").agg(F.sum("n").alias("n"))
    shared = contexts.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1").drop("all")
    ranked = C.checkpoint(contexts.join(shared, "gram").select("ctx", "gram", "n", "kinds"))
    members = C.checkpoint(texts.mapInArrow(_list_anchors(length, gram), "ctx long, tid long, at long").join(ranked.select("ctx", "n", "kinds"), "ctx"))
    C.discard(ranked)
    whole = members.where("n > 1").select("tid", F.shiftright("at", 16).alias("start"), (F.shiftright("at", 16) + F.col("at").bitwiseAND(255) + length).alias("stop"))
    whole = C.checkpoint(whole)
    # one anchor of each kind stands for its copies
    kinds = members.where("kinds > 1").groupBy("ctx").agg(F.min(F.struct("tid", "at")).alias("one")).select("one.*")
    opened = C.checkpoint(kinds.groupBy("tid").agg(F.collect_list("at").alias("open")))
    C.discard(members)
    # copies of a text go before the shuffle, in each task's share of the aggregation
    some = texts.join(opened.select("tid"), "tid", "left_semi").dropDuplicates(["tid"]).join(opened, "tid").select("tid", "text", "open")
    pairs = C.checkpoint(some.mapInArrow(_first_pairs(length), "pair long, next long, tid long, p int"))
    C.discard(opened)
    # the rank that a pair has next to another at twice the offset; positions that are alone have dropped out
    later = C.checkpoint(_repeated(pairs).select(F.xxhash64("pair", "next").alias("pair"), "tid", "p"))
    C.discard(pairs)
    edges = _repeated(later).select("tid", "p").repartition("tid").sortWithinPartitions("tid", "p").mapInArrow(_runs(length), "tid long, start long, stop long")
    spans = C.checkpoint(whole.unionByName(edges).groupBy("tid").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans")))
    C.discard(whole, later)
    return spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_bytes, n_removed, n_spans, and kept: the bytes that remain. In: spans is the last column, text is `text`."""
    for batch in batches:
        names = batch.schema.names
        spans, at = batch.column(len(names) - 1), names.index("text")
        n_spans, n_removed, kept, n_bytes = [], [], [], []
        per_row = np.asarray(spans.value_lengths().fill_null(0)) if len(batch) else np.zeros(0, int)
        flat = spans.flatten()
        start, stop = np.asarray(flat.field("start")), np.asarray(flat.field("stop"))
        buf, offs = C.text_of(batch.column(at))
        k = 0
        for row, n in enumerate(per_row):
            own = buf[offs[row] : offs[row + 1]]
            n_bytes.append(len(own))
            if not n:
                n_spans.append(0), n_removed.append(0), kept.append(own.tobytes())
                continue
            s, e = start[k : k + n], np.maximum.accumulate(stop[k : k + n])
            k += n
            new = np.ones(n, bool)
            new[1:] = s[1:] > e[:-1]
            s, e = s[new], e[np.append(np.flatnonzero(new)[1:], n) - 1]
            cover = np.zeros(len(own) + 1, np.int8)
            cover[s], cover[e] = 1, -1
            gone = np.cumsum(cover[:-1]) > 0
            n_spans.append(len(s)), n_removed.append(int((e - s).sum())), kept.append(own[~gone].tobytes())
        columns = [batch.column(i) for i in range(len(names) - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=[*names[:-1], "n_bytes", "n_removed", "n_spans", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        names = batch.schema.names
        sha = pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(len(names) - 1)], pa.string())
        keep = [i for i, c in enumerate(names) if c not in ("text", "kept")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), sha], names=[*(names[i] for i in keep), "kept_sha256"])


def _with_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs and, as the last column, the spans of each row's text."""
    tid, last = C.unused("tid", docs.columns), C.unused("spans", docs.columns)
    content = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn(tid, F.xxhash64(content, F.octet_length(content)))
    spans = repeated_spans(keyed.where(F.octet_length("text") >= length).select(F.col(tid).alias("tid"), "text"), length=length, gram=gram)
    return keyed.join(spans.select(F.col("tid").alias(tid), F.col("spans").alias(last)), tid, "left").select(*docs.columns, last)


def digest(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (doc_id, text).

    A null text has no bytes; texts shorter than `length` lose none; copies of a text, and the same row twice, are
    occurrences of each other. Other columns are ignored.
    """
    out = _with_spans(docs.select("doc_id", "text"), length, gram)
    kind = dict(out.dtypes)["doc_id"]
    return out.mapInArrow(_digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with their repeated bytes cut out of text; characters that a cut splits go as well, null texts stay null.

    Rows whose text is repeated from end to end are left with an empty text.
    """
    names = docs.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            removed, kept = batch.column(batch.num_columns - 3), batch.column(batch.num_columns - 1)
            was = batch.column(names.index("text"))
            text = [k.as_py().decode("utf-8", "ignore") if r.as_py() else w.as_py() for w, r, k in zip(was, removed, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text, was.type) if c == "text" else batch.column(i) for i, c in enumerate(names)], names=names)

    return _with_spans(docs, length, gram).mapInArrow(cut, schema)
