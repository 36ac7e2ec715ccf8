"""Byte-level BPE encoding and decoding by merge ranks, with a queue of ranks in a hierarchical bitmap.

A piece of text is a linked list of tokens, one for each byte at first. The queue has a bucket of list positions for each rank
that some neighbouring pair could merge to; a bitmap of 64-bit words, with a bit for each bucket, and words above it with a bit
for each word that isn't zero, give the least rank by find-first-set on each level. A merge leaves the entries of the pairs that
it breaks where they are: they are stale and skipped when their turn comes. So n bytes take about n log n steps however long
a piece is; short ones share a queue (their order among each other doesn't matter), and those that come again are remembered.

The rank file is read on the driver (some 50,000 lines) and sent to the executors, which need no copy of it. Texts stay in
their rows: nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphledger.llm.common import BLOCK_BYTES, blocks

#: Pieces that a task remembers (twice as many at most), and up to how many characters each.
REMEMBERED, REMEMBERED_CHARS = 1 << 17, 48
#: From so many bytes on, lists of numbers are kept in four bytes each.
LONG = 1 << 20
#: Ids are kept in so many bits where two of them make a key.
ID_BITS = 24


class RankQueue:
    """Buckets of positions by rank, least rank first. Empty again once all buckets have been taken."""

    def __init__(self, n_ranks: int) -> None:
        self.levels = []
        while not self.levels or len(self.levels[-1]) > 1:
            n_ranks = max(1, n_ranks + 63 >> 6)
            self.levels.append([0] * n_ranks)
        self.down = self.levels[::-1]
        self.buckets: dict[int, list[int]] = {}

    def fill(self, ranks: np.ndarray) -> None:
        """Start with the rank of each position; those below 0 have none."""
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        found, first = np.unique(ranks[at], return_index=True)
        ends = [*first[1:].tolist(), len(at)][: len(first)]  # none of none
        for rank, i, j in zip(found.tolist(), first.tolist(), ends, strict=True):
            self.put(rank, at[i:j].tolist() if j - i < LONG else array("i", at[i:j].astype(np.int32).tobytes()))

    def put(self, rank: int, positions) -> None:
        """Start a bucket of a rank that has none."""
        self.buckets[rank] = positions
        for level in self.levels:
            word = rank >> 6
            before = level[word]
            level[word] = before | 1 << (rank & 63)
            if before:
                break
            rank = word

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.put(rank, [at])
        else:
            bucket.append(at)

    def take(self) -> tuple[int, list[int]]:
        """(the least rank, its positions from left to right), or (-1, []) if nothing is left."""
        rank = 0
        for level in self.down:
            bits = level[rank]
            if not bits:
                return -1, []
            rank = rank << 6 | (bits & -bits).bit_length() - 1
        at = rank
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        bucket = self.buckets.pop(rank)
        return rank, sorted(bucket) if len(bucket) > 1 else bucket


class Vocabulary:
    """A rank file: a line has a token in base64 and its rank, which is its id too. All single bytes have to be tokens."""

    def __init__(self, data: bytes) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
        self.n_ids = 1 + max(self.ranks.values())
        if any(bytes([b]) not in self.ranks for b in range(256)) or self.n_ids > 1 << ID_BITS:
            raise ValueError("a rank file needs a rank below 2**24 for every single byte")
        self.pairs = {left << ID_BITS | right: rank for token, rank in self.ranks.items() for i in range(1, len(token)) if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.first = np.full(1 << 16, -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = rank
        self.queue = RankQueue(self.n_ids)
        self.pieces = Pieces(self.encode)  # for all tasks of a process
        tokens = [b""] * self.n_ids
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes, self.offsets = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as int32: its own where the whole piece is a token, else what merging leaves."""
        raw = [piece.encode() for piece in pieces]
        whole = [self.ranks.get(x) for x in raw]
        merged = iter(self.merged([x for x, own in zip(raw, whole, strict=True) if own is None]))
        return [next(merged) if own is None else own.to_bytes(4, sys.byteorder) for own in whole]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Merge the pieces side by side: each is a linked list of its own, and the queue has the ranks of all of them."""
        n = sum(map(len, pieces))
        if not n:
            return [b""] * len(pieces)
        keep = list if n < LONG else lambda values: array("i", values)
        raw, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(x) for x in pieces], dtype=np.int64)
        token, after, before = keep(self.single[raw].tolist()), keep(range(1, n + 1)), keep(range(-1, n - 1))
        for end in ends.tolist():
            after[end - 1] = -1
            if end < n:
                before[end] = -1
        ranks = self.first[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        ranks[ends[:-1] - 1] = -1
        queue, pairs = self.queue, self.pairs
        queue.fill(ranks)
        while True:
            rank, bucket = queue.take()
            if rank < 0:
                break
            for k, at in enumerate(bucket):
                right = after[at]
                if right < 0 or token[at] < 0 or pairs.get(token[at] << ID_BITS | token[right]) != rank:
                    continue  # stale: a merge took one of the two
                token[at], token[right] = rank, -1
                after[at] = beyond = after[right]
                least = rank
                if beyond >= 0:
                    before[beyond] = at
                    new = pairs.get(rank << ID_BITS | token[beyond])
                    if new is not None:
                        queue.push(new, at)
                        least = min(least, new)
                left = before[at]
                if left >= 0:
                    new = pairs.get(token[left] << ID_BITS | rank)
                    if new is not None:
                        queue.push(new, left)
                        least = min(least, new)
                if least < rank:  # the new pair comes first; the rest of the bucket waits
                    if k + 1 < len(bucket):
                        queue.put(rank, bucket[k + 1 :])
                    break
        ids = np.array(token, np.int32)
        left = np.cumsum(ids >= 0)[ends - 1]
        flat = ids[ids >= 0].tobytes()
        return [flat[4 * i : 4 * j] for i, j in zip([0, *left[:-1].tolist()], left.tolist(), strict=True)]

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        length = self.offsets[ids + 1] - self.offsets[ids]
        if (length == 0).any():
            raise ValueError("an id that the vocabulary doesn't have")
        ends = np.cumsum(length)
        return self.bytes[np.repeat(self.offsets[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class Pieces:
    """The ids of pieces of text, as int32 bytes. Those that come again are remembered; once there are many, what has not been
    asked for since the last time there were many is forgotten. Pieces that aren't known yet are encoded together."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]) -> None:
        self.encode, self.known, self.before = encode, {}, {}

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, which is a list of pieces."""
        if len(self.known) >= REMEMBERED:
            self.known, self.before = {}, self.known
        known = self.known
        missing = set().union(*texts).difference(known)
        new, before = [], self.before.get
        for piece in missing:
            ids = before(piece)
            if ids is None:
                new.append(piece)
            else:
                known[piece] = ids
        known.update(zip(new, self.encode(new), strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
        for piece in new:
            if len(piece) > REMEMBERED_CHARS:
                del known[piece]
        return out


def split_ids(texts: list[str], pattern: regex.Pattern, pieces: Pieces) -> list[bytes]:
    """The ids of each text's pieces in a row, as int32; the pieces of a long text are never all in memory."""
    if sum(map(len, texts)) <= 2 * BLOCK_BYTES:
        return pieces.join([pattern.findall(text) for text in texts])
    return [b"".join(pieces.join([list(some)])[0] for some in batched((m[0] for m in pattern.finditer(text)), 1 << 17)) for text in texts]


def int_lists(ids: list[bytes]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


_LOADED: dict[tuple, object] = {}


def once(kind, data: bytes):
    """kind(data), kept for all tasks of this Python process."""
    key = (kind, hashlib.sha256(data).digest())
    if key not in _LOADED:
        _LOADED[key] = kind(data)
    return _LOADED[key]


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, text, ids) of each row of docs (doc_id, text); ids is an array of int.

    The text is cut into the matches of pattern (text that no match covers has no ids), each of which is merged for itself.
    Special tokens are not known: their strings are plain text. A null text counts as empty and has no ids; rows with null or
    equal ids stay as they are; other columns are ignored. A text has to fit in a task: its longest piece takes about fifty
    times its bytes.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(file_bytes(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, matches = once(Vocabulary, ranks.value), regex.compile(pattern)
        for batch in batches:
            for row, end, buf, offs in blocks(batch["text"]):
                ids = split_ids([buf[offs[i] : offs[i + 1]].tobytes().decode() for i in range(end - row)], matches, vocabulary.pieces)
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], int_lists(ids)], ["doc_id", "text", "ids"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id string, text string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows (doc_id, ids); decoded is binary, as ids may be cut anywhere.

    Null ids count as none and give no bytes. An id that the vocabulary doesn't have is an error. Other columns are ignored.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(file_bytes(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = once(Vocabulary, ranks.value)
        for batch in batches:
            lists = batch["ids"]
            flat, offs = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            row = 0
            while row < len(lists):  # some rows at a time
                end = min(len(lists), max(row + 1, int(np.searchsorted(offs, offs[row] + BLOCK_BYTES // 4, "right")) - 1))
                raw = [vocabulary.decoded(flat[offs[i] : offs[i + 1]].astype(np.int64)).tobytes() for i in range(row, end)]
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])
                row = end

    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id string, ids array<int>, decoded binary").withColumn("doc_id", F.col("doc_id").cast(encoded.schema["doc_id"].dataType))


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def digest(decoded: DataFrame) -> DataFrame:
    """The rows of decode() with hashes in place of ids and bytes."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(_joined(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
