"""Which tokens of two tokenizers meet in a text: DuckDB tables of token intervals inside each Arrow batch.

A block of texts is encoded by both tokenizers; the tokens of each are a table of byte intervals. In DuckDB an ASOF join gives
every A token the first and the last B token that it overlaps, those in between follow by position, and window sums over the
common ends number the groups, in which each token finds its place by bisection. Each block counts for itself in how many of its texts a pair of ids is linked; Spark adds up
these partial counts, looks them up for each text's links, and does all that crosses blocks.

Tokenizer files are read on the driver (some megabytes) and sent to the executors, which need no copy of them.
"""

from __future__ import annotations

import json
import os
import tempfile
from array import array
from collections.abc import Iterator
from itertools import compress

import duckdb
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from glyphledger.llm.byte_bpe import Pieces, file_bytes, once, split_ids
from glyphledger.llm.common import blocks, checkpoint

#: Up to so many pairs of ids the table of counts is broadcast (some 60 MB); a larger one is joined by shuffling the links.
MAX_BROADCAST = 1 << 20
#: Bytes of text that are one set of DuckDB tables, and memory that these may take before they spill to disk.
TABLE_BYTES, TABLE_MEMORY = 1 << 19, "300MB"
#: The pattern of byte-level pre-tokenizers, and the sign for a blank in pieces.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK_SIGN = "▁"
#: New pieces that a tokenizer gets as one text, and what such pieces of the pattern look like.
RUN, BLANK_AND_MORE = 64, regex.compile(r" \S")


class TokenBytes:
    """The bytes of each id, and their numbers."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.bytes, self.start = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.bytes[np.repeat(self.start[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def spell(self, ids: list[np.ndarray], texts: list[bytes]) -> list[bool]:
        """Whether the ids of each text are its bytes, looked at together where all have as many bytes as their texts."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(self.length[flat])])[np.cumsum([len(x) for x in ids], dtype=np.int64)]
        if np.array_equal(ends, np.cumsum([len(x) for x in texts])) and self.joined(flat) == b"".join(texts):
            return [True] * len(ids)
        return [self.joined(x) == raw for x, raw in zip(ids, texts, strict=True)]

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as int32."""
        raise NotImplementedError

    def in_runs(self, pieces: list[str], sign: str) -> list[bytes]:
        """The ids of each piece, made from runs of RUN pieces with a sign between them: for pieces that no token of a run
        crosses, if each sign is counted to the piece behind it. Runs that aren't what their tokens spell are made piece by piece."""
        runs = [pieces[i : i + RUN] for i in range(0, len(pieces), RUN)]
        ids = [np.frombuffer(x, np.int32) for x in self.whole([sign.join(run) for run in runs])]
        raw = [[f" {p}".encode() if sign else p.encode() for p in run] for run in runs]
        out = []
        for run, made, of, same in zip(runs, ids, raw, self.spell(ids, [b"".join(x) for x in raw]), strict=True):
            stop, ends = np.cumsum(self.length[made]), np.cumsum([len(x) for x in of])
            at = np.searchsorted(stop, ends) if same else ends
            if same and (stop[at] == ends).all():
                flat, cuts = made.tobytes(), (4 * at + 4).tolist()
                out += [flat[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
            else:
                out += self.whole(run)
        return out


class ByteLevel(TokenBytes):
    """A byte-level tokenizer from its JSON; the text gets a blank in front. Special tokens are plain text."""

    def __init__(self, data: bytes) -> None:
        made = json.loads(data)
        self.tokenizer = tokenizers.Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        super().__init__([bytes(letters[ch] for ch in name) if all(ch in letters for ch in name) else name.encode() for name in names])
        # where pieces are encoded one by one anyway, those that come again needn't be
        step = made.get("pre_tokenizer") or {}
        self.by_piece = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not made.get("normalizer")
        self.pattern, self.pieces = regex.compile(BYTE_LEVEL_PATTERN), Pieces(self.new_pieces)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("i", made.ids).tobytes() for made in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def new_pieces(self, pieces: list[str]) -> list[bytes]:
        # a blank and no other one: the pattern cuts a run of these as it cut the texts
        worded = [BLANK_AND_MORE.match(p) is not None for p in pieces]
        runs, others = iter(self.in_runs(list(compress(pieces, worded)), "")), iter(self.whole([p for p, ok in zip(pieces, worded, strict=True) if not ok]))
        return [next(runs if ok else others) for ok in worded]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        texts = [f" {t}" for t in texts]
        return [np.frombuffer(ids, np.int32) for ids in (split_ids(texts, self.pattern, self.pieces) if self.by_piece else self.whole(texts))]


class PieceModel(TokenBytes):
    """A piece model with byte fallback, which puts a blank in front by itself."""

    def __init__(self, data: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(BLANK_SIGN, " ").encode() for i, piece in enumerate(pieces)])
        # merges never cross a blank if no piece has one behind another character: words that come again needn't be encoded again
        made = sentencepiece_model_pb2.ModelProto.FromString(data)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.by_word = (
            made.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
            and made.normalizer_spec.name == "identity"
            and made.normalizer_spec.add_dummy_prefix
            and not made.normalizer_spec.remove_extra_whitespaces
            and not any(BLANK_SIGN in piece.lstrip(BLANK_SIGN) for piece in pieces)
            and not any(piece.type == kinds.USER_DEFINED for piece in made.pieces)
        )
        self.words = Pieces(lambda words: self.in_runs(words, " "))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # each word gets the blank before it; where blanks stand together or at an end, the text is encoded as a whole
        plain = [self.by_word and "  " not in f" {t} " for t in texts]
        words = iter(self.words.join([t.split(" ") for t, ok in zip(texts, plain, strict=True) if ok]))
        others = iter(self.whole([t for t, ok in zip(texts, plain, strict=True) if not ok]))
        return [np.frombuffer(next(words if ok else others), np.int32) for ok in plain]


#: Groups end where tokens of both end; the window sum over these places numbers them, and a token is in the group that the
#: next such place ends.
_CUTS = "SELECT stop, count(*) OVER (ORDER BY stop ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT stop FROM a JOIN b USING (stop)) AS both_end ORDER BY g"
#: The first B token that an A token overlaps is the last one that starts no later. Where that ends too early, the last one is
#: looked for as well, and those in between follow by position.
_LINKS = """
CREATE OR REPLACE TEMP TABLE links AS
WITH heads AS MATERIALIZED (
  SELECT a.doc, a.id, a.stop, head.id AS head_id, head.i AS head, head.stop AS head_stop FROM a ASOF JOIN b AS head ON a.start >= head.start),
more AS (
  SELECT long.doc, long.id, unnest(range(long.head + 1, tail.i + 1)) AS i
  FROM (SELECT * FROM heads WHERE head_stop < stop) AS long ASOF JOIN b AS tail ON long.stop > tail.start),
met AS (
  SELECT doc, id AS a, head_id AS b FROM heads
  UNION ALL
  SELECT more.doc, more.id AS a, b.id AS b FROM more JOIN b ON b.i = more.i)
SELECT doc, a, b, CAST(count(*) AS INT) AS n FROM met GROUP BY doc, a, b"""
_BY_DOC = "SELECT doc, CAST(sum(n) AS BIGINT) AS n_links, list({'a': a, 'b': b, 'n': n}) AS links FROM links GROUP BY doc ORDER BY doc"
_BY_PAIR = "SELECT list({'a': a, 'b': b, 'docs': docs}) AS partial FROM (SELECT a, b, CAST(count(*) AS INT) AS docs FROM links GROUP BY a, b) AS p"

_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
_PARTIAL = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int32())])
_MADE = pa.schema([("doc_id", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("links", pa.list_(_LINK)), ("partial", pa.list_(_PARTIAL))])
_SQL_TYPE = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int,n:int>>, partial array<struct<a:int,b:int,docs:int>>"


def _intervals(ids: list[np.ndarray], docs: list[int], kind: TokenBytes) -> pa.Table:
    flat = np.concatenate(ids)
    stop = np.cumsum(kind.length[flat])
    return pa.table({"i": np.arange(len(flat), dtype=np.int32), "doc": np.repeat(np.array(docs, np.int32), [len(x) for x in ids]), "id": flat, "start": stop - kind.length[flat], "stop": stop})


def _written(a: list[np.ndarray], b: list[np.ndarray], group_a: np.ndarray, group_b: np.ndarray, names: list[str]) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each text; names has each id followed by a comma, then by a bar, then by a semicolon."""
    group, side = np.concatenate([group_a, group_b]), np.repeat(np.array([0, 1]), [len(group_a), len(group_b)])
    order = np.argsort(group * 2 + side, kind="stable")
    key = (group * 2 + side)[order]
    last = np.append(key[1:] != key[:-1], True)
    n = len(names) // 3
    code = np.concatenate([*a, *b])[order] + n * np.where(last, 1 + side[order], 0)
    ends = np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    return ["".join(map(names.__getitem__, code[i:j].tolist()))[:-1] for i, j in zip(ends - np.diff(ends, prepend=0), ends, strict=True)]


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, links, partial) of each row of docs (doc_id, text).

    A is a byte-level tokenizer (JSON), B a piece model; both encode the text with one blank before it. Byte places where
    tokens of both end cut the tokens into groups, written `a1,a2|b1;a3|b2,b3`. links are the pairs of ids whose byte ranges
    overlap, n how often in this text, n_links all of them; partial has, on one row of each block of texts, in how many of the
    block's texts each pair is linked. Texts that are null, empty, or not what their tokens of A or of B spell have no tokens:
    zeros, an empty `groups` and no links. Rows with null or equal ids are rows of their own; other columns are ignored. Tables
    of long texts spill to the task's disk, but a text's tokens (about 100 bytes each) have to fit in memory.
    """
    context = docs.sparkSession.sparkContext
    a_data, b_data = context.broadcast(file_bytes(a_file)), context.broadcast(file_bytes(b_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        a_kind, b_kind = once(ByteLevel, a_data.value), once(PieceModel, b_data.value)
        most = max(len(a_kind.length), len(b_kind.length))
        names = [f"{i}{sign}" for sign in ",|;" for i in range(most)]
        with tempfile.TemporaryDirectory() as spilled, duckdb.connect(config={"threads": 1, "memory_limit": TABLE_MEMORY, "temp_directory": spilled}) as db:
            for batch in batches:
                for row, end, buf, offs in blocks(batch["text"], TABLE_BYTES):
                    texts = [buf[i:j].tobytes().decode() for i, j in zip(offs[:-1], offs[1:], strict=True)]
                    yield _aligned(db, batch["doc_id"].slice(row, end - row), texts, a_kind, b_kind, names)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, _SQL_TYPE).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _aligned(db: duckdb.DuckDBPyConnection, doc_id: pa.Array, texts: list[str], a_kind: ByteLevel, b_kind: PieceModel, names: list[str]) -> pa.RecordBatch:
    spelled = [(f" {t}".encode() if t else b"") for t in texts]
    a, b = a_kind.encode(texts), b_kind.encode(texts)
    same = [side_kind.spell(side, spelled) for side_kind, side in ((a_kind, a), (b_kind, b))]
    kept = [k for k, raw in enumerate(spelled) if raw and same[0][k] and same[1][k]]
    n_a, n_b, n_groups, n_links = np.zeros((4, len(texts)), np.int64)
    groups, links, partial = [""] * len(texts), pa.nulls(len(texts), pa.list_(_LINK)), pa.nulls(len(texts), pa.list_(_PARTIAL))
    if kept:
        a, b = [a[k] for k in kept], [b[k] for k in kept]
        table_a, table_b = _intervals(a, kept, a_kind), _intervals(b, kept, b_kind)
        db.register("a", table_a)
        db.register("b", table_b)
        cuts = db.execute(_CUTS).fetchnumpy()
        group_a, group_b = (cuts["g"][np.searchsorted(cuts["stop"], side["stop"].to_numpy())] for side in (table_a, table_b))
        db.execute(_LINKS)
        by_doc, by_pair = (db.sql(sql).to_arrow_table().combine_chunks() for sql in (_BY_DOC, _BY_PAIR))
        n_a[kept], n_b[kept] = [len(x) for x in a], [len(x) for x in b]
        ends = n_a[kept].cumsum()
        n_groups[kept] = group_a[ends - 1] - group_a[ends - n_a[kept]] + 1
        n_links[kept] = by_doc["n_links"].to_numpy()
        for k, text in zip(kept, _written(a, b, group_a, group_b, names), strict=True):
            groups[k] = text
        at = np.full(len(texts), -1)
        at[kept] = np.arange(len(kept))
        links = by_doc["links"].combine_chunks().take(pa.array(at, mask=at < 0)).cast(pa.list_(_LINK))
        partial = by_pair["partial"].combine_chunks().take(pa.array(np.zeros(len(texts), np.int64), mask=np.arange(len(texts)) > 0)).cast(pa.list_(_PARTIAL))
    counts = [pa.array(x) for x in (n_a, n_b, n_groups, n_links)]
    return pa.RecordBatch.from_arrays([doc_id, *counts, pa.array(groups, pa.string()), links, partial], schema=_MADE)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, docs, best): in how many rows of align() each pair is linked, and the highest such number of its A id.

    A group of the window is the B ids that one A id meets, at most B's vocabulary.
    """
    merged = aligned.where("partial IS NOT NULL").select(F.inline("partial")).groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    return merged.withColumn("best", F.max("docs").over(Window.partitionBy("a")))


def weigh(aligned: DataFrame, counts: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(row, n_best, count_sum) for rows (row, links) that have links: links whose pair is its A id's most frequent, and the sum of all their counts.

    counts is broadcast if it is small, which is counted first; otherwise each text's distinct links are shuffled to it.
    """
    counts = F.broadcast(counts) if counts.limit(max_broadcast + 1).count() <= max_broadcast else counts
    met = aligned.select("row", F.inline("links")).join(counts, ["a", "b"])
    return met.groupBy("row").agg(F.sum(F.when(F.col("docs") == F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))


def digest(docs: DataFrame, a_file: str, b_file: str, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs; see align()."""
    made = align(docs, a_file, b_file)
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = checkpoint(made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", hashed, "links", "partial"))
    counts = checkpoint(pair_counts(aligned))
    sums = weigh(aligned, counts, max_broadcast)
    out = aligned.join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
