"""What the operators share: tables, the shared folder, and word and hash arithmetic on the bytes of Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; small enough for the processor's caches.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD1342543DE82EF95)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Spark drops the shuffle files of a query as soon as it has ended: what it made is in the shared folder by then.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, under spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a folder of its own. On a cluster that is an error: each machine
    would write to its own disk, and rows would be missing without a word.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/glyphledger-checkpoints"
    return f"{base}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder; a lost executor loses none of it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that checkpoint() wrote, once all that is made from them has been written itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._shared_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """A column name made of `name` that none of the columns has; Spark takes names in any case for equal."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod5(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


#: Each byte value's own random 64-bit value.
BYTE64 = mix64((np.arange(256, dtype=U64) + U64(1)) * _ODD)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)
        inverse = 1
        for _ in range(6):
            inverse = inverse * (2 - int(_BASE) * inverse) % 2**64
        self.inverse = U64(inverse)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * BLOCK_BYTES)
            for name, base in (("up", _BASE), ("down", self.inverse)):
                p = np.full(size, base, U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U64))
        return self.up, self.down


POWERS = _Powers()


class PrefixHash:
    """Hashes of any substrings of one byte block, from running sums modulo 2**64."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.up, self.down = POWERS.to(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        """The hash of each window of this length, by its start (not yet mixed)."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows that hold about limit bytes."""
    buf, offs = text_of(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_spans(is_word: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes that stays within a row, and how many of them each row has."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    inner = offs[:-1][offs[:-1] < offs[1:]]
    first[inner] = is_word[inner]
    inner = offs[1:][offs[:-1] < offs[1:]] - 1
    last[inner] = is_word[inner]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.diff(np.searchsorted(start, offs))


def byte_table(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, letters and all that is not ASCII.
WORD_BYTES = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: All but the blanks x20 and x09 to x0D.
NONBLANK_BYTES = ~byte_table([0x20, *range(0x09, 0x0E)])


def hashed_words(buf: np.ndarray, offs: np.ndarray, members: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes (never 0) of the lower-cased words of a block, their byte spans, and the words of each row."""
    start, stop, per_row = word_spans(members[buf], offs)
    h = PrefixHash(BYTE64[LOWER[buf]]).of(start, stop) if len(start) else np.zeros(0, U64)
    h[h == 0] = 1
    return h, start, stop, per_row


def shingles(words: np.ndarray, per_row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of `width` words (one of all its words where it has fewer, none where it has none), and the row of each."""
    ends = np.cumsum(per_row)
    starts = ends - per_row
    n = np.where(per_row >= width, per_row - width + 1, (per_row > 0).astype(per_row.dtype))
    row = np.repeat(np.arange(len(per_row)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[row]
    full = per_row[row] >= width
    h = np.zeros(len(at), U64)
    for j in range(width):
        there = full | (at + j < ends[row])
        h = np.where(there, (h ^ words[np.minimum(at + j, max(len(words) - 1, 0))]) * _ODD + (h >> U64(29)), h) if len(words) else h
    return mix64(h), row


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
