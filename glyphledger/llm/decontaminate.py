"""Benchmark decontamination with suffix arrays of the training text.

Every block of training documents is a shard. Its suffixes (at word starts) are sorted, and every suffix of the benchmark
items is looked up in them by binary search; the run of equal suffixes gives all its occurrences, and occurrences of
successive item suffixes on one diagonal join to the longest verbatim matches. The benchmark is the stated query set: it
is taken in blocks of bounded size, each sent to all shards in turn. No step shuffles documents.

All suffixes are sorted by their first two words; the runs in which a test suffix falls are sorted by as many words as a
window has, and searched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphledger.llm import common as C

#: Bytes of benchmark text in one broadcast block.
BENCH_BLOCK_BYTES = 8 << 20


class Windows:
    """The distinct windows of some benchmark items, and in which items each is and where."""

    def __init__(self, items: list[tuple], width: int) -> None:
        self.width = width
        self.ids = [i for i, _ in items]
        column = pa.array([t or "" for _, t in items], pa.large_string())
        rows, lengths, owner, place = [], [], [], []
        for lo, hi, buf, offs in C.blocks(column):
            words, _, _, per_row = C.hashed_words(buf, offs)
            first = np.cumsum(per_row) - per_row
            for i in range(hi - lo):
                w = words[first[i] : first[i] + per_row[i]]
                if not len(w):
                    continue
                if len(w) < width:
                    w = np.concatenate([w, np.zeros(width - len(w), C.U64)])
                grid = np.lib.stride_tricks.sliding_window_view(w, width)
                rows.append(grid)
                lengths.append(np.full(len(grid), min(per_row[i], width)))
                owner.append(np.full(len(grid), lo + i))
                place.append(np.arange(len(grid)))
        self.empty = not rows
        if self.empty:
            return
        grid = np.ascontiguousarray(np.concatenate(rows))
        lengths, owner, place = (np.concatenate(x) for x in (lengths, owner, place))
        _, first, which = np.unique(grid.view([("", C.U64)] * width).ravel(), return_index=True, return_inverse=True)
        which = which.ravel()
        self.words, self.lengths = grid[first], lengths[first]
        order = np.argsort(which, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.ends = np.cumsum(np.bincount(which, minlength=len(first)))
        self.starts = np.concatenate([[0], self.ends[:-1]])
        # where a window's suffixes begin and end among suffixes sorted by heads(); a window of one word has any second word
        low = heads(self.words[:, 0], np.where(self.lengths > 1, self.words[:, 1], C.U64(0)) if width > 1 else self.words[:, 0] * C.U64(0))
        high = np.where(self.lengths > 1, low, low | C.U64(0xFFFFFFFF))
        self.low = np.unique(low)
        self.high = np.maximum.reduceat(high[np.argsort(low, kind="stable")], np.searchsorted(np.sort(low), self.low))


def heads(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The upper halves of two words in one number."""
    return (first & ~C.U64(0xFFFFFFFF)) | (second >> C.U64(32))


def search(words: np.ndarray, tests: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence of a window in the text words: a suffix array and two binary searches.

    words: rows closed by a 0, and `width` zeros at the end.
    """
    body = np.flatnonzero(words[: len(words) - tests.width])
    key = heads(words[body], words[body + 1])
    order = np.argsort(key)
    key = key[order]
    begin, end = np.searchsorted(key, tests.low, "left"), np.searchsorted(key, tests.high, "right")
    inside = np.cumsum(np.bincount(begin, minlength=len(key) + 1) - np.bincount(end, minlength=len(key) + 1))[:-1] > 0
    at = body[order[inside]]
    if not len(at):
        return at, at
    keys = words[at[:, None] + np.arange(tests.width)]
    order = np.lexsort(keys.T[::-1])
    suffixes, keys = at[order], keys[order]
    inside = np.arange(tests.width) < tests.lengths[:, None]

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(inside), np.int64), np.full(len(inside), len(suffixes))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            mine, its = keys[mid], tests.words[open_]
            differ = (mine != its) & inside[open_]
            j = differ.argmax(1)
            k = np.arange(len(open_))
            unlike = differ[k, j]
            below = unlike & (mine[k, j] < its[k, j])
            right = below | ~unlike if upper else below
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    lo, hi = bound(False), bound(True)
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    return suffixes[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[window]], window


def longest_matches(tests: Windows, pos: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, position, words, place in the item): occurrences of windows, joined along each diagonal."""
    n = tests.ends[window] - tests.starts[window]
    k = np.repeat(np.arange(len(n)), n)
    ref = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + tests.starts[window][k]
    item, place, pos, size = tests.owner[ref], tests.place[ref], pos[k], tests.lengths[window][k]
    order = np.lexsort((pos, pos - place, item))
    item, place, pos, size = item[order], place[order], pos[order], size[order]
    new = np.ones(len(pos), bool)
    new[1:] = (item[1:] != item[:-1]) | (pos[1:] - place[1:] != pos[:-1] - place[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos))[: len(first)] - 1
    return item[first], pos[first], pos[last] + size[last] - pos[first], place[first]


def _leaks_type(item_type: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", item_type), T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("item_start", T.LongType())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = 10, bench_block_bytes: int = BENCH_BLOCK_BYTES) -> DataFrame:
    """The rows of docs with n_words and leaks, an array of (item_id, start, words, item_start): longest verbatim matches.

    Words are lower-cased runs of letters, digits and non-ASCII characters. A window is `width` successive words of an item
    (all of them where it has fewer); matches shorter than a window don't count. A null or wordless text has no words and no
    leaks; a null or wordless item leaks nowhere; repeated documents and items each count. Columns named n_words or leaks
    are replaced (decontaminate() keeps them). An empty benchmark leaves every row without leaks.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id"), F.col("text").alias("text")).where("text is not null")
    item_type = benchmark.schema["item_id"].dataType
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // bench_block_bytes))
    leaks = _leaks_type(item_type)
    kept = [c for c in docs.columns if c not in ("n_words", "leaks")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("leaks", leaks)])
    out = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(leaks).alias("leaks"))
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n_blocks)) == k)
        tests = spark.sparkContext.broadcast(Windows([tuple(r) for r in block.toLocalIterator()], width))

        def run(batches: Iterator[pa.RecordBatch], tests=tests, text=text) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _search_batch(batch, text, tests.value)

        out = out.mapInArrow(run, schema)
    return out


def _search_batch(batch: pa.RecordBatch, text: str, tests: Windows) -> pa.RecordBatch:
    column = batch.column(batch.schema.names.index(text))
    n_words = np.zeros(len(batch), np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    for lo, hi, buf, offs in C.blocks(column):
        words, _, _, per_row = C.hashed_words(buf, offs)
        n_words[lo:hi] = per_row
        if tests.empty or not len(words):
            continue
        row_of = np.repeat(np.arange(hi - lo), per_row)
        first = np.cumsum(per_row) - per_row
        closed = np.zeros(len(words) + (hi - lo) + tests.width, C.U64)
        closed[np.arange(len(words)) + row_of] = words
        pos, window = search(closed, tests)
        if len(pos):
            item, pos, size, place = longest_matches(tests, pos, window)
            row = np.searchsorted(first + np.arange(hi - lo), pos, "right") - 1
            # rows without words share their start with the next row's zero; the last of them holds the words
            found.append((row + lo, item, pos - row - first[row], size, place))
    leaks_type = batch.schema.field("leaks").type
    if found:
        row, item, start, size, place = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        row = item = start = size = place = np.zeros(0, np.int64)
    before = batch.column(batch.schema.names.index("leaks"))
    had = np.asarray(before.value_lengths().fill_null(0)) if len(batch) else np.zeros(0, np.int64)
    ids = pa.array([tests.ids[i] for i in item], leaks_type.value_type.field("item_id").type)
    fresh = [ids, pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(place, pa.int64())]
    old = before.flatten()
    order = np.argsort(np.concatenate([np.repeat(np.arange(len(batch)), had), row]), kind="stable")
    parts = [pa.concat_arrays([old.field(i) if len(old) else pa.array([], f.type), f]).take(pa.array(order)) for i, f in enumerate(fresh)]
    total = np.concatenate([[0], np.cumsum(had + np.bincount(row, minlength=len(batch)))])
    value = pa.StructArray.from_arrays(parts, fields=list(leaks_type.value_type))
    made = pa.ListArray.from_arrays(pa.array(total, pa.int32()), value)
    columns = [pa.array(n_words) if c == "n_words" else made if c == "leaks" else batch.column(i) for i, c in enumerate(batch.schema.names)]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def summarize(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the leaks of find_leaks()."""
    spans = F.array_sort(F.transform("leaks", lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["words"]).alias("stop"))))
    zero = F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("total"))
    add = lambda a, x: F.struct(F.greatest(a["stop"], x["stop"]).alias("stop"), (a["total"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(a["stop"], x["start"]))).alias("total"))
    items = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: F.coalesce(x["item_id"].cast("string"), F.lit("")))))
    return found.withColumns({"n_hit": F.aggregate(spans, zero, add)["total"], "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(items, ","), 256), "contaminated": F.size("leaks") > 0})


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = 10) -> DataFrame:
    """docs without the rows that hold a window of a benchmark item."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return find_leaks(packed, benchmark, width=width).where(F.size("leaks") == 0).select("row.*")
