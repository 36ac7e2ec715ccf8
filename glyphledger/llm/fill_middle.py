"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and the middle is moved to the end.

Each text becomes a numpy array of code points; where a non-blank meets a blank a unit ends, and the two cuts are taken among
these ends. Which documents are rearranged, and where, follows from a seed and the document's id alone, so reruns, retries and
other partitionings agree. Texts stay in their rows: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphledger.llm.common import blocks

#: The marks before prefix, suffix and middle, and the blanks that separate units.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLANK = np.zeros(0x21, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

_MADE = pa.schema([("doc_id", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def unit_ends(points: np.ndarray) -> np.ndarray:
    """Where the units of a text end: behind each run of non-blanks, and at the end of the text."""
    if not len(points):
        return np.zeros(0, np.int64)
    blank = _BLANK[np.minimum(points, 0x20)] & (points <= 0x20)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(points))


def _rearranged(raw: bytes, draws: tuple[int, int, int, int], rate: int, spm_share: int) -> tuple:
    """(n, form, characters of the prefix, of the middle, output) of one text."""
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = unit_ends(points)
    n, (h1, h2, h3, h4) = len(ends), draws
    if not n or h3 % 100 >= rate or any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    edge = lambda rank: int(ends[rank - 1]) if rank else 0
    a, b = sorted((edge(h1 % (n + 1)), edge(h2 % (n + 1))))
    piece = lambda i, j: points[i:j].tobytes().decode("utf-32-le").encode("utf-8")
    head, middle, tail = piece(0, a), piece(a, b), piece(b, len(points))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm_share:
        return n, "spm", a, b - a, s + tail + p + head + m + middle
    return n, "psm", a, b - a, p + head + s + tail + m + middle


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_share: int = 80) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of each row of docs (doc_id, text).

    n counts units (a run of non-blanks with the blanks before it, or the blanks at the end). rate of 100 documents are
    rearranged, of these spm_share of 100 as suffix, prefix, middle (spm), the others as prefix, suffix, middle (psm); the
    rest, empty texts and texts that hold a mark themselves are plain, with null for both lengths. A null text counts as
    empty, a null doc_id as an empty id. Rows with equal ids are cut at equal ranks; repeated rows stay. Both cuts may be at
    one place: then the middle is empty. Other columns are ignored. A text is decoded whole (about ten times its bytes).
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    each = [F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = list(zip(*(batch[f"h{i}"].to_pylist() for i in (1, 2, 3, 4)), strict=True))
            for row, end, buf, offs in blocks(batch["text"]):
                made = [_rearranged(buf[offs[i] : offs[i + 1]].tobytes(), draws[row + i], rate, spm_share) for i in range(end - row)]
                n, form, prefix, middle, output = zip(*made, strict=True)
                part = batch.slice(row, end - row)
                columns = [part["doc_id"], part["text"], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=_MADE)

    made = rows.mapInArrow(run, "doc_id string, text string, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    after = lambda text, mark: F.substring_index(text, mark, -1)
    before = lambda text, mark: F.substring_index(text, mark, 1)
    middle, front = after(output, MIDDLE), before(output, MIDDLE)
    spm = F.concat(after(front, PREFIX), middle, after(before(front, PREFIX), SUFFIX))
    psm = F.concat(after(before(front, SUFFIX), PREFIX), middle, after(front, SUFFIX))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """The rows of fill_in_middle() with hashes in place of texts; the restored text comes from output and form."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
