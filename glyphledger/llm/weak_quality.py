"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of
vote patterns estimates how accurate each labeller is and how common good documents are; no hand label is read. The
posterior of a document's votes is its soft label. A hashed linear scorer is then fitted to the soft labels of a bounded
sample, and scores every document from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphledger.llm import common as C

#: Documents whose soft labels fit the scorer: those with the smallest hashes of their text.
SAMPLE_DOCS = 12_000
HASH_BITS = 16
#: Labellers as (name, measure, bad below, good from, good to, bad above).
LABELLERS = (
    ("words", "words", 1, 3, 1e9, 1e12),
    ("word_length", "word_length", 2.2, 3.2, 8.5, 12.0),
    ("letters", "letters", 0.60, 0.72, 1.0, 2.0),
    ("symbols", "symbols", -1.0, 0.0, 0.01, 0.02),
    ("capitals", "capitals", -1.0, 0.0, 0.10, 0.40),
    ("line_copies", "line_copies", -1.0, 0.0, 0.05, 0.30),
    ("word_variety", "word_variety", 0.10, 0.30, 1.1, 9.0),
    ("word_copies", "word_copies", -1.0, 0.0, 0.03, 0.12),
    ("sentence_marks", "sentence_marks", 0.0, 0.002, 0.08, 0.12),
)
MEASURES = tuple(dict.fromkeys(m for _, m, *_ in LABELLERS))
_LETTERS = C.byte_table([*range(65, 91), *range(97, 123), *range(128, 256)])
_CAPITALS = C.byte_table(range(65, 91))
_MARKS = C.byte_table(b".!?")
_SYMBOLS = ~(C.WORD_BYTES | C.byte_table(b" \t\n\r\x0b\x0c.,;:!?'\"()-"))


def measures(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One column for each of MEASURES and a row for each text."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1).astype(float)
    share = lambda members: np.diff(np.concatenate([[0], np.cumsum(members[buf])])[offs]) / size
    words, start, stop, per_row = C.hashed_words(buf, offs)
    row = np.repeat(np.arange(n), per_row)
    count = np.maximum(per_row, 1).astype(float)
    length = np.bincount(row, stop - start, n) / count
    first = np.unique(np.stack([row.astype(C.U64), words]), axis=1) if len(words) else np.zeros((2, 0), C.U64)
    variety = np.bincount(first[0].astype(np.int64), minlength=n) / np.minimum(count, 200 + count / 8)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    again = np.bincount(row, again, n) / count
    lines, _, _, lines_per_row = C.hashed_words(buf, offs, ~C.byte_table(b"\n"))
    line_row = np.repeat(np.arange(n), lines_per_row)
    kinds = np.unique(np.stack([line_row.astype(C.U64), lines]), axis=1) if len(lines) else np.zeros((2, 0), C.U64)
    copies = 1 - np.bincount(kinds[0].astype(np.int64), minlength=n) / np.maximum(lines_per_row, 1)
    letters = np.maximum(share(_LETTERS), 1e-9)
    return np.stack([per_row, length, letters, share(_SYMBOLS), share(_CAPITALS) / letters, np.where(lines_per_row > 0, copies, 0), variety, again, share(_MARKS)], 1)


def votes(m: np.ndarray) -> np.ndarray:
    """-1 (bad), 0 (nothing) or 1 (good) of each labeller; a text without words gets no good vote."""
    out = np.zeros((len(m), len(LABELLERS)), np.int8)
    for j, (_, name, bad_below, good_from, good_to, bad_above) in enumerate(LABELLERS):
        x = m[:, MEASURES.index(name)]
        out[:, j] = np.where((x < bad_below) | (x > bad_above), -1, np.where((x >= good_from) & (x <= good_to) & (m[:, 0] > 0), 1, 0))
    return out


_PLACES = 3 ** np.arange(len(LABELLERS))


def features(buf: np.ndarray, offs: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the hashed features: words of the whole text by share, and its measures in steps."""
    words, _, _, per_row = C.hashed_words(buf, offs)
    n = len(offs) - 1
    row = np.repeat(np.arange(n), per_row)
    slot = (words >> C.U64(64 - HASH_BITS)).astype(np.int64)
    key, count = np.unique(row << HASH_BITS | slot, return_counts=True)
    r, s = key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)
    value = np.sqrt(count / np.maximum(per_row, 1)[r]) * 0.5
    steps = [np.log2(1 + m[:, 0]) * 2, m[:, 1] * 2, m[:, 2] * 20, m[:, 3] * 50, m[:, 4] * 20, m[:, 5] * 20, m[:, 6] * 10, m[:, 7] * 20, np.sqrt(m[:, 8]) * 40]
    for j, x in enumerate(steps):
        h = C.mix64(np.clip(x, 0, 60).astype(C.U64) + C.U64(1000 * (j + 1)))
        r, s, value = np.append(r, np.arange(n)), np.append(s, (h >> C.U64(64 - HASH_BITS)).astype(np.int64)), np.append(value, np.ones(n))
    return r, s, value


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over vote patterns: (rates[class, labeller, vote + 1], share of good, posterior good).

    Given the class (0 bad, 1 good), votes are independent, and each labeller has its own rates of bad, missing and good
    votes. The start takes any bad vote for a sign of a bad document, which settles which class is which.
    """
    hot = (patterns[:, :, None] + 1) == np.arange(3)
    post = np.where((patterns < 0).any(1), 0.05, 0.97)
    for _ in range(steps):
        weight = np.stack([1 - post, post]) * counts
        seen = np.einsum("cp,plv->clv", weight, hot) + np.array([[[1.0, 1.0, 1.0]], [[0.1, 1.0, 2.0]]])
        rates = seen / seen.sum(2, keepdims=True)
        good = float(np.clip(weight[1].sum() / counts.sum(), 0.02, 0.98))
        logs = np.einsum("plv,clv->cp", hot, np.log(rates))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - good) / good), -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return rates, good, new


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 6) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over sparse rows (slots, values, soft label), by adaptive gradient steps."""
    w, g2, bias = np.zeros(1 << HASH_BITS), np.full(1 << HASH_BITS, 1e-2), 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            s, v, y = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[s] @ v + bias, -30, 30)))
            g = (p - y) * v + 1e-5 * w[s]
            g2[s] += g * g
            w[s] -= 0.3 * g / np.sqrt(g2[s])
            bias -= 0.02 * (p - y)
    return w, bias


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in C.blocks(batch.column(1)):
            pattern = (votes(measures(buf, offs)) + 1) @ _PLACES
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(pattern, pa.int64())], names=["key", "pattern"])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in C.blocks(batch.column(1)):
            m = measures(buf, offs)
            r, s, v = features(buf, offs, m)
            order = np.argsort(r, kind="stable")
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=hi - lo))]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array((votes(m) + 1) @ _PLACES, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(s[order], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(v[order].astype(np.float32)))], names=["key", "pattern", "slots", "values"])


def learn(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> dict:
    """The model of docs (text): labeller accuracies from all of them, the scorer from at most `sample_docs`."""
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    counts = texts.mapInArrow(_vote_rows, "key long, pattern long").groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3 ** labellers at most; in order, so that sums of reruns agree
    if not counts:
        return {"accuracy": np.full((2, len(LABELLERS), 3), 1 / 3), "good": 0.5, "posterior": {}, "weights": np.zeros(1 << HASH_BITS), "bias": 0.0}
    keys, n = np.array([r.pattern for r in counts]), np.array([r.n for r in counts], float)
    accuracy, good, post = fit_accuracies((keys[:, None] // _PLACES % 3) - 1, n)
    posterior = dict(zip(keys.tolist(), post.tolist(), strict=True))
    chosen = texts.select("key").distinct().orderBy("key").limit(sample_docs)
    sample = texts.join(F.broadcast(chosen), "key").dropDuplicates(["key"])
    rows = [(np.array(r.slots), np.array(r["values"]), posterior.get(r.pattern, good)) for r in sorted(sample.mapInArrow(_feature_rows, "key long, pattern long, slots array<int>, values array<float>").toLocalIterator(), key=lambda r: r.key)]
    weights, bias = fit_scorer(rows)
    return {"accuracy": accuracy, "good": good, "posterior": posterior, "weights": weights, "bias": bias}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, weak_label, score (0 to 1, higher is better) and keep (score from 0.5) for each row of docs (doc_id, text).

    weak_label is the labellers' posterior alone. Null texts count as empty; these get bad and missing votes only, so they
    are not kept. Equal texts score the same. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, buf, offs in C.blocks(batch.column(1)):
                m = measures(buf, offs)
                r, s, v = features(buf, offs, m)
                z = np.bincount(r, model["weights"][s] * v, hi - lo) + model["bias"]
                p = np.where(m[:, 0] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                weak = [model["posterior"].get(int(x), model["good"]) for x in (votes(m) + 1) @ _PLACES]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(weak, pa.float64()), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "weak_label", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, weak_label double, score double, keep boolean")
