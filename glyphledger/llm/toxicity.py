"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding undoes common disguises: case, homoglyphs (Cyrillic and Greek look-alikes, full-width and accented letters) and
digits or signs in place of letters inside words. The lexicon is learned from labelled documents: whole words and word
beginnings that toxic documents have and clean ones have not. The number of labelled documents used has a documented
bound, and so has the lexicon with it; every document is scored on its whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphledger.llm.common import checkpoint, discard, unused

#: Characters that look like ASCII letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g"}
#: Digits, and signs before or between letters, written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {r"@(?=[a-z])": "a", r"\$(?=[a-z])": "s", r"(?<=[a-z])[!|](?=[a-z])": "i"}
#: Accented letters and their base.
ACCENTED = {"a": "áàâäãåā", "e": "éèêëē", "i": "íìîïī", "o": "óòôöõō", "u": "úùûüū", "y": "ýÿ", "n": "ñň", "c": "çč", "s": "š", "z": "ž", "r": "ř", "t": "ť", "d": "ď", "l": "ľĺ"}
#: Phrases in which a term is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash day", "clown fish", "pond scum", "idiot proof", "stupid simple")

SAMPLE_DOCS = 40_000
MIN_SHARE = 0.01
PREFIX = (4, 8)
#: Different terms that a task counts before it passes its counts on.
COUNTED = 200_000


def fold(text: Column) -> Column:
    """Words of the folded text, each with a blank before and after: ' stupid trash '. Null becomes blank."""
    alike = HOMOGLYPHS | {x: base for base, marked in ACCENTED.items() for x in marked} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | DIGITS
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(alike), "".join(alike.values()))
    for sign, letter in SIGNS.items():
        low = F.regexp_replace(low, sign, letter)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def terms_of(folded: str) -> set[str]:
    """The terms of a folded text: its words of three letters or more, and the beginnings of longer ones."""
    lo, hi = PREFIX
    words = {w for w in folded.split(" ") if len(w) >= 3}
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(lo, min(len(w), hi) + 1)}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, folded text) to (term, t, c): how many toxic and clean texts have a term, counted within each task."""
    counts: dict[str, list[int]] = {}

    def counted() -> pa.RecordBatch:
        seen = list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([n[k] for n in seen], pa.int64()) for k in (1, 0))], names=["term", "t", "c"])

    for batch in batches:
        for toxic, folded in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for term in terms_of(folded.as_py()):
                counts.setdefault(term, [0, 0])[toxic] += 1
            if len(counts) > COUNTED:
                yield counted()
                counts.clear()
    if counts:
        yield counted()


def learn(docs: DataFrame, labels: DataFrame, train: Column, *, sample_docs: int = SAMPLE_DOCS) -> dict:
    """The lexicon {term: weight} and the calibration, from at most `sample_docs` labelled documents.

    A term begins with a blank (a word's beginning) and ends with one if it is a whole word. Its weight is the smoothed log
    ratio of its shares of toxic and of clean documents. Rows with a null id, text or label teach nothing. Without toxic and
    clean examples the lexicon is empty and every score is the prior's.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(train & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    # which documents: the smallest hashes of the ids, so that reruns and any partitioning agree
    chosen = rows.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    n = chosen.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    if not n.t or not n.c:
        return {"terms": {}, "prior": 0.5 if n.t == n.c else 0.99 if n.t else 0.01, "gain": 1.0, "bias": 0.0}
    # folded once: the terms are counted on it, and the lexicon that comes of them is calibrated on it
    sample = checkpoint(rows.join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), fold(F.col("text")).alias("folded")))
    counted = sample.mapInArrow(_count_terms, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # copies of a passage make terms of its words; a term has to show in a share of all toxic documents
    counted = checkpoint(counted.where(F.col("t") >= max(3, math.ceil(MIN_SHARE * n.t))))
    weight = F.log((F.col("t") + 0.5) / (n.t + 1)) - F.log((F.col("c") + 0.5) / (n.c + 1))
    # of many candidates some look toxic by chance: the likelihood ratio against the prior has to beat their number
    prior = n.t / (n.t + n.c)
    seen = F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") / seen / prior) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / seen / (1 - prior))).otherwise(0.0))
    chance = 2 * math.log(1 + counted.count()) + 4
    best = counted.withColumns({"weight": weight, "ratio": ratio}).where((F.col("weight") >= 2.0) & (F.col("ratio") >= chance)).orderBy(F.desc("ratio"), F.length("term"), "term").collect()  # each has its share of a bounded sample
    found: dict[str, float] = {}
    for r in best:  # a term adds nothing where its beginning is in already, unless it is far surer
        inner = [x for x in found if r.term.startswith(x)]
        if not inner or r.weight > max(found[x] for x in inner) + 1.5:
            found[r.term] = float(r.weight)
    gain = _calibrate(sample, found, prior)
    discard(sample, counted)
    return {"terms": found, "prior": prior} | gain


def _calibrate(sample: DataFrame, terms: dict, prior: float) -> dict:
    """Gain and bias of the logistic score, by Newton steps on counts of the (rounded) raw score; these are few."""
    if not terms:
        return {"gain": 1.0, "bias": 0.0}
    scored = sample.select("toxic", match({"terms": terms})("folded").alias("raw"))
    counts = [(r.raw, r.t, r.n) for r in scored.groupBy(F.round(F.least("raw", F.lit(20.0)), 1).alias("raw")).agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()]
    a, b = 1.0, math.log(prior / (1 - prior))
    for _ in range(30):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, t, n in counts:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            d, w = t - n * p, n * p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + d * x, g1 + d, h00 + w * x * x, h01 + w * x, h11 + w
        h00, h11, g0 = h00 + 1.0, h11 + 0.01, g0 - (a - 1.0)  # a weak prior keeps separable data finite
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + max(-2.0, min(2.0, da)), b + max(-2.0, min(2.0, db))
    return {"gain": max(a, 0.05), "bias": b - math.log(prior / (1 - prior))}


def match(model: dict, exceptions: tuple[str, ...] = EXCEPTIONS):
    """A pandas UDF: summed weights of a folded text's terms, over a slowly growing function of its words."""
    terms = dict(model["terms"])

    def build():
        import ahocorasick

        auto = ahocorasick.Automaton()
        for term, weight in terms.items():
            auto.add_word(term, (len(term), weight))
        for phrase in exceptions:
            auto.add_word(f" {phrase} ", (len(phrase) + 2, None))
        auto.make_automaton()
        return auto

    def raw(auto, text: str) -> float:
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in auto.iter(text):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:  # one weight for each place, the surest
                best[start] = max(best.get(start, 0.0), weight)
        total, at, until = 0.0, 0, 0
        spared.sort()
        for s in sorted(best):
            while at < len(spared) and spared[at][0] <= s:
                until = max(until, spared[at][1])
                at += 1
            total += best[s] if s >= until else 0.0
        return total / (1 + math.log1p(text.count(" ") / 400)) if total else 0.0

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = build()
        for batch in texts:
            yield batch.map(lambda t: raw(auto, t)).astype("float64")

    return score


def score(docs: DataFrame, model: dict, *, text: str = "text", to: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; empty and null texts get the score of a text without terms. A column of its name is replaced."""
    base = math.log(model["prior"] / (1 - model["prior"]))
    hits = match(model)(fold(F.col(text)))
    return docs.withColumn(to, 1 / (1 + F.exp(-(F.lit(base + model["bias"]) + F.lit(model["gain"]) * hits))))


def drop_toxic(docs: DataFrame, model: dict, *, threshold: float = 0.5) -> DataFrame:
    """docs without those that score `threshold` or more."""
    to = unused("_toxicity", docs.columns)
    return score(docs, model, to=to).where(F.col(to) < threshold).drop(to)
