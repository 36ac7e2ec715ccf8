"""Mixing sources to target weights by the cube method.

Each source gets a target of tokens from its weight; a document of a source with target / size = r is taken floor(r) times
for certain and once more with the probability that is left. The cube method turns these probabilities into 0 or 1 so that
token and document totals hold: the flight phase moves the fractional probabilities along the null space of the balancing
constraints until each but a few are 0 or 1. Documents are flown in salted blocks of bounded size; the few that each block
leaves open fly again together, level by level; the last few of a source land where the totals stay nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphledger.llm.common import checkpoint

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL, CAP = 1.5, 2.0
#: Documents that fly together in one block.
BLOCK_DOCS = 4096
#: Documents of a source that the landing settles.
LANDING_DOCS = 14
_CLOSE = 1e-9


def size_of(text: Column) -> Column:
    """Number of runs of characters other than x20 and x09 to x0D; null has none."""
    blank = r"[\x20\x09-\x0D]+"
    words = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), blank, " "), "^ | $", "")
    return F.when(words == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) for rows (source, source_size) of any number of sources.

    Weights repeat over the sources in code point order, null last. The targets share total x all sizes by weight; a target
    stops at cap x its source's size and what is over is shared by weight again, until none is above.
    """
    # a rank over all sources without one task that holds them: sorted partitions, and how many rows come before each
    sizes = sizes.select("source", "source_size").orderBy(F.col("source").asc_nulls_last()).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    sizes = checkpoint(sizes)
    before, seen = {}, 0
    for part, n in sorted((r.part, r.n) for r in sizes.groupBy("part").agg(F.count("*").alias("n")).collect()):
        before[part], seen = seen, seen + n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in (before or {0: 0}).items() for x in pair]), F.col("part"))
    rank = offset + F.col("place").bitwiseAND((1 << 33) - 1)
    ranked = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).alias("weight"))
    whole = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * total
    level = None
    while True:  # each pass fixes the sources that the last level puts over their cap; a pass without a new one ends it
        over = F.lit(False) if level is None else F.col("weight") * level > F.col("source_size") * cap
        held = ranked.agg(F.sum(F.when(over, F.col("source_size") * cap).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("rest"), F.count_if(over).alias("n")).first()
        new = (whole - (held.held or 0.0)) / held.rest if held.rest else None
        if new is None or new == level:
            break
        level = new
    share = F.col("source_size") * cap if level is None else F.least(F.col("weight") * level, F.col("source_size") * cap)
    return ranked.select("source", "source_size", share.cast("double").alias("target"))


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Move probabilities until at most `leave` (2 or more) are fractional, keeping their sum and the sum of prob x size.

    Two constraints, so any three fractional units have a null direction; it is followed to the next face of the cube, up
    or down at odds that keep each unit's expected value.
    """
    p = prob.copy()
    open_ = [int(i) for i in np.flatnonzero((p > _CLOSE) & (p < 1 - _CLOSE))]
    # units of like size next to each other keep the steps, and what the landing can lose, small
    open_.sort(key=lambda i: (-size[i], i))
    draws = iter(rng.random(len(open_) + 1).tolist())
    p, s = p.tolist(), size.tolist()
    held: list[int] = []
    # what is left for the landing has sizes of all kinds, so that its sums come near any total
    spare = {open_[int(i)] for i in np.linspace(0, len(open_) - 1, min(leave - 2, len(open_)))}
    for unit in [i for i in open_ if i not in spare]:
        held.append(unit)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])  # orthogonal to (1, 1, 1) and to the sizes
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(held, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        step = up if next(draws) < down / (up + down) else -down
        for i, d in zip(held, u, strict=True):
            p[i] += step * d
        held = [i for i in held if _CLOSE < p[i] < 1 - _CLOSE]
    p = np.array(p)
    p[p <= _CLOSE], p[p >= 1 - _CLOSE] = 0.0, 1.0
    return p


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few units that are still fractional so that the size total, then their number, stays nearest."""
    at = np.flatnonzero((prob > 0) & (prob < 1))
    p = prob.copy()
    if len(at):
        choices = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        off = np.abs((choices - prob[at]) @ size[at])
        p[at] = choices[np.lexsort((np.abs((choices - prob[at]).sum(1)), off))[0]]
    return p


def _fly(level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows of whole blocks; a block may go on in the next batch."""
        rest: pd.DataFrame | None = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (rest["source_key"].iloc[-1], rest["block"].iloc[-1]) if len(rest) else None
            done = (rest["source_key"] != last[0]) | (rest["block"] != last[1]) if last else pd.Series(dtype=bool)
            if done.any():
                yield flown(rest[done])
                rest = rest[~done].reset_index(drop=True)
        if rest is not None and len(rest):
            yield flown(rest)

    def flown(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        out = rows["prob"].to_numpy(copy=True)
        size = rows["size"].to_numpy().astype(float)
        for (key, block), at in rows.groupby(["source_key", "block"], sort=False).indices.items():
            rng = np.random.default_rng([int(key) & 0xFFFFFFFF, int(block) & 0xFFFFFFFF, level])
            last = rows["blocks"].iloc[at[0]] == 1
            p = flight(out[at], size[at], rng, LANDING_DOCS if last else 2)
            if last:
                p = land(p, size[at])
            out[at] = p
        return rows.assign(prob=out)

    return run


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, size, source_size, target and taken (the document's size times its copies in the mix) for each row of docs.

    Reads doc_id, text and source; other columns are ignored. No document is taken more than ceil(cap) times. A null source
    is a source; documents without words have size 0 and are never taken; identical rows are separate documents. Draws
    depend on ids and texts alone, so reruns agree. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", size_of(F.col("text")).alias("size"), "source", F.xxhash64(F.coalesce("source", F.lit("\0null")), F.col("source").isNull()).alias("source_key"), F.xxhash64("doc_id", "text").alias("draw"))
    rows = checkpoint(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    shares = checkpoint(targets(sources, weights=weights, total=total, cap=cap))
    counts = sources.select(F.col("source").alias("s"), "n")
    shares = shares.join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = rows.withColumnRenamed("source", "own").join(shares, F.col("own").eqNullSafe(F.col("source"))).withColumn("rate", F.when(F.col("size") > 0, F.least(rate, F.lit(cap))).otherwise(0.0))
    wanted = wanted.withColumns({"sure": F.floor("rate").cast("long"), "prob": F.col("rate") - F.floor("rate")})
    # salted blocks of one source; a block holds block_docs documents or so, whatever the source's size
    open_ = wanted.withColumn("blocks", F.ceil(F.col("n") / block_docs)).select("doc_id", "size", "source_key", "draw", "source_size", "target", "sure", "prob", "blocks")
    most = -(-(sources.agg(F.max("n")).first()[0] or 0) // block_docs)
    out, level = None, 0
    while True:
        open_ = open_.withColumn("block", F.pmod(F.xxhash64("draw", F.lit(level)), F.col("blocks")))
        flown = checkpoint(open_.repartition("source_key", "block").sortWithinPartitions("source_key", "block", "size", "doc_id", "draw").mapInPandas(_fly(level), open_.schema))
        fixed = flown.where("prob in (0, 1)")
        out = fixed if out is None else out.unionByName(fixed)
        if most <= 1:
            break
        # each block has left two documents at most; they fly again together
        most, level = -(-2 * most // block_docs), level + 1
        open_ = flown.where("prob not in (0, 1)").withColumn("blocks", F.ceil(F.col("blocks") * 2 / block_docs))
    return out.select("doc_id", "size", "source_size", "target", ((F.col("sure") + F.col("prob").cast("long")) * F.col("size")).cast("long").alias("taken"))
