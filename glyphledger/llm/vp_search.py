"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

Vectors get one more component so that the largest inner product is the smallest Euclidean distance, where the triangle
inequality holds: sqrt(M^2 - |x|^2) for a stored vector, M the largest norm, and 0 for a query scaled to norm M. Shards are
placed by vantage points: each point belongs to its nearest pivot, and the points of a pivot are cut into rings of about
equal size by their distance to it. A query is sent to the nearest ring first; the distance of its k-th neighbour there
then tells which other rings it has to visit. Each shard has a tree of its own, built where its queries are. A ring or a
subtree is skipped if the triangle inequality shows that it holds nothing nearer than the current k-th neighbour divided by
`factor`; factor one is exact, a larger factor skips more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphledger.llm.common import checkpoint

K = 20
#: Pruning factor of the production query; recall against brute force is in the README.
FACTOR = 2.0
SHARD_ROWS, QUERY_ROWS, LEAF = 16_384, 16_384, 512
#: Most pivots, and rings of a pivot.
PIVOTS, RINGS = 256, 256


class VPTree:
    """Nodes split the points at the median distance to a vantage point; leaves hold up to `leaf` points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        # the vantage point: far from the first point, hence near the rim
        spread = ((self.points[at] - self.points[at[0]]) ** 2).sum(1)
        centre = self.points[at[int(spread.argmax())]]
        d = np.sqrt(((self.points[at] - centre) ** 2).sum(1))
        half = len(at) // 2
        order = np.argpartition(d, half)
        inner, outer = at[order[:half]], at[order[half:]]
        return centre, d[order[:half]].min(), d[order[:half]].max(), d[order[half:]].min(), d[order[half:]].max(), self._build(inner), self._build(outer)

    def nearest(self, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of each query's k nearest, and of all others that rounding might put among these; `bound`:
        distances beyond which nothing is wanted."""
        limit = np.full(len(queries), np.inf) if bound is None else bound**2
        best = np.full((len(queries), k), np.inf)
        norm, own = (self.points**2).sum(1), (queries**2).sum(1)
        slack = 1e-11 * (float(norm.max(initial=0.0)) + own)  # of squared distances, far above their rounding
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def reach(q: np.ndarray) -> np.ndarray:
            return np.minimum(best[q].max(1), limit[q]) + slack[q]

        def leaf(at: np.ndarray, q: np.ndarray) -> None:
            d2 = np.maximum(norm[at] - 2 * (queries[q] @ self.points[at].T) + own[q][:, None], 0)
            both = np.concatenate([best[q], d2], 1)
            best[q] = np.partition(both, k - 1, axis=1)[:, :k]
            i, j = np.nonzero(d2 <= reach(q)[:, None])
            found.append((q[i], at[j], d2[i, j]))

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                return leaf(node, q)
            centre, in_lo, in_hi, out_lo, out_hi, inner, outer = node
            d = np.sqrt(((queries[q] - centre) ** 2).sum(1))
            near_in = d <= (in_hi + out_lo) / 2
            for turn in (0, 1):
                for child, lo, hi, first in ((inner, in_lo, in_hi, near_in), (outer, out_lo, out_hi, ~near_in)):
                    side = first if turn == 0 else ~first
                    part = q[side]
                    gap = np.maximum(np.maximum(lo - d[side], d[side] - hi), 0)
                    visit(child, part[gap <= np.sqrt(reach(part)) / factor])

        visit(self.root, np.arange(len(queries)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, at, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = d2 <= reach(q)
        return q[keep], at[keep]


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Pivots:
    """Vantage points of each width, in the space with one more component."""

    def __init__(self, vectors: list[np.ndarray], most: float) -> None:
        self.most, self.by_width = most, {}
        for width in {len(v) for v in vectors}:
            x = np.stack([v for v in vectors if len(v) == width])
            self.by_width[width] = np.column_stack([x, np.sqrt(np.maximum(most**2 - (x**2).sum(1), 0))])

    def place(self, vectors: pd.Series) -> dict[str, np.ndarray]:
        """Width, nearest pivot (-1 where the width has none) and distance to it."""
        width, pivot, far = np.array([len(v) for v in vectors], np.int32), np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
        for w in set(width.tolist()) & set(self.by_width):
            at = np.flatnonzero(width == w)
            x = np.stack([vectors.iloc[i] for i in at])
            x = np.column_stack([x, np.sqrt(np.maximum(self.most**2 - (x**2).sum(1), 0))])
            p = self.by_width[w]
            d2 = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)
            pivot[at] = d2.argmin(1)
            far[at] = np.sqrt(((x - p[pivot[at]]) ** 2).sum(1))
        return {"width": width, "pivot": pivot, "far": far}

    def gaps(self, rings: pd.DataFrame, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rings of the query's width and how far the query is from each at least."""
        own = rings[rings["width"] == len(query)]
        p = self.by_width.get(len(query))
        if p is None:
            return own.index.to_numpy(), np.zeros(len(own))
        q = np.append(query * self.most / np.sqrt((query**2).sum()), 0.0)
        d = np.sqrt(((p - q) ** 2).sum(1))[own["pivot"].to_numpy()]
        return own.index.to_numpy(), np.maximum(np.maximum(own["lo"].to_numpy() - d, d - own["hi"].to_numpy()), 0.0)


def search(base: DataFrame, is_query: Column, *, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, its k nearest other rows by inner product.

    Reads vec_id and embedding. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    do rows with a null vec_id; vectors of unequal lengths are compared within their length only. Fewer than k candidates
    give fewer rows. Ties go to smaller ids; copies of a vector are indexed once, with the k + 1 smallest of their ids.
    Other columns are ignored.
    """
    spark = base.sparkSession
    rows = base.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    rows = rows.withColumn("key", F.xxhash64("vector"))
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).distinct()
    # copies: of each distinct vector only the k + 1 smallest ids can be an answer
    least = rows.select("vector", "vec_id", "key").distinct()
    for salt in (F.pmod(F.xxhash64("vec_id"), F.lit(64)), F.lit(0)):
        w = Window.partitionBy("key", "vector", salt).orderBy("vec_id")
        least = least.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n")
    points = checkpoint(least.groupBy("key", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = checkpoint(asked)
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    size = points.agg(F.count("*").alias("n"), F.max(norm2).alias("m")).first()
    most = float(size.m or 1.0) ** 0.5
    # pivots: a bounded number of points, those of the smallest hashes; widths without one have a single ring
    chosen = points.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(max(1, min(PIVOTS, size.n // shard_rows))).select("vector").collect()
    pivots = Pivots([np.array(r.vector) for r in chosen], most)
    placed = points.mapInPandas(lambda batches: (b.assign(**pivots.place(b["vector"])) for b in batches), "key long, vector array<double>, ids array<long>, width int, pivot int, far double")
    placed = checkpoint(placed)
    steps = placed.groupBy("width", "pivot").agg(F.count("*").alias("n"), F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 10 * RINGS).alias("cuts"))
    # a ring for each shard_rows points; rings that hold many points at one distance are dealt by hash as well
    ring = F.floor(F.size(F.filter("cuts", lambda x: x < F.col("far"))) * F.least(F.ceil(F.col("n") / shard_rows), F.lit(RINGS)) / RINGS)
    ringed = placed.join(F.broadcast(steps), ["width", "pivot"]).select("width", "pivot", ring.cast("int").alias("ring"), "far", "key", "ids", "vector")
    rings = ringed.groupBy("width", "pivot", "ring").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).toPandas()  # one row for some shard_rows points
    rings = rings.sort_values(["width", "pivot", "ring"]).reset_index(drop=True)
    rings["salts"] = np.maximum(1, np.ceil(rings["n"] / (2 * shard_rows))).astype(int)
    names = spark.createDataFrame(rings.assign(shard=rings.index)[["width", "pivot", "ring", "shard", "salts"]], "width int, pivot int, ring int, shard int, salts int")
    stored = checkpoint(ringed.join(F.broadcast(names), ["width", "pivot", "ring"]).select("shard", F.pmod(F.xxhash64("key", F.lit(2)), F.col("salts")).cast("int").alias("salt"), "salts", "ids", "vector"))

    def visits(bounded: bool):
        """(query_id, query, bound) to the shards that it visits: the nearest, or, once it has a bound, all others in reach."""

        def run(batches):
            for batch in batches:
                rows = []
                for name, query, bound in zip(batch["query_id"], batch["query"], batch["bound"], strict=True):
                    shard, gap = pivots.gaps(rings, np.array(query))
                    home = shard[gap.argmin()] if len(shard) else -1
                    to = shard[(gap <= bound / factor * (1 + 1e-9)) & (shard != home)] if bounded else shard[shard == home]
                    rows += [(int(x), name, query, bound) for x in to]
                yield pd.DataFrame(rows, columns=["shard", "query_id", "query", "bound"])

        return run

    def searched(asked: DataFrame, bounded: bool) -> DataFrame:
        sent = asked.mapInPandas(visits(bounded), "shard int, query_id long, query array<double>, bound double")
        # a shard with very many queries is searched in several tasks
        count = sent.groupBy("shard").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
        shards = stored.join(F.broadcast(count), "shard")
        none = F.lit(None)
        stock = shards.select("shard", "salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), none.cast("long").alias("query_id"), "ids", "vector", none.cast("double").alias("bound"))
        salts = F.broadcast(names.select("shard", "salts")).join(F.broadcast(count), "shard")
        asks = sent.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", none.cast("array<bigint>").alias("ids"), F.col("query").alias("vector"), "bound")
        return stock.unionByName(asks).groupBy("shard", "salt", "block").applyInPandas(cell, "query_id long, vec_id long, score double")

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["query_id"].notna()
        queries, stock = pdf[asks], pdf[~asks]
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(stock):
            return out
        x = np.stack(stock["vector"].to_list())
        tree = VPTree(np.column_stack([x, np.sqrt(np.maximum(most**2 - (x**2).sum(1), 0))]))
        ids, parts = stock["ids"].to_list(), [out]
        for lo in range(0, len(queries), 1024):
            some = queries.iloc[lo : lo + 1024]
            q = np.stack(some["vector"].to_list())
            scale = most / np.sqrt((q**2).sum(1))
            # a query's own vector may be among the nearest, hence one more
            i, j = tree.nearest(np.column_stack([q * scale[:, None], np.zeros(len(q))]), k + 1, factor, some["bound"].to_numpy())
            score = np.add.reduce(x[j] * q[i], axis=1)
            n = np.array([len(ids[at]) for at in j], np.int64)
            found = pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(np.int64)[i], n), "vec_id": np.array([v for at in j for v in ids[at]], np.int64), "score": np.repeat(score, n)})
            found = found[found["query_id"] != found["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            parts.append(found.groupby("query_id").head(k))
        return pd.concat(parts)

    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = checkpoint(searched(asked.withColumn("bound", F.lit(float("inf"))), False))
    # the distance of the k-th neighbour found so far, from its score
    kth = first.groupBy("query_id").agg(F.count("*").alias("found"), F.sort_array(F.collect_list("score"), asc=False).alias("scores")).where(F.col("found") >= k).select("query_id", F.element_at("scores", k).alias("score"))
    scale = most / F.sqrt(F.aggregate("query", F.lit(0.0), lambda a, x: a + x * x))
    bound = F.sqrt(F.greatest(2 * most**2 - 2 * scale * F.col("score"), F.lit(0.0))) + 1e-6 * most
    rest = asked.join(kth, "query_id", "left").select("query_id", "query", F.when(F.col("score").isNotNull(), bound).otherwise(float("inf")).alias("bound"))
    found = first.unionByName(searched(rest, True)).distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
