"""The two nearest descriptors of any collection, exactly: an index of bands first, blocks of what it leaves open after that.

A descriptor is a row of 64-bit words. Cut into bands of sixteen bits, two descriptors that differ in fewer bits than there are
bands share a band; with one bit turned in any band, those share one that differ in fewer than twice as many. So a lookup by band
settles all queries whose two nearest are that close. Bands that very many descriptors share are left out, and the queries that
have one stay open, as do those that would meet so many descriptors that comparing blocks costs less. Open queries meet the
collection block by block, each pair of blocks in a task that keeps the nearest only. Bands are many rows for each descriptor and
look small to Spark as a file does: they are sorted and merged, never broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphledger.sources.shared import written

BAND_BITS = 16
#: A band value that more descriptors of an image have isn't looked up.
HOT = 200
#: A query that would meet more descriptors in its bands, and more than this share of its image, is left to the blocks.
LOOKUPS, SHARE = 256, 1000
#: Descriptors in a block of the exhaustive part.
BLOCK = 20_000
#: Pairs that are compared at a time, few enough for a cache.
CELLS = 1 << 16
#: The nearest ids that are kept of equal descriptors and of a query: two, and one more that may be the query itself.
KEPT = 3


def two_nearest(queries: DataFrame, stock: DataFrame, *, words: int = 4, turned: int = 1, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(image, q_id, s_id, d, rank) of descriptors (image, id, bits: array of `words` longs): ranks 1 and 2 by distance, then id.

    Compared are descriptors of one image; a constant image compares all with all. A descriptor is no neighbour of one of the
    same image and id, so queries and stock may be one table. Fewer than two others give fewer rows. Ids are taken as distinct
    within an image; rows with null bits, image or id take no part. Equal descriptors are looked up once.
    """
    present = lambda df: df.select("image", "id", "bits").where(F.col("image").isNotNull() & F.col("id").isNotNull() & (F.size("bits") == words) & ~F.exists("bits", lambda w: w.isNull()))
    queries, stock = present(queries), present(stock)
    by_bits = Window.partitionBy("image", "bits").orderBy("id")
    kinds = stock.withColumn("n", F.row_number().over(by_bits)).where(F.col("n") <= KEPT).groupBy("image", "bits").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    kinds = written(kinds)
    open_, found = written(queries.select("image", "bits").distinct()), []
    for bits in range(turned + 1):
        got, left = _by_bands(open_, kinds, words, bits, hot)
        found, open_ = [*found, got], left
    found.append(_by_blocks(open_, kinds, words, block))
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    of = queries.join(near, ["image", "bits"]).where("id <> s_id")
    ranked = of.withColumn("rank", F.row_number().over(Window.partitionBy("image", "id").orderBy("d", "s_id"))).where("rank <= 2")
    return ranked.select("image", F.col("id").alias("q_id"), "s_id", "d", "rank")


def distance(a: Column, b: Column, words: int) -> Column:
    total = F.lit(0)
    for k in range(words):
        total = total + F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k)))
    return total


def _bands(df: DataFrame, words: int, turned: int) -> DataFrame:
    """A row (band, key) for each band, and for each way to turn so many of its bits (none or one)."""
    cut = [F.shiftrightunsigned(F.get("bits", k), BAND_BITS * j).bitwiseAND(F.lit((1 << BAND_BITS) - 1)) for k in range(words) for j in range(64 // BAND_BITS)]
    rows = df.select("*", F.posexplode(F.array(*cut)).alias("band", "key"))
    return _turns(rows, turned)


def _turns(rows: DataFrame, turned: int) -> DataFrame:
    """Each row once more for each bit of its key, with that bit turned."""
    if not turned:
        return rows
    return rows.withColumn("key", F.explode(F.transform(F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(BAND_BITS)]), lambda m: F.col("key").bitwiseXOR(m))))


def _nearest(candidates: DataFrame) -> DataFrame:
    """The nearest KEPT ids of each query (image, bits) among (d, s_id)."""
    w = Window.partitionBy("image", "bits").orderBy("d", "s_id")
    return candidates.withColumn("n", F.row_number().over(w)).where(F.col("n") <= KEPT).select("image", "bits", "d", "s_id", "n")


def _by_bands(queries: DataFrame, kinds: DataFrame, words: int, turned: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(nearest of the settled queries, queries left open)."""
    number = ["image", "band", "key"]
    kinds, queries = kinds.withColumnRenamed("bits", "s_bits"), written(queries.withColumn("q", F.monotonically_increasing_id()))
    index = _bands(kinds.withColumn("bits", F.col("s_bits")), words, 0).select(*number, "s_bits", "ids")
    sizes = index.groupBy(number).agg(F.count("*").alias("n"))
    sizes = _turns(sizes, turned).groupBy(number).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    of_image = kinds.groupBy("image").agg(F.greatest(F.lit(LOOKUPS), F.count("*") / SHARE).alias("lookups"))
    load = _bands(queries, words, 0).select("q", *number).join(sizes.hint("merge"), number).groupBy("q", "image").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    few = written(load.join(of_image, "image").where((F.col("most") <= hot) & (F.col("n") <= F.col("lookups"))).select("q"))
    asked = _bands(queries.join(few, "q", "left_semi"), words, turned).select("bits", *number)
    met = asked.join(index.hint("merge"), number).select("image", "bits", "s_bits", "ids").distinct()
    near = written(_nearest(met.select("image", "bits", distance(F.col("bits"), F.col("s_bits"), words).alias("d"), F.explode("ids").alias("s_id"))))
    bands = words * 64 // BAND_BITS
    sure = written(near.where((F.col("n") == KEPT) & (F.col("d") < (turned + 1) * bands)).select("image", "bits"))
    return near.join(sure, ["image", "bits"], "left_semi").select("image", "bits", "d", "s_id"), written(queries.drop("q").join(sure, ["image", "bits"], "left_anti"))


def _by_blocks(queries: DataFrame, kinds: DataFrame, words: int, block: int) -> DataFrame:
    """The nearest of all that is left, every block of queries against every block of the same image."""
    sizes = lambda df, name: df.groupBy("image").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    grid = written(sizes(queries, "q_blocks").join(sizes(kinds, "s_blocks"), "image"))
    place = lambda df, own, name: df.join(grid, "image").withColumn(name, F.pmod(F.xxhash64("bits"), F.col(own)).cast("int"))
    every = lambda df, other, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    q = every(place(queries, "q_blocks", "qb"), "s_blocks", "sb").select("image", "qb", "sb", "bits")
    s = every(place(kinds, "s_blocks", "sb"), "q_blocks", "qb").select("image", "qb", "sb", "bits", "ids")
    image, key = dict(queries.dtypes)["image"], dict(kinds.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"image": [], "bits": [], "d": [], "s_id": []})
        right = right.iloc[np.argsort(np.array([ids[0] for ids in right["ids"]]), kind="stable")]
        a, b = (np.asfortranarray(np.stack(df["bits"].to_numpy()).astype(np.int64).view(np.uint64)) for df in (left, right))
        k, out = min(KEPT, len(b)), []
        step = max(1, CELLS // len(b))
        for i in range(0, len(a), step):
            some = a[i : i + step]
            order = np.zeros((len(some), len(b)), np.int64)
            for w in range(0, words, 3):  # counts of three words fit in a byte
                d = np.bitwise_count(some[:, w, None] ^ b[None, :, w])
                for v in range(w + 1, min(w + 3, words)):
                    d += np.bitwise_count(some[:, v, None] ^ b[None, :, v])
                order += d
            order *= len(b)
            order += np.arange(len(b))  # by distance, then by the least id
            rows = np.arange(len(some))
            for _ in range(k):
                least = order.min(axis=1)
                d, col = np.divmod(least, len(b))
                order[rows, col] = np.iinfo(np.int64).max
                for row, far, c in zip(rows.tolist(), d.tolist(), col.tolist(), strict=True):
                    out += [(i + row, far, s_id) for s_id in right["ids"].iat[c]]
        at, dist, s_id = zip(*out, strict=True)
        return pd.DataFrame({"image": left["image"].iat[0], "bits": left["bits"].to_numpy()[list(at)], "d": dist, "s_id": s_id})

    keys = ["image", "qb", "sb"]
    met = q.groupBy(keys).cogroup(s.groupBy(keys)).applyInPandas(meet, f"image {image}, bits array<long>, d int, s_id {key}")
    return _nearest(met).select("image", "bits", "d", "s_id")
