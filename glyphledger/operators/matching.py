"""Descriptor matching: the two nearest by Hamming distance, a ratio test, and guards on how many are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RATIO, MIN_MATCHES = 0.75, 30


def two_nearest(queries: DataFrame, stock: DataFrame) -> DataFrame:
    """(image, q_id, s_id, d, rank) for descriptors (image, id, bits), compared within an image pair only.

    A descriptor is no neighbour of itself, so queries and stock may be one table. The number of descriptors of an image is bounded by its detector, so a pair is small; the join is by image.
    """
    q, s = queries.select("image", F.col("id").alias("q_id"), F.col("bits").alias("q")), stock.select("image", F.col("id").alias("s_id"), F.col("bits").alias("s"))
    near = q.join(s, "image").where("q_id <> s_id").select("image", "q_id", "s_id", F.bit_count(F.col("q").bitwiseXOR(F.col("s"))).alias("d"))
    w = Window.partitionBy("image", "q_id").orderBy("d", "s_id")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def good_matches(nearest: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(image, q_id, s_id, d1, d2) where the nearest is clearly nearer than the next."""
    best = nearest.groupBy("image", "q_id").agg(F.min_by("s_id", "rank").alias("s_id"), F.min_by("d", "rank").alias("d1"), F.max_by("d", "rank").alias("d2"), F.count("*").alias("n"))
    return best.where((F.col("n") == 2) & (F.col("d1") < ratio * F.col("d2"))).drop("n")


def enough(matches: DataFrame, least: int = MIN_MATCHES) -> DataFrame:
    return matches.groupBy("image").agg(F.count("*").alias("n")).where(F.col("n") >= least)
