"""Choosing among readings of one field, and which of them go to the text tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphledger.functions.evidence import THRESHOLDS


def best_width(reads: DataFrame, key: str, *, text: str = "text", score: str = "score", width: str = "w") -> DataFrame:
    """(key, text, score): the surest width's reading, the first at a tie; an empty strip makes the field empty and sure."""
    rows = reads.groupBy(key).agg(F.max_by(text, F.struct(score, -F.col(width))).alias("_text"), F.max(score).alias("_score"), F.bool_or(F.col(text) == "").alias("_blank"))
    return rows.select(key, F.when(F.col("_blank"), "").otherwise(F.col("_text")).alias("text"), F.when(F.col("_blank"), 1.0).otherwise(F.col("_score")).alias("score"))


def name_of(first: Column, second: Column) -> Column:
    """Two parts of a name joined by a blank."""
    return F.trim(F.concat_ws(" ", first, second))


def name_score(*scores: Column | float) -> Column:
    """A name is as sure as its least sure part."""
    return F.least(*[s if isinstance(s, Column) else F.lit(s) for s in scores])


def needs_cleaner(confidence: Column, reading: Column) -> Column:
    """Whether the text tier is asked: unsure and not blank."""
    return (confidence < THRESHOLDS["text"]) & (F.trim(F.coalesce(reading, F.lit(""))) != "")


def places(rows: DataFrame, key: str, *, block: int = 1 << 16) -> DataFrame:
    """rows with `place`, from 0 on in the order of an integer key that no two rows share.

    Keys are counted by blocks; only one count a block goes through a window over all of them, and rows are numbered within
    their block.
    """
    rows = rows.withColumn("_block", F.floor(F.col(key) / block))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_block").agg(F.count("*").alias("n")).select("_block", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1
    return rows.join(starts, "_block").withColumn("place", (F.col("_before") + within).cast("long")).drop("_block", "_before")


def round_robin(rows: DataFrame, key: str, pool: tuple[str, ...], to: str) -> DataFrame:
    """rows with the pool's entries dealt out in key order, over and over."""
    return places(rows, key).withColumn(to, F.get(F.array(*map(F.lit, pool)), (F.col("place") % len(pool)).cast("int"))).drop("place")
