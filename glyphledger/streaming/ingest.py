"""Beyond the batch pipeline: the same rules over a stream of records, and page pairing with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphledger.operators.rules import issues


def stream_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def stream_issues(records: DataFrame, key: str = "form_id") -> DataFrame:
    """The rules hold no state, so a stream takes the same function as a table."""
    return issues(records, key)


def pair_page_streams(first: DataFrame, second: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """First pages with the second page that comes within `delay` of them, if one does (form_id, ts, body)."""
    a = first.select("form_id", F.col("ts").alias("t1"), F.col("body").alias("p1")).withWatermark("t1", delay)
    b = second.select(F.col("form_id").alias("f2"), F.col("ts").alias("t2"), F.col("body").alias("p2")).withWatermark("t2", delay)
    near = F.expr(f"form_id = f2 AND t2 BETWEEN t1 - INTERVAL {delay} AND t1 + INTERVAL {delay}")
    return a.join(b, near, "leftOuter").select("form_id", "t1", "p1", "p2")
