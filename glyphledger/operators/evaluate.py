"""Accuracy against labels: joins, counts by field, and a grand total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown_labels(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """Label rows whose field the catalog doesn't know."""
    return labels.join(catalog.select("field"), "field", "left_anti")


def by_field(matches: DataFrame) -> DataFrame:
    """total, correct, mean_conf and flagged of each field from (field, correct, confidence, flagged)."""
    return matches.groupBy("field").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.avg("confidence").alias("mean_conf"), F.count_if("flagged").alias("flagged"))


def accuracy(matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """correct, total and pct of every catalog field; fields never seen have zeros."""
    counted = matches.groupBy("field").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    rows = catalog.select("field").join(counted, "field", "left").select("field", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("correct", "total")])
    return rows.withColumn("pct", F.when(F.col("total") > 0, 100.0 * F.col("correct") / F.col("total")).otherwise(0.0))


def overall(matches: DataFrame) -> DataFrame:
    """Counts of each field and, with a null field, of all: one rollup."""
    return matches.rollup("field").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))


def caught(report: DataFrame) -> DataFrame:
    """All flagged readings of a report by field, and those of fields that have errors."""
    return report.agg(F.sum("flagged").alias("flagged"), F.sum(F.when(F.col("correct") < F.col("total"), F.col("flagged")).otherwise(0)).alias("caught"))


def worst_first(report: DataFrame, low: float = 0.95) -> DataFrame:
    """The report with acc and a mark under `low`, least accurate and least sure fields first."""
    acc = F.col("correct") / F.col("total")
    return report.withColumns({"acc": acc, "mark": F.when(acc < low, "low").otherwise("")}).orderBy("acc", "mean_conf", "field")
