"""Which fields a person has to look at, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reasons(observations: DataFrame, extracted: DataFrame, issues: DataFrame, catalog: DataFrame) -> DataFrame:
    """(form_id, field, reason_ord, reason): low confidence, unreadable numbers, and failed rules.

    observations (form_id, field, confidence), extracted (form_id, field, value, flag), issues (form_id, rule, rule_ord,
    fields), catalog (field, kind, threshold). Blank text is never doubted for its confidence alone; a reading without a
    value, or without an extracted row, is.
    """
    known = F.broadcast(catalog.select("field", "kind", "threshold"))  # as many rows as a form has fields; a shuffle by field has no more parts
    seen = extracted.join(known, "field")
    blank = F.coalesce(F.trim("value") == "", F.lit(False))
    low = observations.join(known, "field").join(extracted.select("form_id", "field", "value").hint("merge"), ["form_id", "field"], "left")
    low = low.where(~((F.col("kind") != "occupancy") & blank) & (F.col("confidence") < F.col("threshold")))
    low = low.select("form_id", "field", F.lit(1).alias("reason_ord"), F.format_string("low confidence %.2f < %.2f", "confidence", "threshold").alias("reason"))
    unread = seen.where((F.col("kind") == "decimal") & F.col("value").isNotNull() & ~F.col("value").rlike("[0-9]"))
    unread = unread.select("form_id", "field", F.lit(2).alias("reason_ord"), F.lit("no valid decimal").alias("reason"))
    failed = issues.select("form_id", F.explode("fields").alias("field"), (F.col("rule_ord") + 100).alias("reason_ord"), F.concat(F.lit("constraint: "), "rule").alias("reason"))
    return low.unionByName(unread).unionByName(failed)


def flags(found: DataFrame) -> DataFrame:
    """(form_id, field, reasons), the reasons in order; a field with none is accepted."""
    ordered = F.array_sort(F.collect_list(F.struct("reason_ord", "reason")))
    return found.groupBy("form_id", "field").agg(F.transform(ordered, lambda r: r["reason"]).alias("reasons"))
