"""The text tier: what a cleaner's answer may do to an escalated reading. Answers come as a column, from any source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from glyphledger.functions.alike import ratios
from glyphledger.functions.evidence import THRESHOLDS
from glyphledger.functions.text import ALPHABET, key_upper
from glyphledger.operators.readings import needs_cleaner

#: Least similarity of a suggestion and of an adopted value to the reading.
SUGGEST, ADOPT = 0.4, 0.5


@F.pandas_udf(DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series(ratios(a.fillna("").tolist(), b.fillna("").tolist()))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of the upper-case keys."""
    return _ratio(key_upper(F.coalesce(a, F.lit(""))), key_upper(F.coalesce(b, F.lit(""))))


def revalidates(value: Column, reading: Column, ratio: Column) -> Column:
    """Block letters only, not much longer than the reading, and like it."""
    value, n = F.trim(value), F.length(reading)
    return (value != "") & value.rlike(f"^[{ALPHABET} ]+$") & (F.length(value) <= F.greatest(n + 4, F.floor(n * 1.6))) & (ratio >= ADOPT)


def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows (field, reading, is_name, confidence) with a cleaner's response from answers (field, reading, is_name, response).

    Only readings that need a cleaner look one up; the others, and those without an answer, have none. Of several answers to
    one question the least counts, so reruns agree.
    """
    asks = F.coalesce(needs_cleaner(F.col("confidence"), F.col("reading")), F.lit(False))
    question = ["field", "reading", "is_name"]
    known = answers.where("response IS NOT NULL").groupBy(*question).agg(F.min("response").alias("response"))
    asked = rows.where(asks).join(known, question, "left").select(*rows.columns, "response")
    return asked.unionByName(rows.where(~asks).withColumn("response", F.lit(None).cast("string")))


def decide(rows: DataFrame, *, available: bool = True) -> DataFrame:
    """rows (reading, response, is_name, ratio, confidence) with value, suggestion, source and the new confidence.

    Sure or blank readings stay. A name keeps its value, whatever the answer, and gets a suggestion at most; other texts
    adopt an answer that revalidates.
    """
    raw = F.trim(F.coalesce("reading", F.lit("")))
    answer = F.when(F.trim("response") != "", F.trim("response"))
    source = (
        F.when((F.col("confidence") >= THRESHOLDS["text"]), None)
        .when(raw == "", "ocr")
        .when(F.lit(not available), "unavailable")
        .when(answer.isNull(), "ocr")
        .when(F.col("is_name"), F.when(F.col("ratio") >= SUGGEST, "suggestion").otherwise("ocr"))
        .otherwise(F.when(revalidates(answer, raw, F.col("ratio")), "clean").otherwise("ocr"))
    )
    out = rows.withColumn("source", source)
    return out.withColumns({"value": F.when(F.col("source") == "clean", answer).otherwise(F.col("reading")), "suggestion": F.when(F.col("source") == "suggestion", answer), "confidence": F.when(F.col("source") == "clean", F.greatest("confidence", F.lit(0.85))).otherwise(F.col("confidence"))})
