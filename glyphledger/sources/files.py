"""Sources and sinks of the pipeline, all through Spark's readers and writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from glyphledger.functions.evidence import aspect_off

LABELS = "labels map<string,string>, ground_truth map<string,string>"
SAMPLE = "sample_id string, _is_broken boolean, _broken_fields array<string>, _gazetteer_miss array<string>, _style string, _writer string, ground_truth map<string,string>"


def read_register(spark: SparkSession, path: str, list_name: str) -> DataFrame:
    """(list_name, entry, ord): stripped lines in file order, without blank ones and comments (#)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    return lines.select(F.lit(list_name).alias("list_name"), F.trim("line").alias("entry"), "ord").where("entry <> '' AND NOT entry LIKE '#%'")


def envelope(json_text):
    """Labels of a sheet: under `labels`, else under `ground_truth`, else the document itself."""
    wrapped = F.from_json(json_text, LABELS)
    return F.coalesce(wrapped["labels"], wrapped["ground_truth"], F.from_json(json_text, "map<string,string>"))


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, field, truth): <stem>.labels.json where there is one, else <stem>.json. Null labels are left out."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), "value")
    files = files.select(F.regexp_replace("name", r"\.labels$", "").alias("stem"), F.col("name").like("%.labels").alias("own"), "value")
    best = files.groupBy("stem").agg(F.max_by("value", "own").alias("value"))
    return best.select("stem", F.explode(envelope(F.col("value"))).alias("field", "truth")).where("truth IS NOT NULL")


def read_samples(spark: SparkSession, path: str, *, by_line: bool = False) -> DataFrame:
    """Generated samples with their defaults: not broken, no broken fields. One sample a file, or one a line."""
    rows = spark.read.schema(SAMPLE).json(path, multiLine=not by_line)
    return rows.withColumns({"_is_broken": F.coalesce("_is_broken", F.lit(False)), "_broken_fields": F.coalesce("_broken_fields", F.array().cast("array<string>"))})


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, p1, p2): the bytes of <stem>_p1.png and, where there is one, of <stem>_p2.png."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_p[12].png").load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)_p[12]\.png$", 1).alias("stem"), F.regexp_extract("path", r"_p([12])\.png$", 1).alias("page"), "content")
    return files.groupBy("stem").agg(*[F.first(F.when(F.col("page") == p, F.col("content")), ignorenulls=True).alias(f"p{p}") for p in "12"]).where("p1 IS NOT NULL")


def decode_pages(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(name, w, h, pixels, warning) of images: grey pixels by row, by Spark's image reader, and a warning where the sides
    are not those of the form (more than 3 % off). Files that are no images are left out."""
    images = spark.read.format("image").option("pathGlobFilter", pattern).option("dropInvalid", True).load(folder).select("image.*")
    named = images.select(F.regexp_extract("origin", r"([^/]+)\.[A-Za-z]+$", 1).alias("name"), F.col("width").alias("w"), F.col("height").alias("h"), "nChannels", "data")
    schema = "name string, w int, h int, pixels binary"
    warning = F.when(aspect_off(F.col("w"), F.col("h")), F.concat_ws(" ", F.lit("page of"), "w", F.lit("x"), "h", F.lit("pixels is not shaped like the form")))
    return named.mapInPandas(_grey_batches, schema).withColumn("warning", warning)


def _grey_batches(batches):
    import numpy as np

    for batch in batches:
        made = []
        for w, h, n, data in zip(batch["w"], batch["h"], batch["nChannels"], batch["data"], strict=True):
            planes = np.frombuffer(data, np.uint8).reshape(h, w, n)
            # blue, green, red (and alpha): the usual weights of brightness in 65,536ths
            made.append((planes[:, :, 0] if n == 1 else (planes[:, :, 2] * np.uint32(19595) + planes[:, :, 1] * np.uint32(38470) + planes[:, :, 0] * np.uint32(7471) + np.uint32(32768)) >> 16).astype(np.uint8).tobytes())
        yield batch[["name", "w", "h"]].assign(pixels=made)


def pair_pages(first: DataFrame, second: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """First pages with their labels (required) and second pages (where there are any)."""
    return first.join(labels, key).join(second, key, "left")


def merge_pages(p1: DataFrame, p2: DataFrame, keys: tuple[str, ...] = ("form_id", "field")) -> DataFrame:
    """Observations of both pages; where both have a field, the second page's counts."""
    both = p1.withColumn("_page", F.lit(1)).unionByName(p2.withColumn("_page", F.lit(2)))
    rest = [c for c in p1.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_page").alias("v")).select(*keys, "v.*")


def as_base64(content):
    return F.base64(content)


def result_json(fields: DataFrame, issues: DataFrame, flags: DataFrame) -> DataFrame:
    """(form_id, body): values, confidences to three places (half to even), failed rules and reasons as one document."""
    values = fields.groupBy("form_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.bround("confidence", 3).alias("c"))))).alias("confidences"))
    failed = issues.groupBy("form_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_ord", "rule"))), lambda x: x["rule"]).alias("issues"))
    doubts = flags.groupBy("form_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "reasons")))).alias("reasons"))
    rows = values.join(failed, "form_id", "left").join(doubts, "form_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("form_id", F.to_json(F.struct("fields", "confidences", F.coalesce("issues", none).alias("issues"), F.coalesce(F.map_keys("reasons"), none).alias("flagged"), "reasons")).alias("body"))


def answer_documents(readings: DataFrame, issues: DataFrame, flags: DataFrame, warnings: DataFrame) -> DataFrame:
    """(form_id, body): the whole answer. readings (form_id, field, value, confidence, threshold, repaired, suggestion,
    source): repaired is the value before a repair; issues (form_id, rule_ord, rule); flags (form_id, field, reasons);
    warnings (form_id, page, warning) come before the failed rules. Maps hold only fields that have an entry.
    """
    def by_field(value, when=None):
        entry = F.struct("field", value.alias("v"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry if when is None else F.when(when, entry))))

    said = lambda name: F.coalesce(F.col(name) != "", F.lit(False))
    values = readings.groupBy("form_id").agg(
        by_field(F.coalesce("value", F.lit(""))).alias("fields"),
        by_field(F.bround("confidence", 3)).alias("confidences"),
        by_field(F.col("threshold")).alias("thresholds"),
        by_field(F.concat_ws(" -> ", "repaired", "value"), F.col("repaired").isNotNull()).alias("disambiguated"),
        by_field(F.col("suggestion"), said("suggestion")).alias("suggestions"),
        by_field(F.col("source"), said("source")).alias("second_check"),
    )
    found = issues.select("form_id", (F.col("rule_ord") + 100).alias("ord"), F.col("rule").alias("msg")).unionByName(warnings.where("warning IS NOT NULL").select("form_id", F.col("page").alias("ord"), F.col("warning").alias("msg")))
    found = found.groupBy("form_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "msg"))), lambda x: x["msg"]).alias("validation_issues"))
    doubts = flags.groupBy("form_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "reasons")))).alias("field_reasons"))
    rows = values.join(found, "form_id", "left").join(doubts, "form_id", "left")
    none = F.array().cast("array<string>")
    body = F.struct("fields", F.coalesce("validation_issues", none).alias("validation_issues"), F.coalesce(F.map_keys("field_reasons"), none).alias("flagged_fields"), F.coalesce("field_reasons", F.create_map().cast("map<string,array<string>>")).alias("field_reasons"), "confidences", "thresholds", "disambiguated", "suggestions", "second_check")
    return rows.select("form_id", F.to_json(body).alias("body"))


def record_reviews(reviews: DataFrame, path: str) -> None:
    """Append review actions (form_id, action, at, fields): approved or flagged forms with what the reviewer left in them."""
    reviews.where("action IN ('approve', 'flag')").write.mode("append").parquet(path)


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in order; 0 takes all."""
    ordered = rows.orderBy(*order)
    return ordered.limit(n) if n else ordered


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """(name, w, h, pixels) of a template page; a file that is no image is an error, not a missing row."""
    from pyspark.errors import PySparkValueError

    image = decode_pages(spark, path).select("name", "w", "h", "pixels")
    if image.isEmpty():
        raise PySparkValueError(f"no image can be read at {path}")
    return image


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (page_id, w, h, pixels) as PNG images, in a table (page_id, content) that read_pages's bytes have the form of."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "content": [_png(*x) for x in zip(batch["w"], batch["h"], batch["pixels"], strict=True)]})

    pages.select("page_id", "w", "h", "pixels").mapInPandas(run, f"page_id {kind}, content binary").write.mode("overwrite").parquet(path)


@F.pandas_udf(BinaryType())
def as_png(w: pd.Series, h: pd.Series, pixels: pd.Series) -> pd.Series:
    """Grey pixels by row as a PNG image; null where there are none."""
    return pd.Series([None if x is None else _png(int(a), int(b), x) for a, b, x in zip(w, h, pixels, strict=True)], dtype=object)


def _png(w: int, h: int, pixels: bytes) -> bytes:
    """A grey image: a header, the rows (each unfiltered), an end, and the checksum of every part."""
    import struct
    import zlib

    rows = b"".join(b"\0" + pixels[y * w : (y + 1) * w] for y in range(h))
    parts = ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows)), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body)) for name, body in parts)


def write_samples(forms: DataFrame, path: str) -> None:
    """Generated forms (form_id, broken, and their fields) as samples, one a line, that read_samples() reads."""
    fields = [c for c in forms.columns if c not in ("form_id", "broken")]
    truth = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.to_json(c) if dict(forms.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in fields]))
    wrong = F.when(F.col("broken").isNull(), F.array().cast("array<string>")).otherwise(F.array("broken"))
    forms.select(F.col("form_id").cast("string").alias("sample_id"), F.col("broken").isNotNull().alias("_is_broken"), wrong.alias("_broken_fields"), truth.alias("ground_truth")).write.mode("overwrite").json(path)
