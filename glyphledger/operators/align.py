"""Photos onto their templates, from descriptors to pixels: matched, filtered, joined back to points, fitted, warped.

A photo that can't be aligned says why and is resized instead. Detecting features is the caller's: descriptors are input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphledger.functions import vision
from glyphledger.operators import descriptors, pages
from glyphledger.operators.matching import MIN_MATCHES, RATIO, good_matches

#: Features that either side needs, and pairs that have to agree with the map.
MIN_FEATURES, MIN_INLIERS = 10, 10


def fit(template: DataFrame, photo: DataFrame, *, ratio: float = RATIO, least_features: int = MIN_FEATURES, least_matches: int = MIN_MATCHES, least_inliers: int = MIN_INLIERS, words: int = 4) -> DataFrame:
    """(image, status, matches, inliers, h) of features (image, id, x, y, bits) of templates and of photos.

    h takes points of the photo to points of the template; it is null unless status is `aligned`. The other states, the first
    that holds: `too few features`, `too few matches`, `too few inliers`. An image without features on one side has too few
    of them. Each template feature looks for its two nearest in the photo.
    """
    of_photo = F.concat(F.lit("p"), F.col("id").cast("string"))  # the two sides number their features on their own
    counted = template.select("image", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(photo.select("image", F.lit(0).alias("t"), F.lit(1).alias("p")))
    images = counted.where("image IS NOT NULL").groupBy("image").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    nearest = descriptors.two_nearest(template.withColumn("id", F.concat(F.lit("t"), F.col("id").cast("string"))), photo.withColumn("id", of_photo), words=words)
    good = good_matches(nearest, ratio)
    pairs = good.join(template.select("image", F.concat(F.lit("t"), F.col("id").cast("string")).alias("q_id"), F.col("x").alias("u"), F.col("y").alias("v")), ["image", "q_id"])
    pairs = pairs.join(photo.select("image", of_photo.alias("s_id"), "x", "y"), ["image", "s_id"])
    matches = pairs.groupBy("image").agg(F.count("*").alias("matches"))
    found = images.join(matches, "image", "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    state = F.when(F.least("t", "p") < least_features, "too few features").when(F.col("matches") < least_matches, "too few matches")
    found = found.withColumn("state", state)
    fitted = vision.fit_homographies(pairs.join(found.where("state IS NULL").select("image"), "image", "left_semi").select("image", "x", "y", "u", "v"), least_inliers)
    out = found.join(fitted, "image", "left")
    status = F.coalesce("state", F.when(F.col("h").isNull(), "too few inliers").otherwise("aligned"))
    return out.select("image", status.alias("status"), "matches", "inliers", "h")


def align_pages(images: DataFrame, template: DataFrame, photo: DataFrame, width: int = vision.CANVAS_WIDTH, height: int = vision.CANVAS_HEIGHT, **limits) -> DataFrame:
    """pages.prepare_pages() of images (page_id, w, h, pixels) with maps from descriptors; a resized page's reason is the state of its fit."""
    fits = fit(template, photo, **limits)
    made = pages.prepare_pages(images, fits.select("image", "h", "inliers"), width, height)
    states = fits.select(F.col("image").alias("page_id"), F.col("status").alias("state"))
    reason = F.when(F.col("status") == "resized", F.coalesce("state", "reason")).otherwise(F.col("reason"))
    return made.join(states, "page_id", "left").select("page_id", "w", "h", "pixels", "status", reason.alias("reason"))
