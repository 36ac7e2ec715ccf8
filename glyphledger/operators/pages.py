"""From page images to observations: bringing a page to the canvas, and reading every field in the way of its kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphledger.functions import evidence, text, vision

#: Photos are brought to this many pixels a side at most before they are matched to the template.
LONGEST_SIDE = 3000


class Layout(NamedTuple):
    """Where a field stands and how it is read: mark (a box), box (whole), cells (digit by digit), comb or names (strips).

    combs holds one list of cell boxes for each comb; a name may have two. A form's layout is a list of such entries.
    """

    field: str
    way: str
    box: tuple[int, int, int, int] = (0, 0, 0, 0)
    combs: tuple[tuple[tuple[int, int, int, int], ...], ...] = ()


def capped_size(w: int, h: int, longest: int = LONGEST_SIDE) -> tuple[int, int]:
    """The size at which a photo is matched: its own, or the one that makes its longer side `longest`."""
    return (w, h) if max(w, h) <= longest else (w * longest // max(w, h), h * longest // max(w, h))


def prepare_pages(pages: DataFrame, fits: DataFrame, width: int = vision.CANVAS_WIDTH, height: int = vision.CANVAS_HEIGHT, longest: int = LONGEST_SIDE) -> DataFrame:
    """(page_id, w, h, pixels, status, reason) at the canvas size for pages (page_id, w, h, pixels).

    A page of that size stays as it is. Others are aligned by their map in fits (image, h, inliers; from
    vision.fit_homographies, on points of the photo at its capped size), and resized where there is none: the reason says
    why, and a second page without a fit is no error.
    """
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", "w", "h", "pixels").join(fits.select(F.col("image").alias("page_id"), F.col("h").alias("map"), "inliers"), "page_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for r in batch.itertuples():
                image = np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w)
                if (r.w, r.h) == (width, height):
                    made.append((r.page_id, r.pixels, "as is", None))
                elif r.map is None:
                    reason = "no match" if pd.isna(r.inliers) else f"{int(r.inliers)} inliers are too few"
                    made.append((r.page_id, vision.resize(image, width, height).tobytes(), "resized", reason))
                else:
                    w, h = capped_size(r.w, r.h, longest)
                    photo = image if (w, h) == (r.w, r.h) else vision.resize(image, w, h)
                    made.append((r.page_id, vision.warp(photo, np.array(r.map).reshape(3, 3), width, height).tobytes(), "aligned", None))
            out = pd.DataFrame(made, columns=["page_id", "pixels", "status", "reason"])
            yield out.assign(w=width, h=height)[["page_id", "w", "h", "pixels", "status", "reason"]]

    return rows.mapInPandas(run, f"page_id {kind}, {vision.IMAGE}, status string, reason string")


def page_evidence(pages: DataFrame, layout: list[Layout], read_digits: Callable, read_text: Callable) -> DataFrame:
    """(page_id, field, way, share, cells, reads) of every field of every page (page_id, w, h, pixels).

    share: dark pixels of a mark's box. cells: text, ink and score of each cell. reads: text, score and width (from 0) of
    each strip or whole box, comb by comb. The recognisers are picklable functions from pixels to text and score. A page
    is read by one task in one pass; the layout has a row for each field of the form.
    """
    kind = dict(pages.dtypes)["page_id"]

    def fields_of(image: np.ndarray) -> Iterator[tuple]:
        for at in layout:
            share, cells, reads = None, [], []
            x1, y1, x2, y2 = at.box
            if at.way == "mark":
                share = float((image[y1:y2, x1:x2] < evidence.MARK_PIXEL).mean())
            elif at.way == "box":
                found, score = read_digits(vision.box_with_margin(image, at.box))
                reads.append([{"text": found, "score": float(score), "width": 0}])
            elif at.way == "cells":
                for left, top, right, bottom in (cell for comb in at.combs for cell in comb):
                    cell = image[top:bottom, left:right]
                    found, score = read_digits(cell)
                    cells.append({"text": found, "ink": float((cell < evidence.INK_PIXEL).mean()), "score": float(score)})
            else:
                for comb in at.combs:
                    strips = [vision.comb_strip(image, list(comb), inner) for inner in (vision.WIDTHS if at.way == "names" else vision.WIDTHS[:1])]
                    read = [("", 1.0) if strip is None else read_text(strip) for strip in strips]
                    reads.append([{"text": found, "score": float(score), "width": k} for k, (found, score) in enumerate(read)])
            yield at.field, at.way, share, cells, reads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                rows = [(r.page_id, *x) for x in fields_of(np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w))]
                yield pd.DataFrame(rows, columns=["page_id", "field", "way", "share", "cells", "reads"])

    schema = f"page_id {kind}, field string, way string, share double, cells array<struct<text:string,ink:double,score:double>>, reads array<array<struct<text:string,score:double,width:int>>>"
    return pages.select("page_id", "w", "h", "pixels").mapInPandas(run, schema)


def observations(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(page_id, field, value, occupied, confidence, low_cells) from page_evidence() and the catalog (field, kind).

    Each comb counts with its surest reading (the first at a tie), letters of the form's alphabet only; the combs of a name
    are joined by a blank, and the field is as sure as its least sure comb or inked cell.
    """
    c = F.col
    best = F.transform("reads", lambda strips: F.array_max(F.transform(strips, lambda x: F.struct(x["score"].alias("score"), (-x["width"]).alias("at"), x["text"].alias("text")))))
    words = F.transform(best, lambda x: text.keep_alphabet(x["text"]))
    inked = F.filter("cells", lambda x: x["ink"] > evidence.INK_SHARE)
    value = (
        F.when(c("way") == "mark", F.lit(None).cast("string"))
        .when(c("way") == "box", F.get(best, 0)["text"])
        .when(c("way") != "cells", F.trim(F.array_join(words, " ")))
        .when(c("kind") == "decimal", evidence.amount_of(c("cells")))
        .when(c("kind") == "id", evidence.id_of(c("cells")))
        .otherwise(evidence.digits_of(c("cells")))
    )
    sure = (
        F.when(c("way") == "mark", evidence.occupancy_confidence(c("share")))
        .when(c("way") == "cells", evidence.field_confidence(inked))
        .otherwise(F.coalesce(F.array_min(F.transform(best, lambda x: x["score"])), F.lit(1.0)))
    )
    marked = F.when(c("way") == "mark", c("share") > evidence.MARK_SHARE)
    low = F.when(c("way") == "cells", evidence.low_cells(inked)).otherwise(F.array().cast("array<int>"))
    rows = found.join(catalog.select("field", "kind"), "field")
    return rows.select("page_id", "field", value.alias("value"), marked.alias("occupied"), sure.alias("confidence"), low.alias("low_cells"))
