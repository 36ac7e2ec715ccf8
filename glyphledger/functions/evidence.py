"""Confidence and values from per-cell evidence, and geometry of cells; arrays and higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels darker than these count, and the shares from which a mark or a digit is taken to be there.
MARK_PIXEL, MARK_SHARE = 128, 0.10
INK_PIXEL, INK_SHARE = 200, 0.02
#: Review thresholds by class, and the cell score under which a digit may be repaired.
THRESHOLDS = {"numeric": 0.80, "text": 0.70, "occupancy": 0.30}
LOW_CELL = 0.85


def dark_share(pixels: Column, darker_than: int) -> Column:
    return F.size(F.filter(pixels, lambda x: x < darker_than)) / F.size(pixels)


def occupied(pixels: Column) -> Column:
    return dark_share(pixels, MARK_PIXEL) > MARK_SHARE


def inked(pixels: Column) -> Column:
    return dark_share(pixels, INK_PIXEL) > INK_SHARE


def occupancy_confidence(share: Column) -> Column:
    """Distance from the cut-off, as a share of it, at most 1."""
    return F.least(F.lit(1.0), F.abs(share - MARK_SHARE) / MARK_SHARE)


def field_confidence(cells: Column) -> Column:
    """A field is as sure as its least sure cell; without cells it is sure."""
    return F.coalesce(F.array_min(F.transform(cells, lambda c: c["score"])), F.lit(1.0))


def low_cells(cells: Column) -> Column:
    """Places (from 0) of cells whose digit may be repaired."""
    marked = F.transform(cells, lambda c, i: F.when(c["score"] < LOW_CELL, i))
    return F.filter(marked, lambda i: i.isNotNull())


def last_digit(text: Column, missing: str = "?") -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits == "", F.lit(missing)).otherwise(F.right(digits, F.lit(1)))


def _joined(cells: Column, missing: str = "?") -> Column:
    return F.array_join(F.transform(cells, lambda c: last_digit(c["text"], missing)), "")


def _with_ink(cells: Column) -> Column:
    return F.filter(cells, lambda c: c["ink"] > INK_SHARE)


def amount_of(cells: Column) -> Column:
    """'NNN.CC': inked whole-number cells in order (0 if none), a point, and both cents, 0 where unreadable."""
    n = F.size(cells)
    whole = _joined(_with_ink(F.slice(cells, 1, F.greatest(n - 2, F.lit(0)))))
    return F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), _joined(F.slice(cells, -2, 2), "0"))


def id_of(cells: Column) -> Column:
    """Inked cells with a slash after the sixth; empty if none has ink."""
    digits = _joined(_with_ink(cells))
    return F.when(digits == "", "").otherwise(F.concat(F.substring(digits, 1, 6), F.lit("/"), F.substring(digits, F.lit(7), F.length(digits))))


def digits_of(cells: Column) -> Column:
    return _joined(_with_ink(cells))


def cell_row(x: Column, y: Column, pitch: int, width: int, height: int, n: Column) -> Column:
    """n boxes of one size from (x, y) to the right, `pitch` apart."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((x + i * pitch).alias("x1"), y.alias("y1"), (x + i * pitch + width).alias("x2"), (y + height).alias("y2")))


def hull(cells: Column) -> Column:
    first, last = F.element_at(cells, 1), F.element_at(cells, -1)
    return F.struct(first["x1"].alias("x1"), first["y1"].alias("y1"), last["x2"].alias("x2"), last["y2"].alias("y2"))


def aspect_off(width: Column, height: Column, canvas_width: int = 1241, canvas_height: int = 1755) -> Column:
    """Whether a page's shape differs from the canvas by more than 3 percent."""
    want = canvas_width / canvas_height
    return F.abs(width / height - want) / want > 0.03


def darken(a: Column, b: Column) -> Column:
    """Pixel by pixel, the darker of two images."""
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def crop(pixels: Column, width: int, x1: int, y1: int, x2: int, y2: int) -> Column:
    """Rows y1 to y2 and columns x1 to x2 (without the ends) of a row-major image."""
    return F.flatten(F.transform(F.sequence(F.lit(y1), F.lit(y2 - 1)), lambda y: F.slice(pixels, y * width + x1 + 1, F.lit(x2 - x1))))


def months(mode: Column, first: Column, n: Column) -> Column:
    """Twelve flags: all, none (as with the mark for the whole year, "master"), or n months from `first` (1 to 12) on."""
    return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.when(mode == "all", True).when(mode.isin("none", "master"), False).otherwise((m >= first) & (m < first + n)))


def aligned_start(cells: int, size: Column, *, middle: bool = False) -> Column:
    """The cell (from 0) where a text of this size starts that stands at the right end, or in the middle."""
    return F.floor((cells - size) / 2) if middle else cells - size
