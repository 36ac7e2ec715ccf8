"""Repair of uncertain digits by a checksum: only cells of low confidence may change, and at most three of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphledger.functions.evidence import low_cells

MAX_LOW, N_CELLS = 3, 10
#: What a digit is worth, by its place.
_WORTH = tuple(10 ** (N_CELLS - 1 - i) for i in range(N_CELLS))


def repaired_id(cells: Column) -> Column:
    """The least ten-digit number divisible by 11 that differs in low cells only; null where nothing is to be repaired.

    Low cells come in ascending places, so trying the first ones in order meets the least number first; at most a hundred
    are tried. Cells that are no digits and not low leave no candidate.
    """
    low = low_cells(cells)
    chars = F.transform(cells, lambda c: c["ch"])
    now = F.array_join(chars, "")
    fine = now.rlike("^[0-9]{10}$") & (now.try_cast("long") % 11 == 0)
    k = F.size(low)
    # the digits of all other cells as a number, and what each low cell's digit is worth
    fixed = F.aggregate(F.transform(cells, lambda c, i: F.when(F.array_contains(low, i), "0").otherwise(c["ch"])), F.lit(""), lambda a, c: F.concat(a, c)).try_cast("long")
    worth = F.transform(low, lambda i: F.get(F.array(*[F.lit(w).cast("long") for w in _WORTH]), i))
    # of two or three low cells the first ones are tried in turn; the last one follows from what is missing to a multiple
    # of 11: ten to an even power leaves 1, to an odd power 10
    ends = F.get(worth, k - 1)
    tens = F.when(k == 3, F.sequence(F.lit(0), F.lit(99))).when(k == 2, F.sequence(F.lit(0), F.lit(9))).otherwise(F.array(F.lit(0)))

    def closed(v: Column) -> Column:
        begun = fixed + F.when(k == 3, F.floor(v / 10) * F.get(worth, 0) + v % 10 * F.get(worth, 1)).when(k == 2, v * F.get(worth, 0)).otherwise(0)
        missing = F.when(ends % 11 == 1, (11 - begun % 11) % 11).otherwise(begun % 11)
        return F.when(missing < 10, begun + missing * ends)

    found = F.get(F.filter(F.transform(tens, closed), lambda n: n.isNotNull()), 0)
    text = F.lpad(found.cast("string"), 10, "0")
    ready = k.between(1, MAX_LOW) & (F.size(cells) == N_CELLS) & ~F.coalesce(fine, F.lit(False)) & fixed.isNotNull()
    return F.when(ready, F.when(text != now, text))
