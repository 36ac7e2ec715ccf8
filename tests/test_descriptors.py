"""Two nearest descriptors by bands and blocks against all distances; photos aligned from descriptors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from glyphledger.operators import descriptors

BITS = "image int, id long, bits array<long>"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def turned(rng, bits, n):
    flat = sum((b % (1 << 64)) << (64 * i) for i, b in enumerate(bits))
    for place in rng.sample(range(64 * len(bits)), n):
        flat ^= 1 << place
    return [signed(flat >> (64 * i) & (1 << 64) - 1) for i in range(len(bits))]


def plain(queries, stock):
    out = []
    for image, q, a in queries:
        if None in (image, q, a):
            continue
        near = sorted((sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(a, b, strict=True)), s) for i, s, b in stock if None not in (i, s, b) and i == image and s != q)
        out += [(image, q, s, d, rank) for rank, (d, s) in enumerate(near[:2], 1)]
    return sorted(out)


@pytest.mark.parametrize(("hot", "block", "turn"), [(200, 20_000, 1), (200, 7, 1), (2, 7, 0), (0, 1000, 1)])
def test_two_nearest(spark, hot, block, turn):
    rng = random.Random(hot + block)
    word = lambda: signed(rng.getrandbits(64))
    centres = [[word() for _ in range(4)] for _ in range(6)]
    stock = [(rng.randrange(2), i, turned(rng, rng.choice(centres), rng.choice([0, 1, 3, 9, 20, 40, 90]))) for i in range(90)]
    stock += [(0, 100 + i, centres[0]) for i in range(30)] + [(2, 500, centres[1]), (None, 501, centres[1]), (1, 502, None), (1, None, centres[2]), (3, 503, centres[0]), (3, 504, centres[0])]
    queries = stock + [(0, 900, turned(rng, centres[0], 5)), (1, 901, centres[3]), (7, 902, centres[3])]
    got = descriptors.two_nearest(spark.createDataFrame(queries, BITS), spark.createDataFrame(stock, BITS).withColumn("d", F.lit("clash")), hot=hot, block=block, turned=turn).collect()
    assert sorted(map(tuple, got)) == plain(queries, stock)


def test_few_bands_settle_near_ones(spark, monkeypatch):
    """Where the three nearest are close, nothing is left to the blocks."""
    rng = random.Random(3)
    centres = [[signed(rng.getrandbits(64)) for _ in range(4)] for _ in range(50)]
    rows = [(0, 10 * c + i, turned(rng, bits, 3)) for c, bits in enumerate(centres) for i in range(5)]
    left = []
    kept = descriptors._by_blocks
    monkeypatch.setattr(descriptors, "_by_blocks", lambda q, *a: left.append(q.count()) or kept(q, *a))
    df = spark.createDataFrame(rows, BITS)
    assert sorted(map(tuple, descriptors.two_nearest(df, df).collect())) == plain(rows, rows) and left == [0]


def test_no_descriptors(spark):
    none = spark.createDataFrame([], BITS)
    assert descriptors.two_nearest(none, none).collect() == []


def test_lookups_are_bounded_and_not_broadcast(spark, monkeypatch):
    """Queries whose bands hold many descriptors go to the blocks, and the rows of bands are merged, not sent through the driver (F2)."""
    rng = random.Random(5)
    centre = [signed(rng.getrandbits(64)) for _ in range(4)]
    rows = [(0, i, turned(rng, centre, 5)) for i in range(40)] + [(0, 100 + i, [signed(rng.getrandbits(64)) for _ in range(4)]) for i in range(40)]
    left, plans, met = [], [], []
    blocks, nearest = descriptors._by_blocks, descriptors._nearest

    def seen(candidates):
        plans.append(candidates._jdf.queryExecution().executedPlan().toString())
        met.append(candidates.count())
        return nearest(candidates)

    monkeypatch.setattr(descriptors, "LOOKUPS", 100)
    monkeypatch.setattr(descriptors, "_by_blocks", lambda q, *a: left.append(q.count()) or blocks(q, *a))
    monkeypatch.setattr(descriptors, "_nearest", seen)
    df = spark.createDataFrame(rows, BITS)
    assert sorted(map(tuple, descriptors.two_nearest(df, df, turned=0).collect())) == plain(rows, rows)
    assert left == [80] and met[0] == 40  # the crowd would meet itself, 16 times over; the others meet themselves only
    assert any("SortMergeJoin" in line and "band" in line for line in plans[0].split("\n"))
