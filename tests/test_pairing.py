"""Pages in any order and many batches, late ones and repeated ones, restarts, against the batch merge."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from glyphledger.sources import files
from glyphledger.streaming import pairing

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of pages; each call adds a file and runs the stream to its end."""

    def put(*pages):
        rows = [(f, p, None if m is None else T0 + timedelta(minutes=m), x) for f, p, m, x in pages]
        spark.createDataFrame(rows, pairing.PAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(delay="0 seconds"):
        stream = spark.readStream.schema(pairing.PAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = pairing.start(pairing.live_forms(stream, delay=delay), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        return {r.form_id: (r.version, r.status, r.fields) for r in pairing.latest(spark, str(tmp_path / "out")).collect()}

    run.put = put
    return run


def test_late_and_repeated_pages(feed):
    feed.put(("a", 1, 0, {"x": "1", "y": "2"}), ("b", 1, 0, {"x": "3"}), ("c", 2, 1, {"z": None}))
    assert feed() == {}
    feed.put(("a", 2, 2, {"y": "5", "é": None}), ("a", 3, 2, {"y": "6"}), (None, 1, 2, {"y": "7"}), ("d", 1, None, {"y": "8"}))
    assert feed() == {"a": (1, "complete", {"x": "1", "y": "5", "é": None})}
    feed.put((None, None, 15, None))  # time goes on: forms with one page go out
    got = feed()
    assert got["b"] == (1, "first page only", {"x": "3"}) and got["c"] == (1, "second page only", {"z": None}) and len(got) == 3
    feed.put(("b", 2, 20, {"x": "4"}), ("a", 1, 21, {"x": "9"}), ("a", 1, 21, {"x": "9"}))
    got = feed()
    assert got["b"] == (2, "complete", {"x": "4"}) and got["a"] == (2, "complete", {"x": "9", "y": "5", "é": None})
    feed.put((None, None, 60 * 24 * 40, None))
    assert feed() == got  # state has gone, what went out stays
    feed.put(("b", 1, 60 * 24 * 40 + 1, {"x": "new"}), (None, None, 60 * 24 * 41, None))
    feed.put((None, None, 60 * 24 * 42, None))
    assert feed()["b"] == (1, "first page only", {"x": "new"})


def test_stream_equals_merge(spark, tmp_path, feed):
    """Pages dealt into files at random, with a restart after every few, end as merge_pages() has them."""
    rng = random.Random(8)
    pages = [(str(f), p, rng.randrange(100), {c: str(rng.randrange(50)) for c in rng.sample("abcdef", rng.randint(0, 4))}) for f in range(80) for p in rng.choice([(1,), (1, 2), (1, 2), (2,)])]
    pages.sort(key=lambda page: page[2])
    for i in range(0, len(pages), 40):
        feed.put(*pages[i : i + 40])
        if i % 80 == 0:
            feed("1 minute")
    feed.put((None, None, 10_000, None))
    got = feed("1 minute")
    rows = spark.createDataFrame(pages, "form_id string, page int, m int, fields map<string,string>").select("form_id", "page", F.explode("fields").alias("field", "value"))
    merged = files.merge_pages(rows.where("page = 1").drop("page"), rows.where("page = 2").drop("page"))
    assert sorted((f, k, v) for f, (_, _, x) in got.items() for k, v in x.items()) == sorted(map(tuple, merged.collect()))
    assert {f for f, *_ in pages} == set(got)


def test_a_batch_run_again_replaces_itself(spark, tmp_path, feed):
    feed.put(("a", 1, 0, {"x": "1"}), ("a", 2, 0, {"y": "1"}))
    before = feed()
    done = tmp_path / "state" / "commits" / "0"
    done.rename(tmp_path / "gone")  # as if the driver had been lost between writing and noting it
    for crc in (tmp_path / "state" / "commits").glob(".0.crc"):
        crc.unlink()
    assert feed() == before
    assert spark.read.parquet(str(tmp_path / "out")).where("batch = 0").count() == 1


def test_forms_of_a_bucket_share_a_state(spark, tmp_path):
    """A call to the state store brings a bucket of forms, however many there are: state rows go with buckets (F1)."""
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [(str(f), p, at(p), {"x": str(p)}) for f in range(900) for p in ((1,), (2,), (1, 2))[f % 3]]
    put = lambda rows: spark.createDataFrame(rows, pairing.PAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        pages = spark.readStream.schema(pairing.PAGE).parquet(str(tmp_path / "in"))
        query = pairing.start(pairing.live_forms(pages, delay="0 seconds", buckets=4), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        return max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])

    put(rows)
    assert run() <= 4 * 3  # a value and a timer for each bucket, the timer under two orders
    put([("900", 1, at(30), {"x": "1"})])
    assert run() <= 4 * 3
    got = {r.form_id: (r.version, r.status, r.fields["x"]) for r in pairing.latest(spark, str(tmp_path / "out")).collect()}
    assert got == {str(f): ((1, "first page only", "1"), (1, "second page only", "2"), (1, "complete", "2"))[f % 3] for f in range(900)}
