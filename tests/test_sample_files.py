"""Samples written as files: what is there after a commit, an overwrite, a task that ran twice and a job that failed."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphledger.sources import files, sample_files


def test_written_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {f"s{i}": [rng.integers(0, 256, (9, 7), dtype=np.uint8), rng.integers(0, 256, (9, 7), dtype=np.uint8)] for i in range(7)}
    rows = [(name, bytearray(a.tobytes()), None if name == "s3" else bytearray(b.tobytes()), f'{{"sample_id": "{name}", "ground_truth": {{"x": "ž"}}}}') for name, (a, b) in images.items()]
    df = spark.createDataFrame(rows, "name string, p1 binary, p2 binary, document string").repartition(3)
    df = df.withColumns({p: files.as_png(F.lit(7), F.lit(9), p) for p in ("p1", "p2")})
    for _ in range(2):  # the second time replaces the first
        sample_files.write_sample_files(df, str(tmp_path / "out"))
    parts = [p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]
    assert all(p.name.startswith("part-") for p in parts)
    assert sorted(f.name for p in parts for f in p.iterdir() if f.suffix != ".crc") == sorted(f"{n}{e}" for n in images for e in sample_files.ENDINGS.values() if (n, e) != ("s3", "_p2.png"))
    back = {r.name: np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.h, r.w) for r in files.decode_pages(spark, str(tmp_path / "out" / "part-*")).collect()}
    assert all((back[f"{n}_p{k + 1}"] == images[n][k]).all() for n in images for k in (0, 1) if (n, k) != ("s3", 1))
    assert {(r.sample_id, r._is_broken, r.ground_truth["x"]) for r in files.read_samples(spark, str(tmp_path / "out" / "part-*" / "*.json")).collect()} == {(n, False, "ž") for n in images}
    sample_files.write_sample_files(df.limit(0), str(tmp_path / "out"))
    assert not any(p.name.startswith("part-") for p in (tmp_path / "out").iterdir())


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    df = spark.createDataFrame([("a", None, None, "{}")], sample_files.SCHEMA)
    sample_files.write_sample_files(df, str(tmp_path / "out"))
    bad = spark.range(40).select(F.col("id").cast("string").alias("name"), F.lit(None).cast("binary").alias("p1"), F.lit(None).cast("binary").alias("p2"), F.when(F.col("id") < 39, "{}").otherwise(F.raise_error(F.lit("broken")).cast("string")).alias("document"))
    with pytest.raises(Exception, match="broken"):
        sample_files.write_sample_files(bad.repartition(4), str(tmp_path / "out"))
    left = [p.name for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert left == ["a.json"]


def test_of_a_task_that_ran_twice_one_is_shown(tmp_path):
    writer = sample_files._Writer(str(tmp_path), overwrite=False)
    row = {"name": "a", "p1": b"1", "p2": None, "document": "{}"}
    writer.write(iter([row]))  # lost
    writer.commit([writer.write(iter([row])), None, writer.write(iter([]))])
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.json", "a_p1.png"]
