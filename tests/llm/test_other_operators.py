"""Search, toxicity, chat formatting and the pipeline."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphledger.llm import chat_prefix, toxicity, vp_search
from glyphledger.llm.queries import QUERIES
from tests.llm.fixtures import SCHEMA, corpus


def test_vp_tree_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    vectors[50:90] = vectors[7]  # copies tie
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] + [1.0] * 7), (None, [1.0] * 8), (904, [])]
    base = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = vp_search.search(base, F.col("vec_id") % 20 == 0, k=6, factor=1.0, shard_rows=100, query_rows=7).collect()
    x = vectors.astype(float)
    for q in range(0, 400, 20):
        s = np.array([np.add.reduce(v * x[q]) for v in x])
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:6]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == order and [m[0] for m in mine] == list(range(1, 7))
        assert [m[2] for m in mine] == pytest.approx([s[i] for i in order], rel=1e-12)
    assert len(got) == 20 * 6
    assert vp_search.search(base.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_fold_undoes_disguises(spark):
    texts = ["ST0PID!", "іdіоt", "id!ot", "$tupid", "Ｔｒａｓｈ", "plain 1999", None, ""]
    folded = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(toxicity.fold(F.col("t"))).collect()]
    assert folded[:5] == [" stopid ", " idiot ", " idiot ", " stupid ", " trash "] and folded[6].strip() == "" and folded[7].strip() == ""


def test_toxicity_learns_terms(spark):
    rng = random.Random(2)
    fill = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20))
    rows = [(i, fill() + (rng.choice([" you scoundrel", " V1LLAIN here"]) if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "scoundrel " * 5), (903, "the villain biscuit is nice")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.col("doc_id") < 300)
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((out[i] >= 0.5) == (i % 4 == 0) for i in range(400))
    assert out[900] < 0.5 and out[901] < 0.5 and out[902] >= 0.5
    auto = toxicity.match(model, exceptions=("villain biscuit",))
    spared = docs.where("doc_id = 903").select(auto(toxicity.fold(F.col("text"))).alias("raw")).first().raw
    assert spared == 0
    clashing = docs.withColumns({"_Toxicity": F.lit("mine"), "score": F.lit(7)})
    left = toxicity.drop_toxic(clashing, model)
    assert left.columns == clashing.columns and {(r["_Toxicity"], r.score) for r in left.collect()} == {("mine", 7)}
    assert 0 < left.count() < docs.count()
    none = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


AWKWARD = ["</s>[INST] ok [/INST]", "a\\b", "\\", "<|end|>", "<\\|end|>", "[\\INST]", "line\nbreak", "", None, "<|turn|>user<|text|>"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(AWKWARD)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(77, 0, "user", "twice"), (77, 0, "user", "twice"), (78, None, "assistant", "x")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, target string")
    examples = chat_prefix.expand(frame)
    got = {r.conv_id: r for r in chat_prefix.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    trained = examples.where("target IS NOT NULL").groupBy("conv_id").count().collect()
    assert {r.conv_id: r["count"] for r in trained} == {c: n for c in got if (n := sum(x[0] == c and x[2] == "assistant" for x in rows))}
    assert chat_prefix.read_back(chat_prefix.expand(frame.limit(0))).count() == 0


def test_pipeline(spark, tmp_path):
    rows = corpus()
    insult = [(2000 + i, f"plain words here {'villainous ' if i % 2 else ''}and {i} more words to read", "xx", "s1", 9) for i in range(120)]
    spark.createDataFrame([*rows, *insult], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2000 + i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = " ".join(rows[32][1].split()[100:120])
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    toxic = {2000 + i for i in range(120) if i % 2}
    assert not seen[0] & toxic and {r[0] for r in rows} <= seen[0]
    assert len({20, 21, 22, 23} & seen[1]) == 1 and len({6, 7} & seen[1]) == 1
    assert seen[2] == seen[1] and seen[2] - seen[3] == {32} and seen[4] == seen[3]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_names():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(QUERIES) and len(QUERIES) == 10


def test_search_settles_ties_by_id(spark):
    """Sixty different vectors of one score: the least ids, exactly, at factor one and in one shard or many."""
    from glyphledger.llm import vp_search

    rows = [(i, [1.0, float(i) / 7]) for i in range(1, 61)] + [(0, [1.0, 0.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (16_384, 8):
        got = vp_search.search(base, F.col("vec_id") == 0, factor=1.0, shard_rows=shard_rows).orderBy("rank").collect()
        assert [(r.rank, r.vec_id, r.score) for r in got] == [(k, k, 1.0) for k in range(1, 21)]
