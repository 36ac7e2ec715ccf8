"""Toxicity, weak labels, shared passages and the whole pipeline against plain versions of them."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphledger.llm import chain_dedup, common, toxicity, weak_quality
from tests.llm import brute
from tests.llm.fixtures import SCHEMA, corpus, words

INSULTS = ["you scoundrel", "V1LLAIN here", "ѕcoundrel", "Víllain trash can", "trash day scoundrel", "villainous"]


def insulted(n=300):
    """(doc_id, text, toxic): every third has an insult, some of them disguised, some next to an exception."""
    rng = random.Random(6)
    rows = []
    for i in range(n):
        filler = words(rng, rng.randint(5, 60))
        if i % 3 == 0:
            filler.insert(rng.randrange(len(filler)), rng.choice(INSULTS))
        if i % 5 == 0:
            filler += ["the trash can", "scoundrels!"] if i % 3 == 0 else ["the trash can"]
        rows.append((i, " ".join(filler), int(i % 3 == 0)))
    return rows


def test_toxicity_against_every_term_at_every_place(spark):
    rows = insulted()
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), (900, None), (901, ""), (902, " \n"), (903, "scoundrel " * 30_000), (903, "trash can")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    train = F.col("doc_id") % 4 > 0
    model = toxicity.learn(docs, labels, train)
    taught = [(t, x) for i, t, x in rows if i % 4]
    toxic, clean = sum(x for _, x in taught), sum(1 - x for _, x in taught)
    counts = brute.term_counts(taught)
    assert model["terms"] and model["prior"] == pytest.approx(toxic / (toxic + clean))
    for term, weight in model["terms"].items():
        t, c = counts[term]
        assert weight == pytest.approx(math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))) and t >= 3 and weight >= 2
    # a term that all insults of one kind bring is in, itself or by its beginning
    assert all(any(f" {w} ".startswith(term) for term in model["terms"]) for w in ("scoundrel", "villain"))
    texts = {i: t for i, t, _ in rows} | {900: None, 901: "", 902: " \n"}
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id <> 903"), model).collect()}
    assert set(got) == set(texts)
    for i, score in got.items():
        assert score == pytest.approx(brute.toxicity_score(texts[i], model), rel=1e-9)


def test_terms_are_counted_whole(spark, monkeypatch):
    """However often a task passes its counts on."""
    rows = insulted(60)
    frame = spark.createDataFrame([(x, brute.folded(t)) for _, t, x in rows], "toxic int, folded string").repartition(3)
    want = brute.term_counts([(t, x) for _, t, x in rows])
    got = frame.mapInArrow(toxicity._count_terms, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    assert {r.term: (r.t, r.c) for r in got} == want
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "COUNTED", 50)
    parts = list(toxicity._count_terms(iter([pa.RecordBatch.from_pylist([{"toxic": x, "folded": brute.folded(t)} for _, t, x in rows])])))
    summed = defaultdict(lambda: (0, 0))
    for part in parts:
        for r in part.to_pylist():
            t, c = summed[r["term"]]
            summed[r["term"]] = (t + r["t"], c + r["c"])
    assert len(parts) > 3 and dict(summed) == want


def plain_measures(text):
    """The labellers' measures of one text, in the order of MEASURES."""
    data = (text or "").encode()
    size = max(len(data), 1)
    w = brute.low_words(text)
    n = max(len(w), 1)
    lines = [x for x in data.split(b"\n") if x]
    share = lambda members: sum(b in members for b in data) / size
    letters = max(share({*range(65, 91), *range(97, 123), *range(128, 256)}), 1e-9)
    plain = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b" \t\n\r\x0b\x0c.,;:!?'\"()-"}
    symbols = share(set(range(256)) - plain)
    copies = 1 - len({x.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for x in lines}) / len(lines) if lines else 0
    again = sum(a == b for a, b in zip(w, w[1:], strict=False)) / n
    return [len(w), sum(len(x.encode()) for x in w) / n, letters, symbols, share(set(range(65, 91))) / letters, copies, len(set(w)) / min(n, 200 + n / 8), again, share(set(b".!?"))]


def plain_votes(m):
    out = []
    for _, name, bad_below, good_from, good_to, bad_above in weak_quality.LABELLERS:
        x = m[weak_quality.MEASURES.index(name)]
        out.append(-1 if x < bad_below or x > bad_above else 1 if good_from <= x <= good_to and m[0] > 0 else 0)
    return tuple(out)


def plain_posteriors(patterns):
    """Expectation-maximisation, document by document and labeller by labeller."""
    counts = Counter(patterns)
    post = {p: 0.05 if -1 in p else 0.97 for p in counts}
    for _ in range(300):
        rates = []
        for k, start in ((0, (1.0, 1.0, 1.0)), (1, (0.1, 1.0, 2.0))):
            table = []
            for j in range(len(weak_quality.LABELLERS)):
                seen = list(start)
                for p, n in counts.items():
                    seen[p[j] + 1] += n * (post[p] if k else 1 - post[p])
                table.append([x / sum(seen) for x in seen])
            rates.append(table)
        good = min(0.98, max(0.02, sum(n * post[p] for p, n in counts.items()) / counts.total()))
        new = {}
        for p in counts:
            odds = math.log((1 - good) / good) + sum(math.log(rates[0][j][v + 1]) - math.log(rates[1][j][v + 1]) for j, v in enumerate(p))
            new[p] = 1 / (1 + math.exp(max(-50, min(50, odds))))
        done = max(abs(new[p] - post[p]) for p in counts) < 1e-9
        post = new
        if done:
            break
    return post


def weak_rows():
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in corpus()]
    rows += [(1000 + i, "$$ ## @@ !! " * rng.randint(2, 20) + w) for i, w in enumerate(words(rng, 12))]
    rows += [(1100 + i, "\n".join(["Same line here."] * 12 + words(rng, 3))) for i in range(6)]
    rows += [(1200 + i, " ".join(words(rng, 80)).upper() + ". Ok!") for i in range(6)]
    return rows


def test_weak_labels_against_plain_expectation_maximisation(spark):
    rows = weak_rows()
    docs = spark.createDataFrame([(i, t, "clash", 0.0, True) for i, t in rows], "doc_id long, text string, weak_label string, score double, keep boolean").repartition(3)
    model = weak_quality.learn(docs)
    patterns = [plain_votes(plain_measures(t)) for _, t in rows]
    post = plain_posteriors(patterns)
    want = sorted((i, post[p]) for (i, _), p in zip(rows, patterns, strict=True))
    scored = weak_quality.score(docs, model)
    got = sorted((r.doc_id, r.weak_label) for r in scored.collect())
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)
    assert scored.columns == ["doc_id", "weak_label", "score", "keep"]
    # the scorer's answer from the texts' words and measures, slot by slot
    texts = dict(rows)
    for r in scored.collect():
        text = (texts[r.doc_id] or "").encode()
        hashes, _, _, _ = common.hashed_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        slots = Counter(int(h) >> (64 - weak_quality.HASH_BITS) for h in hashes)
        z = model["bias"] + sum(model["weights"][s] * 0.5 * math.sqrt(n / len(hashes)) for s, n in slots.items())
        m = plain_measures(texts[r.doc_id])
        steps = [math.log2(1 + m[0]) * 2, m[1] * 2, m[2] * 20, m[3] * 50, m[4] * 20, m[5] * 20, m[6] * 10, m[7] * 20, math.sqrt(m[8]) * 40]
        for j, x in enumerate(steps):
            h = common.mix64(np.array([int(min(max(x, 0), 60)) + 1000 * (j + 1)], np.uint64))[0]
            z += model["weights"][int(h) >> (64 - weak_quality.HASH_BITS)]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))) if m[0] else 0.0, abs=1e-6)
        assert r.keep == (r.score >= 0.5)


def test_weak_labels_of_a_text_do_not_depend_on_its_copies_place(spark):
    rows = [*weak_rows(), (None, "A plain line of words, nothing more."), (None, "A plain line of words, nothing more."), (7, "word " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(repr, weak_quality.score(docs, weak_quality.learn(docs.repartition(2))).collect()))
    two = sorted(map(repr, weak_quality.score(docs.repartition(5), weak_quality.learn(docs.repartition(7))).collect()))
    assert one == two and len(one) == len(rows)


def passages(rng):
    """Texts with shared passages of all kinds, and a plain filler text for each."""
    rows = [(r[0], r[1]) for r in corpus()]
    edited = words(rng, 120)
    for k in range(4):
        own = list(edited)
        for at in rng.sample(range(120), 3 * k):
            own[at] = f"edit{k}{at}"
        rows.append((500 + k, " ".join([*words(rng, 25), *own, *words(rng, 25)])))
    line = words(rng, 49)
    rows += [(600 + k, " ".join([*words(rng, 20), *line, *words(rng, 20)])) for k in range(3)]
    line = words(rng, 50)
    rows += [(700 + k, " ".join([*words(rng, 20), *line, *words(rng, 20)])) for k in range(3)]
    return rows


def test_chains_against_all_fifty_word_runs(spark):
    """Every word of a run of 50 equal words that another text has too lies in a passage, and every passage is one."""
    rows = passages(random.Random(8))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, start string").repartition(3)
    got = chain_dedup.repeated_passages(docs).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[t].append(i)
    word = {i: brute.low_words(t) for i, t in rows}
    covered = defaultdict(set)
    for r in got:
        covered[r.doc_id] |= set(range(r.start, r.stop))
        covered[r.other_id] |= set(range(r.other_start, r.other_stop))
        a, b = word[r.doc_id][r.start : r.stop], word[r.other_id][r.other_start : r.other_stop]
        assert len(a) >= 50 and r.identity >= 0.8 and r.doc_id != r.other_id
        assert brute.common_length(a, b) / max(len(a), len(b)) >= r.identity - 1e-9
    where = defaultdict(set)
    for t, ids in texts.items():
        w = brute.low_words(t)
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(min(ids))
    for w, ids in where.items():
        if len(ids) > 1:
            for i in ids:
                at = next(k for k in range(len(word[i]) - 49) if tuple(word[i][k : k + 50]) == w)
                assert set(range(at, at + 50)) <= covered[i], (i, at)
    # copies, from end to end; a line of 49 words is no passage
    assert any(r.doc_id == 7 and r.other_id == 6 and r.start == 0 and r.stop == len(word[7]) for r in got) == (len(word[7]) >= 50)
    assert not {600, 601, 602} & set(covered) and {700, 701, 702} <= set(covered) and {500, 501, 502, 503} <= set(covered)
    again = chain_dedup.repeated_passages(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows = corpus()
    rows += [(2000 + i, f"plain words here {'villainous ' if i % 2 else ''}and {i} more words to read", "xx", "s1", 9) for i in range(120)]
    rows += [(None, "A text without an id, of a few words.", "xx", None, 9), (None, "Another one without an id, quite different.", "xx", "s2", 9), (5, "An id that another text has as well.", "xx", "s3", 9)]
    names = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, leaks string, taken string"
    spark.createDataFrame([(*r, "x", 0.5, "y", "z") for r in rows], names).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(2000 + i, i % 2) for i in range(120)]
    spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join(rows[32][1].split()[100:120])), (2, "no document has these words one after another in it")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), common.crc_mod5("doc_id") != 0)
    kept = [r for r in rows if brute.toxicity_score(r[1], model) < 0.5]
    assert len(kept) == len(rows) - 60
    # of each class the row with the least id, null last
    classes = defaultdict(list)
    for r, c in zip(kept, brute.near_classes([r[1] for r in kept]), strict=True):
        classes[c].append(r)
    kept = [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]
    cut = brute.repeats([r[1] for r in kept], 200)
    kept = [(r[0], r[1] if not gone else rest.decode("utf-8", "ignore"), r[3]) for r, (_, gone, _, rest) in zip(kept, cut, strict=True)]
    assert any(x[1] for x in cut)
    kept = [r for r, found in zip(kept, brute.leaks([r[1] for r in kept], items), strict=True) if not found[1]]
    sized = [(r[0], r[2], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in kept]
    size, target = brute.mix_targets([(s, n) for _, s, n in sized])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, n) for i, _, n in sized)
    want = defaultdict(Counter)
    for i, s, n in sized:
        want[i, n][s] += 1
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        assert any(r.source_size == size[s] and r.target == pytest.approx(target[s]) for s in want[r.doc_id, r.size])
    for s in size:
        taken = sum(r.taken for r in out if r.source_size == size[s])
        same = [x for x in size if size[x] == size[s]]
        assert taken == pytest.approx(sum(target[x] for x in same), abs=2 * max(n for _, x, n in sized if x == s))


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
