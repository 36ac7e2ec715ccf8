"""Each corpus operator against a brute-force version, over the awkward cases of fixtures.py."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from glyphledger.llm import chain_dedup, context_mixing, cube_mix, dart_minhash, decontaminate, suffix_dedup, weak_quality
from glyphledger.llm.common import crc_mod5
from tests.llm.fixtures import SCHEMA, corpus, words

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def low_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def held(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % 5 == k


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with what operators add."""
    return spark.createDataFrame([(*r, "x", 1.0, None) for r in rows], SCHEMA + ", leaks string, score double, spans string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontaminate(spark, docs, rows, empty):
    some = low_words(rows[12][1])
    items = [(1, " ".join(some[5:30])), (2, "Sole"), (3, None), (4, ""), (5, " ".join(low_words(rows[32][1])[4000:4015])), (5, rows[0][1]), (6, " ".join(some[5:30]).upper()), (None, rows[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = low_words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = []
    for r in rows:
        w, hit, found = low_words(r[1]), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                got = windows.get(tuple(w[k : k + n]))
                if got and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= got
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for block in (decontaminate.BENCH_BLOCK_BYTES, 64):  # one block of items, and many
        found = decontaminate.summarize(decontaminate.find_leaks(docs, bench, bench_block_bytes=block))
        got = [tuple(x) for x in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
        assert Counter(got) == Counter(want)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram"), [(200, 96), (40, 12)])
def test_suffix_dedup(docs, rows, empty, length, gram):
    got = suffix_dedup.digest(docs, length=length, gram=gram).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], length), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(w[2] for w in want) > 0
    assert suffix_dedup.digest(empty, length=length, gram=gram).count() == 0


def test_suffix_dedup_doubles_one_copy_of_each_text(spark, monkeypatch):
    rng = random.Random(9)
    base = words(rng, 200)
    near = [*base[:100], "changed", *base[101:]]
    texts = [" ".join(base)] * 500 + [" ".join(near)] * 300
    sizes, plain = [], suffix_dedup._repeated
    monkeypatch.setattr(suffix_dedup, "_repeated", lambda pairs: sizes.append((pairs.count(), pairs.select("tid", "p").distinct().count())) or plain(pairs))
    got = suffix_dedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(brute_repeats(texts, 200))
    # two rounds, at offsets 50 and 100; each position once, and fewer from round to round
    assert len(sizes) == 2 and all(n == m > 0 for n, m in sizes) and sizes[1][0] < sizes[0][0] < 2 * len(texts[0])


def test_suffix_dedup_long_text(spark):
    """A text of several blocks, cut at its repeated passage only."""
    rng = random.Random(4)
    one, two = (" ".join(words(rng, 260_000)) for _ in range(2))
    passage = one[700_000:701_000]
    texts = [one, f"{two} {passage} end"]
    got = sorted(suffix_dedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    size = len(passage.encode())
    assert len(texts[0].encode()) > suffix_dedup.C.BLOCK_BYTES and [r.n_spans for r in got] == [1, 1] and all(size <= r.n_removed <= size + 2 for r in got)


def test_remove_repeats(docs, rows, empty):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    cut = {r.doc_id: r for r in out.collect()}
    assert cut[3].text is None and cut[4].text == "" and cut[6].text == cut[7].text and len(cut[10].text) < len(rows[10][1])
    assert cut[10].leaks == "x" and cut[10].score == 1.0 and cut[10].spans is None
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_near_duplicates(docs, rows, empty):
    shingle = {}
    for r in rows:
        w = low_words(r[1])
        shingle[r[0]] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter({("", r[1]): 1})
    root = {i: i for i in shingle}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in shingle:
        for b in shingle:
            both = sum((shingle[a] & shingle[b]).values())
            if a < b and both / (shingle[a].total() + shingle[b].total() - both) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = dart_minhash.classes(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i in shingle}
    kept = dart_minhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({find(i) for i in shingle}) and kept.columns == docs.columns
    assert dart_minhash.classes(empty).count() == 0


def test_signatures_of_short_texts_take_bounded_memory():
    """A block of many short texts, signed in parts: the same signatures, and memory that their number doesn't raise."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    n = 6000
    row = np.repeat(np.arange(n), rng.integers(0, 9, n))
    shingle = rng.integers(0, 2**63, len(row)).astype(np.uint64)
    tracemalloc.start()
    got = dart_minhash._signed(shingle, row, n, 120)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == dart_minhash.signatures(shingle, row, n, 120)).all() and peak < 60 << 20


def test_near_duplicates_null_and_repeated_ids(spark):
    """Rows that share an id, or have none, stand for their own texts."""
    text = lambda mark, n=200: " ".join(f"{mark}{i}" for i in range(n))
    near = text("a", 199) + " changed"
    rows = [(None, text("p")), (None, text("q")), (None, text("q")), (None, None), (7, text("r")), (7, text("s")), (7, text("s")), (None, near), (3, text("a")), (1, text("t")), (3, text("t")), (9, near), (None, "")]
    kept = dart_minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    heads = {text(m) for m in "pqrst"} | {None, ""}
    assert Counter(r.text for r in kept) == Counter([*heads, text("a")])
    assert {r.text: r.doc_id for r in kept}[text("a")] == 3 and {r.text: r.doc_id for r in kept}[text("t")] == 1


def test_near_duplicates_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, 2, "x"), (2, "a b c d e f", 3, 4, "y"), (3, "g h", 5, 6, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _TID int, _kept int, _kept_tid string")
    kept = dart_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_near_duplicates_beyond_the_leader(spark, monkeypatch):
    """A chain of texts, each alike to its next two only: links that no leader has."""
    base, other = ([f"{mark}{i}" for i in range(200)] for mark in "xy")
    chain = [(k, " ".join(other[: 6 * k] + base[6 * k :])) for k in range(12)]
    far = [(100 + k, " ".join(f"z{k}w{i}" for i in range(200))) for k in range(3)]
    texts = spark.createDataFrame(chain + far, "doc_id long, text string")
    for small_rows, few in ((1024, 32), (0, 32), (0, 1)):  # settled in a task, by its pairs, or around pivots
        monkeypatch.setattr(dart_minhash, "FEW", few)
        got = {r.doc_id: r.class_id for r in dart_minhash.classes(texts, small_rows=small_rows).collect()}
        assert got == {i: 0 if i < 100 else i for i, _ in chain + far}


def test_chains_find_shared_passages(docs, rows, empty):
    got = chain_dedup.repeated_passages(docs).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in got}
    linked = {i for p in pairs for i in p}
    assert {10, 11, 12, 13, 20, 21, 22, 23} <= linked
    assert not linked & {0, 1, 2, 3, 4, 5, 30, 31}
    assert all(r.stop - r.start >= 50 and r.identity >= 0.8 for r in got)
    assert chain_dedup.repeated_passages(empty).count() == 0


def test_chains_cross_lines_of_other_texts(spark):
    """Two lines that many texts have stand next to each other in two texts only."""
    rng = random.Random(11)
    texts, want = [], set()
    for _ in range(20):
        one, two = words(rng, 30), words(rng, 30)
        for line in (one, two):
            texts += [" ".join([*words(rng, 40), *line, *words(rng, 40)]) for _ in range(12)]
        want.add(frozenset((len(texts), len(texts) + 1)))
        texts += [" ".join([*words(rng, 40), *one, *two, *words(rng, 40)]) for _ in range(2)]
    got = chain_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in got} == want and all(r.stop - r.start >= 60 for r in got)


def test_chains_refer_past_texts_that_share_less(spark):
    """Each piece of a passage stands alone in many smaller texts; the two that share it whole are found all the same."""
    rng = random.Random(12)
    passage = words(rng, 80)
    texts = [" ".join([*words(rng, 30), *passage[k : k + 8], *words(rng, 30)]) for k in range(73)]
    texts += [" ".join([*words(rng, 40), *passage, *words(rng, 40)]) for _ in range(2)]
    got = chain_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in got} == {frozenset((73, 74))} and all(r.stop - r.start >= 80 for r in got)


def test_chain_and_alignment():
    import numpy as np

    assert chain_dedup.chain(np.array([0, 20, 45]), np.array([5, 26, 50]), np.array([10, 10, 10])) == [[0, 1, 2]]
    crossing = chain_dedup.chain(np.array([0, 20]), np.array([50, 5]), np.array([10, 10]))
    assert sorted(map(tuple, crossing)) == [(0,), (1,)]
    a = np.arange(100)
    b = np.concatenate([np.arange(40), [999], np.arange(40, 100)])
    assert chain_dedup.align(a, b, [5, 50], [5, 51], [20, 20]) == (0, 100, 0, 101, 100 / 101)


def test_context_mixing(docs, rows, empty):
    got = sorted(map(tuple, context_mixing.score(docs, crc_mod5("doc_id") == 1, known_words=50).collect()))
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), ""]
    seen = Counter(w for r in rows if not held(r[0], 1) for w in split(r[1]))
    n, v = seen.total(), len(seen)
    want = sorted((r[0], held(r[0], 1), len(split(r[1])), sum(seen[w] > 0 for w in split(r[1])), n, sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(r[1]))) for r in rows)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] < 0
    # the model has learned: better than 8 bits a byte on unseen text
    texts = {r[0]: len((r[1] or "").encode()) for r in rows}
    unseen = [g for g in got if g[1] and texts[g[0]] > 200]
    assert -sum(g[6] for g in unseen) / math.log10(2) / sum(texts[g[0]] for g in unseen) < 4.5
    assert context_mixing.score(empty, crc_mod5("doc_id") == 1).count() == 0


def test_bits_per_byte(docs, rows):
    size = {r[0]: len((r[1] or "").encode()) for r in rows}
    got = context_mixing.score(docs, crc_mod5("doc_id") == 1).collect()
    assert len(got) == len(rows) and sum(size[r.doc_id] == 0 for r in got) == 2
    for r in got:
        n = size[r.doc_id]
        assert r.bits_per_byte == (pytest.approx(-r.score * math.log2(10) / n, rel=1e-12) if n else None)


def test_symbol_logs_against_a_plain_model():
    """Contexts, mixture and corrections, symbol by symbol in plain Python."""
    import numpy as np

    rng = np.random.default_rng(3)
    odds = [rng.integers(-60, 60, 1 << 16).astype(np.int8) for _ in range(3)]
    model = context_mixing.Model(odds, np.zeros(0, np.uint64), np.zeros(0))
    texts = ["Some words, né? " * 30, "", "x" * 300, "of a"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    piece = context_mixing.Piece(0, len(texts), buf, offs)
    weights = np.tile(np.array(context_mixing._BEGIN), (len(texts), context_mixing._GATES, 1))
    logs, first = model.symbol_logs(piece, weights)
    s, told, _ = context_mixing.symbols(piece)
    contexts, (length, begin, nodes, bits, depth), hashed = context_mixing.contexts(s), context_mixing.code(), context_mixing.path_tables()[0]
    for row in range(len(texts)):
        w = np.tile(np.array(context_mixing._BEGIN), (context_mixing._GATES, 1))
        n = offs[row + 1] - offs[row] + 1
        for lo, hi in zip(context_mixing._STRETCHES[:-1], context_mixing._STRETCHES[1:], strict=True):
            slope, seen = np.zeros_like(w), np.zeros(len(w))
            for i in range(lo, min(hi, n)):
                place, total = first[row] + 4 + i, 0.0
                for j in range(begin[s[place]], begin[s[place]] + length[s[place]]):
                    x = np.array([o[(c[place] + hashed[j]) % (1 << 16)] / 15.9 for o, c in zip(odds, contexts, strict=True)])
                    g = min(depth[nodes[j]], context_mixing._GATES - 1)
                    p = 1 / (1 + math.exp(-max(-14, min(14, float(w[g] @ x)))))
                    total += math.log10(p if bits[j] else 1 - p)
                    slope[g] += (bits[j] - p) * x
                    seen[g] += 1
                assert logs[place] == pytest.approx(total, abs=2e-4)
            w += np.clip(context_mixing._RATE * slope / (seen[:, None] + 8), -context_mixing._STEP, context_mixing._STEP)
        assert weights[row] == pytest.approx(w, abs=1e-3)


def test_trust_moves_with_the_words_before():
    import numpy as np

    gain = np.random.default_rng(2).normal(size=200)
    recent, says = context_mixing._RECENT, context_mixing._SAYS
    want = [max(-8, min(8, context_mixing._TRUST + says * gain[max(0, i - recent) : i].sum())) for i in range(200)]
    assert context_mixing.trusts(gain, np.zeros(0)) == pytest.approx(want)
    assert context_mixing.trusts(gain[90:], gain[90 - recent : 90]) == pytest.approx(want[90:])
    assert 10 ** context_mixing._mixed(np.array([0.0]), np.array([-1.0]), np.array([-2.0]))[0] == pytest.approx((0.1 + 0.01) / 2)


def test_scores_do_not_depend_on_partitions(docs):
    some = docs.select("doc_id", "text")
    one = sorted(map(tuple, context_mixing.score(some.repartition(2), crc_mod5("doc_id") == 1).collect()))
    two = sorted(map(tuple, context_mixing.score(some.repartition(8), crc_mod5("doc_id") == 1).collect()))
    for a, b in zip(one, two, strict=True):
        assert a[:5] == b[:5] and a[5:7] == pytest.approx(b[5:7], rel=1e-10)


def test_long_text_is_scored_in_pieces():
    import numpy as np
    import pyarrow as pa

    text = " ".join(words(random.Random(8), 30_000))
    column = pa.array(["short", text, None])
    found = list(context_mixing.pieces(column, 1 << 14))
    long = [p for p in found if p.hi == 2 and p.lo == 1]
    assert len(long) > 8 and b"".join(p.buf.tobytes() for p in long).decode() == text and [p.last for p in long] == [False] * (len(long) - 1) + [True]
    assert all(p.buf.tobytes().endswith(b" ") for p in long[:-1])
    # contexts at the start of a piece are those of the whole text
    whole = context_mixing.contexts(context_mixing.symbols(context_mixing.Piece(1, 2, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])))[0])
    part = context_mixing.contexts(context_mixing.symbols(long[3])[0])
    for a, b in zip(whole, part, strict=True):
        assert (a[long[3].at + 4 : long[3].at + 200] == b[4:200]).all()


def test_cube_mix(docs, rows, empty):
    got = cube_mix.mix(docs, block_docs=8).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * size.total(), set()
    while True:
        level = (total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and weight[s] * level > 2 * size[s]}
        if not more:
            break
        capped |= more
    target = {s: 2 * size[s] if s in capped else weight[s] * level for s in size}
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in size:
        # a document that holds most of its source can only be taken once or twice
        assert taken[s] == pytest.approx(target[s], rel=0.12 if s == source[32] else 0.03)
    assert Counter(map(tuple, got)) == Counter(map(tuple, cube_mix.mix(docs.repartition(5), block_docs=8).collect()))
    assert cube_mix.mix(empty).count() == 0


def test_weak_quality(spark, docs, rows, empty):
    junk = [(1000 + i, "$$ ## @@ !! " * 20 + w, "xx", "s1", 9) for i, w in enumerate("abcdefgh")]
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(junk, SCHEMA))
    out = {r.doc_id: r for r in weak_quality.score(more, weak_quality.learn(more)).collect()}
    assert not any(out[1000 + i].keep for i in range(8)) and not out[3].keep and not out[4].keep
    assert sum(out[r[0]].keep for r in rows if r[1] and len(low_words(r[1])) >= 40) >= 30
    assert weak_quality.score(empty, weak_quality.learn(empty)).count() == 0
