"""Nearest entries by tries, broadcast and in shards, against all distances."""

from __future__ import annotations

import random

import numpy as np
import pytest

from glyphledger.functions.text import key_lower
from glyphledger.functions.trie import Trie, nearest
from glyphledger.operators import register


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def noisy(rng, word, n, letters):
    out = list(word)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(out) + 1)
        if kind == 0:
            out.insert(at, rng.choice(letters))
        elif out and kind == 1:
            del out[min(at, len(out) - 1)]
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefghij0123456789", "aé漢"])
def test_within(letters):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(120)}, key=lambda _: rng.random())
    texts = ["", *[noisy(rng, rng.choice(keys), rng.randint(0, 4), letters) for _ in range(60)]]
    radius = np.array([rng.randint(0, 4) for _ in texts])
    got = sorted(zip(*(x.tolist() for x in Trie(keys).within(texts, radius)), strict=True))
    assert got == [(i, k, d) for i, t in enumerate(texts) for k, key in enumerate(keys) if (d := edits(t, key)) <= radius[i]]
    begun = {(i, k): d for i, k, d in zip(*(x.tolist() for x in Trie(keys).within(texts, radius, prefixes=True)), strict=True)}
    assert begun == {(i, k): d for i, t in enumerate(texts) for k, key in enumerate(keys) if (d := min(edits(t[:j], key) for j in range(len(t) + 1))) <= radius[i]}


def test_nothing():
    assert [len(x) for x in Trie([]).within(["a"], np.array([3]))] == [0, 0, 0]
    assert [len(x) for x in Trie(["a"]).within([], np.array([]))] == [0, 0, 0]
    best, d, _ = nearest(Trie(["", "b"]), ["", "c"], np.array([0, 1]), np.array([0, 1]))
    assert best.tolist() == [0, 0] and d.tolist() == [0, 1]


def test_radius():
    for n in range(200):
        far = max(d for d in range(n + 2) if d <= max(1, int((n + d) * register.TOLERANCE)))
        assert register.radius(np.array([n])).tolist() == [far]


@pytest.mark.parametrize("way", [{}, {"max_broadcast_bytes": 0, "shard_entries": 9}, {"max_broadcast_bytes": 0, "shard_entries": 10_000}])
def test_nearest_entry(spark, monkeypatch, way):
    monkeypatch.setattr(register, "VISITS", 20)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 11)))
    entries = [(rng.choice(["x", "x", "y"]), f"{word()} {word()}", rng.randint(1, 90)) for _ in range(150)] + [("x", "--", 3), ("y", None, 4), (None, "abc", 5), ("x", "Same One", 7), ("x", "same-one", 7), ("x", "aa", 1), ("x", "ab", 1)]
    said = [(i, rng.choice(["x", "y", "none", None]), noisy(rng, (rng.choice(entries)[1] or ""), rng.randint(0, 6), "abcde -")) for i in range(250)]
    said += [(300, "x", None), (301, "x", " "), (302, "x", "--"), (303, "x", "sameone"), (304, "x", "a"), (304, "x", "a"), (305, "x", "e" * 60), (None, "y", "bad")]
    rows = spark.createDataFrame(said, "k int, list_name string, value string")
    reg = spark.createDataFrame(entries, "list_name string, entry string, ord int")
    got = register.nearest_entry(rows, reg, key="k", **way).collect()
    keys = {r.v: r.k for r in spark.createDataFrame([(x,) for x in {e[1] for e in entries} | {(s[2] or "").strip(" ") for s in said}], "v string").select("v", key_lower("v").alias("k")).collect()}
    want = []
    for k, name, value in said:
        raw = (value or "").strip(" ")
        q, mine = keys[raw], [(keys[e], o, e) for n, e, o in entries if n == name and n is not None and e is not None]
        out = (raw, False, 0.0)
        if q and mine:
            d, _, e, n = min((edits(q, key), o, e, len(key)) for key, o, e in mine)
            longest = max(len(q), n)
            if d <= max(1, int(longest * register.TOLERANCE)):
                out = (e, True, 1.0 if d == 0 else round(1 - d / max(1, longest), 3))
        want.append((k, name, value, *out))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_few_of_all_pairs():
    """Names against a hundred thousand entries: under one in twenty pairs is compared, at every radius."""
    rng = random.Random(5)
    keys = sorted({f"customer{rng.randrange(10**9):09d}" for _ in range(100_000)})
    texts = [noisy(rng, f"customer{rng.randrange(10**9):09d}", rng.randint(0, 3), "0123456789c") for _ in range(100)]
    best, d, compared = nearest(Trie(keys), texts, register.radius(np.array([len(t) for t in texts])), np.arange(len(keys)))
    assert (best >= 0).all() and compared < 0.05 * len(keys) * len(texts)
    for i in range(3):
        assert (d[i], best[i]) == min((edits(texts[i], k), j) for j, k in enumerate(keys))


def test_no_key_farther_than_the_nearest_is_compared():
    """The distance rises by one: with doubling, texts three edits away from a key met all keys at four."""
    rng = random.Random(6)
    keys = sorted({"".join(rng.choice("abcd") for _ in range(9)) for _ in range(4000)})
    texts = [noisy(rng, "x" * 3 + rng.choice(keys), rng.randint(0, 2), "abcd") for _ in range(40)] + ["y" * 70, rng.choice(keys) + "z" * 60]
    best, d, compared = nearest(Trie(keys), texts, np.full(len(texts), 5), np.arange(len(keys)))
    far = [[edits(t, k) for k in keys] for t in texts]
    want = [min((x, j) for j, x in enumerate(row)) for row in far]
    assert [(x, j) for x, j in zip(d.tolist(), best.tolist(), strict=True) if j >= 0] == [(x, j) for x, j in want if x <= 5]
    assert compared == sum(row.count(min(row)) for row in far if min(row) <= 5)


@pytest.mark.parametrize("n", [62, 63, 64, 65])
def test_words_of_bits(n):
    rng = random.Random(n)
    key = "".join(rng.choice("ab") for _ in range(n))
    texts = [noisy(rng, key, 40, "ab")[:n].ljust(n, "b") for _ in range(5)]
    keys = [key, key[1:], key + "a", key[:30], "", *texts[:2]]
    got = sorted(zip(*(x.tolist() for x in Trie(keys).within(texts, np.full(5, n + 2))), strict=True))
    assert got == [(i, k, edits(t, w)) for i, t in enumerate(texts) for k, w in enumerate(keys)]


def test_lookups_are_dealt_over_tasks(spark):
    """Keys to look up are few bytes, which Spark puts into one task."""
    asked = spark.createDataFrame([("x", f"key{i}", 1) for i in range(40)], "_list string, _key string, reach int").coalesce(1)
    entries = spark.createDataFrame([("x", f"kay{i}", i, f"kay{i}") for i in range(40)], "_list string, _key string, ord long, entry string")
    assert register._by_broadcast(asked, entries).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_one_edit(spark):
    """Exactly the keys that are one edit away, each with the entry of least place among these."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 5))) for _ in range(150)}, key=lambda _: rng.random())
    entries, keys = [(rng.choice("xy"), w) for w in words[:60]], [(n, w) for n in "xyz" for w in words[60:]]
    placed = spark.createDataFrame([(n, w, i, i // 2, w) for i, (n, w) in enumerate(entries)], "_list string, _key string, place long, ord long, entry string")
    asked = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "_list string, _key string, q long")
    want = [(n, w, 1, i // 2, entries[i][1]) for n, w in keys if (i := next((i for i, (m, e) in enumerate(entries) if m == n and edits(w, e) == 1), None)) is not None]
    assert len(want) > 30 and sorted(map(tuple, register._one_edit(asked, placed).collect())) == sorted(want)


def test_rounds_of_shards(spark, monkeypatch):
    """Keys far from all entries visit the shards round by round, and the few that are left go all the way."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    entries = [("x", word(20), i) for i in range(60)]
    said = [(i, "x", noisy(rng, rng.choice(entries)[1], rng.randint(0, 9), "abc")) for i in range(60)] + [(99, "x", word(90))]
    rows, reg = spark.createDataFrame(said, "k int, list_name string, value string"), spark.createDataFrame(entries, "list_name string, entry string, ord int")
    want = sorted(map(tuple, register.nearest_entry(rows, reg, key="k").collect()))
    for few in (0, 100):
        monkeypatch.setattr(register, "FEW", few)
        assert sorted(map(tuple, register.nearest_entry(rows, reg, key="k", max_broadcast_bytes=0, shard_entries=9).collect())) == want


def test_large_tables_do_not_pass_through_the_driver(spark, monkeypatch):
    """Files of keys that are all alike are small, however many they are: no join of a large register sends a side to all tasks."""
    n = 2000
    placed = register.written(spark.range(n).selectExpr("'x' AS _list", "lpad(string(id), 9, 'k') AS _key", "id AS place", "id AS ord", "lpad(string(id), 9, 'k') AS entry"))
    asked = register.written(spark.range(n).selectExpr("'x' AS _list", "lpad(string(id * 3), 10, 'k') AS _key", "id AS q", "3 AS reach"))
    rows = spark.range(n).selectExpr("id AS k", "'x' AS list_name", "lpad(string(id * 3), 10, 'k') AS value")
    reg = placed.select(placed["_list"].alias("list_name"), "entry", "ord")
    monkeypatch.setattr(register, "MAX_SENT_BYTES", 0, raising=False)
    for df in (register._one_edit(asked, placed), register.nearest_entry(rows, reg, key="k", max_broadcast_bytes=0, shard_entries=500)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_register_reaches_the_driver_as_arrow(spark, monkeypatch):
    entries = spark.createDataFrame([("x", "kay", 1, "Kay"), ("x", "kai", None, "Kai")], "_list string, _key string, ord long, entry string")
    asked = spark.createDataFrame([("x", "key", 1)], "_list string, _key string, reach int")
    monkeypatch.setattr(type(entries), "toPandas", None)
    assert [tuple(r) for r in register._by_broadcast(asked, entries).collect()] == [("x", "key", 1, 1, "Kay")]
