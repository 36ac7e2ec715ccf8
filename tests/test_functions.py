"""Scalar expressions against small models written for the tests, and the edge cases that a port gets wrong."""

from __future__ import annotations

import difflib
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphledger.functions import catalog, evidence, text
from glyphledger.operators import tiers

HYPO = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def each(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r.out for r in rows.select("i", make(F.col("s")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(("raw", "value"), [("1234.567", "1234.56"), ("7.0", "70"), ("12,5", "1.25"), ("5", "5"), ("12?45.00", "45.00"), ("123?.45", "123.45"), ("1308 9.82", "13089.82"), ("1.00 2.00", "2.00"), ("", "")])
def test_decimal_cases(spark, raw, value):
    assert each(spark, [raw], text.normalize_decimal) == [value]


@HYPO
@given(st.lists(st.tuples(st.integers(0, 10**8), st.integers(0, 99), st.sampled_from(".,:，："), st.text(alphabet="? x", max_size=3)), min_size=1, max_size=20))
def test_decimal_finds_the_amount(spark, values):
    """An amount with any mark between its parts comes out, whatever stands before it without digits."""
    raw = [f"{noise}{whole}{mark}{part:02d}" for whole, part, mark, noise in values]
    assert each(spark, raw, text.normalize_decimal) == [f"{whole}.{part:02d}" for whole, part, _, _ in values]


@HYPO
@given(st.lists(st.text(alphabet="0123456789", min_size=10, max_size=10), min_size=1, max_size=20), st.integers(0, 10))
def test_id_is_read_with_or_without_its_mark(spark, values, at):
    marked = [f"{v[:6]}/{v[6:]}" for v in values]
    noisy = [f"{v[:at]} x{v[at:]}" for v in values]
    assert each(spark, values, text.normalize_id) == each(spark, noisy, text.normalize_id) == each(spark, marked, text.normalize_id) == marked


@pytest.mark.parametrize(("raw", "value"), [("12345", "12345"), ("1/2", "1/2"), ("12345678901", "12345678901"), ("", "")])
def test_id_cases(spark, raw, value):
    assert each(spark, [raw], text.normalize_id) == [value]


def test_fold(spark):
    assert each(spark, ["Poľná 7", "ŠŤAVA", "čučoriedka ĺ ŕ ô ä", ""], text.fold) == ["polna 7", "stava", "cucoriedka l r o a", ""]


def near(word, hay):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    n = len(word)
    return word in hay or any(distance(word, hay[i : i + k]) <= 1 for k in (n, n - 1, n + 1) for i in range(len(hay) - k + 1))


@HYPO
@given(st.lists(st.tuples(st.text(alphabet="abcd", min_size=1, max_size=6), st.text(alphabet="abcd", max_size=9)), min_size=1, max_size=12))
def test_contains_within_one_edit(spark, pairs):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, w string, h string")
    got = [r.out for r in rows.select("i", text.contains_within_one_edit(F.col("w"), F.col("h")).alias("out")).orderBy("i").collect()]
    assert got == [near(w, h) for w, h in pairs]


@pytest.mark.parametrize(("truth", "read", "agrees"), [("", "anything", True), ("Slovensko", "siovensko", True), ("Poľná", "p o t n a", True), ("Krátka", "dlhá", False), ("ab", "xb", True), ("a", "", True), ("Nová ulica", "nova", False), ("dom", None, False)])
def test_text_agrees(spark, truth, read, agrees):
    rows = spark.createDataFrame([(truth, read)], "t string, r string")
    assert rows.select(text.text_agrees(F.col("t"), F.col("r")).alias("x")).first().x is agrees


def test_check_digit_and_birth(spark):
    nine = [f"{n:09d}" for n in range(990100001, 990100200, 7)]
    got = each(spark, nine, text.check_digit)
    assert all(d == 10 or int(n + str(d)) % 11 == 0 for n, d in zip(nine, got, strict=True))
    assert each(spark, ["8552151234", "0101301234"], text.birth_date_of) == ["15021985", "30012001"]


def test_truncate_money(spark):
    got = each(spark, ["1.239", "-1.239", "0.005"], lambda s: text.truncate_money(s.cast("decimal(18,3)")).cast("string"))
    assert got == ["1.23", "-1.23", "0.00"]


def test_occupancy_boundaries(spark):
    assert each(spark, [0.1, 0.07, 0.13, 0.5], evidence.occupancy_confidence, "double") == pytest.approx([0.0, 0.3, 0.3, 1.0])
    at = spark.createDataFrame([([0] * 10 + [255] * 90,), ([0] * 11 + [255] * 89,)], "px array<int>").select(evidence.occupied(F.col("px")).alias("o")).collect()
    assert [r.o for r in at] == [False, True]


def test_blank_amount_is_sure_zero(spark):
    cells = [("l", 0.0, 0.9)] * 10
    rows = spark.createDataFrame([([dict(zip(("text", "ink", "score"), c, strict=True)) for c in cells],)], "cells array<struct<text:string,ink:double,score:double>>")
    got = rows.select(evidence.amount_of(F.col("cells")).alias("v"), evidence.id_of(F.col("cells")).alias("i"), evidence.field_confidence(F.array().cast("array<struct<score:double>>")).alias("c")).first()
    assert (got.v, got.i, got.c) == ("0.00", "", 1.0)


def test_catalog(spark):
    rows = catalog.field_catalog(spark)
    assert rows.count() == 130 and rows.where("page = 1").count() == 26 and rows.select("field").distinct().count() == 130


def test_similarity_is_the_ratio_of_keys(spark):
    pairs = [("Krátka", "KRATKA"), ("Dlhá 5", "dlha"), ("", ""), ("abc", "xyz")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.x for r in rows.select("i", tiers.similarity(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    key = lambda s: "".join(ch for ch in unicodedata.normalize("NFD", s.upper()) if unicodedata.category(ch) != "Mn" and ch.isalnum())
    assert got == pytest.approx([difflib.SequenceMatcher(None, key(a), key(b)).ratio() for a, b in pairs])


def test_strip_marks_of_every_character(spark):
    """Every code point of the basic plane, alone and between letters, as canonical decomposition without marks has it."""
    import unicodedata

    plain = lambda t: "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn")
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    texts = [*chars, *["".join(f"a{c}" for c in chars[i : i + 300]) for i in range(0, len(chars), 300)], "", "a\u0301\u0323b", "한국어 Ünï", "𝒳🙂é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: r.out for r in rows.select("i", text.strip_marks(F.col("t")).alias("out")).collect()}
    wrong = [(hex(ord(t[0])) if t else "", got[i], plain(t)) for i, t in enumerate(texts) if len(t) < 300 and got[i] != plain(t)]
    assert wrong == []
    # between letters no mark moves over another
    assert all(got[i] == "".join(map(plain, t)) for i, t in enumerate(texts))


@pytest.mark.parametrize(("word", "hay", "inside"), [("a.c", "xabcx", True), ("a.c", "xa.cx", True), ("(a)[b]", "..(a)[c]..", True), ("a+b*", "aab", False), ("a+b*", "a+b", True), ("x", "", True), ("", "", True), ("ab", "\nb", True), ("ab\\cd", "ab\\xd", True), ("a{2}b", "aab", False), ("ab", "", False), ("abc", "a\nc", True), ("🙂é漢", "x🙂漢y", True)])
def test_words_with_signs(spark, word, hay, inside):
    rows = spark.createDataFrame([(word, hay)], "w string, h string")
    assert rows.select(text.contains_within_one_edit(F.col("w"), F.col("h")).alias("x")).first().x is inside is near(word, hay)
