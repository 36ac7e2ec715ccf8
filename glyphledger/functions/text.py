"""Scalar text, number and identifier expressions: Column in, Column out, no Python at run time."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that block-letter fields may hold.
ALPHABET = "aábäcčdďeéfghiíjklĺľmnňoóôpqrŕsštťuúvwxyýzžAÁBÄCČDĎEÉFGHIÍJKLĹĽMNŇOÓÔPQRŔSŠTŤUÚVWXYÝZŽ"
#: Marks that recognition reads for the decimal point.
POINT_LIKE = "，,：:"


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def normalize_decimal(s: Column) -> Column:
    """The last amount with two decimals; where there is none, the digits with a point put before the last two."""
    s = F.replace(F.translate(s, POINT_LIKE, "." * len(POINT_LIKE)), F.lit(" "), F.lit(""))
    digits = digits_only(s)
    placed = F.when(F.length(digits) >= 3, F.concat(F.expr("''"), F.substring(digits, F.lit(1), F.length(digits) - 2), F.lit("."), F.right(digits, F.lit(2)))).otherwise(digits)
    return F.coalesce(F.try_element_at(F.regexp_extract_all(s, F.lit(r"[0-9]+\.[0-9]{2}"), F.lit(0)), F.lit(-1)), placed)


def normalize_id(s: Column) -> Column:
    """Digits and slashes; ten bare digits get their slash after the sixth."""
    kept = F.regexp_replace(s, "[^0-9/]", "")
    bare = ~F.contains(kept, F.lit("/")) & (F.length(kept) == 10)
    return F.when(bare, F.concat(F.left(kept, F.lit(6)), F.lit("/"), F.right(kept, F.lit(4)))).otherwise(kept)


@cache
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """(characters with one base and then all marks, their bases, characters with several bases) of the basic plane.

    Decomposition is canonical; syllables of Hangul, which follow a rule, are not among them.
    """
    one, bases, marks, several = [], [], [], {}
    for code in [*range(0x80, 0xAC00), *range(0xE000, 0x10000)]:
        char = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", char) if unicodedata.category(x) != "Mn")
        if not base:
            marks.append(char)
        elif len(base) > 1:
            several[char] = base
        elif base != char:
            one.append(char)
            bases.append(base)
    return "".join(one + marks), "".join(bases), several


def strip_marks(s: Column) -> Column:
    """Characters decomposed into their bases; marks go. (Spacing marks stay, in the order that the text has.)"""
    one, bases, several = _decomposed()
    out = F.translate(s, one, bases)
    place = F.ascii  # of one character, its code point
    syllable = lambda ch: place(ch) - 0xAC00
    jamo = lambda start, n, at: F.substring(F.lit("".join(map(chr, range(start, start + n)))), at.cast("int") + 1, F.lit(1))
    lead, vowel, tail = (lambda ch: F.floor(syllable(ch) / 588)), (lambda ch: F.floor(syllable(ch) % 588 / 28)), (lambda ch: syllable(ch) % 28)
    hangul = lambda ch: F.concat(jamo(0x1100, 19, lead(ch)), jamo(0x1161, 21, vowel(ch)), F.when(tail(ch) == 0, "").otherwise(jamo(0x11A8, 27, tail(ch) - 1)))
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    each = F.transform(F.split(out, ""), lambda ch: F.when(place(ch).between(0xAC00, 0xD7A3), hangul(ch)).otherwise(F.coalesce(F.element_at(table, ch), ch)))
    return F.when(F.rlike(out, F.lit(f"[\uac00-\ud7a3{''.join(several)}]")), F.array_join(each, "")).otherwise(out)


def fold(s: Column) -> Column:
    """Lower case without accents."""
    return strip_marks(F.lower(s))


def key_lower(s: Column) -> Column:
    """The comparison key of a register: folded, letters and digits only."""
    return F.regexp_replace(fold(s), r"[^\p{L}\p{N}]", "")


def key_upper(s: Column) -> Column:
    return F.upper(key_lower(s))


def keep_alphabet(s: Column) -> Column:
    """Anything that block letters can't be becomes a blank; blanks are single, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, f"[^{ALPHABET}]", " "), " +", " "))


def put_separator(digits: Column, kind: Column) -> Column:
    """The separator that a digit field's value has: a slash after six of ten digits of an id, a point before cents."""
    n = F.length(digits)
    as_id = F.concat(F.left(digits, F.lit(6)), F.lit("/"), F.substring(digits, F.lit(7), n))
    as_amount = F.concat(F.substring(digits, F.lit(1), F.greatest(n - 2, F.lit(0))), F.lit("."), F.right(digits, F.lit(2)))
    return F.when((kind == "id") & (n == 10), as_id).when((kind == "decimal") & (n >= 2), as_amount).otherwise(digits)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def contains_within_one_edit(word: Column, text: Column) -> Column:
    """Whether the word, or a window of its length or one more or less that is one edit away, is in the text.

    One edit leaves one half of the word as it is: texts without either half are passed over by a plain search, the others
    are matched against that half with the other one, edited in any one place, beside it. Words of one letter are in any text.
    """
    n = F.length(word)
    left, right = F.substring(word, F.lit(1), F.floor(n / 2).cast("int")), F.substring(word, F.floor(n / 2).cast("int") + 1, n)
    quoted = lambda s: F.regexp_replace(s, r"([\\^$.|?*+()\[\]{}&~#\-])", r"\\$1")
    cut = lambda s, i, j: quoted(F.substring(s, i + 1, j - i))

    def edited(s: Column) -> Column:
        """A letter replaced, left out, or put in before another."""
        size = F.length(s)
        each = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        ways = F.transform(each, lambda i: F.concat(cut(s, F.lit(0), i), F.lit("(?:.?"), cut(s, i + 1, size), F.lit("|."), cut(s, i, size), F.lit(")")))
        return F.concat(F.lit("(?:"), F.array_join(ways, "|"), F.lit(")"))

    pattern = F.concat(F.lit("(?s)"), quoted(left), edited(right), F.lit("|"), edited(left), quoted(right))
    return F.contains(text, word) | ((F.contains(text, left) | F.contains(text, right)) & F.rlike(text, pattern))


def text_agrees(truth: Column, read: Column) -> Column:
    """Every word of the truth (of two letters or more) is in the reading: as it is, without its first or last letter, or,
    from four letters on, within one edit. Blanks in the reading don't matter; an empty truth agrees with anything."""
    read = fold(F.coalesce(read, F.lit("")))
    tight = F.replace(read, F.lit(" "), F.lit(""))
    words = F.filter(F.split(fold(truth), r"\s+"), lambda w: F.length(w) >= 2)

    def there(w: Column) -> Column:
        n = F.length(w)
        return F.contains(read, w) | F.contains(tight, w) | F.contains(tight, F.substring(w, F.lit(2), n)) | F.contains(tight, F.substring(w, F.lit(1), n - 1)) | ((n >= 4) & contains_within_one_edit(w, tight))

    return F.forall(words, there)


def value_agrees(kind: Column, truth: Column, value: Column, occupied: Column) -> Column:
    """Equality of a label and a reading, by the field's kind; an id's label is taken as it is."""
    return (
        F.when(kind == "occupancy", (F.lower(truth) == "true") == occupied)
        .when(kind == "decimal", normalize_decimal(truth) == normalize_decimal(value))
        .when(kind == "id", truth == normalize_id(value))
        .when(kind == "digits", digits_only(truth) == digits_only(value))
        .otherwise(text_agrees(truth, value))
    )


def extracted_value(kind: Column, value: Column) -> Column:
    """The final value of a reading by its field's kind (occupancy has a flag instead)."""
    return F.when(kind == "decimal", normalize_decimal(value)).when(kind == "id", normalize_id(value)).when(kind == "digits", digits_only(value)).when(kind == "occupancy", F.lit(None).cast("string")).otherwise(F.trim(F.coalesce(value, F.lit(""))))


def check_digit(nine: Column) -> Column:
    """The digit that makes nine digits divisible by 11; 10 where there is none."""
    return F.pmod(-(nine.cast("long") * 10), F.lit(11))


def corrupted_id(ten: Column, shift: Column) -> Column:
    """The id with its last digit moved by 1 to 9."""
    return F.concat(F.left(ten, F.lit(9)), ((F.right(ten, F.lit(1)).cast("int") + shift) % 10).cast("string"))


def birth_date_of(ten: Column) -> Column:
    """DDMMYYYY from the first six digits of an id; months above 50 are a woman's, years from 30 on the last century's."""
    yy, mm, dd = (F.substring(ten, i, 2) for i in (1, 3, 5))
    return F.concat(dd, F.lpad((mm.cast("int") % 50).cast("string"), 2, "0"), F.when(yy.cast("int") >= 30, F.lit("19")).otherwise(F.lit("20")), yy)


def truncate_money(amount: Column) -> Column:
    """Two decimals, towards zero."""
    cents = F.floor(F.abs(amount) * 100)
    return (F.when(amount < 0, -cents).otherwise(cents).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def prompt(field: Column, reading: Column, is_name: Column) -> Column:
    """What a text cleaner is asked for an escalated reading."""
    kind = F.when(is_name, "person").when(F.contains(field, F.lit("company")), "company").otherwise("street")
    return F.format_string("Correct this misread %s in block letters: %s", kind, reading)


def completion(body: Column) -> Column:
    """The text of a cleaner's JSON answer; null where it is blank or missing."""
    text = F.trim(F.get_json_object(body, "$.choices[0].message.content"))
    return F.when(text != "", text)
