"""A small corpus with every awkward case: nulls, blanks, copies, near copies, shared passages, junk, long texts, ties."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ren tas vor el du pin sho gra né lü ob".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(seed)
    shared = " ".join(words(rng, 70))
    texts: list[str | None] = [" ".join(words(rng, rng.choice([1, 3, 8, 40, 120, 300]))) for _ in range(n)]
    texts[3] = None
    texts[4] = ""
    texts[5] = "   \n\t "
    texts[6] = texts[7]
    for i in (10, 11, 12, 13):
        texts[i] = f"{' '.join(words(rng, 30))} {shared} {' '.join(words(rng, 25))}"
    base = words(rng, 200)
    for i in (20, 21, 22, 23):
        edited = list(base)
        edited[rng.randrange(200)] = "changed"
        texts[i] = " ".join(edited)
    texts[30] = "na " * 400
    texts[31] = "é" * 900
    texts[32] = " ".join(words(rng, 6000))
    rows = [(i, t, "xx", rng.choice(["s1", "s2", "s3", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
