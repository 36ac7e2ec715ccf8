"""Likeness of texts in batches against the standard library, one pair at a time."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from glyphledger.functions import alike


def plain(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz0123456789", "aé漢🙂"])
def test_ratios(letters, monkeypatch):
    monkeypatch.setattr(alike, "STEP", 2000)
    rng = random.Random(len(letters))
    text = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    pairs = [("", ""), ("", "a"), ("a", ""), ("a", "a"), *[(text(20), text(20)) for _ in range(300)]]
    for _ in range(40):
        a = text(300)
        b = list(a)
        for _ in range(rng.randint(0, 30)):
            b[rng.randrange(len(b) or 1) : rng.randrange(len(b) + 1)] = text(5)
        pairs.append((a, "".join(b)))
    got = alike.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [plain(a, b) for a, b in pairs]


def test_popular_characters():
    """From 200 characters on, frequent ones start no block but belong to one."""
    rng = random.Random(1)
    pairs = []
    for n in (198, 199, 200, 201, 450):
        for _ in range(12):
            a = "".join(rng.choice("ee  tab") if rng.random() < 0.8 else chr(rng.randrange(200, 900)) for _ in range(n))
            cut = rng.randrange(n)
            pairs += [(a, a[cut:] + a[:cut]), (a[:50], a), ("e" * n, "e" * n), ("e" * 30, "e" * n)]
    got = alike.ratios(*map(list, zip(*pairs, strict=True)))
    assert got.tolist() == [plain(a, b) for a, b in pairs]


def test_no_pairs():
    assert isinstance(alike.ratios([], []), np.ndarray) and len(alike.ratios([], [])) == 0
