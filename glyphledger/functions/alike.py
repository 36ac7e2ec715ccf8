"""How alike two texts are: twice the characters in common blocks over the characters of both.

The longest common block comes first (the earliest in the first text, then in the second), then those on either side of it, and
so on. All pairs of a batch go together: a step looks at one character of every open stretch at a time.
"""

from __future__ import annotations

import numpy as np

#: In a second text of so many characters or more, a character that is over a hundredth of them (and one) more often starts no block.
LONG_TEXT, POPULAR_SHARE = 200, 100
#: Characters of second texts that one step looks at.
STEP = 1 << 18


def _padded(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(length.max(initial=0)) + 1), fill, np.int32)
    out[np.arange(out.shape[1]) < length[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, length


def ratios(first: list[str], second: list[str]) -> np.ndarray:
    """The likeness of each pair, from 0 to 1; two empty texts are alike."""
    out = np.ones(len(first))
    size = np.array([max(len(a), len(b)) for a, b in zip(first, second, strict=True)], np.int64)
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):  # pairs of about one size together
        some = order[at : at + max(1, STEP // (int(size[order[min(at + 4096, len(order)) - 1]]) + 1))][:4096]
        out[some] = _ratios([first[i] for i in some], [second[i] for i in some])
        at += len(some)
    return out


def _ratios(first: list[str], second: list[str]) -> np.ndarray:
    (a, n_a), (b, n_b) = _padded(first, -1), _padded(second, -2)
    seeds = b.copy()
    for k in np.flatnonzero(n_b >= LONG_TEXT):
        chars, counts = np.unique(b[k, : n_b[k]], return_counts=True)
        seeds[k][np.isin(seeds[k], chars[counts > n_b[k] // POPULAR_SHARE + 1])] = -3
    common, pair = np.zeros(len(first), np.int64), np.arange(len(first))
    span = np.stack([np.zeros_like(n_a), n_a, np.zeros_like(n_b), n_b], axis=1)  # open stretches: from, to, from, to
    while len(pair):
        open_ = (span[:, 0] < span[:, 1]) & (span[:, 2] < span[:, 3])
        pair, span = pair[open_], span[open_]
        if not len(pair):
            break
        i, j, n = _longest(a[pair], b[pair], seeds[pair], span)
        np.add.at(common, pair, n)
        hit = n > 0
        pair, span, i, j, n = pair[hit], span[hit], i[hit], j[hit], n[hit]
        span = np.concatenate([np.stack([span[:, 0], i, span[:, 2], j], 1), np.stack([i + n, span[:, 1], j + n, span[:, 3]], 1)])
        pair = np.concatenate([pair, pair])
    total = n_a + n_b
    return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)


def _longest(a: np.ndarray, b: np.ndarray, seeds: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of the longest common block of each stretch."""
    a_from, a_to, b_from, b_to = span.T
    rows, width = np.arange(len(span)), int((b_to - b_from).max())
    place = b_from[:, None] + np.arange(width)
    inside = place < b_to[:, None]
    stretch = np.where(inside, np.take_along_axis(seeds, np.minimum(place, seeds.shape[1] - 1), axis=1), -4)
    best, i, j, run = np.zeros(len(span), np.int64), a_from.copy(), b_from.copy(), np.zeros((len(span), width), np.int32)
    for k in range(int((a_to - a_from).max())):
        at = a_from + k
        char = np.where(at < a_to, a[rows, np.minimum(at, a.shape[1] - 1)], -5)
        same = stretch == char[:, None]
        run[:, 1:] = np.where(same[:, 1:], run[:, :-1] + 1, 0)
        run[:, 0] = same[:, 0]
        end = run.argmax(axis=1)
        n = run[rows, end]
        more = n > best
        best[more], i[more], j[more] = n[more], (at - n + 1)[more], (b_from + end - n + 1)[more]
    while (back := (i > a_from) & (j > b_from) & (a[rows, i - 1] == b[rows, j - 1])).any():  # popular characters belong to it, too
        i, j, best = i - back, j - back, best + back
    while (on := (i + best < a_to) & (j + best < b_to) & (a[rows, np.minimum(i + best, a.shape[1] - 1)] == b[rows, np.minimum(j + best, b.shape[1] - 1)])).any():
        best = best + on
    return i, j, best
