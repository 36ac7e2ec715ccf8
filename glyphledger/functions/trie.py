"""A trie of keys, searched for all keys within an edit distance of many texts at once.

The trie is kept level by level as numpy arrays, made from the sorted keys. A search goes down one level at a time with all pairs of
a text and a node. Texts of up to 63 characters have a word of bits for each number of edits, which says what beginnings of the
text are as near to the node; longer ones a row of the Levenshtein table. Nodes that no beginning is near to are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of a text and a node that a step may make, so that a search takes bounded memory; words of bits in a step, which stay in cache.
MAX_PAIRS, STEP = 1 << 19, 1 << 16

_Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class Trie:
    """Distinct keys; `order[i]` is the place of the i-th sorted key in what was given."""

    def __init__(self, keys: list[str]) -> None:
        length = np.array([len(k) for k in keys], np.int64)
        width = int(length.max(initial=0))
        codes = np.zeros((len(keys), width + 1), np.uint32)  # zeros stand for ends, which sort first
        codes[np.arange(width + 1) < length[:, None]] = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
        self.order = np.lexsort(codes.T[::-1])
        codes, length = codes[self.order], length[self.order]
        self.n_keys, self.levels = len(keys), []
        fresh = np.zeros(len(keys), bool)  # rows whose prefix differs from that of the row before
        fresh[:1] = True
        first = np.flatnonzero(fresh)  # of each node of a level: the first key below it
        for depth in range(width + 1):
            ends = length[first] == depth
            fresh[1:] |= codes[1:, depth] != codes[:-1, depth]
            below = np.flatnonzero(fresh & (length > depth))
            bounds = np.append(first, len(keys))
            self.levels.append({"key": np.where(ends, first, -1), "from": np.searchsorted(below, bounds[:-1]), "to": np.searchsorted(below, bounds[1:]), "char": codes[below, depth]})
            first = below
        self.widest = max((len(level["key"]) for level in self.levels), default=1)
        self.letters = np.unique(np.concatenate([np.unique(level["char"]) for level in self.levels])) if self.levels else np.zeros(0, np.uint32)
        for level in self.levels:
            level["letter"] = np.searchsorted(self.letters, level["char"])

    def within(self, texts: list[str], radius: np.ndarray, prefixes: bool = False) -> _Found:
        """(text, key, distance) of all keys within each text's radius; keys by their place in what was given.

        With prefixes, the distance is the least one between any beginning of the text and the key.
        """
        found = []
        length = np.array([len(t) for t in texts], np.int64)
        for n, reach in np.unique(np.stack([length, radius]), axis=1).T.tolist() if self.n_keys and len(texts) else ():
            same = np.flatnonzero((length == n) & (radius == reach))
            search, size = (self._by_bits, max(n + 1, len(self.letters))) if n < 64 else (self._by_rows, max(n + 1, self.widest))
            step = max(1, MAX_PAIRS // size)
            for i in range(0, len(same), step):
                some = same[i : i + step]
                codes = np.frombuffer("".join(texts[k] for k in some).encode("utf-32-le"), np.uint32).reshape(len(some), n)
                found += [(some[q], key, d) for q, key, d in search(codes, reach, prefixes)]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        text, key, d = map(np.concatenate, zip(*found, strict=True))
        return text, self.order[key], d

    def _below(self, depth: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes: whose they are, and their places in the next level."""
        level = self.levels[depth]
        start, count = level["from"][node], level["to"][node] - level["from"][node]
        up = np.repeat(np.arange(len(node)), count)
        return up, np.arange(len(up)) + np.repeat(start - np.cumsum(count) + count, count)

    def _by_bits(self, codes: np.ndarray, reach: int, prefixes: bool) -> Iterator[_Found]:
        """Bit p of the j-th word of a pair is set where the first p characters of the text are within j edits of the node."""
        n_texts, n = codes.shape
        one, last = np.uint64(1), np.uint64(n)
        whole = ~np.uint64(0) >> np.uint64(63 - n)
        equal = np.zeros((n_texts, len(self.letters)), np.uint64)  # where in a text a letter is
        letter = np.minimum(np.searchsorted(self.letters, codes), max(0, len(self.letters) - 1))
        for p in range(n if len(self.letters) else 0):
            row = np.flatnonzero(self.letters[letter[:, p]] == codes[:, p])
            equal[row, letter[row, p]] |= one << np.uint64(p + 1)
        equal, n_letters = equal.ravel(), len(self.letters)

        def hits(depth: int, text: np.ndarray, node: np.ndarray, words: list[np.ndarray]) -> Iterator[_Found]:
            key = self.levels[depth]["key"][node]
            at = np.flatnonzero(key >= 0)
            d = np.zeros(len(at), np.int64)
            for word in words:
                d += word[at] == 0 if prefixes else (word[at] >> last) & one == 0
            at, d = at[d <= reach], d[d <= reach]
            if len(at):
                yield text[at], key[at], d

        words = [np.full(n_texts, (1 << min(j, n) + 1) - 1, np.uint64) for j in range(reach + 1)]
        todo = [(0, np.arange(n_texts), np.zeros(n_texts, np.int64), words)]
        yield from hits(*todo[0])
        while todo:
            depth, text, node, words = todo.pop()
            level = self.levels[depth]
            if len(node) > 1 and (level["to"][node] - level["from"][node]).sum() * (reach + 1) > STEP:
                half = len(node) // 2
                todo += [(depth, text[some], node[some], [word[some] for word in words]) for some in (slice(half), slice(half, None))]
                continue
            up, node = self._below(depth, node)
            same = equal[text[up] * n_letters + level["letter"][node]]
            # where all edits are used up only an equal character goes on
            on = (words[-1][up] << one) & same != 0
            if reach:
                on |= words[-2][up] != 0
            on = np.flatnonzero(on)
            if not len(on):
                continue
            up, node, same = up[on], node[on], same[on]
            new: list[np.ndarray] = []
            for word in (word[up] for word in words):
                made = (word << one) & same
                if new:  # a character more in the node, another character, a character more in the text
                    made |= before | (before << one) | (new[-1] << one)
                new.append(made & whole)
                before = word
            text = text[up]
            yield from hits(depth + 1, text, node, new)
            todo.append((depth + 1, text, node, new))

    def _by_rows(self, codes: np.ndarray, reach: int, prefixes: bool) -> Iterator[_Found]:
        n = codes.shape[1]
        steps = np.arange(n + 1, dtype=np.int32)
        text, node, row = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.tile(steps, (len(codes), 1))
        for depth, level in enumerate(self.levels):
            if not len(text):
                return
            key, d = level["key"][node], row.min(axis=1) if prefixes else row[:, n]
            hit = np.flatnonzero((key >= 0) & (d <= reach))
            if len(hit):
                yield text[hit], key[hit], d[hit].astype(np.int64)
            up, node = self._below(depth, node)
            text, above = text[up], row[up]
            new = np.empty_like(above)
            new[:, 0] = above[:, 0] + 1
            np.minimum(above[:, :-1] + (codes[text] != level["char"][node][:, None]), above[:, 1:] + 1, out=new[:, 1:])
            row = np.minimum.accumulate(new - steps, axis=1) + steps  # a character more in the text
            kept = row.min(axis=1) <= reach
            text, node, row = text[kept], node[kept], row[kept]


def nearest(trie: Trie, texts: list[str], radius: np.ndarray, rank: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each text the nearest key within its radius (-1: none), ties to the least rank of keys; the distance; keys compared.

    The distance rises by one: most texts are settled among the few keys close to them. It begins at `least`, for texts that
    are known to have no nearer key.
    """
    best, far = np.full(len(texts), -1), np.zeros(len(texts), np.int64)
    open_, reach, compared = np.arange(len(texts)), least, 0
    while len(open_):
        text, key, d = trie.within([texts[i] for i in open_], np.minimum(radius[open_], reach))
        compared += len(key)
        order = np.lexsort((rank[key], d, text))
        first = order[np.unique(text[order], return_index=True)[1]]
        best[open_[text[first]]], far[open_[text[first]]] = key[first], d[first]
        open_ = open_[(best[open_] < 0) & (radius[open_] > reach)]
        reach += 1
    return best, far, compared
