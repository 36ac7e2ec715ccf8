"""What the operators compute, in plain Python over all rows, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex

from glyphledger.llm import toxicity

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def low_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def near_classes(texts, least=0.8):
    """The number of the first text of each text's class, by weighted Jaccard similarity of five-word shingles."""
    shingles = []
    for text in texts:
        w = low_words(text)
        shingles.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter({("", text): 1}))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            both = (shingles[a] & shingles[b]).total()
            if both / (shingles[a].total() + shingles[b].total() - both) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def repeats(texts, length):
    """(bytes, bytes removed, runs removed, bytes that remain) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    return out


def leaks(texts, items):
    """(words, words hit, items found, hash of their ids) of each text, for items (item_id, text)."""
    windows = defaultdict(set)
    for i, t in items:
        w = low_words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    out = []
    for text in texts:
        w, hit, found = low_words(text), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                got = windows.get(tuple(w[k : k + n]))
                if got and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def mix_targets(sized):
    """(words of each source, target of each source) for (source, words)."""
    size = Counter()
    for source, n in sized:
        size[source] += n
    order = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * size.total(), set()
    while True:
        free = sum(weight[s] for s in size if s not in capped)
        level = (total - sum(2 * size[s] for s in capped)) / free if free else 0
        more = {s for s in size if s not in capped and weight[s] * level > 2 * size[s]}
        if not more:
            return size, {s: 2 * size[s] if s in capped else weight[s] * level for s in size}
        capped |= more


def folded(text):
    """Letter by letter, for texts whose disguises are those of the operator's tables."""
    alike = dict(toxicity.HOMOGLYPHS) | dict(toxicity.DIGITS) | {x: base for base, marked in toxicity.ACCENTED.items() for x in marked}
    low = "".join(alike.get(ch, chr(ord(ch) - 0xFF41 + 97) if 0xFF41 <= ord(ch) <= 0xFF5A else ch) for ch in (text or "").lower())
    for sign, letter in toxicity.SIGNS.items():
        low = re.sub(sign, letter, low)
    return f" {regex.sub(r'[^\p{L}\p{N}]+', ' ', low).strip(' ')} "


def toxicity_score(text, model, exceptions=toxicity.EXCEPTIONS):
    """Every term tried at every place of the text."""
    flat = folded(text)
    spared = [range(i, i + len(phrase) + 2) for phrase in exceptions for i in range(len(flat)) if flat.startswith(f" {phrase} ", i)]
    raw = 0.0
    for i in range(len(flat)):
        here = [weight for term, weight in model["terms"].items() if flat.startswith(term, i)]
        # a phrase takes the terms that begin in it, but for its closing blank
        if here and not any(i in span[:-1] for span in spared):
            raw += max(here)
    raw /= 1 + math.log1p(flat.count(" ") / 400)
    return 1 / (1 + math.exp(-(math.log(model["prior"] / (1 - model["prior"])) + model["bias"] + model["gain"] * raw)))


def term_counts(labelled):
    """{term: (toxic texts, clean texts)} for (text, toxic)."""
    counts = defaultdict(lambda: [0, 0])
    for text, toxic in labelled:
        terms = set()
        for w in folded(text).split():
            if len(w) >= 3:
                terms.add(f" {w} ")
            terms |= {f" {w[:k]}" for k in range(toxicity.PREFIX[0], toxicity.PREFIX[1] + 1) if len(w) >= k}
        for term in terms:
            counts[term][1 - toxic] += 1
    return {term: tuple(n) for term, n in counts.items()}


def common_length(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]
