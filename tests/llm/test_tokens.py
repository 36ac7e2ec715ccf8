"""Fill-in-the-middle, byte-pair encoding and cross-tokenizer alignment against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import unicodedata

import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from glyphledger.llm import align_tokens, byte_bpe, fill_middle
from tests.llm.fixtures import SCHEMA, corpus

ODD = [(None, "no id at all"), (None, None), (900, "holds a <P> mark"), (901, "<S>"), (902, "<M"), (903, "\t\n lead and trail \r\n"), (904, "\x1c no blank \x85 either   thin"), (905, "🙂🙂 é ü 漢字 " * 50), (906, "word " * 250_000), (907, "x" * 1_500_000), (908, " " * 50_000), (909, "a\u0000b c"), (8, "same id, other text")]


def odd_rows():
    return [*corpus(), *[(i, t, "xx", None, None) for i, t in ODD]]


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fill(doc_id, text, seed=42, rate=50, spm_share=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, drawn = len(units), hexed(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_share:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("seed", "rate", "spm_share"), [(42, 50, 80), (7, 100, 0), (7, 100, 100), (1, 0, 50)])
def test_fill_in_middle(spark, seed, rate, spm_share):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("clash"), "OUTPUT": F.lit(1), "h1": F.lit(2)})
    made = fill_middle.fill_in_middle(docs, seed, rate, spm_share).repartition(3)
    got = [tuple(r) for r in made.collect()]
    want = [(i, t or "", *plain_fill(i, t, seed, rate, spm_share)) for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    back = fill_middle.digest(made).collect()
    assert sorted((str(r.doc_id), r.output_sha256, r.restored_sha256) for r in back) == sorted((str(w[0]), hexed(w[-1]), hexed(w[1])) for w in want)


def test_fill_in_middle_of_nothing(spark):
    made = fill_middle.digest(fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert made.count() == 0


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    """The tokenizer library on the same rank file."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(open(RANKS, "rb").read())


def test_byte_bpe(spark, library):
    rows = [*odd_rows(), (920, "<|endoftext|> isn't special, we'll see it's 1234567 ...  \n\n x"), (921, "ab" * 300_000), (922, "aaaaaaaab" * 20_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumns({"ids": F.lit("clash"), "Decoded": F.lit(1)})
    got = byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).repartition(3), RANKS)).collect()
    want = []
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hexed(",".join(map(str, ids))), hexed(text or "")))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_byte_bpe_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)).count() == 0
    none = byte_bpe.decode(spark.sql("SELECT 1L AS doc_id, CAST(NULL AS array<int>) AS ids"), RANKS).collect()
    assert [tuple(r) for r in none] == [(1, [], bytearray())]


def test_pieces_of_every_character(library, vocabulary):
    """Both libraries put every assigned character in the same class, beside letters, digits, marks and blanks."""
    pattern, pieces = regex.compile(public_tokenizers.PATTERN), byte_bpe.Pieces(vocabulary.encode)
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    for start in range(0, len(chars), 5000):
        text = "".join(f"a{c}b 1{c}2 .{c}; {c} {c}\n" for c in chars[start : start + 5000])
        assert byte_bpe.np.frombuffer(byte_bpe.split_ids([text], pattern, pieces)[0], "i4").tolist() == library.encode_ordinary(text), hex(ord(chars[start]))


def test_merges_of_random_pieces(library, vocabulary):
    rng, pieces = random.Random(5), ["", "a", "aa"]
    for _ in range(3000):
        letters = rng.choice(["ab", "aeiou", "therain", "0123456789", "éüß漢字", "-=#", "thesandoring"])
        pieces.append("".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 7, 30, 200]))))
    for some in (pieces[3:], *([p] for p in pieces[3:200])):
        for piece, ids in zip(some, vocabulary.encode(some), strict=True):
            assert byte_bpe.np.frombuffer(ids, "i4").tolist() == library._encode_single_piece(piece), piece
    assert vocabulary.encode([]) == [] and vocabulary.queue.buckets == {}


def test_a_lower_rank_that_comes_late(library):
    """Ranks in any order, as no training would give them: a merge may make a pair that comes before what is being merged."""
    rng = random.Random(7)
    for _ in range(200):
        tokens = [bytes([b]) for b in range(256)] + sorted({"".join(rng.choice("ab") for _ in range(rng.randint(2, 5))).encode() for _ in range(12)})
        ranks = dict(zip(tokens, [*range(256), *rng.sample(range(256, 400), len(tokens) - 256)], strict=True))
        plain = tiktoken.Encoding("odd", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        mine = byte_bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(2, 40))) for _ in range(30)]
        for piece, ids in zip(pieces, mine.encode(pieces), strict=True):
            assert byte_bpe.np.frombuffer(ids, "i4").tolist() == plain.encode_ordinary(piece)


def test_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    asked = []
    pieces = byte_bpe.Pieces(lambda new: asked.extend(new) or [p.encode() for p in new])
    rng = random.Random(9)
    for _ in range(50):
        texts = [[rng.choice("abcdefghijkl") * rng.choice([1, 1, 60]) for _ in range(4)] for _ in range(3)]
        assert pieces.join(texts) == ["".join(t).encode() for t in texts]
        assert len(pieces.known) <= 5 + 12 and all(len(p) == 1 for p in pieces.known)
    assert 12 < len([a for a in asked if len(a) == 1]) < 300


def test_rank_queue():
    rng = random.Random(6)
    for n_ranks in (1, 64, 65, 5000, 300_000):
        queue, held = byte_bpe.RankQueue(n_ranks), {}
        assert queue.take() == (-1, [])
        start = [rng.randrange(-1, n_ranks) for _ in range(200)]
        queue.fill(byte_bpe.np.array(start))
        for i, rank in enumerate(start):
            if rank >= 0:
                held.setdefault(rank, []).append(i)
        for _ in range(2000):
            if rng.random() < 0.6:
                rank, at = rng.randrange(n_ranks), rng.randrange(1000)
                queue.push(rank, at)
                held.setdefault(rank, []).append(at)
            elif held:
                assert queue.take() == (min(held), sorted(held.pop(min(held))))
        while held:
            assert queue.take() == (min(held), sorted(held.pop(min(held))))
        assert queue.take() == (-1, []) and not any(map(any, queue.levels))


A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts):
    """The rows of digest() without ids, by comparing all tokens of a text; token bytes from the files themselves."""
    a_kind = tokenizers.Tokenizer.from_file(A_FILE)
    a_kind.encode_special_tokens = True
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    b_kind = sentencepiece.SentencePieceProcessor(model_file=B_FILE)

    def b_bytes(i):
        piece = b_kind.id_to_piece(i)
        return bytes.fromhex(piece[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("\u2581", " ").encode()

    def intervals(ids, spell):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(spell(i))))
            at = out[-1][2]
        return out, b"".join(map(spell, ids))

    rows, docs_of = [], {}
    for k, text in enumerate(texts):
        a, b, links, parts = [], [], [], []
        if text:
            a, a_spelled = intervals(a_kind.encode(" " + text, add_special_tokens=False).ids, ranks.__getitem__)
            b, b_spelled = intervals(b_kind.encode(text), b_bytes)
            if a_spelled != (" " + text).encode() or b_spelled != (" " + text).encode():
                a = b = []
            low = 0
            for x, start, stop in a:  # B tokens that end before this A token starts are passed
                while b[low][2] <= start:
                    low += 1
                j = low
                while j < len(b) and b[j][1] < stop:
                    links.append((x, b[j][0]))
                    j += 1
            cuts = sorted({s for *_, s in a} & {s for *_, s in b})
            for side in (a, b):
                at, mine = 0, []
                for cut in cuts:
                    here = []
                    while at < len(side) and side[at][2] <= cut:
                        here.append(str(side[at][0]))
                        at += 1
                    mine.append(",".join(here))
                parts.append(mine)
        for pair in set(links):
            docs_of.setdefault(pair, set()).add(k)
        groups = ";".join("|".join(pair) for pair in zip(*parts, strict=True)) if a else ""
        rows.append((len(a), len(b), groups.count(";") + 1 if groups else 0, links, groups))
    best = {}
    for (x, _), ks in [(pair, docs) for pair, docs in docs_of.items()]:
        best[x] = max(best.get(x, 0), len(ks))
    return [(n_a, n_b, n_groups, len(links), sum(len(docs_of[p]) == best[p[0]] for p in links), sum(len(docs_of[p]) for p in links), hexed(groups) if groups else "") for n_a, n_b, n_groups, links, groups in rows]


ALIGNED = [(930, "<|endoftext|> <s>\u2581 </s> <0x41>"), (931, "a\u2581b"), (932, "  two  blanks "), (933, "ｆｕｌｌ width ﬁ"), (934, "naïve café 🙂 漢字 \n\t x"), (935, "<s> </s> <unk> <0x41> <|endoftext|>"), (936, "plain words again"), (937, "plain words again")]


@pytest.mark.parametrize("max_broadcast", [1 << 20, 0])
def test_align_tokens(spark, max_broadcast):
    rows = [*odd_rows(), *[(i, t, None, None, None) for i, t in ALIGNED]]
    rows = [r for r in rows if len(r[1] or "") < 1_400_000]
    docs = spark.createDataFrame([(*r[:2], "clash", 1, "x") for r in rows], "doc_id long, text string, links string, Row int, a string").repartition(5)
    got = align_tokens.digest(docs, A_FILE, B_FILE, max_broadcast).collect()
    want = [(r[0], *w) for r, w in zip(rows, plain_alignment([r[1] for r in rows]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_align_tokens_of_nothing(spark):
    assert align_tokens.digest(spark.createDataFrame([], SCHEMA), A_FILE, B_FILE).count() == 0
    blank = align_tokens.digest(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), A_FILE, B_FILE).collect()
    assert sorted(map(tuple, blank), key=repr) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_tokens_of_pieces_are_those_of_texts():
    """Encoding a text's pieces one by one gives what the tokenizer gives for the whole text, for every character."""
    kind = align_tokens.ByteLevel(open(A_FILE, "rb").read())
    assert kind.by_piece
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    texts = ["".join(f"a{c}b 1{c}2 .{c}; {c} {c}\n" for c in chars[i : i + 5000]) for i in range(0, len(chars), 5000)]
    for text, ids in zip(texts, kind.encode(texts), strict=True):
        assert ids.tolist() == byte_bpe.np.frombuffer(kind.whole([" " + text])[0], "i4").tolist()


def test_pieces_of_words_are_those_of_texts():
    kind = align_tokens.PieceModel(open(B_FILE, "rb").read())
    assert kind.by_word
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    texts = ["".join(f"a{c}b 1{c}2 .{c}; {c}. .{c}\n{c} " for c in chars[i : i + 2000]) for i in range(0, len(chars), 2000)]
    texts = [t.rstrip(" ") for t in texts] + ["", " ", "a", " a", "a ", "a  b", "a b c", "\u2581a b", "a\u2581 b", "a \u2581b", *[r[1] or "" for r in corpus()]]
    assert sum("  " not in f" {t} " for t in texts) > 40
    for text, ids in zip(texts, kind.encode(texts), strict=True):
        assert ids.tolist() == kind.model.encode(text), text[:50]


@pytest.mark.parametrize("kind,name", [(align_tokens.ByteLevel, "byte_bpe_50k.json"), (align_tokens.PieceModel, "piece_bpe_32k.model")])
def test_new_pieces_in_runs(monkeypatch, kind, name):
    """Words that come for the first time are few texts to the tokenizer, and each has the ids that it has alone."""
    made = kind(byte_bpe.file_bytes(public_tokenizers.path(name)))
    odd = ["a▁b", "▁", "<s>", "</s>", "<0x41>", "'s", "x's", "́", "١٢٣", "漢字仮名", "ée", "﻿x", "\x00", "a\xa0b", "…", "🙂🙂", "--", "1a2b3c", "a" * 3000]
    words = odd + ["w" + str(i * 7919 % 10007).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(3000)] + odd[::-1]
    alone = [byte_bpe.np.frombuffer(x, "i4").tolist() for x in made.whole(words if kind is align_tokens.PieceModel else [f" {w}" for w in words])]
    asked, whole = [], made.whole
    monkeypatch.setattr(made, "whole", lambda texts: asked.extend(texts) or whole(texts))
    got = made.encode([" ".join(words)])[0].tolist()
    assert got == [i for ids in alone for i in ids]
    assert len(asked) < len(words) // 4
