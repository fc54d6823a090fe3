"""Token alignment against whole-text encoding and links by brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from sightline.llm import alignment
from sightline.llm.queries import op12_alignment
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return a, b


def plain(libraries, text):
    """Ids of A and B and the byte ranges of their tokens, from whole texts; None without tokens."""
    a, b = libraries
    if not text:
        return None
    alphabet = alignment.byte_level_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    told_a = [bytes(alphabet[c] for c in a.id_to_token(n)) for n in ids_a]
    told_b = [alignment.piece_bytes(b.id_to_piece(n)) for n in ids_b]
    if b"".join(told_a) != (" " + text).encode() or b"".join(told_b) != (" " + text).encode():
        return None
    ends = []
    for told in (told_a, told_b):
        at, some = 0, []
        for x in told:
            at += len(x)
            some.append(at)
        ends.append(some)
    return ids_a, ids_b, *ends


def brute_force(libraries, rows):
    found, links = [], Counter()
    for i, text in rows:
        got = plain(libraries, text)
        own = [] if got is None else [(x, y) for x, e in zip(got[0], got[2], strict=True) for y, f in zip(got[1], got[3], strict=True) if e == f]
        links.update(own)
        found.append((i, got, own))
    most = {}
    for (_, y), n in links.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for i, got, own in found:
        if got is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        shown, at_a, at_b = [], 0, 0
        for end in sorted(set(got[2]) & set(got[3])):
            to_a, to_b = got[2].index(end) + 1, got[3].index(end) + 1
            shown.append(",".join(map(str, got[0][at_a:to_a])) + "|" + ",".join(map(str, got[1][at_b:to_b])))
            at_a, at_b = to_a, to_b
        out.append((i, len(got[0]), len(got[1]), len(shown), len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), ";".join(shown)))
    return out


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n and lines \t"), (5, "▁ literal"), (6, "<|endoftext|> <s> </s> <0x41> <unk>"), (7, "don't we'll I'm"), (7, "don't we'll I'm"), (None, "ünï 世界 \U0001f600 ①ﬁ"),
    (9, "x" * 30_000), (10, "a b  c　 d​ e᠎ f﻿ g"), (11, "12345 3.14 (x) [y]"), (12, "نص عربي हिन्दी"), (13, "trailing "), (14, "\nleading"), (15, "é combining ́x"), (16, "\x00 \x1c \x85 q"),
]


def test_alignment_edges(spark, libraries):
    rows = [(i, t, 1, "k", "g") for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, key string, groups string")
    tables = {}
    found = [tuple(r) for r in alignment.align_tokenizers(docs, A, B, dictionary=tables).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(found, key=key) == sorted(brute_force(libraries, ROWS), key=key)
    assert sum(r.n for r in tables["groups"].collect()) == sum(r[3] for r in found) == sum(r["count"] for r in tables["pairs"].collect())
    assert alignment.align_tokenizers(docs.limit(0), A, B).collect() == []
    nulls = alignment.align_tokenizers(spark.createDataFrame([(1, None)], "doc_id int, text string"), A, B).collect()
    assert [tuple(r) for r in nulls] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("words, chunk", [(300_000, 16_000_000), (50, 3_000)])
def test_query_equals_brute_force(spark, libraries, monkeypatch, words, chunk):
    monkeypatch.setattr(alignment, "WORDS", words)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", chunk)
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in op12_alignment(spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    expected = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in brute_force(libraries, texts)]
    assert found == sorted(expected)


def test_words_are_encoded_as_in_whole_texts(libraries, monkeypatch):
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        own = alignment.Aligner(f.read(), g.read())
    assert own.cuts
    rng = random.Random(3)
    bits = ["a", "Word", "don't", " ", "  ", "\n", "\t", " ", " ", "​", "᠎", "é", "é", "世", "\U0001f600", "9", "1234", "...", "▁", "<s>", "_", "ß", "\x1c", " ", " the", "'s", "-", "ﬁ"]
    for _ in range(4000):
        if not rng.randrange(50):
            monkeypatch.setattr(alignment, "WORDS", 100)
            monkeypatch.setattr(alignment, "GROUPS", rng.choice([60, 10_000]))
            own.shrink()
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        shown, found = own.align(text)
        n_a, n_b, n_groups, _ = alignment._Chunk(own).add(found)
        want = brute_force(libraries, [(0, text)])[0]
        assert (n_a, n_b, n_groups, shown) == (want[1], want[2], want[3], want[7]), repr(text)
