"""Cutting and packing documents: edges, sound reductions, and places by brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sightline.llm import packing
from sightline.llm.queries import op11_packing
from tests.conftest import SF

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def least_bins(sizes: tuple[int, ...], capacity: int) -> int:
    """By trying every set for the largest piece."""

    @cache
    def least(rest: tuple[int, ...]) -> int:
        if not rest:
            return 0
        best = len(rest)
        first, others = rest[0], rest[1:]

        def choose(at: int, room: int, left: tuple[int, ...]) -> None:
            nonlocal best
            best = min(best, 1 + least(left + others[at:]))
            for k in range(at, len(others)):
                if others[k] <= room:
                    choose(k + 1, room - others[k], left + others[at:k])

        choose(0, capacity - first, ())
        return best

    return least(tuple(sorted(sizes, reverse=True)))


@pytest.mark.parametrize("seed", range(6))
def test_reduction_keeps_the_least_number_of_sequences(seed):
    rng = random.Random(seed)
    for _ in range(60):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(1 + capacity // rng.choice([3, 5, 9]), capacity) for _ in range(rng.randint(1, 9))]
        fixed, left = packing.reduce_lengths(dict(Counter(sizes)), capacity)
        kept = [s for s, n in left.items() for _ in range(n)]
        used = [s for p in fixed for s, n in p.fill for _ in range(n * p.bins)]
        assert sorted(used + kept) == sorted(sizes)
        assert all(sum(s * n for s, n in p.fill) <= capacity for p in fixed)
        assert sum(p.bins for p in fixed) + least_bins(tuple(kept), capacity) == least_bins(tuple(sizes), capacity)


def test_reduction_knows_sets_of_three():
    fixed, left = packing.reduce_lengths({50: 1, 25: 1, 24: 1}, 100)
    assert fixed == [packing.Pattern(1, ((50, 1), (25, 1), (24, 1)))] and not left


def plain_best_fit(sizes: list[int], capacity: int) -> Counter:
    rooms: list[list[int]] = []
    for size in sorted(sizes, reverse=True):
        fitting = [b for b in rooms if capacity - sum(b) >= size]
        best = min(fitting, key=lambda b: capacity - sum(b), default=None)
        if best is None:
            rooms.append([size])
        else:
            best.append(size)
    return Counter(sum(b) for b in rooms)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_is_that_of_one_piece_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 64, 100])
    sizes = [min(capacity, 1 + int(rng.expovariate(1 / rng.choice([3, 15, 40])))) for _ in range(300)]
    found = packing.best_fit(dict(Counter(sizes)), capacity)
    filled = Counter()
    for p in found:
        filled[sum(s * n for s, n in p.fill)] += p.bins
    assert sorted(s for p in found for s, n in p.fill for _ in range(n * p.bins)) == sorted(sizes)
    assert filled == plain_best_fit(sizes, capacity)


def test_plan_does_not_grow_with_the_pieces():
    rng = random.Random(5)
    shape = {s: rng.randint(1, 9) for s in range(1, 4097)}
    small, large = packing.plan_sequences(shape, 4096), packing.plan_sequences({s: n * 10**9 for s, n in shape.items()}, 4096)
    assert len(large) < 6 * 4096 and len(small) < 6 * 4096
    total = sum(s * n for s, n in shape.items()) * 10**9
    assert sum(p.bins for p in large) <= total / 4096 * 1.005


def checked(rows, capacity=4096):
    """Sequences are gapless from 0 and not too long; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in by.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_holds_the_library_ids(spark, library):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = op11_packing(spark, SF).collect()
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    n = 0
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            r, some = pieces[doc_id, k // 4096], ids[k : k + 4096]
            assert (r.start, r.length, r.ids_crc32) == (k, len(some), zlib.crc32(some.tobytes()))
            n += 1
    assert n == len(rows)
    assert checked(rows) <= -(-sum(r.length for r in rows) // 4096) + 1


ROWS = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (5, "word " * 30_000), (6, "<|endoftext|> A B"), (7, "one two " * 2048)]


def test_packing_edges(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ROWS], "doc_id long, text string, sequence_id string, offset int, _packing_size int")
    stats = {}
    placed = packing.pack_documents(docs, WORDS, stats=stats).cache()
    rows = placed.collect()
    assert checked(rows) == stats["sequences"] >= stats["least"] and stats["fixed"] >= 8
    whole = {}
    for r in sorted(rows, key=lambda r: r.piece):
        whole.setdefault(r.doc_id, []).append(np.frombuffer(r.token_ids, "<u4").tolist())
    for i, text in {i: t for i, t in ROWS if i != 3}.items():
        assert sum(whole[i], []) == [*library.encode(text or "", add_special_tokens=False).ids, 1]
    assert len(whole[3]) == 2 and whole[3][0] == whole[3][1]
    for r in packing.gather_sequences(placed).collect():
        ids = np.frombuffer(r.token_ids, "<u4")
        assert len(ids) == r.length == sum(p.length for p in rows if p.sequence_id == r.sequence_id)
        for p in rows:
            if p.sequence_id == r.sequence_id:
                assert ids[p.offset : p.offset + p.length].tobytes() == p.token_ids
    assert packing.pack_documents(docs.limit(0), WORDS).collect() == []


def test_pieces_of_one_length_are_in_many_tasks(spark):
    pieces = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") < 5000, 3).otherwise(F.col("id") % 50 + 1).alias("length"), F.lit("s").alias("sequence_id"))
    found = packing.place_pieces(pieces, 64, slice_rows=500)
    rows = found.collect()
    assert len(rows) == 6000 and checked(rows, 64) <= 1.01 * sum(r.length for r in rows) / 64
    per_task = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 3000
    for bad in (0, 65, None):
        with pytest.raises(ValueError, match="longer than a sequence"):
            packing.place_pieces(pieces.withColumn("length", F.lit(bad).cast("long")), 64)
