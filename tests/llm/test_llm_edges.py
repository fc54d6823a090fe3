"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sightline.llm import bpe, exact_dedup, mixing, near_dedup, pii, quality, token_files, topk, toxicity, warc

DOCS = "doc_id long, text string, source string, _id long, keep_id string, id int, n int, rep string, score string, spans string, _text string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows):
    """Rows (doc_id, text[, source]) in a table with many clashing columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, 7, "x", 1, 2, "r", "s", "p", "t") for r in rows]
    return spark.createDataFrame(full, DOCS)


LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f"), (5, "a  b c d e f"), (6, "A B c d e f"), (None, "a b c d e f"), (8, LONG), (9, LONG + " end"), (10, "ümläut \U0001f600 text one two"), (10, "ümläut \U0001f600 text one two")]


@pytest.mark.parametrize("digest", [True, False])
def test_exact_dedup(spark, digest):
    rows = exact_dedup.exact_dedup(docs(spark, ROWS), digest_all=digest).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept) for r in rows)
    assert found == [(-1, 5, 3, False), (1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 5, 3, False), (5, 5, 3, True), (6, 6, 1, True), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 2, True), (10, 10, 2, True)]
    assert exact_dedup.exact_dedup(docs(spark, []), digest_all=digest).collect() == []


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_exact_dedup_with_a_full_filter(spark, bits):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    found = exact_dedup.exact_dedup(docs(spark, rows), filter_bits=bits, prefix_chars=2)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found.collect()) == [(i, i % 40, 5) for i in range(200)]


def test_mixing(spark):
    rows = [*[(i, "w " * (i % 50 + 1), "a") for i in range(400)], *[(1000 + i, "w " * (i % 9), "b") for i in range(300)], *[(2000 + i, "v " * 20, None) for i in range(200)], (None, None, "a"), (5000, "", "empty")]
    found = mixing.mix_sources(docs(spark, rows)).collect()
    again = mixing.mix_sources(docs(spark, rows)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    total = sum(r.size for r in found)
    targets = {r.source: (r.target, r.source_size) for r in found}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    for source, (target, size) in targets.items():
        taken = sum(r.taken for r in found if r.source == source)
        assert target <= 2 * size and abs(taken - target) <= 50 + 0.01 * size
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in found)
    # weights 3, 1, 2, 3 by name with null last: a and b are short of their shares
    assert targets["a"][0] / targets["a"][1] >= targets["b"][0] / targets["b"][1] or targets["b"][0] == 2 * targets["b"][1]
    assert mixing.mix_sources(docs(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix_sources(docs(spark, [(1, "", "a"), (2, None, "b")])).collect()] == [0, 0]


def test_mixing_of_a_very_long_text_and_repeated_rows(spark):
    rows = [(1, "w " * 400_000, "a"), *[(10 + i, "x y", "a") for i in range(300)], *[(7, "same words", "b")] * 40, (8, "x" * 3_000_000, "c")]
    found = mixing.mix_sources(docs(spark, rows), keep=("text",)).collect()
    assert len(found) == len(rows) and sum(r.size for r in found) == 400_000 + 600 + 80 + 1
    assert all(r.taken <= 2 * r.size and r.size == len(r.text.split()) for r in found)
    assert {r.source_size for r in found if r.source == "b"} == {80}
    taken = {s: sum(r.taken for r in found if r.source == s) for s in "abc"}
    assert abs(taken["b"] - next(r.target for r in found if r.source == "b")) <= 2 and taken["c"] <= 2


def test_near_duplicates(spark):
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, ROWS)).collect()}
    assert found == {(1, 0): (1, True), (2, 0): (2, True), (3, 0): (3, True), (4, 2): (4, True), (5, 2): (4, False), (6, 2): (4, False), (None, 2): (None, True), (8, 59996): (8, True), (9, 59997): (8, False), (10, 1): (10, True)}
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []
    assert near_dedup.near_duplicates(docs(spark, [(1, "one two")])).first().kept


def test_near_duplicates_of_one_id(spark):
    """An id that speaks for several classes: they stay apart."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, c), (3, a + " end"), (5, b), (7, b), (5, b), (2, c.replace("c30", "z"))]
    found = near_dedup.near_duplicates(docs(spark, rows).withColumn("text_copy", F.col("text")), keep=("text_copy",)).collect()
    assert sorted((r.doc_id, r.text_copy[0], r.component_id, r.kept) for r in found) == [(2, "c", 2, True), (3, "a", 3, True), (5, "a", 3, False), (5, "b", 5, True), (5, "b", 5, True), (5, "c", 2, False), (7, "b", 5, False)]
    assert len({r.group for r in found}) == 3 and len({(r.group, r.text_copy[0]) for r in found}) == 3


@pytest.mark.parametrize("block", [2, 512])
def test_links_within_blocks(spark, block, monkeypatch):
    """Buckets that are cut into many blocks hold the same links."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    test_links_within_a_crowd(spark)


def test_links_within_a_crowd(spark):
    """Many variants of one text, most of them not similar enough to each other, with some chains."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(120):
        words = base[:]
        for i in rng.sample(range(60), rng.choice([1, 3, 6])):
            words[i] = f"x{d}_{i}"
        rows.append((d, " ".join(words)))
    sets = {d: set(zip(t.split(), t.split()[1:], strict=False)) for d, t in rows}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = near_dedup.near_duplicates(docs(spark, rows), shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: find(d) for d in sets}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8):
        gaps = []
        for n in (15, 150, 600):
            for _ in range(20):
                all_ = rng.integers(0, 2**63, n).astype(np.uint64)
                both = int(n * share)
                half = (n - both) // 2
                a, b = all_[: both + half], np.concatenate((all_[:both], all_[both + half :]))
                gaps.append((near_dedup.super_minhash(a) == near_dedup.super_minhash(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < (share * (1 - share) / near_dedup.SLOTS) ** 0.5


def test_bpe(spark):
    text = ["", "a" * 20_000, "hello  world\n\n 's x", "\U0001f600é", LONG]
    rows = [(i, t) for i, t in enumerate(text)] + [(9, None), (None, "x"), (None, "x")]
    encoded = bpe.bpe_encode(docs(spark, rows), RANKS, public_tokenizers.PATTERN)
    found = bpe.bpe_decode(encoded, RANKS).collect()
    assert sorted(bytes(r.decoded).decode() for r in found) == sorted(t or "" for _, t in rows)
    assert all(len(r.token_ids) == 4 * r.n_tokens for r in found)
    assert bpe.bpe_encode(docs(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []
    with pytest.raises(Exception, match="KeyError"):
        bpe.bpe_decode(spark.createDataFrame([(bytearray(b"\xff\xff\xff\x7f"),)], "token_ids binary"), RANKS).collect()


def test_rank_queue_takes_the_least_rank_leftmost():
    rng = random.Random(2)
    queue = bpe.RankQueue(5000)
    held = []
    for _ in range(3000):
        if held and rng.random() < 0.4:
            assert queue.pop() == min(held)
            held.remove(min(held))
        else:
            entry = (rng.randrange(5000), rng.randrange(50))
            held.append(entry)
            queue.push(*entry)
    while held:
        assert queue.pop() == min(held)
        held.remove(min(held))
    assert not queue.top


@pytest.mark.parametrize(("seq_len", "rows"), [(4, 2), (1024, 256)])
def test_token_files(spark, seq_len, rows):
    data = [(3, "three words here"), (1, ""), (2, None), (None, "first of all"), (None, "first of all"), (5, LONG), (4, "Ünïcode ² 中 x́ <|endoftext|>"), (4, "again"), (6, "a<|endoftext|>b"), (7, "<|STARTOFTEXT|> |> <|"), (8, "x" * 50_000 + "<|startoftext|>")]
    index = token_files.write_sequences(docs(spark, data), WORDS, seq_len=seq_len, batch_rows=rows)
    found = sorted(token_files.read_sequences(index).collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    ids = [(doc, np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for doc, text in data]
    assert (6, np.array([320, 49407, 321, 2], "<u4").tobytes()) in ids
    assert sorted(((r.doc_id is not None, r.doc_id or 0, bytes(r.token_ids)) for r in found)) == sorted((d is not None, d or 0, x) for d, x in ids)
    order = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert order == sorted(order) and all(4 * r.n_tokens == len(r.token_ids) for r in found)
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:k]) for k in range(len(found))]
    assert token_files.read_sequences(token_files.write_sequences(docs(spark, []), WORDS)).collect() == []


def test_an_id_that_many_rows_repeat_is_in_several_files(spark):
    rows = [(7, f"text number {i % 20}") for i in range(400)]
    index = token_files.write_sequences(docs(spark, rows), WORDS)
    assert len({r.file for r in index.collect()}) > 1 and token_files.read_sequences(index).count() == 400


def test_a_sequence_is_read_alone_and_without_copies(spark):
    import pyarrow as pa

    rows = [(k, f"word number {k} and {k * 7} more") for k in range(200)]
    index = token_files.write_sequences(docs(spark, rows), WORDS, seq_len=8, batch_rows=4)
    whole = {r.doc_id: np.frombuffer(r.token_ids, "<u4").tolist() for r in token_files.read_sequences(index).collect()}
    file = index.groupBy("part", "file").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("n_tokens").alias("n")).orderBy("part").first()
    ids = [x for k in range(file.a, file.b + 1) for x in whole[k]]
    reader = token_files.open_sequences(file.file)
    before = pa.total_allocated_bytes()
    for number in (0, 5, len(ids) // 8 - 1, len(ids) // 8):
        found, mask = token_files.sequence_at(reader, number)
        n = min(8, len(ids) - 8 * number)
        assert found[:n].tolist() == ids[8 * number : 8 * number + n] and mask.true_count == n
        assert not found.flags.owndata and not found.flags.writeable
    assert pa.total_allocated_bytes() - before < 4096  # the ids stayed in the file


def test_sequence_files_have_equal_batches(spark):
    import pyarrow as pa

    index = token_files.write_sequences(docs(spark, [(i, "some words " * i) for i in range(50)]), WORDS, seq_len=8, batch_rows=4)
    for file in {r.file for r in index.collect()}:
        reader = pa.ipc.open_file(pa.memory_map(file.removeprefix("file://")))
        assert reader.schema.field("token_ids").type == pa.list_(pa.uint16(), 8)
        sizes = [reader.get_batch(i).num_rows for i in range(reader.num_record_batches)]
        assert all(s == 4 for s in sizes[:-1])


PAGES = "page_id long, url string, html string, file string, offset long, digest string, _payload int"


def test_warc(spark):
    big = "x" * 1500 + "é"
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", "y" * 999), (4, "u", "y" * 999), (5, "u", None), (6, "u", ""), (7, "u", "z\r\n\r\nWARC/1.1\r\n" * 90), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "f", 1, "d", 0) for r in rows], PAGES)
    index = warc.write_warc(warc.plan_records(pages))
    found = {r.page: r for r in warc.read_warc(index).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in found.items()} == {
        "1": ("revisit", "2", 1502), "2": ("response", None, 1502), "3": ("response", None, 999), "4": ("response", None, 999), "5": ("response", None, 0), "6": ("response", None, 0), "7": ("response", None, len(rows[6][2])), None: ("revisit", "2", 1502),
    }
    assert bytes(found["2"].payload).decode() == big and found["1"].payload is None and bytes(found["7"].payload).decode() == rows[6][2]
    some = warc.read_warc(index.where("id in (7, 2)"), gap=0, most=10)
    assert sorted(r.page for r in some.collect()) == ["2", "7"]
    assert warc.read_warc(warc.write_warc(warc.plan_records(pages.limit(0)))).collect() == []


def test_warc_of_repeated_ids_and_long_payloads(spark):
    big, long = "x" * 1500, "é<p>" * 1_000_000
    rows = [(2, "u", big), (2, "u", big), (1, "v", big), (9, "", long), (8, None, long), (3, "w", "small"), (3, "w", "small")]
    pages = spark.createDataFrame([(*r, "f", 1, "d", 0) for r in rows], PAGES)
    index = warc.write_warc(warc.plan_records(pages)).collect()
    assert len({r.record_id for r in index}) == len(rows) == len({(r.file, r.offset) for r in index})
    read = warc.read_warc(spark.createDataFrame(index)).collect()
    found = sorted((r.page, r.record_type, r.refers_to, r.payload_bytes) for r in read)
    n = len(long.encode())
    assert [x for x in found if x[0] != "1" and x[0] != "8"] == [("2", "response", None, 1500)] * 2 + [("3", "response", None, 5)] * 2 + [("9", "response", None, n)]
    assert [x for x in found if x[0] in "18"] == [("1", "revisit", "2", 1500), ("8", "revisit", "9", n)]
    assert {r.url for r in read if r.page in ("8", "9")} == {"urn:page:8", "urn:page:9"}


def test_an_archive_is_what_the_format_says(spark):
    """Read by a plain reader of the format: gzip members, header lines, blocks by their lengths."""
    import base64
    import gzip
    import hashlib

    body = "<p>same</p>" * 200
    pages = spark.createDataFrame([(i, f"http://h/{i}", body if i < 4 else f"<p>{i}</p>" * 200, "f", 1, "d", 0) for i in range(20)], PAGES)
    index = warc.write_warc(warc.plan_records(pages)).collect()
    records = {}
    for file in {r.file for r in index}:
        data, at, first = gzip.open(file.removeprefix("file://")).read(), 0, True
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            version, *lines = data[at:end].decode().split("\r\n")
            head = dict(x.split(": ", 1) for x in lines)
            assert version == "WARC/1.1" and (head["WARC-Type"] == "warcinfo") == first
            block = data[end + 4 : end + 4 + int(head["Content-Length"])]
            at, first = end + 8 + len(block), False
            assert data[at - 4 : at] == b"\r\n\r\n" and head["WARC-Record-ID"] not in records
            records[head["WARC-Record-ID"]] = head, block
    by_type = {k: [x for x in records.values() if x[0]["WARC-Type"] == k] for k in ("response", "revisit")}
    assert (len(by_type["response"]), len(by_type["revisit"])) == (17, 3)
    for head, block in by_type["response"]:
        status, _, payload = block.partition(b"\r\n\r\n")
        assert head["Content-Type"] == "application/http;msgtype=response" and status.startswith(b"HTTP/1.1 200 OK\r\n")
        assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    for head, block in by_type["revisit"]:
        target = records[head["WARC-Refers-To"]][0]
        assert target["WARC-Target-URI"] == head["WARC-Refers-To-Target-URI"] == "http://h/3" and target["WARC-Type"] == "response"
        assert target["WARC-Payload-Digest"] == head["WARC-Payload-Digest"] and block.endswith(b"\r\n\r\n")


VECTORS = "vec_id long, embedding array<float>, id int, score string, cell int, grp int, chunk string"


def brute_top(rows, k, every, scale):
    usable = [(i, [int(x) for x in np.floor(scale * np.array(v, np.float32).astype(float))]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in usable if i != q)[:k]
            out += [(q, n + 1, i, int(-s)) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize(("n", "pivots", "group", "chunk"), [(300, 16, 4, 64), (300, 16, 2, 3), (40, 128, 2048, 16384), (3, 2, 1, 1), (1, 8, 8, 8)])
def test_top_k(spark, n, pivots, group, chunk):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.2 * rng.normal(size=6)]) for i in range(n)]
    rows += [(1000, rows[0][1]), (2000, [0.0] * 6), (-10, rows[0][1]), (None, rows[0][1]), (5000, None), (5010, [None] * 6), (5020, [float("nan")] * 6), (5030, [float("inf")] + [0.0] * 5), (70, [3.0] * 4) if n > 1 else (71, [])]
    rows = [r for k, r in enumerate(rows) if r[0] != 70 or k > n]
    df = spark.createDataFrame([(*r, 1, "s", 2, 3, "c") for r in rows], VECTORS)
    found = topk.top_k(df, k=4, every=10, pivots=pivots, group_queries=group, chunk_rows=chunk).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute_top(rows, 4, 10, 256)


@pytest.mark.parametrize("size", [2.0**17, 200_000.0, 2.0**20, 1.5 * 2.0**20])
def test_top_k_of_large_components(spark, size):
    """Products beyond 2**53, and beyond 32 bits a component, are exact."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in size * rng.normal(size=5)]) for i in range(120)] + [(500, [size, 1.0, 0.0, 0.0, 0.0]), (501, [2.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "s", 2, 3, "c") for r in rows], VECTORS)
    found = topk.top_k(df, k=4, every=10, pivots=8, chunk_rows=16).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute_top(rows, 4, 10, 256)


def test_top_k_refuses_what_does_not_fit(spark):
    for size, message in ((1e30, "beyond 2"), (1e15, "too large|OverflowError")):
        df = spark.createDataFrame([(i, [size, size], 1, "s", 2, 3, "c") for i in range(4)], VECTORS)
        with pytest.raises(Exception, match=message):
            topk.top_k(df, k=1, every=1).collect()
    df = spark.createDataFrame([(0, [200_000.0, 1.0], 1, "s", 2, 3, "c"), (1, [2.0, 0.0], 1, "s", 2, 3, "c")], VECTORS)
    assert topk.top_k(df, k=1).first().score == 26214400000


def test_top_k_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.05 * rng.normal(size=24)]) for i in range(3000)]
    df = spark.createDataFrame([(*r, 1, "s", 2, 3, "c") for r in rows], VECTORS)
    stats = {}
    found = topk.top_k(df, k=5, every=50, stats=stats).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute_top(rows, 5, 50, 256)
    assert stats["share"] < 0.3


def test_top_k_of_one_vector_many_times(spark):
    rows = [(i, [0.5, -0.25]) for i in range(200)]
    df = spark.createDataFrame([(*r, 1, "s", 2, 3, "c") for r in rows], VECTORS)
    found = topk.top_k(df, k=3, every=50, pivots=8, group_queries=2, chunk_rows=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute_top(rows, 3, 50, 256)
    assert topk.top_k(df.limit(0)).collect() == []


def found_pii(table, learn=None):
    candidates = pii.pii_candidates(table)
    found = pii.find_pii(candidates, pii.fit_pii(candidates if learn is None else pii.pii_candidates(learn)))
    return found.select("doc_id", pii.written("base_spans").alias("b"), pii.written("spans").alias("s"), "id", "_text").collect()


def test_pii(spark):
    rows = [(1, None), (2, ""), (3, "é a@b.co, 10.0.0.1; 4111 1111 1111 1111 +1 (234) 555-1234"), (3, "x"), (None, "q@w.de"), (5, "1" * 100_000), (6, "a" * 100_000 + "@b.com"), (7, "1.2.3.4.5.6.7.8 256.1.1.1 a@b.c_d@e.com"), (8, "a.b" * 30_000), (9, "\x01a@b.de\x01\x02 \x03+1 234 567 8901")]
    found = found_pii(docs(spark, rows))
    got = {r.doc_id: r.b for r in found if r.b}
    assert got == {3: "email:2:8,ip:10:18,card:20:39,phone:40:57", None: "email:0:6", 6: "email:0:100006", 7: "ip:0:7,ip:8:15,email:26:31,email:31:39", 9: "email:1:7,phone:11:26"}
    assert len(found) == len(rows) and all(set(r.b.split(",")) <= set(r.s.split(",")) for r in found if r.b) and all(r["_text"] == "t" for r in found)
    assert found_pii(docs(spark, [])) == []


def test_pii_of_a_text_with_many_spans(spark):
    """Positions of 30,000 spans, in time that grows with their number."""
    import time

    took = []
    for n in (10_000, 30_000):
        began = time.perf_counter()
        row = found_pii(docs(spark, [(1, "".join(f"u{i % 10}@h{i % 7}.org, 10.0.{i % 300}.1; " for i in range(n)))]))[0]
        took.append(time.perf_counter() - began)
        base = row.b.split(",")
        assert sum(x.startswith("email") for x in base) == n and sum(x.startswith("ip") for x in base) == sum(i % 300 < 256 for i in range(n))
        text = "".join(f"u{i % 10}@h{i % 7}.org, 10.0.{i % 300}.1; " for i in range(n))
        for kind, s, e in (x.split(":") for x in base[:: n // 50]):
            assert (text[int(s) : int(e)].count("@") == 1) == (kind == "email")
    assert took[1] < 9 * took[0]


#: Candidates beyond the base spans, that are personal data or only look like it.
TRUE_SPANS = ["reach me at jane.doe (at) mail (dot) com please", "contact: bob [at] corp.org", "login from host 10[.]20[.]30[.]40 today", "server address 192[.]168[.]7[.]21 down", "card 4111.1111.1111.1111 visa", "call my phone 212-555-0187 now", "tel (415) 555-2671 mobile"]
FALSE_SPANS = ["version 999[.]888[.]777[.]666 released", "sku 999-555-1234 isbn", "order ref 4111.1111.1111.1112 total", "build 300.400.500.600 release", "version 999.1.1.1 of the part", "serial 4111 1111 1111 1113 model", "item id 123-045-6789 page", "token x@localhost ref"]


def test_pii_classifier_on_planted_spans(spark):
    """An obfuscated address is found, a decoy refused, whatever the texts teach: both, hardly any, or true ones alone."""
    rng = random.Random(8)
    words = "the quick brown fox jumps over lazy dogs and writes plain prose".split()
    plain = lambda n: " ".join(rng.choices(words, k=n))
    base = [f"{plain(12)} write to u{i}@mail{i % 9}.com or server 10.{i % 250}.0.{i % 99} {plain(5)} call +1 212 555 01{i % 90 + 10} card 4111 1111 1111 1111" for i in range(60)]
    cases = [(i, f"{plain(9)} {t} {plain(9)}") for i, t in enumerate([*TRUE_SPANS, *FALSE_SPANS])]
    for learn in ([(k, t) for k, t in enumerate(base)] + cases, [(k, t) for k, t in enumerate(base * 20)], []):
        found = {r.doc_id: (r.b, r.s) for r in found_pii(docs(spark, cases), docs(spark, learn))}
        for i, t in enumerate([*TRUE_SPANS, *FALSE_SPANS]):
            added = set(found[i][1].split(",")) - set(found[i][0].split(","))
            assert bool(added) == (i < len(TRUE_SPANS)), (t, found[i], len(learn))


def test_pii_reliabilities_favour_labelers_that_agree(spark):
    rows = [("p", [v, v, c, pii.NONE, 1, 1, 1], float(n)) for v, c, n in ((pii.YES, pii.YES, 60), (pii.YES, pii.NO, 40), (pii.NO, pii.YES, 40), (pii.NO, pii.NO, 60))]
    df = spark.createDataFrame(rows, "k string, v array<int>, n double").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("rows"))
    q = {tuple(x.v[:3]): x.q for x in df.select(pii.reliabilities(F.col("rows")).alias("r")).first().r}
    assert q[pii.YES, pii.YES, pii.NO] > 0.8 and q[pii.NO, pii.NO, pii.YES] < 0.2


def toxic_tables(spark):
    rng = random.Random(3)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for d in range(600):
        words = rng.choices(clean, k=40)
        if d % 4 == 0:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["dreadword", "awfulterm", "vilething"])
        rows.append((d, " ".join(words)))
        labels.append((d, int(d % 4 == 0)))
    return rows, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity(spark):
    rows, labels = toxic_tables(spark)
    table = docs(spark, rows)
    model = toxicity.fit_toxicity(table, labels)
    clean = " ".join(f"w{i}" for i in range(40))
    cases = [(1, None), (2, ""), (3, clean), (4, clean + " dreadword awfulterm vilething dreadword"), (5, clean + " draedword awfultrm vilethingg dreadwrd dreadword"), (6, clean + ' they wrote "dreadword" once'), (7, LONG), (7, LONG), (None, "x")]
    scored = toxicity.score_toxicity(docs(spark, cases), model).collect()
    score = {r.doc_id: r.score for r in scored}
    assert score[4] > 0.5 and score[5] > 0.3 and max(score[k] for k in (1, 2, 3, 6, 7, None)) < 0.5 and score[1] == score[2]
    assert score[6] < score[4] and all(r.spans == "p" for r in scored)
    assert toxicity.score_toxicity(docs(spark, []), model).collect() == []
    no_labels = toxicity.fit_toxicity(table, labels.limit(0))
    assert toxicity.score_toxicity(docs(spark, [(1, "dreadword")]), no_labels).first().score < 0.5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_entry(word, terms, stems, clean=()):
    """(weight, edits) by the docstring of the lexicon, over all entries."""
    if word in terms:
        return terms[word], 0
    for k in range(min(len(word), toxicity.LONGEST_STEM), 2, -1):
        if word[:k] in stems:
            return stems[word[:k]], 0
    if word in clean:
        return None
    near = []
    for t, weight in terms.items():
        if len(t) >= toxicity.SHORTEST_FUZZY:
            d = edits(word, t)
            if d < 2 or d == 2 and (len(t) >= toxicity.LONG_TERM or sorted(word) == sorted(t)):
                near.append((d, -weight))
    for s, weight in stems.items():
        if len(s) >= toxicity.FUZZY_STEM:
            d = min(edits(word[:k], s) for k in range(len(word) + 1))
            if d < 2:
                near.append((d, -weight))
    return (-min(near)[1], min(near)[0]) if near else None


def test_lexicon_finds_what_brute_force_finds():
    rng = random.Random(1)
    found = 0
    for letters in ("abc", "abcdefgh"):
        terms = {"".join(rng.choices(letters, k=rng.randint(3, 10))): rng.randint(1, 9) / 2 for _ in range(14)}
        stems = {"".join(rng.choices(letters, k=rng.randint(3, 8))): rng.randint(1, 9) / 2 for _ in range(5)}
        lexicon = toxicity.Lexicon(terms, stems, frozenset(["abcab"]))
        words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(2000)]
        for entry in [*terms, *stems]:  # and words near the entries
            for _ in range(60):
                word = list(entry + rng.choice(["", "", "ab", "hgf"]))
                for _ in range(rng.randint(1, 3)):
                    at = rng.randrange(len(word))
                    word[at : at + 1] = rng.choice([[], [rng.choice(letters)], [word[at], rng.choice(letters)], word[at : at + 1]])
                    word = word or ["a"]
                rng.random() < 0.1 and rng.shuffle(word)
                words.append("".join(word))
        for word in ["abcab", "", *words]:
            want = brute_entry(word, terms, stems, {"abcab"})
            assert lexicon.find(word) == want, word
            found += bool(want and want[1])
    assert found > 300
    assert toxicity.Lexicon({"idiot": 2.0}, {}).find("tdioi") == (2.0, 2)
    # a term under a short stem is found misspelled, too
    under = toxicity.Lexicon({"idiotic": 2.0}, {"idio": 1.0})
    assert [under.find(w) for w in ("idiotic", "idioms", "idoitic", "xdiotic")] == [(2.0, 0), (1.0, 0), (2.0, 2), (2.0, 1)]


def test_toxicity_features_by_brute_force():
    """The features of a text, counted word by word with no index."""
    import math
    import re

    terms, stems = {"dreadword": 3.0, "awful": 1.5}, {"vilest": 2.0}
    lexicon = toxicity.Lexicon(terms, stems)

    def brute(text):
        words = [(m[0], m.start()) for m in re.finditer(r"\w+", text.lower())]
        sums, scored = {"exact": 0.0, "fuzzy": 0.0, "quoted": 0.0}, []
        for i, (word, start) in enumerate(words):
            entry = brute_entry(word, terms, stems)
            if entry:
                line = text[: start].count("\n")
                row, at = text.split("\n")[line], start - (text.rfind("\n", 0, start) + 1)
                quoted = sum(c in toxicity.MARKS for c in row[:at]) % 2 == 1 and any(c in toxicity.MARKS for c in row[at:])
                quoted = quoted or any(w in toxicity.REPORTING for w, _ in words[max(0, i - 4) : i])
                sums["quoted" if quoted else "fuzzy" if entry[1] else "exact"] += entry[0]
                scored.append((i, entry[0] * (toxicity.QUOTED if quoted else 1) / (1 + entry[1])))
        if not scored:
            return [0.0] * toxicity.N_FEATURES
        hottest = max(sum(s for j, s in scored if i - toxicity.WINDOW <= j <= i) for i, _ in scored)
        return [*(math.log1p(sums[k]) for k in ("exact", "fuzzy", "quoted")), hottest / 5, math.log1p(100 * (sums["exact"] + sums["fuzzy"]) / len(words))]

    rng = random.Random(4)
    pieces = ["dreadword", "draedword", "awful", "awfull", "vilestly", "vielst", "plain", "word", "said", '"', "\n", "„", "quote", "x", "Awful,"]
    for n in (0, 1, 5, 40, 300):
        for _ in range(30):
            text = " ".join(rng.choices(pieces, k=n))
            assert toxicity.features(text, toxicity.Hits(lexicon)) == pytest.approx(brute(text))


def test_quality(spark):
    rows = [(i, ("good plain words here " if i % 3 else "junk!! JUNK!! junk!! ") * (i % 7 + 1)) for i in range(300)]
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1 + (i % 3 == 2)) for i in range(300)] + [(None, 1), (4, None)], "doc_id long, grade int")
    table = docs(spark, rows)
    model = quality.fit_quality(table, labels, F.col("grade"), 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    found = quality.score_quality(docs(spark, [*rows, (None, None), (999, ""), (998, LONG)]), model).collect()
    assert len(found) == 303 and all(r.source is None and list(r.grade_tails) == sorted(r.grade_tails, reverse=True) for r in found)
    assert all((r.tail_probability >= 0.5) == (r.doc_id % 3 > 0) for r in found if r.doc_id is not None and r.doc_id < 300)
    assert quality.score_quality(docs(spark, []), model).collect() == []
    nothing = quality.fit_quality(table, labels.limit(0), F.col("grade"), 3)
    assert quality.score_quality(docs(spark, [(1, "x")]), nothing).first().tail_probability == pytest.approx(0.5, abs=0.01)


def brute_quality(text, model):
    """Expected grade and tails, slot by slot from the definition."""
    import math
    import zlib

    slot = lambda kind, x: zlib.crc32(f"{kind}:{x}".encode()) % quality.SLOTS
    words = (text or "").split()
    eta = 0.0
    for w in words:
        form = ""
        for c in w:
            sign = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
            form += sign if not form or form[-1] != sign else ""
        eta += (model.weights[slot("word", w.lower())] + model.weights[slot("shape", form)]) / len(words)
    if words:
        eta += model.weights[slot("text", "repeated")] * sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        eta += model.weights[slot("text", "distinct")] * len(set(words)) / len(words)
    else:
        eta += model.weights[slot("text", "empty")]
    tails = [1 / (1 + math.exp(-max(-40.0, min(40.0, eta - t)))) for t in model.thresholds]
    return sum(tails), tails


def test_quality_scores_by_brute_force(spark):
    rng = np.random.default_rng(2)
    model = quality.OrdinalModel(rng.normal(size=quality.SLOTS), np.array([-0.5, 0.25, 1.5]))
    rows = [(1, None), (2, " \t"), (3, "One two two 2 two!! ÀÉé 中文"), (3, "One two two 2 two!! ÀÉé 中文"), (4, LONG), (5, "A\u00a0b\u2003c d")]
    found = quality.score_quality(docs(spark, rows), model, tail_from=2).collect()
    assert len(found) == len(rows)
    for r in found:
        grade, tails = brute_quality(r.text, model)
        assert r.expected_grade == pytest.approx(grade) and list(r.grade_tails) == pytest.approx(tails) and r.tail_probability == pytest.approx(tails[1])


def test_quality_fit_is_at_the_highest_likelihood():
    """The loss, taken grade by grade from the definition, is stationary where the fit ends."""
    import math

    rng = np.random.default_rng(6)
    rows = [{int(s): float(v) for s, v in zip(rng.choice(6, 3, replace=False), rng.random(3), strict=True)} for _ in range(150)]
    grades = np.array([min(3, max(0, round(2 * r.get(0, 0) - 2 * r.get(1, 0) + 1.2 + rng.normal()))) for r in rows])

    def loss(weights, cuts):
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            eta = sum(weights[s] * v for s, v in r.items())
            tails = [1.0, *(1 / (1 + math.exp(t - eta)) for t in cuts), 0.0]
            total -= math.log(tails[g] - tails[g + 1])
        return total / len(rows)

    model = quality.fit_ordinal(rows, grades, 4, steps=1500, rate=0.05)
    assert (np.diff(model.thresholds) > 0).all()
    point = np.concatenate((model.weights[:6], model.thresholds))
    at = lambda p: loss(p[:6], p[6:])
    for k in range(len(point)):
        step = np.zeros(len(point))
        step[k] = 1e-4
        assert abs(at(point + step) - at(point - step)) / 2e-4 < 2e-3
    assert all(at(point + 0.1 * rng.normal(size=len(point))) > at(point) for _ in range(20))


def test_labelled_sample_is_bounded_in_rows(spark):
    from sightline.llm.labelled import labelled_sample

    table = docs(spark, [(1, f"t{i}") for i in range(200)] + [(2, "x"), (3, None), (None, "y")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    texts, marks = labelled_sample(table, labels, F.col("toxic"), "doc_id", "text", 50, 10**6)
    assert len(texts) == len(marks) == 50
    texts, _ = labelled_sample(table, labels, F.col("toxic"), "doc_id", "text", 4000, 10**6)
    assert len(texts) == 201
