"""The registered queries give the rows of their SQL, or of brute force where SQL can't say it."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, same_as_duckdb, name):
    same_as_duckdb(QUERIES[name](spark, SF), ORACLES[name])


def test_bpe_is_that_of_the_library(spark, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = QUERIES["op5_bpe"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ids = np.array(library.encode_ordinary(documents[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()


def test_token_files_hold_the_library_ids(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for doc in sorted(documents):
        ids = np.array([*library.encode(documents[doc], add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = QUERIES["op10_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == want


def shingles(text: str, n: int) -> frozenset:
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_components(texts: dict[int, str], n: int) -> dict[int, int]:
    sets = {d: shingles(t, n) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(a: int) -> int:
        while root[a] != a:
            a = root[a]
        return a

    meet = defaultdict(Counter)
    seen = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            for e in seen[s]:
                meet[d][e] += 1
            seen[s].append(d)
        for e, both in meet[d].items():
            if 100 * both >= 80 * (len(sets[d]) + len(sets[e]) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def test_near_duplicates_are_those_of_brute_force(spark, documents):
    root = brute_components(documents, 2)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op9_near_dedup"](spark, SF).collect()}
    assert found == {d: (len(shingles(t, 2)), root[d], root[d] == d) for d, t in documents.items()}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[str]:
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(number) <= 19 and luhn(number)) or kind == "phone" and not 10 <= len(number) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data_base(spark, documents):
    rows = QUERIES["op8_pii"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        spans = base_spans(documents[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in spans) for k in BASE]
        assert set(spans) <= set(r.spans.split(","))


SF_LARGER = SF.replace("sf0.001", "sf0.01")


def test_toxicity_on_rows_held_out(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF_LARGER}/labels.parquet'").fetchall())
    rows = QUERIES["op6_toxicity"](spark, SF_LARGER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) >= 0.93
    assert sum(p for p, y in held if y == 0) == 0


def test_quality_on_rows_held_out(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF_LARGER}/labels.parquet'").fetchall())
    rows = QUERIES["op3_quality"](spark, SF_LARGER).collect()
    held = [(r.kept, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(k == (y > 0) for k, y in held) / len(held) >= 0.95
    assert all(0 <= r.tail_probability <= 1 and r.tail_probability <= r.expected_grade <= 1 + r.tail_probability for r in rows)


def test_pipeline_stages(spark, documents):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [s[0] for s in c.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "byte-level BPE"]
    first = c.toxicity(spark, docs, SF).cache()
    assert first.columns == docs.columns and 0 < first.count() <= docs.count()

    second = c.exact(spark, first, SF).cache()
    groups = defaultdict(list)
    for r in first.collect():
        text = r.text or ""
        groups[re.sub(r"[\x20\x09-\x0d]+", "", text)].append((-len(text), r.doc_id))
    assert sorted(r.doc_id for r in second.collect()) == sorted(min(g)[1] for g in groups.values())

    third = c.near(spark, second, SF).cache()
    root = brute_components({r.doc_id: r.text or "" for r in second.collect()}, 5)
    assert sorted(r.doc_id for r in third.collect()) == sorted(d for d, r in root.items() if d == r)

    fourth = c.mixing(spark, third, SF).cache()
    times = Counter(r.doc_id for r in fourth.collect())
    assert max(times.values()) <= 2
    words = third.select("source", F.regexp_count("text", F.lit("[^ \\t-\\r]+")).alias("n")).groupBy("source").agg(F.sum("n")).collect()
    taken = fourth.select("source", F.regexp_count("text", F.lit("[^ \\t-\\r]+")).alias("n")).agg(F.sum("n")).first()[0]
    assert taken == pytest.approx(1.5 * sum(r[1] for r in words), rel=0.1)

    last = c.tokens(spark, fourth, SF)
    rows = last.select("doc_id", "n_tokens", F.octet_length("token_ids").alias("bytes"), "round_trip").collect()
    assert Counter(r.doc_id for r in rows) == times and all(r.round_trip and r.bytes == 4 * r.n_tokens for r in rows)
    assert c.run(spark, SF).count() == len(rows)


def test_pipeline_on_repeated_ids_nulls_and_clashes(spark, tmp_path):
    """Every distinct text of what comes in keeps a representative; twins and null ids are told apart."""
    import corpus_pipeline as c

    a, b, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abd")
    rows = [(5, a, "x"), (5, b, "x"), (3, b, "y"), (5, a, "y"), (5, a.replace(" ", "  "), None), (None, d, "x"), (None, d, None), (8, None, "x"), (9, "", "y"), (10, " \n", None), (11, a + " end", "x"), (12, d + " end", "y")]
    table = spark.createDataFrame([(i, t, "en", s, 1, "k", 2, "g") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _hash string, kept int, `group` string")
    norm = lambda t: "".join((t or "").split())

    second = c.exact(spark, table, SF)
    assert second.columns == table.columns
    kept = [(r.doc_id, r.text) for r in second.collect()]
    assert sorted(kept, key=str) == sorted([(3, b), (5, a.replace(" ", "  ")), (None, d), (10, " \n"), (11, a + " end"), (12, d + " end")], key=str)
    assert {norm(t) for _, t in kept} == {norm(t) for _, t, _ in rows}

    third = c.near(spark, table, SF)
    kept = sorted(((r.doc_id, r.text) for r in third.collect()), key=str)
    assert third.columns == table.columns
    # groups: a, twice a and a with an end (5); b (3, 5); d with an end alone, as null ids take no part
    assert sorted(k for k in kept if k[0] in (3, 5, 11, 12)) == [(3, b), (5, min((t for i, t, _ in rows if i == 5 and norm(t) == norm(a)), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])), (12, d + " end")]
    assert [k for k in kept if k[0] is None] == [(None, d)] * 2 and {k[0] for k in kept} >= {8, 9, 10}

    fourth = c.mixing(spark, second, SF)
    assert fourth.columns == table.columns and set((r.doc_id, r.text) for r in fourth.collect()) <= set((r.doc_id, r.text) for r in second.collect())
    last = c.tokens(spark, table, SF).collect()
    assert len(last) == len(rows) and all(r.round_trip for r in last)

    empty = table.limit(0)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in c.STAGES)
