"""Links between the tokens of two tokenizers, by a dictionary of groups."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import lookup, prepare, scratch, text_of, worker_state

#: Words and groups that a worker remembers from chunk to chunk, and how long such a word may be.
WORDS, GROUPS, WORD_CHARS = 600_000, 1_000_000, 128
#: So many new words go to the libraries as one text.
TOGETHER = 64
#: A chunk of documents, which share a table of groups, ends after so many characters.
CHUNK_CHARS = 16_000_000
#: Characters and documents of a batch that a worker hands on.
SENT_CHARS, SENT_DOCS = 2_000_000, 500
#: A space that ends one word and begins the next, whichever white space a tokenizer knows.
INK = r"[^\s᠎​-‏⁠﻿]"
CUT = re.compile(f"(?<={INK}) (?={INK})")
PLAIN = re.compile(INK)


def byte_level_alphabet() -> dict[str, int]:
    """Byte of each character by which byte-level vocabularies write it: printable bytes are themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: <0xHH> is that byte, U+2581 a space."""
    as_byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(as_byte[1], 16)]) if as_byte else piece.replace("▁", " ").encode()


class Aligner:
    """Cuts texts into groups: the shortest runs of A tokens and of B tokens that cover the same bytes.

    A's tokens are those of a space and the text, B's those of the text (B adds
    the space), the strings of special tokens as plain text. Where both
    tokenizers treat words alone, a text is cut before the spaces between words,
    as no token of either goes across such a place; groups of words are remembered.
    """

    def __init__(self, config_a: str, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the workers are the parallelism
        self.a = Tokenizer.from_str(config_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        alphabet = byte_level_alphabet()
        names = self.a.get_vocab(with_added_tokens=False)
        told = {n: bytes(alphabet[c] for c in name) for name, n in names.items() if all(c in alphabet for c in name)}
        self.bytes_a = [told.get(n, b"") for n in range(max(names.values()) + 1)]
        pieces = [self.b.id_to_piece(n) for n in range(self.b.vocab_size())]
        self.bytes_b = [piece_bytes(x) for x in pieces]
        if any(not x for x in (*told.values(), *self.bytes_b)):
            raise ValueError("a token has no bytes")
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.kind = np.dtype("<u2" if max(max(names.values()), len(pieces)) < (1 << 16) - 1 else "<u4")
        self.mark = np.array([-1]).astype(self.kind).tobytes()
        self.cuts = self._cuts(json.loads(config_a), pieces)
        self.clear()

    def _cuts(self, config: dict, pieces: list[str]) -> bool:
        before = config.get("pre_tokenizer") or {}
        alone_a = config.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        plain = "a  b ééﬁ① \n"
        alone_b = not any("▁" in x.lstrip("▁") for x in pieces) and b"".join(self.bytes_b[n] for n in self.b.encode(plain)) == (" " + plain).encode()
        return bool(alone_a and alone_b)

    def clear(self) -> None:
        """Forget all words and groups."""
        self.words: dict[str, tuple[int, ...]] = {}
        self.bad: set[str] = set()
        self.number: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.texts: list[str] = []
        self.sizes = np.zeros((1 << 16, 2), np.int64)

    def shrink(self) -> None:
        """Keep WORDS words, the first met, as the latest came in for the rarest."""
        for _ in range(len(self.words) - WORDS):
            self.bad.discard(self.words.popitem()[0])
        if len(self.keys) > GROUPS:
            self.clear()

    def split(self, text: str) -> tuple[list[str], list[str]]:
        """Words of a text, each without the space before it, and those of them that are not known."""
        words = text.split(" ") if self.cuts else [text]
        fresh = [w for w in set(words) if w not in self.words]
        if self.cuts and not all(w and PLAIN.match(w[0]) and PLAIN.match(w[-1]) for w in fresh):
            words = CUT.split(text)
            fresh = [w for w in set(words) if w not in self.words]
        return words, fresh

    def learn(self, words: list[str]) -> None:
        """Words that can stand between others go to the libraries many to a text, which their bytes cut up again."""
        alone = [w for w in words if len(w) > WORD_CHARS or not (w and PLAIN.match(w[0]) and PLAIN.match(w[-1]))] if self.cuts else words
        others = set(alone)
        runs = [words] if not others else [[w for w in words if w not in others]]
        runs = [run[k : k + TOGETHER] for run in runs for k in range(0, len(run), TOGETHER)] if self.cuts else []
        texts = [*alone, *(" ".join(run) for run in runs)]
        ids_a = [x.ids for x in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        for word, a, b in zip(alone, ids_a, ids_b, strict=False):
            self._add([word], a, b)
        for run, a, b in zip(runs, ids_a[len(alone) :], ids_b[len(alone) :], strict=True):
            if not self._add(run, a, b):
                for word in run:
                    self._add([word], self.a.encode(" " + word, add_special_tokens=False).ids, self.b.encode(word))

    def _add(self, run: list[str], a: list[int], b: list[int]) -> bool:
        """Take in the words of a run with these tokens. A single word that they do not spell is bad; of more, none is taken in."""
        told = [(" " + word).encode() for word in run]
        whole = b"".join(told)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            if len(run) == 1:
                self.words[run[0]] = ()
                self.bad.add(run[0])
            return False
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        size = self.kind.itemsize
        to_a, to_b = ((np.searchsorted(ends, cuts) + 1) * size for ends in (ends_a, ends_b))
        packed_a, packed_b, mark, number = ids_a.astype(self.kind).tobytes(), ids_b.astype(self.kind).tobytes(), self.mark, self.number
        groups, from_a, from_b = [], 0, 0
        for at_a, at_b in zip(to_a.tolist(), to_b.tolist(), strict=True):
            key = packed_a[from_a:at_a] + mark + packed_b[from_b:at_b]
            known = number.get(key)
            groups.append(self._group(key, (at_a - from_a) // size) if known is None else known)
            from_a, from_b = at_a, at_b
        at = 0
        for word, to in zip(run, (np.searchsorted(cuts, np.cumsum([*map(len, told)])) + 1).tolist(), strict=True):
            self.words[word] = tuple(groups[at:to])
            at = to
        return True

    def _group(self, key: bytes, n_a: int) -> int:
        """The number of a new group, which is interned by its ids: those of A, the greatest number there is, those of B."""
        known = self.number[key] = len(self.keys)
        ids = np.frombuffer(key, self.kind).tolist()
        self.keys.append(key)
        self.texts.append(",".join(map(str, ids[:n_a])) + "|" + ",".join(map(str, ids[n_a + 1 :])))
        if known == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sizes[known] = n_a, len(ids) - n_a - 1
        return known

    def align(self, text: str) -> tuple[str, np.ndarray]:
        """The groups as text, and their numbers in order; "" and none if the tokens do not spell the text."""
        if not text:
            return "", np.zeros(0, np.int64)
        words, fresh = self.split(text)
        if fresh:
            self.learn(fresh)
        groups = [] if self.bad and not self.bad.isdisjoint(words) else [*chain.from_iterable(map(self.words.__getitem__, words))]
        for word in fresh:
            if len(word) > WORD_CHARS:
                del self.words[word]
                self.bad.discard(word)
        return ";".join(map(self.texts.__getitem__, groups)), np.array(groups, np.int64)


class _Chunk:
    """The groups of a chunk of documents: each gets a number from 0 as it comes, and is counted."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.of = aligner, np.full(1 << 16, -1, np.int64)
        self.groups: list[int] = []
        self.counts = np.zeros(1 << 16, np.int64)

    def add(self, groups: np.ndarray) -> tuple[int, int, int, bytes]:
        """Of a document: A tokens, B tokens, groups, and its groups' numbers and counts, packed."""
        if not len(groups):
            return 0, 0, 0, b""
        group, n = np.unique(groups, return_counts=True)
        size = len(self.aligner.keys)
        if size > len(self.of):
            self.of = np.concatenate([self.of, np.full(2 * size - len(self.of), -1, np.int64)])
        fresh = group[self.of[group] < 0]
        self.of[fresh] = np.arange(len(self.groups), len(self.groups) + len(fresh))
        self.groups += fresh.tolist()
        if len(self.groups) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(2 * len(self.groups) - len(self.counts), np.int64)])
        number = self.of[group]
        self.counts[number] += n
        n_a, n_b = (n @ self.aligner.sizes[group]).tolist()
        order = np.argsort(number)
        return n_a, n_b, len(groups), zstandard.compress(np.stack([number[order], n[order]]).astype("<u4").tobytes(), 1)


def last_tokens(key: bytes, kind: np.dtype) -> tuple[int, int]:
    """The only tokens of a group that end together: its last A and its last B token, as tokens have bytes and inner ends would cut it."""
    ids = np.frombuffer(key, kind)
    at = int(np.flatnonzero(ids == np.iinfo(kind).max)[0])
    return int(ids[at - 1]), int(ids[-1])


def align_tokenizers(docs: DataFrame, tokenizer_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text", *, shown: Callable[[Column], Column] = lambda groups: groups, dictionary: dict | None = None) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every document.

    A tokens (a tokenizers file, byte level) of a space and the text, and B
    tokens (a sentencepiece model) of the text, are cut into groups where both
    end at a byte. Links are the pairs of an A and a B token that end together;
    the count of a pair of ids is how many links of all documents hold it.
    n_best counts the links whose pair has the highest count that the B id has
    in all documents, ties included; count_sum adds up the counts of the
    links. groups is "a1,a2|b1;a3|b2,b3" as text; shown says what is kept of
    it, such as a digest. dictionary, where given, gets the tables "groups"
    (key, n, a, b) and "pairs" (a, b, count, best).

    Every distinct group is interned by its ids. Texts are encoded once;
    documents keep the numbers of their groups in the table of their chunk, a
    run of some CHUNK_CHARS characters, and each chunk hands on a row for each
    distinct group. Groups are summed over chunks, links are expanded once
    per distinct group and weighed by its frequency, and what a group's links
    are worth is joined back to the chunks by the group's key. So what is
    shuffled grows with distinct groups of chunks, not with tokens; a group
    that every text has is one row a chunk, in a join that adaptive execution
    can split. Only a chunk's documents meet in one task.

    Null and empty texts, and those whose A or B tokens do not spell a space
    and the text, have no tokens: zeros and "". Repeated rows count as often as
    they occur; null ids stay. Other columns are ignored. A sum beyond 64 bits
    is an error. No rows give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer_a, encoding="utf-8") as f, open(model_b, "rb") as g:
        held = spark.sparkContext.broadcast((f.read(), g.read()))
    aligner = Aligner(*held.value)
    kind = aligner.kind
    plain = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    fields = [StructField("chunk", LongType()), StructField("_id", docs.schema[id_col].dataType), *(StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups")), StructField("groups", StringType()), StructField("refs", BinaryType())]
    fields += [StructField("number", IntegerType()), StructField("key", BinaryType()), StructField("n", LongType())]
    schema = StructType(fields)

    def rows(names: list[str], columns: list) -> pa.RecordBatch:
        given = dict(zip(names, columns, strict=True))
        n, arrow = len(columns[0]), {"chunk": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups": pa.string(), "refs": pa.binary(), "number": pa.int32(), "key": pa.binary(), "n": pa.int64()}
        return pa.RecordBatch.from_arrays([given[f] if isinstance(given.get(f), pa.Array) else pa.array(given[f], arrow[f]) if f in given else pa.nulls(n, arrow.get(f, id_kind[0])) for f in schema.names], names=schema.names)

    id_kind: list[pa.DataType] = [pa.null()]

    query = uuid.uuid4().hex  # what a worker remembers is of one run, so runs do not depend on those before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state(("align", query), lambda: Aligner(*held.value))
        part, number, chars = TaskContext.get().partitionId() << 32, 0, 0
        chunk = _Chunk(own)

        def table() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(chunk.groups), 50_000):
                some = chunk.groups[at : at + 50_000]
                yield rows(["chunk", "number", "key", "n"], [[part + number] * len(some), range(at, at + len(some)), [own.keys[g] for g in some], chunk.counts[at : at + len(some)].tolist()])
            own.shrink()

        for batch in batches:
            id_kind[0] = batch.column(0).type
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                out, size, begin = [], 0, at
                while at < len(texts) and size < SENT_CHARS and len(out) < SENT_DOCS:
                    groups, found = own.align(texts[at])
                    n_a, n_b, n_groups, refs = chunk.add(found)
                    out.append((n_a, n_b, n_groups, groups, refs))
                    size += len(texts[at])
                    at += 1
                chars += size
                yield rows(["chunk", "_id", "n_a", "n_b", "n_groups", "groups", "refs"], [[part + number] * len(out), ids.slice(begin, at - begin), *map(list, zip(*out, strict=True))])
                if chars >= CHUNK_CHARS:
                    yield from table()
                    number, chars, chunk = number + 1, 0, _Chunk(own)
        yield from table()

    aligned = plain.mapInArrow(run, schema).withColumn("groups", F.when(F.col("n_groups") == 0, "").when(F.col("n_groups") > 0, shown(F.col("groups"))))
    aligned = scratch(aligned, "align-chunks")
    of_chunk = aligned.where("key is not null").select("chunk", "number", "key", "n")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [last_tokens(key, kind) for key in batch.column(0).to_pylist()]
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["key", "n", "a", "b"])

    distinct = of_chunk.groupBy("key").agg(F.sum("n").alias("n"))
    distinct = scratch(distinct.mapInArrow(expand, "key binary, n long, a int, b int"), "align-groups")
    pairs = distinct.groupBy("a", "b").agg(F.sum("n").alias("count"))
    pairs = scratch(pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b"))), "align-pairs")  # a B id has at most a row for each A id
    if dictionary is not None:
        dictionary |= {"groups": distinct, "pairs": pairs}
    worth = scratch(distinct.join(lookup(pairs), ["a", "b"]).select("key", "count", "best"), "align-worth")
    back = of_chunk.drop("n").join(lookup(worth), "key").select("chunk", "number", "count", "best")
    texts = aligned.where("key is null").select(F.col("chunk").alias("chunk"), "_id", "n_a", "n_b", "n_groups", "groups", "refs")
    result = StructType([*(f for f in fields if f.name in ("_id", "n_a", "n_b", "n_groups")), *(StructField(c, LongType()) for c in ("n_links", "n_best", "count_sum")), aligned.schema["groups"]])

    def add_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("number").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sums = []
        for refs in left.column("refs").to_pylist():
            groups, n = np.frombuffer(zstandard.decompress(refs), "<u4").reshape(2, -1).astype(np.int64) if refs else np.zeros((2, 0), np.int64)
            if float(count[groups].astype(float) @ n) > 9e18:
                raise OverflowError("a document's sum of counts is beyond 64 bits")
            sums.append((int(n.sum()), int(best[groups] @ n), int(count[groups] @ n)))
        columns = [left.column(c) for c in ("_id", "n_a", "n_b", "n_groups")]
        return pa.table([*columns, *(pa.array([s[k] for s in sums], pa.int64()) for k in range(3)), left.column("groups")], names=result.names)

    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(add_up, result).withColumnRenamed("_id", id_col)
