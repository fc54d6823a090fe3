"""Byte-level BPE: encoding by a rank queue, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StructField, StructType

from .common import prepare, text_of, worker_state

#: Bits in a word of the rank bitmap.
WORD = 256
#: Pre-tokens whose ids a worker remembers (some 200 bytes each); others are encoded each time they occur,
#: as are pre-tokens of more bytes than these, which hardly occur twice and could fill the memory.
REMEMBERED = 1_200_000
LONGEST_REMEMBERED = 128


class RankQueue:
    """Positions by merge rank: pop() gives the least rank's leftmost position.

    A two-level bitmap has a bit per rank and one per word of ranks; find-first-set
    on both picks the next rank. Each rank's bucket is a heap of positions.
    """

    def __init__(self, n_ranks: int):
        self.top = 0
        self.words = [0] * (n_ranks // WORD + 1)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank // WORD
        self.words[word] |= 1 << rank % WORD
        self.top |= 1 << word

    def pop(self) -> tuple[int, int]:
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        rank = word * WORD + low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.words[word] = bits ^ low
        if bits == low:
            self.top ^= 1 << word
        return rank, bucket[0]


class Encoder(dict):
    """Maps a pre-token to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], remember: int = REMEMBERED):
        self.ranks, self.remember = ranks, remember
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.packed = {piece: rank.to_bytes(4, "little") for piece, rank in ranks.items()}
        self.pieces = {rank: piece for piece, rank in ranks.items()}

    def __missing__(self, token: str) -> bytes:
        piece = token.encode("utf-8", "surrogatepass")
        ids = self.packed.get(piece)
        if ids is None:
            ids = self.merge(piece)
        if len(piece) <= LONGEST_REMEMBERED and len(self) < self.remember:
            self[token] = ids
        return ids

    def merge(self, piece: bytes) -> bytes:
        """Merge the pair of least rank, leftmost first, until no pair has a rank.

        Parts form a linked list by their first byte's position. A queue entry
        is stale, and skipped, when its part's pair has another rank by now.
        """
        rank_of, queue, n = self.ranks.get, self.queue, len(piece)
        push, pop = queue.push, queue.pop
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        now = [rank_of(piece[i : i + 2]) for i in range(n)]
        now[-1] = None
        for i, rank in enumerate(now):
            if rank is not None:
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if now[i] != rank:
                continue
            j = end[i]
            now[j] = None
            stop = end[i] = end[j]
            if stop < n:
                before[stop] = i
                found = now[i] = rank_of(piece[i : end[stop]])
                if found is not None:
                    push(found, i)
            else:
                now[i] = None
            k = before[i]
            if k >= 0:
                found = now[k] = rank_of(piece[k:stop])
                if found is not None:
                    push(found, k)
        out, i = [], 0
        while i < n:
            out.append(self.packed[piece[i : end[i]]])
            i = end[i]
        return b"".join(out)

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file of lines "base64 rank"."""
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in data.splitlines() if line)}


def _encoder(data: bytes, remember: int = REMEMBERED) -> Encoder:
    return worker_state(("bpe", hash(data)), lambda: Encoder(read_ranks(data), remember))


def _with_columns(df: DataFrame, kinds: dict[str, DataType], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df with the columns that make(batch) gives, computed on Arrow batches."""
    schema = StructType([*(f for f in df.schema.fields if f.name not in kinds), *(StructField(n, k) for n, k in kinds.items())])
    names = [f.name for f in schema.fields[: -len(kinds)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *make(part)], names=schema.names)

    return df.mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, keep: tuple[str, ...] = (), decoded_col: str | None = None, remember: int = REMEMBERED) -> DataFrame:
    """id, the columns of keep, token_ids and n_tokens of each row's whole text.

    token_ids holds the ids as little-endian unsigned 32-bit integers. Each
    match of pattern is encoded alone; there are no special tokens. The rank
    file (about 1 MB) is read on the driver and sent along, so executors need
    no copy of it. With decoded_col, the ids are also decoded, as bpe_decode
    does, before they leave the worker. A worker remembers the ids of so many
    short pre-tokens as remember says, which bounds its memory. A text that
    repeats that of the row before is encoded once. Null text counts as empty: no ids.
    Repeated rows give repeated rows, null ids stay null, no rows give no rows.
    """
    prepare(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batch: pa.RecordBatch) -> list[pa.Array]:
        encoder, cut = _encoder(held.value, remember), regex.compile(pattern).findall
        ids, decoded, last = [], [], None
        for text in batch.column("_text").to_pylist():
            if text != last:  # rows repeated by a mix follow one another
                now = encoder.encode(cut(text))
                back, last = encoder.decode(now) if decoded_col else b"", text
            ids.append(now)
            decoded.append(back)
        return [pa.array(ids, pa.binary()), *([pa.array(decoded, pa.binary())] if decoded_col else [])]

    plain = docs.select(F.col(id_col), *keep, text_of(text_col).alias("_text"))
    kinds = {"token_ids": BinaryType()} | ({decoded_col: BinaryType()} if decoded_col else {})
    out = _with_columns(plain, kinds, encode)
    return out.drop("_text").withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast(LongType()))


def bpe_decode(tokens: DataFrame, ranks_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """tokens with out_col: the bytes that the ids of ids_col stand for.

    Null ids give no bytes; an id that the rank file lacks is an error.
    """
    prepare(tokens.sparkSession)
    with open(ranks_path, "rb") as f:
        held = tokens.sparkSession.sparkContext.broadcast(f.read())

    def decode(batch: pa.RecordBatch) -> list[pa.Array]:
        encoder = _encoder(held.value)
        return [pa.array([encoder.decode(x or b"") for x in batch.column(ids_col).to_pylist()], pa.binary())]

    return _with_columns(tokens, {out_col: BinaryType()}, decode)
