"""Packing documents into sequences of equal length: dominance reduction, then best fit."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import lookup, prepare, scratch, text_of, worker_state
from .token_files import WordEncoder


class Pattern(NamedTuple):
    """bins sequences that are filled alike: so many pieces of each length, in this order."""

    bins: int
    fill: tuple[tuple[int, int], ...]


def _largest(sizes: list[int], left: dict[int, int], room: int, taken: tuple[int, ...]) -> int:
    """The largest size up to room of which a piece is left besides those taken; 0 if there is none."""
    at = bisect_right(sizes, room) - 1
    while at >= 0 and left[sizes[at]] <= taken.count(sizes[at]):
        at -= 1
    return sizes[at] if at >= 0 else 0


def _least(sizes: list[int], left: dict[int, int], n: int, taken: int) -> int:
    """The sum of the n smallest pieces besides one of size taken; beyond any capacity if there are fewer."""
    total = 0
    for size in sizes:
        some = min(n, left[size] - (size == taken))
        total, n = total + some * size, n - some
        if not n:
            return total
    return 1 << 62


def _dominating(sizes: list[int], left: dict[int, int], size: int, capacity: int) -> tuple[int, ...] | None:
    """Pieces of at most three that, with one of this size among them, dominate every other set that holds it; None if none is known.

    A set dominates another if the other's pieces can be dealt into parts, each
    no larger than a piece of the first: then some best packing uses the first.
    """
    room = capacity - size
    one = _largest(sizes, left, room, (size,))
    if not one:
        return (size,)  # nothing fits beside it
    if one == room:
        return (size, one)  # whatever else fits beside it is no larger than this one piece
    if _least(sizes, left, 2, size) > room:
        return (size, one)  # one piece at most fits beside it, and this is the largest
    if _least(sizes, left, 3, size) <= room:
        return None
    # two pieces at most fit beside it: x and the smaller y
    two = _largest(sizes, left, room - one, (size, one))
    best_alone = best_pair = True  # one covers every x + y; one and two cover x and y
    for at in range(bisect_right(sizes, room // 2)):
        y = sizes[at]
        if left[y] <= (y == size):
            continue
        x = _largest(sizes, left, room - y, (size, y))
        if x >= y and x + y > one:
            best_alone = False
            best_pair = best_pair and y <= two
    if best_alone:
        return (size, one)
    return (size, one, two) if best_pair and two else None


def reduce_lengths(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that some best packing has, and the pieces that they leave.

    Martello and Toth's reduction on counts of pieces by length: a set that
    dominates all others with a piece is fixed, as often as its pieces allow,
    as taking pieces away never makes a dominated set better. Sizes are gone
    through from the largest to the smallest until a round fixes nothing.
    """
    left = {size: n for size, n in counts.items() if n > 0}
    fixed: list[Pattern] = []
    again = True
    while again and left:
        again = False
        sizes = sorted(left)
        for size in reversed(sizes[:]):
            while left.get(size):
                found = _dominating(sizes, left, size, capacity)
                if found is None:
                    break
                fill = {x: found.count(x) for x in sorted(found, reverse=True)}
                times = min(left[x] // n for x, n in fill.items())
                fixed.append(Pattern(times, tuple(fill.items())))
                again = True
                for x, n in fill.items():
                    left[x] -= times * n
                    if not left[x]:
                        del left[x]
                        sizes.pop(bisect_left(sizes, x))
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit of all pieces, the longest first, on counts by length.

    A piece goes to the open sequence with the least room that it fits. Such a
    sequence then has the least room still, so it takes pieces of this length
    until none fits; sequences filled alike are handled as one. Work and memory
    depend on the number of lengths, not of pieces.
    """
    open_by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_by_room[room].append(pattern)

    for size in sorted(counts, reverse=True):
        n = counts[size]
        filled: list[tuple[int, Pattern]] = []
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
            else:
                room, pattern = capacity, Pattern(n, ())
            each = room // size
            full = min(pattern.bins, n // each)
            if full:
                filled.append((room - each * size, Pattern(full, (*pattern.fill, (size, each)))))
            n -= full * each
            rest = pattern.bins - full
            if rest and n:
                filled.append((room - n * size, Pattern(1, (*pattern.fill, (size, n)))))
                rest, n = rest - 1, 0
            if rest and pattern.fill:
                put(room, Pattern(rest, pattern.fill))
        for room, pattern in filled:  # none of these has room for another of this size, or none is left
            put(room, pattern)
    return [p for some in open_by_room.values() for p in some]


def plan_sequences(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """How many sequences to fill with how many pieces of which lengths."""
    if any(not 0 < size <= capacity for size in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    fixed, left = reduce_lengths(counts, capacity)
    return [*fixed, *best_fit(left, capacity)]


class _Places:
    """Of each length: runs of ranks, and where their pieces go."""

    def __init__(self, plan: list[Pattern]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for bins, fill in plan:
            offset = 0
            for size, each in fill:
                runs.setdefault(size, []).append((used.get(size, 0), first, each, offset))
                used[size] = used.get(size, 0) + bins * each
                offset += size * each
            first += bins
        self.runs = {size: np.array(some, np.int64).T for size, some in runs.items()}

    def of(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence and offset of the pieces with these ranks among those of their size."""
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            start, first, each, at = self.runs[int(size)]
            run = np.searchsorted(start, ranks[mine], side="right") - 1
            within = ranks[mine] - start[run]
            sequence[mine] = first[run] + within // each[run]
            offset[mine] = at[run] + within % each[run] * size
        return sequence, offset


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, seq_len: int = 4096) -> DataFrame:
    """id, piece, start, length and token_ids (little-endian unsigned 32-bit) of every document's pieces.

    A document's ids are those that the library gives for its whole text (the
    string of an added token becomes its id), then end_id. More than seq_len of
    them are cut; only a document's last piece may be shorter. Null text counts
    as empty and is end_id alone. Rows that repeat an id are documents of their
    own. No rows give no rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        config = f.read()
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(config)
    tail = end_id.to_bytes(4, "little")
    schema = StructType([docs.schema[id_col], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("token_ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("words", hash(held.value), 4), lambda: WordEncoder(held.value, 4))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = encoder.encode_texts(part.column(1).to_pylist(), tail)
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                pieces = -(-sizes // seq_len)
                of = np.repeat(np.arange(len(ids)), pieces)
                number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * seq_len
                length = np.minimum(sizes[of] - start, seq_len)
                cut = [ids[d][4 * a : 4 * (a + n)] for d, a, n in zip(of.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(cut, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", by: tuple[str, ...] = ("doc_id", "piece"), *, slice_rows: int = 1_000_000, stats: dict | None = None) -> DataFrame:
    """pieces with sequence_id and offset: each piece's place in a sequence of at most capacity.

    As few sequences as best fit after dominance reduction makes. Pieces are
    counted by length; that table has at most capacity rows, and from it the
    driver makes the plan: how many sequences hold how many pieces of which
    lengths, in a size that does not grow with the number of pieces. Pieces are
    range-partitioned by (length, a hash of the columns by), so that pieces of
    one length, however many, are in many tasks, and are numbered within their
    length; a piece's number leads to its place in the plan. Offsets are gapless
    from 0, sequence ids from 0.

    stats, where given, gets the number of sequences, of those that the
    reduction fixed, and the least possible by the sum of lengths. A length
    that is null, below 1 or beyond capacity is an error. Rows that repeat are
    pieces of their own. Columns sequence_id and offset that pieces may have
    give way. No rows give no rows.
    """
    spark = pieces.sparkSession
    rows = scratch(pieces.drop("sequence_id", "offset"), "packing-pieces")
    size = F.col(length_col).cast("long")
    counted = rows.groupBy(F.when(size.between(1, capacity), size).alias("size")).agg(F.count("*").alias("n")).collect()  # at most capacity + 1 rows
    counts = {r.size: r.n for r in counted}
    if None in counts:
        raise ValueError("a piece is empty or longer than a sequence")
    plan = plan_sequences(counts, capacity)
    if stats is not None:
        stats |= {"sequences": sum(p.bins for p in plan), "fixed": sum(p.bins for p in reduce_lengths(counts, capacity)[0]), "least": -(-sum(s * n for s, n in counts.items()) // capacity)}
    places = spark.sparkContext.broadcast(_Places(plan))

    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) // slice_rows))
    keyed = rows.withColumn("_packing_size", size).withColumn("_packing_hash", F.xxhash64(*by)).withColumn("_packing_place", F.monotonically_increasing_id())
    order = ("_packing_size", "_packing_hash", *by, "_packing_place")
    ranged = keyed.repartitionByRange(slices, *order).sortWithinPartitions(*order).drop("_packing_hash", "_packing_place")
    # a row's number says its slice and its place in it
    ranged = scratch(ranged.withColumn("_packing_at", F.monotonically_increasing_id()).withColumn("_packing_slice", F.spark_partition_id()), "packing-ranged")
    firsts = ranged.groupBy("_packing_size", "_packing_slice").agg(F.min("_packing_at").alias("_packing_first"), F.count("*").alias("_packing_n"))  # a row for each slice and size in it
    ahead = Window.partitionBy("_packing_size").orderBy("_packing_slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = scratch(firsts.select("_packing_size", "_packing_slice", (F.coalesce(F.sum("_packing_n").over(ahead), F.lit(0)) - F.col("_packing_first")).alias("_packing_shift")), "packing-firsts")
    ranked = ranged.join(lookup(firsts), ["_packing_size", "_packing_slice"]).withColumn("_packing_rank", F.col("_packing_at") + F.col("_packing_shift")).select(*rows.columns, "_packing_size", "_packing_rank")
    prepare(spark)
    schema = StructType([*rows.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.value.of(batch.column("_packing_size").to_numpy(), batch.column("_packing_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *map(pa.array, found)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def gather_sequences(placed: DataFrame, ids_col: str = "token_ids") -> DataFrame:
    """sequence_id, length and token_ids of each sequence: its pieces' ids in the order of their offsets.

    A group is one sequence, so it holds capacity ids at most. Null ids are an error.
    """
    some = F.array_sort(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids"))))
    joined = F.aggregate(some, F.lit(b""), lambda got, x: F.concat(got, F.coalesce(x["ids"], F.raise_error(F.lit("a piece has no ids")).cast("binary"))))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias(ids_col))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, seq_len: int = 4096, stats: dict | None = None) -> DataFrame:
    """cut_pieces and place_pieces in one: every piece with its ids and its place. Give it to gather_sequences for whole sequences."""
    pieces = cut_pieces(docs, tokenizer_path, id_col, text_col, end_id=end_id, seq_len=seq_len)
    return place_pieces(pieces, seq_len, by=(id_col, "piece"), stats=stats)
