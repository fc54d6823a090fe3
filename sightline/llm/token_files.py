"""Token ids as Arrow files of fixed-size-list batches."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import filesystem_of, prepare, scratch, shared_path, stored_bytes, text_of, worker_state

#: Pieces of text whose ids a worker remembers.
CACHE = 400_000
#: Between words that go to the library together; a mark is a word of its own.
MARK = "!"
TOGETHER = 64
#: How the tokenizer normalises and cuts, and the same cut of lower-case text of Latin-1 characters.
NORMALISED = ["NFC", "Replace", "Lowercase"]
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\s\x85\xa0a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+", re.ASCII)

#: ASCII punctuation that no normalisation makes of another character.
PUNCTUATION = re.compile(r"[!-/:<-@\[-_{-~]+")


def _cuts_so(config: str) -> bool:
    """Whether the tokenizer has the cut for which PIECES stands."""
    try:
        read = json.loads(config)
        return [x["type"] for x in read["normalizer"]["normalizers"]] == NORMALISED and read["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": CUT}
    except (KeyError, IndexError, TypeError):
        return False


def added_strings(config: str) -> list[str]:
    """What a text must hold, letter for letter, to hold the string of an added token.

    The tokenizer may look for the string after normalising, which changes
    letters and spaces but makes no punctuation; so the string's longest run of
    that is looked for. A string without any makes "" of it: any text may hold it.
    """
    runs = (max(PUNCTUATION.findall(x["content"]), key=len, default="") for x in json.loads(config).get("added_tokens") or ())
    return sorted(set(runs))


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases and drops white space.

    A text of Latin-1 characters, which no normalisation changes but lower-casing,
    is cut into the tokenizer's own pre-tokens here; another at spaces and newlines, which
    end a pre-token too. Ids of pieces are remembered; the pieces that a batch of
    texts brings in anew go to the library in few calls, words of letters many
    to a text with a mark between them. A text that may hold the string of an
    added token goes to the library whole, which knows how to cut it out.
    """

    def __init__(self, config: str, width: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the workers are the parallelism
        self.tokenizer = Tokenizer.from_str(config)
        self.added = added_strings(config)
        self.dtype = np.dtype(f"<u{width}")
        self.pieces: dict[str, bytes] = {"": b""}
        self.mark = self._encode([MARK])[0]
        self.known = len(self.mark) == width and _cuts_so(config)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 2000):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[k : k + 2000], add_special_tokens=False)]
        return out

    def _encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        plain = [w for w in pieces if w.isalpha()] if self.known else []
        other = [w for w in pieces if not w.isalpha()] if self.known else pieces
        yield from zip(other, self._encode(other), strict=True)
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self._encode([f" {MARK} ".join(g) for g in groups]), strict=True):
            size = self.dtype.itemsize
            marks = np.flatnonzero(np.frombuffer(ids, self.dtype) == int.from_bytes(self.mark, "little")) * size
            if len(marks) != len(group) - 1:
                raise ValueError("the tokenizer does not keep words apart")
            yield from ((w, ids[a:b]) for w, a, b in zip(group, [0, *(marks + size).tolist()], [*marks.tolist(), len(ids)], strict=True))

    def _cut(self, text: str) -> list[str]:
        if self.known:
            try:
                text.isascii() or text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return PIECES.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def encode_texts(self, texts: list[str], tail: bytes) -> list[bytes]:
        whole = [k for k, x in enumerate(texts) if any(sign in x for sign in self.added)]
        cut = list(map(self._cut, texts)) if not whole else [() if any(sign in x for sign in self.added) else self._cut(x) for x in texts]
        held = self.pieces
        held.update(self._encode_pieces(list(set(chain.from_iterable(cut)).difference(held))))
        out = [b"".join([*map(held.__getitem__, some), tail]) for some in cut]
        for k, ids in zip(whole, self._encode([texts[k] for k in whole]), strict=True):
            out[k] = ids + tail
        for _ in range(len(held) - CACHE):  # the latest came in for the rarest
            held.popitem()
        return out


def encode_words(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int | None = None) -> tuple[DataFrame, int]:
    """id and packed token_ids of each row's whole text, and the bytes an id takes.

    The tokenizer must drop white space. Ids take two bytes where the
    vocabulary and end_id allow, else four, little-endian. end_id, where given, ends each text.
    The ids are those that the library gives by default: the string of an added
    token in a text, such as <|endoftext|>, becomes its id. Null text counts as empty.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        config = f.read()
    width = 2 if max(Tokenizer.from_str(config).get_vocab_size(with_added_tokens=True), end_id or 0) < 1 << 16 else 4
    tail = b"" if end_id is None else end_id.to_bytes(width, "little")
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("words", hash(held.value), width), lambda: WordEncoder(held.value, width))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = encoder.encode_texts(part.column(1).to_pylist(), tail)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=[id_col, "token_ids"])

    plain = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    schema = StructType([docs.schema[id_col], StructField("token_ids", BinaryType())])
    return plain.mapInArrow(run, schema), width


class _SequenceFile:
    """Writes a stream of ids as rows of length ids with a mask, some rows a batch."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, length: int, rows: int, width: int):
        self.length, self.rows, self.dtype = length, rows, np.dtype(f"<u{width}")
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("token_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held: list[bytes] = []
        self.bytes = self.n = 0

    def add(self, ids: bytes) -> int:
        """Returns the number of ids before these."""
        start = self.n
        self.n += len(ids) // self.dtype.itemsize
        self.held.append(ids)
        self.bytes += len(ids)
        if self.bytes >= self.length * self.rows * self.dtype.itemsize:
            self._flush(False)
        return start

    def _flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.held), self.dtype)
        step = self.length * self.rows
        whole = len(data) // step * step
        for k in range(0, whole, step):
            self._batch(data[k : k + step], step)
        rest = data[whole:]
        if last and len(rest):
            self._batch(rest, -(-len(rest) // self.length) * self.length)
            rest = rest[:0]
        self.held, self.bytes = [rest.tobytes()], rest.nbytes

    def _batch(self, ids: np.ndarray, size: int) -> None:
        full = np.zeros(size, self.dtype)
        full[: len(ids)] = ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, np.arange(size) < len(ids))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.out.close()


def write_sequences(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, seq_len: int = 1024, batch_rows: int = 256, part_bytes: int = 1 << 27) -> DataFrame:
    """Encode docs, write their ids in ascending id order, and return the index of the files.

    The rows are range-partitioned and sorted by id, so a file holds a run of
    ids and the files follow one another by their number part. There are about
    part_bytes of stored text to a file, and at least as many files as the
    session has shuffle partitions. A file is an Arrow IPC file: fixed-size
    lists of seq_len ids with a mask, batch_rows to a batch, the end of the last
    filled up with 0 and masked out. Any sequence is reached by the batch number
    without reading others. Batches have equal lengths, so memory mapping needs
    no copy.

    Index rows: part, file, id, local_start (ids before it in the file),
    n_tokens. Every attempt of a task writes a file of its own name; only files
    of the attempt that Spark commits are in the index. Null ids come first.
    Rows with the same id are in the order of a hash of their texts, then of
    their place in docs, and may lie in several files, so an id that many rows
    repeat is in no one task. Null text counts as empty and gives end_id alone.
    No rows give no files and an empty index.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "sequences")
    plain = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(plain, unknown=0) // part_bytes))
    keyed = plain.withColumn("_hash", F.xxhash64("_text")).withColumn("_place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(parts, "_id", "_hash", "_place").sortWithinPartitions("_id", "_hash", "_place").select("_id", "_text")
    encoded, width = encode_words(ordered, tokenizer_path, "_id", "_text", end_id=end_id)
    schema = StructType([StructField("part", IntegerType()), StructField("file", StringType()), StructField("_id", docs.schema[id_col].dataType), StructField("local_start", LongType()), StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        out = None
        for batch in batches:
            if out is None and batch.num_rows:
                fs, path = filesystem_of(file)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = _SequenceFile(fs, path, seq_len, batch_rows, width)
            ids = batch.column(1).to_pylist()
            starts = [out.add(x) for x in ids]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.string()), batch.column(0), pa.array(starts, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64())], names=schema.names)
        if out is not None:
            out.close()

    return scratch(encoded.mapInArrow(run, schema), "sequence-index").withColumnRenamed("_id", id_col)


def open_sequences(file: str) -> pa.ipc.RecordBatchFileReader:
    """A reader of a file of sequences. Where the file lies on a local or mounted path it is mapped, and its
    batches are views of the map: nothing of it is read or copied until it is looked at."""
    fs, path = filesystem_of(file)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path))


def sequence_at(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, pa.Array]:
    """Ids and mask of one sequence by its number in the file, as views of its batch; no other batch is read."""
    step = reader.get_batch(0).num_rows
    batch = reader.get_batch(number // step)
    row = number % step
    return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values


def read_sequences(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and token_ids (unsigned 32-bit) of each indexed row, from the files.

    start counts the ids of all rows before it, in all files.
    """
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # a row for each file
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch(sums.select("part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset")), "sequence-offsets")
    prepare(index.sparkSession)
    placed = index.join(F.broadcast(offsets), "part").select(F.col(id_col).alias("_id"), (F.col("_offset") + F.col("local_start")).alias("start"), "n_tokens", "file", "local_start")
    schema = StructType([StructField("_id", index.schema[id_col].dataType), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("token_ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader, held = None, None, (-1, None)
        for batch in batches:
            out = []
            for file, start, n in zip(*(batch.column(k).to_pylist() for k in ("file", "local_start", "n_tokens")), strict=True):
                if file != opened:
                    reader, opened, held = open_sequences(file), file, (-1, None)
                    rows = reader.get_batch(0).num_rows
                    length = reader.schema.field(0).type.list_size
                    step = length * rows if reader.num_record_batches > 1 else 1 << 62
                parts = []
                while n > 0:
                    k, at = divmod(start, step)
                    if held[0] != k:
                        column = reader.get_batch(k)
                        held = (k, (column.column(0).flatten().to_numpy(), column.column(1).flatten()))
                    ids, mask = held[1]
                    some = min(n, len(ids) - at)
                    if some <= 0 or mask.slice(at, some).false_count:
                        raise ValueError(f"{file} has no ids at {start}")
                    parts.append(ids[at : at + some])
                    start, n = start + some, n - some
                out.append(np.concatenate(parts).astype("<u4").tobytes() if parts else b"")
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.binary())], names=schema.names)

    return placed.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def crc32_of(tokens: DataFrame, ids_col: str = "token_ids") -> DataFrame:
    """tokens with ids_crc32 in place of the ids."""
    return tokens.withColumn("ids_crc32", F.crc32(ids_col)).drop(ids_col)
