"""Near-duplicate groups: SuperMinHash, banding, verification, union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..operators.graph import components
from .common import SPACE_CLASS, lookup, maybe_member, member_bits, prepare, scratch, text_of, worker_state

BANDS, BAND_ROWS = 40, 5
SLOTS = BANDS * BAND_ROWS
#: Bits of the one-bit sketch, in 64-bit words.
SKETCH = -(-SLOTS // 64)
FILTER_BITS = 1 << 23
#: Members of a block, and elements of all their sets, that one task holds of a bucket at a time.
BLOCK, BLOCK_ELEMENTS = 512, 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S27, _S30, _S31, _S16, _S48 = (np.uint64(x) for x in (27, 30, 31, 16, 48))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of width words.

    Fewer words make one shingle of all of them; no words make none.
    """
    n = len(words)
    if n == 0:
        return words
    size = min(n, width)
    with np.errstate(over="ignore"):
        h = np.full(n - size + 1, np.uint64(size) * _A)
        for k in range(size):
            h = _mix(h + words[k : n - size + 1 + k] + _A)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def super_minhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit hashes, as whole numbers.

    Each element has a random permutation of the slots. At its j-th step it
    offers j + r, r a fresh fraction, to the j-th slot of that permutation;
    every slot keeps its least offer, the upper 16 bits of which are the rank j
    and the lower 48 the fraction. The permutations are drawn step by step, for
    all elements at once; as no later offer can be less than j + 1, drawing
    stops once all slots are below that.
    """
    signature = np.full(slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    if not len(elements):
        return signature
    rows = np.arange(len(elements))
    order = None
    with np.errstate(over="ignore"):
        for j in range(slots):
            random = _mix(elements + np.uint64(2 * j + 1) * _A)
            k = j + (random % np.uint64(slots - j)).astype(np.int64)
            if j == 0:
                at, first = k, k
            else:
                if order is None:
                    order = np.tile(np.arange(slots, dtype=np.int32), (len(elements), 1))
                    order[rows, first], order[:, 0] = 0, first
                at = order[rows, k]
                order[rows, k] = order[:, j]
                order[:, j] = at
            offer = (np.uint64(j) << _S48) | (_mix(random + _A) >> _S16)
            np.minimum.at(signature, at, offer)
            if signature.max() < np.uint64(j + 1) << _S48:
                break
    return signature


def _bands(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = _mix(np.arange(BANDS, dtype=np.uint64) * _A + _B)
        for k in range(BAND_ROWS):
            h = _mix(h + signature[k::BAND_ROWS] + _A)
    return h.view(np.int64)


def _sketch(signature: np.ndarray) -> np.ndarray:
    bits = np.zeros(SKETCH * 64, np.uint8)
    bits[: len(signature)] = (_mix(signature) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view("<i8")


def _digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    """Slices of the batches, and the shingle sets of their rows."""
    worker_state("near", dict)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            lists = part.column(1)
            offsets = lists.offsets.to_numpy()
            words = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            yield part, [shingle_set(words[a:b], width) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _word_hashes(text: Column) -> Column:
    lower = F.translate(text, UPPER, LOWER)
    return F.transform(F.filter(F.split(lower, SPACE_CLASS + "+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.array([len(x) for x in arrays], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], sizes.cumsum())), pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), kind))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for at, end in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(c[at] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(group: pa.Table, percent: int, least_agreement: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a block pair that no link joins, that sizes and sketches allow
    and that share no band before this one."""
    n, root, side = (group.column(c).to_numpy() for c in ("n", "root", "side"))
    sketch = group.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(n), SKETCH)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(two)  # a block with itself
    two = one if within else two
    agree = np.full((len(one), len(two)), SLOTS, np.int16)
    for k in range(SKETCH):
        agree -= np.bitwise_count(sketch[one, k][:, None] ^ sketch[two, k][None, :])
    small, large = np.minimum(n[one][:, None], n[two][None, :]), np.maximum(n[one][:, None], n[two][None, :])
    open_ = (agree >= least_agreement) & (100 * small >= percent * large) & (root[one][:, None] != root[two][None, :])
    x, y = np.nonzero(np.triu(open_, 1) if within else open_)
    x, y = one[x], two[y]
    if len(x):
        band, bands = group.column("band")[0].as_py(), [frozenset(b) for b in group.column("bands").to_pylist()]
        here = np.fromiter((min(bands[i] & bands[j]) == band for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
        x, y = x[here], y[here]
    return x, y


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns of keep, n_shingles, component_id, kept, group.

    Words are split at white space (space and TAB to CR) and A-Z lower-cased; a
    text's set holds its distinct shingles of shingle_words words, or, of a
    shorter text, all its words as one shingle. Two texts are linked when
    100 * intersection >= percent * union; component_id is the least id that
    links lead to and kept tells whether it is the row's own. group is equal
    for the rows of a component and null for those that take no part.

    Texts with equal sets form a class, spoken for by its least id. Classes that
    agree in all rows of a band of their SuperMinHash signatures share a
    bucket; at a similarity of 0.8 a pair misses all of the 40 bands of 5 rows
    with a chance of 1.3e-7. A bucket's pivot is the class that meets most others.
    Every class is compared with the highest of its pivots, then with those
    that no link joins to it yet. In buckets that still hold several components, members
    outside the largest are compared with all that are not linked to them,
    so no pair of a bucket is left out unless links join it already: such a
    bucket is cut into blocks, every pair of blocks is a group of its own, the
    sketches of a group tell which members may be similar, and only their sets
    are sent to it. Buckets of equal members are compared once, and so are pairs
    that meet in several. Pairs go
    on if the sizes of their sets allow the similarity and a one-bit sketch of
    200 bits agrees in 156 (expected at 0.8: 180, deviation 3.6); then the full sets decide (64-bit
    hashes of shingles). Nothing is capped.

    Null text, empty text and white space have an empty set and are linked with
    nothing. Null ids take no part in links, have no component and stay. Rows
    that repeat an id are taken one by one; classes that one id speaks for stay
    apart, though their component_id may be the same id. No rows give no rows.
    Other columns are ignored.
    """
    if not 75 <= percent <= 100:
        raise ValueError("the bands are made for 75 to 100 percent")
    least_agreement = 156 if percent >= 80 else 150
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    extra = [f"keep_{k}" for k in range(len(keep))]
    source = docs.select(F.col(id_col).alias("id"), _word_hashes(text_of(text_col)).alias("_words"), *(F.col(c).alias(e) for c, e in zip(keep, extra, strict=True)))
    carried = [StructField(e, docs.schema[c].dataType) for c, e in zip(keep, extra, strict=True)]
    schema = StructType([StructField("id", id_type), StructField("n", LongType()), StructField("digest", BinaryType()), StructField("sketch", ArrayType(LongType())), StructField("bands", ArrayType(LongType())), *carried])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, shingle_words):
            signatures = [super_minhash(x) if len(x) else None for x in sets]
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()),
                _lists([none if s is None else _sketch(s) for s in signatures], pa.int64()), _lists([none if s is None else _bands(s) for s in signatures], pa.int64()), *part.columns[2:],
            ], names=schema.names)

    signed = scratch(source.mapInArrow(sign, schema), "near-signed")
    some = signed.where("n > 0 and id is not null")
    classes = scratch(some.groupBy("digest", "n").agg(F.min("id").alias("lead")), "near-classes")
    # a class is known by the id that speaks for it; if an id speaks for several, by the digest too
    several = bool(classes.groupBy("lead").count().where("count > 1").limit(1).count())
    classes = classes.select("digest", "n", "lead", (F.struct("lead", "digest") if several else F.col("lead")).alias("rep"))
    id_of = (lambda node: F.col(f"{node}.lead")) if several else F.col
    leads = some.join(classes.select("digest", "lead", "rep"), (F.col("id") == F.col("lead")) & (some["digest"] == classes["digest"])).select("rep", "n", "sketch", "bands")

    # buckets: bands that two classes share
    in_bands = scratch(leads.select("rep", "n", "sketch", F.explode("bands").alias("band")), "near-bands")
    n_classes = classes.count()
    if in_bands.count() != BANDS * n_classes:  # rows repeat id and text
        in_bands = scratch(in_bands.dropDuplicates(["rep", "band"]), "near-bands")
    shared = scratch(in_bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "near-shared", 20 * n_classes)
    bits = scratch(member_bits(shared, ["band"], FILTER_BITS), "near-bits", FILTER_BITS // 64)
    members = maybe_member(in_bands, bits, ["band"], FILTER_BITS).join(lookup(shared), "band")
    members = scratch(members.select("band", "size", "rep", "n", "sketch"), "near-members")

    # a bucket's pivot is the class that meets most others, in all of its buckets
    met = scratch(members.groupBy("rep").agg(F.sum("size").alias("met"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-met", n_classes)
    ranked = members.select("band", "rep").join(lookup(met.select("rep", "met")), "rep")
    pivots = scratch(ranked.groupBy("band").agg(F.min(F.struct((-F.col("met")).alias("m"), F.col("rep"))).alias("p")).select("band", F.col("p.rep").alias("pivot"), F.col("p.m").alias("rank")), "near-pivots", 20 * n_classes)
    stars = members.select("band", "rep").join(lookup(pivots), "band").where("rep <> pivot")
    stars = scratch(stars.groupBy("rep", "pivot").agg(F.min("rank").alias("rank")), "near-stars", BANDS * n_classes)

    # the full sets of all classes that share a bucket
    wanted = scratch(member_bits(met.select(id_of("rep").alias("id")), ["id"], FILTER_BITS), "near-wanted", FILTER_BITS // 64)
    held = StructType([StructField("id", id_type), StructField("digest", BinaryType()), StructField("set", ArrayType(LongType()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, shingle_words):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(x) for x in sets], pa.binary()), _lists([x.view(np.int64) for x in sets], pa.int64())], names=held.names)

    plain = maybe_member(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_text")), wanted, ["id"], FILTER_BITS)
    sets = plain.select("id", _word_hashes(F.col("_text")).alias("_words")).mapInArrow(gather, held)
    sets = sets.join(classes.select("digest", "lead", "rep"), (sets["id"] == classes["lead"]) & (sets["digest"] == classes["digest"])).select(F.col("rep").alias("id"), "set")
    sets = scratch(sets if not several else sets.dropDuplicates(["id"]), "near-sets")

    def may_match(a: str, b: str) -> Column:
        agree = F.lit(SLOTS)
        for k in range(SKETCH):
            agree = agree - F.expr(f"bit_count({a}.sketch[{k}] ^ {b}.sketch[{k}])")
        small, large = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
        return (100 * small >= percent * large) & (agree >= least_agreement)

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        pairs = scratch(pairs, f"near-{label}-pairs")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("_x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("_y")), "b")
        inter = F.size(F.array_intersect("_x", "_y")).cast("long")
        both = both.select("a", "b", inter.alias("_i"), (F.size("_x") + F.size("_y")).cast("long").alias("_s"))
        # no distinct: it would tie the rows of a pivot to one task, and repeats do no harm
        return scratch(both.where(100 * F.col("_i") >= percent * (F.col("_s") - F.col("_i"))).select("a", "b"), f"near-{label}-links")

    def likely_stars(pairs: DataFrame) -> DataFrame:
        """Of pairs (rep, pivot), those (a, b) that sizes and sketches allow."""
        x = met.select(F.col("rep"), F.struct("n", "sketch").alias("x"))
        y = met.select(F.col("rep").alias("pivot"), F.struct("n", "sketch").alias("y"))
        return pairs.select("rep", "pivot").join(x, "rep").join(y, "pivot").where(may_match("x", "y")).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))

    def rooted(of: DataFrame, roots: DataFrame, label: str) -> DataFrame:
        return scratch(of.join(lookup(roots), of["rep"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "rep")), f"near-{label}-rooted", BANDS * n_classes)

    def with_more(roots: DataFrame, more: DataFrame) -> DataFrame:
        """The roots when more links come in: a tree of each component stands for its links."""
        if not more.limit(1).count():
            return roots
        joined = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b")
        return scratch(joined, "near-roots", n_classes)

    # first every class with its highest pivot, then with pivots that are not linked to it yet
    best = stars.groupBy("rep").agg(F.min(F.struct("rank", "pivot")).alias("p")).select("rep", F.col("p.pivot").alias("pivot"))
    roots = scratch(components(verified(likely_stars(best), "best"), "a", "b"), "near-roots", n_classes)
    placed = rooted(stars, roots, "best")
    other = placed.join(lookup(roots.select(F.col("node").alias("pivot"), F.col("root").alias("to"))), "pivot", "left").where(F.col("root") != F.coalesce("to", "pivot"))
    roots = with_more(roots, verified(likely_stars(other), "star"))

    # then, in buckets that hold several components, all that no link joins yet
    placed = rooted(members.join(lookup(pivots.select("band", "pivot")), "band").where("rep <> pivot").drop("size", "pivot"), roots, "star")
    placed = scratch(placed.withColumn("_h", F.xxhash64("rep", F.lit(11))).withColumn("root", F.xxhash64("root")), "near-placed")
    by_root = placed.groupBy("band", "root").agg(F.count("*").alias("_c"), F.sum("n").alias("_s"), F.bit_xor("_h").alias("_x"), F.sum(F.shiftright("_h", 34)).alias("_y"))
    unsettled = by_root.groupBy("band").agg(
        F.count("*").alias("_roots"), F.max(F.struct("_c", "root")).alias("_most"), F.sum("_c").alias("_c"), F.sum("_s").alias("_s"), F.bit_xor("_x").alias("_x"), F.sum("_y").alias("_y"),
    ).where("_roots > 1")
    unsettled = unsettled.groupBy("_c", "_x", "_y").agg(F.min("band").alias("band"), F.first("_most").alias("_most"), F.first("_s").alias("_s"))
    # strays, outside the largest component, are cut into blocks, and so are the members of that
    in_blocks = lambda c: F.greatest(F.ceil(c / BLOCK), F.ceil(F.col("_s") / BLOCK_ELEMENTS)).cast("int")
    unsettled = scratch(unsettled.select("band", F.col("_most.root").alias("most"), in_blocks(F.col("_c") - F.col("_most._c")).alias("_strays"), in_blocks(F.col("_most._c")).alias("_others")), "near-unsettled", 20 * n_classes)
    left = placed.join(lookup(unsettled), "band")
    # a pair that meets in several bands is compared in the first; a class has BANDS of them at most
    in_all = scratch(left.groupBy("rep").agg(F.sort_array(F.collect_list("band")).alias("bands")), "near-left-bands", n_classes)
    left = left.join(lookup(in_all), "rep")
    upto = lambda c, start=0: F.sequence(F.lit(start), F.col(c) + start - 1)
    stray = F.col("root") != F.col("most")
    block = F.pmod(F.shiftright("_h", 8), F.when(stray, F.col("_strays")).otherwise(F.col("_others"))).cast("int")
    left = left.select("band", "rep", "n", "sketch", "root", "bands", stray.alias("_stray"), block.alias("_b"), "_strays", "_others")
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
    with_strays = F.transform(upto("_strays"), lambda k: pair(F.least("_b", k), F.greatest("_b", k), k < F.col("_b")))
    with_others = F.transform(upto("_others"), lambda k: pair(F.col("_b"), F.col("_strays") + k, 0))
    to_strays = F.transform(upto("_strays"), lambda k: pair(k, F.col("_strays") + F.col("_b"), 1))
    left = left.withColumn("_p", F.explode(F.when(F.col("_stray"), F.concat(with_strays, with_others)).otherwise(to_strays)))
    key = ("band", "i", "j")
    left = left.select("band", "_p.i", "_p.j", "_p.side", "rep", "n", "sketch", "root", "bands")

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(*key).sortWithinPartitions(*key, "side")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members that may be similar to another of their group."""
        for group in _groups(batches, key):
            x, y = _open_pairs(group, percent, least_agreement)
            if len(x):
                yield from group.take(pa.array(np.union1d(x, y))).combine_chunks().to_batches()

    some = scratch(in_order(left).mapInArrow(screen, left.schema), "near-screened")
    some = some.join(sets.withColumnRenamed("id", "rep"), "rep").select(*left.columns, "set")
    link_type = StructType([StructField("a", left.schema["rep"].dataType), StructField("b", left.schema["rep"].dataType)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each group; where links lead from one to the other already, no more."""
        for group in _groups(batches, key):
            x, y = _open_pairs(group, percent, least_agreement)
            lists = group.column("set").combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            roots = group.column("root").to_numpy().tolist()
            upper = {r: r for r in roots}
            found: list[tuple[int, int]] = []
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                p, q = roots[i], roots[j]
                while upper[p] != p:
                    p = upper[p]
                while upper[q] != q:
                    q = upper[q]
                if p == q:
                    continue
                one, two = flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]]
                place = np.searchsorted(two, one)
                place[place == len(two)] = 0
                if (100 + percent) * int((two[place] == one).sum()) >= percent * (len(one) + len(two)):
                    upper[p] = q
                    found.append((i, j))
            if found:
                reps = group.column("rep").combine_chunks()
                yield pa.RecordBatch.from_arrays([reps.take(pa.array([i for i, _ in found])), reps.take(pa.array([j for _, j in found]))], names=link_type.names)

    rest = in_order(some).mapInArrow(compare, link_type).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    roots = with_more(roots, scratch(rest, "near-rest"))

    # from classes to rows; a row's class is known by its digest
    named = scratch(classes.join(lookup(roots), classes["rep"] == roots["node"], "left").select("digest", F.coalesce("root", "rep").alias("root")), "near-named", n_classes)
    rows = signed.select("id", "n", "digest", *extra)
    takes_part = F.col("id").isNotNull() & (F.col("n") > 0)
    joined = rows.where(takes_part).join(lookup(named), "digest", "left").select("id", *extra, "n", id_of("root").alias("to"), F.col("root").alias("group"))
    nothing = F.lit(None).cast(joined.schema["group"].dataType)
    joined = joined.unionByName(rows.where(~takes_part).select("id", *extra, "n", F.col("id").alias("to"), nothing.alias("group")))
    return joined.select(F.col("id").alias(id_col), *(F.col(e).alias(c) for c, e in zip(keep, extra, strict=True)), F.col("n").alias("n_shingles"), F.col("to").alias("component_id"), F.col("id").eqNullSafe(F.col("to")).alias("kept"), "group")
