"""Directed graphs in few rounds: trimming from both ends, and paths shortened by pointer doubling."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import lookup, scratch

#: A round of trimming that leaves more than this share of the edges is followed by shortening.
SLOW = 0.5
#: Layers that a closure goes through one by one before it shortens paths.
PLAIN_LAYERS = 8


class Settled(NamedTuple):
    """Nodes (column node) that lie on cycles or between them, the edges of the longest path, and the rounds it took."""

    cyclic: DataFrame
    longest: int
    rounds: int


def shortened(pointers: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Follow pointers to their ends: u, to, d, most of each that ends, the others, and the rounds.

    pointers has u (once each), to, d (length of the step) and most (a value of
    u). An end is a node that has no pointer itself. The d of a result is the
    length of the way, most the greatest of the values on the way, each with the
    way to it added. Every round doubles what a pointer spans, and only pointers
    that have not ended go into it; those that have not after
    log2 of their number rounds lead into a cycle.
    """
    marked = pointers.join(lookup(scratch(pointers.select(F.col("u").alias("_at"), F.lit(True).alias("_open")), "pointer-nodes")), F.col("to") == F.col("_at"), "left")
    table = scratch(marked.select("u", "to", "d", "most", F.coalesce("_open", F.lit(False)).alias("open")), "pointers")
    ended, rounds, spans = [table.where("not open")], 0, 1
    going = table.where("open")
    left = going.count()
    n = left
    while left and spans <= n:
        rounds += 1
        spans *= 2
        # where an open pointer leads has a pointer too: one that has ended, or one that is open
        known = ended[0]
        for more in ended[1:]:
            known = known.unionByName(more)
        onward = known.unionByName(going).select(F.col("u").alias("_at"), F.col("to").alias("_to"), F.col("d").alias("_d"), F.col("most").alias("_most"), F.col("open").alias("_open"))
        step = going.join(onward, F.col("to") == F.col("_at")).select("u", F.col("_to").alias("to"), (F.col("d") + F.col("_d")).alias("d"), F.greatest(F.col("most"), F.col("d") + F.col("_most")).alias("most"), F.col("_open").alias("open"))
        step = scratch(step, "pointers", n)
        ended.append(step.where("not open"))
        going = step.where("open")
        left = going.count()
    done = ended[0]
    for more in ended[1:]:
        done = done.unionByName(more)
    return done.drop("open"), going.drop("open"), rounds


def _nodes(edges: DataFrame, *known: DataFrame) -> DataFrame:
    """node, n_out, n_in, base, top of the ends of edges and of known nodes; known tables have node, base, top."""
    none = F.lit(None).cast("long")
    rows = edges.select(F.col("s").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), none.alias("base"), none.alias("top"))
    rows = rows.union(edges.select("t", F.lit(0), F.lit(1), none, none))
    for table in known:
        rows = rows.union(table.select("node", F.lit(0), F.lit(0), "base", "top"))
    return rows.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.coalesce(F.max("base"), F.lit(0)).cast("long").alias("base"), F.coalesce(F.max("top"), F.lit(0)).cast("long").alias("top"))


def _kept(nodes: DataFrame) -> tuple[DataFrame, int]:
    """The nodes that still have edges, and the longest path that runs through any of them."""
    nodes = scratch(nodes, "dag-nodes")
    return nodes.where("n_out + n_in > 0"), _greatest(nodes, F.col("base") + F.col("top"))


def _flipped(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    back = edges.select(F.col("t").alias("s"), F.col("s").alias("t"), "w")
    return back, nodes.select("node", F.col("n_in").alias("n_out"), F.col("n_out").alias("n_in"), F.col("top").alias("base"), F.col("base").alias("top"))


def _greatest(df: DataFrame, value: Column) -> int:
    return df.agg(F.coalesce(F.max(value), F.lit(0))).first()[0]


def _without_single_ways(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, int, int, DataFrame]:
    """Take out the nodes that one edge leaves: every path through them goes on to where that edge leads.

    Returns edges, nodes, the longest path met, rounds, and nodes that lead into a cycle of such nodes.
    """
    single = scratch(nodes.where("n_out = 1").select(F.col("node").alias("u"), "base", "top"), "dag-single")
    pointers = scratch(edges.join(lookup(single), F.col("s") == F.col("u")).select("u", F.col("t").alias("to"), F.col("w").alias("d"), F.col("top").alias("most"), "base"), "dag-pointers")
    done, cyclic, rounds = shortened(pointers.drop("base"))
    ends = scratch(done.join(lookup(single.select(F.col("u").alias("_u"), "base")), F.col("u") == F.col("_u")).drop("_u"), "dag-ends")
    longest = max(_greatest(ends, F.col("base") + F.col("most")), _greatest(ends, F.col("base") + F.col("d")))
    gone = lookup(scratch(single.select(F.col("u").alias("s")), "dag-gone"))
    rest = edges.join(gone, "s", "left_anti")
    to = ends.select(F.col("u").alias("t"), F.col("to").alias("_to"), F.col("d").alias("_d"), F.col("most").alias("_most"))
    bad = scratch(cyclic.select(F.col("u").alias("node")), "dag-cyclic")
    rest = rest.join(lookup(bad.select(F.col("node").alias("t"))), "t", "left_anti").join(lookup(scratch(to, "dag-to")), "t", "left")
    rest = scratch(rest.select("s", F.coalesce("_to", "t").alias("t"), (F.col("w") + F.coalesce("_d", F.lit(0))).alias("w"), (F.col("w") + F.col("_most")).alias("top")), "dag-rest")
    none = F.lit(None).cast("long")
    made = scratch(rest.groupBy("s", "t").agg(F.max("w").alias("w")), "dag-edges")
    tops = rest.where("top is not null").select(F.col("s").alias("node"), none.alias("base"), "top")
    bases = ends.select(F.col("to").alias("node"), (F.col("base") + F.col("d")).alias("base"), none.alias("top"))
    nodes, through = _kept(_nodes(made, nodes, tops, bases))
    return made, nodes, max(longest, through), rounds, bad


def settle(edges: DataFrame, source: str, target: str, *, stop_at_cycle: bool = False) -> Settled:
    """Whether directed edges have cycles, and how long their longest path is.

    A round trims: nodes that no edge leads to and nodes that no edge leaves go,
    both in one round, and tell their neighbours the longest path up to them or
    from them. Where that takes away little, nodes that one edge leaves (then
    nodes that one edge enters) are taken out whole paths at a time by pointer
    doubling, the lengths being kept on the edges. A chain of n nodes takes
    about log2 n rounds, and a closed one is known for a cycle in the first
    round, as nothing can be trimmed. Where all layers are wide and interlinked,
    two layers go in a round.

    What cannot be trimmed nor shortened holds a cycle; with stop_at_cycle the
    first such finding ends the work and longest is what was met so far. Edges
    may repeat; an edge from a node to itself is a cycle. Nodes must not be
    null and may be structs. No edges have no cycle and a longest path of 0.
    """
    edges = edges.select(F.col(source).alias("s"), F.col(target).alias("t"), F.lit(1).cast("long").alias("w")).distinct()
    edges = scratch(edges, "dag-edges")
    bad = [edges.where("s = t").select(F.col("s").alias("node"))]
    edges = edges.where("s <> t")
    nodes = scratch(_nodes(edges), "dag-nodes")
    longest = rounds = 0
    count = edges.count()

    def found(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for more in tables[1:]:
            out = out.unionByName(more)
        return out.distinct()

    while count:
        rounds += 1
        about = lookup(nodes)
        left = about.select(F.col("node").alias("s"), (F.col("n_in") == 0).alias("first"), "base")
        right = about.select(F.col("node").alias("t"), (F.col("n_out") == 0).alias("last"), "top")
        met = scratch(edges.join(left, "s").join(right, "t"), "dag-met")
        longest = max(longest, _greatest(met, F.col("base") + F.col("w") + F.col("top")))
        none = F.lit(None).cast("long")
        told = [met.where("first").select(F.col("t").alias("node"), (F.col("base") + F.col("w")).alias("base"), none.alias("top")), met.where("last").select(F.col("s").alias("node"), none.alias("base"), (F.col("top") + F.col("w")).alias("top"))]
        edges = met.where("not first and not last").select("s", "t", "w")
        now = edges.count()
        if now == count and stop_at_cycle:
            return Settled(found([*bad, edges.select(F.col("s").alias("node"))]), longest, rounds)
        nodes, through = _kept(_nodes(edges, nodes, *told))
        longest = max(longest, through)
        if now <= SLOW * count:
            count = now
            continue
        before, trimmed = now, now < count
        for flip in (False, True):
            if flip:
                edges, nodes = _flipped(edges, nodes)
            edges, nodes, met_now, some, cyclic = _without_single_ways(edges, nodes)
            longest, rounds = max(longest, met_now), rounds + some
            loops = edges.where("s = t").select(F.col("s").alias("node"))
            bad += [cyclic, loops]
            edges = edges.where("s <> t")
            if flip:
                edges, nodes = _flipped(edges, nodes)
        edges = scratch(edges, "dag-edges")
        nodes, _ = _kept(_nodes(edges, nodes))
        count = edges.count()
        if stop_at_cycle and found(bad).limit(1).count():
            break
        if count == before and not trimmed:
            bad.append(edges.select(F.col("s").alias("node")))
            break
    return Settled(found(bad), longest, rounds)


def closure(edges: DataFrame, source: str, target: str, roots: DataFrame) -> tuple[DataFrame, int]:
    """node, depth of the roots (column node) and all that reach them along edges from source to target, and the rounds.

    depth counts the edges of the shortest way. Layers are gone through one by
    one, each a table of its own beside those before. If PLAIN_LAYERS were not
    enough, the nodes that one edge leaves are hung on the end of their path by
    pointer doubling (a root is an end), and the search goes on over what is
    left, by lengths. So a chain takes a logarithmic number of rounds, and a
    shallow graph none but its layers. Cycles are allowed.
    """
    edges = edges.select(F.col(source).alias("s"), F.col(target).alias("t"))
    reached = [scratch(roots.select("node", F.lit(0).cast("long").alias("depth")).distinct(), "closure")]
    rounds = 0

    def known() -> DataFrame:
        out = reached[0]
        for more in reached[1:]:
            out = out.unionByName(more)
        return out

    for layer in range(1, PLAIN_LAYERS + 1):
        rounds += 1
        step = edges.join(lookup(reached[-1].select(F.col("node").alias("t"))), "t").select(F.col("s").alias("node")).distinct()
        front = scratch(step.join(known(), "node", "left_anti").withColumn("depth", F.lit(layer).cast("long")), "closure-front")
        if not front.limit(1).count():
            return known(), rounds
        reached.append(front)

    # what is known is settled: shortest ways to the rest start in it
    settled = scratch(known(), "closure")
    distinct = scratch(edges.where("s <> t").distinct(), "closure-edges")
    open_edges = scratch(distinct.join(settled.select(F.col("node").alias("s")), "s", "left_anti"), "closure-open")
    single = open_edges.groupBy("s").agg(F.count("*").alias("n"), F.first("t").alias("to")).where("n = 1")
    pointers = scratch(single.select(F.col("s").alias("u"), "to", F.lit(1).cast("long").alias("d"), F.lit(0).cast("long").alias("most")), "closure-pointers")
    ends, lost, some = shortened(pointers)
    rounds += some
    ends = scratch(ends.select("u", "to", "d"), "closure-ends")
    gone = scratch(ends.select(F.col("u").alias("s")).union(lost.select("u")), "closure-gone")
    rest = open_edges.join(lookup(gone), "s", "left_anti").join(lookup(scratch(lost.select(F.col("u").alias("t")), "closure-lost")), "t", "left_anti")
    rest = rest.join(lookup(ends.select(F.col("u").alias("t"), F.col("to").alias("_to"), F.col("d").alias("_d"))), "t", "left")
    rest = rest.select("s", F.coalesce("_to", "t").alias("t"), (F.lit(1) + F.coalesce("_d", F.lit(0))).alias("w")).groupBy("s", "t").agg(F.min("w").alias("w"))
    rest = scratch(rest, "closure-rest")
    best = front = settled
    while True:
        rounds += 1
        step = rest.join(front.select(F.col("node").alias("t"), "depth"), "t").groupBy(F.col("s").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        held = best.select(F.col("node").alias("_n"), F.col("depth").alias("_depth"))
        front = scratch(step.join(held, F.col("node") == F.col("_n"), "left").where("_depth is null or depth < _depth").select("node", "depth"), "closure-front")
        if not front.limit(1).count():
            break
        best = scratch(best.unionByName(front).groupBy("node").agg(F.min("depth").alias("depth")), "closure")
    hung = ends.join(best.select(F.col("node").alias("to"), "depth"), "to").select(F.col("u").alias("node"), (F.col("depth") + F.col("d")).alias("depth"))
    return best.unionByName(hung), rounds
