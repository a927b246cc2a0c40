"""Weak and strong components, connectivity tests and bridges."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweft.model import PropertyGraph
from arcweft.operators.search import reachable
from arcweft.shared import attach, components, cut, drop, lookup, numbered


def weak(g: PropertyGraph) -> DataFrame:
    """id, component (its smallest id); directions do not count."""
    found = components(g.edges, "src", "dst")
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _spread_max(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """id, colour: the largest id that reaches a vertex along arcs."""
    colour = cut(vertices.select("id", F.col("id").alias("colour")), "colour")
    changed = colour
    while True:
        new = changed.join(arcs, changed.id == arcs.src).groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("new"))
        changed = cut(new.join(colour, "id").filter("new > colour").select("id", F.col("new").alias("colour")), "changed")
        if changed.isEmpty():
            return colour
        colour = cut(colour.join(changed, "id", "left_anti").unionAll(changed), "colour")


def strong(g: PropertyGraph) -> DataFrame:
    """id, component (its smallest id). Undirected: the weak components.

    Trim vertices that lack an in- or out-arc; colour the rest by the largest id that reaches them; what reaches a colour's
    own vertex back within the colour is a component. Repeat on what is left."""
    if not g.directed:
        return weak(g)
    left = cut(g.vertices.select("id"), "left")
    arcs = cut(g.edges.select("src", "dst").filter("src <> dst").distinct(), "arcs")
    done: DataFrame | None = None

    def add(more: DataFrame) -> None:
        nonlocal done
        done = cut(more if done is None else done.unionAll(more), "done")

    while not left.isEmpty():
        both = arcs.select(F.col("src").alias("id")).distinct().join(arcs.select(F.col("dst").alias("id")).distinct(), "id")
        core = cut(left.join(both, "id", "left_semi"), "core")
        if core.count() < left.count():
            add(left.join(core, "id", "left_anti").select("id", F.col("id").alias("root")))
        else:
            colour = _spread_max(core, arcs)
            same = arcs.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("id").alias("dst"), "colour"), "dst").filter("c = colour")
            back = reachable(colour.filter("id = colour"), same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            found = cut(back.select("id").join(colour, "id").select("id", F.col("colour").alias("root")), "found")
            add(found)
            core = cut(core.join(found, "id", "left_anti"), "core")
        left = core
        ends = left.select(F.col("id").alias("src"))
        arcs = cut(arcs.join(ends, "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "arcs")
    if done is None:
        return g.vertices.select("id", F.col("id").alias("component"))
    least = done.groupBy("root").agg(F.min("id").alias("component"))
    return done.join(least, "root").select("id", "component")


def connected_components(g: PropertyGraph, types: Iterable[str] | None = None) -> DataFrame:
    """Strong components of directed graphs, weak ones of others; by types, where no type means all."""
    g = g if types is None else g.by_types(types, empty_means_all=True)
    return strong(g) if g.directed else weak(g)


def is_weak(g: PropertyGraph, strict_empty: bool = False) -> bool:
    """One component; the empty graph counts unless strict_empty."""
    parts = weak(g).select("component").distinct().limit(2).count()
    return parts == 1 or (parts == 0 and not strict_empty)


def is_strong(g: PropertyGraph) -> bool:
    """Everything is reached from some vertex, forwards and backwards."""
    if not g.directed:
        return is_weak(g)
    n = g.vertices.count()
    if n == 0:
        return True
    first = g.vertices.agg(F.min("id").alias("id"))
    arcs = g.edges.select("src", "dst")
    if reachable(first, arcs).count() < n:
        return False
    return reachable(first, arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).count() == n


def is_connected(g: PropertyGraph, types: Iterable[str] | None = None) -> bool:
    g = g if types is None else g.by_types(types, empty_means_all=True)
    return is_strong(g) if g.directed else is_weak(g)


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """src, dst of a forest that spans the components of distinct pairs src < dst: every component takes its smallest pair that leaves
    it, and what these join becomes one. Each round at least halves the components that have a pair left."""
    rest = cut(pairs.select("src", "dst", F.col("src").alias("cs"), F.col("dst").alias("cd")), "contracted")
    forest = pairs.limit(0)
    while not rest.isEmpty():
        before = rest
        ends = rest.select(F.explode(F.array("cs", "cd")).alias("c"), F.struct("src", "dst", "cs", "cd").alias("pair"))
        taken = cut(ends.groupBy("c").agg(F.min("pair").alias("pair")).select("pair.*").distinct(), "taken")
        forest = forest.unionAll(taken.select("src", "dst"))
        joined = cut(components(taken, "cs", "cd"), "joined")
        for c in ("cs", "cd"):
            rest = attach(rest, joined.select(F.col("id").alias(c), F.col("component").alias("_to")), [c], F.struct("src", "dst")).withColumn(c, F.coalesce("_to", c)).drop("_to")
        # one pair, the smallest, between any two components
        rest = rest.filter("cs <> cd").groupBy(F.least("cs", "cd").alias("lo"), F.greatest("cs", "cd").alias("hi")).agg(F.min(F.struct("src", "dst")).alias("p"))
        rest = cut(rest.select("p.src", "p.dst", F.col("lo").alias("cs"), F.col("hi").alias("cd")), "contracted")
        drop(before, joined)
    return cut(forest, "forest")


def euler_sums(forest: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst, a, b: for each pair of the forest the exclusive-or of the labels (id, a, b) on one of the sides that it parts.

    Both sides have the same where a component's labels cancel out. The arcs of every tree are threaded to a tour, and sums along it
    are made by pointer doubling: as many rounds as the logarithm of the tour's length, whatever the tree's depth."""
    arcs = forest.select(F.col("src").alias("t"), F.col("dst").alias("h")).unionAll(forest.select(F.col("dst").alias("t"), F.col("src").alias("h")))
    arcs = cut(numbered(arcs, ["t", "h"], "r"), "arcs")
    block = cut(arcs.groupBy("t").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("m")), "blocks")
    roots = components(forest, "src", "dst").filter("id = component").select(F.col("id").alias("t"))
    heads = block.join(roots, "t").select(F.col("lo").alias("next"), F.lit(True).alias("is_head"))
    # after an arc comes the one behind its reverse around the vertex it leads to
    turned = lookup(arcs, block, ["t"], "m", F.col("r")).select(F.col("h").alias("t"), F.col("t").alias("h"), F.when(F.col("r") < F.col("hi"), F.col("r") + 1).otherwise(F.col("lo")).alias("next"))
    # each vertex's label counts once, on the first arc into it
    into = arcs.groupBy("h").agg(F.min("r").alias("r")).join(labels.withColumnRenamed("id", "h"), "h").select("r", "a", "b")
    tour = arcs.join(turned, ["t", "h"]).join(into, "r", "left").join(heads, "next", "left")
    tour = tour.select("r", F.when(F.col("is_head").isNull(), F.col("next")).alias("next"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    tour = cut(tour, "tour")
    while not tour.filter("next is not null").isEmpty():
        ahead = tour.select(F.col("r").alias("next"), F.col("next").alias("_next"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        more = tour.filter("next is not null").join(ahead, "next").select("r", F.col("_next").alias("next"), F.col("a").bitwiseXOR(F.col("_a")).alias("a"), F.col("b").bitwiseXOR(F.col("_b")).alias("b"))
        done, tour = tour, cut(tour.filter("next is null").unionAll(more), "tour")
        drop(done)
    sums = arcs.join(tour, "r").select(F.least("t", "h").alias("src"), F.greatest("t", "h").alias("dst"), "a", "b")
    return sums.groupBy("src", "dst").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))


def bridge_pairs(g: PropertyGraph) -> DataFrame:
    """src < dst of pairs whose removal (with all parallels) parts a component; directions do not count.

    Every pair beside a spanning forest gets a random 128-bit label, which its ends carry; the exclusive-or of the labels on one side of
    a forest pair is zero if no other pair leads across (and by chance with a probability of 2**-128)."""
    pairs = cut(g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src < dst").distinct(), "pairs")
    forest = spanning_forest(pairs)
    other = pairs.join(forest, ["src", "dst"], "left_anti")
    labels = other.select(F.explode(F.array("src", "dst")).alias("id"), F.xxhash64(F.lit("a"), "src", "dst").alias("a"), F.xxhash64(F.lit("b"), "dst", "src").alias("b"))
    carried = cut(labels.groupBy("id").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")), "labels")
    return euler_sums(forest, carried).filter("a = 0 and b = 0").select("src", "dst")


def bridges(g: PropertyGraph) -> DataFrame:
    """src, dst: bridging pairs; parallel edges are one."""
    return bridge_pairs(g)


def bridges_single(g: PropertyGraph) -> DataFrame:
    """src, dst, edge_type of bridges that are a single edge."""
    e = g.edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("m"), F.min("edge_type").alias("edge_type"))
    return bridge_pairs(g).join(e.filter("m = 1"), ["src", "dst"]).select("src", "dst", "edge_type")


def bridges_by_types(g: PropertyGraph, types: Iterable[str]) -> DataFrame:
    """src, dst, edge_type of all edges of the types on pairs that bridge the graph of these types."""
    part = g.by_types(types)
    e = part.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "edge_type")
    return bridge_pairs(part).join(e, ["src", "dst"]).select("src", "dst", "edge_type")
