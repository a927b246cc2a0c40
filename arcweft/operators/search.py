"""Reachability, paths, cycles and shortest paths as frontier loops.

Every round joins only the frontier with the arcs and cuts the lineage with a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweft.model import GraphError, PropertyGraph
from arcweft.shared import cut, drop

#: Rounds between merges of what a loop has found.
STRIDE = 8


def reachable(starts: DataFrame, arcs: DataFrame, stop_at: int | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """id, level of all that the starts (id) reach along arcs (src, dst); ends early once `stop_at` is reached. Vertices
    in `excluded` count as visited."""
    arcs = cut(arcs.select("src", "dst").filter("src <> dst").distinct(), "arcs")
    frontier = starts.select("id").distinct()
    if excluded is not None:
        frontier = frontier.join(excluded, "id", "left_anti")
    seen = cut(frontier.withColumn("level", F.lit(0)), "seen")
    frontier, level = seen, 0
    while True:
        level += 1
        new = frontier.join(arcs, frontier.id == arcs.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        if excluded is not None:
            new = new.join(excluded, "id", "left_anti")
        frontier = cut(new.withColumn("level", F.lit(level)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)
        if stop_at is not None and not frontier.filter(F.col("id") == stop_at).isEmpty():
            return seen
        if level % STRIDE == 0:
            seen = cut(seen, "seen")


def start_of(g: PropertyGraph, node: int) -> DataFrame:
    return g.vertices.filter(F.col("id") == node).select("id")


def has_path(g: PropertyGraph, source: int, target: int, strict: bool = True, excluded: DataFrame | None = None) -> bool:
    """strict: an id that does not exist raises, else there is no path."""
    try:
        g.require(source, target)
    except GraphError:
        if strict:
            raise
        return False
    if source == target:
        return True
    found = reachable(start_of(g, source), g.arcs(), target, excluded)
    return not found.filter(F.col("id") == target).isEmpty()


def bfs_path(g: PropertyGraph, source: int, target: int, types: Iterable[str] | None = None, grouped: bool = False) -> list[int] | None:
    """A path of fewest hops: of those, the one a queue finds that visits neighbours in insertion order.

    grouped: neighbours stand in the order of their first edge of any type, as where parallel edges are kept together."""
    g.require(source, target)
    if source == target:
        return [source]
    order = g.arcs().groupBy("src", "dst").agg(F.min("edge_id").alias("key"))
    allowed = g if types is None else g.by_types(types)
    arcs = allowed.arcs().groupBy("src", "dst").agg(F.min("edge_id").alias("own"))
    arcs = arcs.join(order, ["src", "dst"]).select("src", "dst", "key") if grouped else arcs.withColumnRenamed("own", "key")
    arcs = cut(arcs.filter("src <> dst"), "arcs")
    longs = "array<bigint>"
    seen = start_of(g, source)
    frontier = seen.select("id", F.expr(f"cast(array() as {longs})").alias("order"), F.array("id").alias("path"))
    while True:
        step = frontier.join(arcs, frontier.id == arcs.src).select(F.col("dst").alias("id"), F.struct(F.concat("order", F.array("key")).alias("order"), F.concat("path", F.array("dst")).alias("path")).alias("way"))
        new = step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("way").alias("way"))
        frontier = cut(new.select("id", "way.order", "way.path"), "frontier")
        hit = frontier.filter(F.col("id") == target).first()
        if hit:
            return list(hit.path)
        if frontier.isEmpty():
            return None
        seen = cut(seen.unionAll(frontier.select("id")), "seen")


def has_cycle_directed(g: PropertyGraph) -> bool:
    """Peel vertices without in-arcs and those without out-arcs, both ends at a time; a cycle is what cannot be peeled."""
    if not g.edges.filter("src = dst").isEmpty():
        return True
    arcs = cut(g.edges.select("src", "dst").distinct(), "arcs")
    m = arcs.count()
    while m:
        heads, tails = arcs.select(F.col("dst").alias("src")).distinct(), arcs.select(F.col("src").alias("dst")).distinct()
        arcs = cut(arcs.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"), "arcs")
        n, m = m, arcs.count()
        if n == m:
            return True
    return False


def has_cycle_undirected(g: PropertyGraph, parallel: bool) -> bool:
    """More edges than a forest on these vertices has. Loops are cycles; parallel edges only if `parallel`."""
    from arcweft.operators.components import weak

    e = g.edges.select("src", "dst")
    if not e.filter("src = dst").isEmpty():
        return True
    edges = (e if parallel else e.distinct()).count()
    parts = weak(g).select("component").distinct().count()
    return edges > g.vertices.count() - parts


def has_cycle(g: PropertyGraph, parallel: bool = True) -> bool:
    return has_cycle_directed(g) if g.directed else has_cycle_undirected(g, parallel)


def least_arcs(g: PropertyGraph, weight: Column | None = None) -> DataFrame:
    """src, dst, w: the least weight from one vertex to another."""
    arcs = g.arcs().groupBy("src", "dst").agg(F.min("weight" if weight is None else weight).alias("w"))
    return arcs.filter("src <> dst and w is not null and not (w <> w)")


def tight(dist: DataFrame, arcs: DataFrame) -> DataFrame:
    """source, src, id: the arcs that end shortest paths, which dist (source, id, dist) has the lengths of."""
    before = dist.select("source", F.col("id").alias("src"), F.col("dist").alias("before"))
    return before.join(arcs, "src").withColumnRenamed("dst", "id").join(dist, ["source", "id"]).filter("before + w = dist and id <> source").select("source", "src", "id")


def shortest(g: PropertyGraph, sources: DataFrame, weight: Column | None = None) -> DataFrame:
    """source, id, dist, pred: least total weight from every source (id) to all it reaches, and the last vertex before (the
    smallest of equals; null for the source). Negative weights raise. Arcs of weight zero count like others: where they form a
    cycle, the vertices on it may have each other as pred."""
    arcs = cut(least_arcs(g, weight), "arcs")
    if not arcs.filter("w < 0").isEmpty():
        raise GraphError("negative weights")
    kind = arcs.schema["w"].dataType
    dist = sources.select(F.col("id").alias("source"), "id", F.lit(0).cast(kind).alias("dist"))
    base = cut(dist, "dist")
    frontier, layers = base, []
    while True:
        reach = frontier.join(arcs, frontier.id == arcs.src).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        # what is known: the base and the layers since, which are written once each and merged every STRIDE rounds
        known = base
        for layer in layers:
            known = known.unionAll(layer)
        known = known.groupBy("source", "id").agg(F.min("dist").alias("dist")) if layers else base
        better = reach.join(known, ["source", "id"], "left").filter("dist is null or new < dist").select("source", "id", F.col("new").alias("dist"))
        frontier = cut(better, "frontier")
        if frontier.isEmpty():
            dist = cut(known, "dist") if layers else base
            break
        layers.append(frontier)
        if len(layers) == STRIDE:
            merged = cut(known.unionAll(frontier).groupBy("source", "id").agg(F.min("dist").alias("dist")), "dist")
            drop(base, *layers[:-1])
            base, layers = merged, []
    pred = tight(dist, arcs).groupBy("source", "id").agg(F.min("src").alias("pred"))
    return dist.join(pred, ["source", "id"], "left").select("source", "id", "dist", "pred")


def dijkstra(g: PropertyGraph, start: int, types: Iterable[str] | None = None) -> DataFrame:
    """id, dist, pred."""
    g.require(start)
    return shortest(g if types is None else g.by_types(types), start_of(g, start)).select("id", "dist", "pred")


def fewest_arcs(g: PropertyGraph, start: int, dist: DataFrame) -> DataFrame:
    """id, pred of the shortest paths (dist: id, dist) with the fewest arcs: no cycle of weight zero is among them."""
    steps = cut(tight(dist.select(F.lit(start).cast("long").alias("source"), "id", "dist"), least_arcs(g)).select("src", F.col("id").alias("dst")), "steps")
    levels = cut(reachable(start_of(g, start), steps), "levels")
    ends = steps.join(levels.select(F.col("id").alias("src"), F.col("level").alias("before")), "src").join(levels.select(F.col("id").alias("dst"), "level"), "dst")
    return cut(ends.filter("before + 1 = level").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("pred")), "tree")


def dijkstra_path(g: PropertyGraph, start: int, end: int, types: Iterable[str] | None = None) -> list[int] | None:
    """The shortest path by smallest predecessors; where these run in a circle of weight zero, one with the fewest arcs."""
    g.require(start, end)
    if start == end:
        return [start]
    tree = cut(dijkstra(g, start, types), "tree")
    if tree.filter(F.col("id") == end).isEmpty():
        return None
    path = way_back(tree, start, end, tree.count())
    return path or way_back(fewest_arcs(g if types is None else g.by_types(types), start, tree.select("id", "dist")), start, end)


def way_back(tree: DataFrame, start: int, end: int, most: int | None = None) -> list[int] | None:
    """The vertices from start to end by a tree (id, pred); None where a way of `most` vertices does not meet the start."""
    # pointer doubling: after k rounds `way` holds the last 2**k vertices, and `jump` leads 2**k steps back
    way = tree.filter(F.col("id") == end).select("id", F.lit(0).cast("long").alias("step"))
    jump, length = tree.filter("pred is not null").select("id", F.col("pred").alias("to")), 1
    while most is None or length <= most:
        more = way.join(jump, "id").select(F.col("to").alias("id"), (F.col("step") + length).alias("step"))
        longer = cut(way.unionAll(more), "way")
        if not longer.filter(F.col("id") == start).isEmpty():
            return [r.id for r in longer.orderBy(F.desc("step")).collect()]  # the answer itself
        way, length = longer, 2 * length
        jump = cut(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), "jump")
    return None
