"""Greedy dominating sets: vertices in order of degree, computed in parallel rounds with the sequential result."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweft.model import PropertyGraph
from arcweft.shared import cut


def dominating_set(g: PropertyGraph) -> DataFrame:
    """id: vertices in order of degree (largest first, then id), each taken unless an earlier one taken has an arc to it."""
    arcs = g.arcs()
    degree = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    order = g.vertices.select("id").join(degree, "id", "left").select("id", F.struct((-F.coalesce("d", F.lit(0))).alias("d"), F.col("id").alias("i")).alias("at"))
    order = cut(order, "order")
    one, two = order.select(F.col("id").alias("src"), F.col("at").alias("a")), order.select(F.col("id").alias("dst"), F.col("at").alias("b"))
    # arcs from an earlier vertex to a later one decide
    arcs = cut(arcs.select("src", "dst").distinct().join(one, "src").join(two, "dst").filter("a < b").select("src", "dst"), "arcs")
    left = order.select("id")
    taken = None
    while True:
        waits = arcs.select(F.col("dst").alias("id")).distinct()
        new = cut(left.join(waits, "id", "left_anti"), "taken")
        taken = new if taken is None else taken.unionAll(new)
        out = arcs.join(new.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        left = cut(left.join(new, "id", "left_anti").join(out, "id", "left_anti"), "left")
        if left.isEmpty():
            return cut(taken, "taken")
        ids = left.select("id")
        arcs = cut(arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "arcs")


def dominating_set_typed(g: PropertyGraph, types: Iterable[str] | None = None) -> DataFrame:
    """id: as above over edges of the types (none: all), by the number of distinct neighbours; isolated vertices stay out, and a
    vertex is taken if it or any of its neighbours is uncovered.

    A vertex is decided once all earlier ones within two steps are, so each round decides every vertex that is first among
    the undecided of its surroundings; a vertex whose own surroundings are covered is never taken."""
    g = g if types is None else g.by_types(types, empty_means_all=True)
    arcs = cut(g.arcs().select("src", "dst").distinct(), "arcs")
    order = cut(arcs.groupBy(F.col("src").alias("id")).agg(F.struct((-F.count("*")).alias("d"), F.first("src").alias("i")).alias("at")), "order")
    # src covers dst: itself and its neighbours
    covers = cut(arcs.unionAll(order.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct(), "covers")
    left, open_ones = order, cut(covers.select(F.col("dst").alias("id")).distinct(), "open")
    taken = None
    while True:
        useful = covers.join(open_ones.withColumnRenamed("id", "dst"), "dst", "left_semi").join(left.withColumnRenamed("id", "src"), "src")
        useful = cut(useful, "useful")  # src, dst, at: what undecided vertices would still cover
        if useful.isEmpty():
            return g.vertices.limit(0).select("id") if taken is None else cut(taken, "taken")
        first = useful.groupBy("dst").agg(F.min("at").alias("first"))
        ready = useful.join(first, "dst").groupBy("src").agg(F.min(F.col("at") == F.col("first")).alias("all")).filter("all").select(F.col("src").alias("id"))
        new = cut(ready, "taken")
        taken = new if taken is None else taken.unionAll(new)
        covered = covers.join(new.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        open_ones = cut(open_ones.join(covered, "id", "left_anti"), "open")
        left = cut(left.join(new, "id", "left_anti"), "left")
