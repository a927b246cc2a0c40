"""Communities: rounds of local moving on modularity, refinement to connected parts, aggregation, merging of small ones."""

from __future__ import annotations

import random
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweft.model import PropertyGraph
from arcweft.shared import components, cut


@dataclass(frozen=True)
class CommunityConfig:
    """The effective resolution is resolution * gamma. deterministic: results depend on the seed only; else the seed, where it
    is not given, and the moves of the refinement are drawn afresh."""

    gamma: float = 1.0
    resolution: float = 1.0
    iterations: int = 3
    rounds: int = 8
    seed: int | None = 42
    min_community_size: int = 2
    deterministic: bool = True


def _symmetric(g: PropertyGraph) -> DataFrame:
    """src, dst, w in both directions, parallel edges summed; a loop weighs twice."""
    e = g.edges.select("src", "dst", F.col("weight").cast("double").alias("w"))
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(arcs: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of labels (id, label) over symmetric arcs; 0 without edges."""
    one, two = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in ("src", "dst"))
    both = arcs.join(one, "src").join(two, "dst")
    per = both.groupBy(F.col("l_src").alias("label")).agg(F.sum("w").alias("total"), F.sum(F.when(F.col("l_src") == F.col("l_dst"), F.col("w")).otherwise(0.0)).alias("inside"))
    row = per.agg(F.sum("total"), F.sum("inside"), F.sum(F.col("total") * F.col("total"))).first()
    total = row[0] or 0.0
    return 0.0 if total == 0 else row[1] / total - resolution * row[2] / total**2


def _move(arcs: DataFrame, config: CommunityConfig, level: int, start: DataFrame | None = None) -> DataFrame:
    """id, label after rounds of moves, from single vertices or the start's labels: each vertex of the round's half goes to the neighbouring label of largest gain."""
    resolution = config.resolution * config.gamma
    strength = cut(arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "strength")
    total = strength.agg(F.sum("k")).first()[0] or 0.0
    labels = cut(strength.select("id", F.col("id").alias("label")) if start is None else start, "labels")
    if total == 0:
        return labels
    best, best_score = labels, modularity(arcs, labels, resolution)
    for i in range(config.rounds):
        mine = labels.join(strength, "id")
        sums = mine.groupBy("label").agg(F.sum("k").alias("total"))
        near = arcs.filter("src <> dst").join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("k_in"))
        own = mine.select("id", "label", F.lit(0.0).alias("k_in"))
        options = near.unionAll(own).groupBy("id", "label").agg(F.sum("k_in").alias("k_in")).join(sums, "label").join(mine.select("id", F.col("label").alias("now"), "k"), "id")
        others = F.col("total") - F.when(F.col("label") == F.col("now"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("k_in") - resolution * F.col("k") * others / total, 9)
        options = options.withColumn("gain", gain)
        pick = options.groupBy("id").agg(F.max(F.struct("gain", (-F.col("label")).alias("minus"))).alias("to"), F.max(F.when(F.col("label") == F.col("now"), F.col("gain"))).alias("stay"))
        # half of the vertices at a time, so that neighbours seldom swap
        half = F.pmod(F.xxhash64("id", F.lit(config.seed + level)), F.lit(2)) == i % 2
        moved = pick.filter(half & (F.col("to.gain") > F.col("stay"))).select("id", (-F.col("to.minus")).alias("new"))
        new = cut(labels.join(moved, "id", "left").select("id", F.coalesce("new", "label").alias("label"), F.col("new").isNotNull().alias("moved")), "labels")
        changed = not new.filter("moved").isEmpty()
        labels = new.select("id", "label")
        score = modularity(arcs, labels, resolution)
        if score > best_score:
            best, best_score = labels, score
        if not changed and i > 0:
            break
    return best


def _inside(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """The arcs whose ends share a label."""
    one, two = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in ("src", "dst"))
    return arcs.join(one, "src").join(two, "dst").filter("l_src = l_dst").select("src", "dst", "w")


def _connected(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each connected part of a community as one of its own, named by its smallest vertex."""
    parts = components(_inside(arcs, labels).filter("src < dst"), "src", "dst")
    return cut(labels.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("label")), "connected")


def _refined(arcs: DataFrame, labels: DataFrame, config: CommunityConfig, level: int) -> DataFrame:
    """Each community anew from single vertices, which join the part of their community of largest positive gain (not deterministic:
    with a chance that grows with the gain); then connected parts, named by their smallest vertex. What a refinement leaves apart
    may join again, in whole parts, at the next level."""
    resolution = config.resolution * config.gamma
    strength = cut(arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "strength")
    total = strength.agg(F.sum("k")).first()[0] or 0.0
    inside = cut(_inside(arcs, labels).filter("src <> dst"), "inside")
    parts = cut(labels.select("id", F.col("id").alias("label")), "parts")
    for i in range(config.rounds if total else 0):
        mine = parts.join(strength, "id")
        sums = mine.groupBy("label").agg(F.sum("k").alias("total"), F.count("*").alias("members"))
        near = inside.join(parts.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("k_in"))
        # only vertices that are still alone move, half of them at a time, to a part that another of the round does not leave
        alone = mine.join(sums.filter("members = 1").select("label"), "label").filter("id = label").select("id", "k")
        half = lambda c: F.pmod(F.xxhash64(c, F.lit(config.seed or 0), F.lit(level), F.lit(i // 2)), F.lit(2)) == i % 2
        options = near.join(alone.filter(half("id")), "id").join(sums, "label").filter((F.col("label") != F.col("id")) & ((F.col("members") > 1) | ~half("label")))
        options = options.withColumn("gain", F.round(F.col("k_in") - resolution * F.col("k") * F.col("total") / total, 9)).filter("gain > 0")
        pick = options.groupBy("id").agg(F.max(F.struct("gain", (-F.col("label")).alias("minus"))).alias("to"))
        if not config.deterministic:
            pick = pick.filter(F.rand() < 1 / (1 + F.exp(-F.col("to.gain"))))
        moved = cut(pick.select("id", (-F.col("to.minus")).alias("new")), "moved")
        if moved.isEmpty():
            if i % 2:
                break
            continue
        parts = cut(parts.join(moved, "id", "left").select("id", F.coalesce("new", "label").alias("label")), "parts")
    return _connected(inside, parts)


def _merged(arcs: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """Communities under `least` join the neighbour with which they share the heaviest arc."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    small = cut(sizes.filter(F.col("n") < least).select("label"), "small")
    if small.isEmpty():
        return labels
    one, two = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in ("src", "dst"))
    out = arcs.join(one, "src").join(two, "dst").filter("l_src <> l_dst").join(small.withColumnRenamed("label", "l_src"), "l_src")
    to = out.groupBy("l_src").agg(F.max(F.struct("w", (-F.col("l_dst")).alias("minus"))).alias("best")).select(F.col("l_src").alias("label"), (-F.col("best.minus")).alias("to"))
    # of two small ones that choose each other, the larger label moves
    back = to.select(F.col("label").alias("to"), F.col("to").alias("label"), F.lit(True).alias("mutual"))
    to = to.join(back, ["label", "to"], "left").filter("mutual is null or label > to").select("label", "to")
    return labels.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label"))


def communities(g: PropertyGraph, config: CommunityConfig = CommunityConfig(), include_isolated: bool = True) -> DataFrame:
    """community (its smallest vertex), id."""
    if config.seed is None or not config.deterministic:
        config = replace(config, seed=random.randrange(1 << 30) if config.seed is None else config.seed)
    arcs = cut(_symmetric(g), "arcs")
    level_arcs = arcs
    labels: DataFrame | None = None
    start: DataFrame | None = None
    for level in range(config.iterations):
        # the parts of the refinement become the next level's vertices and begin in the communities that were found; at the last
        # level, or where the refinement joins nothing, the communities stand, each connected
        moved = _move(level_arcs, config, level, start)
        last = level == config.iterations - 1
        found = _connected(level_arcs, moved) if last else _refined(level_arcs, moved, config, level)
        if not last and found.filter("id <> label").isEmpty():
            last, found = True, _connected(level_arcs, moved)
        labels = found if labels is None else cut(labels.join(found.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.col("up").alias("label")), "labels")
        if last:
            break
        start = cut(found.join(moved.select("id", F.col("label").alias("of")), "id").groupBy(F.col("label").alias("id")).agg(F.min("of").alias("label")), "start")
        one, two = (found.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in ("src", "dst"))
        level_arcs = cut(level_arcs.join(one, "src").join(two, "dst").groupBy(F.col("l_src").alias("src"), F.col("l_dst").alias("dst")).agg(F.sum("w").alias("w")), "arcs")
    labels = g.vertices.limit(0).select("id", F.col("id").alias("label")) if labels is None else labels
    labels = cut(_merged(arcs, labels, config.min_community_size), "labels")
    least = labels.groupBy("label").agg(F.min("id").alias("community"))
    out = labels.join(least, "label").select("community", "id")
    if include_isolated:
        out = out.unionAll(g.vertices.select(F.col("id").alias("community"), "id").join(labels, "id", "left_anti").select("community", "id"))
    return out


def communities_by_types(g: PropertyGraph, types: Iterable[str], config: CommunityConfig = CommunityConfig()) -> DataFrame:
    """Over edges of the types (none: all); vertices without one are left out."""
    return communities(g.by_types(types, empty_means_all=True), config, include_isolated=False)
