"""Degree, closeness, betweenness, PageRank, Katz and eigenvector centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from arcweft.model import GraphError, PropertyGraph
from arcweft.operators import brandes
from arcweft.operators.search import has_cycle_directed, shortest
from arcweft.shared import cut

#: Rounds of a spectral loop between two tables; between them the plan is one job.
STRIDE = 4


def degree(g: PropertyGraph) -> DataFrame:
    """id, degree: out-arcs; in undirected graphs all edges, loops twice. Isolated vertices have 0."""
    d = g.arcs().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return g.vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def hops(g: PropertyGraph) -> Column:
    return F.lit(1).cast("long")


#: Most rows (sources * vertices) of a batch of an all-pairs measure.
STATE = 200_000_000
#: Most arcs (one per pair) of which each task of betweenness has a copy; more stay in tables.
ARCS = 2_000_000


def batches_of(ids: DataFrame, vertices: DataFrame, batches: int | None) -> list[DataFrame]:
    """The sources in so many parts that each, times all vertices, stays under STATE rows."""
    n = batches or max(1, -(-ids.count() * vertices.count() // STATE))
    return [ids if n == 1 else ids.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


def closeness(g: PropertyGraph, weighted: bool = False, sources: DataFrame | None = None, batches: int | None = None) -> DataFrame:
    """id, closeness: reached vertices over the sum of their distances (hops, or least weights); 0 if none is reached.

    Exact for all sources, which go in batches and leave one row each; `sources` (id) asks for some only."""
    ids = g.vertices.select("id") if sources is None else sources
    score: DataFrame | None = None
    for part in batches_of(ids, g.vertices, batches):
        far = shortest(g, part, None if weighted else hops(g)).filter("id <> source")
        sums = cut(far.groupBy(F.col("source").alias("id")).agg(F.try_divide(F.count("*").cast("double"), F.sum("dist").cast("double")).alias("closeness")), "closeness")
        score = sums if score is None else score.unionAll(sums)
    return ids.join(score, "id", "left").select("id", F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def betweenness(g: PropertyGraph, weighted: bool = False, multiplicity: bool = True, types: list[str] | None = None, batches: int | None = None) -> DataFrame:
    """id, betweenness: shares of shortest paths through a vertex, over (n - 1)(n - 2), twice that for undirected graphs.

    multiplicity: parallel arcs are paths of their own. With types, n counts the vertices that an allowed edge touches. Chains are
    one arc (of whole weights). Blocks of sources go through all arcs in arrays, up to ARCS; with more, batches of sources in
    tables, whose state (sources * vertices rows) stays under STATE. 0 for all if n <= 2. Arcs of weight zero are steps like others; negative weights raise, and cycles
    of weight zero, round which shortest paths are without number."""
    part = g if types is None else g.by_types(types)
    n = part.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().count() if types is not None else g.vertices.count()
    arcs = part.arcs().groupBy("src", "dst").agg(F.min("weight").alias("weight"), F.count("*").alias("m")).filter("src <> dst")
    arcs = cut(arcs.select("src", "dst", (F.col("weight") if weighted else hops(g)).alias("w"), (F.col("m") if multiplicity else F.lit(1)).cast("double").alias("m")), "arcs")
    if weighted and not arcs.filter("w < 0").isEmpty():
        raise GraphError("negative weights")
    many, most = arcs.agg(F.count("w"), F.max("w")).first()
    kind, small = arcs.schema["w"].dataType, (most or 0) * (many + 1) < 1 << 62
    whole = arcs.filter("w is not null")
    # sums of whole numbers are the same in any order, so chains can be summed up first
    lines = brandes.chained(whole, g.vertices) if isinstance(kind, LongType) and small else None
    few = lines[0] if lines else whole.withColumn("n", F.lit(1).cast("long"))
    if weighted and has_cycle_directed(PropertyGraph(g.vertices, few.filter("w = 0").select("src", "dst"), True)):
        raise GraphError("weighted betweenness has no value where arcs of weight zero form a cycle")
    if isinstance(kind, (LongType, DoubleType)) and small and (few.count() if lines else many) <= ARCS:
        sums = brandes.shares(few, g.vertices, batches)
        total = cut(brandes.unchained(cut(sums, "sums"), *lines[1:]) if lines else sums.select("id", "x"), "sums")
    else:
        total = _shares(g, part, arcs, None if weighted else hops(g), batches)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if total is None:
        return g.vertices.select("id", F.lit(0.0).alias("betweenness"))
    total = total.groupBy("id").agg(F.sum("x").alias("x"))
    # undirected: every path counts from both ends, and the scale is twice as large
    return g.vertices.select("id").join(total, "id", "left").select("id", (F.coalesce("x", F.lit(0.0)) * scale).alias("betweenness"))


def _shares(g: PropertyGraph, part: PropertyGraph, arcs: DataFrame, weight: Column | None, batches: int | None) -> DataFrame | None:
    """id, x as of `brandes.shares` in tables alone: for more arcs than a task holds, and other kinds of weights."""
    total: DataFrame | None = None
    for sources in batches_of(g.vertices.select("id"), g.vertices, batches):
        dist = cut(shortest(part, sources, weight).select("source", "id", "dist"), "dist")
        to = dist.select("source", F.col("id").alias("dst"), F.col("dist").alias("dist_to"))
        steps = dist.withColumnRenamed("id", "src").join(arcs, "src").join(to, ["source", "dst"]).filter("dist + w = dist_to")
        steps = cut(steps.select("source", "src", "dst", "m"), "steps")
        # paths by their number of steps, summed over all numbers
        wave = cut(dist.filter("id = source").select("source", "id", F.lit(1.0).alias("x")), "wave")
        waves = wave
        while True:
            wave = cut(wave.join(steps, (wave.source == steps.source) & (wave.id == steps.src)).groupBy(steps.source, F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("m")).alias("x")), "wave")
            if wave.isEmpty():
                break
            waves = waves.unionAll(wave)
        sigma = cut(waves.groupBy("source", "id").agg(F.sum("x").alias("sigma")), "sigma")
        one, two = sigma.select("source", F.col("id").alias("src"), F.col("sigma").alias("s1")), sigma.select("source", F.col("id").alias("dst"), F.col("sigma").alias("s2"))
        shares = cut(steps.join(one, ["source", "src"]).join(two, ["source", "dst"]).select("source", "src", "dst", (F.col("m") * F.col("s1") / F.col("s2")).alias("share")), "shares")
        wave = sigma.select("source", "id", F.lit(1.0).alias("x"))
        waves = None
        while True:
            wave = cut(wave.join(shares, (wave.source == shares.source) & (wave.id == shares.dst)).groupBy(shares.source, F.col("src").alias("id")).agg(F.sum(F.col("x") * F.col("share")).alias("x")), "wave")
            if wave.isEmpty():
                break
            waves = wave if waves is None else waves.unionAll(wave)
        if waves is not None:
            sums = cut(waves.filter("id <> source").groupBy("id").agg(F.sum("x").alias("x")), "sums")
            total = sums if total is None else total.unionAll(sums)
    return total


def _loop(start: DataFrame, rounds: int, tolerance: float, step, change: Column | None) -> DataFrame:
    """x of (id, x) after `rounds` steps, or once `change` over (old, x) falls under the tolerance. Without a tolerance the
    lineage is cut every STRIDE rounds only."""
    now = cut(start, "scores")
    for i in range(rounds):
        new = step(now)
        if tolerance > 0 and change is not None:
            new = cut(new, "scores")
            gap = new.join(now.withColumnRenamed("x", "old"), "id").agg(change).first()[0]
            now = new
            if gap is None or gap < tolerance:
                break
        else:
            now = cut(new, "scores") if (i + 1) % STRIDE == 0 else new
    return now


def pagerank(g: PropertyGraph, damping: float = 0.85, max_iter: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, pagerank: (1 - d) / n + d * sum of rank * share of the weight out; the rank of vertices without out-arcs is lost.
    Stops once the ranks move by less than the tolerance in sum."""
    ids = cut(g.vertices.select("id"), "ids")
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("pagerank"))
    pairs = g.arcs().groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("w"))
    out = g.arcs().groupBy("src").agg(F.sum(F.col("weight").cast("double")).alias("out"))
    moves = cut(pairs.join(out, "src").select("src", "dst", F.try_divide("w", "out").alias("p")).filter("p is not null"), "moves")

    def step(now: DataFrame) -> DataFrame:
        got = now.join(moves, now.id == moves.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("p")).alias("got"))
        return ids.join(got, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("x"))

    return _loop(ids.select("id", F.lit(1.0 / n).alias("x")), max_iter, tolerance, step, F.sum(F.abs(F.col("x") - F.col("old")))).withColumnRenamed("x", "pagerank")


def _out_weights(g: PropertyGraph) -> DataFrame:
    return cut(g.arcs().groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("w")), "weights")


def katz(g: PropertyGraph, alpha: float = 0.1, beta: float = 1.0, max_iter: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, katz: beta + alpha * sum of weight * score of out-neighbours, not normalised. Stops once no score moves by the
    tolerance."""
    ids, weights = cut(g.vertices.select("id"), "ids"), _out_weights(g)

    def step(now: DataFrame) -> DataFrame:
        got = now.join(weights, now.id == weights.dst).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("got"))
        return ids.join(got, "id", "left").select("id", (beta + alpha * F.coalesce("got", F.lit(0.0))).alias("x"))

    return _loop(ids.select("id", F.lit(float(beta)).alias("x")), max_iter, tolerance, step, F.max(F.abs(F.col("x") - F.col("old")))).withColumnRenamed("x", "katz")


def eigenvector(g: PropertyGraph, max_iter: int = 100, tolerance: float = 0) -> DataFrame:
    """id, eigenvector: max_iter rounds of 1 + sum of weight * score of out-neighbours, scaled to length 1; then to sum 1. With a
    tolerance it stops once no scaled score moves by as much."""
    ids, weights = cut(g.vertices.select("id"), "ids"), _out_weights(g)

    def step(now: DataFrame) -> DataFrame:
        got = now.join(weights, now.id == weights.dst).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("got"))
        raw = ids.join(got, "id", "left").select("id", (1.0 + F.coalesce("got", F.lit(0.0))).alias("x"))
        norm = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        return raw.join(F.broadcast(norm), F.lit(True)).select("id", F.try_divide("x", "norm").alias("x"))

    now = cut(_loop(ids.select("id", F.lit(1.0).alias("x")), max_iter, tolerance, step, F.max(F.abs(F.col("x") - F.col("old")))), "scores")
    total = now.agg(F.sum("x").alias("total"))
    return now.join(F.broadcast(total), F.lit(True)).select("id", F.try_divide("x", "total").alias("eigenvector"))
