"""Exact top-k inner products by norm-bucketed retrieval.

1. Vectors are dealt to buckets of neighbouring lengths, from splitters over a bounded sample; a bucket with more rows than
   a block holds is subdivided by a hash of the id, so vectors that share a length (or are equal) never swell one task.
2. Each query's products with the longest vectors (one bounded seed block) give a first lower bound of its k-th score.
3. For each block of queries and bucket the bound becomes a local cosine threshold: bound / (|q| * longest in the bucket).
   Over 1 the bucket is skipped. High thresholds prune by coordinates: on the query's largest coordinates a vector must
   lie in the interval that the threshold leaves. Others prune by length: only vectors of at least bound / |q|.
4. Products of the survivors are verified in integers, and each query keeps its k best of a block.
5. The best of all blocks are merged per query by rank; each task passes on its k best of a query only, in a sorted stream.

Components are floor(scale * x), x as double. Vectors that are null, or hold a null or non-finite component, take no part;
vectors of different sizes are extended by zeros. A row is no candidate for the query of its own id; repeated rows are
candidates each, and repeated query ids are one query (the smallest vector). Null ids take no part. Empty table: no rows.
Components and scores that pass 64 bits raise. Extra columns are ignored.

Every query block meets every vector block whose length can matter; where lengths are alike (normalised vectors) that is all of
them, and a vector is copied once per QUERIES queries. That is the cost of exact answers by this method.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweft.shared import cut

#: Vectors in a block, queries in a block, coordinates that prune, and the threshold from which they do.
BLOCK, QUERIES, FOCUS, STEEP = 8192, 2048, 3, 0.6
#: Most rows of the sample that sets the buckets' bounds, and most buckets.
SAMPLE, BUCKETS = 100_000, 4096
#: Vectors whose products with every query give the first bounds.
SEED = 2048
#: Least and most tasks that pair vector blocks with query blocks, and vector blocks for each.
LINKS, MOST_LINKS, LINKED = 64, 4096, 64


def vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<long>), norm2 (double) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.forall("x", finite))
    whole = lambda c: F.when(F.abs(c * scale) < 2.0**63, F.floor(c * scale).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")).cast("long"))
    df = df.select("vec_id", F.transform("x", whole).alias("v"))
    return df.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c))


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Lists to a matrix, extended by zeros; int64."""
    counts = np.diff(np.asarray(rows.offsets))
    flat = np.asarray(rows.flatten(), np.int64)
    out = np.zeros((len(counts), width), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(counts)), counts)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact: p and q hold doubles where no partial sum can pass 2**53, else Python's integers."""
    exact = p @ q
    if exact.dtype == np.float64 or not len(p):
        return exact.astype(np.int64)
    if max(map(abs, exact), default=0) >= 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return exact.astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(ids: np.ndarray, p: np.ndarray, qids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, ids, scores) of the candidates of one block that can be among the k best; bounds[i] is -inf or a score that k
    candidates of query i reach."""
    norm = np.sqrt((p.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-norm, kind="stable")
    ids, p, norm = ids[order], p[order], norm[order]
    unit = p / np.where(norm > 0, norm, 1)[:, None]
    longest = norm[0] if len(norm) else 0.0
    qnorm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    most = float(np.abs(p).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, p.shape[1])
    p, q = (x.astype(np.float64 if most < 2**53 else object) for x in (p, q))
    for i in range(len(qids)):
        bound, size = bounds[i], qnorm[i]
        slack = 1e-9 * (1 + abs(bound)) if np.isfinite(bound) else 0
        at = slice(None)
        if np.isfinite(bound) and bound > 0:
            if size * longest < bound - slack:
                continue
            count = int(np.searchsorted(-norm, -((bound - slack) / size), "right"))  # at least this long
            local = (bound - slack) / (size * longest)
            if local >= STEEP:
                qbar = q[i].astype(np.float64) / size
                keep = np.ones(count, bool)
                for f in np.argsort(-np.abs(qbar))[: min(FOCUS, len(qbar))]:
                    least = np.minimum(1.0, (bound - slack) / (size * norm[:count]))
                    reach = np.sqrt(np.maximum(0, (1 - least**2) * (1 - qbar[f] ** 2))) + 1e-9
                    keep &= np.abs(unit[:count, f] - qbar[f] * least) <= np.where(least >= abs(qbar[f]), reach, np.inf)
                at = np.flatnonzero(keep)
            else:
                at = slice(0, count)
        scores = products(p[at], q[i])
        mine = ids[at]
        other = mine != qids[i]
        if np.isfinite(bound):
            other &= scores >= bound
        mine, scores = best(mine[other], scores[other], k)
        yield qids[i], mine, scores


FOUND = "query_id long, vec_id long, score long"


def table(found: list[tuple]) -> pa.Table:
    ids = [np.full(len(m), q) for q, m, _ in found]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"query_id": pa.array(cat(ids), pa.int64()), "vec_id": pa.array(cat([m for _, m, _ in found]), pa.int64()), "score": pa.array(cat([s for _, _, s in found]), pa.int64())})


def top_k(df: DataFrame, queries: DataFrame, k: int, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer products, ties to the smaller id."""
    rows = cut(vectors(df, scale, id_col, vector_col), "vectors")
    asked = vectors(queries, scale, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_buckets = max(1, min(BUCKETS, -(-n // BLOCK)))
    lot = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    if n_buckets > 1:
        marks = rows.where(lot).agg(F.percentile_approx("norm2", [i / n_buckets for i in range(1, n_buckets)], 10 * n_buckets).alias("q")).first().q or []
        bucket = F.size(F.filter(F.split(F.lit(",".join(map(repr, marks))), ",").cast("array<double>"), lambda m: m <= F.col("norm2")))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("rows"))
    # one row per bucket: at most BUCKETS rows, whatever the input
    sizes = sizes.select("bucket", F.ceil(F.col("rows") / BLOCK).cast("int").alias("parts"))
    blocks = rows.join(F.broadcast(sizes), "bucket").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    blocks = cut(blocks.select("bucket", "part", "vec_id", "v", "norm2"), "blocks")
    n_queries = asked.count()
    groups = max(1, -(-n_queries // QUERIES))
    asked = cut(asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), "queries")
    # the seed block: the SEED longest vectors, a number that does not grow
    seed = blocks.orderBy(F.desc("norm2"), "vec_id").limit(SEED)

    def seeded(keys: tuple, qs: pa.Table, ps: pa.Table) -> pa.Table:
        ids, p = ps.column("vec_id").to_numpy(), matrix(ps.column("v").combine_chunks(), width)
        qids, q = qs.column("vec_id").to_numpy(), matrix(qs.column("v").combine_chunks(), width)
        bounds = [(i, s[-1]) for i, m, s in search_block(ids, p, qids, q, np.full(len(qids), -np.inf), k) if len(m) == k]
        return pa.table({"vec_id": pa.array([i for i, _ in bounds], pa.int64()), "bound": pa.array([float(b) for _, b in bounds], pa.float64())})

    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    seeds = seed.select("vec_id", "v", every_group.alias("group"))
    bounds = asked.groupBy("group").cogroup(seeds.groupBy("group")).applyInArrow(seeded, "vec_id long, bound double")
    asked = cut(asked.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))), "bounded")

    # a pair of a query block and a vector block is one task's work; pairs that length alone rules out are not made
    shapes = blocks.groupBy("bucket", "part").agg(F.max("norm2").alias("longest"))
    needs = asked.withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)))
    needs = needs.groupBy("group").agg(F.min(F.when(F.col("size") > 0, F.col("bound") / F.col("size")).otherwise(F.lit(float("-inf")))).alias("least"))
    # vector blocks are dealt to tasks, each of which sees the bounds of all query blocks
    links = max(LINKS, min(MOST_LINKS, n // BLOCK // LINKED))
    needs = needs.withColumn("link", F.explode(F.sequence(F.lit(0), F.lit(links - 1))))
    work = shapes.withColumn("link", F.pmod(F.xxhash64("bucket", "part"), F.lit(links)).cast("int")).join(needs, "link").where("least <= 0 or sqrt(longest) * (1 + 1e-9) >= least").select("bucket", "part", "group")
    work = cut(work, "work")
    left = asked.join(work, "group").select("group", "bucket", "part", "vec_id", "v", "bound")
    right = blocks.join(work, ["bucket", "part"]).select("group", "bucket", "part", "vec_id", "v")

    def searched(keys: tuple, qs: pa.Table, ps: pa.Table) -> pa.Table:
        ids, p = ps.column("vec_id").to_numpy(), matrix(ps.column("v").combine_chunks(), width)
        qids, q = qs.column("vec_id").to_numpy(), matrix(qs.column("v").combine_chunks(), width)
        return table(list(search_block(ids, p, qids, q, qs.column("bound").to_numpy(), k)))

    key = ["group", "bucket", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(searched, FOUND)
    # the rank limit is applied before the shuffle too, so no buffer holds more than a sorted run
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(df: DataFrame) -> DataFrame:
    return top_k(df, df.where(F.col("vec_id") % 20 == 0), 20)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
