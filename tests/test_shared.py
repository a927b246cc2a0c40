"""Hot-key lookups, bitmap semi-joins and components against plain Python."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from arcweft import shared


def test_lookup_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(shared, "HEAVY", 3)
    rows = spark.range(1000).select((F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 40)).cast("long").alias("k"), "id")
    rows = rows.unionAll(spark.createDataFrame([(None, 5000), (77, 5001)], "k long, id long"))
    table = rows.where("k < 30").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v"))
    want = {r.k: r.v for r in table.collect()}
    got = shared.lookup(rows, shared.cut(table), ["k"], "n", F.col("id")).collect()
    assert len(got) == 1002
    assert all(r.v == want.get(r.k) for r in got)
    got = shared.attach(rows, table.drop("n"), ["k"], F.col("id")).collect()
    assert len(got) == 1002
    assert all(r.v == want.get(r.k) for r in got)


def test_row_groups_of_long_rows_are_bounded(spark):
    """120 KB a row, 48 MB in one task: neither its writer nor a reader holds them all."""
    table = shared.cut(spark.range(0, 400, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(15000)), lambda x: F.xxhash64("id", x)).alias("x")))
    (path,) = glob.glob(f"{table.cut_path.removeprefix('file:')}/*.parquet")
    groups = pq.ParquetFile(path).metadata
    assert max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 2 * shared.GROUP["parquet.block.size"]
    assert table.select(F.count("*"), F.sum("id"), F.sum(F.size("x"))).first() == (400, 79800, 6000000)


def test_narrowed_keeps_all_ids(spark):
    rows = spark.range(20000).withColumnRenamed("id", "doc_id")
    ids = spark.range(0, 20000, 97).withColumnRenamed("id", "doc_id")
    got = shared.narrowed(rows, ids, "doc_id")
    assert got.join(ids, "doc_id", "left_semi").count() == ids.count()
    assert got.count() < ids.count() + 50
    assert shared.narrowed(rows, ids.limit(0), "doc_id").count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered_and_dropped(spark):
    rows = spark.range(2000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"))
    got = [(r.k, r.v, r.n) for r in shared.numbered(rows, ["k", "v"]).collect()]
    assert sorted(got, key=lambda r: r[2]) == [(k, v, n) for n, (k, v) in enumerate(sorted((i % 700, i) for i in range(2000)))]
    assert shared.numbered(rows.limit(0), ["k"]).count() == 0
    table = shared.cut(rows)
    assert table.count() == 2000
    shared.drop(table, rows)
    import os

    assert not os.path.exists(table.cut_path.removeprefix("file:"))
