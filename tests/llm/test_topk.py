"""Exact top-k against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweft.llm import topk


def brute(rows, k, step):
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in ok if i % step == 0}:
        qv = min(v for i, v in ok if i == q)
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = random.Random(3)
    gauss = lambda s=1.0: [rng.gauss(0, s) for _ in range(8)]
    centre = [gauss() for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centre)] if i % 3 else gauss(rng.choice([0.01, 1, 9]))) for i in range(300)]
    rows += [(1000 + i, list(centre[0])) for i in range(120)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [0.0] * 8), (2010, [2.5]), (None, gauss()), (7, centre[1]), (7, centre[1]), (10, gauss()), (2020, [3e6] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, df.where(F.col("vec_id") % 10 == 0), 7)
    flat = [tuple(r) for r in got.collect()]
    assert set(flat) == brute(rows, 7, 10)


def test_empty_and_few(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.op1_exact_top_k(df).count() == 0
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [-0.5])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.op1_exact_top_k(df).collect())) == [(0, 1, 1, 2048), (0, 2, 2, -2048)]


def test_a_component_beyond_64_bits_raises(spark):
    df = spark.createDataFrame([(0, [1e19]), (1, [0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.op1_exact_top_k(df).collect()
    df = spark.createDataFrame([(0, [2.0**50]), (1, [-(2.0**50)])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.op1_exact_top_k(df).collect()


def test_alike_lengths_and_many_ties(spark, monkeypatch):
    """Normalised vectors, a third of them equal: no bucket, task or buffer holds a query's hits of all blocks."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "SEED", 16)
    rng = random.Random(5)
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i % 3 == 0 else [rng.choice([-1, 1]) / 2 for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(map(tuple, topk.top_k(df, df.where("vec_id % 20 = 0"), 20).collect())) == brute(rows, 20, 20)
    plan = topk.top_k(df, df.where("vec_id % 20 = 0"), 20)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
