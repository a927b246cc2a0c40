"""Sharding: balance, gapless slots, checksums, hot groups and edge cases."""

import random
import zlib

import pytest

from arcweft.llm import shards


def check(rows, got, n):
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(n))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return by


def test_balance_with_hot_and_long_texts(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 400)))
    hot = text()
    rows = [(i, hot if i % 3 == 0 else text()) for i in range(3000)] + [(4000, "x" * 3000), (None, "n"), (None, "n"), (5000, None), (5001, "")]
    rows += [(6000 + i, "") for i in range(2000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    got = shards.assign(docs, 16, 256).collect()
    by = check(rows, got, 16)
    sizes = [sum(r.size for r in p) for p in by.values()]
    mean = sum(sizes) / 16
    assert len(by) == 16 and max(sizes) - mean < 3000 + mean * 16 / 256 * 2 and mean - min(sizes) < 3000 + mean * 16 / 256 * 2
    # equal texts share a shard, but for those over a fiftieth of its share
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(w) > 1 for w in where.values()) == 1 and len(where[zlib.crc32(hot.encode())]) > 1


def test_small_groups_never_part(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 60))) for _ in range(4000)]
    rows = [(5 * i + j, t) for i, t in enumerate(texts) for j in range(5)] + [(30_000 + i, "") for i in range(3000)]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = check(rows, got, 16)
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(where) == 4001 and all(len(w) == 1 for w in where.values())
    sizes = [sum(r.size for r in p) for p in by.values()]
    assert max(sizes) < 1.03 * min(sizes)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1, "a"), (2, "b")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shards.op7_sharding(docs).collect()
    check(rows, got, 16)
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)


def test_positions(spark):
    at = [-5, -5, 0, 7, 7, 7, 9]
    keys = spark.createDataFrame([(k,) for k in (-9, -5, -1, 0, 6, 7, 8, 9, 99)], "key long")
    got = [r[0] for r in keys.select(shards.position(at, keys.key)).collect()]
    assert got == [sum(a <= k for a in at) for k in (-9, -5, -1, 0, 6, 7, 8, 9, 99)]
