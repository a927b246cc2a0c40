"""Substring dedup against brute force over all passages."""

import hashlib
import random
import re

from arcweft.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    where = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if i is not None:
                where[key] = min(i, where.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - length + 1):
            if i is not None and where[tuple(w[s : s + length])] < i:
                gone |= set(range(s, s + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, length, seed):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, first int")
    got = sorted(map(tuple, repeats.dedup(docs, length, seed).collect()), key=str)
    assert got == brute(rows, length)


def test_passages_in_common(spark):
    rng = random.Random(1)
    words = lambda n: [f"v{rng.randrange(30)}" for _ in range(n)]
    shared = [words(n) for n in (5, 9, 12, 20, 40)]
    rows = [(None, " ".join(shared[3])), (-1, None), (-2, ""), (-3, "\t "), (-4, " ".join(["é"] * 30)), (-5, " ".join(["é"] * 31)), (-6, "a"), (7, " ".join(shared[4])), (7, " ".join(shared[4]))]
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += words(rng.randrange(12)) + rng.choice(shared)[rng.randrange(3) :]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rng.shuffle(rows)
    check(spark, rows, 10, 3)
    check(spark, rows, 10, 10)


def test_words_that_collide_under_polynomial_hashes(spark):
    mirrored = lambda letters: "".join(letters[i.bit_count() & 1] for i in range(2048))
    tail = " ".join(f"t{i}" for i in range(49))
    rows = [(1, f"{mirrored('ab')} {tail}"), (2, f"{mirrored('ba')} {tail}"), (3, f"{mirrored('ab')} {tail} more"), (4, " ".join(mirrored("ab"))), (5, " ".join(mirrored("ba")))]
    check(spark, rows, 50, 15)


def test_long_repetitive_text_and_empty_table(spark):
    check(spark, [(1, "x y z " * 4000), (2, "y z x " * 900 + "end"), (3, "q " * 60)], 50, 15)
    assert repeats.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
