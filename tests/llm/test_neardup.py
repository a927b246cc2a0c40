"""Near-duplicates against brute force over all pairs."""

import random
import re

import pytest

from arcweft.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent=80):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, set()).add(shingles(text, size))
    flat = [(i, s) for i, x in sets.items() for s in x]
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for j, (i, s) in enumerate(flat):
        for x in s:
            index.setdefault(x, []).append(j)
    for j, (i, s) in enumerate(flat):
        common = {}
        for x in s:
            for o in index[x]:
                if o < j:
                    common[o] = common.get(o, 0) + 1
        for o, c in common.items():
            if 100 * c >= percent * (len(s) + len(flat[o][1]) - c):
                a, b = find(i), find(flat[o][0])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def check(spark, rows, size):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = neardup.near_duplicates(docs, shingle=size).collect()
    assert len(got) == len(rows)
    want = brute([(i, t) for i, t in rows if i is not None], size)
    for r in got:
        if r.doc_id is not None:
            assert (r.doc_id, r.component_id) == (r.doc_id, want[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)
    return {(r.doc_id, r.n_shingles) for r in got}


def mirrored(n, letters="ab"):
    """The Thue-Morse word over two letters: it and its complement collide under any polynomial hash modulo 2**64."""
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_bounds_follow_the_parameters():
    assert neardup.needed(32, 80) == 3 and neardup.needed(16, 80) == 1 and neardup.needed(32, 60) == 1
    assert 10 / 32 < neardup.least_share(32, 80) < 12 / 32 and neardup.least_share(32, 50) < 2 / 32


def test_a_large_family_and_a_lower_similarity(spark):
    """Half of all rows are one family: its pivots are in pairs with all of them."""
    rng = random.Random(8)
    rows = list(enumerate(family(rng, [f"v{rng.randrange(300)}" for _ in range(50)], 500, 3) + [" ".join(f"u{rng.randrange(9999)}" for _ in range(40)) for _ in range(500)]))
    rng.shuffle(rows)
    check(spark, rows, 2)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_families_common_passages_and_edge_cases(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(40)
    rows = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two")]
    i = 100
    for n, size, edits in ((90, 60, 4), (70, 200, 14), (20, 12, 2)):  # longer than LIST: pivots and leftovers
        for t in family(rng, text(size), n, edits):
            rows.append((i, t))
            i += 1
    for _ in range(80):  # a passage that many share, the rest their own
        rows.append((i, " ".join(passage + text(rng.randint(5, 60)))))
        i += 1
    rows += [(i, "x y z " * 3000), (i + 1, "x y z " * 2999), (8, "One Two"), (8, "One Two"), (9, "É è")]
    rng.shuffle(rows)
    rows += [(30, "r s t u"), (31, "r s t u"), (31, "k l m n"), (32, "k l m n"), (33, "k l m"), (33, "g h")]  # ids with two texts
    rows += [(20, mirrored(2048)), (21, mirrored(2048, "ba")), (22, mirrored(4096)), (23, " ".join(mirrored(1024))), (24, " ".join(mirrored(1024, "ba")))]
    counts = check(spark, rows, 2)
    assert {(1, 0), (4, 1), (6, 1), (i, 3)} <= counts


def test_shingles_of_five(spark):
    rng = random.Random(6)
    base = [f"v{rng.randrange(99)}" for _ in range(120)]
    check(spark, list(enumerate(family(rng, base, 60, 5) + family(rng, base[:30], 20, 1))), 5)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("size", [2])
def test_documents_table(spark, size):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, size)
