"""Decontamination against brute force over all windows, and the recall of the embedding's samples."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from arcweft.llm import decontam
from arcweft.llm.words import slices


def words(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            if not v or not w:
                continue
            k = int(0.2 * len(v) + 1e-9)
            need = Counter(v)
            near = [s for s in range(max(1, len(w) - len(v) + 1)) if sum((need & Counter(w[s : s + len(v)])).values()) >= len(v) - k]
            best = min(((distance(v, w[s : s + len(v)]), s) for s in near), default=(k + 1, 0))
            if best[0] <= k:
                out[d, i] = best
    return out


def edited(rng, text, edits):
    w = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[at] = f"q{rng.randrange(99)}"
        elif kind == 1:
            del w[at]
        else:
            w.insert(at, f"q{rng.randrange(99)}")
    return w


def test_against_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: [f"v{rng.randrange(40)}" for _ in range(n)]
    items = [(i, text(rng.choice([5, 6, 9, 15, 30, 60]))) for i in range(14)]
    docs = []
    for d in range(140):
        w = text(rng.randrange(30))
        for _ in range(rng.randrange(1, 4)):
            _, item = rng.choice(items)
            at = rng.randrange(len(w) + 1)
            w[at:at] = edited(rng, item, rng.randrange(int(0.2 * len(item)) + 2))
        docs.append((d, " ".join(w).upper() if d % 3 else "!! ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, " ".join(items[4][1]) + " x" * 30000), (1003, "a, b.")]
    items = [(i, " ".join(w)) for i, w in items] + [(100, None), (101, "a b"), (102, "")]
    want = brute(docs, items)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.start_word) for r in decontam.leaks(df, bench).collect()}
    assert set(got) <= set(want) and len(want) > 100
    assert len(got) >= 0.98 * len(want)
    assert sum(got[x] == want[x] for x in got) >= 0.97 * len(got)
    dirty = {d for d, _ in got}
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {d for d, _ in docs} - dirty
    old, decontam.BLOCK_BYTES = decontam.BLOCK_BYTES, 400  # several blocks
    try:
        assert {(r.doc_id, r.item_id): (r.edits, r.start_word) for r in decontam.leaks(df, bench).collect()} == got
        assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {d for d, _ in docs} - dirty
    finally:
        decontam.BLOCK_BYTES = old


def windows_found(item, near):
    """Which of the windows of the item's size share a key with it, apart from what verification finds around them."""
    items = decontam.prepare([1], [" ".join(item)])
    found = []
    for i, w in enumerate(near):
        part = decontam.plain_words(next(iter(slices(pa.array([" ".join(w)])))))
        found.append(any(len(s) for _, _, s in decontam.candidates(part, part.hashes(), items)))
    return found


def test_recall_of_single_windows():
    """At the allowed distance, the only window is the text itself: edits at random, evenly spread, in front, behind, at both ends."""
    rng = random.Random(12)
    fresh = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    for m in (5, 9, 10, 15, 25, 37, 44, 59, 64, 130):
        item, k, near = [f"v{i}" for i in range(m)], int(0.2 * m + 1e-9), []
        for way in range(75):
            w = list(item)
            if way % 5 == 0:
                for x in rng.sample(range(m), k):
                    w[x] = fresh(1)[0]
            elif way % 5 == 1:
                for j in range(k):
                    w[(2 * j + 1) * m // (2 * k)] = fresh(1)[0]
            elif way % 5 == 2:
                w[:k] = fresh(k)
            elif way % 5 == 3:
                w[m - k :] = fresh(k)
            else:
                w[: k // 2], w[m - (k - k // 2) :] = fresh(k // 2), fresh(k - k // 2)
            near.append(w)
        assert sum(windows_found(item, near)) >= 0.98 * len(near), m


def test_items_with_a_common_opening(monkeypatch):
    """Thousands of items share their keys with each other and with every line: turns bound what is held at a time."""
    monkeypatch.setattr(decontam, "SPAN", 1 << 12)
    opening = "which of the following statements about the text above is right and why"
    items = decontam.prepare(list(range(3000)), [f"{opening} n{i} m{i} of all" for i in range(3000)])
    texts = next(iter(slices(pa.array([f"{opening} n{i} m{i} of all" for i in (5, 2999)] + [f"{opening} or not at all"] * 3))))
    doc, item, start, edits = decontam.leaks_of(texts, items)
    exact = {(d, i) for d, i, e in zip(doc.tolist(), item.tolist(), edits.tolist()) if e == 0}
    assert exact == {(0, 5), (1, 2999)} and len(doc) >= 0.99 * 2 * 3000 and set(start.tolist()) == {0}


def test_recall_of_samples_at_the_allowed_distance():
    rng = random.Random(9)
    hits = n = 0
    for m in (5, 10, 20, 40, 60):
        for _ in range(60):
            item = [f"v{rng.randrange(200)}" for _ in range(m)]
            near = edited(rng, item, int(0.2 * m))
            near = (near + ["z"] * m)[:m]
            if distance(item, near) > int(0.2 * m):
                continue
            items = decontam.prepare([1], [" ".join(item)])
            texts = next(iter(slices(pa.array([" ".join(near)]))))
            n += 1
            hits += len(decontam.leaks_of(texts, items)[0])
    assert n > 100 and hits >= 0.98 * n


def test_every_leak_of_long_items_is_found():
    rng = random.Random(10)
    for m in (15, 30, 50, 80, 120, 200, 300, 500):
        item = [f"v{rng.randrange(5000)}" for _ in range(m)]
        items, near, k = decontam.prepare([1], [" ".join(item)]), [], int(0.2 * m + 1e-9)
        for way in range(60):
            # substitutions alone, at random or evenly spread: only the aligned window qualifies
            w = list(item)
            for x in rng.sample(range(m), k) if way % 2 else [(2 * j + 1) * m // (2 * k) for j in range(k)]:
                w[x] = f"q{rng.randrange(10**9)}"
            near.append(["z"] * way + w + ["z"] * 9)
        far = ["z"] * 9 + [f"r{x}" if x % 4 == 0 else w for x, w in enumerate(item)] + ["z"] * 9
        texts = next(iter(slices(pa.array([" ".join(w) for w in [*near, far]]))))
        doc, _, start, edits = decontam.leaks_of(texts, items)
        assert doc.tolist() == list(range(60)), m
        assert start.tolist() == list(range(60)) and set(edits.tolist()) == {k}, m


def test_short_items_and_scripts_without_spaces(spark):
    han = "".join(chr(0x4E00 + 7 * i) for i in range(30))
    thai, rare = "ภาษาไทยไม่เว้นวรรค", "".join(chr(0x20000 + 5 * i) for i in range(10))
    items = [(1, "two words"), (2, "Zebra"), (3, han), (4, thai), (5, "one two three four"), (6, rare), (7, "!"), (8, "é—ü")]
    docs = [(1, "here TWO, words end"), (2, "two other words"), (3, "a zebra."), (4, "zebras"), (5, "x" + han[:10] + "一二三" + han[13:] + "y"), (6, han[:15] + "一" * 7 + han[22:])]
    docs += [(7, "ก" + thai + "ข"), (8, "one two three five"), (9, "0 one two three four 0"), (10, "é" + rare[:4] + "丁" + rare[5:]), (11, None), (12, "! é—ü")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.start_word) for r in decontam.op2_benchmark_decontamination(df, bench).collect()}
    assert got == {(1, 1): (0, 1), (3, 2): (0, 1), (5, 3): (3, 1), (7, 4): (0, 1), (9, 5): (0, 1), (10, 6): (1, 1), (12, 8): (0, 0)}
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {2, 4, 6, 8, 11}


def test_distances():
    rng = random.Random(1)
    pairs = [([rng.randrange(4) for _ in range(rng.randrange(9))], [rng.randrange(4) for _ in range(rng.randrange(9))]) for _ in range(300)]
    a, b = (np.array([x for p in pairs for x in p[i]], np.uint64) for i in (0, 1))
    la, lb = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    got = decontam.edit_distances(a, np.cumsum(la) - la, la, b, np.cumsum(lb) - lb, lb, np.full(300, 3))
    for g, (x, y) in zip(got, pairs):
        assert (g == distance(x, y)) if distance(x, y) <= 3 else g > 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == 1
    assert decontam.clean(docs, bench).count() == 0
