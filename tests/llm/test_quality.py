"""The line CRF: its marginals against enumeration, held-out accuracy, and edge cases."""

import itertools
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from arcweft.llm import quality
from arcweft.llm.words import slices


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 1, 1, 6, 10])
    e, turns = rng.normal(size=10), rng.normal(size=(2, 2))
    got = quality.sigmoid(sum(quality.messages(e, first, turns)))
    for a, b in zip(first[:-1], first[1:]):
        total, good = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=int(b - a)):
            p = np.exp(sum(e[a + i] for i, v in enumerate(y) if v) + sum(turns[u, v] for u, v in zip(y, y[1:])))
            total, good = total + p, good + p * np.array(y)
        if b > a:
            np.testing.assert_allclose(got[a:b], good / total)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op3_quality_classifier(docs, labels).join(labels, "doc_id").where("held_out")
    right, n, bad_kept, good_lost, bad = got.agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*"), F.sum(((F.col("quality") == 0) & (F.col("predicted") == 1)).cast("int")), F.sum(((F.col("quality") == 1) & (F.col("predicted") == 0)).cast("int")), F.sum((F.col("quality") == 0).cast("int"))
    ).first()
    print(right, n, bad_kept, good_lost, bad)
    assert n > 500 and right > 0.97


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\n ", "x"), (4, "word", "x"), (None, "Some words here.\nAnd more.", "x"), (5, "### $$$ " * 20000, "x"), (4, "word", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, None), (None, 1)], "doc_id long, quality int")
    got = quality.op3_quality_classifier(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    none = quality.op3_quality_classifier(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.op3_quality_classifier(docs.limit(0), labels).count() == 0


def test_slicing_changes_nothing():
    import pyarrow as pa

    texts = pa.array(["a b\nc d e.", None, "X Y Z!!\n\nq", "", "tail"])
    model = quality.Model(np.linspace(-1, 1, 3 * len(quality.FEATURES)), 0.3, np.array([[0.5, 0], [0, 0.5]]), np.zeros(len(quality.FEATURES)), np.ones(len(quality.FEATURES)), 0.4)
    whole = np.concatenate([quality.document_scores(model, s) for s in slices(texts)])
    parts = np.concatenate([quality.document_scores(model, s) for s in slices(texts, 5)])
    np.testing.assert_allclose(whole, parts)


def plain_score(model, text):
    """The score by loops over lines, words and bytes."""
    gap = bytes([32, *range(9, 14)])
    rows, sizes, seen = [], [], set()
    for line in (text or "").encode().split(b"\n"):
        words = [w for w in re.split(b"[" + re.escape(gap) + b"]+", line) if w]
        if not words:
            continue
        body = line.strip(gap)
        share = lambda chars: sum(c in chars for c in body) / len(body)  # noqa: B023, E731
        letters = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
        n = len(words)
        rows.append([
            share(b"#*$%&@^~=<>{}[]\\_"), share(b"!?"), share(b"|\t"), share(bytes(range(65, 91))), share(b"0123456789"), share(letters),
            sum(len(w) >= 14 for w in words) / n, sum(len(w) <= 3 for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n, (n - len(set(words))) / n,
            float(tuple(words) in seen), np.log1p(n), np.log(len(body) / n), float(body[-1] in b".!?:;\"')"),
        ])
        seen.add(tuple(words))
        sizes.append(len(body))
    if not rows:
        return model.prior
    x = np.clip((np.array(rows, np.float32) - model.mean) / model.scale, -5, 5)
    none = np.zeros(x.shape[1])
    e = [float(np.r_[x[i], x[i - 1] if i else none, x[i + 1] if i + 1 < len(x) else none] @ model.weights + model.bias) for i in range(len(x))]
    good = []
    for at in range(len(x)):  # both labels of a line, summed over all others, forwards and backwards
        odds = []
        for mine in (0, 1):
            total = 0.0
            for order, turns in ((range(at), model.turns), (range(len(x) - 1, at, -1), model.turns.T)):
                state = None
                for i in order:
                    now = np.array([0.0, e[i]])
                    state = now if state is None else now + np.logaddexp(state[0] + turns[0], state[1] + turns[1])
                if state is not None:
                    total += np.logaddexp(state[0] + turns[0, mine], state[1] + turns[1, mine])
            odds.append(total + (e[at] if mine else 0.0))
        good.append(1 / (1 + np.exp(odds[0] - odds[1])))
    return float(np.dot(good, sizes) / sum(sizes))


def test_query_against_plain_loops(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in quality.op3_quality_classifier(docs, labels).collect()}
    assert set(got) == set(texts)
    for i in sorted(texts)[:250]:
        want = plain_score(model, texts[i])
        assert abs(got[i].score - want) < 1e-4, i
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and (got[i].predicted == int(want >= 0.7) or abs(want - 0.7) < 1e-4)


def test_training_is_bounded(spark, monkeypatch):
    """Long documents and ids that repeat do not swell what reaches the driver."""
    monkeypatch.setattr(quality, "TRAIN_LINES", 20)
    docs = spark.createDataFrame([(i % 5, "\n".join(f"line {i} {j}" for j in range(1000))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    held = []
    monkeypatch.setattr(quality, "fit", lambda x, first, y: held.append((x.shape, first, y)))
    quality.train(docs, labels, most=3)
    (shape, first, y), = held
    assert len(y) <= 3 and shape[0] == 20 * len(y) and np.diff(first).max() == 20
