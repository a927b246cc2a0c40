"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines before and after it, with transition
weights between neighbours. Training takes each labelled document's quality as the label of its lines; the marginals of the
forward-backward pass, weighted by line length, average to the document's score in 0..1 (higher: better).

Training uses at most TRAIN_DOCS labelled documents, those of smallest id hash, and of each at most TRAIN_LINES lines in a row (from
a place that its length decides); features are made where the texts are, and only these reach the driver. Scoring has no bound. Scoring is one pass over whole texts and passes all columns through.

Nulls: a null or empty text, or one of empty lines only, scores the share of good documents in training (0.5 without labels).
Null labels and ids train nothing; several labels of one id count as the smallest. Empty tables: no rows, or scores of 0.5.
Repeated rows score alike. Extra columns pass through, but for one named like the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweft.llm.words import Texts, slices

#: Bound of the labelled sample, passes of the optimiser, strength of the prior on weights, and the threshold of `predicted`.
TRAIN_DOCS, STEPS, PRIOR, THRESHOLD = 2000, 120, 1e-3, 0.7
#: Bound of the lines of one labelled document.
TRAIN_LINES = 500
#: Own features of a line; each also counts for the lines before and after.
FEATURES = ("symbols", "marks", "bars", "capitals", "digits", "letters", "long_words", "short_words", "echo", "again", "seen_line", "length", "word_length", "ends")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the own features, those of the line before, those of the line after
    bias: float
    turns: np.ndarray  # [from, to], 1 is good
    mean: np.ndarray
    scale: np.ndarray
    prior: float


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _MARKS, _BARS, _DIGITS = _flags(b"#*$%&@^~=<>{}[]\\_"), _flags(b"!?"), _flags(b"|\t"), _flags(b"0123456789")
_CAPITALS = _flags(bytes(range(65, 91)))
_LETTERS = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_ENDS = _flags(b".!?:;\"')")


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of features of all lines that have a word, where each text's lines begin and end, and the lines' bytes."""
    data, words = texts.data, texts.words()
    n = len(words.start)
    if not n:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(texts.n + 1, np.int64), np.zeros(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line_no = breaks[words.start]
    new = np.ones(n, bool)
    new[1:] = (line_no[1:] != line_no[:-1]) | (words.doc[1:] != words.doc[:-1])
    at = np.flatnonzero(new)  # each line's first word
    after = np.r_[at[1:], n]
    doc, lo, hi = words.doc[at], words.start[at], words.end[after - 1]
    size = (hi - lo).astype(np.float64)
    per_line = (after - at).astype(np.float64)
    line = np.repeat(np.arange(len(at)), after - at)

    def share(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags[data])])
        return (c[hi] - c[lo]) / size

    h = words.hashes()
    length = words.end - words.start
    lines = lambda x: np.bincount(line, x, len(at))
    echo = np.zeros(n)
    echo[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    # a word that stands in the same line already
    order = np.lexsort((h, line))
    again = np.zeros(n)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    whole = np.zeros(len(at), np.uint64)
    np.add.at(whole, line, h * (np.arange(n) - at[line] + 1).astype(np.uint64))
    order = np.lexsort((whole, doc))
    seen = np.zeros(len(at))
    seen[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    rows = np.stack(
        [
            share(_SYMBOLS), share(_MARKS), share(_BARS), share(_CAPITALS), share(_DIGITS), share(_LETTERS),
            lines(length >= 14) / per_line, lines(length <= 3) / per_line, lines(echo) / per_line, lines(again) / per_line,
            seen, np.log1p(per_line), np.log(size / per_line), _ENDS[data[hi - 1]],
        ],
        axis=1,
    )
    return rows.astype(np.float32), np.searchsorted(doc, np.arange(texts.n + 1)), (hi - lo).astype(np.int64)


def with_neighbours(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    starts, n = first[:-1], np.diff(first)
    before[starts[n > 0]] = 0
    after[(first[1:] - 1)[n > 0]] = 0
    return np.concatenate([rows, before, after], axis=1)


def messages(e: np.ndarray, first: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of good from the lines so far (with this one) and from the lines to come, all texts side by side."""
    forward, backward = e.astype(np.float64).copy(), np.zeros(len(e))
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")  # texts with at least t lines
    (t00, t01), (t10, t11) = turns
    for t in range(1, len(active)):
        at = start[: active[t]] + t
        a = forward[at - 1]
        forward[at] += np.logaddexp(a + t11, t01) - np.logaddexp(a + t10, t00)
    for t in range(len(active) - 1, 0, -1):
        at = start[: active[t]] + t
        b = e[at] + backward[at]
        backward[at - 1] = np.logaddexp(b + t11, t10) - np.logaddexp(b + t01, t00)
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: np.ndarray, first: np.ndarray, good: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood with a small prior, by Adam; every text counts the same however many lines it has."""
    mean = rows.mean(0) if len(rows) else np.zeros(len(FEATURES))
    scale = rows.std(0) + 1e-3 if len(rows) else np.ones(len(FEATURES))
    prior = float(good.mean()) if len(good) else 0.5
    size = 3 * len(FEATURES) + 5
    params = np.zeros(size)
    if len(rows) and 0 < prior < 1:
        x = with_neighbours(np.clip((rows - mean) / scale, -5, 5).astype(np.float32), first)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        y = good[doc].astype(np.float64)
        weight = (1 / np.sqrt(np.maximum(n, 1)))[doc]
        weight /= len(n)
        inner = np.ones(len(doc), bool)
        inner[first[1:][n > 0] - 1] = False
        pairs = np.flatnonzero(inner)
        m, v = np.zeros(size), np.zeros(size)
        for step in range(1, steps + 1):
            w, bias, turns = params[:-5].astype(np.float32), params[-5], params[-4:].reshape(2, 2)
            e = x @ w + bias
            forward, backward = messages(e, first, turns)
            gap = weight * (y - sigmoid(forward + backward))
            grad = np.r_[gap.astype(np.float32) @ x, gap.sum(), np.zeros(4)]
            if len(pairs):
                nxt = e[pairs + 1] + backward[pairs + 1]
                joint = np.stack([np.zeros(len(pairs)) + turns[0, 0], nxt + turns[0, 1], forward[pairs] + turns[1, 0], forward[pairs] + nxt + turns[1, 1]])
                joint = np.exp(joint - joint.max(0))
                joint /= joint.sum(0)
                held = np.zeros((4, len(pairs)))
                held[0], held[3] = 1 - y[pairs], y[pairs]
                grad[-4:] = ((held - joint) * weight[pairs]).sum(1)
            grad -= PRIOR * params
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(params[:-5], params[-5], params[-4:].reshape(2, 2), mean, scale, prior)


def marginals(model: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The chance of each line to be good."""
    x = with_neighbours(np.clip((rows - model.mean) / model.scale, -5, 5), first)
    return sigmoid(sum(messages(x @ model.weights + model.bias, first, model.turns)))


def document_scores(model: Model, texts: Texts) -> np.ndarray:
    rows, first, size = line_features(texts)
    n = np.diff(first)
    doc = np.repeat(np.arange(texts.n), n)
    good = np.bincount(doc, marginals(model, rows, first) * size, texts.n)
    total = np.bincount(doc, size, texts.n)
    return np.where(total > 0, good / np.maximum(total, 1), model.prior)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Model:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most)  # at most `most` rows, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                x, first, _ = line_features(texts)
                label = batch.column(0).slice(texts.first, texts.n).to_pylist()
                n = np.diff(first)
                start = first[:-1] + np.where(n > TRAIN_LINES, n * 7919 % np.maximum(n - TRAIN_LINES, 1), 0)
                lines = [x[a:b].tobytes() for a, b in zip(start, start + np.minimum(n, TRAIN_LINES), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(lines, pa.binary())], names=["label", "lines"])

    # ids may repeat in docs: at most `most` rows again. A fixed order, so that training does not depend on how tables are laid out
    found = rows.mapInArrow(run, "label int, lines binary").where(F.octet_length("lines") > 0)
    found = sorted((bytes(r.lines), r.label) for r in found.orderBy(F.xxhash64("lines", "label"), "lines", "label").limit(most).collect())
    x = [np.frombuffer(b, np.float32).reshape(-1, len(FEATURES)) for b, _ in found]
    first = np.cumsum([0, *map(len, x)])
    return fit(np.concatenate(x) if x else np.zeros((0, len(FEATURES)), np.float32), first, np.array([y for _, y in found]))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs, and the score."""
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [document_scores(model, texts) for texts in slices(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def predicted(score: str = "score") -> Column:
    return (F.col(score) >= THRESHOLD).cast("int")


def op3_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted().alias("predicted"))
