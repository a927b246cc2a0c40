"""Substring dedup by seed and extend: words inside a passage of `length` words that also starts in an earlier document go.

1. Every run of `seed` words has a hash; the winnowed anchor of a passage of `length` words is its smallest such hash (the
   first of equals). Neighbouring passages share anchors, so there is about one anchor per 18 words.
2. Documents are joined on anchors. An anchor with the span of all passages it stands for, extended both ways, is one
   context. A context that an earlier document also has is a repeat as it stands, with no more work.
3. Where an anchor has different contexts, only the first document of each context is extended passage by passage: the
   passages around the seed are matched by hash, each with the smallest document that holds it.
4. Matched passages of a document merge to maximal repeats of at least `length` words, and their words are removed.

Documents without a match never leave the first pass; it hashes their kept words there. Whole texts are read, whatever
their length. Nulls: a null text is empty; rows with a null id take part as no other's source and lose nothing. Rows
that repeat an id are each judged against smaller ids only. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweft.llm.words import Runs, Words, mix, signed, slices
from arcweft.shared import cut, lookup, narrowed

LENGTH, SEED = 50, 15


def anchors(words: Words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each run of passages with one anchor: its hash, the hash of its whole context, text, first passage, passages."""
    h = words.hashes()
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    runs = Runs(h)
    starts = np.arange(n - seed + 1)
    grams = runs.of(starts, seed)
    wide = length - seed + 1
    # the smallest of `wide` grams from each place, by doubling; the place is kept in the low bits, so the first wins ties
    bits = np.uint64(max(1, int(n).bit_length()))
    best = (grams >> bits << bits) | starts.astype(np.uint64)
    step = 1
    while step * 2 <= wide:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = np.minimum(best[: n - length + 1], best[wide - step : wide - step + n - length + 1])
    anchor = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    passage = np.arange(n - length + 1)
    inside = words.doc[passage] == words.doc[passage + length - 1]
    new = np.ones(len(passage), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(passage)]
    first, last = first[inside[first]], last[inside[first]]
    at = anchor[first]
    # the place of the anchor in the context is part of the context
    context = mix(runs.of(first, last - first + length - 1, 1) + (at - first).astype(np.uint64), 3)
    return grams[at], context, words.doc[first], first - words.first[words.doc[first]], last - first


def kept_hashes(words: Words, keep: np.ndarray | None = None) -> list[str]:
    """SHA-256 of every text's words (those marked) with one space between, laid out in bulk."""
    start, end, first = words.start, words.end, words.first
    if keep is not None:
        first = np.r_[0, np.cumsum(keep)][first]
        start, end = start[keep], end[keep]
    length = end - start
    to = np.cumsum(length + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    if len(to):
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[step + np.repeat(to - length - 1, length)] = words.data[step + np.repeat(start, length)]
    edges = np.r_[0, to][first]
    flat = out.tobytes()
    return [hashlib.sha256(flat[a : max(a, b - 1)]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def covered(words: Words, doc: np.ndarray, first: np.ndarray, passages: np.ndarray, length: int) -> np.ndarray:
    """Which words of all texts lie in the passages first .. first + passages - 1 of their text."""
    edge = np.zeros(len(words.start) + 1, np.int64)
    at = words.first[doc] + first
    np.add.at(edge, at, 1)
    np.add.at(edge, at + passages + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


#: A text's digest row has a null anchor.
FOUND = "doc_id long, row long, anchor long, context long, first int, passages int, n_words long, plain string"


def seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                words = texts.words()
                anchor, context, doc, first, count = anchors(words, length, seed)
                ids, row = (batch.column(i).slice(texts.first, texts.n) for i in (0, 2))
                m = len(anchor)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids.take(pa.array(doc)), ids]),
                        pa.concat_arrays([row.take(pa.array(doc)), row]),
                        pa.concat_arrays([pa.array(signed(anchor)), pa.nulls(texts.n, pa.int64())]),
                        pa.concat_arrays([pa.array(signed(context)), pa.nulls(texts.n, pa.int64())]),
                        pa.concat_arrays([pa.array(first, pa.int32()), pa.nulls(texts.n, pa.int32())]),
                        pa.concat_arrays([pa.array(count, pa.int32()), pa.nulls(texts.n, pa.int32())]),
                        pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(np.diff(words.first), pa.int64())]),
                        pa.concat_arrays([pa.nulls(m, pa.string()), pa.array(kept_hashes(words), pa.string())]),
                    ],
                    names=["doc_id", "row", "anchor", "context", "first", "passages", "n_words", "plain"],
                )

    return docs.mapInArrow(run, FOUND)


def passage_hashes(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, text, row, runs array<struct<anchor, first, passages>>) to a row per passage: doc_id, row, at, two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_runs = batch.column(3)
            for part in slices(batch.column(1)):
                words = part.words()
                hashed = Runs(words.hashes())
                runs = all_runs.slice(part.first, part.n)
                counts = np.diff(np.asarray(runs.offsets))
                flat = runs.flatten()
                anchor, first, passages = (np.asarray(x) for x in flat.flatten())
                doc = np.repeat(np.arange(part.n), counts)
                row = np.repeat(np.arange(len(first)), passages)
                at = np.arange(len(row)) - np.repeat(np.cumsum(passages) - passages, passages) + first[row]
                start = at + words.first[doc[row]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(part.first, part.n).take(pa.array(doc[row])) for i in (0, 2)), pa.array(at, pa.int32()), pa.array(signed(hashed.of(start, length, 4))), pa.array(anchor[row], pa.int64())],
                    names=["doc_id", "row", "at", "passage", "anchor"],
                )

    return texts.mapInArrow(run, "doc_id long, row long, at int, passage long, anchor long")


def removed(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, text, row, runs array<struct<first, passages>>) to doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                words = part.words()
                runs = batch.column(3).slice(part.first, part.n)
                first, passages = (np.asarray(x).astype(np.int64) for x in runs.flatten().flatten())
                doc = np.repeat(np.arange(part.n), np.diff(np.asarray(runs.offsets)))
                gone = covered(words, doc, first, passages, length)
                n, lost = np.diff(words.first), np.diff(np.r_[0, np.cumsum(gone)][words.first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.n), pa.array(n.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(kept_hashes(words, ~gone), pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
                )

    return texts.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`row` tells apart rows of one id with different texts."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"))


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, first, passages): runs of passages that an earlier document also holds; and (doc_id, row, n_words, plain)
    of every row."""
    texts = identified(docs, id_col, text_col)
    found = cut(seeds(texts, length, seed), "seeds")
    every = found.where("anchor is null").select("doc_id", "row", "n_words", "plain")
    runs = found.where("anchor is not null and doc_id is not null").select("doc_id", "row", "anchor", "context", "first", "passages")
    contexts = runs.groupBy("anchor", "context").agg(F.min("doc_id").alias("source"), F.count("*").alias("rows"))
    contexts = cut(contexts, "contexts")
    several = contexts.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum("rows").alias("rows")).where("rows > 1").select("anchor", "contexts", "rows")
    several = cut(several, "shared")  # anchors that occur once are in no repeat
    shared = lookup(contexts, several.select("anchor", "contexts", F.col("contexts").alias("weight")), ["anchor"], "weight", F.col("context")).where("contexts is not null").select("anchor", "context", "source", "rows", "contexts")
    shared = cut(shared, "contexts")
    known = lookup(runs, shared, ["anchor", "context"], "rows", F.col("doc_id")).where("source is not null")
    known = cut(known.select("doc_id", "row", "anchor", "first", "passages", "source", "contexts"), "known")
    same = known.where("source < doc_id").select("doc_id", "row", "first", "passages")
    open_runs = known.where("source = doc_id and contexts > 1").groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "first", "passages")).alias("runs"))
    open_runs = cut(open_runs, "open")
    rows = passage_hashes(narrowed(texts, open_runs, "doc_id").join(open_runs, ["doc_id", "row"]).select("doc_id", "text", "row", "runs"), length)
    rows = cut(rows, "passages")
    sources = cut(rows.groupBy("anchor", "passage").agg(F.min("doc_id").alias("source"), F.count("*").alias("rows")).where("rows > 1"), "sources")
    single = lookup(rows, sources, ["anchor", "passage"], "rows", F.col("doc_id")).where("source < doc_id").select("doc_id", "row", F.col("at").alias("first"), F.lit(1).alias("passages"))
    return same.unionAll(single), every


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    found, every = repeats(docs, length, seed, id_col, text_col)
    per_doc = cut(found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "passages")).alias("runs")), "repeats")
    texts = identified(docs, id_col, text_col)
    changed = removed(narrowed(texts, per_doc, "doc_id").join(per_doc, ["doc_id", "row"]).select("doc_id", "text", "row", "runs"), length)
    same = every.join(per_doc.select("doc_id", "row"), ["doc_id", "row"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("plain").alias("kept_sha256"))
    return same.unionAll(changed)


def op9_substring_dedup(docs: DataFrame) -> DataFrame:
    return dedup(docs)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS s FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT h.doc_id, list(h.i) AS s FROM h JOIN m ON h.h = m.h AND m.s < h.doc_id GROUP BY h.doc_id),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(s) AS i FROM c) , unnest(range(0, 50)) AS t(k), LATERAL (SELECT i + k AS j)),
r AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
k AS (SELECT doc_id, j, w[j] AS x FROM (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS j FROM d SEMI JOIN r ON r.doc_id = d.doc_id) ANTI JOIN g USING (doc_id, j)),
q AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM k GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(len(r.gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN r.doc_id IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(q.t, '') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)
"""
