"""Near-duplicate detection by bottom-k sketches from one hash function.

1. One pass over whole texts gives each document's set size, a 128-bit digest of its set of word shingles and its sketch: the
   k smallest shingle hashes. Equal sets collapse to one representative, so exact copies cost one sum.
2. Inverted lists: each pair of values that stand side by side in a sketch is a key. Two sets of similarity 0.8 share such
   a pair for certain while their sketches hold the whole sets, and with probability over 1 - 1e-9 at k = 32 otherwise
   (at a similarity s and other k the chance of none is about (1 - s * s) ** (k / 2) or less).
   Lists up to LIST documents give all their pairs of fitting sizes. Longer lists give star pairs to a few pivots; what
   pivots leave apart is compared block by block with the rest of its list (`leftovers`), so nothing is lost.
3. The union of two sketches estimates the similarity; a loose bound drops chance pairs.
4. The exact sets of what is left are intersected; links that could not change any component are skipped.
5. Components over links, by stars.

Words are runs of bytes other than space, tab to carriage return, after lower-casing A-Z; a text with fewer words than a
shingle is one shingle. Nulls and texts without words: an empty set, linked with nothing, its own component. A null id: the
row is returned with a null component. Repeated rows (one id) get the same component, different texts of one id too (but for its
empty ones). Shingles are compared as 63-bit hashes, mixed without linear structure: two of n are taken for equal with a chance
of n * n / 2**64. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweft.llm.words import Runs, Words, mix, signed, slices
from arcweft.shared import attach, components, cut, lookup, narrowed

#: Retained values per document.
K = 32
#: Longest inverted list that gives all its pairs; pivots of a longer one; documents in a block of `leftovers`.
LIST, PIVOTS, BLOCK = 32, 3, 256
#: Lists that a pair of no long list must share. Under WHOLE shingles (sketches may hold whole sets) one is enough; above, two sets
#: of similarity 0.8 share fewer than SHARED with a probability of 2e-7 at k = 32. `needed` sets it for other k and similarities.
WHOLE, SHARED = 40, 3
#: Chance that the estimate from two sketches drops a pair that has the similarity.
LOSS = 1e-8
#: Pairs of one document that a task of the exact check may hold.
FAN = 256


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending within each text, and where each text's begin and end."""
    runs, first, n = Runs(words.hashes()), words.first, len(words.start)
    start = np.arange(n)
    left = first[words.doc + 1] - start  # words from here to the end of the text
    whole = np.diff(first)[words.doc] < size
    use = np.where(whole, start == first[words.doc], left >= size)
    start, left, whole = start[use], left[use], whole[use]
    value = runs.of(start, np.where(whole, left, size)) >> np.uint64(1)  # 63 bits: the same order signed
    doc = words.doc[use]
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(words.texts.n + 1))


def set_digests(values: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit digest of each text's set: the sum of its mixed values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values, seed), out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(values), pa.int64()))


def needed(k: int, percent: int) -> int:
    """Lists that two large sets must share: SHARED where its chance of loss is known, else one."""
    return SHARED if k >= K and percent >= 80 else 1


def least_share(k: int, percent: int) -> float:
    """The share of a union sketch of k values below which two sets of the similarity fall with a chance under LOSS."""
    p, below, common = percent / 100, 0.0, 0
    while common < k:
        below += math.comb(k, common) * p**common * (1 - p) ** (k - common)
        if below > LOSS:
            break
        common += 1
    return max(0.0, common - 0.5) / k


SKETCH = "doc_id long, n long, fp1 long, fp2 long, sketch array<long>"


def sketches(docs: DataFrame, size: int, k: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                values, first = shingle_sets(texts.words(lower=True), size)
                n = np.diff(first)
                rank = np.arange(len(values)) - np.repeat(first[:-1], n)
                held = np.minimum(n, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, texts.n).cast(pa.int64()),
                        pa.array(n.astype(np.int64)),
                        pa.array(signed(set_digests(values, first, 11))),
                        pa.array(signed(set_digests(values, first, 12))),
                        list_array(values[rank < k], np.r_[0, np.cumsum(held)]),
                    ],
                    names=["doc_id", "n", "fp1", "fp2", "sketch"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                values, first = shingle_sets(texts.words(lower=True), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), list_array(values, first)], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def scan_lists(longest: int, percent: int, k: int):
    """Rows (key, n, doc), sorted, to pairs of short lists (hot false; key: how many lists the pair must share) and the rows
    of long ones (hot true; b: the size)."""

    whole, need = max(WHOLE, 5 * k // 4), needed(k, percent)

    def emit(key: np.ndarray, n: np.ndarray, doc: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        pairs = [[], [], []]
        at = np.flatnonzero(~hot)
        k, m, d = key[at], n[at], doc[at]
        for shift in range(1, longest):
            same = k[shift:] == k[:-shift]
            if not same.any():
                break
            near = same & fits(m[shift:], m[:-shift], percent)
            pairs[0].append(d[:-shift][near])
            pairs[1].append(d[shift:][near])
            pairs[2].append(np.where(np.minimum(m[shift:], m[:-shift])[near] <= whole, 1, need))
        c = np.concatenate([*pairs[2], key[hot]]).astype(np.int64)
        a = np.concatenate([*pairs[0], doc[hot]])
        b = np.concatenate([*pairs[1], n[hot]])
        is_hot = np.arange(len(a)) >= len(a) - hot.sum()
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(a), pa.array(b), pa.array(is_hot)], names=["key", "a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        last_hot = None  # a key whose list is known to be long
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            key, n, doc = (np.concatenate(x) for x in zip(held, new, strict=True))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            if not len(starts):
                continue
            lengths = np.diff(np.r_[starts, len(key)])
            hot = np.repeat((lengths > longest) | ((key[starts] == last_hot) if last_hot is not None else False), lengths)
            end = starts[-1] if not hot[-1] else len(key)  # an open short list waits for its rest
            if hot[-1]:
                last_hot = key[-1]
            yield emit(key[:end], n[:end], doc[:end], hot[:end])
            held = [key[end:], n[end:], doc[end:]]
        if len(held[0]):
            hot = np.zeros(len(held[0]), bool)
            yield emit(*held, hot)

    return run


def estimated(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch has at least `least_share` of its values in both."""
    one = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    both = attach(attach(pairs, one, ["a"], F.col("b")), two, ["b"], F.col("a"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.withColumn("u", union)
    common = F.size(F.array_intersect("u", F.array_intersect("sa", "sb")))
    return both.where(common >= least_share(k, percent) * F.size("u")).select("a", "b").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity. A document with many pairs, at either end, is copied to several tasks."""

    def end(rows: DataFrame, c: str, other: str) -> tuple[DataFrame, DataFrame]:
        fan = cut(rows.groupBy(c).agg(F.count("*").alias("n")).withColumn("m", F.ceil(F.col("n") / FAN).cast("int")), "fan")
        dealt = lookup(rows, fan, [c], "n", F.col(other)).withColumn(f"part_{c}", F.pmod(F.xxhash64(other), F.col("m")).cast("int")).drop("n", "m")
        copies = sets.join(fan, sets.doc_id == fan[c]).select(c, F.col("shingles").alias(f"s{c}"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias(f"part_{c}"))
        return dealt, copies

    dealt, one = end(pairs, "a", "b")
    dealt, two = end(dealt, "b", "a")
    both = dealt.join(one, ["a", "part_a"]).join(two, ["b", "part_b"])
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def with_component(rows: DataFrame, on: str, comps: DataFrame, name: str, spread: str) -> DataFrame:
    comps = comps.select(F.col("id").alias(on), F.col("component").alias(name))
    return attach(rows, comps, [on], F.col(spread)).withColumn(name, F.coalesce(name, on))


def block_units(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (grp, doc, n, comp, ...) to small tasks: each pair of blocks of documents whose sizes can fit is a `unit`.

    A document of size level l meets those of levels l - 1 and l; groups or levels that are one component make no unit."""
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * 1.000001)).cast("int")
    rows = rows.withColumn("level", F.explode(F.array(level, level + 1))).withColumn("own", F.col("level") == level)
    rows = cut(rows, "levels")
    counts = rows.groupBy("grp", "level").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / BLOCK).cast("int").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    counts = cut(counts.where("lo < hi").drop("lo", "hi"), "counts")
    rows = lookup(rows, counts, ["grp", "level"], "rows", F.col("doc")).where("m is not null")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.withColumn("first", F.col("block") <= F.col("other")).withColumn("second", F.col("block") >= F.col("other"))
    rows = rows.withColumn("unit", F.xxhash64("grp", "level", F.least("block", "other"), F.greatest("block", "other")))
    return rows.drop("level", "rows", "m", "block", "other")


def common_values(values: pa.ListArray, docs: int) -> np.ndarray:
    """How many values each two of the lists have in common."""
    flat = np.asarray(values.flatten(), np.int64)
    doc = np.repeat(np.arange(docs), np.diff(np.asarray(values.offsets)))
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    code, doc = (np.cumsum(shared) - 1)[code[shared[code]]], doc[shared[code]]
    out, width = np.zeros((docs, docs), np.float32), 4096
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    for lo in range(0, int(shared.sum()), width):
        at = slice(*np.searchsorted(code, [lo, lo + width]))
        m = np.zeros((docs, width), np.float32)
        m[doc[at], code[at] - lo] = 1
        out += m @ m.T
    return out


def open_pairs(frame: pa.Table, percent: int) -> tuple[np.ndarray, ...]:
    """doc, n and which two rows of a unit are still to be compared."""
    doc, n, comp, own, first, second = (frame.column(c).to_numpy() for c in ("doc", "n", "comp", "own", "first", "second"))
    ask = first[:, None] & second[None, :] & (comp[:, None] != comp[None, :]) & (own[:, None] | own[None, :]) & (doc[:, None] != doc[None, :])
    return doc, n, comp, ask & fits(n[:, None], n[None, :], percent)


def leftovers(groups: DataFrame, classes: DataFrame, comps: DataFrame, exact_sets, percent: int, k: int) -> DataFrame | None:
    """Links (a, b) within groups (grp, doc, n) between documents that are still in different components.

    First sketches tell which documents have any partner at all; only their sets are compared, exactly, unit by unit, and
    a unit reports no more links than join its components."""
    rows = with_component(groups, "doc", comps, "comp", "grp")
    apart = cut(rows.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("grp", "rows"), "apart")
    rows = lookup(rows, apart, ["grp"], "rows", F.col("doc")).where("rows is not null").drop("rows")
    rows = cut(attach(rows, classes.select(F.col("rep").alias("doc"), F.col("n").alias("size"), "sketch"), ["doc"], F.col("grp")).where("size = n").drop("size"), "open")
    if rows.isEmpty():
        return None

    share = least_share(k, percent)

    def hopeful(keys: tuple, frame: pa.Table) -> pa.Table:
        doc, n, _, ask = open_pairs(frame, percent)
        if ask.any():
            both = common_values(frame.column("sketch").combine_chunks(), len(doc))
            held = np.minimum(n, k)
            ask &= both >= share * np.minimum(k, held[:, None] + held[None, :] - both)
        return pa.table({"doc": pa.array(np.unique(doc[ask.any(0) | ask.any(1)]), pa.int64())})

    some = cut(block_units(rows, percent).groupBy("unit").applyInArrow(hopeful, "doc long").distinct(), "hopeful")
    sets = exact_sets(some.select(F.col("doc").alias("id")))
    rows = rows.drop("sketch").join(sets.select(F.col("doc_id").alias("doc"), "shingles"), "doc").where(F.size("shingles") == F.col("n"))

    def linked(keys: tuple, frame: pa.Table) -> pa.Table:
        doc, n, comp, ask = open_pairs(frame, percent)
        a, b = [], []
        if ask.any():
            both = common_values(frame.column("shingles").combine_chunks(), len(doc)).astype(np.int64)
            root = {c: c for c in comp.tolist()}
            for i, j in np.argwhere(ask & (100 * both >= percent * (n[:, None] + n[None, :] - both))).tolist():
                x, y = root[comp[i]], root[comp[j]]
                if x != y:
                    root = {c: x if r == y else r for c, r in root.items()}
                    a.append(min(doc[i], doc[j]))
                    b.append(max(doc[i], doc[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut(block_units(rows, percent).groupBy("unit").applyInArrow(linked, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; linked: 100 * common >= percent * union."""
    every = cut(sketches(docs, shingle, k, id_col, text_col), "sketches")
    classes = every.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    classes = cut(classes, "classes")
    side_by_side = F.expr("transform(sequence(1, size(sketch) - 1), i -> xxhash64(sketch[i - 1], sketch[i]))")
    keys = classes.where("n > 1").select("rep", "n", F.explode(side_by_side).alias("key"))
    lists = keys.select("key", "n", F.col("rep").alias("doc")).repartition("key").sortWithinPartitions("key", "n", "doc")
    found = cut(lists.mapInArrow(scan_lists(LIST, percent, k), "key long, a long, b long, hot boolean"), "lists")
    pairs = found.where("not hot").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("key").alias("need"))
    hot = found.where("hot").select("key", F.col("a").alias("doc"), F.col("b").alias("n"))
    # long lists with one smallest document are one group: the lists of a family of copies fall together
    heads = cut(hot.groupBy("key").agg(F.min("doc").alias("grp"), F.count("*").alias("rows")), "heads")
    groups = cut(lookup(hot, heads, ["key"], "rows", F.col("doc")).select("grp", "doc", "n").distinct(), "groups")
    pivots = groups.groupBy("grp").agg(*(F.min_by("doc", F.xxhash64("doc", F.lit(i))).alias(f"p{i}") for i in range(1, PIVOTS)), F.count("*").alias("rows"))
    pivots = cut(pivots.select("grp", "rows", F.array_distinct(F.array("grp", *(f"p{i}" for i in range(1, PIVOTS)))).alias("pivots")), "pivots")
    stars = lookup(groups, pivots, ["grp"], "rows", F.col("doc")).select("doc", F.explode("pivots").alias("p")).where("doc <> p").select(F.least("doc", "p").alias("a"), F.greatest("doc", "p").alias("b"), F.lit(1).cast("long").alias("need"))
    overlaps = pairs.unionAll(stars).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where("shared >= need")
    candidates = cut(estimated(cut(overlaps.select("a", "b"), "overlaps"), classes, k, percent), "candidates")

    def exact_sets(ids: DataFrame) -> DataFrame:
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        ids = cut(ids.select(F.col("id").alias("doc_id")).distinct(), "ids")
        rows = narrowed(texts, ids, "doc_id").join(ids, "doc_id", "left_semi")
        return cut(full_sets(rows.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h"), shingle), "sets")

    def ends(p: DataFrame) -> DataFrame:
        return p.select(F.col("a").alias("id")).unionAll(p.select(F.col("b").alias("id")))

    # an id with several texts is one document: it links the classes of its texts
    texts_of = every.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("fp1", "fp2", "n")).alias("lo"), F.max(F.struct("fp1", "fp2", "n")).alias("hi"))
    several = cut(every.select("doc_id", "fp1", "fp2", "n").where("n > 0").join(texts_of.where("lo <> hi").select("doc_id"), "doc_id", "left_semi").distinct(), "several")
    same = several.join(classes.select("fp1", "fp2", "n", "rep"), ["fp1", "fp2", "n"]).select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).where("a < b")
    sets = exact_sets(ends(candidates))
    # first a forest: each document with its smallest partner; then only pairs that would still join two components
    forest = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = cut(confirmed(forest, sets, percent).unionAll(same), "links")
    comps = cut(components(links), "comps")
    rest = with_component(with_component(cut(candidates.join(forest, ["a", "b"], "left_anti"), "rest"), "a", comps, "ca", "b"), "b", comps, "cb", "a").where("ca <> cb").select("a", "b")
    links = cut(links.unionAll(confirmed(cut(rest, "rest"), sets, percent)), "links")
    comps = cut(components(links), "comps")
    more = leftovers(groups, classes, comps, exact_sets, percent, k)
    if more is not None and not more.isEmpty():
        comps = cut(components(links.unionAll(more)), "comps")
    roots = comps.select(F.col("id").alias("rep"), F.col("component").alias("component_id"))
    reps = classes.select("fp1", "fp2", "n", "rep", "copies").join(roots, "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    reps = cut(reps.select("fp1", "fp2", "n", "copies", "component_id"), "reps")
    out = lookup(every.drop("sketch"), reps, ["fp1", "fp2", "n"], "copies", F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle=2)
