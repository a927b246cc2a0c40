"""Benchmark decontamination: documents that hold a window close in edit distance to a benchmark item.

Texts become words (runs of letters and digits, case folded for ASCII and Latin-1; in scripts without spaces, such as Chinese,
Japanese or Thai, each character is a word). An item of m words is leaked by a document
with a window of m words at most floor(0.2 * m) word edits away. In one pass over whole texts:

1. CGK embedding: a random walk over a window's words, which stays on a word or steps on as random bits of the word say, and writes
   down the word at each step. Windows a few edits apart give walks that agree in most places (Hamming distance). A
   window is walked from its first word on and from its last word back, WALKS times each, with as many steps as the least window
   of its length class has words, so that no walk leaves its window and windows of all sizes at one place share their walks.
2. Bit sampling: SAMPLES sets of PLACES steps of every walk are the keys of hash tables that hold the items' own walks. A window
   and an item that agree on any key are a candidate. The numbers are chosen for a recall over 0.99 of single windows at the
   allowed distance in every length class (measured over random, evenly spread, leading and trailing edits: 0.998 and
   more); most leaks have several windows near enough. Items over LONGEST words enter as parts of 33 to 48 words; of edits within the
   allowed share one part at least has no more than its share.
3. An edit changes at most two word pairs, so a window within k edits of an item of m words holds at least m - 1 - 2k pairs
   of the item's. Windows with fewer pairs of any item are not walked, candidates with fewer of their own item's not verified.
   This loses nothing. Items under five words allow no edit, so their walks are equal and none is missed.
4. All others are verified by exact banded edit distance, with the windows around them; the closest window is returned.

Items are sent to the tasks in blocks of at most BLOCK_BYTES of text, each block one pass; so what is sent is bounded
whatever the benchmark's size. Candidates are formed and verified in turns of at most SPAN of them, so items that share a key
with many others (common openings) cost time, not memory. No shuffle of texts.

Nulls: a null document or item text is empty; items without words match nothing. Null ids are returned as they are.
Repeated rows each give their rows; ties between windows go to the earliest. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweft.llm.words import Texts, Words, mix, slices
from arcweft.shared import cut

EDITS = 0.2
#: Walks in each direction, samples of each, and steps in a sample.
WALKS, SAMPLES, PLACES = 6, 12, 3
#: Least words of the length classes, and the most words of an item that is embedded whole.
CLASSES, LONGEST, PART = (1, 2, 3, 5, 6, 8, 11, 15, 20, 26, 34, 45), 64, 48
BLOCK_BYTES = 16 << 20
#: Bits of the bitmap of word pairs.
PAIR_BITS = 22
#: Bytes of text, candidates (and words of spans of windows) and cells of the bands of windows worked on at a time.
SLICE, SPAN, CELLS = 1 << 19, 1 << 18, 1 << 18

#: All ASCII characters other than letters and digits part words.
_GAPS = np.zeros(256, bool)
_GAPS[:128] = [not chr(c).isalnum() for c in range(128)]

#: First and last characters of scripts written without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Javanese, Balinese, kana, Han.
_UNSPACED = np.array([(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)])


def unspaced(data: np.ndarray) -> np.ndarray:
    """Bytes where characters of scripts without spaces begin, and where they end."""
    at = np.flatnonzero(data >= 0xE0)
    four = data[at] >= 0xF0
    byte = lambda i: data[np.minimum(at + i, len(data) - 1)].astype(np.int64)
    code = ((byte(0) & 15) << 12) | ((byte(1) & 63) << 6) | (byte(2) & 63)
    code = np.where(four, ((code & 0x7FFF) << 6) | (byte(3) & 63), code)
    among = np.searchsorted(_UNSPACED[:, 0], code, "right") - 1
    ok = (among >= 0) & (code <= _UNSPACED[among, 1])
    return np.concatenate((at[ok], at[ok] + 3 + four[ok]))


def folded(data: np.ndarray) -> np.ndarray:
    """Small letters for A-Z and for the capitals U+00C0 to U+00DE (two bytes in UTF-8)."""
    out = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += np.uint8(32)
    return out


def plain_words(texts: Texts) -> Words:
    return Words(texts, folded(texts.data), _GAPS, unspaced(texts.data))


@dataclass(frozen=True)
class Tables:
    """The hash tables of a length class: sizes of its parts, and by sorted key the part's item, offset and size."""

    low: int
    sizes: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    maybe: np.ndarray  # a bitmap of the keys' last bits


@dataclass(frozen=True)
class Items:
    """Words of all items end to end, the tables of their walks, and their word pairs."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    tables: list[Tables]
    pairs: np.ndarray  # hashes of (item, word pair), sorted
    any_pairs: np.ndarray  # hashes of word pairs, sorted
    maybe: np.ndarray  # a bitmap of their first bits


def allowed(m: np.ndarray) -> np.ndarray:
    return np.floor(EDITS * m + 1e-9).astype(np.int64)


def pair_keys(item: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of an item and two neighbouring words."""
    return mix(mix(mix(item.astype(np.uint64)) ^ left, 1) ^ right, 2)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def walk(symbols: np.ndarray, bits: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, way: int, steps: int) -> list[np.ndarray]:
    """The words that a random walk from each place meets, `way` 1 or -1; 0 beyond [low, high)."""
    out, at = [], at.copy()
    for j in range(steps):
        inside = (at >= low) & (at < high)
        here = np.where(inside, at, 0)
        out.append(np.where(inside, symbols[here], np.uint64(0)))
        at += way * ((bits[here] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return out


@lru_cache(maxsize=64)
def samples(low: int) -> tuple[tuple, ...]:
    """(walk, way, places of each sample) of a class. Where no edit is allowed one walk agrees for certain."""
    sure = low < 5
    lot = random.Random(low)
    every = list(combinations(range(low), min(PLACES, low)))
    draw = lambda: tuple(lot.sample(every, min(1 if sure else SAMPLES, len(every))))
    return tuple((w, way, draw()) for w in range(1 if sure else WALKS) for way in ((1,) if sure else (1, -1)))


def walk_bits(symbols: np.ndarray, w: int) -> np.ndarray:
    return mix(symbols, 100 + w)


def sample_keys(low: int, w: int, way: int, places: tuple[tuple[int, ...], ...], steps: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Words are hashes already, so sums of odd multiples of them will do."""
    for s, sample in enumerate(places):
        key = np.full(len(steps[0]), ((low * 64 + w) * 4 + way + 1) * 64 + s, np.uint64)
        for place in sample:
            key = key * _ODD + steps[place]
        yield mix(key, 4)


def neighbours(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two words that stand side by side."""
    return left * _ODD + right


def parts_of(m: int) -> list[tuple[int, int]]:
    """(offset, size) of the parts of an item of m words."""
    n = 1 if m <= LONGEST else -(-m // PART)
    edges = [m * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def prepare(ids: list, texts: list[str]) -> Items:
    words = plain_words(next(iter(slices(pa.array(texts, pa.string()), 1 << 62))))
    symbols, first = words.hashes(), words.first
    m = np.diff(first)
    rows = [(i, offset, size) for i, x in enumerate(m.tolist()) for offset, size in parts_of(x)]
    item, offset, size = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    group = np.searchsorted(CLASSES, size, "right") - 1
    tables = []
    for g in np.unique(group).tolist():
        mine, low = np.flatnonzero(group == g), CLASSES[g]
        start = first[item[mine]] + offset[mine]
        end = start + size[mine]
        keys, who = [], []
        for w, way, places in samples(low):
            steps = walk(symbols, walk_bits(symbols, w), start if way > 0 else end - 1, start, end, way, low)
            for key in sample_keys(low, w, way, places, steps):
                keys.append(key)
                who.append(mine)
        key, who = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        maybe = np.zeros(1 << max(16, min(26, int(8 * len(key)).bit_length())), bool)
        maybe[(key & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
        tables.append(Tables(low, np.unique(size[mine]), key, item[who], offset[who], size[who], maybe))
    row = np.repeat(np.arange(len(m)), m)
    at = np.flatnonzero(row[1:] == row[:-1])
    pairs = np.unique(pair_keys(row[at], symbols[at], symbols[at + 1]))
    any_pairs = np.unique(neighbours(symbols[at], symbols[at + 1]))
    maybe = np.zeros(1 << PAIR_BITS, bool)
    maybe[(any_pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int64)] = True
    return Items(np.array(ids, dtype=object), symbols, first, tables, pairs, any_pairs, maybe)


@lru_cache(maxsize=2)
def prepared(block: bytes) -> Items:
    """One preparation per worker process and block of items."""
    return prepare(*pickle.loads(block))


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def ramp(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count, end to end."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def candidates(words: Words, symbols: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, item, start), in turns: windows that share a key with an item; place is a word of the window's text."""
    n = len(symbols)
    key = neighbours(symbols[:-1], symbols[1:])
    pair = np.flatnonzero(items.maybe[(key >> np.uint64(64 - PAIR_BITS)).astype(np.int64)]) if n else key.astype(np.int64)
    pair = pair[words.doc[pair + 1] == words.doc[pair]]
    there = np.zeros(n, np.int32)
    there[pair[among(key[pair], items.any_pairs)]] = 1
    most = max((int(t.sizes.max()) for t in items.tables), default=1)
    sums = np.concatenate([[0], np.cumsum(there)]).astype(np.int32)
    before, after = np.concatenate([np.full(most, 0, np.int32), sums]), np.concatenate([sums, np.full(most, sums[-1], np.int32)])
    low, high = words.first[words.doc], words.first[words.doc + 1]
    bits = [walk_bits(symbols, w) for w in range(WALKS)]
    for t in items.tables:
        # the least need over the widest window first, then size by size where that is met
        needs = [(size, size - 1 - 2 * int(EDITS * size + 1e-9)) for size in t.sizes.tolist()]
        widest, least = needs[-1][0], min(need for _, need in needs)
        starts = np.flatnonzero(after[widest - 1 : widest - 1 + n] - sums[:n] >= least)
        ends = np.flatnonzero(sums[:n] - before[most + 1 - widest : most + 1 - widest + n] >= least)
        from_here, to_here = np.zeros(len(starts), bool), np.zeros(len(ends), bool)
        for size, need in needs:
            from_here |= after[starts + size - 1] - sums[starts] >= need
            to_here |= sums[ends] - before[ends + most + 1 - size] >= need
        starts, ends = starts[from_here], ends[to_here]
        found = [[np.zeros(0, np.int64)] for _ in range(2)]
        held = 0
        for w, way, places in samples(t.low):
            at = starts if way > 0 else ends
            for lo in range(0, len(at), 1 << 16):
                p = at[lo : lo + (1 << 16)]
                steps = walk(symbols, bits[w], p, low[p], high[p], way, t.low)
                for key in sample_keys(t.low, w, way, places, steps):
                    some = np.flatnonzero(t.maybe[(key & np.uint64(len(t.maybe) - 1)).astype(np.int64)])
                    left, right = (np.searchsorted(t.keys, key[some], side) for side in ("left", "right"))
                    times = right - left
                    turn = (np.cumsum(times) - times) // SPAN
                    for k in np.unique(turn[times > 0]).tolist():
                        now = np.flatnonzero((turn == k) & (times > 0))
                        hit = ramp(times[now]) + np.repeat(left[now], times[now])
                        place = np.repeat(p[some[now]], times[now])
                        start = place - t.offset[hit] if way > 0 else place - t.offset[hit] - t.size[hit] + 1
                        # one number for a place's text, item and start; starts may lie before their text
                        found[0].append(t.item[hit] * (2 * n + 1) + start + n)
                        found[1].append(place)
                        held += len(hit)
                        if held > SPAN:
                            yield unpacked(found, n)
                            found, held = [[np.zeros(0, np.int64)] for _ in range(2)], 0
        yield unpacked(found, n)


def unpacked(found: list[list[np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, at = np.unique(np.concatenate(found[0]), return_index=True)
    return np.concatenate(found[1])[at], both // (2 * n + 1), both % (2 * n + 1) - n


def spans(words: Words, items: Items, place: np.ndarray, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first start, last start) of the runs of windows around candidates, none overlapping for an item."""
    n, m = len(words.start), np.diff(items.first)[item]
    doc, k = words.doc[place], 2 * allowed(m)
    # windows stay inside their text
    least, most = words.first[doc], np.maximum(words.first[doc + 1] - m, words.first[doc])
    lo, hi = np.clip(start - k, least, most), np.clip(start + k, least, most)
    order = np.lexsort((lo, item))
    i = item[order]
    # one line for all items: item times more than any start
    lo, hi = (i * (n + 1) + x[order] for x in (lo, hi))
    reach = np.maximum.accumulate(hi) if len(hi) else hi
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    last = np.append(new[1:], True) if len(new) else new
    return lo[new] // (n + 1), lo[new] % (n + 1), reach[last] % (n + 1)


def windows(words: Words, symbols: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, item) of every window that can be within the allowed edits, in turns; a text shorter than the item is one window."""
    for found in candidates(words, symbols, items):
        if len(found[0]):
            yield from windows_of(words, symbols, items, *spans(words, items, *found))


def windows_of(words: Words, symbols: np.ndarray, items: Items, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    m_items = np.diff(items.first)
    size = hi - lo + m_items[item]
    turn = (np.cumsum(size) - size) // SPAN
    for t in np.unique(turn):
        i, a, n = (x[turn == t] for x in (item, lo, size))
        row, at = np.repeat(np.arange(len(i)), n), np.repeat(a, n) + ramp(n)
        left, right = (symbols[np.minimum(x, len(symbols) - 1)] for x in (at, at + 1))
        key = pair_keys(i[row], left, right)
        sums = np.append(0, np.cumsum(among(key, items.pairs)))
        m = m_items[i]
        starts = n - m + 1
        where = np.repeat(np.cumsum(n) - n, starts) + ramp(starts)
        i, m = i[row[where]], m[row[where]]
        s = at[where]
        short = s + m > words.first[words.doc[s] + 1]
        ok = short | (sums[where + m - 1] - sums[where] >= m - 1 - 2 * allowed(m))
        yield s[ok], i[ok]


def edit_distances(a: np.ndarray, a_at: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_len: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Word edit distance of pairs of runs, where it is at most `most`; else something larger. Banded, all pairs at once."""
    n, k = len(a_at), int(most.max(initial=0))
    far = np.int32(1 << 20)
    band = np.full((2 * k + 1, n), far, np.int32)  # band[d + k]: prefix i of a, prefix i + d of b
    shift = np.arange(-k, k + 1, dtype=np.int32)[:, None]
    for d in range(k + 1):
        band[d + k] = np.where(d <= b_len, d, far)
    result = np.where((a_len == 0) & (b_len <= k), b_len, far).astype(np.int32)
    for i in range(1, int(a_len.max(initial=0)) + 1):
        x = a[np.minimum(a_at + i - 1, len(a) - 1)]
        j = i + shift
        y = b[np.clip(b_at + j - 1, 0, len(b) - 1)]
        best = band + (x != y)
        best[:-1] = np.minimum(best[:-1], band[1:] + 1)
        best = np.where((j < 1) | (j > b_len), far, best)
        if i <= k:
            best[k - i] = i
        # steps along b: each costs one
        band = np.minimum.accumulate(best - shift, 0) + shift
        done = np.flatnonzero(a_len == i)
        d = (b_len - a_len)[done]
        near = np.abs(d) <= k
        result[done[near]] = band[d[near] + k, done[near]]
    return result


def leaks_of(texts: Texts, items: Items) -> tuple[np.ndarray, ...]:
    """(text, item, start, distance): the closest window, the earliest of equals, of each text and item that match."""
    words = plain_words(texts)
    symbols = words.hashes()
    m_items = np.diff(items.first)
    found = [[np.zeros(0, np.int64)] for _ in range(4)]
    for start, item in windows(words, symbols, items):
        # windows of one turn by allowed edits, so that few have a wider band than they need
        order = np.argsort(m_items[item], kind="stable")
        start, item = start[order], item[order]
        cells = 2 * allowed(m_items[item]) + 1
        turn = (np.cumsum(cells) - cells) // CELLS
        for t in np.unique(turn):
            s, i = start[turn == t], item[turn == t]
            m, doc = m_items[i], words.doc[s]
            size = np.minimum(m, words.first[doc + 1] - s)
            k = allowed(m)
            distance = edit_distances(items.words, items.first[i], m, symbols, s, size, k)
            ok = distance <= k
            for x, y in zip(found, (doc, i, s - words.first[doc], distance), strict=True):
                x.append(y[ok].astype(np.int64))
    doc, i, s, distance = (np.concatenate(x) for x in found)
    order = np.lexsort((s, distance, i, doc))
    doc, i, s, distance = doc[order], i[order], s[order], distance[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (i[1:] != i[:-1])
    return doc[new], i[new], s[new], distance[new]


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        if ids and size + len(r[1]) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, edits, item_words of every document and item that match."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word int, edits int, item_words int"
    parts: list[DataFrame] = []
    for ids, item_texts in blocks(benchmark, item_col, item_text_col):
        block = pickle.dumps((ids, item_texts))

        def run(batches: Iterator[pa.RecordBatch], block: bytes = block) -> Iterator[pa.RecordBatch]:
            items = prepared(block)
            m = np.diff(items.first)
            for batch in batches:
                for part in slices(batch.column(1), SLICE):
                    doc, i, s, distance = leaks_of(part, items)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(part.first, part.n).take(pa.array(doc)), pa.array(items.ids[i].tolist(), pa.int64()), pa.array(s, pa.int32()), pa.array(distance, pa.int32()), pa.array(m[i], pa.int32())],
                        names=["doc_id", "item_id", "start_word", "edits", "item_words"],
                    )

        if parts:  # a second block: one pass is done before the next begins
            parts[-1] = cut(parts[-1], "leaks")
        parts.append(texts.mapInArrow(run, schema))
    if not parts:
        return texts.limit(0).select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("start_word", "int"), ("edits", "int"), ("item_words", "int"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose text leaks no item."""
    kept = docs
    for ids, item_texts in blocks(benchmark, item_col, item_text_col):
        block, at = pickle.dumps((ids, item_texts)), kept.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], block: bytes = block, at: int = at) -> Iterator[pa.RecordBatch]:
            items = prepared(block)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for part in slices(batch.column(at), SLICE):
                    keep[part.first + leaks_of(part, items)[0]] = False
                yield batch.filter(pa.array(keep))

        if kept is not docs:
            kept = cut(kept, "clean")
        kept = kept.mapInArrow(run, T.StructType(docs.schema.fields))
    return kept


def op2_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
