"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into words where no piece can cross (before a run of spaces, around characters of no longer piece). For the
distinct words of each slice of texts:

1. explode: every substring of 2 to the longest piece's characters is a candidate edge;
2. equi-join: edges are joined with the piece table on a hash of their bytes, and single characters with their piece or bytes;
3. group: edges are sorted by word, then by score;
4. fold: a word's state is the bit mask of its boundaries. Each step applies the word's best edge that spans exactly two
   symbols, until none is left. This is the order in which a BPE model merges; the highest total score (Viterbi), which
   fits unigram models, does not give a BPE model's encoding.

Where no edge crosses a boundary the word parts there, so long words of scripts without spaces fall into short parts. The fold
runs over all parts of a slice at once, in arrays. Parts over WIDE characters, whose pieces overlap throughout (rows of one
character), go to the model's library, exactly. Ids of words are then laid out along the texts. Decoding joins ids to piece bytes and drops the added first space.

The model is a file whose path is a parameter; its bytes travel with the tasks (its size is checked). Nulls encode to null,
empty texts to no ids. Repeated rows encode alike; extra columns pass through, but for those named like the results. Empty
table: no rows. Long texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweft.llm.words import Texts, byte_hashes, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Most bytes of a model that is sent to tasks; most characters of a word in the lattice (a mask has 64 bits).
MODEL_BYTES, WIDE = 64 << 20, 62
#: Bytes of text that are encoded at a time: a lattice takes some 130 times its words' bytes.
SLICE = 1 << 19
SPACE = "▁"


class Model:
    """The piece table: hashes of piece bytes, ids and ranks; bytes of every id; characters that no longer piece has."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = [sp.id_to_piece(i).replace(SPACE, " ") for i in normal]
        if any(" " in t.lstrip(" ") for t in text):
            raise ValueError("pieces that cross words are not supported")
        chars = np.array([len(t) for t in text])
        flat = [t.encode() for t in text]
        data = np.frombuffer(b"".join(flat), np.uint8)
        end = np.cumsum([len(b) for b in flat])
        hashes = byte_hashes(data, np.r_[0, end[:-1]], end)
        scores = np.array([sp.get_score(i) for i in normal])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids = hashes[order], np.array(normal, np.int64)[order]
        rank = np.empty(len(normal), np.int64)
        _, dense = np.unique(-scores, return_inverse=True)
        rank[:] = dense
        self.ranks = rank[order]
        self.longest = int(chars.max(initial=1))
        self.low = np.zeros(1 << 22, bool)
        self.low[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        longer = set("".join(t for t in text if len(t) > 1))
        self.lonely = np.zeros(256, bool)
        self.lonely[:128] = [chr(c) not in longer and c != 32 for c in range(128)]
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        of = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value] = i
                of[i] = bytes([value])
        for i, b in zip(normal, flat, strict=True):
            of[i] = b
        self.piece_bytes = np.frombuffer(b"".join(of), np.uint8)
        self.piece_ends = np.cumsum([0, *map(len, of)])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the table, -1 for no piece."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.low[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        out[maybe[hit]] = at[hit]
        return out


@lru_cache(maxsize=2)
def model_of(raw: bytes) -> Model:
    return Model(raw)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[0], ..., starts[0] + lengths[0] - 1, starts[1], ..."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)


def encode_words(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words [start, end), end to end, and where each word's begin and end."""
    n = len(start)
    size = end - start
    flat = data[runs(start, size)]
    at = np.cumsum(size) - size
    head = (flat & 0xC0) != 0x80
    head[at] = True
    char = np.flatnonzero(head)  # first byte of every character
    first = np.searchsorted(char, at)  # first character of every word
    chars = np.diff(np.r_[first, len(char)])
    word = np.repeat(np.arange(n), chars)
    place = np.arange(len(char)) - first[word]
    after = np.r_[char, len(flat)]
    left = chars[word] - place  # characters from here to the word's end
    # explode and join; edges from character to character
    edge_from, edge_to, edge_at = [], [], []
    some = np.flatnonzero(left >= 2)
    for length in range(2, model.longest + 1):
        some = some[left[some] >= length]
        if not len(some):
            break
        found = model.find(byte_hashes(flat, char[some], after[some + length]))
        hit = found >= 0
        edge_from.append(some[hit])
        edge_to.append(some[hit] + length)
        edge_at.append(found[hit])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    i, j, e = map(cat, (edge_from, edge_to, edge_at))
    # a boundary that no edge crosses parts a word: what lies on its two sides never merges
    crossed = np.zeros(len(char) + 1, np.int64)
    np.add.at(crossed, i + 1, 1)
    np.add.at(crossed, j, -1)
    head = np.cumsum(crossed)[:-1] <= 0
    head[first] = True
    part_first = np.flatnonzero(head)
    part = np.cumsum(head) - 1
    n_parts = len(part_first)
    size_of = np.diff(np.r_[part_first, len(char)])
    place = np.arange(len(char)) - part_first[part]
    wide = size_of > WIDE
    narrow = ~wide[part[i]]
    i, j, e = i[narrow], j[narrow], e[narrow]
    w = part[i]
    i, j = place[i], j - part_first[w]
    order = np.lexsort((i, model.ranks[e], w))
    w, i, j, e = w[order], i[order], j[order], e[order]
    bit = lambda x: np.uint64(1) << x.astype(np.uint64)
    ends, between = bit(i) | bit(j), bit(j) - (bit(i) << np.uint64(1))
    # fold
    mask = bit(np.minimum(size_of, WIDE) + 1) - np.uint64(1)
    live = np.arange(len(w))
    while len(live):
        m = mask[w[live]]
        inside = m & between[live]
        two = (inside != 0) & ((inside & (inside - np.uint64(1))) == 0)
        ready = live[two & ((m & ends[live]) == ends[live])]
        if not len(ready):
            break
        best = ready[np.r_[True, w[ready][1:] != w[ready][:-1]]]
        mask[w[best]] &= ~between[best]
        # words that moved, and of their edges those whose ends are still boundaries and which are not applied yet
        moved = np.zeros(n_parts, bool)
        moved[w[best]] = True
        live = live[moved[w[live]]]
        m = mask[w[live]]
        live = live[((m & ends[live]) == ends[live]) & ((m & between[live]) != 0)]
    # the symbols that are left: applied edges, single characters (a piece or bytes), and wide words
    m = mask[w]
    done = np.flatnonzero(((m & ends) == ends) & ((m & between) == 0))
    alone = np.flatnonzero(~wide[part] & ((mask[part] >> place.astype(np.uint64)) & (mask[part] >> (place + 1).astype(np.uint64)) & np.uint64(1)).astype(bool))
    piece = model.find(byte_hashes(flat, char[alone], after[alone + 1]))
    known = piece >= 0
    raw = alone[~known]
    raw_size = after[raw + 1] - char[raw]
    raw_byte = runs(char[raw], raw_size)
    token_key = [char[part_first[w[done]] + i[done]], char[alone[known]], raw_byte]
    token_id = [model.ids[e[done]], model.ids[piece[known]], model.byte_ids[flat[raw_byte]]]
    for x in np.flatnonzero(wide).tolist():
        lo, hi = char[part_first[x]], after[part_first[x] + size_of[x]]
        ids = encode_wide(model, flat[lo:hi].tobytes().decode("utf-8", "replace"))
        # a part has no more ids than bytes, so they stay in order before the next part's
        token_key.append(lo + np.arange(len(ids)))
        token_id.append(np.array(ids, np.int64))
    tk, ti = map(np.concatenate, (token_key, token_id))
    order = np.argsort(tk, kind="stable")
    return ti[order], np.searchsorted(tk[order], np.r_[at, len(flat)])


def encode_wide(model: Model, word: str) -> list[int]:
    """By the library: a first space is its own added one; otherwise a lone character stands before and is cut off."""
    if word.startswith(" "):
        return model.library.encode(word[1:])
    mark = "\n"
    lead = len(model.library.encode(mark))
    return model.library.encode(mark + word)[lead:]


def encode_texts(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and where each text's begin and end."""
    n = texts.n
    size = np.diff(texts.offsets)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    # every text that is not empty gets a space in front
    data = np.insert(texts.data, texts.offsets[:-1][some], 0x20)
    begin = texts.offsets[:-1][some] + np.arange(len(some))
    space, lonely = data == 0x20, model.lonely[data]
    cut = lonely.copy()
    cut[1:] |= (space[1:] & ~space[:-1]) | lonely[:-1]
    cut[begin] = True
    start = np.flatnonzero(cut)
    end = np.r_[start[1:], len(data)]
    doc = np.repeat(some, np.diff(np.r_[np.searchsorted(start, begin), len(start)]))
    _, where, which = np.unique(byte_hashes(data, start, end), return_index=True, return_inverse=True)
    ids, bounds = encode_words(model, data, start[where], end[where])
    lengths = np.diff(bounds)[which]
    out = ids[runs(bounds[which], lengths)]
    per_doc = np.bincount(doc, lengths, n).astype(np.int64)
    return out, np.r_[0, np.cumsum(per_doc)]


def decode_ids(model: Model, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and where each begins and ends; the space added in front is dropped."""
    ids = np.clip(ids, 0, len(model.piece_ends) - 2)
    size = model.piece_ends[ids + 1] - model.piece_ends[ids]
    data = model.piece_bytes[runs(model.piece_ends[ids], size)]
    ends = np.r_[0, np.cumsum(size)][bounds]
    lead = ends[:-1][(np.diff(ends) > 0)]
    lead = lead[data[lead] == 0x20]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    return data[keep], ends - np.searchsorted(lead, ends)


def equal_texts(texts: Texts, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts equal the decoded ones."""
    same = np.diff(ends) == np.diff(texts.offsets)
    if same.all():
        differ = np.concatenate([[0], np.cumsum(data != texts.data)])
        return np.diff(differ[ends]) == 0
    for i in np.flatnonzero(same):
        same[i] = np.array_equal(data[ends[i] : ends[i + 1]], texts.data[texts.offsets[i] : texts.offsets[i + 1]])
    return same


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return raw


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model_path: str = MODEL, check_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """All columns of df (or those to keep) and the ids (array<int>) of the text; in check_col whether decoding them gives the text back, found
    in the same pass (a second one would need a second Python worker per task)."""
    raw = model_bytes(model_path)
    df = df.drop(ids_col, *([check_col] if check_col else []))
    at = df.columns.index(text_col)
    kept = [i for i, c in enumerate(df.columns) if keep is None or c in keep]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(check_col, T.BooleanType())] if check_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(raw)
        for batch in batches:
            null = batch.column(at).is_null()
            for texts in slices(batch.column(at), SLICE):
                ids, bounds = encode_texts(model, texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                mask = null.slice(texts.first, texts.n)
                if mask.true_count:
                    lists = pa.compute.if_else(mask, pa.scalar(None, lists.type), lists)
                part = batch.slice(texts.first, texts.n)
                more = [pa.array(equal_texts(texts, *decode_ids(model, ids, bounds)))] if check_col else []
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), lists, *more], names=[*(part.schema.names[i] for i in kept), ids_col, *([check_col] if check_col else [])])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """All columns of df and the text of the ids; null ids decode to null, bytes that are no UTF-8 to the replacement mark."""
    raw = model_bytes(model_path)
    df = df.drop(text_col)
    at = df.columns.index(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(raw)
        for batch in batches:
            lists = batch.column(at)
            bounds = np.asarray(lists.offsets, np.int64)
            ids = np.asarray(lists.values if lists.null_count == 0 else lists.values.fill_null(0), np.int64)[bounds[0] : bounds[-1]] if len(lists) else np.zeros(0, np.int64)
            data, ends = decode_ids(model, ids, bounds - bounds[0]) if len(lists) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
            try:
                text = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
                text.validate(full=True)
                text = text.cast(pa.string())
            except pa.ArrowInvalid:
                flat = data.tobytes()
                text = pa.array([flat[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
            if lists.null_count:
                text = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, text_col])

    return df.mapInArrow(run, schema)


def op6_sentencepiece(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_xxhash64, decoded_equal: of each text the number and a hash of its ids, and the round trip."""
    out = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), check_col="decoded_equal", keep=["doc_id"])
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxhash64"), "decoded_equal")
