"""SentencePiece encoding as relations: the lattice of `arcweft.llm.pieces` in Spark's own operators.

1. explode: the distinct words of all texts give every substring up to the longest piece's characters;
2. equi-join: substrings are joined with the piece table (broadcast: its size is the model's, and checked);
3. group: the edges of a word are one array, ordered by the model's rank;
4. fold: a higher-order `aggregate` over as many steps as a word has characters. Its state are the word's boundaries; each step
   takes away the one that the best edge over exactly two symbols spans (see `pieces` for why this and not the highest sum).

Words then join the texts that hold them, and a text's ids are put together in order. No Python runs on executors.

Nulls encode to null, empty texts to no ids. Rows that repeat an id and text are one row. Extra columns are ignored. Empty
table: no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.llm.pieces import MODEL, Model, model_bytes
from arcweft.shared import attach, cut


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """piece, id, rank: as many rows as the model has pieces."""
    at = [(model.piece_ends[i], model.piece_ends[i + 1]) for i in model.ids.tolist()]
    data = model.piece_bytes.tobytes()
    return spark.createDataFrame([(data[a:b].decode(), i, r) for (a, b), i, r in zip(at, model.ids.tolist(), model.ranks.tolist(), strict=True)], "piece string, id int, rank long")


def words_of(text: Column, model: Model) -> Column:
    """A text with a space in front, cut before each run of spaces and around characters of no longer piece."""
    lonely = "".join(re.escape(chr(c)) if chr(c).isprintable() else f"\\x{c:02x}" for c in range(128) if model.lonely[c])
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(f"([{lonely}]| *[^ {lonely}]+| +)"), F.lit(1)))


def folded(edges: Column, size: Column) -> Column:
    """The boundaries that are left of 1 .. size + 1. edges: array<struct<rank, i, j, ...>>, the best first.

    The state holds, for each boundary, the next one; 0 for what is none any more."""

    def step(after: Column, _: Column) -> Column:
        def ready(e: Column) -> Column:
            middle = F.get(after, e["i"] - 1)
            return F.coalesce((middle > 0) & (F.get(after, middle - 1) == e["j"]), F.lit(False))

        best = F.get(F.filter(edges, ready), F.lit(0))
        merged = F.transform(after, lambda to, at: F.when(at + 1 == best["i"], best["j"]).when(at + 1 == F.get(after, best["i"] - 1), 0).otherwise(to))
        return F.when(best.isNull(), after).otherwise(merged)

    after = F.aggregate(F.sequence(F.lit(1), size), F.sequence(F.lit(2), size + 1), step)
    return F.concat(F.filter(F.transform(after, lambda to, at: F.when(to > 0, at + 1)), lambda x: x.isNotNull()), F.array(size + 1))


def lattice(words: DataFrame, pieces: DataFrame, model: Model) -> DataFrame:
    """word, ids of distinct words."""
    size = F.char_length("word")
    ends = lambda i: F.sequence(i + 1, F.least(i + model.longest, size + 1))
    every = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(ends(i), lambda j: F.struct(i.alias("i"), j.alias("j"), F.substr(F.col("word"), i, j - i).alias("piece")))))
    edges = words.select("word", F.explode(every).alias("e")).select("word", "e.*").join(F.broadcast(pieces), "piece", "left").where("id is not null or j = i + 1")
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "i", "j", "id", "piece"))).alias("edges"))
    grouped = grouped.withColumn("bounds", folded(F.col("edges"), size))
    hexes = lambda p: F.hex(F.encode(p, "UTF-8"))
    raw = F.array(*map(F.lit, model.byte_ids.tolist()))
    bytes_of = lambda p: F.transform(F.sequence(F.lit(1), F.length(hexes(p)), F.lit(2)), lambda b: F.get(raw, F.conv(F.substr(hexes(p), b, F.lit(2)), 16, 10).cast("int")).cast("int"))

    def ids_at(at: Column) -> Column:
        """Of the symbol between two boundaries: its piece, or its bytes."""
        low, high = F.get("bounds", at), F.get("bounds", at + 1)
        e = F.get(F.filter("edges", lambda e: (e["i"] == low) & (e["j"] == high)), F.lit(0))
        return F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(bytes_of(e["piece"]))

    return grouped.select("word", F.flatten(F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), ids_at)).alias("ids"))


def encode_relational(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids of each id and text."""
    model = Model(model_bytes(model_path))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    found = texts.where("text is not null").dropDuplicates(["doc_id", "row"]).select("doc_id", "row", F.posexplode(words_of(F.col("text"), model)).alias("pos", "word"))
    known = cut(lattice(found.select("word").distinct(), piece_table(docs.sparkSession, model), model), "words")
    ids = attach(found, known, ["word"], F.struct("row", "pos")).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    ids = ids.select("row", F.col("doc_id").alias("_id"), F.flatten("parts.ids").alias("ids"))
    out = texts.select("doc_id", "row", F.col("text").isNull().alias("null")).distinct()
    out = out.join(ids, (out.row == ids.row) & out.doc_id.eqNullSafe(ids._id), "left")
    none = F.when(F.col("null"), F.lit(None).cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return out.select("doc_id", F.coalesce("ids", none).alias("ids")).select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")
