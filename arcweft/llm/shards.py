"""Sharding by sampled splitters: shards of nearly equal bytes, equal texts side by side, no group in one task.

1. A slim table (id, size, checksum, key) is made in one pass over the texts; key is a hash of the text, so that equal
   texts share it.
2. Rows are drawn with a chance in proportion to their size; the quantiles of their keys split the key range into
   `ranges` fine ranges of about equal bytes.
3. Exact sums show ranges that are overfull in bytes or rows; these are subdivided by a hash of the key, so equal texts stay
   together. A single text with more copies than such a piece may hold is a piece of its own, ranked in several parts by
   a hash of the id, so no task gets more than its share of rows.
4. Pieces, in key order, are cut into shards where the exact running sum of bytes passes a multiple of total / shards. Only a
   group of equal texts over GROUP of a shard's share is cut itself, between its parts; all others lie in one shard.
   Slots are an offset per part plus the rank inside the part.

Nulls: a null text counts as empty; a null id is an id like any other (it sorts first). Empty table: no rows.
Repeated rows are each placed and get slots of their own. Extra columns are not read. A text longer than a shard's share
makes its shard that much larger; it is never split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweft.shared import cut

#: Most rows of the sample whose quantiles become the splitters.
SAMPLE_ROWS = 100_000
LAW = "bytes"
#: The part of a shard's share up to which a group of equal texts is never cut: the price are shards that differ by as much.
GROUP = 1 / 50


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")
    )


def position(splitters: list[int], key: Column) -> Column:
    """How many splitters are at most key, by binary search; their number is one less than a power of two."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(splitters).bit_length()))))
    at = F.split(F.lit(",".join(map(str, splitters))), ",").cast("array<bigint>")  # folded to one literal
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(at, lo + step - 1) <= key, lo + step).otherwise(lo))


def assign(docs: DataFrame, shards: int = 16, ranges: int = 4096, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; `ranges` is a power of two, well above `shards`."""
    rows = cut(slim(docs, id_col, text_col), "slim")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    per_range = max(1.0, total / ranges)
    # size-weighted draw, the same at every attempt: a row is drawn about SAMPLE_ROWS * size / total times
    chance = F.col("size") * F.lit(min(1.0, SAMPLE_ROWS / max(1, n))) * F.lit(max(1, n)) / F.lit(float(max(1, total)))
    lot = F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.withColumn("weight", F.floor(chance + lot).cast("long")).where("weight > 0")
    drawn = drawn.withColumn("_", F.explode(F.sequence(F.lit(1), F.least("weight", F.lit(ranges)).cast("int"))))
    found = drawn.agg(F.percentile_approx("key", F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>"), 20 * ranges).alias("q")).first()
    splitters = list(found.q or [0] * (ranges - 1))
    ranged = rows.withColumn("range", position(splitters, F.col("key")))
    share = max(1, total) / shards
    rows_per_range = max(1.0, n / ranges)
    # how many units a number of bytes and rows makes
    pieces = lambda b, r: F.greatest(F.ceil(b / F.lit(2 * per_range)), F.ceil(r / F.lit(4 * rows_per_range)), F.lit(1)).cast("long")
    full = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    over = full.where(pieces(F.col("b"), F.col("r")) > 1).select("range")
    # texts that fill several units alone: less than `ranges` of them, as they hold half a unit's bytes or rows each and more
    hot = ranged.join(F.broadcast(over), "range").groupBy("range", "key").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    hot = cut(hot.withColumn("parts", pieces(F.col("b"), F.col("r"))).where("parts > 1"), "hot")
    rest = full.join(hot.groupBy("range").agg(F.sum("b").alias("hot_b"), F.sum("r").alias("hot_r")), "range", "left")
    rest = rest.select("range", pieces(F.col("b") - F.coalesce("hot_b", F.lit(0)), F.col("r") - F.coalesce("hot_r", F.lit(0))).alias("pieces"))
    groups = hot.join(rest, "range").select("range", "key", "parts", (F.col("b") > GROUP * share).alias("apart"), (F.col("pieces") + F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1).alias("own"))
    # one row per range, and one per hot text: both bounded by `ranges`, whatever the input
    unit = ranged.join(F.broadcast(rest), "range").join(F.broadcast(groups), ["range", "key"], "left")
    unit = unit.withColumn("piece", F.coalesce("own", F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.col("pieces")))).withColumn("apart", F.coalesce("apart", F.lit(False)))
    unit = unit.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1)), F.col("parts")), F.lit(0).cast("long"))).drop("pieces", "parts", "own")
    units = unit.groupBy("range", "piece", "part").agg(F.sum("size").alias("b"), F.count("*").alias("r"), F.first("apart").alias("apart"))
    # less than 4 * `ranges` units
    units = units.withColumn("before", F.sum("b").over(Window.orderBy("range", "piece", "part")) - F.col("b"))
    whole = Window.partitionBy("range", "piece")
    middle = F.when(F.col("apart"), F.col("before") + F.col("b") / 2).otherwise(F.min("before").over(whole) + F.sum("b").over(whole) / 2)
    units = units.withColumn("shard", F.least(F.floor(middle / F.lit(share)), F.lit(shards - 1)).cast("int"))
    units = units.withColumn("offset", F.sum("r").over(Window.partitionBy("shard").orderBy("range", "piece", "part")) - F.col("r"))
    placed = unit.join(F.broadcast(units.select("range", "piece", "part", "shard", "offset")), ["range", "piece", "part"])
    rank = F.row_number().over(Window.partitionBy("range", "piece", "part").orderBy("key", "doc_id", "size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + rank - 1).cast("long").alias("slot"))


def op7_sharding(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
