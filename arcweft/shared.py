"""What several operators need from the cluster: cut lineage, joins that withstand hot keys, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys with the most rows that `lookup` broadcasts; every other key has less than a thousandth of the rows.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets a temporary
    folder; a cluster has none that its machines share, so there it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="arcweft-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arcweft/{name}-{uuid.uuid4().hex}"


#: Bytes after which a cut table begins a new row group, and rows between looks at its size. A task that writes holds one row
#: group, a task that reads at most one, however long its rows are.
GROUP = {"parquet.block.size": 1 << 24, "parquet.page.size.row.check.min": 10, "parquet.page.size.row.check.max": 1000}


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps neither recompute it nor depend on
    an executor that may be lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**GROUP).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote and that nothing reads any more: loops drop a round's tables once the next stand."""
    for t in tables:
        if path := getattr(t, "cut_path", None):
            jvm, context = t.sparkSession._jvm, t.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def lookup(rows: DataFrame, table: DataFrame, on: list[str], weight: str, spread: Column) -> DataFrame:
    """Left join of rows to a table with one row per key, whatever share of the rows one key holds.

    The HEAVY keys of largest `weight` (how many rows have that key) are broadcast, a number that does not grow; rows
    with such a key are dealt by `spread` in the shuffle join that serves all others. The table should be cut."""
    return _dealt(rows, table, table.orderBy(F.desc(weight), *on).limit(HEAVY), on, spread)


def attach(rows: DataFrame, table: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """As `lookup`, to a table that does not know how many rows have its keys: these are counted first (partial sums, then
    keys alone are shuffled). The table has one row per key, or few."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("_rows"))
    heavy = counts.orderBy(F.desc("_rows"), *on).limit(HEAVY).where("_rows > 1").drop("_rows")
    return _dealt(rows, table, table.join(F.broadcast(heavy), on), on, spread)


def _dealt(rows: DataFrame, table: DataFrame, heavy: DataFrame, on: list[str], spread: Column) -> DataFrame:
    values = [c for c in table.columns if c not in on]
    heavy = heavy.select(*on, F.lit(1).alias("_heavy"), *(F.col(c).alias(f"_h_{c}") for c in values))
    marked = rows.join(F.broadcast(heavy), on, "left")
    marked = marked.withColumn("_salt", F.when(F.col("_heavy") == 1, F.pmod(F.xxhash64(spread), F.lit(100_003)) + 1).otherwise(0))
    rest = table.select(*on, *(F.col(c).alias(f"_r_{c}") for c in values), F.lit(0).cast("long").alias("_salt"))
    joined = marked.join(rest.hint("shuffle_merge"), [*on, "_salt"], "left")
    picked = (F.when(F.col("_heavy") == 1, F.col(f"_h_{c}")).otherwise(F.col(f"_r_{c}")).alias(c) for c in values)
    return joined.select(*rows.columns, *picked)


def numbered(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """df with the place of each row, from 0, in the order of `by`: ranges are sorted side by side, and only their sizes meet."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    # one row per range, whose number is that of the shuffle partitions
    sizes = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    return rows.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


#: Bits of the bitmap that `marked` broadcasts: 4 MB, whatever the input.
BITS = 1 << 25


def marked(rows: DataFrame, ids: DataFrame, on: str, name: str = "maybe") -> DataFrame:
    """rows with a boolean `name`: false only where the key is not in ids, true for all of theirs and for a few others.

    The ids' hashes set bits of one bitmap of fixed size, which is broadcast in pieces of 4 KB; the more ids there are, the
    more often it is true for others."""
    hashed = lambda: F.pmod(F.xxhash64(on), F.lit(BITS)) + 1
    pieces = ids.select(hashed().alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    rows_h = rows.withColumn("_h", hashed()).withColumn("_piece", F.bitmap_bucket_number("_h"))
    at = F.bitmap_bit_position("_h")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (F.pmod(at, F.lit(8)) + 1).cast("int"))), F.lit(2)) == 1
    return rows_h.join(F.broadcast(pieces), "_piece", "left").select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias(name))


def narrowed(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """rows without most of those whose key is not in ids, ahead of a shuffle join that removes the rest; no row of theirs goes."""
    return marked(rows, ids, on, "_maybe").where("_maybe").drop("_maybe")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every endpoint of the undirected edges; component is the smallest id that can be reached.

    Alternating large and small stars; each round is two aggregations with partial sums and two hot-key lookups, so a
    hub with most of the edges stays spread out."""
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    e = cut(e, "edges")
    for _ in range(max_rounds):
        # converged when every vertex is a root, or hangs from exactly one vertex, which is a root
        ends = e.select(F.col("hi").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(e.select(F.col("lo").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        ends = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if ends.where("below > 1 or (below > 0 and above > 0)").isEmpty():
            break
        # the two tables of least neighbours are computed once: both of their readers share one exchange
        arcs = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = arcs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = lookup(arcs, least, ["u"], "n", F.col("v")).where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = cut(large.where("lo < hi").distinct(), "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = lookup(large, least, ["hi"], "n", F.col("lo"))
        small = small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").unionAll(least.select(F.col("m").alias("lo"), "hi"))
        done, e = e, cut(small.distinct(), "edges")
        drop(done, large)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = e.select(F.col("lo").alias("id")).distinct()
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(roots.select("id", F.col("id").alias("component")))
