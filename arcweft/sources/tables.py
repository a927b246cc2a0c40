"""Graphs derived from the star-schema tables, each from whole tables.

users: who acts after whom in the event stream (directed multigraph, typed, weights in cents)
hierarchy: region, nation, supplier and customer (directed child to parent, a forest)
trade: nation to nation by what customers order (directed, typed by return flag, weights quantities)
supply: supplier and part (undirected, one edge per pair, weight their lines)
world: hierarchy and trade together (undirected)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweft.model import PropertyGraph

#: Fixed: where the id ranges of the kinds of vertices begin. Each has room for 2**40 keys.
NATION, SUPPLIER, PART, CUSTOMER, TRADE = 100, 1 << 40, 2 << 40, 3 << 40, 4 << 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def following(events: DataFrame) -> DataFrame:
    """events with `next_user`: the user of the event after it in (ts, event_id) order, null for the last.

    Within an hour by a window; the last of an hour looks at the first of the next hour that has any, and hours are few."""
    e = events.withColumn("hour", F.date_trunc("hour", "ts"))
    inside = Window.partitionBy("hour").orderBy("ts", "event_id")
    e = e.withColumn("inner_next", F.lead("user_id").over(inside))
    firsts = e.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))
    firsts = firsts.select("hour", F.lead("first_user").over(Window.orderBy("hour")).alias("outer_next"))
    return e.join(firsts, "hour").withColumn("next_user", F.coalesce("inner_next", "outer_next")).drop("hour", "inner_next", "outer_next")


def users(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    events = read(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    edges = following(events.select("event_id", "ts", "user_id", "event_type", "value")).filter("next_user is not null")
    edges = edges.select(F.col("event_id").alias("edge_id"), F.col("user_id").alias("src"), F.col("next_user").alias("dst"), cents.alias("weight"), F.col("event_type").alias("edge_type"))
    return PropertyGraph.of(events.select(F.col("user_id").alias("id")).distinct(), edges, True)


def _kind(df: DataFrame, key: str, base: int, name: str, kind: str, **more: str) -> DataFrame:
    pairs = [F.lit("kind"), F.lit(kind)]
    for k, c in more.items():
        pairs += [F.lit(k), F.col(c).cast("string")]
    return df.select((F.col(key).cast("long") + base).alias("id"), F.col(name).alias("data"), F.create_map(*pairs).alias("attrs"))


def hierarchy(spark: SparkSession, sf_dir: str, directed: bool = True) -> PropertyGraph:
    region, nation, supplier, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    v = _kind(region, "r_regionkey", 0, "r_name", "region").unionAll(_kind(nation, "n_nationkey", NATION, "n_name", "nation"))
    v = v.unionAll(_kind(supplier, "s_suppkey", SUPPLIER, "s_name", "supplier")).unionAll(_kind(customer, "c_custkey", CUSTOMER, "c_name", "customer", segment="c_mktsegment"))

    def up(df: DataFrame, key: str, base: int, parent: str, parent_base: int, kind: str) -> DataFrame:
        i = F.col(key).cast("long") + base
        return df.select(i.alias("edge_id"), i.alias("src"), (F.col(parent).cast("long") + parent_base).alias("dst"), F.lit(1).cast("long").alias("weight"), F.lit(kind).alias("edge_type"))

    e = up(nation, "n_nationkey", NATION, "n_regionkey", 0, "in_region").unionAll(up(supplier, "s_suppkey", SUPPLIER, "s_nationkey", NATION, "supplier_of"))
    return PropertyGraph.of(v, e.unionAll(up(customer, "c_custkey", CUSTOMER, "c_nationkey", NATION, "customer_of")), directed)


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    nation, supplier, customer, orders, lineitem = (read(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "orders", "lineitem"))
    flow = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
    e = flow.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.col("l_returnflag").alias("edge_type")).agg(F.sum("l_quantity").cast("long").alias("weight"))
    e = e.withColumn("edge_id", (F.col("src") * 100 + F.col("dst")) * 256 + F.ascii("edge_type"))
    return PropertyGraph.of(nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("data")), e, True)


def supply(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    lineitem, supplier, part = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    v = supplier.select((F.col("s_suppkey") + SUPPLIER).alias("id"), F.col("s_name").alias("data")).unionAll(part.select((F.col("p_partkey") + PART).alias("id"), F.col("p_name").alias("data")))
    e = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight"))
    e = e.select((F.col("l_suppkey") * (1 << 32) + F.col("l_partkey")).alias("edge_id"), (F.col("l_suppkey") + SUPPLIER).alias("src"), (F.col("l_partkey") + PART).alias("dst"), "weight", F.lit("supplies").alias("edge_type"))
    return PropertyGraph.of(v, e, False)


def world(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    h, t = hierarchy(spark, sf_dir), trade(spark, sf_dir)
    e = t.edges.select((F.col("edge_id") + TRADE).alias("edge_id"), (F.col("src") + NATION).alias("src"), (F.col("dst") + NATION).alias("dst"), "weight", "edge_type")
    return PropertyGraph.of(h.vertices, h.edges.select("edge_id", "src", "dst", "weight", "edge_type").unionAll(e), False)
