"""The property graph: two DataFrames and a direction.

vertices: id long, data, attrs map<string,string>
edges: edge_id long, src long, dst long, weight, edge_type string, attrs map<string,string>

Undirected edges are kept with src <= dst. A graph is immutable; every operation is a lazy DataFrame program.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERTICES = "id long, data string, attrs map<string,string>"
EDGES = "edge_id long, src long, dst long, weight double, edge_type string, attrs map<string,string>"


class GraphError(ValueError):
    """An id that does not exist, an edge without its ends, or an input of the wrong shape."""


def no_attrs():
    return F.expr("cast(map() as map<string,string>)")


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool

    @staticmethod
    def empty(spark: SparkSession, directed: bool) -> PropertyGraph:
        return PropertyGraph(spark.createDataFrame([], VERTICES), spark.createDataFrame([], EDGES), directed)

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame, directed: bool) -> PropertyGraph:
        """Missing data, attrs, weight, edge_type get defaults; ends of undirected edges are put in order."""
        v, e = vertices, edges
        v = v.select(F.col("id").cast("long").alias("id"), v["data"] if "data" in v.columns else F.col("id").cast("string").alias("data"), v["attrs"] if "attrs" in v.columns else no_attrs().alias("attrs"))
        src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
        e = e.select(
            F.col("edge_id").cast("long").alias("edge_id"),
            (src if directed else F.least(src, dst)).alias("src"),
            (dst if directed else F.greatest(src, dst)).alias("dst"),
            e["weight"] if "weight" in e.columns else F.lit(1).cast("long").alias("weight"),
            e["edge_type"] if "edge_type" in e.columns else F.lit("").alias("edge_type"),
            e["attrs"] if "attrs" in e.columns else no_attrs().alias("attrs"),
        )
        return PropertyGraph(v, e, directed)

    def by_types(self, types: Iterable[str], empty_means_all: bool = False) -> PropertyGraph:
        """Only edges of these types. No types: no edges, or all of them where the operation reads an empty list so."""
        types = list(types)
        if not types and empty_means_all:
            return self
        return replace(self, edges=self.edges.filter(F.col("edge_type").isin(types)))

    def arcs(self) -> DataFrame:
        """edge_id, src, dst, weight, edge_type; undirected edges both ways, loops twice."""
        e = self.edges.select("edge_id", "src", "dst", "weight", "edge_type")
        if self.directed:
            return e
        return e.unionAll(e.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "edge_type"))

    def pairs(self) -> DataFrame:
        """One row per (src, dst) of the arcs: first edge, number, least and total weight."""
        return self.arcs().groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"), F.count("*").alias("m"), F.min("weight").alias("weight"), F.sum(F.col("weight").cast("double")).alias("total"))

    def views(self, prefix: str = "") -> None:
        """Temporary views vertices, edges and arcs for SQL."""
        for name, df in (("vertices", self.vertices), ("edges", self.edges), ("arcs", self.arcs())):
            df.createOrReplaceTempView(prefix + name)

    def require(self, *ids: int) -> None:
        found = {r.id for r in self.vertices.filter(F.col("id").isin(list(ids))).select("id").distinct().collect()}
        if missing := [i for i in ids if i not in found]:
            raise GraphError(f"no vertex {missing[0]}")

    def problems(self) -> DataFrame:
        """kind, key: edges without an end, and repeated vertex or edge ids."""
        ids = self.vertices.select("id")
        ends = [self.edges.select(F.lit(f"no {c}").alias("kind"), F.col("edge_id").alias("key"), F.col(c).alias("id")).join(ids, "id", "left_anti").select("kind", "key") for c in ("src", "dst")]
        twice = [df.groupBy(F.col(c).alias("key")).count().filter("count > 1").select(F.lit(f"repeated {c}").alias("kind"), "key") for df, c in ((self.vertices, "id"), (self.edges, "edge_id"))]
        out = ends[0]
        for df in (ends[1], *twice):
            out = out.unionAll(df)
        return out

    def validate(self) -> bool:
        return self.problems().isEmpty()
