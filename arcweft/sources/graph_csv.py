"""Graph CSV files: plain (ids and attributes) and typed (payloads too). Fields are neither quoted nor escaped.

Files are written in one part each where the reader wants single files (`single`), else in as many as Spark has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.model import GraphError, PropertyGraph, no_attrs

PLAIN_NODES, PLAIN_EDGES = ["node_id"], ["from", "to", "weight"]
TYPED_NODES, TYPED_EDGES = ["node_id", "data"], ["edge_id", "from", "to", "weight", "data"]


class FormatError(GraphError):
    """A header, a number of fields or a value that does not fit."""


def attr_keys(df: DataFrame) -> list[str]:
    """The schema of the attribute columns: as many values as the file has columns."""
    return sorted(r[0] for r in df.select(F.explode(F.map_keys("attrs"))).distinct().collect())


def _write(df: DataFrame, fixed: list[Column], keys: list[str], names: list[str], path: str, single: bool) -> None:
    attrs = [F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit("")) for k in keys]
    fields = [*(c.cast("string") for c in fixed), *(attrs or [F.lit("")])]  # without attributes a comma is left at the end
    lines = df.select(F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in fields)).alias("value"))
    head = df.sparkSession.createDataFrame([(",".join(names) + "," + ",".join(keys),)], "value string")
    if single:
        head.withColumn("n", F.lit(0)).unionAll(lines.withColumn("n", F.lit(1))).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)
    else:
        # every part begins with the header, as readers of folders expect
        lines.select(F.split("value", ",", -1).alias("f")).select(*(F.col("f")[i].alias(c or "_") for i, c in enumerate([*names, *(keys or [""])]))).write.mode("overwrite").csv(path, header=True, quote="", emptyValue="")


def save(g: PropertyGraph, nodes: str, edges: str, typed: bool, single: bool = False) -> None:
    """Two folders of part files; `single` writes each as one part, in one task, for readers of single files."""
    v, e = g.vertices, g.edges
    _write(v, [F.col("id"), F.col("data")] if typed else [F.col("id")], attr_keys(v), TYPED_NODES if typed else PLAIN_NODES, nodes, single)
    ends = [F.col("src"), F.col("dst"), F.col("weight")]
    _write(e, [F.col("edge_id"), *ends, F.col("edge_type")] if typed else ends, attr_keys(e), TYPED_EDGES if typed else PLAIN_EDGES, edges, single)


def _read(spark: SparkSession, path: str, names: list[str], what: str) -> tuple[DataFrame, list[str]]:
    lines = spark.read.text(path)
    first = lines.first()
    if first is None or not first.value:
        raise FormatError(f"empty {what} file")
    head = first.value.split(",")
    if head[: len(names)] != names:
        raise FormatError(f"{what} file: the header must begin with {','.join(names)}")
    keys = [k for k in head[len(names) :] if k]
    rows = lines.filter((F.col("value") != first.value) & (F.col("value") != "")).withColumn("f", F.split("value", ",", -1))
    if bad := rows.filter(F.size("f") < len(names)).first():
        raise FormatError(f"{what} file: too few fields in {bad.value!r}")
    return rows, keys


def _attrs(keys: list[str], at: int) -> Column:
    if not keys:
        return no_attrs()
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.get("f", F.lit(at + i)).alias("value")) for i, k in enumerate(keys)))
    return F.map_from_entries(F.filter(entries, lambda x: F.coalesce(x["value"], F.lit("")) != ""))


def _number(i: int, kind: str, what: str) -> Column:
    """A field as a number; a value that is none raises with the line."""
    c = F.col("f")[i]
    return F.coalesce(c.try_cast(kind), F.raise_error(F.concat(F.lit(f"{what}: not a number: "), F.col("value"))).cast(kind))


def load(spark: SparkSession, nodes: str, edges: str, directed: bool, typed: bool, weight: str = "double") -> PropertyGraph:
    """Ids are those of the files. Plain files: the payload of a vertex is its id, that of an edge its first attribute."""
    rows, keys = _read(spark, nodes, TYPED_NODES if typed else PLAIN_NODES, "nodes")
    fixed = len(TYPED_NODES if typed else PLAIN_NODES)
    v = rows.select(_number(0, "long", "nodes").alias("id"), (F.col("f")[1] if typed else F.col("f")[0]).alias("data"), _attrs(keys, fixed).alias("attrs"))
    rows, keys = _read(spark, edges, TYPED_EDGES if typed else PLAIN_EDGES, "edges")
    at = 1 if typed else 0
    columns = [_number(at, "long", "edges").alias("src"), _number(at + 1, "long", "edges").alias("dst"), _number(at + 2, weight, "edges").alias("weight")]
    if typed:
        e = rows.select(_number(0, "long", "edges").alias("edge_id"), *columns, F.col("f")[4].alias("edge_type"), _attrs(keys, 5).alias("attrs"))
    else:
        e = rows.select(F.monotonically_increasing_id().alias("edge_id"), *columns, F.coalesce(F.get("f", F.lit(3)), F.lit("")).alias("edge_type"), _attrs(keys, 3).alias("attrs"))
    g = PropertyGraph.of(v, e, directed)
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(g.vertices.select("id"), "id", "left_anti")
    if bad := ends.first():
        raise FormatError(f"edges file: no vertex {bad.id}")
    return g


def load_networkx_style(spark: SparkSession, nodes: str, edges: str) -> PropertyGraph:
    """Typed files as an undirected multigraph whose missing payloads and attributes read "unknown"."""
    g = load(spark, nodes, edges, False, True)
    keys = {"v": attr_keys(g.vertices), "e": attr_keys(g.edges)}

    def filled(ks: list[str]) -> Column:
        return F.create_map(*(x for k in ks for x in (F.lit(k), F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit("unknown"))))) if ks else no_attrs()

    unknown = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c))
    return PropertyGraph(g.vertices.withColumn("attrs", filled(keys["v"])).withColumn("data", unknown("data")), g.edges.withColumn("attrs", filled(keys["e"])).withColumn("edge_type", unknown("edge_type")), False)
