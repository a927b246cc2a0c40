"""Construction, mutation, look-ups, attributes and conversion. All are single-pass filters, unions or joins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweft.functions.attrs import with_attr
from arcweft.model import GraphError, PropertyGraph, no_attrs
from arcweft.shared import numbered


def add_nodes(g: PropertyGraph, data: DataFrame) -> PropertyGraph:
    """Rows (data[, attrs]) as vertices with ids after the largest; rows with their own `id` keep it."""
    if "id" not in data.columns:
        top = g.vertices.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        data = numbered(data, ["data"], "_n").withColumn("id", F.col("_n") + top + 1)
    elif not data.select("id").join(g.vertices.select("id"), "id", "left_semi").isEmpty():
        raise GraphError("an id exists already")
    attrs = data["attrs"] if "attrs" in data.columns else no_attrs()
    return replace(g, vertices=g.vertices.unionByName(data.select(F.col("id").cast("long").alias("id"), "data", attrs.alias("attrs"))))


def add_edges(g: PropertyGraph, edges: DataFrame) -> PropertyGraph:
    """All rows or none: an end that does not exist raises."""
    if "edge_id" not in edges.columns:
        top = g.edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1))).first()[0]
        edges = numbered(edges, ["src", "dst"], "_n").withColumn("edge_id", F.col("_n") + top + 1)
    new = PropertyGraph.of(g.vertices, edges, g.directed).edges
    ends = new.select(F.explode(F.array("src", "dst")).alias("id"))
    if bad := ends.join(g.vertices.select("id"), "id", "left_anti").first():
        raise GraphError(f"no vertex {bad.id}")
    return replace(g, edges=g.edges.unionByName(new))


def remove_nodes(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Vertices (id) and every edge at them."""
    gone = ids.select("id").distinct()
    edges = g.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return replace(g, vertices=g.vertices.join(gone, "id", "left_anti"), edges=edges.select(g.edges.columns))


def is_pair(g: PropertyGraph, a: int, b: int) -> Column:
    """Edges from a to b; of undirected graphs also b to a."""
    there = (F.col("src") == a) & (F.col("dst") == b)
    return there if g.directed else there | ((F.col("src") == b) & (F.col("dst") == a))


def remove_edge_pair(g: PropertyGraph, a: int, b: int) -> PropertyGraph:
    """All parallel edges between a and b."""
    if g.edges.filter(is_pair(g, a, b)).isEmpty():
        raise GraphError(f"no edge {a}-{b}")
    return replace(g, edges=g.edges.filter(~is_pair(g, a, b)))


def remove_edge_id(g: PropertyGraph, edge_id: int) -> PropertyGraph:
    return replace(g, edges=g.edges.filter(F.col("edge_id") != edge_id))


def set_node_attr(g: PropertyGraph, where: Column, key: str, value: str) -> PropertyGraph:
    return replace(g, vertices=g.vertices.withColumn("attrs", F.when(where, with_attr(F.col("attrs"), F.lit(key), F.lit(value))).otherwise(F.col("attrs"))))


def set_node_attrs(g: PropertyGraph, updates: DataFrame) -> PropertyGraph:
    """Rows (id, key, value) in bulk; each key of a vertex once."""
    new = updates.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_new"))
    v = g.vertices.join(new, "id", "left")
    merged = F.map_concat(F.map_filter("attrs", lambda k, _: ~F.map_contains_key("_new", k)), F.col("_new"))
    return replace(g, vertices=v.withColumn("attrs", F.when(F.col("_new").isNull(), F.col("attrs")).otherwise(merged)).select(g.vertices.columns))


def set_edge_attr(g: PropertyGraph, where: Column, key: str, value: str) -> PropertyGraph:
    """By pair (`is_pair`) or by id; all edges that match."""
    return replace(g, edges=g.edges.withColumn("attrs", F.when(where, with_attr(F.col("attrs"), F.lit(key), F.lit(value))).otherwise(F.col("attrs"))))


def first_edge_attrs(g: PropertyGraph, a: int, b: int) -> DataFrame:
    """attrs of the first of the edges between a and b."""
    return g.edges.filter(is_pair(g, a, b)).agg(F.min_by("attrs", "edge_id").alias("attrs")).filter("attrs is not null")


def neighbors(g: PropertyGraph, node: int) -> DataFrame:
    return g.arcs().filter(F.col("src") == node).select("edge_id", F.col("dst").alias("neighbor"), "weight")


def neighbors_grouped(g: PropertyGraph) -> DataFrame:
    return g.arcs().groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("edge_id", "weight"))).alias("edges"))


def predecessors(g: PropertyGraph, node: int) -> DataFrame:
    return g.arcs().filter(F.col("dst") == node).select("edge_id", F.col("src").alias("predecessor"), "weight")


def edges_between(g: PropertyGraph, a: int, b: int) -> DataFrame:
    return g.edges.filter(is_pair(g, a, b))


#: Ids in one row of the attribute index.
CHUNK = 10_000


def attribute_index(g: PropertyGraph) -> DataFrame:
    """kind, key, value, chunk, ids: which vertices and edges hold a value. A value that many hold has several rows, each with the ids
    of one chunk (all whose id // CHUNK is `chunk`), so no row grows with the graph."""
    v = g.vertices.select(F.lit("node").alias("kind"), "id", F.explode("attrs").alias("key", "value"))
    e = g.edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.explode("attrs").alias("key", "value"))
    rows = v.unionAll(e).withColumn("chunk", F.floor(F.col("id") / CHUNK))
    return rows.groupBy("kind", "key", "value", "chunk").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def predecessors_by_types(g: PropertyGraph, node: int, types: list[str]) -> DataFrame:
    """Over edges of the types; no types: no edges."""
    return predecessors(g.by_types(types), node)


def metrics(g: PropertyGraph) -> DataFrame:
    """n_vertices, n_edges, directed, density (0 for fewer than two vertices)."""
    v = g.vertices.agg(F.count("*").alias("n_vertices"))
    e = g.edges.agg(F.count("*").alias("n_edges"))
    n = F.col("n_vertices").cast("double")
    most = n * (n - 1) / (1 if g.directed else 2)
    return v.join(e, F.lit(True)).select("n_vertices", "n_edges", F.lit(g.directed).alias("directed"), F.when(n > 1, F.try_divide("n_edges", most)).otherwise(0.0).alias("density"))


def transpose(g: PropertyGraph) -> PropertyGraph:
    """Every arc turned; the result is directed (of an undirected graph, arcs from large to small)."""
    e = g.edges.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "edge_type", "attrs")
    return PropertyGraph(g.vertices, e, True)


def transpose_by_types(g: PropertyGraph, types: list[str]) -> PropertyGraph:
    """Edges of the types (none: all), turned; the direction flag stays."""
    return replace(transpose(g.by_types(types, empty_means_all=True)), directed=g.directed)


def convert_default(g: PropertyGraph, data: Column | None = None, edge_type: Column | None = None) -> PropertyGraph:
    """The same structure, weights and attributes with payloads replaced by defaults."""
    return replace(g, vertices=g.vertices.withColumn("data", F.lit("") if data is None else data), edges=g.edges.withColumn("edge_type", F.lit("") if edge_type is None else edge_type))


def to_string_plain(g: PropertyGraph) -> PropertyGraph:
    """Vertex payload: the id as text; edge payload: empty."""
    return convert_default(g, F.col("id").cast("string"))


def to_string_typed(g: PropertyGraph, render: Column | None = None) -> PropertyGraph:
    """Payloads as text, by a rendering expression where they are structs."""
    return replace(g, vertices=g.vertices.withColumn("data", F.col("data").cast("string") if render is None else render), edges=g.edges.withColumn("edge_type", F.col("edge_type").cast("string")))


def from_matrix(rows: DataFrame, directed: bool) -> PropertyGraph:
    """Rows (i, row array) of a square matrix; undirected graphs read the upper triangle with the diagonal."""
    shape = rows.agg(F.count("*").alias("n"), F.min(F.size("row")).alias("lo"), F.max(F.size("row")).alias("hi")).first()
    if not shape.n or shape.lo != shape.n or shape.hi != shape.n:
        raise GraphError("the matrix is empty or not square")
    cells = rows.select(F.col("i").cast("long").alias("src"), F.posexplode("row").alias("j", "weight")).filter("weight <> 0")
    cells = cells.withColumn("dst", F.col("j").cast("long")).withColumn("edge_id", F.col("src") * shape.n + F.col("dst"))
    if not directed:
        cells = cells.filter("dst >= src")
    return PropertyGraph.of(rows.select(F.col("i").alias("id"), F.lit("").alias("data")), cells, directed)


def to_matrix(g: PropertyGraph) -> DataFrame:
    """i, j, weight of the cells that hold an edge; of parallel edges the last counts."""
    return g.arcs().groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.max_by("weight", "edge_id").alias("weight"))


def to_dense_matrix(g: PropertyGraph) -> DataFrame:
    """i, row: the dense square matrix in vertex order, 0 where there is no edge. Its size is the square of the vertices'."""
    place = numbered(g.vertices.select("id"), ["id"], "p")
    n = place.count()
    cells = to_matrix(g).join(place.select(F.col("id").alias("j"), F.col("p").alias("q")), "j").groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("q", "weight"))).alias("cells"))
    kind = g.edges.schema["weight"].dataType
    cell = lambda q: F.coalesce(F.try_element_at("cells", q), F.lit(0).cast(kind))
    zero = F.when(F.col("cells").isNull(), F.array_repeat(F.lit(0).cast(kind), n)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell))
    return place.join(cells, place.id == cells.i, "left").select(F.col("id").alias("i"), zero.alias("row"))
