"""The registered graph queries. Each builds its graph from whole tables; the SQL beside it is in `arcweft.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.functions.attrs import get_attr, rendered
from arcweft.model import PropertyGraph
from arcweft.operators import build, centrality, community, components, dominating, search
from arcweft.plans import oracle
from arcweft.shared import cut, fresh_path
from arcweft.sources import graph_csv, tables

TYPES = ["click", "purchase"]
Query = Callable[[SparkSession, str], DataFrame]


def one(spark: SparkSession, value: bool) -> DataFrame:
    return spark.range(1).select(F.lit(value).alias("result"))


def path_rows(spark: SparkSession, path: list[int] | None) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(path or [])], "step long, id long")


def edge_rows(g: PropertyGraph) -> DataFrame:
    return g.edges.select("edge_id", "src", "dst", "weight", "edge_type")


def counts(g: PropertyGraph) -> DataFrame:
    """A digest of a graph: sizes, and sums over ids and weights."""
    v = g.vertices.agg(F.count("*").alias("n_vertices"), F.sum("id").alias("sum_id"))
    e = g.edges.agg(F.count("*").alias("n_edges"), F.sum("src").alias("sum_src"), F.sum("dst").alias("sum_dst"), F.sum("weight").cast("long").alias("sum_weight"))
    return v.join(e, F.lit(True))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    name = df.columns[-1]
    return df.select("id", F.round(name, digits).alias(name))


def csv_round_trip(spark: SparkSession, g: PropertyGraph, typed: bool) -> PropertyGraph:
    nodes, edges = fresh_path(spark, "nodes"), fresh_path(spark, "edges")
    graph_csv.save(g, nodes, edges, typed)
    return graph_csv.load(spark, nodes, edges, g.directed, typed, "long")


def networkx_load(spark: SparkSession, g: PropertyGraph) -> PropertyGraph:
    nodes, edges = fresh_path(spark, "nodes"), fresh_path(spark, "edges")
    graph_csv.save(g, nodes, edges, True)
    return graph_csv.load_networkx_style(spark, nodes, edges)


def cached(g: PropertyGraph) -> PropertyGraph:
    """For loops over a derived graph: its edges and vertices as tables."""
    return PropertyGraph(cut(g.vertices, "vertices"), cut(g.edges, "edges"), g.directed)


def undirected(g: PropertyGraph) -> PropertyGraph:
    return PropertyGraph.of(g.vertices, g.edges, False)


def U(s: SparkSession, d: str) -> PropertyGraph:
    return cached(tables.users(s, d))


def H(s: SparkSession, d: str) -> PropertyGraph:
    return cached(tables.hierarchy(s, d))


def W(s: SparkSession, d: str) -> PropertyGraph:
    return cached(tables.world(s, d))


def named(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), "id long, data string")


def matrix_of(s: SparkSession, d: str) -> PropertyGraph:
    """The trade graph's matrix written densely and read back."""
    return build.from_matrix(build.to_dense_matrix(tables.trade(s, d)), True)


def attr_table(g: PropertyGraph, edges: bool = False) -> DataFrame:
    return g.edges.select("edge_id", rendered(F.col("attrs")).alias("attrs")) if edges else g.vertices.select("id", rendered(F.col("attrs")).alias("attrs"))


def tagged(s: SparkSession, d: str) -> PropertyGraph:
    """Hierarchy whose edges carry their type and length as attributes."""
    g = tables.hierarchy(s, d)
    return PropertyGraph(g.vertices, g.edges.withColumn("attrs", F.create_map(F.lit("kind"), F.col("edge_type"), F.lit("length"), F.col("weight").cast("string"))), True)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        # scans, sources and sinks
        "scan_nodes": lambda s, d: tables.hierarchy(s, d).vertices.select("id", "data"),
        "scan_edges": lambda s, d: edge_rows(tables.users(s, d)),
        "csv_roundtrip_g": lambda s, d: (lambda g: g.vertices.select("id", "data", rendered(F.col("attrs")).alias("attrs")).join(g.edges.groupBy("dst").agg(F.count("*").alias("n_in"), F.min("edge_type").alias("payload")).withColumnRenamed("dst", "id"), "id", "left"))(csv_round_trip(s, tagged(s, d), False)),
        "csv_roundtrip_h": lambda s, d: (lambda g: g.edges.select("edge_id", "src", "dst", "weight", "edge_type", rendered(F.col("attrs")).alias("attrs")))(csv_round_trip(s, tagged(s, d), True)),
        "from_matrix": lambda s, d: matrix_of(s, d).edges.select("src", "dst", "weight"),
        "to_matrix": lambda s, d: build.to_dense_matrix(tables.trade(s, d)).select("i", F.array_join("row", ",").alias("row")),
        "networkx_load": lambda s, d: networkx_load(s, tagged(s, d)).vertices.select("id", "data", rendered(F.col("attrs")).alias("attrs")),
        # construction and mutation
        "add_nodes": lambda s, d: build.add_nodes(tables.hierarchy(s, d), named(s, (50, "x"), (51, "y"))).vertices.select("id", "data"),
        "add_edges": lambda s, d: counts(build.add_edges(tables.trade(s, d), s.createDataFrame([(1, 0, 1, 5), (2, 3, 3, 7)], "edge_id long, src long, dst long, weight long"))),
        "add_nodes_assigned": lambda s, d: build.add_nodes(tables.hierarchy(s, d), tables.read(s, d, "part").select(F.col("p_name").alias("data"))).vertices.select("id", "data"),
        "add_edges_assigned": lambda s, d: edge_rows(build.add_edges(tables.trade(s, d), tables.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"), F.lit(1).cast("long").alias("weight")))),
        "remove_nodes": lambda s, d: counts(build.remove_nodes(tables.world(s, d), s.createDataFrame([(100,), (104,)], "id long"))),
        "remove_edge_pair": lambda s, d: counts(build.remove_edge_pair(tables.world(s, d), 101, 100)),
        "remove_edge_id": lambda s, d: counts(build.remove_edge_id(tables.hierarchy(s, d), 101)),
        "validate": lambda s, d: one(s, tables.world(s, d).validate()),
        # look-ups and attributes
        "set_node_attr": lambda s, d: attr_table(build.set_node_attr(tables.hierarchy(s, d), F.col("id") == 100, "kind", "capital")),
        "set_edge_attr": lambda s, d: attr_table(build.set_edge_attr(tagged(s, d), F.col("dst") == 3, "lane", "north"), True),
        "get_node_attr": lambda s, d: tables.hierarchy(s, d).vertices.select("id", get_attr(F.col("attrs"), "segment").alias("segment")),
        "get_edge_attr": lambda s, d: build.first_edge_attrs(tagged(s, d), SUP, NAT0(s, d)).select(get_attr(F.col("attrs"), "kind").alias("kind")),
        "edge_attrs": lambda s, d: build.first_edge_attrs(tagged(s, d), SUP, NAT0(s, d)).select(rendered(F.col("attrs")).alias("attrs")),
        "neighbors": lambda s, d: build.neighbors(tables.users(s, d), 3),
        "neighbors_grouped": lambda s, d: build.neighbors_grouped(tables.users(s, d)).select("src", "dst", F.array_join(F.transform("edges", lambda e: F.concat(e["edge_id"].cast("string"), F.lit(":"), e["weight"].cast("string"))), ",").alias("edges")),
        "edges_between": lambda s, d: build.edges_between(undirected(tables.users(s, d)), 3, 5).select("edge_id", "src", "dst", "weight"),
        "edges_between_pair": lambda s, d: build.edges_between(undirected(tables.trade(s, d)), 7, 3).select("edge_id", "src", "dst", "weight", "edge_type"),
        "lookup": lambda s, d: tables.hierarchy(s, d).vertices.filter("id = 103").select("id", "data"),
        "has_node": lambda s, d: one(s, not search.start_of(tables.users(s, d), 7).isEmpty()),
        "predecessors": lambda s, d: build.predecessors(tables.users(s, d), 3),
        "predecessors_by_types": lambda s, d: build.predecessors_by_types(tables.users(s, d), 3, TYPES),
        "attr_index": lambda s, d: build.attribute_index(tables.hierarchy(s, d)).select("kind", "key", "value", "chunk", F.array_join("ids", ",").alias("ids")),
        "density": lambda s, d: build.metrics(tables.users(s, d)).select(F.round("density", 9).alias("density")),
        "metrics": lambda s, d: build.metrics(undirected(tables.users(s, d))).select("n_vertices", "n_edges", "directed", F.round("density", 9).alias("density")),
        # conversion
        "convert_default": lambda s, d: build.convert_default(tables.hierarchy(s, d)).vertices.select("id", "data", rendered(F.col("attrs")).alias("attrs")),
        "to_string_g": lambda s, d: build.to_string_plain(tables.hierarchy(s, d)).vertices.select("id", "data"),
        "to_string_h": lambda s, d: edge_rows(build.to_string_typed(tables.users(s, d))),
        "transpose": lambda s, d: edge_rows(build.transpose(tables.users(s, d))),
        "transpose_by_types": lambda s, d: edge_rows(build.transpose_by_types(tables.users(s, d), TYPES)),
        # search
        "has_path": lambda s, d: one(s, search.has_path(H(s, d), tables.SUPPLIER, 2)),
        "has_path_by_types": lambda s, d: one(s, search.has_path(U(s, d).by_types(["purchase"]), 0, 9, strict=False)),
        "bfs_path": lambda s, d: path_rows(s, search.bfs_path(U(s, d), 0, 9)),
        "bfs_path_h": lambda s, d: path_rows(s, search.bfs_path(U(s, d), 0, 11, grouped=True)),
        "bfs_path_by_types": lambda s, d: path_rows(s, search.bfs_path(U(s, d), 0, 12, ["error"], grouped=True)),
        "has_cycle_dir": lambda s, d: one(s, search.has_cycle(H(s, d))),
        "has_cycle_undir": lambda s, d: one(s, search.has_cycle(W(s, d), parallel=False)),
        "has_cycle_by_types": lambda s, d: one(s, search.has_cycle(U(s, d).by_types(["signup"]))),
        # shortest paths
        "sssp": lambda s, d: search.dijkstra(U(s, d), 0).select("id", "dist"),
        "sssp_pred": lambda s, d: search.dijkstra(U(s, d), 0),
        "sssp_by_types": lambda s, d: search.dijkstra(U(s, d), 0, ["purchase"]).select("id", "dist"),
        "sssp_path": lambda s, d: path_rows(s, search.dijkstra_path(U(s, d), 0, 9)),
        "sssp_path_by_types": lambda s, d: path_rows(s, search.dijkstra_path(U(s, d), 0, 9, ["purchase"])),
        # connectivity
        "wcc": lambda s, d: components.weak(cached(tables.supply(s, d))),
        "scc": lambda s, d: components.strong(U(s, d).by_types(["signup"])),
        "cc": lambda s, d: components.connected_components(H(s, d)),
        "is_wcc": lambda s, d: one(s, components.is_weak(H(s, d))),
        "is_scc": lambda s, d: one(s, components.is_strong(U(s, d))),
        "is_connected": lambda s, d: one(s, components.is_connected(W(s, d))),
        "wcc_by_types": lambda s, d: components.weak(W(s, d).by_types(["customer_of", "A"], True)),
        "scc_by_types": lambda s, d: components.strong(U(s, d).by_types(["error"], True)),
        "cc_by_types": lambda s, d: components.connected_components(W(s, d), ["supplier_of"]),
        "is_connected_by_types": lambda s, d: one(s, components.is_connected(W(s, d), ["in_region", "supplier_of"])),
        "is_wcc_by_types": lambda s, d: one(s, components.is_weak(W(s, d).by_types(["supplier_of"], True))),
        "is_scc_by_types": lambda s, d: one(s, components.is_strong(U(s, d).by_types(["click", "purchase", "view"], True))),
        # bridges
        "bridges": lambda s, d: components.bridges(W(s, d)),
        "bridges_h": lambda s, d: components.bridges_single(W(s, d)),
        "bridges_by_types": lambda s, d: components.bridges_by_types(W(s, d), ["in_region", "supplier_of"]),
        # centrality
        "degree": lambda s, d: centrality.degree(undirected(tables.users(s, d))),
        "degree_by_types": lambda s, d: centrality.degree(tables.users(s, d).by_types(TYPES)),
        "betweenness": lambda s, d: rounded(centrality.betweenness(U(s, d))),
        "betweenness_h": lambda s, d: rounded(centrality.betweenness(U(s, d), weighted=True, multiplicity=False)),
        "betweenness_by_types": lambda s, d: rounded(centrality.betweenness(U(s, d), weighted=True, multiplicity=False, types=["purchase"])),
        "closeness": lambda s, d: rounded(centrality.closeness(U(s, d))),
        "closeness_h": lambda s, d: rounded(centrality.closeness(U(s, d), weighted=True), 12),
        "closeness_by_types": lambda s, d: rounded(centrality.closeness(U(s, d).by_types(["purchase"]), weighted=True), 12),
        "eigenvector": lambda s, d: rounded(centrality.eigenvector(U(s, d), 10)),
        "eigenvector_by_types": lambda s, d: rounded(centrality.eigenvector(U(s, d).by_types(TYPES), 10)),
        "eigenvector_tolerance": lambda s, d: rounded(centrality.eigenvector(U(s, d), 200, 1e-13)),
        "pagerank_tolerance": lambda s, d: rounded(centrality.pagerank(U(s, d), 0.85, 200, 1e-12)),
        "katz_tolerance": lambda s, d: rounded(centrality.katz(U(s, d), 1e-8, 1.0, 200, 1e-13)),
        "pagerank": lambda s, d: rounded(centrality.pagerank(U(s, d), 0.85, 20, 0)),
        "pagerank_by_types": lambda s, d: rounded(centrality.pagerank(U(s, d).by_types(TYPES), 0.85, 20, 0)),
        "katz": lambda s, d: rounded(centrality.katz(U(s, d), 1e-6, 1.0, 10, 0)),
        "katz_by_types": lambda s, d: rounded(centrality.katz(U(s, d).by_types(TYPES), 1e-6, 1.0, 10, 0)),
        # dominating sets and communities
        "dominating_set": lambda s, d: dominating.dominating_set(U(s, d)),
        "dominating_set_h": lambda s, d: dominating.dominating_set_typed(undirected(U(s, d))),
        "dominating_set_by_types": lambda s, d: dominating.dominating_set_typed(undirected(U(s, d)), ["signup"]),
        "communities": lambda s, d: community.communities(cached(tables.trade(s, d))),
        "communities_by_types": lambda s, d: community.communities_by_types(W(s, d), ["in_region", "supplier_of"]),
        "communities_of_stars": lambda s, d: community.communities_by_types(W(s, d), ["supplier_of"]),
        "modularity": lambda s, d: s.range(1).select(F.round(F.lit(community.modularity(cut(community._symmetric(tables.trade(s, d)), "arcs"), tables.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("label")))), 9).alias("modularity")),
    }
    return q


SUP = tables.SUPPLIER


def NAT0(s: SparkSession, d: str) -> int:
    """The nation of the first supplier."""
    return tables.NATION + tables.read(s, d, "supplier").filter("s_suppkey = 0").first().s_nationkey


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
