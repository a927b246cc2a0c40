"""Small graphs for the tests."""

from arcweft.model import PropertyGraph

#: The heterogeneous example graph (id, name; edge ends, weight, type in insertion order).
VIKING_NODES = "Hedeby Birka Kaupang Dublin York Ribe Trondheim Uppsala Novgorod Aarhus London Bristol Lindisfarne".split()
VIKING_EDGES = [
    (0, 1, 300, "river"), (0, 5, 150, "river"), (0, 9, 200, "trade"), (1, 2, 400, "sea"), (1, 7, 350, "trade"), (2, 6, 250, "sea"),
    (3, 4, 500, "sea"), (0, 3, 600, "sea"), (4, 5, 300, "river"), (5, 9, 180, "trade"), (6, 7, 450, "mountain"), (7, 8, 700, "trade"),
    (1, 8, 650, "river"), (2, 9, 220, "sea"), (4, 10, 400, "sea"), (10, 11, 200, "river"), (11, 12, 150, "sea"), (12, 4, 300, "sea"),
    (0, 1, 320, "trade"), (0, 5, 160, "trade"), (1, 8, 680, "trade"), (3, 4, 520, "trade"), (4, 10, 420, "river"),
]


def graph(spark, n, edges, directed=False):
    """Vertices 0..n-1 (or given ids) and edges (src, dst[, weight[, type]])."""
    ids = list(range(n)) if isinstance(n, int) else list(n)
    v = spark.createDataFrame([(i,) for i in ids], "id long")
    rows = [(k, e[0], e[1], float(e[2]) if len(e) > 2 else 1.0, e[3] if len(e) > 3 else "") for k, e in enumerate(edges)]
    return PropertyGraph.of(v, spark.createDataFrame(rows, "edge_id long, src long, dst long, weight double, edge_type string"), directed)


def viking(spark):
    g = graph(spark, len(VIKING_NODES), VIKING_EDGES)
    names = spark.createDataFrame(list(enumerate(VIKING_NODES)), "id long, data string")
    return PropertyGraph.of(names, g.edges, False)
