"""Small graphs, edge cases and random graphs against plain Python."""

import heapq
import os
import random

import pytest
from graphs import graph, viking
from pyspark.sql import functions as F

from arcweft.model import GraphError, PropertyGraph
from arcweft.operators import brandes, build, centrality, community, components, dominating, search
from arcweft.shared import shared_dir
from arcweft.sources import graph_csv


def ids(df):
    return sorted(r.id for r in df.collect())


def test_mutation_and_attributes(spark):
    g = graph(spark, 3, [(1, 0, 2, "a"), (0, 1, 3, "b"), (1, 2)])
    assert [(r.src, r.dst) for r in g.edges.orderBy("edge_id").collect()] == [(0, 1), (0, 1), (1, 2)]
    assert g.validate()
    more = build.add_edges(g, spark.createDataFrame([(2, 0, 1.0)], "src long, dst long, weight double"))
    assert more.edges.count() == 4 and more.edges.agg(F.max("edge_id")).first()[0] == 3
    with pytest.raises(GraphError):
        build.add_edges(g, spark.createDataFrame([(9, 0, 1.0)], "src long, dst long, weight double"))
    assert build.remove_edge_pair(g, 1, 0).edges.count() == 1
    with pytest.raises(GraphError):
        build.remove_edge_pair(g, 0, 2)
    assert build.remove_nodes(g, spark.createDataFrame([(1,)], "id long")).edges.isEmpty()
    assert not PropertyGraph(g.vertices.filter("id < 2"), g.edges, False).validate()
    tagged = build.set_edge_attr(build.set_node_attr(g, F.col("id") == 1, "k", "v"), build.is_pair(g, 1, 0), "w", "x")
    assert build.first_edge_attrs(tagged, 0, 1).first().attrs == {"w": "x"}
    assert [(r.kind, r.key, r.value, r.ids) for r in build.attribute_index(tagged).orderBy("kind").collect()] == [("edge", "w", "x", [0, 1]), ("node", "k", "v", [1])]
    bulk = build.set_node_attrs(tagged, spark.createDataFrame([(1, "k", "n"), (2, "z", "y")], "id long, key string, value string"))
    assert {r.id: r.attrs for r in bulk.vertices.collect()} == {0: {}, 1: {"k": "n"}, 2: {"z": "y"}}
    with pytest.raises(GraphError):
        build.add_nodes(g, spark.createDataFrame([(1, "x")], "id long, data string"))
    assert ids(build.add_nodes(g, spark.createDataFrame([("x",)], "data string")).vertices) == [0, 1, 2, 3]


def test_matrix(spark):
    rows = spark.createDataFrame([(0, [0, 2, 0]), (1, [2, 0, 1]), (2, [0, 1, 5])], "i int, row array<long>")
    for directed, n in ((True, 5), (False, 3)):
        g = build.from_matrix(rows, directed)
        assert g.edges.count() == n
        assert {r.i: r.row for r in build.to_dense_matrix(g).collect()} == {r.i: r.row for r in rows.collect()}
    with pytest.raises(GraphError):
        build.from_matrix(rows.limit(2), True)
    with pytest.raises(GraphError):
        build.from_matrix(rows.limit(0), True)


def test_csv(spark, tmp_path):
    g = viking(spark)
    g = build.set_node_attr(g, F.col("id") == 0, "type", "hub")
    g = build.set_edge_attr(g, F.col("edge_id") < 2, "priority", "low")
    for single in (True, False):
        n, e = str(tmp_path / f"n{single}"), str(tmp_path / f"e{single}")
        graph_csv.save(g, n, e, True, single)
        back = graph_csv.load(spark, n, e, False, True)
        assert sorted(map(str, back.edges.collect())) == sorted(map(str, g.edges.collect()))
        assert sorted(map(str, back.vertices.collect())) == sorted(map(str, g.vertices.collect()))
    graph_csv.save(g, n, e, False)
    back = graph_csv.load(spark, n, e, False, False)
    assert back.edges.count() == 23 and back.vertices.filter("data = cast(id as string)").count() == 13
    assert sorted(r.edge_type for r in back.edges.filter("edge_type <> ''").collect()) == ["low", "low"]
    filled = graph_csv.load_networkx_style(spark, str(tmp_path / "nTrue"), str(tmp_path / "eTrue"))
    assert filled.vertices.filter("attrs['type'] = 'unknown'").count() == 12

    def files(nodes, edges):
        for name, text in (("bn", nodes), ("be", edges)):
            (tmp_path / name).write_text(text)
        return graph_csv.load(spark, str(tmp_path / "bn"), str(tmp_path / "be"), False, True)

    good = "node_id,data,\n0,x\n", "edge_id,from,to,weight,data,\n"
    assert files(*good).vertices.count() == 1
    for nodes, edges in (("", good[1]), ("id,data\n0,x\n", good[1]), ("node_id,data,\n0\n", good[1]), (good[0], good[1] + "0,0,7,1,t\n")):
        with pytest.raises(graph_csv.FormatError):
            files(nodes, edges)
    with pytest.raises(Exception, match="not a number"):
        files(good[0], good[1] + "0,0,0,w,t\n").edges.collect()


def test_search_edge_cases(spark):
    g = graph(spark, 4, [(0, 1), (1, 2)], True)
    assert search.has_path(g, 0, 2) and not search.has_path(g, 2, 0) and search.has_path(g, 3, 3)
    assert not search.has_path(g, 0, 2, excluded=spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(GraphError):
        search.has_path(g, 0, 9)
    assert not search.has_path(g, 9, 9, strict=False)
    assert search.bfs_path(g, 0, 3) is None
    with pytest.raises(GraphError):
        search.dijkstra(graph(spark, 2, [(0, 1, -1)]), 0)
    assert not search.has_cycle(g) and search.has_cycle(graph(spark, 3, [(0, 1), (1, 2), (2, 0)], True)) and search.has_cycle(graph(spark, 1, [(0, 0)], True))
    double = graph(spark, 2, [(0, 1), (0, 1)])
    assert search.has_cycle(double) and not search.has_cycle(double, parallel=False)


def test_empty_and_single(spark):
    for directed in (True, False):
        e = PropertyGraph.empty(spark, directed)
        assert e.validate() and components.is_connected(e) and components.weak(e).isEmpty() and components.strong(e).isEmpty()
        assert centrality.pagerank(e).isEmpty() and centrality.betweenness(e).isEmpty() and dominating.dominating_set(e).isEmpty() and community.communities(e).isEmpty()
        one = graph(spark, 1, [], directed)
        assert components.is_connected(one) and ids(dominating.dominating_set(one)) == [0] and dominating.dominating_set_typed(one).isEmpty()
        assert [r.closeness for r in centrality.closeness(one).collect()] == [0.0]
        assert [(r.community, r.id) for r in community.communities(one).collect()] == [(0, 0)]
    assert not components.is_weak(PropertyGraph.empty(spark, False), strict_empty=True)


def test_small_scores(spark):
    star = graph(spark, 4, [(0, 1), (1, 2), (1, 3)])
    assert {r.id: r.betweenness for r in centrality.betweenness(star).collect()} == {0: 0.0, 1: 1.0, 2: 0.0, 3: 0.0}
    path = graph(spark, 3, [(0, 1), (1, 2)])
    assert {r.id: round(r.closeness, 9) for r in centrality.closeness(path, weighted=True).collect()} == {0: 0.666666667, 1: 1.0, 2: 0.666666667}
    for df in (centrality.katz(path), centrality.eigenvector(path, 20), centrality.pagerank(path)):
        x = [r[1] for r in df.orderBy("id").collect()]
        assert x[1] > x[0] and abs(x[0] - x[2]) < 1e-9


def test_communities(spark):
    g = graph(spark, 6, [(0, 1), (1, 2), (0, 2), (3, 4)])
    got = {}
    for r in community.communities(g).collect():
        got.setdefault(r.community, set()).add(r.id)
    assert got == {0: {0, 1, 2}, 3: {3, 4}, 5: {5}}
    assert ids(community.communities_by_types(g, [])) == [0, 1, 2, 3, 4]
    rng = random.Random(3)
    edges = [(a, b) for k in range(3) for a in range(8 * k, 8 * k + 8) for b in range(a + 1, 8 * k + 8) if rng.random() < 0.8] + [(0, 8), (9, 16)]
    g = graph(spark, 24, edges)
    found = community.communities(g)
    parts = {frozenset(r.id for r in found.collect() if r.community == c) for c in {r.community for r in found.collect()}}
    assert parts == {frozenset(range(8 * k, 8 * k + 8)) for k in range(3)}
    arcs = community._symmetric(g)
    single = g.vertices.select("id", F.col("id").alias("label"))
    assert community.modularity(arcs, found.select("id", F.col("community").alias("label"))) > community.modularity(arcs, single)


def brute_reach(n, arcs):
    out = []
    for s in range(n):
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for y in arcs.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out.append(seen)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(18)]
    arcs = {}
    for a, b in edges:
        arcs.setdefault(a, set()).add(b)
    reach = brute_reach(n, arcs)
    g = graph(spark, n, edges, True)
    want = {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}
    assert {r.id: r.component for r in components.strong(g).collect()} == want
    assert search.has_cycle(g) == any(a == b or a in reach[b] for a, b in edges)
    u = graph(spark, n, edges)
    pairs = {(min(e), max(e)) for e in edges if e[0] != e[1]}

    def joined(without):
        both = {}
        for a, b in pairs - {without}:
            both.setdefault(a, set()).add(b)
            both.setdefault(b, set()).add(a)
        return brute_reach(n, both)

    bridges = sorted(p for p in pairs if p[1] not in joined(p)[p[0]])
    assert sorted((r.src, r.dst) for r in components.bridges(u).collect()) == bridges
    # sequential greedy over out-neighbours
    near = {i: [b for a, b in edges if a == i] for i in range(n)}
    taken, covered = [], set()
    for i in sorted(range(n), key=lambda i: (-len(near[i]), i)):
        if i not in covered:
            taken.append(i)
            covered |= {i, *near[i]}
    assert ids(dominating.dominating_set(g)) == sorted(taken)


def test_bridges_of_a_long_path_with_a_cycle(spark):
    """Depth does not matter: 10,000 vertices in a row, whose first 100 are also a ring."""
    n = 10_000
    ids = spark.range(n)
    edges = ids.filter("id > 0").select(F.col("id").alias("edge_id"), (F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    edges = edges.unionAll(spark.createDataFrame([(n, 0, 99), (n + 1, 7, 7), (n + 2, 500, 501)], "edge_id long, src long, dst long"))
    got = {(r.src, r.dst) for r in components.bridges(PropertyGraph.of(ids, edges, False)).collect()}
    assert got == {(i, i + 1) for i in range(99, n - 1)}


def test_refinement_without_a_fixed_seed(spark):
    g = graph(spark, 8, [(a, b) for k in (0, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(0, 4)])
    free = community.CommunityConfig(seed=None, deterministic=False)
    found = community.communities(g, free)
    parts = {}
    for r in found.collect():
        parts.setdefault(r.community, set()).add(r.id)
    assert set().union(*parts.values()) == set(range(8)) and all(c == min(x) for c, x in parts.items())
    again = [sorted(map(tuple, community.communities(g).collect())) for _ in range(2)]
    assert again[0] == again[1] and {c for c, _ in again[0]} == {0, 4}


def test_batches_change_nothing(spark):
    rng = random.Random(4)
    g = graph(spark, 9, [(rng.randrange(9), rng.randrange(9), rng.randrange(1, 5)) for _ in range(16)])
    for measure in (centrality.closeness, centrality.betweenness):
        one, three = ({r[0]: round(r[1], 9) for r in measure(g, weighted=True, batches=b).collect()} for b in (1, 3))
        assert one == three


def test_predecessors_over_arcs_of_weight_zero(spark):
    """The smallest of equal predecessors counts, also where its arc weighs nothing and its id is the larger one."""
    g = graph(spark, 6, [(0, 5, 3), (5, 2, 0), (2, 3, 1), (0, 4, 4), (4, 3, 0)], directed=True)
    got = {r.id: (r.dist, r.pred) for r in search.dijkstra(g, 0).collect()}
    assert got == {0: (0.0, None), 5: (3.0, 0), 2: (3.0, 5), 4: (4.0, 0), 3: (4.0, 2)}
    assert search.dijkstra_path(g, 0, 2) == [0, 5, 2]


def test_paths_past_a_circle_of_weight_zero(spark):
    """1 and 2 are each other's smallest predecessors; the path still begins at the start."""
    g = graph(spark, 6, [(0, 3, 1), (3, 2, 0), (2, 1, 0), (1, 2, 0), (2, 4, 5)], directed=True)
    assert {r.id: r.pred for r in search.dijkstra(g, 0).collect()} == {0: None, 3: 0, 2: 1, 1: 2, 4: 2}
    assert search.dijkstra_path(g, 0, 4) == [0, 3, 2, 4] and search.dijkstra_path(g, 0, 1) == [0, 3, 2, 1] and search.dijkstra_path(g, 0, 5) is None


def test_betweenness_over_arcs_of_weight_zero(spark):
    """0 to 3 by 1 or by 2, both of length 2; by 4 in addition where types allow all."""
    edges = [(0, 1, 2, "a"), (1, 3, 0, "a"), (0, 2, 0, "a"), (2, 3, 2, "a"), (0, 4, 1, "b"), (4, 3, 1, "b")]
    g = graph(spark, 5, edges, directed=True)
    score = lambda **more: {r.id: round(r.betweenness * 12, 9) for r in centrality.betweenness(g, weighted=True, multiplicity=False, **more).collect()}
    third = round(1 / 3, 9)
    assert score() == {0: 0.0, 1: third, 2: third, 3: 0.0, 4: third}
    assert score(types=["a"]) == {0: 0.0, 1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}  # 0.5 of four vertices, times 12 / 6
    for bad in ([(0, 1, 0), (1, 2, 0), (2, 0, 0)], [(0, 1, -1)]):
        with pytest.raises(GraphError):
            centrality.betweenness(graph(spark, 3, bad, directed=True), weighted=True)


def test_betweenness_of_a_long_path(spark):
    """Depth makes no tables: 100 vertices in a row, of which vertex i is on i * (99 - i) paths."""
    n, at = 100, f"{shared_dir(spark)}/arcweft".removeprefix("file:")
    g = graph(spark, n, [(i, i + 1, i % 5 + 1, "a") for i in range(n - 1)] + [(5, 9, 1, "b")], directed=True)
    before = len(os.listdir(at)) if os.path.isdir(at) else 0
    got = {r.id: round(r.betweenness * 99 * 98, 6) for r in centrality.betweenness(g, weighted=True, multiplicity=False, types=["a"]).collect()}
    assert got == {i: i * (99 - i) for i in range(n)}
    assert len(os.listdir(at)) - before < 20


@pytest.mark.parametrize("directed", [True, False])
def test_betweenness_in_arrays_and_tables(spark, monkeypatch, directed):
    """Blocks of any number and size give what tables give: ties, arcs of weight zero, parallel ones, whole and broken weights."""
    rng = random.Random(7)
    some = [(a, b, rng.randrange(0 if directed and a < b else 1, 3)) for a, b in ((rng.randrange(7), rng.randrange(7)) for _ in range(18))]
    g = graph(spark, 8, some, directed)
    whole = PropertyGraph(g.vertices, g.edges.withColumn("weight", F.col("weight").cast("long")), directed)
    halves = PropertyGraph(g.vertices, g.edges.withColumn("weight", F.col("weight") / 2), directed)
    scores = lambda g, **more: {r.id: round(r.betweenness, 9) for r in centrality.betweenness(g, weighted=True, **more).collect()}
    got = scores(whole)
    assert scores(halves, batches=3) == got and sum(x > 0 for x in got.values()) > 2
    monkeypatch.setattr(brandes, "CELLS", 40)
    assert scores(whole) == got
    monkeypatch.setattr(centrality, "ARCS", 0)
    assert scores(whole) == got


def in_copies(rng, users: int, copies: int, events: int) -> list[tuple]:
    """Arcs of a walk over users of which each step stands in so many copies side by side, as in a table repeated with shifted keys."""
    walk = [(k * users + u, c) for u, c in ((rng.randrange(users), rng.randrange(4)) for _ in range(events)) for k in range(copies)]
    return [(a, b, c) for (a, c), (b, _) in zip(walk, walk[1:], strict=False)]


def test_betweenness_of_a_long_path_of_weight_zero(spark):
    """The search for circles of weight zero does not peel a path arc by arc: depth makes no tables there either."""
    n, at = 100, f"{shared_dir(spark)}/arcweft".removeprefix("file:")
    g = graph(spark, n, [(i, i + 1, 0) for i in range(n - 1)], directed=True)
    g = PropertyGraph(g.vertices, g.edges.withColumn("weight", F.col("weight").cast("long")), True)
    before = len(os.listdir(at)) if os.path.isdir(at) else 0
    got = {r.id: round(r.betweenness * 99 * 98, 6) for r in centrality.betweenness(g, weighted=True, multiplicity=False).collect()}
    assert got == {i: i * (99 - i) for i in range(n)}
    assert len(os.listdir(at)) - before < 25


def plain_betweenness(n: int, arcs: list[tuple], weighted: bool) -> dict[int, float]:
    """Vertex by vertex; weighted: parallel arcs count once."""
    w, m = {}, {}
    for a, b, c in arcs:
        if a != b:
            w[a, b], m[a, b] = min(w.get((a, b), c), c) if weighted else 1, 1 if weighted else m.get((a, b), 0) + 1
    out, score = {}, dict.fromkeys(range(n), 0.0)
    for a, b in w:
        out.setdefault(a, []).append(b)
    for s in range(n):
        dist, seen, todo, ways, back = {s: 0}, [], [(0, s)], {s: 1}, {}
        while todo:
            d, a = heapq.heappop(todo)
            if a in seen:
                continue
            seen.append(a)
            for b in out.get(a, []):
                new = d + w[a, b]
                if new < dist.get(b, new + 1):
                    dist[b], ways[b], back[b] = new, 0, []
                    heapq.heappush(todo, (new, b))
                if new == dist[b]:
                    ways[b] += ways[a] * m[a, b]
                    back[b].append(a)
        beyond = dict.fromkeys(seen, 0.0)
        for b in reversed(seen[1:]):
            for a in back[b]:
                beyond[a] += ways[a] * m[a, b] / ways[b] * (1 + beyond[b])
            if b in score:
                score[b] += beyond[b]
    return {v: round(x / (n - 1) / (n - 2), 9) for v, x in score.items()}


def test_betweenness_over_chains(spark, monkeypatch):
    """Ways of vertices with one arc in and out are one arc: few arcs meet the arrays, and scores are those of a plain search. Ways
    round back into a chain, chains without a way in or out, a circle apart, and a vertex that is none."""
    rng, met = random.Random(5), []
    shares = brandes.shares
    monkeypatch.setattr(brandes, "shares", lambda arcs, *more: met.append(arcs.count()) or shares(arcs, *more))
    some = in_copies(rng, 4, 5, 14) + [(30, 31, 1), (31, 32, 2), (32, 0, 1), (3, 33, 1), (33, 34, 0), (34, 35, 1), (36, 37, 1), (37, 38, 1), (38, 36, 1), (40, 41, 2), (41, 42, 2)]
    some = [(a, b, c + 1) for a, b, c in some]
    g = graph(spark, 42, some, directed=True)
    g = PropertyGraph(g.vertices, g.edges.withColumn("weight", F.col("weight").cast("long")), True)
    for more in ({"weighted": True, "multiplicity": False}, {"batches": 3}):
        got = {r.id: round(r.betweenness, 9) for r in centrality.betweenness(g, **more).collect()}
        assert got == plain_betweenness(42, some, "weighted" in more) and sum(x > 0 for x in got.values()) > 20
    assert max(met) * 3 < len({(a, b) for a, b, _ in some if a != b}) * 2
