"""The example graph against its known values."""

import pytest
from graphs import viking

from arcweft.operators import build, centrality, components, dominating, search

# Degrees, distances from 0, dominating sets and bridges, over all edges and by type.
DEGREE = [6, 6, 3, 3, 6, 4, 2, 3, 3, 3, 3, 2, 2]
FROM_0 = {
    None: {0: 0, 1: 300, 2: 420, 3: 600, 4: 450, 5: 150, 6: 670, 7: 650, 8: 950, 9: 200, 10: 850, 11: 900, 12: 750},
    "river": {0: 0, 1: 300, 4: 450, 5: 150, 8: 950, 10: 870, 11: 1070},
    "trade": {0: 0, 1: 320, 5: 160, 7: 670, 8: 1000, 9: 200},
}
DOMINATING = {None: [0, 1, 2, 4, 10], "river": [0, 1, 4, 10], "sea": [2, 3, 4, 12], "trade": [0, 1, 3]}
BRIDGES = {"river": [(0, 1), (0, 5), (1, 8), (4, 5), (4, 10), (10, 11)], "trade": [(0, 1), (3, 4)]}
RANK = [0.097148, 0.134713, 0.055887, 0.093717, 0.149716, 0.053165, 0.045759, 0.080646, 0.099844, 0.043401, 0.071411, 0.03466, 0.039933]


@pytest.fixture(scope="module")
def g(spark):
    return viking(spark)


def test_degree_and_density(g):
    assert [r.degree for r in centrality.degree(g).orderBy("id").collect()] == DEGREE
    assert round(build.metrics(g).first().density, 4) == 0.2949


@pytest.mark.parametrize("kind", list(FROM_0))
def test_distances(g, kind):
    assert {r.id: r.dist for r in search.dijkstra(g, 0, kind and [kind]).collect()} == FROM_0[kind]


def test_paths(g):
    assert search.bfs_path(g, 0, 6) == [0, 1, 2, 6]
    assert search.dijkstra_path(g, 0, 6) == [0, 9, 2, 6]
    assert search.dijkstra_path(g, 4, 4) == [4]
    assert search.dijkstra_path(g, 0, 12, ["trade"]) is None


@pytest.mark.parametrize("kind", list(DOMINATING))
def test_dominating(g, kind):
    assert sorted(r.id for r in dominating.dominating_set_typed(g, kind and [kind]).collect()) == DOMINATING[kind]


@pytest.mark.parametrize("kind", list(BRIDGES))
def test_bridges_by_type(g, kind):
    assert sorted((r.src, r.dst) for r in components.bridges_by_types(g, [kind]).collect()) == BRIDGES[kind]


def test_no_bridges_and_components(g):
    assert components.bridges_single(g).isEmpty()
    got = {}
    for r in components.weak(g.by_types(["sea"])).collect():
        got.setdefault(r.component, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == [[0, 3, 4, 10, 11, 12], [1, 2, 6, 9], [5], [7], [8]]


def test_pagerank(g):
    assert [round(r.pagerank, 6) for r in centrality.pagerank(g, 0.85, 20, 0).orderBy("id").collect()] == RANK
