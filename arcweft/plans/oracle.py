"""SQL for the registered queries, over the same tables."""

from __future__ import annotations

U = """u AS (SELECT event_id AS edge_id, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_type AS edge_type,
  CAST(round(value * 100) AS BIGINT) AS weight FROM events),
e AS (SELECT * FROM u WHERE dst IS NOT NULL), v AS (SELECT DISTINCT user_id AS id FROM events)"""
H = """hv AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS data, 'kind=region' AS attrs FROM region
  UNION ALL SELECT 100 + n_nationkey, n_name, 'kind=nation' FROM nation
  UNION ALL SELECT 1099511627776 + s_suppkey, s_name, 'kind=supplier' FROM supplier
  UNION ALL SELECT 3298534883328 + c_custkey, c_name, 'kind=customer,segment=' || c_mktsegment FROM customer),
he AS (SELECT CAST(100 + n_nationkey AS BIGINT) AS edge_id, CAST(100 + n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst, CAST(1 AS BIGINT) AS weight, 'in_region' AS edge_type FROM nation
  UNION ALL SELECT 1099511627776 + s_suppkey, 1099511627776 + s_suppkey, 100 + s_nationkey, 1, 'supplier_of' FROM supplier
  UNION ALL SELECT 3298534883328 + c_custkey, 3298534883328 + c_custkey, 100 + c_nationkey, 1, 'customer_of' FROM customer)"""
T = """te AS (SELECT (src * 100 + dst) * 256 + ascii(edge_type) AS edge_id, * FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, l_returnflag AS edge_type, CAST(sum(l_quantity) AS BIGINT) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)),
tv AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS data FROM nation)"""
W = f"""{H}, {T}, w0 AS (SELECT edge_id, src, dst, weight, edge_type FROM he UNION ALL SELECT edge_id + 4398046511104, src + 100, dst + 100, weight, edge_type FROM te),
we AS (SELECT edge_id, least(src, dst) AS src, greatest(src, dst) AS dst, weight, edge_type FROM w0)"""
S = """sv AS (SELECT 1099511627776 + s_suppkey AS id FROM supplier UNION ALL SELECT 2199023255552 + p_partkey FROM part),
se AS (SELECT 1099511627776 + l_suppkey AS src, 2199023255552 + l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL)"""


def only(types: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in types) + ")"


def both(edges: str, where: str = "TRUE") -> str:
    return f"SELECT src, dst FROM {edges} WHERE {where} UNION SELECT dst, src FROM {edges} WHERE {where}"


def weak(v: str, arcs: str) -> str:
    """CTEs arcs and cc(id, comp)."""
    return f"""arcs AS ({arcs}), cc(id, comp) USING KEY (id) AS (SELECT id, id FROM {v} UNION (SELECT a.dst, min(c.comp) FROM cc c JOIN arcs a ON a.src = c.id
  JOIN recurring.cc r ON r.id = a.dst GROUP BY a.dst HAVING min(c.comp) < min(r.comp)))"""


def reach(arcs: str, v: str = "v") -> str:
    return f"arcs AS ({arcs}), r(s, id) AS (SELECT id, id FROM {v} UNION SELECT r.s, a.dst FROM r JOIN arcs a ON a.src = r.id)"


def sssp(where: str = "TRUE") -> str:
    return f"""{U}, a AS (SELECT src, dst, min(weight) AS w FROM e WHERE {where} GROUP BY ALL), d(id, dist) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION (SELECT a.dst, min(d.dist + a.w) FROM d JOIN a ON a.src = d.id LEFT JOIN recurring.d r ON r.id = a.dst
  GROUP BY a.dst HAVING min(d.dist + a.w) < coalesce(min(r.dist), 9223372036854775807))),
p AS (SELECT x.id, x.dist, min(y.id) AS pred FROM d x LEFT JOIN (SELECT a.dst, d.id, d.dist + a.w AS c FROM d JOIN a ON a.src = d.id WHERE a.src <> a.dst) y
  ON y.dst = x.id AND y.c = x.dist AND x.id <> 0 GROUP BY x.id, x.dist)"""


def sssp_path(where: str, target: int) -> str:
    return f"""WITH RECURSIVE {sssp(where)}, w(n, id) AS (SELECT 0, CAST({target} AS BIGINT) FROM p WHERE id = {target} UNION ALL SELECT w.n + 1, p.pred FROM w JOIN p ON p.id = w.id WHERE p.pred IS NOT NULL)
SELECT CAST((SELECT max(n) FROM w) - n AS BIGINT) AS step, id FROM w"""


def all_pairs(where: str, weight: str, v: str = "v") -> str:
    """CTEs a(src, dst, w, m) and d(s, id, dist)."""
    return f"""{U}, a AS (SELECT src, dst, min({weight}) AS w, count(*) AS m FROM e WHERE {where} AND src <> dst GROUP BY ALL),
d(s, id, dist) USING KEY (s, id) AS (SELECT id, id, CAST(0 AS BIGINT) FROM {v} UNION (SELECT d.s, a.dst, min(d.dist + a.w) FROM d JOIN a ON a.src = d.id
  LEFT JOIN recurring.d r ON r.s = d.s AND r.id = a.dst GROUP BY d.s, a.dst HAVING min(d.dist + a.w) < coalesce(min(r.dist), 9223372036854775807)))"""


def closeness(where: str, weight: str, digits: int) -> str:
    return f"""WITH RECURSIVE {all_pairs(where, weight)} SELECT v.id, round(coalesce(count(d.id) / CAST(sum(d.dist) AS DOUBLE), 0.0), {digits}) AS closeness
FROM v LEFT JOIN d ON d.s = v.id AND d.id <> v.id GROUP BY v.id"""


def betweenness(where: str, weight: str, m: str, n: str) -> str:
    return f"""WITH RECURSIVE {all_pairs(where, weight)}, dag AS (SELECT x.s, a.src, a.dst, CAST({m} AS DOUBLE) AS m FROM d x JOIN a ON a.src = x.id JOIN d y ON y.s = x.s AND y.id = a.dst AND x.dist + a.w = y.dist),
f(h, s, id, x) AS (SELECT 0, id, id, CAST(1 AS DOUBLE) FROM v UNION ALL SELECT f.h + 1, f.s, g.dst, CAST(sum(f.x * g.m) AS DOUBLE) FROM f JOIN dag g ON g.s = f.s AND g.src = f.id GROUP BY f.h, f.s, g.dst),
sg AS (SELECT s, id, sum(x) AS sg FROM f GROUP BY s, id), q AS (SELECT d.s, d.id, d.dist, sg.sg FROM d JOIN sg USING (s, id)),
b AS (SELECT x.id, sum(x.sg * y.sg / z.sg) AS bc FROM q x JOIN q y ON y.s = x.id JOIN q z ON z.s = x.s AND z.id = y.id AND z.dist = x.dist + y.dist
  WHERE x.s <> x.id AND y.id <> x.id AND x.s <> y.id GROUP BY x.id), n AS ({n})
SELECT v.id, round(coalesce(b.bc, 0.0) / ((n.n - 1) * (n.n - 2)), 9) AS betweenness FROM v LEFT JOIN b USING (id), n"""


def bfs_path(target: int, where: str, grouped: bool) -> str:
    """Of the shortest paths the one whose list of edge keys is smallest."""
    key = "(SELECT src, dst, min(edge_id) AS key FROM e GROUP BY ALL)" if grouped else f"(SELECT src, dst, min(edge_id) AS key FROM e WHERE {where} GROUP BY ALL)"
    return f"""WITH RECURSIVE {U}, k AS {key}, a AS (SELECT k.* FROM k SEMI JOIN (SELECT src, dst FROM e WHERE {where}) x USING (src, dst) WHERE src <> dst),
b(id, lv, ord, path) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), 0, CAST([] AS BIGINT[]), [CAST(0 AS BIGINT)] UNION
  (SELECT a.dst, any_value(b.lv) + 1, min(list_append(b.ord, a.key)), arg_min(list_append(b.path, a.dst), list_append(b.ord, a.key)) FROM b JOIN a ON a.src = b.id
   LEFT JOIN recurring.b r ON r.id = a.dst WHERE r.id IS NULL GROUP BY a.dst)),
p AS (SELECT path FROM b WHERE id = {target}) SELECT CAST(unnest(range(0, len(path))) AS BIGINT) AS step, unnest(path) AS id FROM p"""


def spectral(kind: str, where: str, rounds: int) -> str:
    if kind == "pagerank":
        return f"""WITH RECURSIVE {U}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), o AS (SELECT src, sum(CAST(weight AS DOUBLE)) AS t FROM e WHERE {where} GROUP BY src),
tr AS (SELECT src, dst, sum(p) AS p FROM (SELECT e.src, e.dst, sum(CAST(weight AS DOUBLE)) / any_value(o.t) AS p FROM e JOIN o USING (src) WHERE {where} AND o.t <> 0 GROUP BY e.src, e.dst UNION ALL SELECT id, id, CAST(0 AS DOUBLE) FROM v) GROUP BY src, dst),
x(it, id, r) AS (SELECT 0, id, CAST(1.0 / n AS DOUBLE) FROM v, n UNION ALL SELECT x.it + 1, tr.dst, CAST(CAST(0.15 AS DOUBLE) / any_value(n.n) + CAST(0.85 AS DOUBLE) * sum(x.r * tr.p) AS DOUBLE)
  FROM x JOIN tr ON tr.src = x.id, n WHERE x.it < {rounds} GROUP BY x.it, tr.dst) SELECT id, round(r, 9) AS pagerank FROM x WHERE it = {rounds}"""
    w = f"""w AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, CAST(weight AS DOUBLE) AS w FROM e WHERE {where} UNION ALL SELECT id, id, CAST(0 AS DOUBLE) FROM v) GROUP BY src, dst)"""
    if kind == "katz":
        return f"""WITH RECURSIVE {U}, {w}, x(it, id, r) AS (SELECT 0, id, CAST(1 AS DOUBLE) FROM v UNION ALL SELECT x.it + 1, w.src, CAST(CAST(1 AS DOUBLE) + CAST(1e-6 AS DOUBLE) * sum(x.r * w.w) AS DOUBLE)
  FROM x JOIN w ON w.dst = x.id WHERE x.it < {rounds} GROUP BY x.it, w.src) SELECT id, round(r, 9) AS katz FROM x WHERE it = {rounds}"""
    return f"""WITH RECURSIVE {U}, {w}, x(it, id, r) AS (SELECT 0, id, CAST(1 AS DOUBLE) FROM v UNION ALL SELECT it, id, CAST(y / sqrt(sum(y * y) OVER ()) AS DOUBLE) FROM (
  SELECT x.it + 1 AS it, w.src AS id, CAST(1 AS DOUBLE) + sum(x.r * w.w) AS y FROM x JOIN w ON w.dst = x.id WHERE x.it < {rounds} GROUP BY x.it, w.src))
SELECT id, round(r / sum(r) OVER (), 9) AS eigenvector FROM x WHERE it = {rounds}"""


def dominating(arcs: str, order: str, neighbour: bool) -> str:
    """Greedy over k(rk, id, l): l the neighbours."""
    take = "NOT list_contains(g.cov, k.id)" + (" OR len(list_filter(k.l, lambda y: NOT list_contains(g.cov, y))) > 0" if neighbour else "")
    return f"""WITH RECURSIVE {U}, arcs AS ({arcs}), o AS ({order}), k AS (SELECT row_number() OVER (ORDER BY o.d DESC, o.id) AS rk, o.id, coalesce((SELECT list(DISTINCT dst) FROM arcs WHERE src = o.id), []) AS l FROM o),
g(rk, sel, cov) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL SELECT k.rk, CASE WHEN {take} THEN list_append(g.sel, k.id) ELSE g.sel END,
  CASE WHEN {take} THEN list_distinct(list_concat(list_append(g.cov, k.id), k.l)) ELSE g.cov END FROM g JOIN k ON k.rk = g.rk + 1)
SELECT unnest(sel) AS id FROM g WHERE rk = (SELECT max(rk) FROM k)"""


def bridge(where: str, select: str) -> str:
    return f"""WITH RECURSIVE {W}, p AS (SELECT DISTINCT src, dst FROM we WHERE {where} AND src <> dst), arcs AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p),
r(es, ed, id) AS (SELECT src, dst, src FROM p UNION SELECT r.es, r.ed, a.dst FROM r JOIN arcs a ON a.src = r.id AND NOT (a.src = r.es AND a.dst = r.ed) AND NOT (a.src = r.ed AND a.dst = r.es)),
b AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.es = p.src AND r.ed = p.dst AND r.id = p.dst)) {select}"""


def counts(v: str, e: str) -> str:
    return f"""SELECT * FROM (SELECT count(*) AS n_vertices, CAST(sum(id) AS BIGINT) AS sum_id FROM {v}) a, (SELECT count(*) AS n_edges, CAST(sum(src) AS BIGINT) AS sum_src,
  CAST(sum(dst) AS BIGINT) AS sum_dst, CAST(sum(weight) AS BIGINT) AS sum_weight FROM {e}) b"""


CLICK = only(["click", "purchase"])
TYPED = f"edge_type IN {CLICK}"
BUY = "edge_type = 'purchase'"
DOWN = "edge_type IN ('in_region', 'supplier_of')"


def sql() -> dict[str, str]:
    scan_u = "SELECT edge_id, {} AS src, {} AS dst, weight, edge_type FROM e"
    ue = "(SELECT edge_id, least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM e)"
    return {
        "scan_nodes": f"WITH {H} SELECT id, data FROM hv",
        "scan_edges": f"WITH {U} " + scan_u.format("src", "dst"),
        "csv_roundtrip_g": f"WITH {H} SELECT id, CAST(id AS VARCHAR) AS data, attrs, n_in, payload FROM hv LEFT JOIN (SELECT dst, count(*) AS n_in, min(edge_type) AS payload FROM he GROUP BY dst) x ON x.dst = hv.id",
        "csv_roundtrip_h": f"WITH {H} SELECT edge_id, src, dst, weight, edge_type, 'kind=' || edge_type || ',length=' || weight AS attrs FROM he",
        "networkx_load": f"WITH {H} SELECT id, data, CASE WHEN attrs LIKE '%segment=%' THEN attrs ELSE attrs || ',segment=unknown' END AS attrs FROM hv",
        "from_matrix": f"WITH {T} SELECT src, dst, arg_max(weight, edge_id) AS weight FROM te GROUP BY src, dst HAVING arg_max(weight, edge_id) <> 0",
        "to_matrix": f"""WITH {T}, c AS (SELECT src, dst, arg_max(weight, edge_id) AS w FROM te GROUP BY src, dst)
SELECT a.id AS i, string_agg(CAST(coalesce(c.w, 0) AS VARCHAR), ',' ORDER BY b.id) AS row FROM tv a CROSS JOIN tv b LEFT JOIN c ON c.src = a.id AND c.dst = b.id GROUP BY a.id""",
        "add_nodes": f"WITH {H} SELECT id, data FROM hv UNION ALL SELECT 50, 'x' UNION ALL SELECT 51, 'y'",
        "add_edges": f"WITH {T}, x AS (SELECT src, dst, weight FROM te UNION ALL SELECT 0, 1, 5 UNION ALL SELECT 3, 3, 7) " + counts("tv", "x"),
        "add_nodes_assigned": f"WITH {H} SELECT id, data FROM hv UNION ALL SELECT (SELECT 3298534883328 + max(c_custkey) FROM customer) + row_number() OVER (ORDER BY p_name) AS id, p_name AS data FROM part",
        "add_edges_assigned": f"""WITH {T} SELECT edge_id, src, dst, weight, edge_type FROM te
UNION ALL SELECT (SELECT max(edge_id) FROM te) + row_number() OVER (ORDER BY n_nationkey, n_regionkey), n_nationkey, n_regionkey, 1, '' FROM nation""",
        "remove_nodes": f"WITH {W}, x AS (SELECT * FROM we WHERE src NOT IN (100, 104) AND dst NOT IN (100, 104)), y AS (SELECT * FROM hv WHERE id NOT IN (100, 104)) " + counts("y", "x"),
        "remove_edge_pair": f"WITH {W}, x AS (SELECT * FROM we WHERE NOT (src = 100 AND dst = 101)) " + counts("hv", "x"),
        "remove_edge_id": f"WITH {H}, x AS (SELECT * FROM he WHERE edge_id <> 101) " + counts("hv", "x"),
        "validate": f"WITH {W} SELECT NOT EXISTS (SELECT 1 FROM we WHERE src NOT IN (SELECT id FROM hv) OR dst NOT IN (SELECT id FROM hv)) AND (SELECT count(*) = count(DISTINCT id) FROM hv) AND (SELECT count(*) = count(DISTINCT edge_id) FROM we) AS result",
        "set_node_attr": f"WITH {H} SELECT id, CASE WHEN id = 100 THEN 'kind=capital' ELSE attrs END AS attrs FROM hv",
        "set_edge_attr": f"WITH {H} SELECT edge_id, 'kind=' || edge_type || CASE WHEN dst = 3 THEN ',lane=north' ELSE '' END || ',length=' || weight AS attrs FROM he",
        "get_node_attr": f"WITH {H} SELECT id, CASE WHEN attrs LIKE '%segment=%' THEN split_part(attrs, 'segment=', 2) END AS segment FROM hv",
        "get_edge_attr": "SELECT 'supplier_of' AS kind FROM supplier WHERE s_suppkey = 0",
        "edge_attrs": "SELECT 'kind=supplier_of,length=1' AS attrs FROM supplier WHERE s_suppkey = 0",
        "neighbors": f"WITH {U} SELECT edge_id, dst AS neighbor, weight FROM e WHERE src = 3",
        "neighbors_grouped": f"WITH {U} SELECT src, dst, string_agg(edge_id || ':' || weight, ',' ORDER BY edge_id) AS edges FROM e GROUP BY src, dst",
        "edges_between": f"WITH {U} SELECT edge_id, least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM e WHERE least(src, dst) = 3 AND greatest(src, dst) = 5",
        "edges_between_pair": f"WITH {T} SELECT edge_id, least(src, dst) AS src, greatest(src, dst) AS dst, weight, edge_type FROM te WHERE least(src, dst) = 3 AND greatest(src, dst) = 7",
        "lookup": f"WITH {H} SELECT id, data FROM hv WHERE id = 103",
        "has_node": f"WITH {U} SELECT count(*) > 0 AS result FROM v WHERE id = 7",
        "predecessors": f"WITH {U} SELECT edge_id, src AS predecessor, weight FROM e WHERE dst = 3",
        "predecessors_by_types": f"WITH {U} SELECT edge_id, src AS predecessor, weight FROM e WHERE dst = 3 AND {TYPED}",
        "attr_index": f"""WITH {H}, x AS (SELECT id, unnest(string_split(attrs, ',')) AS kv FROM hv)
SELECT 'node' AS kind, split_part(kv, '=', 1) AS key, split_part(kv, '=', 2) AS value, id // 10000 AS chunk, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM x GROUP BY ALL""",
        "density": f"WITH {U} SELECT round((SELECT count(*) FROM e) / CAST((SELECT count(*) * (count(*) - 1) FROM v) AS DOUBLE), 9) AS density",
        "metrics": f"WITH {U} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges, FALSE AS directed, round(2 * (SELECT count(*) FROM e) / CAST((SELECT count(*) * (count(*) - 1) FROM v) AS DOUBLE), 9) AS density",
        "convert_default": f"WITH {H} SELECT id, '' AS data, attrs FROM hv",
        "to_string_g": f"WITH {H} SELECT id, CAST(id AS VARCHAR) AS data FROM hv",
        "to_string_h": f"WITH {U} " + scan_u.format("src", "dst"),
        "transpose": f"WITH {U} " + scan_u.format("dst", "src"),
        "transpose_by_types": f"WITH {U} " + scan_u.format("dst", "src") + f" WHERE {TYPED}",
        "has_path": f"WITH RECURSIVE {H}, r(id) AS (SELECT CAST(1099511627776 AS BIGINT) UNION SELECT he.dst FROM r JOIN he ON he.src = r.id) SELECT count(*) > 0 AS result FROM r WHERE id = 2",
        "has_path_by_types": f"WITH RECURSIVE {U}, r(id) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.id WHERE {BUY}) SELECT count(*) > 0 AS result FROM r WHERE id = 9",
        "bfs_path": bfs_path(9, "TRUE", False),
        "bfs_path_h": bfs_path(11, "TRUE", True),
        "bfs_path_by_types": bfs_path(12, "edge_type = 'error'", True),
        "has_cycle_dir": f"WITH RECURSIVE {H}, r(s, id) AS (SELECT src, dst FROM he UNION SELECT r.s, he.dst FROM r JOIN he ON he.src = r.id) SELECT count(*) > 0 AS result FROM r WHERE s = id",
        "has_cycle_undir": f"WITH RECURSIVE {W}, {weak('hv', both('we'))} SELECT (SELECT count(*) FROM we WHERE src = dst) > 0 OR (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM we WHERE src <> dst)) > (SELECT count(*) FROM hv) - (SELECT count(DISTINCT comp) FROM cc) AS result",
        "has_cycle_by_types": f"WITH RECURSIVE {U}, r(s, id) AS (SELECT src, dst FROM e WHERE edge_type = 'signup' UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.id AND edge_type = 'signup') SELECT count(*) > 0 AS result FROM r WHERE s = id",
        "sssp": f"WITH RECURSIVE {sssp()} SELECT id, dist FROM d",
        "sssp_pred": f"WITH RECURSIVE {sssp()} SELECT id, dist, pred FROM p",
        "sssp_by_types": f"WITH RECURSIVE {sssp(BUY)} SELECT id, dist FROM d",
        "sssp_path": sssp_path("TRUE", 9),
        "sssp_path_by_types": sssp_path(BUY, 9),
        "wcc": f"WITH RECURSIVE {S}, {weak('sv', both('se'))} SELECT id, comp AS component FROM cc",
        "scc": f"WITH RECURSIVE {U}, {reach(chr(83) + 'ELECT DISTINCT src, dst FROM e WHERE edge_type = ' + repr('signup'))} SELECT x.s AS id, min(x.id) AS component FROM r x JOIN r y ON x.s = y.id AND x.id = y.s GROUP BY x.s",
        "cc": f"WITH {H} SELECT id, id AS component FROM hv",
        "is_wcc": f"WITH RECURSIVE {H}, {weak('hv', both('he'))} SELECT count(DISTINCT comp) <= 1 AS result FROM cc",
        "is_scc": f"WITH RECURSIVE {U}, {reach('SELECT DISTINCT src, dst FROM e')} SELECT count(*) = (SELECT count(*) * count(*) FROM v) AS result FROM r",
        "is_connected": f"WITH RECURSIVE {W}, {weak('hv', both('we'))} SELECT count(DISTINCT comp) <= 1 AS result FROM cc",
        "wcc_by_types": f"WITH RECURSIVE {W}, {weak('hv', both('we', 'edge_type IN ' + only(['customer_of', 'A'])))} SELECT id, comp AS component FROM cc",
        "scc_by_types": f"WITH RECURSIVE {U}, {reach('SELECT DISTINCT src, dst FROM e WHERE edge_type = ' + repr('error'))} SELECT x.s AS id, min(x.id) AS component FROM r x JOIN r y ON x.s = y.id AND x.id = y.s GROUP BY x.s",
        "cc_by_types": f"WITH RECURSIVE {W}, {weak('hv', both('we', 'edge_type IN ' + only(['supplier_of'])))} SELECT id, comp AS component FROM cc",
        "is_connected_by_types": f"WITH RECURSIVE {W}, {weak('hv', both('we', DOWN))} SELECT count(DISTINCT comp) <= 1 AS result FROM cc",
        "is_wcc_by_types": f"WITH RECURSIVE {W}, {weak('hv', both('we', 'edge_type IN ' + only(['supplier_of'])))} SELECT count(DISTINCT comp) <= 1 AS result FROM cc",
        "is_scc_by_types": f"WITH RECURSIVE {U}, {reach('SELECT DISTINCT src, dst FROM e WHERE edge_type IN ' + only(['click', 'purchase', 'view']))} SELECT count(*) = (SELECT count(*) * count(*) FROM v) AS result FROM r",
        "bridges": bridge("TRUE", "SELECT src, dst FROM b"),
        "bridges_h": bridge("TRUE", "SELECT b.src, b.dst, min(we.edge_type) AS edge_type FROM b JOIN we USING (src, dst) GROUP BY b.src, b.dst HAVING count(*) = 1"),
        "bridges_by_types": bridge(DOWN, f"SELECT b.src, b.dst, we.edge_type FROM b JOIN we USING (src, dst) WHERE {DOWN}"),
        "degree": f"WITH {U}, a AS (SELECT src FROM {ue} UNION ALL SELECT dst FROM {ue}) SELECT v.id, count(a.src) AS degree FROM v LEFT JOIN a ON a.src = v.id GROUP BY v.id",
        "degree_by_types": f"WITH {U} SELECT v.id, count(x.src) AS degree FROM v LEFT JOIN (SELECT src FROM e WHERE {TYPED}) x ON x.src = v.id GROUP BY v.id",
        "betweenness": betweenness("TRUE", "CAST(1 AS BIGINT)", "a.m", "SELECT count(*) AS n FROM v"),
        "betweenness_h": betweenness("TRUE", "weight", "1", "SELECT count(*) AS n FROM v"),
        "betweenness_by_types": betweenness(BUY, "weight", "1", f"SELECT count(*) AS n FROM (SELECT src FROM e WHERE {BUY} UNION SELECT dst FROM e WHERE {BUY})"),
        "closeness": closeness("TRUE", "CAST(1 AS BIGINT)", 9),
        "closeness_h": closeness("TRUE", "weight", 12),
        "closeness_by_types": closeness(BUY, "weight", 12),
        "eigenvector": spectral("eigenvector", "TRUE", 10),
        "eigenvector_by_types": spectral("eigenvector", TYPED, 10),
        "eigenvector_tolerance": spectral("eigenvector", "TRUE", 60),
        "pagerank_tolerance": spectral("pagerank", "TRUE", 80),
        "katz_tolerance": spectral("katz", "TRUE", 40).replace("1e-6", "1e-8"),
        "pagerank": spectral("pagerank", "TRUE", 20),
        "pagerank_by_types": spectral("pagerank", TYPED, 20),
        "katz": spectral("katz", "TRUE", 10),
        "katz_by_types": spectral("katz", TYPED, 10),
        "dominating_set": dominating("SELECT src, dst FROM e", "SELECT v.id, (SELECT count(*) FROM e WHERE e.src = v.id) AS d FROM v", False),
        "dominating_set_h": dominating(both("e"), "SELECT src AS id, count(DISTINCT dst) AS d FROM arcs GROUP BY src", True),
        "dominating_set_by_types": dominating(both("e", "edge_type = 'signup'"), "SELECT src AS id, count(DISTINCT dst) AS d FROM arcs GROUP BY src", True),
        "communities_of_stars": f"WITH {H}, x AS (SELECT src, dst FROM he WHERE edge_type = 'supplier_of') SELECT dst AS community, src AS id FROM x UNION SELECT dst, dst FROM x",
        "modularity": f"""WITH {T}, a AS (SELECT src, dst, CAST(weight AS DOUBLE) AS w FROM te UNION ALL SELECT dst, src, weight FROM te), n AS (SELECT n_nationkey AS id, n_regionkey AS c FROM nation),
x AS (SELECT p.c AS c, sum(w) AS t, sum(CASE WHEN p.c = q.c THEN w ELSE 0 END) AS i FROM a JOIN n p ON p.id = a.src JOIN n q ON q.id = a.dst GROUP BY p.c)
SELECT round(sum(i) / sum(t) - sum(t * t) / (sum(t) * sum(t)), 9) AS modularity FROM x""",
    }
