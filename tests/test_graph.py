"""Graph building, ranks, communities and what is read off the graph."""

import pytest

from codequarry.operators import graph
from codequarry.schemas import Params

E = "repo_id string, src string, dst string, rel string"


def files(spark, *paths):
    return spark.createDataFrame([("r", p, True) for p in paths], "repo_id string, path string, is_file boolean")


def symbols(spark, *rows):
    return spark.createDataFrame([("r", i, n, "function", i + 1, p) for i, (n, p) in enumerate(rows)], "repo_id string, seq long, name string, type string, line int, file_path string")


def test_small_graph_ranks(spark):
    nodes = graph.build_nodes(files(spark, "main.go", "utils.go"), symbols(spark, ("main", "main.go"), ("Helper", "utils.go")))
    calls, errors = graph.add_call_edges(spark.createDataFrame([("r", "main.go:main", "utils.go:Helper", ""), ("r", "x", "utils.go:Helper", "")], E), nodes)
    assert errors.count() == 1
    edges = graph.contains_edges(nodes).unionByName(calls)
    rank = {r.key: r.pagerank for r in graph.pagerank(nodes, edges).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6
    assert rank["utils.go:Helper"] > rank["main.go:main"] > rank["main.go"]
    dead = {r.message for r in graph.dead_code(nodes, calls).collect()}
    assert dead == {"Symbol 'main' has zero incoming call edges"}


def test_duplicate_keys_keep_the_first(spark):
    nodes = graph.build_nodes(files(spark, "a"), symbols(spark, ("x", "a"), ("x", "a")))
    assert sorted((r.key, r.line) for r in nodes.collect()) == [("a", 0), ("a:x", 1)]
    bait = graph.hallucination_bait(symbols(spark, ("x", "a"), ("x", "a"), ("x", "b"))).collect()
    assert [(r.file, r.line) for r in bait] == [("a", 2)]


def _pairs(spark, pairs):
    return spark.createDataFrame([("r", a, b, "co-change") for a, b in pairs], E)


def test_communities_three_triangles(spark):
    tri = [(f"{g}{i}", f"{g}{j}") for g in "ABC" for i, j in ((1, 2), (2, 3), (1, 3))] + [("A1", "B1"), ("B1", "C1")]
    nodes = spark.createDataFrame([("r", f"{g}{i}") for g in "ABC" for i in (1, 2, 3)], "repo_id string, key string")
    c = {r.key: r.community_id for r in graph.communities(nodes, _pairs(spark, tri), Params(rounds=10)).collect()}
    for g in "ABC":
        assert len({c[f"{g}{i}"] for i in (1, 2, 3)}) == 1
    assert len(set(c.values())) == 3


@pytest.mark.parametrize(("pairs", "n", "expected"), [([], 10, 10), ([(f"n{i}", f"n{j}") for i in range(5) for j in range(i)], 5, 1)])
def test_communities_extremes(spark, pairs, n, expected):
    nodes = spark.createDataFrame([("r", f"n{i}") for i in range(n)], "repo_id string, key string")
    edges = _pairs(spark, pairs) if pairs else spark.createDataFrame([], E)
    labels = graph.communities(nodes, edges)
    assert graph.community_count(labels).first().communities == expected


def test_threshold(spark):
    nodes = spark.createDataFrame([("r", "file", f"p{i}", v) for i, v in enumerate((0.1, 0.5, 0.9))], "repo_id string, node_type string, path string, pagerank double")
    assert graph.pagerank_threshold(nodes, 0.10).first().value == 0.9
    assert graph.pagerank_threshold(nodes, 0.50).first().value == 0.5


def test_phantom_coupling_boundaries(spark):
    rows = [("r", "a", True, 5, 0.49), ("r", "b", True, 5, 0.5), ("r", "c", True, 4, 0.1), ("r", "d", True, 9, 0.1), ("r", "e", True, 9, 0.1)]
    f = spark.createDataFrame(rows, "repo_id string, path string, is_file boolean, churn int, ownership double")
    nodes = graph.build_nodes(f)
    edges = spark.createDataFrame([("r", "d", "e", "import"), ("r", "a", "a:f", "contains")], E)
    out = graph.phantom_coupling(f, nodes, edges).collect()
    assert [(r.file, r.message) for r in out] == [("a", "Phantom coupling detected in a: Churn=5, Ownership=49%")]


def test_walks(spark):
    e = _pairs(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d2"), ("d2", "d")])
    assert {r.key: r.depth for r in graph.ego_graph(e, "b", 1).collect()} == {"a": 1, "b": 0, "c": 1}
    p = graph.shortest_path(e, "a", "d").first()
    assert p.path == ["a", "d2", "d"] and p.distance == 2
    assert graph.shortest_path(e, "d", "a").count() == 0
    changed = spark.createDataFrame([("r", "d")], "repo_id string, key string")
    assert {r.key: r.depth for r in graph.blast_radius(changed, e, 2).collect()} == {"d": 0, "c": 1, "d2": 1, "b": 2, "a": 2}


def test_neighbors_and_degrees(spark):
    e = _pairs(spark, [("a", "b"), ("b", "a"), ("c", "a")])
    got = {(r.other, r.direction) for r in graph.neighbors(e, "a").collect()}
    assert got == {("b", "import"), ("c", "importer")}
    d = {r.key: (r.in_degree, r.out_degree) for r in graph.degrees(e).collect()}
    assert d["a"] == (1, 1) and d["c"] == (0, 1)


def test_edge_classes_and_cap(spark):
    links = spark.createDataFrame([("r", "a", t, n, c) for t, n, c in (("b", ["x"], 1.0), ("c", ["x"], 1.0), ("d", [], 1.0), ("e", ["x"], 0.2), ("z", ["x"], None))], "repo_id string, source string, target string, imported_names array<string>, confidence double")
    labels = spark.createDataFrame([("r", k, c) for k, c in (("a", 1), ("b", 1), ("c", 2), ("d", 1), ("e", 1))], "repo_id string, key string, community_id long")
    k = graph.classify_edges(links, labels)
    assert {r.target: r.edge_class for r in k.collect()} == {"b": "internal", "c": "crossCommunity", "d": "dynamic", "e": "lowConfidence", "z": "import"}
    assert {r.target for r in graph.cap_edges_per_source(k, 2).collect()} == {"b", "z"}


def test_flows(spark):
    calls = spark.createDataFrame([("r", a, b, "calls") for a, b in (("m", "x"), ("m", "y"), ("y", "z"), ("z", "m2"))], E)
    nodes = spark.createDataFrame([("r", k, p, 0) for k, p in (("m", 0.1), ("x", 0.2), ("y", 0.3), ("z", 0.1), ("m2", 0.1))], "repo_id string, key string, pagerank double, community_id long")
    assert graph.execution_flows(nodes, calls, 5, 5).first().trace == ["m", "y", "z", "m2"]


def test_betweenness_of_a_path(spark):
    e = _pairs(spark, [("a", "b"), ("b", "c")])
    nodes = spark.createDataFrame([("r", k) for k in "abc"], "repo_id string, key string")
    assert {r.key: r.betweenness for r in graph.betweenness(nodes, e, 3).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
