"""Queries that read the graph: classes of edges, modules, paths, flows, reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, history
from ..schemas import Params
from . import projections as P
from .queries import CALLS_SQL, MODULE_SQL, QUERIES, _co_change_graph, _labelled, _module_links, _supply_nodes, _symbol_graph, query, rounded

# ---- communities, with their rounds written out ---------------------------------------------------


def _communities_sql(rounds: int) -> str:
    """Half-rounds of local moving as chained tables."""
    parts = [
        "w AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT a AS src, b AS dst FROM cochange UNION ALL SELECT b, a FROM cochange) GROUP BY ALL)",
        "k AS MATERIALIZED (SELECT src AS key, sum(w) AS k FROM w GROUP BY ALL)",
        "m AS MATERIALIZED (SELECT sum(k) AS m2 FROM k)",
        "s0 AS MATERIALIZED (SELECT key, k, key AS c FROM k)",
    ]
    for i in range(2 * rounds):
        parts += [
            f"z{i} AS MATERIALIZED (SELECT c, sum(k) AS s FROM s{i} GROUP BY ALL)",
            f"t{i} AS MATERIALIZED (SELECT * FROM s{i} WHERE instr('0123456789abcdef', md5(key || ':{i // 2}')[1]) % 2 = {i % 2} AND k > 0)",
            f"o{i} AS MATERIALIZED (SELECT key, c_to, sum(w) AS w FROM (SELECT w.src AS key, l.c AS c_to, w.w FROM w JOIN s{i} l ON l.key = w.dst UNION ALL SELECT key, c, 0 FROM t{i}) GROUP BY ALL)",
            f"g{i} AS MATERIALIZED (SELECT o.key, c_to, t.c, o.w - t.k * (z.s - CASE WHEN c_to = t.c THEN t.k ELSE 0 END) / m2 AS gain FROM o{i} o JOIN t{i} t ON t.key = o.key JOIN z{i} z ON z.c = c_to CROSS JOIN m)",
            f"b{i} AS MATERIALIZED (SELECT key, arg_min(c_to, (-round(gain, 9), c_to)) AS c_to, max(gain) AS gain, max(gain) FILTER (c_to = c) AS own FROM g{i} GROUP BY ALL)",
            f"s{i + 1} AS MATERIALIZED (SELECT s.key, s.k, coalesce(b.c_to, s.c) AS c FROM s{i} s LEFT JOIN (SELECT * FROM b{i} WHERE gain > own + 1e-9) b ON b.key = s.key)",
        ]
    return f"SELECT * FROM (WITH {', '.join(parts)} SELECT 'shop' AS repo_id, key, dense_rank() OVER (ORDER BY c) - 1 AS community_id FROM s{2 * rounds})"


query("cochange", _communities_sql(5))(QUERIES["communities"])


@query("cochange", "SELECT repo_id, count(DISTINCT community_id) AS communities FROM (" + _communities_sql(2) + ") GROUP BY ALL")
def community_count(spark, d):
    return graph.community_count(graph.communities(*_co_change_graph(spark, d), Params(as_of=P.AS_OF, rounds=2)))


# ---- links between parts as imports -----------------------------------------------------------------


def links(spark, d: str) -> DataFrame:
    """Supplier and part of each order line as an import: names by line number, confidence by discount."""
    li = P.table(spark, d, "lineitem")
    names = F.when(F.col("l_linenumber") == 7, F.lit(None)).when(F.col("l_linenumber") == 6, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("n"), F.col("l_linenumber").cast("string")), F.lit("n1")))
    confidence = F.when(F.col("l_tax") > 0, F.col("l_discount") * 10)
    return li.select(F.lit("shop").alias("repo_id"), F.concat(F.lit("sup_"), F.col("l_suppkey").cast("string")).alias("source"), P.part_path("l_partkey").alias("target"), names.alias("imported_names"), confidence.alias("confidence"))


def labels(spark, d: str) -> DataFrame:
    """Communities of suppliers (key modulo 5) and of parts (size modulo 5, large ones have none)."""
    s, p = P.table(spark, d, "supplier"), P.table(spark, d, "part")
    a = s.select(F.lit("shop").alias("repo_id"), F.concat(F.lit("sup_"), F.col("s_suppkey").cast("string")).alias("key"), F.pmod("s_suppkey", F.lit(5)).alias("community_id"))
    return a.unionByName(p.where("p_size <= 40").select(F.lit("shop").alias("repo_id"), P.part_path("p_partkey").alias("key"), F.pmod("p_size", F.lit(5)).cast("bigint").alias("community_id")))


LINKS_SQL = """links AS (SELECT 'shop' AS repo_id, 'sup_' || l_suppkey AS source, 'm' || (l_partkey % 25) || '/part_' || l_partkey || '.go' AS target, l_linenumber AS n, CASE WHEN l_tax > 0 THEN l_discount * 10 END AS confidence,
  CASE WHEN coalesce(CASE WHEN l_tax > 0 THEN l_discount * 10 END, 1) < 0.5 THEN 'lowConfidence' WHEN l_linenumber >= 6 THEN 'dynamic' WHEN p_size > 40 THEN 'import' WHEN l_suppkey % 5 = p_size % 5 THEN 'internal' ELSE 'crossCommunity' END AS edge_class
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


@query("", f"WITH {LINKS_SQL} SELECT repo_id, source, target, edge_class, count(*) AS n FROM links GROUP BY ALL")
def classify_edges(spark, d):
    return graph.classify_edges(links(spark, d), labels(spark, d)).groupBy("repo_id", "source", "target", "edge_class").agg(F.count("*").alias("n"))


_RANK = "CASE edge_class WHEN 'internal' THEN 1 WHEN 'import' THEN 2 WHEN 'crossCommunity' THEN 3 WHEN 'dynamic' THEN 4 ELSE 5 END"


@query("", f"WITH {LINKS_SQL}, e AS (SELECT repo_id, source, target, min({_RANK}) AS r, arg_min(edge_class, {_RANK}) AS edge_class FROM links GROUP BY ALL) SELECT repo_id, source, target, edge_class FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r, target) AS k FROM e) WHERE k <= 25")
def cap_edges_per_source(spark, d):
    return graph.cap_edges_per_source(graph.classify_edges(links(spark, d), labels(spark, d)))


@query("", f"WITH {LINKS_SQL} SELECT repo_id, source, target, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN n < 6 THEN ['n' || n, 'n1'] ELSE [] END)))), ',') AS imported_names, count(*) AS edge_count, max(confidence) AS confidence FROM links GROUP BY ALL")
def dedupe_edges(spark, d):
    return graph.dedupe_edges(links(spark, d)).withColumn("imported_names", F.array_join("imported_names", ","))


@query("supply", "SELECT 'shop' AS repo_id, src, dst, CASE WHEN max(l_linenumber) = 7 THEN 'calls' ELSE 'import' END AS rel FROM (SELECT 'sup_' || l_suppkey AS src, 'm' || (l_partkey % 25) || '/part_' || l_partkey || '.go' AS dst, l_linenumber FROM lineitem WHERE l_partkey % 3 <> 0 AND l_suppkey % 4 <> 0) GROUP BY ALL")
def add_relations(spark, d):
    """Of the relations of one pair the one of the largest line number stays; a quarter of the suppliers and a third of the parts are no nodes."""
    li = P.table(spark, d, "lineitem")
    e = li.select(F.lit("shop").alias("repo_id"), F.concat(F.lit("sup_"), F.col("l_suppkey").cast("string")).alias("src"), P.part_path("l_partkey").alias("dst"), F.when(F.col("l_linenumber") == 7, "calls").otherwise("import").alias("rel"), "l_linenumber", "l_suppkey", "l_partkey")
    nodes = e.where("pmod(l_suppkey, 4) <> 0").select("repo_id", F.col("src").alias("key")).union(e.where("pmod(l_partkey, 3) <> 0").select("repo_id", "dst")).distinct()
    return graph.add_relations(e, nodes, "l_linenumber")


# ---- modules ---------------------------------------------------------------------------------------


@query("cochange parts", f"SELECT * FROM (WITH {MODULE_SQL}, best AS (SELECT p_brand AS module FROM parts WHERE p_brand IN (SELECT source FROM links UNION SELECT target FROM links) GROUP BY 1 ORDER BY avg(pagerank) DESC, 1 LIMIT 15) SELECT repo_id, source, target, edge_count FROM links WHERE source IN (FROM best) AND target IN (FROM best))")
def module_dependency_matrix(spark, d):
    """The matrix in long form."""
    modules = P.part_files(spark, d).groupBy("repo_id", F.col("p_brand").alias("module")).agg(F.avg("pagerank").alias("avg_pagerank"))
    wide = graph.module_dependency_matrix(_module_links(spark, d), modules)
    return wide.unpivot(["repo_id", "source"], [c for c in wide.columns if c not in ("repo_id", "source")], "target", "edge_count").where("edge_count is not null")


@query("parts", "WITH t AS (SELECT size // 100 AS c, arg_max(path, (pagerank, path)) AS top FROM parts GROUP BY ALL) SELECT m.repo_id, m.module, min(c)::BIGINT AS community_id FROM (SELECT DISTINCT repo_id, regexp_extract(path, '^([^/]*)', 1) AS module FROM parts) m JOIN t ON starts_with(top, module || '/') GROUP BY ALL".replace("WITH t AS", "SELECT * FROM (WITH t AS") + ")")
def module_community(spark, d):
    """Modules that hold a community's top file (the hash of the others' names is left out)."""
    nodes, _ = _labelled(spark, d)
    tops = nodes.groupBy("repo_id", "community_id").agg(F.max_by("path", F.struct("pagerank", "path")).alias("top_file"))
    modules = nodes.select("repo_id", F.substring_index("path", "/", 1).alias("module")).distinct()
    held = modules.join(tops.select("repo_id", F.substring_index("top_file", "/", 1).alias("module")).distinct(), ["repo_id", "module"], "left_semi")
    return graph.module_community(held, tops)


@query("supply", "SELECT * FROM (SELECT 'shop' AS repo_id, key, count(*)::BIGINT AS value FROM (SELECT src AS key FROM supply UNION ALL SELECT dst FROM supply) GROUP BY ALL) ORDER BY value DESC, key LIMIT 10")
def centrality_leaderboard(spark, d):
    return graph.centrality_leaderboard(graph.degrees(P.supply_edges(spark, d)), "degree")


@query("parts supply", "SELECT p.repo_id, p.path AS key, floor(100 * (rank() OVER (PARTITION BY p.repo_id ORDER BY pagerank) - 1) / count(*) OVER (PARTITION BY p.repo_id) + 0.5)::INT AS pagerank_percentile, (size // 100)::BIGINT AS community_id, coalesce(n, 0) AS in_degree, 0::BIGINT AS out_degree FROM parts p LEFT JOIN (SELECT dst, count(*) AS n FROM supply GROUP BY ALL) s ON s.dst = p.path")
def graph_metrics(spark, d):
    nodes, _ = _labelled(spark, d)
    return graph.graph_metrics(nodes, P.supply_edges(spark, d)).select("repo_id", "key", "pagerank_percentile", "community_id", "in_degree", "out_degree")


@query("symbols", "SELECT repo_id, file_path AS page, max(seq) AS page_id FROM symbols WHERE name <> 'system' GROUP BY ALL")
def docs_index(spark, d):
    """Of a file's pages the last module page, else the last file page."""
    s = P.symbols(spark, d)
    kind = F.when(F.col("name") == "system", "onboarding").otherwise("module_page")
    pages = s.select("repo_id", F.col("file_path").alias("target_path"), kind.alias("page_type"), "seq", F.col("seq").alias("page_id"))
    return graph.docs_index(pages).withColumnRenamed("target_path", "page")


@query("parts", "SELECT repo_id, path, round(pagerank, 9) AS pagerank, k::INT AS k, CASE WHEN size >= 3000 THEN path END AS page_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY pagerank DESC, path) AS k FROM parts WHERE contains(p_type, 'ECONOMY')) WHERE k <= 5")
def start_here_files(spark, d):
    p = P.part_files(spark, d).withColumns({"node_type": F.lit("file"), "is_entry_point": F.col("p_type").contains("ECONOMY")})
    docs = p.where("size >= 3000").select("repo_id", F.col("path").alias("target_path"), F.col("path").alias("page_id"))
    return rounded(graph.start_here_files(p, docs), "pagerank", places=9)


@query("parts", "SELECT * FROM (SELECT path AS key FROM parts WHERE contains(path, 'part_1') ORDER BY CASE WHEN path = 'part_1' THEN 0 WHEN starts_with(path, 'part_1') THEN 1 ELSE 2 END, levenshtein(path, 'part_1'), path LIMIT 20)")
def node_search(spark, d):
    return graph.node_search(P.part_files(spark, d).withColumnRenamed("path", "key"), "PART_1").select("key")


@query(
    "parts",
    """SELECT * FROM (WITH t AS (SELECT path, list_min(list_transform(regexp_split_to_array(lower(path), '[/.:]'), lambda x: levenshtein(x, 'prat_12'))) AS n FROM parts)
SELECT path AS key FROM t WHERE n <= 2 ORDER BY n, path LIMIT 20)""",
)
def node_search_mistyped(spark, d):
    """Two letters in the wrong order."""
    return graph.node_search(P.part_files(spark, d).withColumnRenamed("path", "key"), "prat_12").select("key")


@query("parts", "SELECT path FROM parts WHERE size // 100 IN (3, 7, 9) AND NOT contains(content, 'ring')")
def community_visibility(spark, d):
    """Shown communities without test files; parts named for a ring are tests."""
    nodes, _ = _labelled(spark, d)
    p = P.part_files(spark, d).select(F.col("path").alias("key"), F.col("content").contains("ring").alias("test"))
    nodes = nodes.join(p, "key").withColumn("path", F.when(F.col("test"), F.regexp_replace("path", r"\.go$", "_test.go")).otherwise(F.col("path")))
    return graph.hide_tests(graph.community_visibility(nodes, [3, 7, 9])).select("path")


# ---- reach and paths ------------------------------------------------------------------------------------

#: Nations hang in a tree: nation n under n // 3; every region's nations form a chain besides.
TREE_SQL = """tree AS (SELECT DISTINCT n_nationkey AS a, n_nationkey // 3 AS b FROM nation WHERE n_nationkey > 0 UNION SELECT a.c_nationkey, b.s_nationkey FROM (SELECT c_custkey, c_nationkey FROM customer) a JOIN supplier b ON a.c_custkey = b.s_suppkey WHERE a.c_nationkey > b.s_nationkey)"""


def tree(spark, d: str) -> DataFrame:
    """Edges from each nation to the one a third of its number, and from customers' to suppliers' nations of one key, downwards."""
    n = P.table(spark, d, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("a"), F.floor(F.col("n_nationkey") / 3).cast("int").alias("b"))
    c, s = P.table(spark, d, "customer"), P.table(spark, d, "supplier")
    more = c.join(s, F.col("c_custkey") == F.col("s_suppkey")).where("c_nationkey > s_nationkey").select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))
    name = lambda x: F.concat(F.lit("n"), F.lpad(F.col(x).cast("string"), 2, "0"))
    return n.union(more).distinct().select(F.lit("w").alias("repo_id"), name("a").alias("src"), name("b").alias("dst"), F.lit("calls").alias("rel"))


_NAME = "'n' || lpad({}::VARCHAR, 2, '0')"


def _reach_sql(start: str, step: str, depth: int) -> str:
    return f"""WITH RECURSIVE {TREE_SQL}, r(key, depth) AS ({start} UNION SELECT {step} AND depth < {depth}) SELECT 'w' AS repo_id, {_NAME.format('key')} AS key, min(depth)::INT AS depth FROM r GROUP BY key"""


@query("", _reach_sql("SELECT 2, 0", "CASE WHEN a = key THEN b ELSE a END, depth + 1 FROM r JOIN tree ON key IN (a, b) WHERE true", 2))
def ego_graph(spark, d):
    return graph.ego_graph(tree(spark, d), "n02", 2)


@query("", _reach_sql("SELECT n_nationkey, 0 FROM nation WHERE n_nationkey IN (1, 7)", "a, depth + 1 FROM r JOIN tree ON b = key WHERE true", 3))
def blast_radius(spark, d):
    """What depends on nations 1 and 7."""
    changed = P.table(spark, d, "nation").where("n_nationkey in (1, 7)").select(F.lit("w").alias("repo_id"), F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("key"))
    return graph.blast_radius(changed, tree(spark, d))


@query("", f"WITH RECURSIVE {TREE_SQL}, r(key, path, depth) AS (SELECT 24, [24], 0 UNION ALL SELECT b, path || [b], depth + 1 FROM r JOIN tree ON a = key WHERE key > 0 AND depth < 12) SELECT 'w' AS repo_id, array_to_string(list_transform(path, lambda x: {_NAME.format('x')}), ' ') AS path, depth::INT AS distance FROM r WHERE key = 0 ORDER BY depth, path LIMIT 1")
def shortest_path(spark, d):
    return graph.shortest_path(tree(spark, d), "n24", "n00").withColumn("path", F.array_join("path", " "))


@query(
    "",
    f"""WITH RECURSIVE {TREE_SQL}, p(s, key, depth, n) AS (SELECT n_nationkey, n_nationkey, 0, 1::DOUBLE FROM nation UNION ALL SELECT s, b, depth + 1, n FROM p JOIN tree ON a = key),
d AS (SELECT s, key, min(depth) AS depth FROM p GROUP BY ALL), q AS (SELECT s, key, depth, sum(n) AS sigma FROM p JOIN d USING (s, key, depth) GROUP BY ALL),
b AS (SELECT x.key, sum(x.sigma * y.sigma / t.sigma) AS v FROM q x JOIN q y ON y.s = x.key JOIN q t ON t.s = x.s AND t.key = y.key AND t.depth = x.depth + y.depth WHERE x.s <> x.key AND y.key <> x.key GROUP BY ALL)
SELECT 'w' AS repo_id, {_NAME.format('n_nationkey')} AS key, round(coalesce(v, 0), 6) AS betweenness FROM nation LEFT JOIN b ON b.key = n_nationkey""",
)
def betweenness(spark, d):
    """Exact, over the shortest paths between all pairs."""
    nodes = P.table(spark, d, "nation").select(F.lit("w").alias("repo_id"), F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("key"))
    return rounded(graph.betweenness(nodes, tree(spark, d), None), "betweenness")


@query("", f"WITH {TREE_SQL}, r AS (SELECT b AS k, a AS o, 'caller' AS side FROM tree UNION ALL SELECT a, b, 'callee' FROM tree), q AS (SELECT *, row_number() OVER (PARTITION BY k, side ORDER BY o) AS i FROM r) SELECT 'w' AS repo_id, {_NAME.format('k')} AS key, side, count(*) AS total, string_agg({_NAME.format('o')}, ' ' ORDER BY o) FILTER (i <= 5) AS others, count(*) > 5 AS truncated FROM q GROUP BY k, side")
def callers_callees(spark, d):
    return graph.callers_callees(tree(spark, d), 5).withColumn("others", F.array_join("others", " "))


@query("", f"WITH {TREE_SQL} SELECT 'w' AS repo_id, {_NAME.format('a')} AS src, {_NAME.format('b')} AS dst FROM tree WHERE a % 2 = 0 AND b % 2 = 0")
def sub_graph(spark, d):
    e = tree(spark, d)
    even = P.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.lit("w").alias("repo_id"), F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("key"))
    return graph.sub_graph(e, even).select("repo_id", "src", "dst")


@query(
    "cochange",
    """SELECT c.repo_id, a AS src, b AS dst FROM cochange c, (SELECT list(path) AS l FROM (SELECT path FROM commits GROUP BY path HAVING max(ts) > TIMESTAMP '2001-08-01' - INTERVAL 365 DAY ORDER BY count(*) DESC, path LIMIT 50)) WHERE list_contains(l, a) AND list_contains(l, b)""",
)
def hot_files(spark, d):
    """Links between the 50 most changed files of the last year."""
    c = P.commits(spark, d)
    pairs = history.co_changes(c, 2).select("repo_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    last = c.select("repo_id", "commit_id", "path", "ts").distinct().groupBy("repo_id", "path").agg(F.count("*").alias("commits"), F.max("ts").alias("last"))
    return graph.hot_files(last, pairs, P.PARAMS, 365)


FLOW_SQL = f"""{CALLS_SQL},
rank AS (SELECT key, length(key) / 1000 + (ascii(name) % 7) AS pr, length(path) % 3 AS c FROM nodes),
entry AS (SELECT src AS key FROM calls WHERE src NOT IN (SELECT dst FROM calls) GROUP BY src)"""


@query(
    "symbols",
    f"""WITH RECURSIVE r AS (SELECT 1) SELECT * FROM (WITH RECURSIVE {FLOW_SQL},
f(entry, trace, node) AS (SELECT key, [key], key FROM (SELECT key FROM entry JOIN rank USING (key) ORDER BY pr DESC, key LIMIT 10)
  UNION ALL SELECT entry, trace || [dst], dst FROM (SELECT f.entry, f.trace, c.dst, row_number() OVER (PARTITION BY f.entry ORDER BY k.pr DESC, c.dst DESC) AS k FROM f JOIN calls c ON c.src = f.node JOIN rank k ON k.key = c.dst WHERE NOT list_contains(f.trace, c.dst) AND len(f.trace) < 8) WHERE k = 1)
SELECT 'chat' AS repo_id, entry, array_to_string(arg_max(trace, len(trace)), ' ') AS trace FROM f GROUP BY entry)""".replace("WITH RECURSIVE r AS (SELECT 1) ", ""),
)
def execution_flows(spark, d):
    """From the first speakers along the most central next speakers."""
    nodes, calls = _symbol_graph(spark, d)
    rank = F.length("key") / 1000 + F.pmod(F.ascii("name"), F.lit(7))
    nodes = nodes.withColumns({"pagerank": rank, "community_id": F.pmod(F.length("path"), F.lit(3)).cast("bigint")})
    flows = graph.execution_flows(nodes.where("node_type = 'symbol'"), graph.add_call_edges(calls, nodes)[0])
    return flows.select("repo_id", "entry", F.array_join("trace", " ").alias("trace"))


@query("symbols", "SELECT DISTINCT 'chat' AS repo_id, src, dst FROM (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p)".replace("FROM p ", "FROM (SELECT name AS a, lead(name) OVER (PARTITION BY file_path ORDER BY seq) AS b FROM symbols) WHERE b IS NOT NULL ", 1).replace("FROM p)", "FROM (SELECT name AS a, lead(name) OVER (PARTITION BY file_path ORDER BY seq) AS b FROM symbols) WHERE b IS NOT NULL)"))
def flow_edges(spark, d):
    """Conversations as traces of speakers."""
    t = P.symbols(spark, d).groupBy("repo_id", "file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("trace"))
    return graph.flow_edges(t)


@query(
    "hot parts",
    """SELECT p.repo_id, round(avg((coalesce(h.churn_percentile, 0) + pp) / 200), 6) AS direct_risk, count(*) AS changed, (SELECT count(*) FROM supply WHERE dst IN (SELECT path FROM parts WHERE p_brand = 'Brand#2'))::BIGINT AS links FROM (
  SELECT *, floor(100 * (rank() OVER (ORDER BY pagerank) - 1) / count(*) OVER () + 0.5) AS pp FROM parts) p LEFT JOIN hot h ON h.path = p.path WHERE p_brand = 'Brand#2' GROUP BY p.repo_id""".replace(", (SELECT count(*) FROM supply WHERE dst IN (SELECT path FROM parts WHERE p_brand = 'Brand#2'))::BIGINT AS links", ""),
)
def blast_score(spark, d):
    """Direct risk of the parts of one brand."""
    p = P.part_files(spark, d)
    changed = p.where("p_brand = 'Brand#2'").select("repo_id", F.col("path").alias("key"))
    ranks = graph.percentile_of(p.select("repo_id", F.col("path").alias("key"), "pagerank"), "pagerank")
    reached = graph.blast_radius(changed, P.supply_edges(spark, d))
    return rounded(graph.blast_score(changed, reached, history.hotspots(P.commits(spark, d), P.PARAMS), ranks), "direct_risk").select("repo_id", "direct_risk", "changed")


@query("parts", "SELECT repo_id, path FROM parts WHERE size // 100 = 7")
def community_nodes(spark, d):
    from ..operators import increments

    nodes, _ = _labelled(spark, d)
    return increments.community_nodes(nodes, "shop", 7).select("repo_id", "path")


@query("symbols", "SELECT DISTINCT repo_id, file_path || ':' || name AS key FROM symbols")
def repo_symbols(spark, d):
    from ..operators import increments

    return increments.repo_symbols(_symbol_graph(spark, d)[0], "chat").select("repo_id", "key")


@query("symbols", "SELECT DISTINCT repo_id, file_path AS key FROM symbols")
def repo_files(spark, d):
    from ..operators import increments

    return increments.repo_files(_symbol_graph(spark, d)[0], "chat").select("repo_id", "key")


@query("supply", "SELECT count(*) AS entities, (SELECT count(*) FROM supply) AS relations FROM (SELECT src FROM supply UNION SELECT dst FROM supply)")
def export_graph(spark, d):
    """The exported graph, read back."""
    from ..sources import sinks
    from ..storage import shared_dir

    path = shared_dir(spark, "graph")
    sinks.export_graph(_supply_nodes(spark, d), P.supply_edges(spark, d), path)
    n = spark.read.json(f"{path}/entities").agg(F.count("*").alias("entities"))
    return n.join(spark.read.json(f"{path}/relations").agg(F.count("*").alias("relations")), F.lit(True))


