"""Roll-ups and contract analytics on small literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from codequarry.operators import contracts, graph, planning, ranks, reports, scoring
from codequarry.schemas import Params

T = dt.datetime(2024, 1, 1)


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def as_dict(frame, key, value):
    return {r[key]: r[value] for r in frame.collect()}


def test_running_totals_over_many_partitions(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "a").otherwise("b").alias("g"), "id", F.lit(1).alias("c"))
    got = ranks.running_totals(rows, "g", "id", "c").collect()
    assert all(r.below == (r.id if r.g == "a" else r.id - 700) and r.total == (700 if r.g == "a" else 300) for r in got)


def hot(spark):
    s = "repo_id string, path string, primary_owner string, churn_percentile double, commit_count_30d long, commit_count_90d long, temporal_hotspot_score double, bus_factor int, is_hotspot boolean"
    return df(spark, s, ("r", "a", "Ann", 95.0, 5, 9, 12.0, 1, True), ("r", "b", "bob", 40.0, 1, 9, 1.0, 2, False), ("r", "c", "cy", 100.0, 0, 0, None, 3, True))


def test_hotspot_views(spark):
    h = hot(spark)
    assert [r.path for r in reports.hotspot_filters(h, "ANN").collect()] == ["a"]
    assert [r.path for r in reports.hotspot_filters(h, preset="accelerating").collect()] == ["a"]
    c = reports.hotspot_preset_counts(h).first()
    assert (c["all"], c.hot, c.bus_factor, c.accelerating) == (3, 2, 1, 1)
    assert as_dict(reports.hotspot_risk(h), "path", "risk") == {"a": 98, "b": 36, "c": 40}
    assert as_dict(reports.trend(h), "path", "trend") == {"a": "heating", "b": "cooling", "c": "steady"}
    assert as_dict(reports.churn_histogram(h), "bucket", "files")[9] == 2
    assert [r.path for r in reports.churn_x_bus_danger(h).collect()] == ["a", "c"]
    assert [r.path for r in reports.bus_factor_risks(h).collect()] == ["a"]
    own = df(spark, "key string, owner string, is_silo boolean", ("k", "o", True), ("k2", "p", False))
    assert reports.ownership_filters(own, "k", True).count() == 1 and reports.silo_count(own).first().silos == 1


def test_dead_code_views(spark):
    f = df(spark, "repo_id string, file string, name string, kind string, owner string, lines long, confidence double, safe_to_delete boolean", ("r", "a", "x", "unused", " ", 10, 0.9, True), ("r", "a", "y", None, "o", 20, 0.4, False))
    assert as_dict(reports.dead_code_by_owner(f), "owner", "lines") == {"Unowned": 10, "o": 20}
    assert reports.dead_code_by_owner(f, True).count() == 1
    assert reports.dead_code_by_file(f).first().largest == "y"
    assert {r.tier for r in reports.dead_code_matrix(f).collect()} == {"high", "low"}
    assert contracts.dead_code_summary(f).first().deletable_lines == 10


def test_costs(spark):
    log = df(spark, "model string, operation string, input_tokens long, output_tokens long, tokens long, cost double, cache_hit boolean", ("claude-3", "a", 1, 2, 3, 1.0, True), ("gpt-4", "b", 1, 1, 2, 3.0, False), ("zz", "b", 0, 0, 0, 0.0, False))
    assert as_dict(reports.cost_by_provider(log), "provider", "calls") == {"anthropic": 1, "openai": 1, "other": 1}
    assert as_dict(reports.cost_concentration(log), "operation", "share") == {"a": 0.25, "b": 0.75}
    assert reports.operation_breakdown(log).first().operation == "a"
    assert reports.cost_averages(log).first().calls == 3
    assert abs(reports.cache_hit_ratio(log).first().ratio - 1 / 3) < 1e-9
    price = spark.range(1).select(planning.regeneration_estimate(F.lit(25), F.lit(0.001), F.lit(0.002)).alias("c")).first().c
    assert abs(price - 3 * (2.0 + 1.6) / 1000) < 1e-12


def test_portfolio_and_decisions(spark):
    repos = df(spark, "files long, fresh_pct double, stale_pages long, dead_exports long, coverage_pct double", (10, 55.0, 1, 2, 50.0), (0, 0.0, 0, 0, None))
    r = reports.portfolio_rollup(repos).first()
    assert (r.files, r.fresh_pages, r.mean_coverage) == (10, 6, 50.0)
    pairs = df(spark, "repo_a string, repo_b string, strength double", ("a", "b", 0.5), ("b", "a", 1.0))
    assert tuple(reports.cross_repo_co_change_summary(pairs).first()) == (2, 1, 75.0)
    c = df(spark, "contract_id string, contract_type string, repo_id string, role string", ("1", "http", "a", "provider"), ("1", "http", "b", "consumer"), ("2", "grpc", "a", "provider"))
    links = contracts.contract_links(c)
    assert links.count() == 1
    assert as_dict(reports.contract_match_summary(c, links), "contract_type", "unmatched") == {"http": 0, "grpc": 1}
    d = df(spark, "repo_id string, id string, path string, status string, updated_at timestamp, created_at timestamp", ("r", "1", "a", "active", T, T))
    change = df(spark, "repo_id string, path string, last_change timestamp", ("r", "a", T + dt.timedelta(days=1)))
    assert as_dict(contracts.decision_health(d, change, hot(spark)), "status", "n") == {"stale": 1, "ungoverned_hotspots": 1}
    assert reports.recent_decisions(d).count() == 1
    m = df(spark, "severity string, type string, file string", ("High", "x", "a/b/c"), ("low", "x", "a/b/d"))
    silos = df(spark, "is_silo boolean", (True,))
    dead = df(spark, "safe_to_delete boolean, lines long", (True, 7))
    assert tuple(reports.risk_summary(hot(spark), silos, dead, d, m).first()) == (2, 1, 7, 0, 1)
    assert reports.findings_by_directory(m).first().total == 2
    item = df(spark, "title string, seq long, lines long", ("t", 1, 600))
    assert [r.severity for r in reports.attention_items(item, item, item, item, item).collect()] == ["high", "high", "medium", "medium", "low"]


def test_groups_and_quadrants(spark):
    t = df(spark, "file string, primary string, impact double, effort double, coverage double, score double", ("a/x", "p", 2.0, 60.0, 10.0, 3.0), ("a/y", "q", 0.5, 10.0, 90.0, 9.0))
    assert reports.refactoring_groups(t, "module").first().targets == 2
    assert {r.quadrant for r in reports.quadrants_impact_effort(t).collect()} == {"high_hard", "low_easy"}
    assert {r.quadrant for r in reports.quadrants_risk_coverage(t).collect()} == {"uncovered_unhealthy", "covered_healthy"}
    rows = df(spark, "path string, owner string", ("f", "a"), ("f", "b"), ("g", "a"))
    nodes, links = reports.contributor_network(rows)
    assert as_dict(nodes, "owner", "files") == {"a": 2, "b": 1} and links.first().shared == 1
    cats = df(spark, "categories map<string,long>", ({"fix": 2, "feature": 1},), ({"fix": 1},))
    assert as_dict(reports.commit_category_totals(cats), "category", "dominant") == {"fix": True, "feature": False}
    own = df(spark, "owner string, category string", ("o", "x"), ("o", "x"), ("o", "y"))
    assert as_dict(reports.owner_category_mix(own), "category", "n") == {"x": 2, "y": 1}


def test_scores_over_time_and_targets(spark):
    snaps = df(spark, "repo_id string, taken_at timestamp, score double", ("r", T, 8.0), ("r", T + dt.timedelta(days=1), 7.0))
    assert [(r.delta, r.alert) for r in scoring.health_trend(snaps).orderBy("taken_at").collect()] == [(None, False), (-1.0, True)]
    m = df(spark, "repo_id string, file string, type string, severity string, deduction double", ("r", "a", "x", "low", 1.0), ("r", "a", "y", "high", 0.5))
    size = df(spark, "repo_id string, path string, nloc long", ("r", "a", 150))
    r = scoring.refactoring_targets(m, size).first()
    assert (r.impact, r.primary, r.effort, r.impact_per_effort) == (1.5, "x", "M", 0.75)
    s = df(spark, "repo_id string, file string, final double", ("r", "a", 3.0), ("r", "b", 9.0))
    o = scoring.health_overview(s, size, hot(spark)).first()
    assert (o.files, o.red, o.green, o.hotspot_health) == (2, 1, 1, 3.0)
    f = df(spark, "repo_id string, path string, size long, is_hotspot boolean, is_silo boolean, is_dead boolean, bus_factor int", ("r", "m/a", 10, True, False, False, 3))
    assert scoring.module_health(f).first().score == 70.0


def test_contract_analytics(spark):
    files = df(spark, "repo_id string, path string, content string, size long, last_mod timestamp", ("r", "d/a.go", "x\ny", 3, dt.datetime(2020, 1, 1)), ("r", "d/b_test.go", "z", 1, T))
    edges = df(spark, "repo_id string, src string, dst string, rel string", ("r", "q", "zz", "import"))
    dead = df(spark, "repo_id string, file string, message string", ("r", "d/a.go", "Symbol 'F' has zero incoming call edges"))
    got = {(r.kind, r.name, r.lines, r.confidence) for r in contracts.dead_code_findings(dead, files, edges, Params(as_of=T)).collect()}
    assert got == {("unreachable_file", "d/a.go", 2, 0.9), ("unused_symbol", "F", 1, 0.9)}
    rk = df(spark, "repo_id string, path string, pagerank double", ("r", "d/a.go", 0.5))
    sy = df(spark, "repo_id string, file_path string, name string, type string, line int, end_line int", ("r", "d/a.go", "Foo", "function", 1, 50))
    assert abs(contracts.symbol_importance(sy, rk).first().importance - 0.9) < 1e-9
    pages = df(spark, "repo_id string, page_id string, content string, target_path string, source_hash string, updated_at timestamp", ("r", "1", "alpha beta alpha", "d/a.go", "nope", T), ("r", "2", "beta", "gone", "x", T))
    assert [r.page_id for r in contracts.search_pages(pages, "Alpha").collect()] == ["1"]
    assert as_dict(contracts.page_freshness(pages, files), "page_id", "freshness") == {"1": "stale", "2": "missing"}
    assert {r.version for r in contracts.page_versions(pages).collect()} == {1}
    own = df(spark, "key string, owner string, share double, is_silo boolean", ("d/a.go", "o", 0.9, True))
    assert {r.kind for r in contracts.knowledge_map(own, rk, rk.limit(0)).collect()} == {"owner", "silo", "target"}
    assert contracts.repo_stats(files, sy, edges).first().modules == 1
    commits = df(spark, "repo_id string, email string, ts timestamp", ("a", "x", T), ("b", "x", T), ("b", "x", T + dt.timedelta(days=3)))
    assert contracts.cross_repo_co_changes(commits).first().strength == 1.0
    deps = df(spark, "repo_id string, dependency string", ("a", "lib"))
    assert contracts.package_deps(deps, df(spark, "repo_id string, package string", ("b", "lib"))).first().target == "b"


def test_graph_reports(spark):
    e = df(spark, "repo_id string, src string, dst string, rel string", ("r", "a/x", "b/y", "import"), ("r", "a/x", "a/z", "import"))
    nodes = df(spark, "repo_id string, key string, path string, node_type string, pagerank double, community_id long, is_entry_point boolean", ("r", "a/x", "a/x", "file", 0.5, 0, True), ("r", "a/z", "a/z", "file", 0.2, 0, False), ("r", "b/y", "b/y", "file", 0.3, 1, False))
    c = {r.community_id: (r.members, r.top_file, r.cohesion) for r in graph.communities_summary(nodes, e).collect()}
    assert c == {0: (2, "a/x", 0.5), 1: (1, "b/y", 0.0)}
    links = graph.community_links(nodes, e)
    assert links.first().edge_count == 1
    assert graph.graph_metrics(nodes, e).where("key = 'a/x'").first().out_degree == 2
    assert [r.key for r in graph.node_search(nodes, "A/").collect()] == ["a/x", "a/z"] and graph.node_search(nodes, "").first().key == "a/x"
    mods = df(spark, "repo_id string, module string, avg_pagerank double", ("r", "a", 0.4), ("r", "b", 0.3))
    ml = graph.module_edges(e, nodes.select("repo_id", "key", F.substring_index("path", "/", 1).alias("module")))
    assert graph.module_dependency_matrix(ml, mods).first()["b"] == 1
    tops = df(spark, "repo_id string, community_id long, top_file string", ("r", 7, "a/x"))
    assert as_dict(graph.module_community(mods, tops), "module", "community_id")["a"] == 7
    docs = df(spark, "repo_id string, target_path string, page_id string, page_type string, seq long", ("r", "a/x", "p1", "file_page", 2), ("r", "a/x", "p2", "module_page", 1))
    assert graph.docs_index(docs).first().page_id == "p2"
    assert graph.start_here_files(nodes, graph.docs_index(docs)).first().page_id == "p2"
    trace = df(spark, "repo_id string, trace array<string>", ("r", ["a", "b", "c"]), ("r", ["z"]))
    assert {(r.src, r.dst) for r in graph.flow_edges(trace).collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    imp = df(spark, "repo_id string, source string, target string, imported_names array<string>, confidence double", ("r", "a", "b", ["x"], 0.5), ("r", "a", "b", ["y"], 0.9))
    r = graph.dedupe_edges(imp).first()
    assert (r.imported_names, r.edge_count, r.confidence) == (["x", "y"], 2, 0.9)
    assert graph.hide_tests(df(spark, "path string", ("a_test.go",), ("a.go",))).count() == 1
    reach = graph.blast_radius(df(spark, "repo_id string, key string", ("r", "b/y")), e)
    rk = graph.percentile_of(nodes.select("repo_id", "key", "pagerank"), "pagerank")
    assert graph.blast_score(df(spark, "repo_id string, key string", ("r", "b/y")), reach, hot(spark), rk).first().transitive == 1
    cc = df(spark, "repo_id string, src string, dst string, rel string", ("r", "m", "x", "calls"), ("r", "m", "y", "calls"))
    assert graph.callers_callees(cc, 1).where("key = 'm'").first().truncated
