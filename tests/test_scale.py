"""Plans that have to hold when one key is hot: rows made by joins, parts of hubs, pairs, texts read."""

import datetime
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from codequarry.operators import clones, contracts, coverage, graph, history
from codequarry.schemas import Params
from codequarry.sources import files as src
from codequarry.sources import sinks
from codequarry.streaming import streams

E = "repo_id string, src string, dst string, rel string"


def matched(paths, keys):
    """Every path with every key."""
    out = {}
    for p in paths:
        n = p.replace("\\", "/")
        hits = []
        for key, pct in keys:
            k = key.replace("\\", "/")
            if key == p:
                hits.append((1 << 30, key, pct))
            elif k.endswith("/" + n) or "/" in k and n.endswith("/" + k):
                hits.append((len(key.encode()), key, pct))
        if hits:
            top = max(h[0] for h in hits)
            best = sorted(h for h in hits if h[0] == top)
            out[p] = (best[0][2], len({h[1] for h in best}) > 1)
    return out


def coverage_tables(spark, paths, keys):
    f = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    return f, spark.createDataFrame([("r", k, v) for k, v in keys], "repo_id string, key string, pct double")


def test_coverage_matches_as_all_pairs_do(spark):
    rnd = random.Random(1)
    name = lambda: rnd.choice(["/", "", "", "C:\\"]) + rnd.choice(["/", "\\", "/"]).join(rnd.choice("abc") for _ in range(rnd.randint(1, 5)))
    paths, keys = sorted({name() for _ in range(150)}), [(k, float(i)) for i, k in enumerate(sorted({name() for _ in range(200)}))]
    got = {r.path: (r.pct, r.ambiguous) for r in coverage.match_coverage(*coverage_tables(spark, paths, keys)).collect()}
    assert got == matched(paths, keys) and len(got) > 50


def test_coverage_of_equal_names_makes_few_rows(spark):
    paths = [f"m{i}/src/index.ts" for i in range(3000)] + ["index.ts"]
    keys = [(f"/ci/m{i}/src/index.ts", float(i)) for i in range(3000)]
    tables = coverage_tables(spark, paths, keys)
    assert coverage.coverage_candidates(*tables).count() == 3001
    got = {r.path: (r.pct, r.ambiguous) for r in coverage.match_coverage(*tables).collect()}
    assert got["m7/src/index.ts"] == (7.0, False) and got["index.ts"][1] and len(got) == 3001


@pytest.mark.parametrize("end, other", [("src", "dst"), ("dst", "src")])
def test_a_star_is_dealt_evenly(spark, end, other):
    star = spark.range(60_000).select(F.lit("r").alias("repo_id"), F.lit("hub").alias(end), F.col("id").cast("string").alias(other), F.lit("x").alias("rel"))
    rows, sizes = graph.cut_by_degree(star, end, other, hub=1_000)
    parts = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(parts) == 60 and max(parts) < 2 * sorted(parts)[30] and sum(parts) == 60_000
    assert [(r.key, r.degree, r.parts) for r in sizes.where("parts > 1").collect()] == [("hub", 60_000, 60)]
    assert graph.in_parts(sizes.where("key = 'hub'")).count() == 60


def test_hubs_in_parts_change_no_result(spark):
    rnd = random.Random(2)
    pairs = {("hub", str(i)) for i in range(60)} | {(str(i), "hub") for i in range(40)} | {(str(rnd.randrange(60)), str(rnd.randrange(60))) for _ in range(90)}
    edges = spark.createDataFrame([("r", a, b, "x") for a, b in pairs if a != b], E)
    nodes = spark.createDataFrame([("r", k) for k in sorted({k for p in pairs for k in p})], "repo_id string, key string")
    ranks = [{r.key: r.pagerank for r in graph.pagerank(nodes, edges, max_iter=4, tolerance=0, hub=h).collect()} for h in (7, 100_000)]
    assert all(abs(ranks[0][k] - v) < 1e-12 for k, v in ranks[1].items()) and len(ranks[0]) == len(ranks[1])
    labels = [{r.key: r.community_id for r in graph.communities(nodes, edges, max_rounds=2, hub=h).collect()} for h in (7, 100_000)]
    assert labels[0] == labels[1]


def test_pagerank_until_tolerance_equals_plain_rounds(spark):
    """Three repositories of different sizes, against a power iteration run to its end."""
    rnd, rows, want = random.Random(5), [], {}
    for repo, n in (("a", 3), ("b", 12), ("c", 30)):
        pairs = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(2 * n)})
        rows += [(repo, str(x), str(y), "x") for x, y in pairs]
        r = [1 / n] * n
        out = Counter(x for x, _ in pairs)
        for _ in range(300):
            lost = sum(r[i] for i in range(n) if not out[i])
            new = [0.15 / n + 0.85 * lost / n] * n
            for x, y in pairs:
                new[y] += 0.85 * r[x] / out[x]
            r = new
        want |= {(repo, str(i)): v for i, v in enumerate(r)}
    nodes = spark.createDataFrame(list(want), "repo_id string, key string")
    got = {(r.repo_id, r.key): r.pagerank for r in graph.pagerank(nodes, spark.createDataFrame(rows, E), tolerance=1e-4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_co_changes_prune_before_pairing(spark):
    """An initial commit of many files of which few recur."""
    rows = [("r", "first", f"f{i}") for i in range(2_000)] + [("r", f"c{c}", f"f{i}") for c in range(3) for i in range(20)]
    once = spark.createDataFrame(rows, "repo_id string, commit_id string, path string")
    pairs = history.pairs_within(history.recurring(once, 3), ["repo_id", "commit_id"], "path")
    assert pairs.where("commit_id = 'first'").count() == 190
    got = {(r.a, r.b): r["count"] for r in history.co_changes(once, 3).collect()}
    assert got == {tuple(sorted(p)): 4 for p in combinations([f"f{i}" for i in range(20)], 2)}
    assert history.co_changes(once, 3, most_files=1_000).first()["count"] == 3


def test_large_sets_are_paired_in_blocks(spark):
    rows = spark.createDataFrame([("k", f"i{i}") for i in range(45)] + [("l", "x")], "k string, i string")
    got = [(r.a, r.b) for r in history.pairs_within(rows, ["k"], "i", block=10).collect()]
    assert sorted(got) == sorted(tuple(sorted(p)) for p in combinations([f"i{i}" for i in range(45)], 2))


def test_cross_repository_days(spark):
    rnd = random.Random(3)
    rows = [(f"r{rnd.randrange(6)}", f"p{rnd.randrange(5)}", f"2024-01-0{rnd.randrange(1, 9)} 10:00:00") for _ in range(120)]
    df = spark.createDataFrame(rows, "repo_id string, email string, t string").withColumn("ts", F.to_timestamp("t"))
    days = {(r, e, t[:10]) for r, e, t in rows}
    want = Counter(tuple(sorted(p)) for k in {d[1:] for d in days} for p in combinations(sorted({d[0] for d in days if d[1:] == k}), 2))
    assert {(r.repo_a, r.repo_b): r.days for r in contracts.cross_repo_co_changes(df).collect()} == want


def test_a_shared_header_reads_its_owner_once(spark):
    header = "licence one two three four five six seven"
    f = spark.createDataFrame([("r", f"f{i}.go", True, ".go", f"\n// {header}\nfunc f{i}() {{}}", None) for i in range(40)], "repo_id string, path string, is_file boolean, ext string, content string, last_mod timestamp")
    out = clones.dry_violations(f, "path", Params()).collect()
    assert len(out) == 39 and {r.line for r in out} == {2} and all("'f0.go' (line ~2)" in r.message for r in out)
    wanted = spark.createDataFrame([("r", "f0.go", "licence")] * 39, "repo_id string, path string, token string")
    assert [tuple(r) for r in clones.first_lines(f, wanted).collect()] == [("r", "f0.go", "licence", 2)]


def test_jaccard_of_token_sets(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a", "a"], ["a"]), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(clones.jaccard("a", "b")).collect()] == [1 / 3, 1.0, 1.0, 0.0]


def test_several_reports_of_one_repository(spark, tmp_path):
    """Equal names in two reports: the report with the last name wins; in one report, the last place."""
    xml = '<coverage><packages><package><classes>{}</classes></package></packages></coverage>'
    row = '<class filename="{}" line-rate="{}"/>'
    (tmp_path / "cob").mkdir()
    (tmp_path / "cob" / "1.xml").write_text(xml.format(row.format("x.go", 0.1) + row.format("a.go", 0.2) + row.format("b.go", 0.3)))
    (tmp_path / "cob" / "2.xml").write_text(xml.format(row.format("a.go", 0.4) + row.format("c.go", 0.5) + row.format("c.go", 0.6)))
    got = {r.key: round(r.pct, 1) for r in src.read_cobertura(spark, str(tmp_path / "cob"), "r").collect()}
    assert got == {"x.go": 10.0, "a.go": 40.0, "b.go": 30.0, "c.go": 60.0}
    clover = '<coverage><project>{}</project></coverage>'
    row = '<file name="{}"><metrics coveredstatements="{}" statements="10"/></file>'
    (tmp_path / "clo").mkdir()
    (tmp_path / "clo" / "1.xml").write_text(clover.format(row.format("x.go", 1) + row.format("y.go", 1) + row.format("a.go", 2)))
    (tmp_path / "clo" / "2.xml").write_text(clover.format(row.format("a.go", 4)))
    got = {r.key: r.pct for r in src.read_clover(spark, str(tmp_path / "clo"), "r").collect()}
    assert got == {"x.go": 10.0, "y.go": 10.0, "a.go": 40.0}


def plain_betweenness(keys, edges):
    """Brandes over every source of one graph."""
    out, score = {k: [] for k in keys}, dict.fromkeys(keys, 0.0)
    for a, b in sorted(set(edges)):
        out[a].append(b)
    for s in keys:
        order, sigma, depth, parents = [], Counter({s: 1}), {s: 0}, {k: [] for k in keys}
        queue = [s]
        for v in queue:
            order.append(v)
            for w in out[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    sigma[w] += sigma[v]
                    parents[w].append(v)
        dep = Counter()
        for w in reversed(order):
            for v in parents[w]:
                dep[v] += sigma[v] / sigma[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    return score


def test_sampled_betweenness_keeps_its_bound(spark):
    """200 random repositories at once: exact, as many sources a repository, and within the stated error."""
    rnd, rows, want, sizes = random.Random(7), [], {}, {}
    for r in range(200):
        n = rnd.randint(2, 24)
        pairs = [(str(rnd.randrange(n)), str(rnd.randrange(n))) for _ in range(2 * n)]
        rows += [(f"r{r}", a, b, "x") for a, b in pairs]
        want |= {(f"r{r}", k): v for k, v in plain_betweenness([str(i) for i in range(n)], pairs).items()}
        sizes[f"r{r}"] = n
    nodes, edges = spark.createDataFrame(list(want), "repo_id string, key string").cache(), spark.createDataFrame(rows, E).cache()
    exact = {(r.repo_id, r.key): r.betweenness for r in graph.betweenness(nodes, edges, None).collect()}
    assert exact.keys() == want.keys() and all(abs(exact[k] - v) < 1e-6 for k, v in want.items())
    near = {(r.repo_id, r.key): r.betweenness for r in graph.betweenness(nodes, edges, error=0.45, doubt=0.1).collect()}
    off = {r for (r, k), v in near.items() if abs(v - want[r, k]) > 0.45 * sizes[r] * max(sizes[r] - 2, 0) + 1e-9}
    assert near != exact and len(off) <= 20


def test_every_repository_gets_its_sources(spark):
    """One path a-b-c-d in each repository: four sources are all of them."""
    edges = spark.createDataFrame([(f"r{i}", a, b, "x") for i in range(4) for a, b in ("ab", "bc", "cd")], E)
    nodes = spark.createDataFrame([(f"r{i}", k) for i in range(4) for k in "abcd"], "repo_id string, key string")
    got = {(r.repo_id, r.key): r.betweenness for r in graph.betweenness(nodes, edges, 4).collect()}
    assert got == {(f"r{i}", k): v for i in range(4) for k, v in zip("abcd", (0, 2, 2, 0))}


def test_mistyped_search_of_each_repository(spark):
    rows = [(r, k, 0.1) for r in ("r", "s") for k in ("m1/part_12.go", "m1/part_123.go", "x/other.go", "part_12", "m/prat_12", "m/q.go:art_12")]
    nodes = spark.createDataFrame(rows, "repo_id string, key string, pagerank double")
    got = [r.key for r in graph.node_search(nodes, "prat_12").where("repo_id = 'r'").collect()]
    assert sorted(got) == ["m/prat_12", "m/q.go:art_12", "m1/part_12.go", "part_12"]
    assert graph.node_search(nodes, "prat_12", limit=1).count() == 2 and graph.node_search(nodes, "z").count() == 0
    assert graph.node_search(nodes, "").count() == 12


def test_stream_batches_write_what_they_hold(spark, tmp_path):
    """A second batch of one file appends that file's rows only; loaded and compacted tables are equal."""
    schema = "repo_id string, path string, is_file boolean, ext string, content string, last_mod timestamp"
    row = lambda p, text, day: ("r", p, True, ".txt", text, datetime.datetime(2024, 1, day))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streams.stream_markers(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "state")).awaitTermination()

    load = lambda: sorted((r.file, r.type) for r in sinks.load_markers(spark, out).collect())
    mail = "write to jo@corp.io now"
    push([row(f"f{i}", mail, 1) for i in range(30)])
    before, stored = load(), spark.read.parquet(out).count()
    assert {f for f, _ in before} == {f"f{i}" for i in range(30)}
    push([row("f3", "clean", 2)])
    assert spark.read.parquet(out).count() == stored + 1  # only "no findings any more"
    after = load()
    assert after == [x for x in before if x[0] != "f3"]
    push([row("f3", mail, 3), row("g", mail, 3)])
    assert {f for f, _ in load()} == {f"f{i}" for i in range(30)} | {"g"}
    want = load()
    sinks.compact_markers(spark, out)
    assert load() == want and spark.read.parquet(out).where("type is not null").count() == len(want)
    push([row("f5", "clean", 4)])
    assert load() == [x for x in want if x[0] != "f5"]


def test_small_tables_of_code_are_dealt_over_all_tasks(spark):
    """A split of a file with few rows is a task's work of a thousand times its bytes."""
    from codequarry.plans.code import code_files

    d = "/root/testdata/sf0.001"
    assert spark.read.parquet(f"{d}/orders.parquet").rdd.getNumPartitions() == 1
    held = [r["count"] for r in code_files(spark, d).groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == 4 and min(held) > sum(held) / 8


def test_one_partner_is_found_without_matching_all():
    from codequarry.functions.masked import NEAR, Source

    rnd = random.Random(6)
    for n in [20] * 300 + [3 * NEAR] * 10:
        s = Source("".join(rnd.choice("()[]{} x") for _ in range(n)), ".js")
        near = {i: s.closing(i) for i, c in enumerate(s.code[:40]) if c in "([{"}
        assert near == {i: Source(s.code, ".js").partner.get(i) for i in near}
    s = Source("f(a, [b]) {" + "(" * 100_000, ".js")
    assert s.closing(1) == 8 and "_partner" not in vars(s)


def test_co_changes_of_commits_of_all_sizes(spark, monkeypatch):
    """Pairs from rows, from blocks and from both, pruned or not, by hashes or by names."""
    rnd = random.Random(8)
    sizes = [1, 2, 3, history.FEW - 1, history.FEW, history.FEW + 1, 2 * history.FEW, 60]
    commits = {str(i): rnd.sample([f"f{j}" for j in range(70)], s) for i, s in enumerate(sizes * 4)}
    rows = [(r, c, p) for r in "rs" for c, files in commits.items() for p in [*files, files[0]]] + [("r", None, "f1"), ("r", None, "f2"), ("r", "0", None)]
    table = spark.createDataFrame(rows, "repo_id string, commit_id string, path string")
    want = Counter(p for files in commits.values() for p in combinations(sorted(files), 2))
    for least in (1, 3):
        expected = {(r, *p): n for r in "rs" for p, n in want.items() if n >= least}
        for most in (history.RECURRING, 10):
            monkeypatch.setattr(history, "RECURRING", most)
            assert {(r.repo_id, r.a, r.b): r["count"] for r in history.co_changes(table, least, block=7).collect()} == expected


def test_commits_joined_by_their_ids_are_not_shuffled_again(spark):
    from codequarry.plans import projections as P

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = history.commit_sets(P.commits(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 4  # orders and customers by customer, orders and lines by commit


def test_links_and_edges_are_read_once(spark):
    """What makes them may be a join of all commits."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    links = spark.createDataFrame([("r", a, b, 1) for a, b in ("ab", "ac", "bc", "ca")], "repo_id string, source string, target string, edge_count long")
    modules = spark.createDataFrame([("r", m, 0.5) for m in "abc"], "repo_id string, module string, avg_pagerank double")
    assert graph.module_dependency_matrix(links.withColumn("source", seen("source")), modules).count() == 3 and read.value == 4
    nodes = spark.createDataFrame([("r", k) for k in "abcd"], "repo_id string, key string")
    edges = spark.createDataFrame([("r", a, b) for a, b in ("ab", "bc", "cd")], "repo_id string, src string, dst string")
    read.value = 0
    assert graph.community_count(graph.communities(nodes, edges.withColumn("src", seen("src")))).first().communities == 2
    assert read.value <= 6  # as source and as target
