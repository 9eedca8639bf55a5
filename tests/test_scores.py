"""Scores, history findings, coverage and planning on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.operators import clones, coverage, history, increments, planning, scoring
from codequarry.schemas import Params
from codequarry.sources import files as src
from codequarry.sources import sinks

M = "repo_id string, file string, type string, severity string, message string, line int, deduction double, category string"
NOW = dt.datetime(2024, 1, 1)
P = Params(as_of=NOW)


def markers(spark, *rows):
    return spark.createDataFrame([("r", f, "t", "low", "", 0, d, c) for f, d, c in rows], M)


@pytest.mark.parametrize(
    ("rows", "final"),
    [
        ([("a", 1.0, "duplication")], 9.0),
        ([("a", 3.0, "duplication")], 8.5),
        ([("a", 30.0, "other")], 1.0),
        ([("a", 9.0, "structural_complexity"), ("a", 9.0, "size_api_complexity"), ("a", -4.0, "duplication")], 4.5),
        ([("a", 0.0, "")], 10.0),
    ],
)
def test_file_score(spark, rows, final):
    s = scoring.file_score(markers(spark, *rows)).first()
    assert s.final == final and s.marker_count == len(rows)


def test_repo_score(spark):
    f = spark.createDataFrame([("r", "a", True), ("r", "b", True)], "repo_id string, path string, is_file boolean")
    s = scoring.file_score(markers(spark, ("a", 4.0, "other")))
    ranks = spark.createDataFrame([("r", "a", 3.0)], "repo_id string, path string, pagerank double")
    zero = spark.createDataFrame([("r", "a", 0.0)], "repo_id string, path string, pagerank double")
    assert scoring.repo_score(f, s, ranks).first().score == 6.0
    assert scoring.repo_score(f, s, zero).first().score == 8.0
    assert scoring.repo_score(f, s).first().score == 8.0
    assert scoring.repo_score(f, s, marked_only=True).first().score == 6.0


def test_composite_health(spark):
    facts = spark.createDataFrame([(50.0, 0.8, 1, 100, 1, 100, 1, 10), (0.0, 0.0, 0, 10, 0, 10, 0, 0)], "doc_coverage_pct double, freshness_score double, dead_export_count int, symbol_count int, hotspot_count int, total_files int, silo_count int, total_modules int")
    got = [(r.score, r.index_only) for r in scoring.composite_health(facts).collect()]
    assert got == [(78, False), (100, True)]


def commit(c, who, day, path="a"):
    return ("r", c, who, NOW - dt.timedelta(days=day), path)


def test_one_commit(spark):
    m = history.file_metrics(spark.createDataFrame([commit("1", "x", 1)], "repo_id string, commit_id string, email string, ts timestamp, path string"), P).first()
    assert (m.churn, m.ownership, m.author_count, m.primary_author) == (1, 1.0, 1, "x")


def test_metrics_ties_and_organisation(spark):
    rows = [commit(str(i), who, day) for i, (who, day) in enumerate([("b", 200), ("a", 300), ("a", 190), ("b", 210), ("c", 10), ("c2", 9), ("c3", 8), ("c4", 7), ("c5", 6)])]
    c = spark.createDataFrame([*rows, rows[0]], "repo_id string, commit_id string, email string, ts timestamp, path string")
    m = history.file_metrics(c, P)
    r = m.first()
    assert (r.churn, r.primary_author, r.author_count) == (9, "a", 5)
    f = spark.createDataFrame([("r", "a", True)], "repo_id string, path string, is_file boolean").join(m, ["repo_id", "path"])
    got = {x.type: x.message for x in history.organisation_markers(f, P).collect()}
    assert got["knowledge_loss"].endswith("was 190 days ago on a high-churn file") and "5 distinct authors" in got["developer_congestion"]


def test_bus_factor_and_co_changes(spark):
    rows = [commit("1", "x", 1), commit("2", "y", 1), commit("3", "z", 1), commit("1", "x", 1, "b"), commit("2", "y", 1, "b")]
    c = spark.createDataFrame(rows, "repo_id string, commit_id string, email string, ts timestamp, path string")
    assert {r.path: r.bus_factor for r in history.bus_factor(c).collect()} == {"a": 2, "b": 1}
    assert [(r.a, r.b, r["count"]) for r in history.co_changes(c, 2).collect()] == [("a", "b", 2)]


def test_co_changes_of_a_large_commit_equal_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from codequarry.plans import projections

    rows = [commit("big", "x", 1, f"f{i}") for i in range(300)] + [commit("big2", "y", 2, f"f{i}") for i in range(0, 500, 2)] + [commit("s", "z", 3, p) for p in ("f1", "f2", "g")]
    c = spark.createDataFrame([*rows, rows[0]], "repo_id string, commit_id string, email string, ts timestamp, path string")
    con = duckdb.connect()
    con.execute("CREATE TABLE commits (repo_id VARCHAR, commit_id VARCHAR, path VARCHAR)")
    con.executemany("INSERT INTO commits VALUES (?, ?, ?)", [(r[0], r[1], r[4]) for r in rows])
    want = con.execute(f"WITH {projections.SQL['cochange']} SELECT * FROM cochange").fetchall()
    for got in (history.co_changes(c, 2), history.co_changes(c, 2, block=7)):
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert len(want) == 150 * 149 // 2 + 1 and history.co_changes(c, 2, most_files=200).count() == 0


def test_lcov_reports_do_not_mix(spark, tmp_path):
    one = "TN:\nSF:a.go\nDA:1,1\nDA:2,1\nDA:3,0\nend_of_record\nSF:c.go\nDA:1,x\nDA:2,4\nend_of_record\nDA:7,7\n"
    two = "SF:b.go\r\nDA:1,0\r\nend_of_record\r\nSF:c.go\r\nDA:1,0\r\nSF:d.go\nDA:1,2\nDA:2,2\nDA:3,2\nDA:4,0\n"
    want = {"a.go": 66.67, "b.go": 0.0, "c.go": 0.0, "d.go": 75.0}
    (tmp_path / "1.info").write_bytes(one.encode())
    (tmp_path / "2.info").write_bytes(two.encode())
    assert {r.key: round(r.pct, 2) for r in src.read_lcov(spark, str(tmp_path), "r").collect()} == want
    df = spark.createDataFrame([("r", one), ("r", two)], "repo_id string, value string")
    assert {r.key: round(r.pct, 2) for r in src.parse_lcov(df).collect() if r.key != "c.go"} == {k: v for k, v in want.items() if k != "c.go"}


def test_clone_pair(spark):
    text = "func a() { one two three four five six }"
    rows = [("r", p, True, ".go", text, NOW, i) for i, p in enumerate(("z.go", "a.go", "m.go"))]
    f = spark.createDataFrame(rows, "repo_id string, path string, is_file boolean, ext string, content string, last_mod timestamp, seq int")
    got = sorted((r.file, r.line, r.deduction, r.message) for r in clones.dry_violations(f, "seq", P).collect())
    assert [(g[0], g[2]) for g in got] == [("a.go", 1.5), ("m.go", 1.5)]
    assert all("similar code to 'z.go'" in g[3] for g in got)


def test_coverage_match(spark):
    f = spark.createDataFrame([("r", p) for p in ("src/a.go", "b.go", "x/y/c.go", "d.go", "e/f.go")], "repo_id string, path string")
    keys = [("src/a.go", 1.0), ("/home/src/a.go", 2.0), ("/w/b.go", 3.0), ("c.go", 4.0), ("y/c.go", 5.0), ("p/d.go", 6.0), ("q/d.go", 7.0), ("g.go", 8.0)]
    c = spark.createDataFrame([("r", k, v) for k, v in keys], "repo_id string, key string, pct double")
    got = {r.path: (r.pct, r.ambiguous) for r in coverage.match_coverage(f, c).collect()}
    assert got == {"src/a.go": (1.0, False), "b.go": (3.0, False), "x/y/c.go": (5.0, False), "d.go": (6.0, True)}


def test_reports(spark, tmp_path):
    (tmp_path / "lcov.info").write_text("SF:test.go\nDA:1,5\nDA:2,5\nDA:3,0\nend_of_record\nDA:9,9\nSF:other.go\nDA:1,0\nDA:2,10\nend_of_record\nSF:none.go\nend_of_record\n")
    (tmp_path / "coverage.xml").write_text('<?xml version="1.0"?><coverage line-rate="0.7"><packages><package><classes><class filename="main.go" line-rate="0.75"/><class filename="util.go" line-rate="0.5"/></classes></package></packages></coverage>')
    (tmp_path / "clover.xml").write_text('<?xml version="1.0"?><coverage><clover/><project><file name="handler.go"><metrics coveredstatements="8" statements="10"/></file><package><file name="no.go"><metrics coveredstatements="1" statements="1"/></file></package></project></coverage>')
    load = lambda n: {r.key: round(r.pct, 2) for r in src.load_coverage(spark, str(tmp_path / n), "r").collect()}
    assert load("lcov.info") == {"test.go": 66.67, "other.go": 50.0, "none.go": 0.0}
    assert load("coverage.xml") == {"main.go": 75.0, "util.go": 50.0}
    assert load("clover.xml") == {"handler.go": 80.0}
    (tmp_path / "odd").write_text("what")
    with pytest.raises(ValueError):
        src.load_coverage(spark, str(tmp_path / "odd"), "r")


def test_commit_log_and_renames(spark, tmp_path):
    (tmp_path / "log").write_text("a@x\x1f100\n\nsrc/{old => new}/f.go\nb.go => c.go\n\x1ebad\nx.go\n\x1eb@x\x1fnope\ny.go\n\x1e")
    got = sorted((r.email, r.path) for r in src.read_commit_log(spark, str(tmp_path / "log"), "r").collect())
    assert got == [("a@x", "c.go"), ("a@x", "src/new/f.go")]


def test_read_files_and_ignore(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.go").write_text("package p")
    (tmp_path / "skip.log").write_text("x")
    pats = spark.createDataFrame([(r"\.log$",)], "pattern string")
    r = src.read_repo_files(spark, str(tmp_path), "r", pats).collect()
    assert [(x.path, x.ext, x.content, x.size) for x in r] == [("pkg/a.go", ".go", "package p", 9)]


@pytest.mark.parametrize(
    ("name", "expected"),
    [("a_test.go", True), ("a.go", False), ("FooTest.java", True), ("test_a.py", True), ("a_spec.rb", True), ("a.spec.ts", True), ("ASpec.kt", True), ("a.tftest.hcl", True), ("test_x.c", True), ("test_noext", False)],
)
def test_test_names(spark, name, expected):
    assert spark.range(1).select(paths.is_test_filename(F.lit("d/" + name)).alias("x")).first().x is expected


@pytest.mark.parametrize(("path", "expected"), [("Jenkinsfile", True), (".github/workflows/a.yml", True), ("ci/x.yaml", True), ("my-ci/x.yml", True), ("src/x.yml", False), ("ci/x.go", False), ("x.yml", False)])
def test_ci_paths(spark, path, expected):
    assert spark.range(1).select(paths.is_ci_path(F.lit(path)).alias("x")).first().x is expected


def test_prices_and_tiers(spark):
    names = ["gpt-4o-mini-x", "gpt-4", "gpt-4o", "unknown", "claude-3-opus-2024"]
    m = spark.createDataFrame([(n,) for n in names], "model string")
    got = {r.model: r.input for r in planning.price_models(m, planning.prices(spark)).collect()}
    assert got == {"gpt-4o-mini-x": 0.15, "gpt-4": 10.0, "gpt-4o": 2.5, "unknown": 0.0, "claude-3-opus-2024": 15.0}
    tiers = {r.tier: r.models for r in planning.bucket_models_by_tier(m).collect()}
    assert tiers == {"premium": ["claude-3-opus-2024"], "medium": ["gpt-4o", "gpt-4o-mini-x"]}


def test_plan_prompts(spark):
    f = spark.createDataFrame([("r", "d/a.go", True, "l1\nl2\n", 8)], "repo_id string, path string, is_file boolean, content string, size long")
    pages = planning.plan_module_pages(f).unionByName(planning.plan_singletons(f))
    pages = pages.unionByName(spark.createDataFrame([("r", "file_page:d/a.go", "file_page", "d/a.go", 1)], pages.schema))
    m = spark.createDataFrame([("r", "d/a.go", "x", "low", "msg", 1, 0.0, "")], M)
    labels = spark.createDataFrame([("r", 0), ("r", 1)], "repo_id string, community_id long")
    got = {r.page_id: r.prompt for r in planning.assemble_prompts(pages, f, m, labels).collect()}
    assert "```\nl1\nl2\n```" in got["file_page:d/a.go"] and "- x (low): msg" in got["file_page:d/a.go"]
    assert "2 detected communities" in got["architecture_diagram:root"] and "found 1 health markers" in got["repo_overview:root"]
    assert got["module_page:d"].startswith("Write markdown documentation for the module/package at path: d")


def test_snapshots_and_merges(spark, tmp_path):
    a = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1"), ("r", "c", "1")], "repo_id string, path string, content string")
    b = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "d", "1")], "repo_id string, path string, content string")
    assert {(r.path, r.change) for r in increments.changed_files(a, b).collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}
    old = spark.createDataFrame([("1", "n", "c0"), ("2", "m", "c0")], "id string, name string, created_at string")
    new = spark.createDataFrame([("1", "n2", "c1"), ("3", "k", "c1")], "id string, name string, created_at string")
    assert {tuple(r) for r in sinks.upsert_repositories(old, new).collect()} == {("1", "n2", "c0"), ("2", "m", "c0"), ("3", "k", "c1")}
    path = str(tmp_path / "markers")
    one = spark.createDataFrame([("r1", "a", ""), ("r2", "a", "")], "repo_id string, type string, suggestion string")
    sinks.write_markers(one, path)
    sinks.write_markers(spark.createDataFrame([("r1", "dead_code", "")], one.schema), path)
    got = {(r.repo_id, r.type, r.suggestion[:6]) for r in sinks.load_markers(spark, path).collect()}
    assert got == {("r1", "dead_code", "Remove"), ("r2", "a", "")}


def test_streams(spark, tmp_path):
    from codequarry.streaming import streams

    rows = [(dt.datetime(2024, 1, 1, h), "p", "x") for h in (1, 2, 9)]
    spark.createDataFrame(rows, "ts timestamp, path string, email string").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("ts timestamp, path string, email string").parquet(str(tmp_path / "in"))
    churn = streams.run_to_memory(streams.stream_file_churn(read()), "churn", str(tmp_path / "c1"), "complete")
    assert [r.commits for r in churn.collect()] == [3]
    sess = streams.run_to_memory(streams.stream_author_sessions(read()), "sessions", str(tmp_path / "c2"), "append")
    assert sess.count() in (0, 1, 2)  # sessions close when the watermark passes them
    whole = streams.stream_author_sessions(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(r.commits for r in whole.collect()) == [1, 2]
