"""Stored findings, streams and shared storage."""

import pytest
from pyspark.sql import functions as F

from codequarry import storage
from codequarry.operators import graph, rules, security
from codequarry.sources import files as src
from codequarry.sources import sinks
from codequarry.streaming import streams

M = "repo_id string, file string, type string, severity string, message string, line int, deduction double, category string, suggestion string"


def findings(spark, *rows):
    return spark.createDataFrame([(r, f, t, "low", "", 1, 0.1, "", "") for r, f, t in rows], M)


def stored(spark, path):
    return {(r.repo_id, r.file, r.type) for r in sinks.load_markers(spark, path).collect()}


def test_findings_of_a_repository_can_vanish(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.write_markers(findings(spark, ("001", "a", "x"), ("2", "b", "x"), ("3", "c", "x")), path)
    assert stored(spark, path) == {("001", "a", "x"), ("2", "b", "x"), ("3", "c", "x")}
    sinks.write_markers(findings(spark, ("2", "b", "y")), path, spark.createDataFrame([("001",), ("2",)], "repo_id string"))
    assert stored(spark, path) == {("2", "b", "y"), ("3", "c", "x")}


def test_a_run_writes_as_many_files_as_it_has_tasks(spark, tmp_path):
    path = tmp_path / "m of all"
    many = spark.range(0, 300, numPartitions=3).selectExpr("cast(id as string) repo_id", "'a' file", "'x' type", "'low' severity", "'' message", "1 line", "0.1D deduction", "'' category", "'' suggestion")
    sinks.write_markers(many, str(path))
    assert len(list(path.rglob("*.parquet"))) == 3
    sinks.write_markers(many.where("repo_id = '7'").withColumn("file", F.lit("b")), str(path), spark.createDataFrame([("8",)], "repo_id string"))
    want = {(str(i), "b" if i == 7 else "a", "x") for i in range(300) if i != 8}
    assert stored(spark, str(path)) == want
    before = set(path.rglob("*.parquet"))
    sinks.compact_markers(spark, str(path))
    assert stored(spark, str(path)) == want and not before & set(path.rglob("*.parquet"))


def test_a_run_also_replaces_versions_of_files(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.append_markers(findings(spark, ("r", "a", "x"), ("r", "b", "x"), ("s", "c", "x")), findings(spark, ("r", "a", ""), ("r", "b", ""), ("s", "c", "")), path)
    sinks.write_markers(findings(spark, ("r", "b", "y"), ("r", "d", "y")), path)
    assert stored(spark, path) == {("r", "b", "y"), ("r", "d", "y"), ("s", "c", "x")}
    sinks.append_markers(findings(spark, ("r", "b", "z")), findings(spark, ("r", "b", ""), ("s", "c", "")), path)
    assert stored(spark, path) == {("r", "b", "z"), ("r", "d", "y")}


def test_folders_hold_what_partitions_hold(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", 1, "x"), ("a/b", 1, "y"), ("a=c d", 2, "é"), (None, 3, None), ("", 3, "z"), ("%", None, "w\nv")] + [("many", i, str(i)) for i in range(300)], "t string, n long, value string")
    sinks.write_folders(rows, str(tmp_path / "f"), "t", "n")
    sinks.write_folders(rows, f"file://{tmp_path}/f", "t", "n")  # again, over the first
    rows.write.partitionBy("t", "n").text(str(tmp_path / "p"))

    def held(top):
        out = {}
        for f in top.rglob("*.txt"):
            out.setdefault(str(f.parent.relative_to(top)), []).extend(f.read_text().split("\n")[:-1])
        return {k: sorted(v) for k, v in out.items()}

    assert held(tmp_path / "f") == held(tmp_path / "p") and len(held(tmp_path / "f")) == 304


def test_trees_of_many_small_files_are_few_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("id % 50 as a", "id as b", "'x' as value")
    sinks.write_folders(rows, str(tmp_path), "a", "b")
    names = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    files = src.read_repo_files(spark, str(tmp_path), "r")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    stages = [names.getStageInfo(s) for j in names.getJobIdsForGroup("listing") for s in names.getJobInfo(j).stageIds]
    assert stages and all(s.numTasks <= 16 for s in stages)
    assert files.rdd.getNumPartitions() <= 8 and files.count() == 400


def test_a_second_batch_keeps_other_files(spark, tmp_path):
    kind = "repo_id string, path string, is_file boolean, ext string, content string, last_mod timestamp"
    bad, good = "id 123456789012 here", "nothing here"

    def feed(*rows):
        rows = spark.createDataFrame([(r, p, True, ".txt", c, t) for r, p, c, t in rows], "repo_id string, path string, is_file boolean, ext string, content string, last_mod string")
        rows.withColumn("last_mod", F.col("last_mod").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        streams.stream_markers(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return {(r, f) for r, f, t in stored(spark, str(tmp_path / "out")) if t == "dpdp_pii_exposure"}

    assert feed(("r", "a", bad, "2001-01-01"), ("r", "b", bad, "2001-01-01"), ("s", "c", bad, "2001-01-01")) == {("r", "a"), ("r", "b"), ("s", "c")}
    assert feed(("r", "a", bad, "2001-01-02"), ("r", "a", good, "2001-01-03")) == {("r", "b"), ("s", "c")}
    assert feed(("s", "c", good, "2001-01-04"), ("s", "d", bad, "2001-01-04")) == {("r", "b"), ("s", "d")}


def test_shared_folder(spark):
    assert storage.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert spark.sparkContext.applicationId in storage.shared_dir(spark, "x")


def test_long_ignore_lists_are_refused(spark):
    f = spark.createDataFrame([("a.py",), ("b.md",)], "path string")
    assert [r.path for r in src.ignore_filter(f, spark.createDataFrame([(r"\.md$",)], "pattern string")).collect()] == ["a.py"]
    with pytest.raises(ValueError, match="short"):
        src.ignore_filter(f, spark.range(10_002).select(F.col("id").cast("string").alias("pattern")))


def test_long_paths_and_long_bodies(spark):
    edges = spark.createDataFrame([("r", f"n{i:03}", f"n{i + 1:03}", "calls") for i in range(14)], "repo_id string, src string, dst string, rel string")
    assert graph.shortest_path(edges, "n000", "n014").first().distance == 14
    assert graph.shortest_path(edges, "n014", "n000").count() == 0
    assert graph.shortest_path(edges, "n000", "n014", 5).count() == 0
    nodes = spark.createDataFrame([("r", f"n{i:03}") for i in range(15)], "repo_id string, key string")
    got = {r.key: r.betweenness for r in graph.betweenness(nodes, edges, None).collect()}
    assert got == {f"n{i:03}": i * (14 - i) for i in range(15)}
    text = "items.map(x => { " + "skip(1); " * 500 + "total = x })"
    files = spark.createDataFrame([("r", "a.ts", ".ts", text)], "repo_id string, path string, ext string, content string")
    assert [r.name for r in security.security_symbols(files).collect()] == ["async_race_condition"]


def test_hot_files(spark):
    import datetime as dt

    at = dt.datetime(2001, 7, 20)
    files = spark.createDataFrame([("r", "a", 9, at), ("r", "b", 8, at), ("r", "c", 7, at), ("r", "d", 99, dt.datetime(2001, 1, 1))], "repo_id string, path string, commits long, last timestamp")
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "a", "d")], "repo_id string, src string, dst string")
    assert [(r.src, r.dst) for r in graph.hot_files(files, edges, limit=2).collect()] == [("a", "b")]


def test_hubs_keep_their_totals(spark):
    edges = spark.createDataFrame([("r", f"c{i:03}", "hub", "calls") for i in range(120)], "repo_id string, src string, dst string, rel string")
    hub = graph.callers_callees(edges).where("key = 'hub'").first()
    assert hub.total == 120 and hub.truncated and hub.others == [f"c{i:03}" for i in range(50)]


def test_advice_is_filled_in(spark, tmp_path):
    sinks.write_markers(findings(spark, ("r", "a", "dead_code"), ("r", "b", "unknown")), str(tmp_path / "m"))
    got = {r.file: r.suggestion for r in sinks.load_markers(spark, str(tmp_path / "m")).collect()}
    assert got == {"a": rules.SUGGESTIONS["dead_code"], "b": ""}
