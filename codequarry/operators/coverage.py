"""Line coverage: matching report keys to paths, coverage findings, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_filename
from ..schemas import Params
from .rules import fired, marker


def _suffixes(text: str) -> Column:
    """The parts of a path behind each of its '/', longest first."""
    tail = lambda i: F.call_function("substring_index", F.col(text), F.lit("/"), -i)
    depth = F.size(F.split(text, "/"))
    return F.when(depth > 1, F.transform(F.sequence(depth - 1, F.lit(1)), tail))


def coverage_candidates(files: DataFrame, coverage: DataFrame) -> DataFrame:
    """(repo_id, path, len, pct, ambiguous): for each path its exact key, the best longer key and each shorter one that end alike.

    Suffixes at '/' are exploded and joined as whole strings with whole strings, so there are at most as many rows as
    paths and keys have folders, however many files share a name. Keys with one suffix become one row (the longest, how many
    of them, the smallest) before they meet a path.
    """
    norm = lambda c: F.regexp_replace(c, r"\\", "/")
    keys = coverage.where("key is not null").groupBy("repo_id", "key").agg(F.min("pct").alias("pct")).withColumn("k", norm("key")).withColumn("len", F.octet_length("key"))
    paths = files.select("repo_id", "path", norm("path").alias("p")).where("path is not null").distinct()

    def best(rows: DataFrame, name: str) -> DataFrame:
        same = rows.groupBy("repo_id", name, "len").agg(F.min_by("pct", "key").alias("pct"), (F.count("*") > 1).alias("ambiguous"))
        return same.groupBy("repo_id", name).agg(F.max_by(F.struct("len", "pct", "ambiguous"), "len").alias("b"))

    exact = paths.join(keys.withColumnRenamed("key", "path"), ["repo_id", "path"]).select("repo_id", "path", F.struct(F.lit(1 << 30).alias("len"), "pct", F.lit(False).alias("ambiguous")).alias("b"))
    longer = paths.join(best(keys.withColumn("p", F.explode(_suffixes("k"))), "p"), ["repo_id", "p"])
    shorter = paths.withColumn("k", F.explode(_suffixes("p"))).join(best(keys.where(F.contains("k", F.lit("/"))), "k"), ["repo_id", "k"])
    columns = "repo_id", "path", "b"
    return exact.select(*columns).unionByName(longer.select(*columns)).unionByName(shorter.select(*columns)).select("repo_id", "path", "b.*")


def match_coverage(files: DataFrame, coverage: DataFrame) -> DataFrame:
    """(repo_id, path, pct, ambiguous): exact key first, else the longest key that matches as a suffix at '/'.

    Either string may be the longer one, but a key without '/' never matches a longer path.
    Ambiguous: two keys of the winning length; the smaller one is taken, and of equal keys the smaller percentage.
    """
    best = coverage_candidates(files, coverage).groupBy("repo_id", "path").agg(F.max_by(F.struct("pct", "ambiguous"), "len").alias("b"))
    return best.select("repo_id", "path", "b.*")


def coverage_markers(files: DataFrame, matched: DataFrame, nodes: DataFrame, threshold: DataFrame, p: Params = Params()) -> DataFrame:
    """untested_hotspot, else coverage_gap; test files are left out."""
    rows = files.where("coalesce(is_file, true)").where(~is_test_filename("path")).join(matched.select("repo_id", "path", "pct"), ["repo_id", "path"])
    rows = rows.join(nodes.where("node_type = 'file'").select("repo_id", "path", "pagerank"), ["repo_id", "path"], "left")
    rows = rows.join(threshold.select("repo_id", F.col("value").alias("least")), "repo_id", "left")
    top = (F.col("least") > 0) & (F.col("pagerank") >= F.col("least"))
    hot = F.coalesce((F.col("churn") >= p.untested_churn) & (F.col("pct") < p.untested_below) & top, F.lit(False))
    gap = (p.gap_below - F.col("pct")) / p.gap_below * p.gap_deduction
    found = F.when(hot, marker("untested_hotspot", "high", "High-churn, high-PageRank file has < 20% line coverage", deduction=p.untested_deduction, category="test_coverage")).when(
        F.col("pct") < p.gap_below, marker("coverage_gap", "medium", "File has < 60% line coverage", deduction=gap, category="test_coverage")
    )
    return fired(rows, "path", [found])


def uncovered_ranges(lines: DataFrame, shown: int = 20) -> DataFrame:
    """Gaps of (repo_id, path, total_lines, covered array): ranges as text, the first ``shown`` and how many more.

    A gap lies between two neighbours of the sorted covered lines (with 0 and the line behind the last one), so a file stays one row.
    """
    last = F.greatest("total_lines", F.lit(1))
    inside = F.filter(F.coalesce("covered", F.array().cast("array<int>")), lambda x: (x >= 1) & (x <= last))
    fence = F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0)), inside, F.array((last + 1).cast("int")))))
    rows = lines.select("repo_id", "path", fence.alias("f"))
    gaps = F.zip_with(F.slice("f", 1, F.size("f") - 1), F.slice("f", 2, F.size("f") - 1), lambda a, b: F.struct((a + 1).alias("a"), (b - 1).alias("b")))
    per = rows.select("repo_id", "path", F.filter(gaps, lambda g: g["a"] <= g["b"]).alias("r")).where(F.size("r") > 0)
    text = F.transform(F.slice("r", 1, shown), lambda x: F.when(x["a"] == x["b"], x["a"].cast("string")).otherwise(F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"))))
    return per.select("repo_id", "path", F.array_join(text, ", ").alias("ranges"), F.greatest(F.size("r") - shown, F.lit(0)).alias("more"))


def coverage_rollup(lines: DataFrame) -> DataFrame:
    """Covered and total lines by top folder of (repo_id, path, covered_lines, total_lines)."""
    out = lines.groupBy("repo_id", F.substring_index("path", "/", 1).alias("module")).agg(F.sum("covered_lines").alias("covered_lines"), F.sum("total_lines").alias("total_lines"))
    return out.withColumn("pct", F.coalesce(F.try_divide(100.0 * F.col("covered_lines"), F.col("total_lines")), F.lit(0.0)))
