"""Readers: file trees, commit logs, coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import col, ext_of
from ..storage import many_files

COBERTURA = (
    "packages struct<package: array<struct<classes: struct<class: array<struct<_filename: string, `_line-rate`: double>>>>>>"
)
CLOVER = "file array<struct<_name: string, metrics: struct<_coveredstatements: int, _statements: int>>>"


def read_repo_files(spark: SparkSession, root: str, repo_id: str | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """All files below ``root`` with content (UTF-8), size and time; ignored paths are dropped before content is read."""
    raw = many_files(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    rows = raw.select(repository_id(F.lit(root) if repo_id is None else F.lit(repo_id), repo_id is None).alias("repo_id"), path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("last_mod"))
    if patterns is not None:
        rows = ignore_filter(rows, patterns)
    return rows.select("repo_id", "path", F.lit(True).alias("is_file"), ext_of("path").alias("ext"), F.decode("content", "UTF-8").alias("content"), "size", "last_mod")


def repository_id(path: Column, derive: bool = True) -> Column:
    """The first twelve digits of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 12) if derive else path


def ignore_filter(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Drop paths that match any regular expression of ``patterns(pattern)`` (a short list, checked: at most 10 000 patterns).

    The list is folded into one literal expression, so the filter needs no join and reaches the scan.
    """
    few = [r.pattern for r in patterns.select("pattern").limit(10_001).collect()]
    if len(few) > 10_000:
        raise ValueError("the ignore list is meant to be a short list")
    return files.where(~F.col("path").rlike("|".join(f"(?:{x})" for x in few))) if few else files


def normalize_rename(path: str | Column) -> Column:
    """``p{a => b}s`` becomes ``pbs``, ``a => b`` becomes ``b``."""
    braced = F.regexp_replace(col(path), r"^(.*)\{[^{}]* => ([^}]*)\}(.*)$", "$1$2$3")
    plain = F.regexp_replace(col(path), r"^.*? => ", "")
    return F.when(col(path).rlike(r"\{[^{}]* => [^}]*\}"), braced).when(col(path).contains(" => "), plain).otherwise(col(path))


def read_commit_log(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """``commits`` from a log dump: records end at 0x1e, the first line holds email 0x1f seconds, then paths.

    A record with a bad header drops its paths.
    """
    return parse_commit_log(spark.read.option("lineSep", "\x1e").text(path), repo_id)


def parse_commit_log(records: DataFrame, repo_id: str) -> DataFrame:
    lines = F.split(F.regexp_replace("value", r"^\s+", ""), "\r?\n")
    head = F.split(lines[0], "\x1f")
    rows = records.select(F.sha2("value", 256).alias("commit_id"), F.get(head, F.lit(0)).alias("email"), F.get(head, F.lit(1)).try_cast("bigint").alias("s"), F.explode(F.slice(lines, 2, 2_000_000_000)).alias("p"))
    rows = rows.where("s is not null and email <> ''").withColumn("p", F.trim("p")).where("p <> ''")
    return rows.select(F.lit(repo_id).alias("repo_id"), "commit_id", "email", F.timestamp_seconds("s").alias("ts"), normalize_rename("p").alias("path"))


def detect_coverage_format(text: str | Column) -> Column:
    """By content: lcov, cobertura, clover, else null."""
    c = col(text)
    return F.when(c.contains("SF:"), "lcov").when(c.contains("line-rate"), "cobertura").when(c.contains("<clover"), "clover")


def parse_lcov(reports: DataFrame) -> DataFrame:
    """(repo_id, key, pct) from whole reports (repo_id, value, and report if they have names); no lines give 0.

    Of a path's records in a report the last wins; of several reports, the one with the last name (without names, the
    greatest hash of its text). Reports are cut into records before any grouping, so lines of two reports never mix.
    """
    name = F.col("report") if "report" in reports.columns else F.sha2("value", 256)
    cut = F.split("value", r"(?dm)^(?=SF:)|^end_of_record\r*$")
    records = reports.select("repo_id", name.alias("report"), F.posexplode(cut).alias("rec", "record")).where(F.col("record").startswith("SF:"))
    lines = F.transform(F.split("record", "\n"), lambda x: F.regexp_replace(x, "\r+$", ""))
    records = records.select("repo_id", "report", "rec", lines.alias("lines"))
    da = F.filter("lines", lambda x: x.startswith("DA:") & x.contains(","))
    hit = F.filter("da", lambda x: F.regexp_extract(x, "^DA:[^,]*,(.*)$", 1).try_cast("bigint") > 0)
    per = records.select("repo_id", "report", "rec", F.substring(F.col("lines")[0], 4, 2_000_000_000).alias("key"), da.alias("da"))
    pct = F.when(F.size("da") > 0, F.size(hit) / F.size("da") * 100.0).otherwise(0.0)
    per = per.where("key <> ''").select("repo_id", "report", "rec", "key", pct.alias("pct"))
    return per.groupBy("repo_id", "key").agg(F.max_by("pct", F.struct("report", "rec")).alias("pct"))


def read_lcov(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    return parse_lcov(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("report"), F.lit(repo_id).alias("repo_id")))


def _report() -> list[Column]:
    """Which report an element comes from, and its place there."""
    return [F.col("_metadata.file_path").alias("report"), F.monotonically_increasing_id().alias("element")]


def _last() -> Column:
    return F.struct("report", "element", "pos")


def read_cobertura(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """Classes with a file name; of equal names the last in the report with the last name wins; broken XML gives no rows."""
    rows = spark.read.format("xml").option("rowTag", "coverage").schema(COBERTURA).load(path)
    c = rows.select(*_report(), F.posexplode(F.flatten(F.transform("packages.package", lambda p: p["classes"]["class"]))).alias("pos", "c"))
    c = c.where("c._filename <> ''")
    return c.groupBy(F.lit(repo_id).alias("repo_id"), F.col("c._filename").alias("key")).agg(F.max_by(F.col("c")["_line-rate"] * 100.0, _last()).alias("pct"))


def read_clover(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """Files directly below the project (files inside packages are not read); of equal names the last in the report with the last name wins."""
    rows = spark.read.format("xml").option("rowTag", "project").schema(CLOVER).load(path)
    f = rows.select(*_report(), F.posexplode("file").alias("pos", "f")).where("f._name <> ''")
    n, hit = F.col("f.metrics._statements"), F.col("f.metrics._coveredstatements")
    pct = F.when(n > 0, hit / n * 100.0).otherwise(0.0)
    return f.groupBy(F.lit(repo_id).alias("repo_id"), F.col("f._name").alias("key")).agg(F.max_by(pct, _last()).alias("pct"))


def load_coverage(spark: SparkSession, path: str, repo_id: str, explicit: bool = True) -> DataFrame | None:
    """Read one report by its content; an explicit path with an unknown format is an error."""
    head = spark.read.text(path, wholetext=True).select(detect_coverage_format("value").alias("f")).first()
    kind = head and head.f
    if kind is None:
        if explicit:
            raise ValueError(f"unrecognised coverage format (expected lcov, cobertura or clover): {path}")
        return None
    return {"lcov": read_lcov, "cobertura": read_cobertura, "clover": read_clover}[kind](spark, path, repo_id)
