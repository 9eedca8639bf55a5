"""Stored tables: findings by repository, merges with earlier state, exports."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import col
from ..operators.rules import SUGGESTIONS
from ..schemas import MARKERS
from ..storage import open_fs, remove


#: The columns of stored findings besides their own: when they were written, and the same if all of their repository was.
LOG = "version bigint, run bigint"


def write_markers(markers: DataFrame, path: str, repositories: DataFrame | None = None) -> None:
    """Replace the findings of the repositories in ``markers`` and in ``repositories`` (repo_id); other repositories keep theirs.

    A run is appended as a whole and ``load_markers`` shows each repository's last one, so a write takes as many files as it
    has tasks, however many repositories there are; ``compact_markers`` removes what is replaced. A repository of
    ``repositories`` without findings loses its old ones: each gets one empty row, which ``load_markers`` leaves out.
    """
    if repositories is not None:
        markers = markers.unionByName(repositories.select("repo_id").distinct(), allowMissingColumns=True)
    now = F.lit(time.time_ns())
    markers.withColumns({"version": now, "run": now}).write.mode("append").parquet(path)


def _log_mark(spark: SparkSession, path: str):
    """(file system, name) of the sign that a table holds appended versions of files."""
    name = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def append_markers(markers: DataFrame, files: DataFrame, path: str) -> None:
    """Append new versions of the findings of ``files`` (repo_id, file); what is written follows the batch, not the table.

    Each file also gets an empty row, which stands for "no findings any more". A batch that runs again writes a later
    version with the same findings.
    """
    rows = markers.unionByName(files.select("repo_id", "file").distinct(), allowMissingColumns=True)
    spark = markers.sparkSession
    rows.withColumns({"version": F.lit(time.time_ns()), "run": F.lit(None).cast("bigint")}).write.mode("append").parquet(path)
    fs, name = _log_mark(spark, path)
    fs.mkdirs(name)


def compact_markers(spark: SparkSession, path: str) -> None:
    """Replace all versions by the last ones: these are a new run, after which the older files hold nothing that is shown."""
    rows = spark.read.schema(f"{MARKERS}, {LOG}").parquet(path)
    write_markers(load_markers(spark, path), path, rows.select("repo_id"))
    for file in rows.inputFiles():
        remove(spark, unquote(file))
    fs, name = _log_mark(spark, path)
    fs.delete(name, True)


def load_markers(spark: SparkSession, path: str) -> DataFrame:
    """All findings, of repositories with several runs and files with several versions the last ones; blank advice is filled in."""
    pairs = [F.lit(x) for kv in SUGGESTIONS.items() for x in kv]
    rows = spark.read.schema(f"{MARKERS}, {LOG}").parquet(path)
    fs, name = _log_mark(spark, path)
    rows = _since(rows, ["repo_id"], "run")
    if fs.exists(name):
        rows = _since(rows, ["repo_id", "file"], "version")
    rows = rows.drop("version", "run").where("type is not null")
    return rows.withColumn("suggestion", F.coalesce(F.nullif("suggestion", F.lit("")), F.create_map(*pairs)[F.col("type")], F.lit("")))


def _since(rows: DataFrame, keys: list[str], of: str) -> DataFrame:
    """The rows of each key that are not older than its last ``of``, if it has one."""
    r, x = rows.alias("r"), rows.groupBy(*keys).agg(F.max(of).alias("last")).alias("x")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys]
    return r.join(x, same).where(F.col("last").isNull() | (F.col("r.version") >= F.col("last"))).select("r.*")


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of ``new`` over rows of ``old`` by key; columns in ``keep`` stay as first stored."""
    value = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*value).alias("o"))
    b = new.select(*keys, F.struct(*value).alias("n"))
    rows = a.join(b, keys, "full")
    pick = lambda c: F.when(F.col("n").isNull(), F.col(f"o.{c}")).when(F.col("o").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}" if c in keep else f"n.{c}"))
    return rows.select(*keys, *[pick(c).alias(c) for c in value])


def upsert_repositories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or update by id; created_at stays."""
    return merge(old, new, ["id"], ["created_at"])


def list_repositories(repositories: DataFrame) -> DataFrame:
    return repositories.orderBy("name", "id")


def get_repository(repositories: DataFrame, repo_id: str) -> DataFrame:
    return repositories.where(F.col("id") == repo_id)


def upsert_wiki_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """By page id: content and updated_at change, everything else stays as first stored."""
    return merge(old, new, ["id"], [c for c in new.columns if c not in ("id", "content", "updated_at")])


def mark_pages_complete(done: DataFrame, more: DataFrame) -> DataFrame:
    return done.unionByName(more).dropDuplicates(["job_id", "page_id"])


def safe_name(subject: str | Column) -> Column:
    """A file name: other characters become '_', none at the ends, at most 128 characters."""
    name = F.regexp_replace(col(subject), r"[^A-Za-z0-9_-]", "_")
    return F.substring(F.regexp_replace(name, r"^_+|_+$", ""), 1, 128)


def export_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write each page's content below ``path/page_type=…/subject=…``; returns the counts by type."""
    rows = pages.select(F.col("type").alias("page_type"), safe_name("subject").alias("subject"), F.col("content").alias("value"))
    write_folders(rows, path, "page_type", "subject")
    return pages.groupBy("type").agg(F.count("*").alias("pages"))


#: What Spark escapes in the names of folders.
_ESCAPED = re.compile(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]")


def folder_of(keys: Iterable[str], values: Iterable[str | None]) -> str:
    """``key=value/key=value``, as ``partitionBy`` names it."""
    name = lambda v: _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v) if v else "__HIVE_DEFAULT_PARTITION__"
    return "/".join(f"{k}={name(v)}" for k, v in zip(keys, values))


def write_folders(rows: DataFrame, path: str, *keys: str) -> None:
    """The lines ``value`` of ``rows`` as text files, a folder for each of ``keys``: what ``partitionBy(*keys).text(path)`` writes.

    Made for many small files. Tasks write them in their place under names that a repeated task overwrites, so no file is renamed, and
    through Arrow, which needs no process to set a file's mode as Hadoop's local file system does. Rows are dealt before, as a small
    table is a single task. Where Arrow doesn't know the file system, Spark writes them.
    """
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = re.sub("^file:/(?!/)", "file:///", folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString())
    rows = rows.select(*[F.nullif(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], F.col("value").cast("string").alias("value"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, F.xxhash64("value")).sortWithinPartitions(*keys)
    try:
        open_fs(uri)
    except (pa.ArrowException, OSError, ValueError):
        dealt.write.mode("overwrite").partitionBy(*keys).text(path)
        return
    remove(spark, path)

    def write(batches):
        fs, root = open_fs(uri)
        lines = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
        for own, group in groupby(lines, key=lambda x: x[:-1]):
            folder = f"{root}/{folder_of(keys, own)}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/part-{TaskContext.get().partitionId():05d}.txt") as out:
                for *_, value in group:
                    out.write((value or "").encode() + b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["done"])

    dealt.mapInArrow(write, "done long").write.format("noop").mode("overwrite").save()


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Entities and relations as JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/entities")
    edges.write.mode("overwrite").json(f"{path}/relations")


def export_docs_bundle(pages: DataFrame) -> DataFrame:
    """(repo_id, bundle): a repository's pages in order of target_path, joined by rules.

    The bundle is one document by definition, so this is meant for a repository's pages, not for all repositories' at once.
    """
    entries = F.array_sort(F.collect_list(F.struct("target_path", "content")))
    return pages.groupBy("repo_id").agg(F.array_join(F.transform(entries, lambda x: x["content"]), "\n\n---\n\n").alias("bundle"))
