"""Set operations between snapshots, latest-wins merges and filters of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import severity_rank


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo_id, path, change): added, removed or modified between two snapshots (repo_id, path, content)."""
    a = before.select("repo_id", "path", F.sha2("content", 256).alias("h0"), F.lit(True).alias("was"))
    b = after.select("repo_id", "path", F.sha2("content", 256).alias("h1"), F.lit(True).alias("now"))
    rows = a.join(b, ["repo_id", "path"], "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("h0").eqNullSafe(F.col("h1")), "modified")
    return rows.select("repo_id", "path", kind.alias("change")).where("change is not null")


def needs_reindex(heads: DataFrame, repositories: DataFrame) -> DataFrame:
    """Repositories whose head differs from the stored commit (or that are new)."""
    rows = heads.join(repositories.select(F.col("id").alias("repo_id"), "last_commit"), "repo_id", "left")
    return rows.where(~F.col("head").eqNullSafe(F.col("last_commit"))).select("repo_id", "head")


def biomarker_options(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("type").union(b.select("type")).distinct().orderBy("type")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    value = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias("v")).select(*keys, "v.*")


def finding_status_update(statuses: DataFrame) -> DataFrame:
    """The latest status of each finding (finding_id, status, changed_at)."""
    return latest(statuses, ["finding_id"], "changed_at")


def filter_markers(markers: DataFrame, type: str | None = None, severity: str | None = None, category: str | None = None) -> DataFrame:
    """All given equalities, without regard to case."""
    for name, wanted in (("type", type), ("severity", severity), ("category", category)):
        if wanted:
            markers = markers.where(F.lower(name) == wanted.lower())
    return markers


def file_markers(markers: DataFrame, repo_id: str, path: str) -> DataFrame:
    return markers.where((F.col("repo_id") == repo_id) & (F.col("file") == path))


def repo_markers(markers: DataFrame, repo_id: str) -> DataFrame:
    return markers.where(F.col("repo_id") == repo_id)


def search_symbols(symbols: DataFrame, name: str | None = None, type: str | None = None, contains: bool = False) -> DataFrame:
    """Exact name and type over all repositories; ``contains`` looks inside names."""
    if name:
        symbols = symbols.where(F.col("name").contains(name) if contains else F.col("name") == name)
    return symbols.where(F.col("type") == type) if type else symbols


def repo_symbols(nodes: DataFrame, repo_id: str) -> DataFrame:
    return nodes.where((F.col("repo_id") == repo_id) & (F.col("node_type") == "symbol"))


def repo_files(nodes: DataFrame, repo_id: str) -> DataFrame:
    return nodes.where((F.col("repo_id") == repo_id) & (F.col("node_type") == "file"))


def community_nodes(nodes: DataFrame, repo_id: str, community_id: int) -> DataFrame:
    return nodes.where((F.col("repo_id") == repo_id) & (F.col("community_id") == community_id))


def min_severity(markers: DataFrame, level: str) -> DataFrame:
    return markers.where(severity_rank("severity") >= severity_rank(F.lit(level)))


def paginate(rows: DataFrame, order: list, limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """One page (sorted by Spark, the offset skipped by it) and the total; has_more is offset + limit < total."""
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()
