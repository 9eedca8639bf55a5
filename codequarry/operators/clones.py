"""Duplicated code by token windows.

A window belongs to the first file (in input order) that shows it; every later file that
shows it is compared with that owner only, so a licence header in a third of all files gives one
row a file, not one a pair of files. Owners are a minimum per window (combined before the
shuffle); the join back to the windows is a plain sort-merge join that adaptive execution may split. Windows travel as two
64-bit keys and their first token; equal keys stand for equal windows, whose similarity is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import STRUCTURAL
from ..schemas import Params
from ..storage import cut
from .rules import marker


def tokenize(content: str | Column) -> Column:
    """Maximal runs of letters, decimal digits and underscores of any alphabet."""
    c = F.col(content) if isinstance(content, str) else content
    return F.filter(F.split(c, r"[^\p{L}\p{Nd}_]+"), lambda x: x != "")


def jaccard(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def estimate_line(content: str | Column, token: str | Column) -> Column:
    """The first line that contains the token as a substring (1 if none does)."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (content, token))
    before = F.call_function("substring_index", c, t, F.lit(1))
    return F.when(F.contains(c, t), F.size(F.split(before, "\n"))).otherwise(1)


def token_windows(files: DataFrame, order: str = "path", p: Params = Params(), exts: list[str] | None = STRUCTURAL) -> DataFrame:
    """(repo_id, path, ord, last_mod, pos, line, window): every stride-th window of each file."""
    rows = files.where("coalesce(is_file, true) and content is not null")
    if exts is not None:
        rows = rows.where(F.col("ext").isin(*exts))
    rows = rows.select("repo_id", "path", F.col(order).alias("ord"), "last_mod", "content", tokenize("content").alias("tokens"))
    rows = rows.where(F.size("tokens") >= p.window)
    starts = F.sequence(F.lit(0), F.size("tokens") - p.window, F.lit(p.stride))
    rows = rows.select("repo_id", "path", "ord", "last_mod", F.explode(F.transform(starts, lambda i: F.struct(i.alias("pos"), F.slice("tokens", i + 1, p.window).alias("window")))).alias("w"))
    return rows.select("repo_id", "path", "ord", "last_mod", "w.pos", "w.window")


def _keyed(windows: DataFrame) -> DataFrame:
    """Two independent 64-bit keys and the first token in place of the window's tokens."""
    keys = F.xxhash64("window").alias("k1"), F.xxhash64(F.reverse("window"), F.lit(1)).alias("k2")
    return windows.select("repo_id", "path", "ord", "last_mod", "pos", F.col("window")[0].alias("token"), *keys)


def window_owners(windows: DataFrame) -> DataFrame:
    """(repo_id, k1, k2, owner struct(ord, pos, path, last_mod)): who shows each window first."""
    w = _keyed(windows) if "k1" not in windows.columns else windows
    return w.groupBy("repo_id", "k1", "k2").agg(F.min(F.struct("ord", "pos", "path", "last_mod")).alias("owner"))


def clone_pairs(windows: DataFrame) -> DataFrame:
    """One row for each file and owner that share a window: the file's first such window."""
    w = _keyed(windows)
    hits = w.join(window_owners(w), ["repo_id", "k1", "k2"]).where(F.col("path") != F.col("owner.path"))
    first = hits.groupBy("repo_id", "path", F.col("owner.path").alias("owner")).agg(F.min(F.struct("pos", "token", "last_mod", F.col("owner.last_mod").alias("owner_mod"))).alias("f"))
    return first.select("repo_id", "path", "owner", "f.*")


def first_lines(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo_id, path, token, line): where the (repo_id, path, token) of ``wanted`` first stand in their files.

    Tokens are gathered by file first, so a file's text is read once, however many clones point to it, and doesn't go on.
    """
    tokens = wanted.distinct().groupBy("repo_id", "path").agg(F.collect_list("token").alias("tokens"))
    rows = files.select("repo_id", "path", "content").join(tokens, ["repo_id", "path"])
    found = F.transform("tokens", lambda t: F.struct(t.alias("token"), estimate_line(F.col("content"), t).alias("line")))
    return rows.select("repo_id", "path", F.explode(found).alias("l")).select("repo_id", "path", "l.*")


def dry_violations(files: DataFrame, order: str = "path", p: Params = Params(), exts: list[str] | None = STRUCTURAL) -> DataFrame:
    """``markers`` of duplicated code: one for each unordered pair of files, on the later file."""
    pairs = cut(clone_pairs(token_windows(files, order, p, exts)), "clones")
    owners = pairs.select("repo_id", F.col("owner").alias("path"), "token")
    lines = first_lines(files, pairs.select("repo_id", "path", "token").unionByName(owners))
    pairs = pairs.join(lines, ["repo_id", "path", "token"])
    pairs = pairs.join(lines.select("repo_id", F.col("path").alias("owner"), "token", F.col("line").alias("owner_line")), ["repo_id", "owner", "token"])
    since = F.lit(p.as_of).cast("timestamp") - F.expr(f"INTERVAL {p.active_days} DAYS")
    active = F.coalesce((F.col("last_mod") > since) & (F.col("owner_mod") > since), F.lit(False))
    deduction = F.least(F.lit(1.5), F.when(active, F.lit(p.active_factor)).otherwise(1.0))
    say = F.format_string("Clone detected: similar code to '%s' (line ~%d)", F.col("owner"), F.col("owner_line"))
    m = marker("dry_violation", "medium", say, F.col("line"), deduction, "duplication")
    return pairs.select("repo_id", F.col("path").alias("file"), m.alias("m")).select("repo_id", "file", "m.*")
