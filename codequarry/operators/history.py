"""Commit history: per-file statistics, organisational findings, co-change, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import col, dirname
from ..schemas import Params
from ..storage import cut
from .ranks import running_totals
from .rules import fired, marker


def before(p: Params, days: int) -> Column:
    return F.lit(p.as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")


def file_author_stats(commits: DataFrame) -> DataFrame:
    """(repo_id, path, email, n, last): commits of each author on each path; a commit touches a path once."""
    once = commits.select("repo_id", "commit_id", "path", "email", "ts").distinct()
    return once.groupBy("repo_id", "path", "email").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def file_metrics(commits: DataFrame, p: Params = Params()) -> DataFrame:
    """churn, ownership, author_count (recent), primary author and their last commit, per file.

    Two aggregations: by (path, author), then by path; only the second level's rows carry authors.
    """
    recent = F.col("last") > before(p, p.recent_days)
    lead = F.min_by(F.struct("email", "last"), F.struct((-F.col("n")).alias("n"), "email"))
    out = file_author_stats(commits).groupBy("repo_id", "path").agg(
        F.sum("n").cast("int").alias("churn"),
        (F.max("n") / F.sum("n")).alias("ownership"),
        F.count(F.when(recent, 1)).cast("int").alias("author_count"),
        lead.alias("lead"),
    )
    return out.select("repo_id", "path", "churn", "ownership", "author_count", F.col("lead.email").alias("primary_author"), F.col("lead.last").alias("primary_author_last_commit"))


def with_metrics(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """Files with their metrics; files without history get zeros and no time."""
    own = ["churn", "ownership", "author_count", "primary_author_last_commit"]
    rows = files.drop(*own).join(metrics.select("repo_id", "path", *own), ["repo_id", "path"], "left")
    return rows.fillna({"churn": 0, "ownership": 0.0, "author_count": 0})


def organisation_markers(files: DataFrame, p: Params = Params()) -> DataFrame:
    """developer_congestion and knowledge_loss."""
    as_of = F.lit(p.as_of).cast("timestamp")
    days = (as_of.cast("double") - F.col("primary_author_last_commit").cast("timestamp").cast("double")) / 86400
    found = [
        F.when(
            F.col("author_count") >= p.congestion_authors,
            marker("developer_congestion", "medium", F.format_string("File touched by %d distinct authors in the last 90 days", "author_count"), deduction=p.congestion_deduction, category="organizational_risk"),
        ),
        F.when(
            (days >= p.loss_days) & (F.col("churn") >= p.loss_churn),
            marker(
                "knowledge_loss", "high", F.format_string("Primary author's last commit was %s days ago on a high-churn file", F.bround(days, 0).cast("bigint").cast("string")), deduction=p.loss_deduction, category="organizational_risk"
            ),
        ),
    ]
    return fired(files.where("coalesce(is_file, true)"), "path", found)


def pairs_within(rows: DataFrame, key: list[str], item: str, block: int = 200) -> DataFrame:
    """(key, a, b) for any two items of a key, a < b; ``rows`` are distinct.

    A key's items are dealt into blocks of about ``block``; each pair of blocks is a join key of its own, so a large
    key's pairs are made by many tasks.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("items_")).where("items_ > 1")
    blocks = F.ceil(F.col("items_") / block).cast("int")
    once = rows.join(sizes, key).select(*key, item, blocks.alias("n_"), F.pmod(F.xxhash64(item), blocks).cast("int").alias("own_"))
    each = F.explode(F.sequence(F.lit(0), F.col("n_") - 1))
    left = once.select(*key, F.col(item).alias("a"), F.col("own_").alias("i_"), each.alias("j_"))
    right = once.select(*key, F.col(item).alias("b"), F.col("own_").alias("j_"), each.alias("i_"))
    return left.join(right, [*key, "i_", "j_"]).where("a < b").select(*key, "a", "b")


def recurring(once: DataFrame, min_count: int, rows: DataFrame | None = None) -> DataFrame:
    """Of distinct (repo_id, commit_id, path), or of some ``rows`` of them, those whose path lies in ``min_count`` commits at least."""
    rows = once if rows is None else rows
    if min_count <= 1:
        return rows
    often = once.groupBy("repo_id", "path").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).select("repo_id", "path")
    return rows.join(often, ["repo_id", "path"], "left_semi")


#: Files of a commit that are paired within its row; those of larger commits are joined block by block.
FEW = 10
#: Hashes of recurring pairs (8 bytes each) that are broadcast, at most; beyond that all pairs are grouped by their names.
RECURRING = 2_000_000


def commit_sets(commits: DataFrame, few: int = FEW) -> DataFrame:
    """(repo_id, commit_id, n, items): the distinct paths of each commit in one row, in a row each if they are more than ``few``.

    Where commits already lie by their ids, as after a join by them, nothing is shuffled.
    """
    key = ["repo_id", "commit_id"]
    once = commits.where("repo_id is not null and commit_id is not null").select(*key, "path").distinct()
    sized = once.withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    sets = sized.groupBy(*key, "n", F.when(F.col("n") > few, F.col("path")).alias("alone")).agg(F.array_sort(F.collect_list("path")).alias("items"))
    return sets.drop("alone")


def co_changes(commits: DataFrame, min_count: int = 3, most_files: int | None = None, block: int = 200) -> DataFrame:
    """(repo_id, a, b, count): distinct commits that touch both files, a < b.

    Commits are written once as rows of their files. Of a commit of a few files the pairs come from its row. Where larger
    ones make more pairs than there are rows, files in fewer than ``min_count`` commits leave them first (a pair can't come more often
    than either file), so an initial commit of many files makes pairs of those only that recur; they are made block by block. Nor can a pair come more often than its
    hash, so hashes are counted first and only pairs whose hash recurs are shuffled by their names. All commits count, unless
    ``most_files`` asks to leave out those that touch more files.
    """
    key = ["repo_id", "commit_id"]
    sets = cut(commit_sets(commits), "commits")
    wanted = sets if most_files is None else sets.where(F.col("n") <= most_files)
    first = wanted.where((F.col("n") > 1) & (F.col("n") <= FEW)).select("repo_id", "items", F.posexplode("items").alias("i", "a"))
    pairs = first.select("repo_id", "a", F.explode(F.slice("items", F.col("i") + 2, FEW)).alias("b"))
    large = wanted.where(F.col("n") > FEW)
    made, held = wanted.agg(F.sum(F.when(F.col("n") > FEW, (F.col("n") - 1) / 2)), F.sum(F.size("items"))).first()
    if made:
        each = lambda rows: rows.select(*key, F.explode("items").alias("path"))
        rows = each(large)
        if made > held:  # else counting all files' commits is more than the pairs
            rows = cut(recurring(each(wanted), min_count, rows), "recurring")
        pairs = pairs.unionByName(pairs_within(rows, key, "path", block).select("repo_id", "a", "b"))
    if min_count > 1:
        hashed = pairs.withColumn("hash", F.xxhash64("repo_id", "a", "b").bitwiseAND(F.lit((1 << 40) - 1)))  # zeros aren't shuffled
        recur = cut(hashed.groupBy("hash").agg(F.count("*").alias("c")).where(F.col("c") >= min_count).select("hash"), "hashes")
        if recur.count() <= RECURRING:
            pairs = hashed.join(F.broadcast(recur), "hash", "left_semi").drop("hash")
    return pairs.groupBy("repo_id", "a", "b").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)


def git_metadata(commits: DataFrame, p: Params = Params(), top: int = 3) -> DataFrame:
    """Per file: commits in all and in the last 90 and 30 days, first and last, age, authors, owner shares."""
    as_of, stats = F.lit(p.as_of).cast("timestamp"), file_author_stats(commits)
    once = commits.select("repo_id", "commit_id", "path", "email", "ts").distinct()
    counts = once.groupBy("repo_id", "path").agg(
        F.count("*").alias("commit_count_total"),
        F.count_if(F.col("ts") > before(p, 90)).alias("commit_count_90d"),
        F.count_if(F.col("ts") > before(p, 30)).alias("commit_count_30d"),
        F.min("ts").alias("first_commit_at"),
        F.max("ts").alias("last_commit_at"),
    )
    # the limit on ranks is pushed below the shuffle, so a file that everyone touches sends few rows to its task
    ranked = stats.withColumn("k", F.row_number().over(Window.partitionBy("repo_id", "path").orderBy(F.desc("n"), "email"))).where(F.col("k") <= top)
    leaders = ranked.groupBy("repo_id", "path").agg(F.array_sort(F.collect_list(F.struct("k", "email", "n"))).alias("a"))
    authors = stats.groupBy("repo_id", "path").agg(F.count("*").alias("contributor_count"), F.sum("n").alias("all")).join(leaders, ["repo_id", "path"])
    authors = authors.select(
        "repo_id", "path", "contributor_count",
        F.col("a")[0]["email"].alias("primary_owner"),
        (F.col("a")[0]["n"] / F.col("all")).alias("primary_owner_share"),
        F.array_join(F.transform("a", lambda x: F.concat(x["email"], F.lit(":"), x["n"].cast("string"))), ",").alias("top_authors"),
    )
    out = counts.join(authors, ["repo_id", "path"])
    return out.withColumn("age_days", F.datediff(as_of, "first_commit_at"))


def hotspots(commits: DataFrame, p: Params = Params(), least: float = 80.0) -> DataFrame:
    """Churn percentile of the last 90 days, a decayed activity score and the hotspot flag.

    The percentile compares counts, so it is computed on the distinct counts of a repository (few
    rows) and joined back, never by ordering all files in one task.
    """
    as_of = F.lit(p.as_of).cast("timestamp")
    once = commits.select("repo_id", "commit_id", "path", "ts").distinct()
    age = (as_of.cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400
    rows = once.groupBy("repo_id", "path").agg(
        F.count_if(F.col("ts") > before(p, 90)).alias("commit_count_90d"), F.count_if(F.col("ts") > before(p, 30)).alias("commit_count_30d"), F.sum(F.exp(-age / 90)).alias("temporal_hotspot_score")
    )
    ranks = percent_ranks(rows, "commit_count_90d")
    out = rows.join(ranks, ["repo_id", "commit_count_90d"])
    return out.withColumn("churn_percentile", 100 * F.col("percent_rank")).drop("percent_rank").withColumn("is_hotspot", F.col("churn_percentile") >= least)


def percent_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(repo_id, value, percent_rank) for each distinct value, as ``percent_rank`` over all rows gives it."""
    counts = rows.groupBy("repo_id", value).agg(F.count("*").alias("c"))
    ranked = running_totals(counts, "repo_id", value, "c")
    return ranked.select("repo_id", value, F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.0).alias("percent_rank"))


def ownership(commits: DataFrame, granularity: str = "file", silo: float = 0.8) -> DataFrame:
    """The top author's share by file or module; a silo has a share above ``silo``."""
    key = F.col("path") if granularity == "file" else dirname("path")
    per = file_author_stats(commits).groupBy("repo_id", key.alias("key"), "email").agg(F.sum("n").alias("n"))
    out = per.groupBy("repo_id", "key").agg(F.min_by("email", F.struct(-F.col("n"), F.col("email"))).alias("owner"), (F.max("n") / F.sum("n")).alias("share"))
    return out.withColumn("is_silo", F.col("share") > silo)


def bus_factor(commits: DataFrame) -> DataFrame:
    """The fewest authors that made half of a file's commits.

    Authors with equally many commits are one row, so a file's window is ordered over its different counts only.
    """
    same = file_author_stats(commits).groupBy("repo_id", "path", "n").agg(F.count("*").alias("authors"))
    of_file = Window.partitionBy("repo_id", "path")
    more = of_file.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    made = F.col("n") * F.col("authors")
    rows = same.select("repo_id", "path", "n", "authors", F.coalesce(F.sum("authors").over(more), F.lit(0)).alias("before"), F.coalesce(F.sum(made).over(more), F.lit(0)).alias("run"), F.sum(made).over(of_file).alias("all"))
    needed = F.greatest(F.ceil((F.col("all") / 2 - F.col("run")) / F.col("n")), F.lit(1))
    return rows.where(needed <= F.col("authors")).groupBy("repo_id", "path").agg(F.min(F.col("before") + needed).cast("int").alias("bus_factor"))


def git_summary(commits: DataFrame, p: Params = Params()) -> DataFrame:
    hot = hotspots(commits, p).groupBy("repo_id").agg(F.count("*").alias("file_count"), F.count_if("is_hotspot").alias("hotspot_count"), F.avg("churn_percentile").alias("mean_percentile"))
    people = commits.groupBy("repo_id").agg(F.count_distinct("email").alias("author_count"), F.count_distinct("commit_id").alias("commit_count"))
    own = ownership(commits).groupBy("repo_id", "owner").agg(F.count("*").alias("files"))
    top = own.groupBy("repo_id").agg(F.min_by("owner", F.struct(-F.col("files"), F.col("owner"))).alias("top_owner"), F.max("files").alias("top_owner_files"))
    return hot.join(people, "repo_id").join(top, "repo_id")


def repo_modules(commits: DataFrame) -> DataFrame:
    """Distinct files and folders of each repository's commits."""
    return commits.groupBy("repo_id").agg(F.count_distinct("path").alias("files"), F.count_distinct(dirname("path")).alias("modules"))


#: Message patterns by category, first match wins; ours (none are given).
COMMIT_CATEGORIES = [("fix", r"(?i)\b(fix|bug|hotfix|patch)"), ("refactor", r"(?i)\b(refactor|clean|rename|restructure)"), ("dependency", r"(?i)\b(bump|upgrade|dependenc|deps)"), ("feature", r"(?i)\b(feat|add|implement|support)")]


def commit_category(message: str | Column) -> Column:
    return F.coalesce(*[F.when(col(message).rlike(pattern), F.lit(name)) for name, pattern in COMMIT_CATEGORIES], F.lit("other"))


def commit_categories(messages: DataFrame) -> DataFrame:
    """(repo_id, path, categories map): commits by category for each file of (repo_id, path, message)."""
    per = messages.groupBy("repo_id", "path", commit_category("message").alias("category")).agg(F.count("*").alias("n"))
    return per.groupBy("repo_id", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))


def owners(commits: DataFrame, p: Params = Params()) -> DataFrame:
    """Per author: files, modules, commits, first and last commit, files they own, tenure in days."""
    stats = file_author_stats(commits)
    base = stats.groupBy("repo_id", "email").agg(F.count("*").alias("files"), F.count_distinct(dirname("path")).alias("modules"), F.sum("n").alias("commits"), F.max("last").alias("last_commit_at"))
    first = commits.groupBy("repo_id", "email").agg(F.min("ts").alias("first_commit_at"))
    owned = ownership(commits).groupBy("repo_id", F.col("owner").alias("email")).agg(F.count("*").alias("owned_files"))
    out = base.join(first, ["repo_id", "email"]).join(owned, ["repo_id", "email"], "left").fillna({"owned_files": 0})
    return out.withColumn("tenure_days", F.datediff(F.lit(p.as_of).cast("timestamp"), "first_commit_at"))


def co_authors(commits: DataFrame, min_count: int = 1) -> DataFrame:
    """(repo_id, email, other, shared, total, share): files two authors share (``min_count`` at least), of the first one's files.

    By definition a file that everyone touches relates all its authors to each other; a larger ``min_count`` bounds
    the pairs, as authors of fewer files leave before pairs are made. Authors of one file are paired as files of one
    commit are: block by block, over many tasks.
    """
    stats = file_author_stats(commits)
    pairs = co_changes(stats.select("repo_id", F.col("path").alias("commit_id"), F.col("email").alias("path")), min_count)
    shared = pairs.select("repo_id", F.col("a").alias("email"), F.col("b").alias("other"), F.col("count").alias("shared"))
    shared = shared.unionByName(shared.select("repo_id", F.col("other").alias("email"), F.col("email").alias("other"), "shared"))
    total = stats.groupBy("repo_id", "email").agg(F.count("*").alias("total"))
    return shared.join(total, ["repo_id", "email"]).withColumn("share", F.col("shared") / F.col("total"))


def reviewer_suggestions(commits: DataFrame, paths: DataFrame, p: Params = Params(), partners: DataFrame | None = None) -> DataFrame:
    """(repo_id, email, score): ownership on the paths (half for co-change partners), decayed by age."""
    wanted = paths.select("repo_id", "path", F.lit(1.0).alias("w"))
    if partners is not None:
        both = partners.select("repo_id", F.col("a").alias("path"), F.col("b").alias("p2")).unionByName(partners.select("repo_id", F.col("b").alias("path"), F.col("a").alias("p2")))
        extra = both.join(paths.select("repo_id", "path"), ["repo_id", "path"]).select("repo_id", F.col("p2").alias("path"), F.lit(0.5).alias("w"))
        wanted = wanted.unionByName(extra).groupBy("repo_id", "path").agg(F.max("w").alias("w"))
    stats = file_author_stats(commits).join(wanted, ["repo_id", "path"])
    stats = stats.join(stats.groupBy("repo_id", "path").agg(F.sum("n").alias("all")), ["repo_id", "path"])
    age = (F.lit(p.as_of).cast("timestamp").cast("double") - F.col("last").cast("timestamp").cast("double")) / 86400
    return stats.select("repo_id", "email", (F.col("w") * F.col("n") / F.col("all") * F.exp(-age / 365)).alias("s")).groupBy("repo_id", "email").agg(F.sum("s").alias("score"))
