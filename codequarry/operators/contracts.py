"""Analytics whose row schemas are fixed and whose formulas are ours; each docstring is the definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dirname, is_test_filename
from ..schemas import Params
from .history import pairs_within
from .ranks import top_by


def dead_code_findings(dead_markers: DataFrame, files: DataFrame, edges: DataFrame, p: Params = Params()) -> DataFrame:
    """Symbol findings and files without incoming edges (no tests); confidence 0.9 after 180 days of rest, else 0.6."""
    rest = (F.lit(p.as_of).cast("timestamp").cast("double") - F.col("last_mod").cast("timestamp").cast("double")) / 86400
    sure = F.when(rest >= 180, 0.9).otherwise(0.6)
    linked = edges.where("rel <> 'contains'").select("repo_id", F.col("dst").alias("path")).distinct()
    alone = files.where(~is_test_filename("path")).join(linked, ["repo_id", "path"], "left_anti")
    whole = alone.select("repo_id", F.col("path").alias("file"), F.lit("unreachable_file").alias("kind"), F.col("path").alias("name"), (F.size(F.split("content", "\n"))).alias("lines"), sure.alias("confidence"))
    symbols = dead_markers.join(files.select("repo_id", F.col("path").alias("file"), "last_mod"), ["repo_id", "file"], "left")
    part = symbols.select("repo_id", "file", F.lit("unused_symbol").alias("kind"), F.regexp_extract("message", "'(.*)'", 1).alias("name"), F.lit(1).alias("lines"), sure.alias("confidence"))
    return whole.unionByName(part).withColumn("safe_to_delete", F.col("confidence") >= 0.8)


def dead_code_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id").agg(F.count("*").alias("findings"), F.sum("lines").alias("lines"), F.sum(F.when(F.col("safe_to_delete"), F.col("lines")).otherwise(0)).alias("deletable_lines"))


def symbol_importance(symbols: DataFrame, ranks: DataFrame) -> DataFrame:
    """0.6 * PageRank of the file relative to the repository's largest + 0.2 if exported + 0.2 * min(1, lines / 100)."""
    top = ranks.groupBy("repo_id").agg(F.max("pagerank").alias("top"))
    rows = symbols.join(ranks.select("repo_id", F.col("path").alias("file_path"), "pagerank"), ["repo_id", "file_path"], "left").join(top, "repo_id", "left")
    lines = F.coalesce(F.col("end_line") - F.col("line") + 1, F.lit(1))
    exported = F.col("name").rlike("^[A-Z]").cast("double")
    rank = F.coalesce(F.try_divide("pagerank", "top"), F.lit(0.0))
    return rows.select("repo_id", "file_path", "name", "type", "line", (0.6 * rank + 0.2 * exported + 0.2 * F.least(F.lit(1.0), lines / 100)).alias("importance"))


def search_pages(pages: DataFrame, query: str, limit: int = 20, width: int = 160) -> DataFrame:
    """TF-IDF over lower-case word terms: sum of tf * ln(1 + N / df) of the query's terms, with a snippet."""
    terms = sorted(set(t for t in query.lower().split() if t))
    words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: w.isin(*terms) if terms else F.lit(False))
    hits = pages.select("page_id", F.explode(words).alias("term")).groupBy("page_id", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = pages.agg(F.count("*").alias("n"))
    score = hits.join(F.broadcast(df), "term").join(F.broadcast(n), F.lit(True)).groupBy("page_id").agg(F.sum(F.col("tf") * F.log1p(F.col("n") / F.col("df"))).alias("score"))
    best = score.orderBy(F.desc("score"), "page_id").limit(limit)
    at = F.greatest(F.lit(1), F.instr(F.lower("content"), terms[0] if terms else "") - width // 4)
    return best.join(pages, "page_id").select("page_id", "score", F.substr("content", at, F.lit(width)).alias("snippet"))


def knowledge_map(ownership: DataFrame, ranks: DataFrame, documented: DataFrame, top: int = 10, by_repository: bool = False) -> DataFrame:
    """(kind, subject, value): top owners by files, silos by share, and undocumented files by PageRank; of each repository, with its repo_id, if asked."""
    own = ["repo_id"] if by_repository else []

    def part(rows: DataFrame, kind: str, subject: str, value: str) -> DataFrame:
        rows = rows.select(*own, F.lit(kind).alias("kind"), F.col(subject).alias("subject"), F.col(value).cast("double").alias("value"))
        order = [F.desc("value"), "subject"]
        return top_by(rows, order, top) if by_repository else rows.orderBy(*order).limit(top)

    owners = ownership.groupBy(*own, "owner").agg(F.count("*").alias("files"))
    targets = ranks.join(documented.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    return part(owners, "owner", "owner", "files").unionByName(part(ownership.where("is_silo"), "silo", "key", "share")).unionByName(part(targets, "target", "path", "pagerank"))


def repo_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    out = files.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_distinct(dirname("path")).alias("modules"))
    out = out.join(symbols.groupBy("repo_id").agg(F.count("*").alias("symbols")), "repo_id", "left")
    return out.join(edges.groupBy("repo_id").agg(F.count("*").alias("edges")), "repo_id", "left").fillna(0)


def cross_repo_co_changes(commits: DataFrame) -> DataFrame:
    """(repo_a, repo_b, days, strength): days on which one author committed to both, over the smaller one's author days.

    Author-days with the same set of repositories (by its size and two 64-bit hashes) are one, with a weight; its
    repositories are paired block by block, so an author of many repositories fills no task.
    """
    days = commits.select("repo_id", "email", F.to_date("ts").alias("day")).distinct()
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("repo_id")).alias("h1"), F.bit_xor(F.xxhash64("repo_id", F.lit(1))).alias("h2"))
    sets = days.groupBy("email", "day").agg(mark.alias("mark")).where("mark.n > 1")
    kinds = sets.groupBy("mark").agg(F.count("*").alias("weight"), F.min(F.struct("email", "day")).alias("first"))
    firsts = days.join(kinds.select("first.email", "first.day"), ["email", "day"])
    pairs = pairs_within(firsts.select("email", "day", "repo_id"), ["email", "day"], "repo_id").join(kinds.select("first.email", "first.day", "weight"), ["email", "day"])
    pairs = pairs.groupBy(F.col("a").alias("repo_a"), F.col("b").alias("repo_b")).agg(F.sum("weight").alias("days"))
    total = days.groupBy("repo_id").agg(F.count("*").alias("t"))
    a, b = total.select(F.col("repo_id").alias("repo_a"), F.col("t").alias("ta")), total.select(F.col("repo_id").alias("repo_b"), F.col("t").alias("tb"))
    return pairs.join(a, "repo_a").join(b, "repo_b").select("repo_a", "repo_b", "days", (F.col("days") / F.least("ta", "tb")).alias("strength"))


def package_deps(manifests: DataFrame, packages: DataFrame) -> DataFrame:
    """Manifest dependencies (repo_id, dependency) whose name is another repository's package (repo_id, package)."""
    p = packages.select(F.col("repo_id").alias("target"), F.col("package").alias("dependency"))
    return manifests.select(F.col("repo_id").alias("source"), "dependency").join(p, "dependency").where("source <> target").distinct()


def contract_links(contracts: DataFrame) -> DataFrame:
    """Provider and consumer rows (contract_id, repo_id, role) joined on the contract."""
    a = contracts.where("role = 'provider'").select("contract_id", F.col("repo_id").alias("provider"))
    b = contracts.where("role = 'consumer'").select("contract_id", F.col("repo_id").alias("consumer"))
    return a.join(b, "contract_id").where("provider <> consumer").distinct()


def decision_health(decisions: DataFrame, last_change: DataFrame, hotspots: DataFrame) -> DataFrame:
    """By status (a decision is stale when its code changed after it), and hotspots without a decision."""
    rows = decisions.join(last_change, ["repo_id", "path"], "left")
    status = F.when(F.col("last_change") > F.col("updated_at"), "stale").otherwise(F.col("status"))
    per = rows.groupBy("repo_id", status.alias("status")).agg(F.count("*").alias("n"))
    open_ = hotspots.where("is_hotspot").join(decisions.select("repo_id", "path"), ["repo_id", "path"], "left_anti").groupBy("repo_id").agg(F.count("*").alias("n"))
    return per.unionByName(open_.select("repo_id", F.lit("ungoverned_hotspots").alias("status"), "n"))


def page_freshness(pages: DataFrame, files: DataFrame) -> DataFrame:
    """fresh when the source's content still has the hash the page was made from, missing when it is gone, else stale."""
    now = files.select("repo_id", F.col("path").alias("target_path"), F.sha2("content", 256).alias("now"))
    rows = pages.join(now, ["repo_id", "target_path"], "left")
    return rows.withColumn("freshness", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("source_hash"), "fresh").otherwise("stale")).drop("now")


def page_versions(pages: DataFrame) -> DataFrame:
    """Versions numbered by time within a page."""
    return pages.withColumn("version", F.row_number().over(Window.partitionBy("page_id").orderBy("updated_at")))
