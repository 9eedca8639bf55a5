"""Dashboard roll-ups over findings, hotspots, owners, costs and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import confidence_tier, prefix, risk_band, round_half_up
from .ranks import top_by


def hotspot_filters(rows: DataFrame, search: str = "", preset: str = "all", sort: str = "trend") -> DataFrame:
    """Search in path or owner; presets hot, bus_factor (one owner), accelerating (30 days at above a third of 90 days)."""
    if search:
        rows = rows.where(F.lower("path").contains(search.lower()) | F.lower("primary_owner").contains(search.lower()))
    rows = rows.where(PRESETS[preset])
    order = {"trend": "temporal_hotspot_score", "churn": "churn_percentile", "commits": "commit_count_90d"}[sort]
    return rows.orderBy(F.desc(F.coalesce(F.col(order), F.lit(-1))), "path")


PRESETS = {"all": "true", "hot": "is_hotspot", "bus_factor": "bus_factor <= 1", "accelerating": "commit_count_30d * 3 > commit_count_90d"}


def hotspot_preset_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.expr(e)).alias(k) for k, e in PRESETS.items()])


def ownership_filters(rows: DataFrame, search: str = "", silo_only: bool = False) -> DataFrame:
    if search:
        rows = rows.where(F.lower("key").contains(search.lower()) | F.lower("owner").contains(search.lower()))
    return rows.where("is_silo") if silo_only else rows


def silo_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("is_silo").alias("silos"), F.count("*").alias("total"))


def language_distribution(files: DataFrame, top: int = 6) -> DataFrame:
    """Files per language (lower case, null is unknown); the top languages and 'other'."""
    per = files.groupBy(F.coalesce(F.lower("language"), F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"))
    ranked = per.withColumn("k", F.row_number().over(Window.orderBy(F.desc("files"), "language")))
    return ranked.groupBy(F.when(F.col("k") <= top, F.col("language")).otherwise("other").alias("language")).agg(F.sum("files").alias("files"))


def attention_items(stale: DataFrame, ungoverned: DataFrame, silos: DataFrame, dead: DataFrame, proposed: DataFrame) -> DataFrame:
    """(kind, title, severity, seq): three stale decisions, ungoverned hotspots and silos, one dead-code line, two proposals."""
    three = lambda f, kind, severity, at, n=3: f.orderBy("seq").limit(n).select(F.lit(kind).alias("kind"), "title", F.lit(severity).alias("severity"), (F.col("seq") + at).alias("seq"))
    lines = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).where("n > 0")
    code = lines.select(F.lit("dead_code").alias("kind"), F.format_string("%d findings, %d lines", "n", "lines").alias("title"), F.when(F.col("lines") > 500, "medium").otherwise("low").alias("severity"), F.lit(3_000_000).cast("bigint").alias("seq"))
    out = three(stale, "stale_decision", "high", 0).unionByName(three(ungoverned, "ungoverned_hotspot", "high", 1_000_000)).unionByName(three(silos, "knowledge_silo", "medium", 2_000_000)).unionByName(code)
    out = out.unionByName(three(proposed, "proposed_decision", "low", 4_000_000, 2))
    return out.orderBy(F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2), "seq")


def hotspot_risk(rows: DataFrame, top: int = 30) -> DataFrame:
    """round(100 * (0.4 churn + 0.35 bus factor + 0.25 trend)) with its band; the top files of each repository."""
    bus = F.when(F.col("bus_factor") <= 1, 1.0).when(F.col("bus_factor") == 2, 0.5).otherwise(0.0)
    trend = F.least(F.lit(1.0), F.coalesce("temporal_hotspot_score", F.lit(0.0)) / 10)
    risk = round_half_up(100 * (0.4 * F.col("churn_percentile") / 100 + 0.35 * bus + 0.25 * trend)).cast("int")
    out = rows.select("repo_id", "path", risk.alias("risk")).withColumn("band", risk_band("risk"))
    return top_by(out, [F.desc("risk"), "path"], top)


def churn_histogram(rows: DataFrame) -> DataFrame:
    """Ten buckets of churn percentiles, empty ones included."""
    per = rows.groupBy(F.least(F.lit(9), F.floor(F.col("churn_percentile") / 10)).cast("int").alias("bucket")).agg(F.count("*").alias("files"))
    all_ = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket"))
    return all_.join(per, "bucket", "left").fillna({"files": 0})


def trend(rows: DataFrame, top: int = 8) -> DataFrame:
    """heating (30 days * 3 / 90 days >= 1.25), cooling (<= 0.75) or steady; the top of each repository by percentile."""
    r = F.try_divide(F.col("commit_count_30d") * 3, F.col("commit_count_90d"))
    kind = F.when(r >= 1.25, "heating").when(r <= 0.75, "cooling").otherwise("steady")
    return top_by(rows.select("repo_id", "path", "churn_percentile", kind.alias("trend")), [F.desc("churn_percentile"), "path"], top)


def bus_factor_distribution(rows: DataFrame) -> DataFrame:
    b = F.col("bus_factor")
    return rows.groupBy(F.when(b >= 3, "healthy").when(b == 2, "medium").otherwise("risk").alias("level")).agg(F.count("*").alias("files"))


def bus_factor_risks(rows: DataFrame, top: int = 10) -> DataFrame:
    return top_by(rows.where("bus_factor <= 1"), [F.desc("commit_count_90d"), "path"], top)


def churn_x_bus_danger(rows: DataFrame, top: int = 5) -> DataFrame:
    """x: churn percentile (0-1 inputs are scaled), y: (8 - bus factor clamped to 1..8) / 7 * 100; both at least 50."""
    x = F.when(F.col("churn_percentile") <= 1, F.col("churn_percentile") * 100).otherwise(F.col("churn_percentile"))
    y = (8 - F.greatest(F.lit(1), F.least(F.lit(8), F.col("bus_factor")))) / 7 * 100
    out = rows.select("repo_id", "path", x.alias("x"), y.alias("y")).where("x >= 50 and y >= 50")
    return top_by(out, [F.desc(F.col("x") + F.col("y")), "path"], top)


def commit_category_totals(rows: DataFrame) -> DataFrame:
    """Sums of the category maps, with the dominant one marked."""
    per = rows.select(F.explode("categories").alias("category", "n")).groupBy("category").agg(F.sum("n").alias("commits"))
    best = per.agg(F.min_by("category", F.struct(-F.col("commits"), F.col("category"))).alias("best"))
    return per.join(F.broadcast(best), F.lit(True)).select("category", "commits", (F.col("category") == F.col("best")).alias("dominant"))


def dead_code_by_owner(findings: DataFrame, safe_only: bool = False, top: int = 8) -> DataFrame:
    rows = findings.where("safe_to_delete") if safe_only else findings
    owner = F.coalesce(F.nullif(F.trim("owner"), F.lit("")), F.lit("Unowned"))
    per = rows.groupBy("repo_id", owner.alias("owner")).agg(F.sum("lines").alias("lines"), F.count("*").alias("findings"))
    return top_by(per, [F.desc("lines"), "owner"], top)


def dead_code_by_file(findings: DataFrame, top: int = 5) -> DataFrame:
    """Per file: lines, findings, its largest finding; the top files of each repository."""
    out = findings.groupBy("repo_id", "file").agg(F.sum("lines").alias("lines"), F.count("*").alias("findings"), F.max_by("name", F.struct("lines", "name")).alias("largest"))
    return top_by(out, [F.desc("lines"), "file"], top)


def dead_code_matrix(findings: DataFrame) -> DataFrame:
    kinds = F.coalesce("kind", F.lit("unknown"))
    """Confidence tiers in rows, kinds in columns."""
    return findings.select(confidence_tier("confidence").alias("tier"), kinds.alias("kind")).groupBy("tier").pivot("kind").count().fillna(0)


def findings_by_directory(markers: DataFrame, depth: int = 2, top: int = 16, by_repository: bool = False) -> DataFrame:
    """The directories with the most findings: of all rows together, or of each repository."""
    s, own = F.lower("severity"), ["repo_id"] if by_repository else []
    out = markers.groupBy(*own, prefix("file", depth).alias("directory")).agg(
        F.count_if(s.isin("high", "critical")).alias("high"), F.count_if(s == "medium").alias("medium"), F.count_if(s == "low").alias("low"), F.count("*").alias("total")
    )
    order = [F.desc("total"), "directory"]
    return top_by(out, order, top) if by_repository else out.orderBy(*order).limit(top)


def findings_by_type(markers: DataFrame) -> DataFrame:
    return markers.groupBy("type").agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), "type")


def severity_distribution(markers: DataFrame) -> DataFrame:
    per = markers.groupBy("severity").agg(F.count("*").alias("findings"))
    return per.select("severity", "findings", (100 * F.col("findings") / F.sum("findings").over(Window.partitionBy())).alias("pct"))


#: Which provider a model belongs to, the first pattern wins.
PROVIDERS = [("anthropic", "claude|anthropic"), ("openai", "gpt|openai|^o[0-9]"), ("google", "gemini|google"), ("mistral", "mistral|mixtral"), ("meta", "llama|meta"), ("deepseek", "deepseek"), ("local", "ollama|local")]


def provider_of(model: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(model).rlike(pattern), F.lit(name)) for name, pattern in PROVIDERS], F.lit("other"))


def cost_by_provider(log: DataFrame) -> DataFrame:
    out = log.groupBy(provider_of(F.col("model")).alias("provider")).agg(
        F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sort_array(F.collect_set("model")).alias("models")
    )
    return out.orderBy(F.desc("cost"), "provider")


def cost_concentration(log: DataFrame, top: int = 12) -> DataFrame:
    """Operations with a cost and their share of all cost."""
    per = log.groupBy("operation").agg(F.sum("cost").alias("cost")).where("cost > 0")
    return per.select("operation", "cost", (F.col("cost") / F.sum("cost").over(Window.partitionBy())).alias("share")).orderBy(F.desc("cost"), "operation").limit(top)


def operation_breakdown(log: DataFrame, metric: str = "tokens", top: int = 12) -> DataFrame:
    per = log.groupBy("operation").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return per.orderBy(F.desc(metric), "operation").limit(top)


def cost_averages(log: DataFrame) -> DataFrame:
    out = log.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return out.select("calls", "tokens", "cost", F.try_divide("tokens", "calls").alias("tokens_per_call"), F.try_divide("cost", "calls").alias("cost_per_call"))


def cache_hit_ratio(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses")).withColumn("ratio", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)))


def llm_costs(log: DataFrame, by: str) -> DataFrame:
    """Calls, tokens and cost by operation, model or day."""
    return log.groupBy(by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def owner_headline(owners: DataFrame) -> DataFrame:
    return owners.agg(F.count("*").alias("owners"), F.sum("owned_files").alias("owned_files"), F.sum("commits").alias("commits"))


def owner_category_mix(rows: DataFrame, top: int = 6) -> DataFrame:
    per = rows.groupBy("owner", "category").agg(F.count("*").alias("n"))
    return per.withColumn("k", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("n"), "category"))).where(F.col("k") <= top).drop("k")


def portfolio_rollup(repos: DataFrame) -> DataFrame:
    """Over repositories: files, fresh pages, stale pages, dead exports, mean coverage where there are files."""
    fresh = round_half_up(F.col("files") * F.col("fresh_pct") / 100)
    return repos.agg(F.sum("files").alias("files"), F.sum(fresh).alias("fresh_pages"), F.sum("stale_pages").alias("stale_pages"), F.sum("dead_exports").alias("dead_exports"), F.avg(F.when(F.col("files") > 0, F.col("coverage_pct"))).alias("mean_coverage"))


def cross_repo_co_change_summary(pairs: DataFrame) -> DataFrame:
    both = F.array_sort(F.array("repo_a", "repo_b"))
    return pairs.agg(F.count("*").alias("pairs"), F.count_distinct(both).alias("repo_pairs"), (100 * F.avg("strength")).alias("mean_strength_pct"))


def contract_match_summary(contracts: DataFrame, links: DataFrame) -> DataFrame:
    """By type: contracts, links, contracts without a link."""
    matched = links.select("contract_id").distinct()
    per = contracts.groupBy("contract_type").agg(F.count("*").alias("total"))
    n = links.join(contracts.select("contract_id", "contract_type"), "contract_id").groupBy("contract_type").agg(F.count("*").alias("links"))
    un = contracts.join(matched, "contract_id", "left_anti").groupBy("contract_type").agg(F.count("*").alias("unmatched"))
    return per.join(n, "contract_type", "left").join(un, "contract_type", "left").fillna(0)


def refactoring_groups(targets: DataFrame, by: str = "primary") -> DataFrame:
    """Targets grouped by rule, module or effort, the largest group first."""
    key = F.substring_index("file", "/", 1) if by == "module" else F.col(by)
    return targets.groupBy(key.alias("group")).agg(F.count("*").alias("targets"), F.sum("impact").alias("impact")).orderBy(F.desc("targets"), "group")


def quadrants_risk_coverage(rows: DataFrame) -> DataFrame:
    """Files by coverage (60) and health (7)."""
    q = F.concat(F.when(F.col("coverage") >= 60, "covered").otherwise("uncovered"), F.lit("_"), F.when(F.col("score") >= 7, "healthy").otherwise("unhealthy"))
    return rows.groupBy(q.alias("quadrant")).agg(F.count("*").alias("files"))


def quadrants_impact_effort(rows: DataFrame) -> DataFrame:
    """Targets by impact (half of the largest) and effort (50)."""
    half = rows.agg((F.max("impact") / 2).alias("half"))
    q = F.concat(F.when(F.col("impact") >= F.col("half"), "high").otherwise("low"), F.lit("_"), F.when(F.col("effort") >= 50, "hard").otherwise("easy"))
    return rows.join(F.broadcast(half), F.lit(True)).groupBy(q.alias("quadrant")).agg(F.count("*").alias("targets"))


def risk_summary(hot: DataFrame, silos: DataFrame, dead: DataFrame, decisions: DataFrame, markers: DataFrame) -> DataFrame:
    """Five one-row counts side by side (each frame is one aggregated row)."""
    one = [
        hot.agg(F.count_if("is_hotspot").alias("hotspots")),
        silos.agg(F.count_if("is_silo").alias("silos")),
        dead.agg(F.coalesce(F.sum(F.when(F.col("safe_to_delete"), F.col("lines"))), F.lit(0)).alias("deletable_lines")),
        decisions.agg(F.count_if(F.col("status") == "stale").alias("stale_decisions")),
        markers.agg(F.count_if(F.lower("severity").isin("high", "critical")).alias("security_findings")),
    ]
    out = one[0]
    for f in one[1:]:
        out = out.join(F.broadcast(f), F.lit(True))
    return out


def recent_decisions(decisions: DataFrame, n: int = 6) -> DataFrame:
    return decisions.orderBy(F.desc("created_at"), "id").limit(n)


def contributor_network(rows: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(owners with file counts, links between the top owners with the files they share) of (path, owner).

    Only files of the top owners are paired, through the at most 20 owners a file can have.
    """
    once = rows.select("path", "owner").distinct()
    nodes = once.groupBy("owner").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "owner").limit(top)
    kept = once.join(F.broadcast(nodes.select("owner")), "owner", "left_semi")
    sets = kept.groupBy("path").agg(F.array_sort(F.collect_set("owner")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.size("w") > 1)
    pairs = sets.select("n", "w", F.explode("w").alias("a")).select("n", "a", F.explode("w").alias("b")).where("a < b")
    return nodes, pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"))


def module_rollup_sort(rows: DataFrame, key: str = "score", descending: bool = False) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), "module")
