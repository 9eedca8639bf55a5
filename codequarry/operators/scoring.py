"""Health scores: findings -> capped deductions -> file scores -> repository score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import round_half_up
from ..schemas import CATEGORY_CAPS
from .ranks import top_by


def cap_of(category: Column) -> Column:
    pairs = [F.lit(x) for kv in CATEGORY_CAPS.items() for x in kv]
    return F.create_map(*pairs)[category]


def clamp(x: Column, low: float = 1.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def category_deductions(markers: DataFrame) -> DataFrame:
    """Per file and category: raw sum of positive deductions, the applied (capped) sum, the cap, count of findings."""
    raw = F.sum(F.when(F.col("deduction") > 0, F.col("deduction")))
    rows = markers.groupBy("repo_id", "file", "category").agg(raw.alias("raw"), F.count("*").alias("findings"))
    cap = cap_of(F.col("category"))
    return rows.withColumn("cap", cap).withColumn("applied", F.when(F.col("raw").isNotNull(), F.least(F.col("raw"), F.coalesce(cap, F.col("raw")))))


def file_score(markers: DataFrame) -> DataFrame:
    """base 10 minus the capped deductions, clamped to 1..10; deductions as a map; all findings counted."""
    rows = category_deductions(markers)
    entry = F.when(F.col("applied").isNotNull(), F.struct("category", "applied"))
    out = rows.groupBy("repo_id", "file").agg(
        F.coalesce(F.sum("applied"), F.lit(0.0)).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("deductions"), F.sum("findings").alias("marker_count")
    )
    return out.select("repo_id", "file", F.lit(10.0).alias("base"), clamp(10.0 - F.col("total")).alias("final"), "deductions", "marker_count")


def score_breakdown(markers: DataFrame) -> DataFrame:
    """Per file and category: raw, applied, cap, whether the cap bites, per cent of the cap used."""
    rows = category_deductions(markers).where("raw is not null")
    return rows.select("repo_id", "file", "category", "raw", "applied", "cap", (F.col("raw") > F.col("cap")).alias("capped"), F.when(F.col("cap") > 0, 100 * F.col("applied") / F.col("cap")).alias("pct_of_cap"))


def all_file_scores(files: DataFrame, scores: DataFrame) -> DataFrame:
    """Every file with its score; files without findings score 10."""
    rows = files.where("coalesce(is_file, true)").select("repo_id", F.col("path").alias("file"))
    return rows.join(scores.select("repo_id", "file", "final", "marker_count"), ["repo_id", "file"], "left").fillna({"final": 10.0, "marker_count": 0})


def repo_score(files: DataFrame, scores: DataFrame, ranks: DataFrame | None = None, marked_only: bool = False) -> DataFrame:
    """PageRank-weighted mean of file scores; plain mean if all weights are (nearly) zero.

    ``marked_only`` is the mode without a file list: the mean over files with findings.
    Repositories come from ``files`` (from ``scores`` in that mode).
    """
    rows = scores.select("repo_id", "file", "final") if marked_only else all_file_scores(files, scores)
    if ranks is None:
        rows = rows.withColumn("w", F.lit(0.0))
    else:
        rows = rows.join(ranks.select("repo_id", F.col("path").alias("file"), F.col("pagerank").alias("w")), ["repo_id", "file"], "left").fillna({"w": 0.0})
    out = rows.groupBy("repo_id").agg(F.sum(F.col("w") * F.col("final")).alias("ws"), F.sum("w").alias("w"), F.avg("final").alias("plain"))
    return out.select("repo_id", clamp(F.when(F.col("w") > 1e-9, F.try_divide("ws", "w")).otherwise(F.col("plain"))).alias("score"))


def marker_summary(markers: DataFrame) -> DataFrame:
    """(dimension, value, findings, deduction): total, by severity, by type, by category, in one aggregation."""
    out = markers.groupingSets([[], ["severity"], ["type"], ["category"]], "severity", "type", "category").agg(
        F.count("*").alias("findings"), F.sum("deduction").alias("deduction"), F.grouping_id().alias("g")
    )
    dim = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "severity").when(F.col("g") == 5, "type").otherwise("category")
    return out.select(dim.alias("dimension"), F.coalesce("severity", "type", "category", F.lit("")).alias("value"), "findings", "deduction")


def top_files(markers: DataFrame, n: int = 20) -> DataFrame:
    """Each repository's files by total deduction, then number of findings; 0 gives all."""
    out = markers.groupBy("repo_id", "file").agg(F.count("*").alias("findings"), F.sum("deduction").alias("deduction"))
    return top_by(out, [F.desc("deduction"), F.desc("findings"), "file"], n)


def worst_files(scores: DataFrame, n: int = 6) -> DataFrame:
    return top_by(scores, ["final", "file"], n)


def composite_health(facts: DataFrame) -> DataFrame:
    """0-100 from documentation, freshness, dead code, hotspots and silos; without documentation the rest is reweighted."""
    part = lambda n, d, k: F.greatest(F.lit(0.0), (1 - F.coalesce(F.try_divide(F.col(n), F.col(d)), F.lit(0.0)) * k) * 100)
    r = round_half_up
    f = facts.withColumns({
        "doc_score": r(F.least("doc_coverage_pct", F.lit(100.0))),
        "fresh_score": r(F.least(F.col("freshness_score") * 100, F.lit(100.0))),
        "dead_score": r(part("dead_export_count", "symbol_count", 5)),
        "hotspot_score": r(part("hotspot_count", "total_files", 3)),
        "silo_score": r(part("silo_count", "total_modules", 2)),
        "index_only": ~((F.col("doc_coverage_pct") > 0) | (F.col("freshness_score") > 0)),
    })
    full = F.col("doc_score") * 0.25 + F.col("fresh_score") * 0.25 + F.col("dead_score") * 0.2 + F.col("hotspot_score") * 0.15 + F.col("silo_score") * 0.15
    bare = F.col("dead_score") * 0.4 + F.col("hotspot_score") * 0.3 + F.col("silo_score") * 0.3
    score = clamp(r(F.when(F.col("index_only"), bare).otherwise(full)).cast("double"), 0.0, 100.0).cast("int")
    return f.withColumn("score", score)


def health_overview(scores: DataFrame, sizes: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Per repository: files, mean score, counts by band; the NLOC-weighted mean of hotspots if both tables are given."""
    out = scores.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.avg("final").alias("mean_score"), F.count_if(F.col("final") < 4).alias("red"), F.count_if((F.col("final") >= 4) & (F.col("final") < 7)).alias("amber"), F.count_if(F.col("final") >= 7).alias("green")
    )
    if sizes is not None and hot is not None:
        rows = scores.join(hot.where("is_hotspot").select("repo_id", F.col("path").alias("file")), ["repo_id", "file"], "left_semi").join(sizes.select("repo_id", F.col("path").alias("file"), "nloc"), ["repo_id", "file"])
        weighted = rows.groupBy("repo_id").agg(F.try_divide(F.sum(F.col("final") * F.col("nloc")), F.sum("nloc")).alias("hotspot_health"))
        out = out.join(weighted, "repo_id", "left")
    return out


def biomarker_breakdown(markers: DataFrame) -> DataFrame:
    """Types in rows, severities in columns."""
    return markers.groupBy("repo_id", "type").pivot("severity", ["critical", "high", "medium", "low"]).count().fillna(0)


def health_trend(snapshots: DataFrame) -> DataFrame:
    """(repo_id, taken_at, score) with the change since the snapshot before and an alert for a fall of half a point."""
    delta = F.col("score") - F.lag("score").over(Window.partitionBy("repo_id").orderBy("taken_at"))
    return snapshots.select("repo_id", "taken_at", "score", delta.alias("delta")).withColumn("alert", F.coalesce(F.col("delta") <= -0.5, F.lit(False)))


def refactoring_targets(markers: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per file: impact, its largest finding type, effort by NLOC (S < 100, M < 300, L < 800, XL), impact per effort."""
    per = markers.groupBy("repo_id", "file", "type").agg(F.sum("deduction").alias("d"))
    rows = per.groupBy("repo_id", "file").agg(F.sum("d").alias("impact"), F.max_by("type", F.struct("d", "type")).alias("primary"))
    rows = rows.join(sizes.select("repo_id", F.col("path").alias("file"), "nloc"), ["repo_id", "file"], "left").fillna({"nloc": 0})
    n = F.col("nloc")
    rows = rows.withColumn("effort", F.when(n < 100, "S").when(n < 300, "M").when(n < 800, "L").otherwise("XL"))
    return rows.withColumn("impact_per_effort", F.col("impact") / F.when(n < 100, 1).when(n < 300, 2).when(n < 800, 4).otherwise(8))


def module_health(files: DataFrame) -> DataFrame:
    """Per top folder: files, lines' median, hotspots, silos, dead symbols and 100 minus weighted shares of them."""
    module = F.substring_index("path", "/", 1)
    rows = files.groupBy("repo_id", module.alias("module")).agg(
        F.count("*").alias("files"),
        F.percentile("size", 0.5).alias("median_size"),
        F.count_if("is_hotspot").alias("hotspots"),
        F.count_if("is_silo").alias("silos"),
        F.count_if("is_dead").alias("dead"),
        F.count_if(F.col("bus_factor") <= 1).alias("bus_risks"),
    )
    n = F.col("files")
    penalty = 30 * F.col("hotspots") / n + 25 * F.col("dead") / n + 25 * F.col("silos") / n + 20 * F.col("bus_risks") / n
    return rows.withColumn("score", 100 - penalty)
