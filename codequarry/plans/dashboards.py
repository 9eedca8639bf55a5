"""Queries of dashboard roll-ups, portfolio views, planning and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import confidence_tier, freshness_band, risk_band, score_band
from ..operators import contracts, history, increments, planning, reports, scoring
from . import projections as P
from .queries import _hot, _metric_files, query, rounded

# ---- dead code ---------------------------------------------------------------------------------

KINDS = ["unreachable_file", "unused_symbol", "unused_import"]


def dead_rows(spark, d: str, repo: Column | None = None) -> DataFrame:
    """Order lines as dead-code findings: file = part, lines = quantity, owner = supplier's nation, confidence = discount."""
    li = P.table(spark, d, "lineitem")
    s = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = li.join(s, "l_suppkey")
    owner = F.when(F.col("s_nationkey") < 3, F.lit("  ")).otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    confidence = F.col("l_discount") * 10
    return rows.select(
        (F.lit("shop") if repo is None else repo).alias("repo_id"), P.part_path("l_partkey").alias("file"), F.array(*map(F.lit, KINDS))[F.pmod("l_linenumber", F.lit(3))].alias("kind"), F.concat_ws("_", F.lit("sym"), "l_orderkey", "l_linenumber").alias("name"),
        F.col("l_quantity").cast("bigint").alias("lines"), confidence.alias("confidence"), (confidence >= 0.8).alias("safe_to_delete"), owner.alias("owner"),
    )


DEAD_SQL = f"""dead AS (
  SELECT 'shop' AS repo_id, 'm' || (l_partkey % 25) || '/part_' || l_partkey || '.go' AS file, {KINDS}[1 + l_linenumber % 3] AS kind, 'sym_' || l_orderkey || '_' || l_linenumber AS name, l_quantity::BIGINT AS lines, l_discount * 10 AS confidence, l_discount * 10 >= 0.8 AS safe,
    CASE WHEN s_nationkey < 3 THEN 'Unowned' ELSE 'n' || s_nationkey END AS owner FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query("", f"WITH {DEAD_SQL}\nSELECT owner, sum(lines)::BIGINT AS lines, count(*) AS findings FROM dead GROUP BY ALL ORDER BY lines DESC, owner LIMIT 8")
def dead_code_by_owner(spark, d):
    return reports.dead_code_by_owner(dead_rows(spark, d)).drop("repo_id")


@query("", f"WITH {DEAD_SQL}\nSELECT repo_id, file, sum(lines)::BIGINT AS lines, count(*) AS findings, arg_max(name, (lines, name)) AS largest FROM dead GROUP BY ALL ORDER BY lines DESC, file LIMIT 5")
def dead_code_by_file(spark, d):
    return reports.dead_code_by_file(dead_rows(spark, d))


_REPOS_SQL = DEAD_SQL.replace("'shop' AS repo_id", "'r' || (l_suppkey % 7) AS repo_id")


@query(
    "",
    f"""WITH {_REPOS_SQL}, o AS (SELECT repo_id, owner AS name, sum(lines)::BIGINT AS value FROM dead GROUP BY ALL), f AS (SELECT repo_id, file AS name, sum(lines)::BIGINT AS value FROM dead GROUP BY ALL),
d AS (SELECT repo_id, regexp_extract(file, '^([^/]*)', 1) AS name, count(*) AS value FROM dead GROUP BY ALL), t AS (SELECT repo_id, file AS name, count(*) AS value FROM dead GROUP BY ALL),
every AS (SELECT 'owner' AS kind, 8 AS most, * FROM o UNION ALL SELECT 'file', 5, * FROM f UNION ALL SELECT 'directory', 3, * FROM d UNION ALL SELECT 'findings', 4, * FROM t)
SELECT kind, repo_id, name, value FROM every QUALIFY row_number() OVER (PARTITION BY kind, repo_id ORDER BY value DESC, name) <= most""",
)
def repository_leaders(spark, d):
    """The top owners, files and directories of seven repositories at once."""
    rows = dead_rows(spark, d, F.concat(F.lit("r"), F.pmod("l_suppkey", F.lit(7)).cast("string")))
    marks = rows.select("repo_id", "file", F.lit("low").alias("severity"), F.lit(1.0).alias("deduction"))
    take = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), "repo_id", F.col(name).alias("name"), F.col(value).cast("bigint").alias("value"))
    out = take(reports.dead_code_by_owner(rows), "owner", "owner", "lines").unionByName(take(reports.dead_code_by_file(rows), "file", "file", "lines"))
    out = out.unionByName(take(reports.findings_by_directory(marks, 1, 3, by_repository=True), "directory", "directory", "total"))
    return out.unionByName(take(scoring.top_files(marks, 4), "findings", "file", "deduction"))


@query("", f"WITH {DEAD_SQL}\nSELECT CASE WHEN confidence < 0.5 THEN 'low' WHEN confidence < 0.8 THEN 'medium' ELSE 'high' END AS tier, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in KINDS) + " FROM dead GROUP BY ALL")
def dead_code_matrix(spark, d):
    return reports.dead_code_matrix(dead_rows(spark, d))


@query("", f"WITH {DEAD_SQL}\nSELECT repo_id, count(*) AS findings, sum(lines)::BIGINT AS lines, sum(CASE WHEN safe THEN lines ELSE 0 END)::BIGINT AS deletable_lines FROM dead GROUP BY ALL")
def dead_code_summary(spark, d):
    return contracts.dead_code_summary(dead_rows(spark, d))


@query(
    "parts supply",
    """SELECT repo_id, file, kind, name, lines, confidence, confidence >= 0.8 AS safe_to_delete FROM (
  SELECT p.repo_id, p.path AS file, 'unreachable_file' AS kind, p.path AS name, 1 AS lines, CASE WHEN x.p_size >= 26 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM parts p JOIN (SELECT 'm' || (p_partkey % 25) || '/part_' || p_partkey || '.go' AS path, p_size FROM part) x USING (path) WHERE p.path NOT IN (SELECT dst FROM supply WHERE src = 'sup_1')
  UNION ALL SELECT p.repo_id, p.path, 'unused_symbol', p.p_brand, 1, CASE WHEN p_size >= 26 THEN 0.9 ELSE 0.6 END FROM parts p JOIN (SELECT 'm' || (p_partkey % 25) || '/part_' || p_partkey || '.go' AS path, p_size FROM part) x USING (path) WHERE p_size > 40)""",
)
def dead_code_findings(spark, d):
    """Parts that supplier 1 doesn't supply, and symbol findings of large parts; a part's age is a week for each unit of its size."""
    p = P.part_files(spark, d)
    p = p.withColumn("last_mod", F.date_sub(F.lit(P.AS_OF).cast("date"), (F.col("size") / 100 * 7).cast("int")).cast("timestamp"))
    dead = p.where("size > 4000").select("repo_id", F.col("path").alias("file"), F.format_string("Symbol '%s' has zero incoming call edges", "p_brand").alias("message"))
    edges = P.supply_edges(spark, d).where("src = 'sup_1'")
    return contracts.dead_code_findings(dead, p, edges, P.PARAMS)


# ---- health, risk and attention ----------------------------------------------------------------


@query(
    "",
    """WITH f AS (SELECT s_suppkey AS id, s_acctbal / 100 AS doc, (s_suppkey % 11) / 10 AS fresh, s_suppkey % 7 AS dead, 40 + s_suppkey % 5 AS syms, s_suppkey % 9 AS hot, s_suppkey % 30 AS files, s_nationkey % 4 AS silos, s_nationkey AS modules FROM supplier),
g AS (SELECT id, floor(least(doc, 100) + 0.5) AS d, floor(least(fresh * 100, 100) + 0.5) AS f, floor(greatest(0, (1 - dead / syms * 5) * 100) + 0.5) AS x, floor(greatest(0, (1 - coalesce(hot / nullif(files, 0), 0) * 3) * 100) + 0.5) AS h, floor(greatest(0, (1 - coalesce(silos / nullif(modules, 0), 0) * 2) * 100) + 0.5) AS s, NOT (doc > 0 OR fresh > 0) AS bare FROM f)
SELECT id, greatest(0, least(100, floor(CASE WHEN bare THEN x * 0.4::DOUBLE + h * 0.3::DOUBLE + s * 0.3::DOUBLE ELSE d * 0.25::DOUBLE + f * 0.25::DOUBLE + x * 0.2::DOUBLE + h * 0.15::DOUBLE + s * 0.15::DOUBLE END + 0.5)))::INT AS score, bare AS index_only FROM g""",
)
def composite_health(spark, d):
    """Suppliers as repositories."""
    s, k = P.table(spark, d, "supplier"), F.col("s_suppkey")
    facts = s.select(
        k.alias("id"), (F.col("s_acctbal") / 100).alias("doc_coverage_pct"), (F.pmod(k, F.lit(11)) / 10).alias("freshness_score"), F.pmod(k, F.lit(7)).alias("dead_export_count"), (40 + F.pmod(k, F.lit(5))).alias("symbol_count"),
        F.pmod(k, F.lit(9)).alias("hotspot_count"), F.pmod(k, F.lit(30)).alias("total_files"), F.pmod("s_nationkey", F.lit(4)).alias("silo_count"), F.col("s_nationkey").alias("total_modules"),
    )
    return scoring.composite_health(facts).select("id", "score", "index_only")


@query(
    "",
    f"""WITH {DEAD_SQL},
o AS (SELECT o_orderkey AS seq, 'Order ' || o_orderkey AS title, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
p AS (
  SELECT * FROM (SELECT 'stale_decision' AS kind, title, 'high' AS severity, seq FROM o WHERE st = 'F' ORDER BY seq LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 'ungoverned_hotspot', title, 'high', seq + 1000000 FROM o WHERE pr = '1-URGENT' ORDER BY seq LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 'knowledge_silo', title, 'medium', seq + 2000000 FROM o WHERE pr = '5-LOW' ORDER BY seq LIMIT 3)
  UNION ALL SELECT 'dead_code', count(*) || ' findings, ' || sum(lines)::BIGINT || ' lines', CASE WHEN sum(lines) > 500 THEN 'medium' ELSE 'low' END, 3000000 FROM dead
  UNION ALL SELECT * FROM (SELECT 'proposed_decision', title, 'low', seq + 4000000 FROM o WHERE st = 'P' ORDER BY seq LIMIT 2))
SELECT * FROM p""",
)
def attention_items(spark, d):
    """Orders as decisions, hotspots and silos."""
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), "o_orderstatus", "o_orderpriority")
    return reports.attention_items(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"), dead_rows(spark, d), o.where("o_orderstatus = 'P'"))


@query(
    "hot own content",
    f"""SELECT * FROM (WITH {DEAD_SQL}
SELECT (SELECT count(*) FROM hot WHERE churn_percentile >= 80) AS hotspots, (SELECT count(*) FROM own WHERE share > 0.8) AS silos, (SELECT coalesce(sum(lines) FILTER (safe), 0)::BIGINT FROM dead) AS deletable_lines,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS stale_decisions, (SELECT count(*) FROM content WHERE severity IN ('high', 'critical')) AS security_findings)""",
)
def risk_summary(spark, d):
    from .queries import _content

    c = P.commits(spark, d)
    decisions = P.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "stale").otherwise("open").alias("status"))
    return reports.risk_summary(history.hotspots(c, P.PARAMS), history.ownership(c), dead_rows(spark, d), decisions, _content(spark, d))


@query("", "SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 6")
def recent_decisions(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return reports.recent_decisions(o).withColumn("created_at", F.unix_timestamp("created_at"))


@query(
    "",
    """WITH d AS (SELECT o_orderkey % 25 AS path, o_orderdate AS made, o_orderstatus AS st FROM orders), l AS (SELECT l_partkey % 50 AS path, max(l_shipdate) AS last FROM lineitem WHERE l_linenumber = 7 GROUP BY ALL)
SELECT 'shop' AS repo_id, status, count(*) AS n FROM (SELECT CASE WHEN last > made THEN 'stale' ELSE st END AS status FROM d LEFT JOIN l USING (path)) GROUP BY ALL
UNION ALL SELECT 'shop', 'ungoverned_hotspots', count(*) FROM (SELECT DISTINCT p_size % 50 AS path FROM part) WHERE path NOT IN (SELECT path FROM d) HAVING count(*) > 0""",
)
def decision_health(spark, d):
    """Orders as decisions on 25 paths, shipments as changes, part sizes as hotspots."""
    repo = F.lit("shop").alias("repo_id")
    decisions = P.table(spark, d, "orders").select(repo, F.pmod("o_orderkey", F.lit(25)).alias("path"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderstatus").alias("status"))
    last = P.table(spark, d, "lineitem").where("l_linenumber = 7").groupBy(repo, F.pmod("l_partkey", F.lit(50)).alias("path")).agg(F.max("l_shipdate").alias("last_change"))
    hot = P.table(spark, d, "part").select(repo, F.pmod("p_size", F.lit(50)).cast("bigint").alias("path"), F.lit(True).alias("is_hotspot")).distinct()
    return contracts.decision_health(decisions, last, hot)


@query("org parts", "SELECT CASE WHEN c >= 60 THEN 'covered' ELSE 'uncovered' END || '_' || CASE WHEN s >= 9.5 - 2.5 THEN 'healthy' ELSE 'unhealthy' END AS quadrant, count(*) AS files FROM (SELECT p.path, p.size // 50 AS c, 10 - 4 * coalesce(sum(o.deduction), 0) AS s FROM parts p LEFT JOIN org o ON o.file = p.path GROUP BY p.path, p.size) GROUP BY ALL")
def quadrants_risk_coverage(spark, d):
    """Parts by coverage (twice the size) and a health of 10 less four times the deductions."""
    f = _metric_files(spark, d)
    lost = history.organisation_markers(f, P.PARAMS).groupBy("repo_id", F.col("file").alias("path")).agg(F.sum("deduction").alias("lost"))
    rows = f.join(lost, ["repo_id", "path"], "left").select((F.col("size") / 50).alias("coverage"), (10 - 4 * F.coalesce("lost", F.lit(0.0))).alias("score"))
    return reports.quadrants_risk_coverage(rows)


@query("", "WITH t AS (SELECT p_retailprice AS impact, p_size * 2 AS effort FROM part) SELECT CASE WHEN impact >= (SELECT max(impact) / 2 FROM t) THEN 'high' ELSE 'low' END || '_' || CASE WHEN effort >= 50 THEN 'hard' ELSE 'easy' END AS quadrant, count(*) AS targets FROM t GROUP BY ALL")
def quadrants_impact_effort(spark, d):
    return reports.quadrants_impact_effort(P.table(spark, d, "part").select(F.col("p_retailprice").alias("impact"), (F.col("p_size") * 2).alias("effort")))


@query("org parts", "SELECT regexp_extract(file, '^([^/]*)', 1) AS \"group\", count(*) AS targets, sum(impact)::DOUBLE AS impact FROM (SELECT file, sum(deduction) AS impact FROM org GROUP BY ALL) GROUP BY ALL")
def refactoring_groups(spark, d):
    f = _metric_files(spark, d)
    t = scoring.refactoring_targets(history.organisation_markers(f, P.PARAMS), f.select("repo_id", "path", F.col("size").alias("nloc")))
    return reports.refactoring_groups(t, "module")


@query(
    "hot bus own parts",
    """, f AS (SELECT p.path, regexp_extract(p.path, '^([^/]*)', 1) AS module, p.size, coalesce(h.churn_percentile >= 80, false) AS hotspot, coalesce(o.share > 0.8, false) AS silo, coalesce(b.bus_factor <= 1, false) AS bus, p.size > 4000 AS dead
  FROM parts p LEFT JOIN hot h USING (path) LEFT JOIN own o ON o.key = p.path LEFT JOIN bus b ON b.path = p.path)
SELECT 'shop' AS repo_id, module, count(*) AS files, median(size)::DOUBLE AS median_size, count(*) FILTER (hotspot) AS hotspots, count(*) FILTER (silo) AS silos, count(*) FILTER (dead) AS dead, count(*) FILTER (bus) AS bus_risks,
  round(100 - (30 * count(*) FILTER (hotspot) / count(*) + 25 * count(*) FILTER (dead) / count(*) + 25 * count(*) FILTER (silo) / count(*) + 20 * count(*) FILTER (bus) / count(*)), 6) AS score FROM f GROUP BY ALL""".replace(", f AS", "SELECT * FROM (WITH f AS", 1) + ")",
)
def module_health(spark, d):
    c, key = P.commits(spark, d), ["repo_id", "path"]
    f = P.part_files(spark, d).select(*key, "size", (F.col("size") > 4000).alias("is_dead"))
    f = f.join(history.hotspots(c, P.PARAMS).select(*key, "is_hotspot"), key, "left").join(history.ownership(c).select("repo_id", F.col("key").alias("path"), "is_silo"), key, "left").join(history.bus_factor(c), key, "left")
    return rounded(scoring.module_health(f), "score")


@query("", "SELECT s_suppkey % 5 AS repo_id, s_suppkey AS taken_at, s_acctbal AS score, round(s_acctbal - lag(s_acctbal) OVER w, 6) AS delta, coalesce(s_acctbal - lag(s_acctbal) OVER w <= -0.5, false) AS alert FROM supplier WINDOW w AS (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey)")
def health_trend(spark, d):
    s = P.table(spark, d, "supplier").select(F.pmod("s_suppkey", F.lit(5)).alias("repo_id"), F.col("s_suppkey").alias("taken_at"), F.col("s_acctbal").alias("score"))
    return rounded(scoring.health_trend(s), "delta")


@query("org parts", "SELECT repo_id, file, final, marker_count FROM (SELECT p.repo_id, p.path AS file, (10 - least(1.0, coalesce(sum(o.deduction), 0)))::DOUBLE AS final, count(o.file) AS marker_count FROM parts p LEFT JOIN org o ON o.file = p.path GROUP BY ALL) ORDER BY final, file LIMIT 6")
def worst_files(spark, d):
    f = _metric_files(spark, d)
    return scoring.worst_files(scoring.all_file_scores(f, scoring.file_score(history.organisation_markers(f, P.PARAMS))))


def _led(spark, d: str) -> DataFrame:
    """The commits with one author in place of the first 22 nations."""
    return P.commits(spark, d).withColumn("email", F.when(F.col("email") < "n22", "lead").otherwise(F.col("email")))


LED_SQL = """led AS (SELECT path, email, count(*) AS n FROM (SELECT path, commit_id, CASE WHEN email < 'n22' THEN 'lead' ELSE email END AS email FROM commits) GROUP BY ALL),
shares AS (SELECT path, arg_min(email, (-n, email)) AS owner, max(n) / sum(n) AS share FROM led GROUP BY ALL)"""


@query("hot", f"SELECT repo_id, path, commit_count_90d FROM (WITH {LED_SQL} SELECT hot.* FROM hot JOIN shares USING (path) WHERE share >= 0.5) ORDER BY commit_count_90d DESC, path LIMIT 10")
def bus_factor_risks(spark, d):
    rows = history.hotspots(P.commits(spark, d), P.PARAMS).join(history.bus_factor(_led(spark, d)), ["repo_id", "path"])
    return reports.bus_factor_risks(rows).select("repo_id", "path", "commit_count_90d")


@query(
    "hot bus own",
    "SELECT repo_id, path, commit_count_30d, commit_count_90d FROM hot JOIN bus USING (repo_id, path) JOIN (SELECT repo_id, key AS path, owner FROM own) o USING (repo_id, path) WHERE (contains(path, '7') OR contains(owner, '7')) AND commit_count_30d * 3 > commit_count_90d",
)
def hotspot_filters(spark, d):
    """Search and preset together."""
    rows = _hot(spark, d).join(history.ownership(P.commits(spark, d)).select("repo_id", F.col("key").alias("path"), F.col("owner").alias("primary_owner")), ["repo_id", "path"])
    return reports.hotspot_filters(rows, "7", "accelerating", "churn").select("repo_id", "path", "commit_count_30d", "commit_count_90d")


@query("commits", f"SELECT * FROM (WITH {LED_SQL} SELECT 'shop' AS repo_id, path AS key, owner FROM shares WHERE share > 0.8 AND contains(path, 'm1'))")
def ownership_filters(spark, d):
    return reports.ownership_filters(history.ownership(_led(spark, d)), "M1", True).select("repo_id", "key", "owner")


@query("own", "SELECT count(*) FILTER (share > 0.8) AS silos, count(*) AS total FROM own")
def silo_count(spark, d):
    return reports.silo_count(history.ownership(P.commits(spark, d)))


@query(
    "",
    """SELECT p_partkey AS id, CASE WHEN x < 4 THEN 'red' WHEN x < 7 THEN 'amber' ELSE 'green' END AS score, CASE WHEN x / 10 < 0.6 THEN 'outdated' WHEN x / 10 < 0.8 THEN 'stale' ELSE 'fresh' END AS freshness, CASE WHEN x * 10 < 25 THEN 'low' WHEN x * 10 < 45 THEN 'moderate' WHEN x * 10 < 70 THEN 'high' ELSE 'critical' END AS risk,
  CASE WHEN x / 10 < 0.5 THEN 'low' WHEN x / 10 < 0.8 THEN 'medium' ELSE 'high' END AS confidence FROM (SELECT p_partkey, p_size / 5 AS x FROM part)""",
)
def bands(spark, d):
    """Every band of part sizes from 0.2 to 10."""
    x = F.col("p_size") / 5
    return P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), score_band(x).alias("score"), freshness_band(x / 10).alias("freshness"), risk_band(x * 10).alias("risk"), confidence_tier(x / 10).alias("confidence"))


# ---- costs, owners, portfolio -------------------------------------------------------------------

MODELS = ["claude-sonnet-4-1", "gpt-4o-mini", "openai/gpt-4o", "gemini-1.5-pro", "mistralai/mixtral-8x7b-v1", "meta-llama/llama-3-8b-instruct", "deepseek-r1", "local/x", "other-model", "o3-mini"]
PROVIDERS = ["anthropic", "openai", "openai", "google", "mistral", "meta", "deepseek", "local", "other", "openai"]
PRICED = [(3.0, 15.0), (0.15, 0.6), (2.5, 10.0), (1.25, 5.0), (0.45, 0.7), (0.06, 0.06), (0.0, 0.0), (0.0, 0.0), (7.0, 9.0), (0.0, 0.0)]


def _model(key: str) -> Column:
    return F.array(*map(F.lit, MODELS))[F.pmod(key, F.lit(len(MODELS))).cast("int")]


def calls(spark, d: str) -> DataFrame:
    """Order lines as model calls."""
    li = P.table(spark, d, "lineitem")
    return li.select(
        _model("l_partkey").alias("model"), F.col("l_returnflag").alias("operation"), F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_linenumber").cast("bigint").alias("output_tokens"), F.col("l_quantity").cast("bigint").alias("tokens"), (F.col("l_quantity") * 2).cast("bigint").alias("cost"), (F.col("l_linestatus") == "F").alias("cache_hit"), "l_shipdate"
    )


_PICK = f"[1 + l_partkey % {len(MODELS)}]"


@query("", f"SELECT {PROVIDERS}{_PICK} AS provider, count(*) AS calls, sum(2 * l_quantity)::BIGINT AS cost, sum(l_quantity::BIGINT + l_linenumber)::BIGINT AS tokens, array_to_string(list_sort(list(DISTINCT {MODELS}{_PICK})), ',') AS models FROM lineitem GROUP BY ALL")
def cost_by_provider(spark, d):
    return reports.cost_by_provider(calls(spark, d)).withColumn("models", F.array_join("models", ","))


@query("", "SELECT l_returnflag AS operation, count(*) AS calls, sum(l_quantity)::BIGINT AS tokens, sum(2 * l_quantity)::BIGINT AS cost FROM lineitem GROUP BY ALL ORDER BY tokens DESC, operation LIMIT 12")
def operation_breakdown(spark, d):
    return reports.operation_breakdown(calls(spark, d))


@query("", "SELECT count(*) FILTER (l_linestatus = 'F') AS hits, count(*) FILTER (l_linestatus <> 'F') AS misses, round(count(*) FILTER (l_linestatus = 'F') / count(*), 9) AS ratio FROM lineitem")
def cache_hit_ratio(spark, d):
    return rounded(reports.cache_hit_ratio(calls(spark, d)), "ratio", places=9)


@query("", f"SELECT {MODELS}{_PICK} AS model, count(*) AS calls, sum(l_quantity)::BIGINT AS tokens, sum(2 * l_quantity)::BIGINT AS cost FROM lineitem GROUP BY ALL")
def llm_costs_by_model(spark, d):
    return reports.llm_costs(calls(spark, d), "model")


@query("", "SELECT epoch(l_shipdate)::BIGINT AS day, count(*) AS calls, sum(l_quantity)::BIGINT AS tokens, sum(2 * l_quantity)::BIGINT AS cost FROM lineitem GROUP BY ALL")
def llm_costs_by_day(spark, d):
    return reports.llm_costs(calls(spark, d).withColumn("day", F.unix_timestamp("l_shipdate")), "day")


@query("", f"SELECT DISTINCT {MODELS}{_PICK} AS model, {[a for a, _ in PRICED]}{_PICK}::DOUBLE AS input, {[b for _, b in PRICED]}{_PICK}::DOUBLE AS output FROM lineitem")
def price_models(spark, d):
    """Exact, prefix, unknown and discovered prices."""
    found = spark.createDataFrame([("other-model", 7.0, 9.0)], "model string, input double, output double")
    return planning.price_models(calls(spark, d).select("model"), planning.prices(spark), found)


_TIERS = ["medium", "medium", "medium", "medium", "medium", "cheap", None, None, None, "cheap"]


@query(
    "",
    f"""SELECT tier, array_to_string(list_sort(list(model)), ',') AS models FROM (SELECT DISTINCT {MODELS}{_PICK} AS model, [{', '.join('NULL' if t is None else f"'{t}'" for t in _TIERS)}]{_PICK} AS tier FROM lineitem) WHERE tier IS NOT NULL GROUP BY ALL""",
)
def bucket_models_by_tier(spark, d):
    return planning.bucket_models_by_tier(calls(spark, d).select("model").distinct()).withColumn("models", F.array_join("models", ","))


@query("own commits", "SELECT count(*) AS owners, sum(owned)::BIGINT AS owned_files, sum(c)::BIGINT AS commits FROM (SELECT email, (SELECT count(*) FROM own o WHERE o.owner = s.email) AS owned, sum(n) AS c FROM stats s GROUP BY email)")
def owner_headline(spark, d):
    return reports.owner_headline(history.owners(P.commits(spark, d), P.PARAMS))


@query(
    "",
    """SELECT owner, category, n FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, category) AS k FROM (SELECT c_nationkey AS owner, o_orderpriority || o_orderstatus AS category, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)) WHERE k <= 6""",
)
def owner_category_mix(spark, d):
    o = P.table(spark, d, "orders").join(P.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return reports.owner_category_mix(o.select(F.col("c_nationkey").alias("owner"), F.concat("o_orderpriority", "o_orderstatus").alias("category")))


CATEGORY = "CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'fix' WHEN contains(o_orderpriority, 'HIGH') THEN 'feature' WHEN contains(o_orderpriority, 'MEDIUM') THEN 'refactor' WHEN contains(o_orderpriority, 'LOW') THEN 'dependency' ELSE 'other' END"


def messages(spark, d: str) -> DataFrame:
    """Orders as commit messages on the customer's path."""
    o, p = P.table(spark, d, "orders"), F.col("o_orderpriority")
    text = F.when(p.contains("URGENT"), "Hotfix the total").when(p.contains("HIGH"), "Add a report").when(p.contains("MEDIUM"), "clean up names").when(p.contains("LOW"), "Bump a version").otherwise("notes")
    return o.select(F.lit("shop").alias("repo_id"), F.pmod("o_custkey", F.lit(200)).alias("path"), text.alias("message"))


@query("", f"SELECT 'shop' AS repo_id, o_custkey % 200 AS path, {CATEGORY} AS category, count(*) AS n FROM orders GROUP BY ALL")
def commit_categories(spark, d):
    return history.commit_categories(messages(spark, d)).select("repo_id", "path", F.explode("categories").alias("category", "n"))


@query("", f"SELECT category, n AS commits, category = arg_min(category, (-n, category)) OVER () AS dominant FROM (SELECT {CATEGORY} AS category, count(*) AS n FROM orders GROUP BY ALL)")
def commit_category_totals(spark, d):
    return reports.commit_category_totals(history.commit_categories(messages(spark, d)))


@query("", "SELECT sum(s_suppkey % 90)::BIGINT AS files, sum(floor((s_suppkey % 90) * (s_nationkey * 4) / 100 + 0.5))::BIGINT AS fresh_pages, sum(s_nationkey)::BIGINT AS stale_pages, sum(s_suppkey % 7)::BIGINT AS dead_exports, round(avg(s_acctbal) FILTER (s_suppkey % 90 > 0), 6) AS mean_coverage FROM supplier")
def portfolio_rollup(spark, d):
    s = P.table(spark, d, "supplier")
    r = s.select(F.pmod("s_suppkey", F.lit(90)).alias("files"), (F.col("s_nationkey") * 4).alias("fresh_pct"), F.col("s_nationkey").alias("stale_pages"), F.pmod("s_suppkey", F.lit(7)).alias("dead_exports"), F.col("s_acctbal").alias("coverage_pct"))
    return rounded(reports.portfolio_rollup(r), "mean_coverage")


@query(
    "",
    """WITH p AS (SELECT 'r' || (l_suppkey % 10) AS a, 'r' || (l_partkey % 12) AS b, l_discount AS s FROM lineitem WHERE l_suppkey % 10 <> l_partkey % 12)
SELECT count(*) AS pairs, count(DISTINCT least(a, b) || ' ' || greatest(a, b)) AS repo_pairs, round(100 * avg(s), 6) AS mean_strength_pct FROM p""",
)
def cross_repo_co_change_summary(spark, d):
    li = P.table(spark, d, "lineitem").where("pmod(l_suppkey, 10) <> pmod(l_partkey, 12)")
    pairs = li.select(F.concat(F.lit("r"), F.pmod("l_suppkey", F.lit(10)).cast("string")).alias("repo_a"), F.concat(F.lit("r"), F.pmod("l_partkey", F.lit(12)).cast("string")).alias("repo_b"), F.col("l_discount").alias("strength"))
    return rounded(reports.cross_repo_co_change_summary(pairs), "mean_strength_pct")


def contract_rows(spark, d: str) -> DataFrame:
    """Parts as contracts that their suppliers provide (even lines) or consume (odd lines)."""
    li = P.table(spark, d, "lineitem")
    return li.select(F.pmod("l_partkey", F.lit(300)).alias("contract_id"), F.concat(F.lit("r"), F.pmod("l_suppkey", F.lit(20)).cast("string")).alias("repo_id"), F.when(F.pmod("l_orderkey", F.lit(97)) == 0, "provider").otherwise("consumer").alias("role"))


CONTRACTS_SQL = "con AS (SELECT l_partkey % 300 AS contract_id, 'r' || (l_suppkey % 20) AS repo_id, l_orderkey % 97 = 0 AS provides FROM lineitem), links AS (SELECT DISTINCT a.contract_id, a.repo_id AS provider, b.repo_id AS consumer FROM con a JOIN con b ON a.contract_id = b.contract_id AND a.repo_id <> b.repo_id WHERE a.provides AND NOT b.provides)"


@query("", f"WITH {CONTRACTS_SQL} SELECT * FROM links")
def contract_links(spark, d):
    return contracts.contract_links(contract_rows(spark, d).distinct())


@query("", f"WITH {CONTRACTS_SQL}, t AS (SELECT p_partkey AS contract_id, p_type AS contract_type FROM part) SELECT contract_type, count(*) AS total, coalesce(sum(n), 0)::BIGINT AS links, count(*) FILTER (n IS NULL) AS unmatched FROM t LEFT JOIN (SELECT contract_id, count(*) AS n FROM links GROUP BY ALL) USING (contract_id) GROUP BY ALL")
def contract_match_summary(spark, d):
    c = P.table(spark, d, "part").select(F.col("p_partkey").alias("contract_id"), F.col("p_type").alias("contract_type"))
    return reports.contract_match_summary(c, contracts.contract_links(contract_rows(spark, d).distinct()))


@query("", "SELECT DISTINCT 'r' || (l_suppkey % 10) AS source, 'pkg' || (l_partkey % 40) AS dependency, 'r' || (l_partkey % 40 % 10) AS target FROM lineitem WHERE l_suppkey % 10 <> l_partkey % 40 % 10 AND l_partkey % 40 < 30")
def package_deps(spark, d):
    """Thirty of forty packages belong to a repository."""
    li = P.table(spark, d, "lineitem").select(F.concat(F.lit("r"), F.pmod("l_suppkey", F.lit(10)).cast("string")).alias("repo_id"), F.pmod("l_partkey", F.lit(40)).alias("k"))
    name = F.concat(F.lit("pkg"), F.col("k").cast("string")).alias("package")
    packages = li.where("k < 30").select(F.concat(F.lit("r"), F.pmod("k", F.lit(10)).cast("string")).alias("repo_id"), name).distinct()
    return contracts.package_deps(li.select("repo_id", name.alias("dependency")), packages)


# ---- pages, prompts and plans --------------------------------------------------------------------


@query("", "SELECT DISTINCT t || ':root' AS page_id, t AS page_type, 'root' AS subject, l AS level, s_nationkey AS repo_id FROM supplier, (VALUES ('repo_overview', 5), ('architecture_diagram', 4), ('onboarding', 6)) v(t, l)")
def plan_singletons(spark, d):
    return planning.plan_singletons(P.table(spark, d, "supplier").select(F.col("s_nationkey").alias("repo_id")))


@query("parts", "SELECT DISTINCT repo_id, 'scc_page:community_' || (size // 100) AS page_id, 'scc_page' AS page_type, 'community_' || (size // 100) AS subject, 3 AS level FROM parts")
def plan_community_pages(spark, d):
    return planning.plan_community_pages(P.part_files(spark, d).select("repo_id", (F.col("size") / 100).cast("bigint").alias("community_id")))


@query("parts", "SELECT page_id, level FROM (SELECT 'file_page:' || path AS page_id, 1 AS level, size FROM parts UNION ALL SELECT DISTINCT 'module_page:' || regexp_extract(path, '^(.*)/', 1), 3, 0 FROM parts) WHERE size < 3000")
def remaining_pages(spark, d):
    """Planned file and module pages without those of large parts, which are done."""
    f = _metric_files(spark, d)
    done = f.where("size >= 3000").select(F.concat(F.lit("file_page:"), "path").alias("page_id"))
    return planning.remaining_pages(planning.plan_file_pages(f).unionByName(planning.plan_module_pages(f)), done).select("page_id", "level")


@query(
    "org parts",
    """SELECT p.repo_id, 'file_page:' || p.path AS page_id, 'Write concise markdown documentation for this source file.' || chr(10) || chr(10) || 'File: ' || p.path || chr(10) || chr(10) || '```' || chr(10) || p.content || chr(10) || '```' || chr(10) || chr(10)
  || coalesce('Health markers:' || chr(10) || m.t, '') || chr(10) || 'Document: purpose, key functions/types, usage notes, and any flagged issues.' AS prompt
FROM parts p LEFT JOIN (SELECT file, string_agg('- ' || type || ' (' || severity || '): ' || message || chr(10), '' ORDER BY type, severity, message) AS t FROM org GROUP BY ALL) m ON m.file = p.path""",
)
def assemble_prompts(spark, d):
    f = _metric_files(spark, d)
    none = spark.createDataFrame([], "repo_id string, community_id bigint")
    out = planning.assemble_prompts(planning.plan_file_pages(f), f, history.organisation_markers(f, P.PARAMS), none)
    return out.select("repo_id", "page_id", "prompt")


@query(
    "org",
    """SELECT repo_id, file, 'Refactor ' || file || chr(10) || chr(10) || string_agg(k || '. [' || severity || '] ' || type || ' (line 0): ' || message, chr(10) ORDER BY k) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file ORDER BY deduction DESC, type) AS k FROM org) GROUP BY repo_id, file""",
)
def refactor_prompt(spark, d):
    return planning.refactor_prompt(history.organisation_markers(_metric_files(spark, d), P.PARAMS))


@query("", "SELECT p_partkey AS id, round(greatest(0, t)::DOUBLE, 9) AS cost FROM (SELECT p_partkey, ([2000, 500, 4000][1 + p_partkey % 3] * p_size * 2.5 + [800, 200, 1500][1 + p_partkey % 3] * p_size * 10) / 1000000 AS t FROM part)")
def estimate_page_cost(spark, d):
    p = P.table(spark, d, "part")
    kind = F.array(*map(F.lit, ["file_page", "symbol_spotlight", "module_page"]))[F.pmod("p_partkey", F.lit(3)).cast("int")]
    return rounded(p.select(F.col("p_partkey").alias("id"), planning.estimate_page_cost(kind, F.col("p_size"), F.lit(2.5), F.lit(10.0)).alias("cost")), "cost", places=9)


@query("", "SELECT p_partkey AS id, round(greatest(1, ceil(p_size * 0.1)) * (2000 * 0.01 + 800 * 0.02) / 1000, 9)::DOUBLE AS part, round(p_size * (2000 * 0.01 + 800 * 0.02) / 1000, 9)::DOUBLE AS whole FROM part")
def regeneration_estimate(spark, d):
    n = F.col("p_size")
    return rounded(P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), planning.regeneration_estimate(n, F.lit(0.01), F.lit(0.02)).alias("part"), planning.regeneration_estimate(n, F.lit(0.01), F.lit(0.02), False).alias("whole")), "part", "whole", places=9)


@query("", "WITH p AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_partkey AS id, p_retailprice AS price, (SELECT count(*) FROM part) > 45 AS more FROM p WHERE k > 20 AND k <= 45")
def paginate(spark, d):
    """The second page of 25 after 20 parts, and whether more follow."""
    rows, total = increments.paginate(P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), [F.desc("price"), "id"], 25, 20)
    return rows.withColumn("more", F.lit(total > 45))


@query(
    "",
    r"""WITH p AS (SELECT page_id, lower(coalesce(html, '')) AS c FROM pages), w AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(c, '[^\p{L}\p{N}]+'), lambda x: x IN ('sidebar', 'footer', 'copy'))) AS term FROM p),
h AS (SELECT page_id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY ALL)
SELECT page_id, round(sum(tf * ln(1 + (SELECT count(*) FROM pages) / df)), 6) AS score FROM h JOIN df USING (term) GROUP BY ALL ORDER BY round(score, 9) DESC, page_id LIMIT 20""",
)
def search(spark, d):
    """Pages by the terms of a query."""
    p = P.table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("content"))
    return rounded(contracts.search_pages(p, "Sidebar footer copy"), "score").select("page_id", "score")


@query(
    "own parts",
    """SELECT * FROM (SELECT 'owner' AS kind, owner AS subject, count(*)::DOUBLE AS value FROM own GROUP BY ALL ORDER BY value DESC, owner LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'silo', key, round(share, 9) FROM own WHERE share > 0.8 ORDER BY share DESC, key LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'target', path, round(pagerank, 9) FROM parts WHERE size < 3000 ORDER BY pagerank DESC, path LIMIT 10)""",
)
def knowledge_map(spark, d):
    p = P.part_files(spark, d)
    return rounded(contracts.knowledge_map(history.ownership(P.commits(spark, d)), p.select("repo_id", "path", "pagerank"), p.where("size >= 3000")), "value", places=9)


@query(
    "symbols",
    """SELECT repo_id, file_path, name, line::INT AS line, round(0.6 * coalesce(rank / max(rank) OVER (), 0) + 0.2 * (length(file_path) % 2) + 0.2 * least(1, (1 + line) / 100), 6) AS importance FROM (SELECT *, length(file_path) / 1000 AS rank FROM symbols)""",
)
def symbol_importance(spark, d):
    """Turns as symbols of 1 + turn lines, exported where the file's name has an odd length."""
    s = P.symbols(spark, d)
    odd = F.length("file_path") % 2 == 1
    s = s.withColumn("plain", F.col("name")).withColumn("name", F.when(odd, F.initcap("name")).otherwise(F.col("name"))).withColumn("end_line", F.col("line") * 2)
    ranks = s.select("repo_id", F.col("file_path").alias("path"), (F.length("file_path") / 1000).alias("pagerank")).distinct()
    return rounded(contracts.symbol_importance(s, ranks), "importance").select("repo_id", "file_path", F.lower("name").alias("name"), "line", "importance")


# ---- states ---------------------------------------------------------------------------------------


@query("", "SELECT l_partkey AS finding_id, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) AS status FROM lineitem GROUP BY ALL")
def finding_status_update(spark, d):
    """The status of the last change of each finding."""
    li = P.table(spark, d, "lineitem").select(F.col("l_partkey").alias("finding_id"), F.col("l_returnflag").alias("status"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("changed_at"))
    return increments.finding_status_update(li).select("finding_id", "status")


@query("", "SELECT o_custkey AS repo_id, max(o_orderkey) AS head FROM orders GROUP BY ALL HAVING NOT coalesce(max(o_orderkey) FILTER (o_orderstatus <> 'O') = max(o_orderkey), false)")
def needs_reindex(spark, d):
    """Customers whose last order is still open, or who have no closed one."""
    o = P.table(spark, d, "orders")
    heads = o.groupBy(F.col("o_custkey").alias("repo_id")).agg(F.max("o_orderkey").alias("head"))
    return increments.needs_reindex(heads, o.where("o_orderstatus <> 'O'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("last_commit")))


@query("", "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY made, k) AS version, k AS id FROM (SELECT o_custkey AS page_id, o_orderdate AS made, o_orderkey AS k FROM orders)")
def page_versions(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), F.struct("o_orderdate", "o_orderkey").alias("updated_at"), F.col("o_orderkey").alias("id"))
    return contracts.page_versions(o).drop("updated_at").withColumn("version", F.col("version").cast("bigint"))


@query("files", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 3 = 1 THEN 'fresh' ELSE 'stale' END AS freshness FROM files")
def page_freshness(spark, d):
    """Pages of documents: a third lost their source, a third were made from another version."""
    f = P.files(spark, d)
    k = F.pmod("doc_id", F.lit(3))
    pages = f.select("doc_id", "repo_id", F.when(k == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("target_path"), F.sha2(F.when(k == 2, F.concat("content", F.lit("."))).otherwise(F.col("content")), 256).alias("source_hash"))
    return contracts.page_freshness(pages, f).select("doc_id", "freshness")


