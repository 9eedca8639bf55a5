"""Registered queries: each applies operators to whole tables; most have the same in SQL.

Floating results are rounded on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import coverage_band
from ..operators import clones, contracts, coverage, graph, history, increments, planning, reports, rules, scoring
from ..schemas import Params
from ..storage import cut
from . import projections as P
from .projections import with_parts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(parts: str = "", sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_parts(parts, sql) if parts else sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


# ---- history -------------------------------------------------------------------------------------


@query("stats", "SELECT repo_id, path, email, n, epoch(last)::BIGINT AS last FROM stats")
def file_author_stats(spark, d):
    return history.file_author_stats(P.commits(spark, d)).withColumn("last", F.unix_timestamp("last"))


@query("metrics", "SELECT repo_id, path, churn, round(ownership, 6) AS ownership, author_count, primary_author, epoch(primary_author_last_commit)::BIGINT AS last FROM metrics")
def file_metrics(spark, d):
    m = history.file_metrics(P.commits(spark, d), P.PARAMS)
    return rounded(m, "ownership").withColumn("last", F.unix_timestamp("primary_author_last_commit")).drop("primary_author_last_commit")


def _metric_files(spark, d) -> DataFrame:
    return history.with_metrics(P.part_files(spark, d), history.file_metrics(P.commits(spark, d), P.PARAMS))


@query("org", "SELECT * FROM org")
def organisation_markers(spark, d):
    return history.organisation_markers(_metric_files(spark, d), P.PARAMS).drop("line")


@query(
    "org",
    """, raw AS (SELECT repo_id, file, category, sum(deduction) AS s, count(*) AS c FROM org GROUP BY ALL)
SELECT repo_id, file, 10.0::DOUBLE AS base, greatest(1, least(10, 10 - sum(least(s, 1.0))))::DOUBLE AS final, sum(c)::BIGINT AS marker_count, sum(least(s, 1.0))::DOUBLE AS organizational_risk
FROM raw GROUP BY ALL""".replace(", raw AS", "SELECT * FROM (WITH raw AS").rstrip() + ")",
)
def file_score(spark, d):
    s = scoring.file_score(history.organisation_markers(_metric_files(spark, d), P.PARAMS))
    return s.withColumn("organizational_risk", F.col("deductions")["organizational_risk"]).drop("deductions")


@query("org", "SELECT repo_id, file, count(*) AS findings, sum(deduction)::DOUBLE AS deduction FROM org GROUP BY ALL ORDER BY deduction DESC, findings DESC, file LIMIT 20")
def top_files(spark, d):
    return scoring.top_files(history.organisation_markers(_metric_files(spark, d), P.PARAMS), 20)


@query(
    "org parts",
    """SELECT s.repo_id, round(sum(pagerank * final) / sum(pagerank), 6) AS score FROM (
  SELECT p.repo_id, p.path, p.pagerank, 10 - least(1.0, coalesce(sum(o.deduction), 0)) AS final FROM parts p LEFT JOIN org o ON o.file = p.path GROUP BY ALL) s GROUP BY ALL""",
)
def repo_score(spark, d):
    f = _metric_files(spark, d)
    scores = scoring.file_score(history.organisation_markers(f, P.PARAMS))
    return rounded(scoring.repo_score(f, scores, f), "score")


@query(
    "org",
    """SELECT dimension, value, count(*) AS findings, sum(deduction)::DOUBLE AS deduction FROM (
  SELECT 'total' AS dimension, '' AS value, deduction FROM org UNION ALL SELECT 'severity', severity, deduction FROM org
  UNION ALL SELECT 'type', type, deduction FROM org UNION ALL SELECT 'category', category, deduction FROM org) GROUP BY ALL""",
)
def marker_summary(spark, d):
    return scoring.marker_summary(history.organisation_markers(_metric_files(spark, d), P.PARAMS))


@query("org", "SELECT repo_id, file, category, sum(deduction)::DOUBLE AS raw, least(sum(deduction), 1.0)::DOUBLE AS applied, 1.0::DOUBLE AS cap, sum(deduction) > 1.0 AS capped, (100 * least(sum(deduction), 1.0))::DOUBLE AS pct_of_cap FROM org GROUP BY ALL")
def score_breakdown(spark, d):
    return scoring.score_breakdown(history.organisation_markers(_metric_files(spark, d), P.PARAMS))


@query("cochange", "SELECT * FROM cochange")
def co_changes(spark, d):
    return history.co_changes(P.commits(spark, d), 2)


@query(
    "metrics cochange",
    """SELECT repo_id, path AS file, 'phantom_coupling' AS type, 'medium' AS severity, 'Phantom coupling detected in ' || path || ': Churn=' || churn || ', Ownership=' || floor(ownership * 100)::INT || '%' AS message
FROM metrics WHERE churn >= 5 AND ownership < 0.12 AND path NOT IN (SELECT a FROM cochange UNION ALL SELECT b FROM cochange)""",
)
def phantom_coupling(spark, d):
    f = _metric_files(spark, d)
    nodes = graph.build_nodes(P.part_files(spark, d))  # the same files; their metrics are counted once
    edges = graph.add_co_change_edges(history.co_changes(P.commits(spark, d), 2), nodes)
    out = graph.phantom_coupling(f, nodes, edges, Params(as_of=P.AS_OF, phantom_ownership=0.12))
    return out.select("repo_id", "file", "type", "severity", "message")


@query(
    "stats",
    """SELECT s.repo_id, s.path, c.total, c.d90, c.d30, epoch(c.first)::BIGINT AS first, epoch(c.last)::BIGINT AS last, c.age_days, count(*) AS contributor_count, arg_min(email, n * -100 + substr(email, 2)::INT) AS primary_owner, round(max(n) / sum(n), 6) AS primary_owner_share
FROM stats s JOIN (SELECT repo_id, path, count(*) AS total, count(*) FILTER (ts > TIMESTAMP '2001-08-01' - INTERVAL 90 DAY) AS d90, count(*) FILTER (ts > TIMESTAMP '2001-08-01' - INTERVAL 30 DAY) AS d30, min(ts) AS first, max(ts) AS last,
  date_diff('day', min(ts)::DATE, DATE '2001-08-01')::INT AS age_days FROM commits GROUP BY ALL) c USING (repo_id, path) GROUP BY ALL""",
)
def git_metadata(spark, d):
    m = history.git_metadata(P.commits(spark, d), P.PARAMS)
    return rounded(m, "primary_owner_share").select(
        "repo_id", "path", F.col("commit_count_total").alias("total"), F.col("commit_count_90d").alias("d90"), F.col("commit_count_30d").alias("d30"), F.unix_timestamp("first_commit_at").alias("first"), F.unix_timestamp("last_commit_at").alias("last"), "age_days", "contributor_count", "primary_owner", "primary_owner_share"
    )


@query("hot", "SELECT repo_id, path, commit_count_90d, commit_count_30d, round(temporal_hotspot_score, 6) AS temporal_hotspot_score, round(churn_percentile, 6) AS churn_percentile, churn_percentile >= 80 AS is_hotspot FROM hot")
def hotspots(spark, d):
    return rounded(history.hotspots(P.commits(spark, d), P.PARAMS), "temporal_hotspot_score", "churn_percentile")


@query("own", "SELECT repo_id, key, owner, round(share, 6) AS share, share > 0.8 AS is_silo FROM own")
def ownership(spark, d):
    return rounded(history.ownership(P.commits(spark, d)), "share")


@query("bus", "SELECT * FROM bus")
def bus_factor(spark, d):
    return history.bus_factor(P.commits(spark, d))


@query(
    "hot own",
    """SELECT h.*, a.author_count, a.commit_count, t.top_owner, t.top_owner_files FROM
(SELECT repo_id, count(*) AS file_count, count(*) FILTER (churn_percentile >= 80) AS hotspot_count, round(avg(churn_percentile), 6) AS mean_percentile FROM hot GROUP BY ALL) h
JOIN (SELECT repo_id, count(DISTINCT email) AS author_count, count(DISTINCT commit_id) AS commit_count FROM commits GROUP BY ALL) a USING (repo_id)
JOIN (SELECT repo_id, arg_min(owner, files * -100 + substr(owner, 2)::INT) AS top_owner, max(files) AS top_owner_files FROM (SELECT repo_id, owner, count(*) AS files FROM own GROUP BY ALL) GROUP BY ALL) t USING (repo_id)""",
)
def git_summary(spark, d):
    return rounded(history.git_summary(P.commits(spark, d), P.PARAMS), "mean_percentile")


@query(
    "own",
    """SELECT s.repo_id, s.email, count(*) AS files, count(DISTINCT regexp_extract(path, '^(.*)/', 1)) AS modules, sum(n)::BIGINT AS commits, epoch(max(last))::BIGINT AS last, coalesce((SELECT count(*) FROM own o WHERE o.owner = s.email), 0) AS owned_files,
  (SELECT date_diff('day', min(ts)::DATE, DATE '2001-08-01') FROM commits c WHERE c.email = s.email)::INT AS tenure_days FROM stats s GROUP BY s.repo_id, s.email""",
)
def owners(spark, d):
    return history.owners(P.commits(spark, d), P.PARAMS).withColumn("last", F.unix_timestamp("last_commit_at")).drop("first_commit_at", "last_commit_at")


@query(
    "stats",
    """SELECT a.repo_id, a.email, b.email AS other, count(*) AS shared, t.total, round(count(*) / t.total, 6) AS share FROM stats a JOIN stats b ON a.repo_id = b.repo_id AND a.path = b.path AND a.email <> b.email
JOIN (SELECT repo_id, email, count(*) AS total FROM stats GROUP BY ALL) t ON t.email = a.email GROUP BY a.repo_id, a.email, b.email, t.total""",
)
def co_authors(spark, d):
    return rounded(history.co_authors(P.commits(spark, d)), "share")


@query(
    "stats",
    """SELECT repo_id, email, round(sum(n / total * exp(-(epoch(TIMESTAMP '2001-08-01' - last) / 86400) / 365)), 6) AS score
FROM (SELECT *, sum(n) OVER (PARTITION BY repo_id, path) AS total FROM stats) GROUP BY ALL""",
)
def reviewer_suggestions(spark, d):
    c = P.commits(spark, d)
    return rounded(history.reviewer_suggestions(c, c.select("repo_id", "path").distinct(), P.PARAMS), "score")


@query("hot", "SELECT b::INT AS bucket, count(path) AS files FROM range(10) r(b) LEFT JOIN hot ON least(9, floor(churn_percentile / 10)) = b GROUP BY ALL")
def churn_histogram(spark, d):
    return reports.churn_histogram(history.hotspots(P.commits(spark, d), P.PARAMS))


def _hot(spark, d) -> DataFrame:
    c = P.commits(spark, d)
    return history.hotspots(c, P.PARAMS).join(history.bus_factor(c), ["repo_id", "path"])


@query(
    "hot",
    """SELECT repo_id, path, round(churn_percentile, 6) AS churn_percentile, CASE WHEN commit_count_90d > 0 AND commit_count_30d * 3 / commit_count_90d >= 1.25 THEN 'heating' WHEN commit_count_90d > 0 AND commit_count_30d * 3 / commit_count_90d <= 0.75 THEN 'cooling' ELSE 'steady' END AS trend
FROM hot ORDER BY hot.churn_percentile DESC, path LIMIT 8""",
)
def trend(spark, d):
    return rounded(reports.trend(history.hotspots(P.commits(spark, d), P.PARAMS)), "churn_percentile")


@query(
    "hot bus",
    """, r AS (SELECT repo_id, path, floor(100 * (0.4::DOUBLE * churn_percentile / 100 + 0.35::DOUBLE * CASE WHEN bus_factor <= 1 THEN 1.0 WHEN bus_factor = 2 THEN 0.5 ELSE 0 END + 0.25::DOUBLE * least(1.0, temporal_hotspot_score / 10)) + 0.5)::INT AS risk FROM hot JOIN bus USING (repo_id, path))
SELECT repo_id, path, risk, CASE WHEN risk < 25 THEN 'low' WHEN risk < 45 THEN 'moderate' WHEN risk < 70 THEN 'high' ELSE 'critical' END AS band FROM r ORDER BY risk DESC, path LIMIT 30""".replace(", r AS", "SELECT * FROM (WITH r AS") + ")",
)
def hotspot_risk(spark, d):
    return reports.hotspot_risk(_hot(spark, d))


@query("bus", "SELECT CASE WHEN bus_factor >= 3 THEN 'healthy' WHEN bus_factor = 2 THEN 'medium' ELSE 'risk' END AS level, count(*) AS files FROM bus GROUP BY ALL")
def bus_factor_distribution(spark, d):
    return reports.bus_factor_distribution(history.bus_factor(P.commits(spark, d)))


@query(
    "hot bus",
    """SELECT repo_id, path, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT repo_id, path, CASE WHEN churn_percentile <= 1 THEN churn_percentile * 100 ELSE churn_percentile END AS x, (8 - greatest(1, least(8, bus_factor))) / 7 * 100 AS y FROM hot JOIN bus USING (repo_id, path))
WHERE x >= 50 AND y >= 50 ORDER BY round(x + y, 9) DESC, path LIMIT 5""",
)
def churn_x_bus_danger(spark, d):
    return rounded(reports.churn_x_bus_danger(_hot(spark, d)), "x", "y")


# ---- file content --------------------------------------------------------------------------------


def _content(spark, d) -> DataFrame:
    return rules.content_markers(P.files(spark, d))


@query("content", "SELECT * FROM content")
def content_markers(spark, d):
    m = _content(spark, d)
    return m.select("repo_id", "file", "type", "severity", F.when(F.col("type") == "token_bloat", "").otherwise(F.col("message")).alias("message"))


@query("content", "SELECT regexp_extract(file, '^([^/]*)', 1) AS directory, count(*) FILTER (severity IN ('high', 'critical')) AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM content GROUP BY ALL ORDER BY total DESC, directory LIMIT 16")
def findings_by_directory(spark, d):
    return reports.findings_by_directory(_content(spark, d), 1)


@query("content", "SELECT type, count(*) AS findings FROM content GROUP BY ALL")
def findings_by_type(spark, d):
    return reports.findings_by_type(_content(spark, d))


@query("content", "SELECT severity, count(*) AS findings, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM content GROUP BY ALL")
def severity_distribution(spark, d):
    return rounded(reports.severity_distribution(_content(spark, d)), "pct")


@query("content", "SELECT repo_id, type, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM content GROUP BY ALL")
def biomarker_breakdown(spark, d):
    return scoring.biomarker_breakdown(_content(spark, d))


CLONES_SQL = r"""toks AS (SELECT repo_id, path, doc_id, content, list_filter(regexp_split_to_array(content, '[^\p{L}\p{Nd}_]+'), lambda x: x <> '') AS t FROM files),
wins AS (SELECT repo_id, path, doc_id, i AS pos, t[i + 1:i + 6] AS w FROM (SELECT *, unnest(range(0, len(t) - 5, 3)) AS i FROM toks WHERE len(t) >= 6)),
owners AS (SELECT repo_id, w, min({'o': doc_id, 'pos': pos, 'path': path}) AS owner FROM wins GROUP BY ALL),
hits AS (SELECT wins.repo_id, path, owner.path AS owner, pos, w[1] AS token FROM wins JOIN owners USING (repo_id, w) WHERE path <> owner.path),
firsts AS (SELECT repo_id, path, owner, arg_min(token, pos) AS token FROM hits GROUP BY ALL)"""


@query(
    "files",
    "SELECT * FROM (WITH " + CLONES_SQL + """
SELECT f.repo_id, f.path AS file, 'dry_violation' AS type, f.owner, (len(string_split(string_split(content, f.token)[1], chr(10))))::INT AS line, 1.0::DOUBLE AS deduction FROM firsts f JOIN files USING (repo_id, path))""",
)
def dry_violations(spark, d):
    m = clones.dry_violations(P.files(spark, d), "doc_id", P.PARAMS, None)
    return m.select("repo_id", "file", "type", F.regexp_extract("message", "'(.*)'", 1).alias("owner"), "line", "deduction")


@query("files", "SELECT repo_id, coalesce(lang, 'und') AS directory, count(*) AS files FROM files GROUP BY ALL")
def directory_descendants(spark, d):
    return graph.directory_descendants(P.files(spark, d)).groupBy("repo_id", "directory").agg(F.count("*").alias("files"))


@query("files", "SELECT coalesce(lower(lang), 'unknown') AS language, count(*) AS files FROM files GROUP BY ALL")
def language_distribution(spark, d):
    return reports.language_distribution(P.files(spark, d).withColumnRenamed("lang", "language"))


@query(
    "files",
    r"""SELECT repo_id, path, 'modified' AS change FROM files WHERE content <> regexp_replace(content, 'Licensed[^\n]*', '', 'g')""",
)
def changed_files(spark, d):
    before = P.files(spark, d)
    return increments.changed_files(before, before.withColumn("content", F.regexp_replace("content", r"Licensed[^\n]*", "")))


# ---- graph -----------------------------------------------------------------------------------------


def _supply_nodes(spark, d) -> DataFrame:
    e = P.supply_edges(spark, d)
    ends = e.select("repo_id", F.explode(F.array("src", "dst")).alias("path")).distinct()
    return graph.build_nodes(ends.withColumn("is_file", F.lit(True)))


def _pagerank_sql(rounds: int) -> str:
    """Rounds of the power iteration as chained CTEs."""
    head = """nodes AS (SELECT src AS key FROM supply UNION SELECT dst FROM supply), deg AS (SELECT src AS key, count(*) AS o FROM supply GROUP BY ALL), n AS (SELECT count(*) AS n FROM nodes),
r0 AS (SELECT key, 1.0::DOUBLE / n AS r FROM nodes, n)"""
    for i in range(rounds):
        head += f""",
r{i + 1} AS (SELECT x.key, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(f, 0) + lost / n) AS r FROM r{i} x CROSS JOIN n
  CROSS JOIN (SELECT coalesce(sum(r), 0) AS lost FROM r{i} WHERE key NOT IN (SELECT key FROM deg)) l
  LEFT JOIN (SELECT dst AS key, sum(r / o) AS f FROM supply JOIN r{i} ON src = r{i}.key JOIN deg ON src = deg.key GROUP BY ALL) g ON g.key = x.key)"""
    return f"SELECT * FROM (WITH {head}\nSELECT 'shop' AS repo_id, key, round(r, 9) AS pagerank FROM r{rounds})"


@query("supply", _pagerank_sql(8))
def pagerank(spark, d):
    return rounded(graph.pagerank(_supply_nodes(spark, d), P.supply_edges(spark, d), P.PARAMS, 8, 0.0), "pagerank", places=9)


@query("supply", "SELECT 'shop' AS repo_id, key, count(*) FILTER (k = 1) AS in_degree, count(*) FILTER (k = 0) AS out_degree FROM (SELECT src AS key, 0 AS k FROM supply UNION ALL SELECT dst, 1 FROM supply) GROUP BY ALL")
def degrees(spark, d):
    return graph.degrees(P.supply_edges(spark, d))


@query("parts", "SELECT repo_id, path, pagerank, floor(100 * (rank() OVER (PARTITION BY repo_id ORDER BY pagerank) - 1) / count(*) OVER (PARTITION BY repo_id) + 0.5)::INT AS pagerank_percentile FROM parts")
def percentile_of(spark, d):
    return graph.percentile_of(P.part_files(spark, d).select("repo_id", "path", "pagerank"), "pagerank")


@query("parts", "SELECT repo_id, list_sort(list(pagerank))[(floor(count(*) * 0.9))::INT + 1] AS value FROM parts GROUP BY ALL")
def pagerank_threshold(spark, d):
    return graph.pagerank_threshold(P.part_files(spark, d).withColumn("node_type", F.lit("file")), 0.10)


@query("symbols", "SELECT repo_id, file_path AS file, 'hallucination_bait' AS type, 'Overlapping symbol name ''' || name || ''' in the same module/file' AS message, line::INT AS line FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path, name ORDER BY seq) AS k FROM symbols) WHERE k > 1")
def hallucination_bait(spark, d):
    return graph.hallucination_bait(P.symbols(spark, d)).select("repo_id", "file", "type", "message", "line")


def _symbol_graph(spark, d):
    s = P.symbols(spark, d)
    conv = s.select("repo_id", F.col("file_path").alias("path")).distinct().withColumn("is_file", F.lit(True))
    nodes = graph.build_nodes(conv, s)
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id", "file_path").orderBy("seq")
    nxt = s.select("repo_id", F.concat_ws(":", "file_path", "name").alias("src"), F.concat_ws(":", "file_path", F.lead("name").over(w)).alias("dst"), F.lead("name").over(w).alias("n")).where("n is not null")
    return nodes, nxt.select("repo_id", "src", "dst")


NODES_SQL = "nodes AS (SELECT repo_id, file_path || ':' || name AS key, file_path AS path, name, arg_min(line, seq)::INT AS line FROM symbols GROUP BY ALL)"
CALLS_SQL = NODES_SQL + ",\ncalls AS (SELECT DISTINCT repo_id, file_path || ':' || name AS src, file_path || ':' || n AS dst FROM (SELECT *, lead(name) OVER (PARTITION BY repo_id, file_path ORDER BY seq) AS n FROM symbols) WHERE n IS NOT NULL)"


@query("symbols", f"SELECT * FROM (WITH {NODES_SQL}\nSELECT repo_id, key, 'symbol' AS node_type, name, path, line FROM nodes UNION ALL SELECT DISTINCT repo_id, file_path, 'file', file_path, file_path, 0 FROM symbols)")
def build_nodes(spark, d):
    return _symbol_graph(spark, d)[0].select("repo_id", "key", "node_type", "name", "path", "line")


@query("symbols", f"SELECT * FROM (WITH {NODES_SQL}\nSELECT repo_id, path AS src, key AS dst, 'contains' AS rel FROM nodes)")
def contains_edges(spark, d):
    return graph.contains_edges(_symbol_graph(spark, d)[0])


@query("symbols", f"SELECT * FROM (WITH {CALLS_SQL}\nSELECT repo_id, src, dst, 'calls' AS rel FROM calls)")
def call_edges(spark, d):
    nodes, calls = _symbol_graph(spark, d)
    return graph.add_call_edges(calls, nodes)[0]


@query("symbols", f"SELECT * FROM (WITH {CALLS_SQL}\nSELECT repo_id, path AS file, 'dead_code' AS type, 'Symbol ''' || name || ''' has zero incoming call edges' AS message, line, 0.1::DOUBLE AS deduction FROM nodes WHERE key NOT IN (SELECT dst FROM calls))")
def dead_code(spark, d):
    nodes, calls = _symbol_graph(spark, d)
    return graph.dead_code(nodes, graph.add_call_edges(calls, nodes)[0]).select("repo_id", "file", "type", "message", "line", "deduction")


@query("symbols", f"SELECT * FROM (WITH {CALLS_SQL}\nSELECT DISTINCT repo_id, src AS key FROM calls WHERE src NOT IN (SELECT dst FROM calls))")
def entry_points(spark, d):
    nodes, calls = _symbol_graph(spark, d)
    return graph.entry_points(graph.add_call_edges(calls, nodes)[0])


def _modules(spark, d) -> DataFrame:
    return P.part_files(spark, d).select("repo_id", F.col("path").alias("key"), F.col("p_brand").alias("module"))


def _module_links(spark, d) -> DataFrame:
    pairs = history.co_changes(P.commits(spark, d), 2).select("repo_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    return graph.module_edges(pairs, _modules(spark, d))


MODULE_SQL = "links AS (SELECT c.repo_id, x.p_brand AS source, y.p_brand AS target, count(*) AS edge_count FROM cochange c JOIN parts x ON x.path = a JOIN parts y ON y.path = b WHERE x.p_brand <> y.p_brand GROUP BY ALL)"


@query("cochange parts", f"SELECT * FROM (WITH {MODULE_SQL} SELECT * FROM links)")
def module_edges(spark, d):
    return _module_links(spark, d)


@query("cochange parts", f"SELECT * FROM (WITH {MODULE_SQL} SELECT repo_id, module, sum(edge_count)::BIGINT AS dependencies FROM (SELECT repo_id, source AS module, edge_count FROM links UNION ALL SELECT repo_id, target, edge_count FROM links) GROUP BY ALL)")
def module_dep_count(spark, d):
    return graph.module_dep_count(_module_links(spark, d))


@query("parts", "SELECT repo_id, regexp_extract(path, '^([^/]*)', 1) AS module, count(*) AS file_count, round(avg(pagerank), 9) AS avg_pagerank FROM parts GROUP BY ALL")
def group_files_as_modules(spark, d):
    f = P.part_files(spark, d).withColumns({"symbol_count": F.lit(0), "has_doc": F.lit(False)})
    return rounded(graph.group_files_as_modules(f), "avg_pagerank", places=9).select("repo_id", "module", "file_count", "avg_pagerank")


def _co_change_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; the pairs are written, as both are read off them."""
    pairs = cut(history.co_changes(P.commits(spark, d), 2).select("repo_id", F.col("a").alias("src"), F.col("b").alias("dst")), "pairs")
    return pairs.select("repo_id", F.explode(F.array("src", "dst")).alias("key")).distinct(), pairs


@query()
def communities(spark, d):
    """Its SQL, the rounds written out, is in ``graphs``."""
    return graph.communities(*_co_change_graph(spark, d), Params(as_of=P.AS_OF, rounds=5))


# ---- coverage ----------------------------------------------------------------------------------------


def _coverage(spark, d) -> DataFrame:
    """Labels as a report with absolute keys: covered = quality."""
    rows = P.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    f = P.files(spark, d).select("repo_id", "path", "doc_id")
    return rows.join(f, "doc_id").select("repo_id", F.concat(F.lit("/build/"), "path").alias("key"), (F.col("q") * 100.0).alias("pct"))


MATCH_SQL = "lab AS (SELECT doc_id, max(quality) * 100.0::DOUBLE AS pct FROM labels GROUP BY ALL), hit AS (SELECT repo_id, path, pct, content FROM files JOIN lab USING (doc_id))"


@query("files", f"SELECT * FROM (WITH {MATCH_SQL} SELECT repo_id, path, pct, false AS ambiguous FROM hit)")
def match_coverage(spark, d):
    return coverage.match_coverage(P.files(spark, d), _coverage(spark, d))


@query("files", f"SELECT * FROM (WITH {MATCH_SQL} SELECT repo_id, path AS file, 'coverage_gap' AS type, (60 - pct) / 60 * 0.5 AS deduction FROM hit WHERE pct < 60)")
def coverage_markers(spark, d):
    f = P.files(spark, d).withColumn("churn", F.lit(0))
    nodes = f.select("repo_id", "path", F.lit("file").alias("node_type"), F.lit(0.0).alias("pagerank"))
    out = coverage.coverage_markers(f, coverage.match_coverage(f, _coverage(spark, d)), nodes, graph.pagerank_threshold(nodes, 0.2))
    return out.select("repo_id", "file", "type", "deduction")


@query("files", f"SELECT * FROM (WITH {MATCH_SQL} SELECT CASE WHEN pct < 30 THEN 'critical' WHEN pct < 60 THEN 'low' WHEN pct < 80 THEN 'fair' ELSE 'good' END AS band, count(*) AS files FROM hit GROUP BY ALL)")
def coverage_bands(spark, d):
    return coverage.match_coverage(P.files(spark, d), _coverage(spark, d)).groupBy(coverage_band("pct").alias("band")).agg(F.count("*").alias("files"))


@query(
    "",
    """WITH g AS (SELECT o, line, line - row_number() OVER (PARTITION BY o ORDER BY line) AS i FROM (
  SELECT l_orderkey AS o, unnest(list_filter(range(1, 8), lambda x: NOT list_contains(list(DISTINCT l_linenumber), x))) AS line FROM lineitem GROUP BY l_orderkey)),
r AS (SELECT o, min(line) AS a, max(line) AS b FROM g GROUP BY o, i)
SELECT o::VARCHAR AS path, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges, 0 AS more FROM r GROUP BY o""",
)
def uncovered_ranges(spark, d):
    li = P.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("covered"))
    return coverage.uncovered_ranges(li.select(F.lit("shop").alias("repo_id"), "path", F.lit(7).alias("total_lines"), "covered")).drop("repo_id")


# ---- planning ----------------------------------------------------------------------------------------

TIERS = {"cheap": "gpt-4o-mini", "medium": "gpt-4o", "premium": "claude-opus-4-1"}

COUNTS_SQL = """counts AS (SELECT repo_id, count(*) AS files, count(DISTINCT regexp_extract(path, '^(.*)/', 1)) AS modules FROM files GROUP BY ALL),
avgs AS (SELECT repo_id, greatest(200, (sum(size) FILTER (size > 0)::BIGINT // greatest(count(*) FILTER (size > 0), 1)) // 4) AS a, count(*) FILTER (size > 0) AS k FROM files GROUP BY ALL),
entries AS (
  SELECT repo_id, 'file_page' AS page_type, files AS pages, 'cheap' AS tier, 'gpt-4o-mini' AS model, CASE WHEN k > 0 THEN a + 500 ELSE 2000 END AS i, CASE WHEN k > 0 THEN greatest(200, a // 3) ELSE 800 END AS o, 0.15 AS pi, 0.60 AS po FROM counts JOIN avgs USING (repo_id)
  UNION ALL SELECT repo_id, 'module_page', modules, 'medium', 'gpt-4o', CASE WHEN k > 0 THEN a * 3 + 1000 ELSE 4000 END, CASE WHEN k > 0 THEN greatest(500, a // 2) ELSE 1500 END, 2.5, 10 FROM counts JOIN avgs USING (repo_id)
  UNION ALL SELECT repo_id, 'repo_overview', 1, 'premium', 'claude-opus-4-1', 8000, 3000, 15, 75 FROM counts
  UNION ALL SELECT repo_id, 'architecture_diagram', 1, 'premium', 'claude-opus-4-1', 10000, 4000, 15, 75 FROM counts
  UNION ALL SELECT repo_id, 'onboarding', 1, 'premium', 'claude-opus-4-1', 6000, 2500, 15, 75 FROM counts)"""


def _counts(spark, d) -> DataFrame:
    none = spark.createDataFrame([], "repo_id string, community_id bigint")
    return planning.page_counts(P.files(spark, d), spark.createDataFrame([], "repo_id string"), none)


def _priced(spark) -> DataFrame:
    names = spark.createDataFrame([(m,) for m in TIERS.values()], "model string")
    return planning.price_models(names, planning.prices(spark))


@query("files", f"SELECT * FROM (WITH {COUNTS_SQL} SELECT repo_id, page_type, tier, model, pages, round((i * pages * pi + o * pages * po)::DOUBLE / 1000000, 4) AS est_cost FROM entries)")
def generation_plan(spark, d):
    plan = planning.generation_plan(_counts(spark, d), planning.token_heuristics(P.files(spark, d)), TIERS, _priced(spark))
    return rounded(plan, "est_cost", places=4)


@query(
    "files",
    f"""SELECT * FROM (WITH {COUNTS_SQL}, s AS (SELECT e.*, pct, CASE WHEN tier = 'premium' THEN pages ELSE greatest(1, floor(pages * pct))::BIGINT END AS p FROM entries e, (SELECT unnest([0.10, 0.15, 0.20, 0.30, 0.40, 0.50])::DOUBLE AS pct))
SELECT repo_id, pct, pct = 0.2 AS recommended, sum(p)::BIGINT AS total_pages, round(sum((i * p * pi + o * p * po)::DOUBLE / 1000000) * 0.8, 4) AS min_cost, round(sum((i * p * pi + o * p * po)::DOUBLE / 1000000) * 1.2, 4) AS max_cost FROM s GROUP BY ALL)""",
)
def coverage_options(spark, d):
    out = planning.coverage_options(_counts(spark, d), planning.token_heuristics(P.files(spark, d)), TIERS, _priced(spark))
    return rounded(out, "min_cost", "max_cost", places=4)


@query("parts metrics", "SELECT p.repo_id, p.path, round(pagerank * 0.7 + 0.3 * coalesce(churn, 0) / (SELECT max(churn) FROM metrics), 6) AS importance FROM parts p LEFT JOIN metrics m ON m.path = p.path")
def importance_rank(spark, d):
    return rounded(planning.importance_rank(_metric_files(spark, d)), "importance").select("repo_id", "path", "importance")


@query(
    "parts metrics",
    """SELECT repo_id, 'api_contract:' || path AS page_id, 'api_contract' AS page_type, path AS subject, 2 AS level FROM (
  SELECT p.repo_id, p.path, pagerank * 0.7::DOUBLE + coalesce(churn, 0) / (SELECT max(churn) FROM metrics) * 0.3::DOUBLE AS s FROM parts p LEFT JOIN metrics m ON m.path = p.path ORDER BY s DESC, p.path LIMIT 50)""",
)
def plan_file_pages(spark, d):
    return planning.plan_file_pages(_metric_files(spark, d), "api_contract", 50)


@query("parts", "SELECT DISTINCT repo_id, 'module_page:' || regexp_extract(path, '^(.*)/', 1) AS page_id, 'module_page' AS page_type, regexp_extract(path, '^(.*)/', 1) AS subject, 3 AS level FROM parts")
def plan_module_pages(spark, d):
    return planning.plan_module_pages(P.part_files(spark, d))


# ---- costs and portfolio --------------------------------------------------------------------------------


@query("usage", "SELECT operation, count(*) AS calls, sum(tokens)::BIGINT AS tokens, sum(cost)::BIGINT AS cost FROM usage GROUP BY ALL")
def llm_costs(spark, d):
    return reports.llm_costs(P.usage_log(spark, d), "operation")


@query("usage", "SELECT operation, sum(cost)::BIGINT AS cost, round(sum(cost) / sum(sum(cost)) OVER (), 6) AS share FROM usage GROUP BY ALL HAVING sum(cost) > 0 ORDER BY 2 DESC, operation LIMIT 12")
def cost_concentration(spark, d):
    return rounded(reports.cost_concentration(P.usage_log(spark, d)), "share")


@query("usage", "SELECT count(*) AS calls, sum(tokens)::BIGINT AS tokens, sum(cost)::BIGINT AS cost, round(sum(tokens) / count(*), 6) AS tokens_per_call, round(sum(cost) / count(*), 6) AS cost_per_call FROM usage")
def cost_averages(spark, d):
    return rounded(reports.cost_averages(P.usage_log(spark, d)), "tokens_per_call", "cost_per_call")


@query(
    "own parts",
    """SELECT * FROM (WITH big AS (SELECT owner, count(*) AS files FROM own GROUP BY ALL ORDER BY files DESC, owner LIMIT 20), pairs AS (
  SELECT DISTINCT path, email AS owner FROM stats WHERE email IN (SELECT owner FROM big))
SELECT a.owner AS a, b.owner AS b, count(*) AS shared FROM pairs a JOIN pairs b ON a.path = b.path AND a.owner < b.owner GROUP BY ALL)""".replace("SELECT owner, count(*) AS files FROM own", "SELECT email AS owner, count(*) AS files FROM stats"),
)
def contributor_network(spark, d):
    stats = history.file_author_stats(P.commits(spark, d))
    return reports.contributor_network(stats.select("path", F.col("email").alias("owner")))[1]


@query("commits", "SELECT repo_id, count(DISTINCT path) AS files, count(DISTINCT regexp_extract(path, '^(.*)/', 1)) AS modules FROM commits GROUP BY ALL")
def repo_modules(spark, d):
    return history.repo_modules(P.commits(spark, d))


@query(
    "files",
    """SELECT a AS repo_a, b AS repo_b, days, round(days / least(ta, tb), 6) AS strength FROM (
  SELECT x.repo_id AS a, y.repo_id AS b, count(*) AS days FROM (SELECT DISTINCT repo_id, lang, day FROM d) x JOIN (SELECT DISTINCT repo_id, lang, day FROM d) y ON x.lang = y.lang AND x.day = y.day AND x.repo_id < y.repo_id GROUP BY ALL)
JOIN (SELECT repo_id AS a, count(DISTINCT (lang, day)) AS ta FROM d GROUP BY ALL) USING (a) JOIN (SELECT repo_id AS b, count(DISTINCT (lang, day)) AS tb FROM d GROUP BY ALL) USING (b)""".replace("FROM d)", "FROM (SELECT repo_id, coalesce(lang, 'und') AS lang, size // 1000 AS day FROM files))").replace("FROM d GROUP", "FROM (SELECT repo_id, coalesce(lang, 'und') AS lang, size // 1000 AS day FROM files) GROUP"),
)
def cross_repo_co_changes(spark, d):
    f = P.files(spark, d)
    day = F.date_add(F.lit("2001-01-01").cast("date"), F.expr("cast(size div 1000 as int)")).cast("timestamp")
    rows = f.select("repo_id", F.coalesce("lang", F.lit("und")).alias("email"), day.alias("ts"))
    return rounded(contracts.cross_repo_co_changes(rows), "strength")


# ---- streams over the events table, run to completion -------------------------------------------------------


@query("", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP))::BIGINT AS window_start, event_type AS path, count(*) AS commits FROM events GROUP BY ALL")
def stream_file_churn(spark, d):
    """The same transformation as the stream, on the whole table (the tests run it as a stream)."""
    from ..streaming.streams import stream_file_churn as churn

    e = P.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"))
    return churn(e).withColumn("window_start", F.unix_timestamp("window_start"))


@query(
    "",
    """WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id::VARCHAR AS email, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 2 HOUR) AS session_end, count(*) AS commits FROM s GROUP BY user_id, k""",
)
def stream_author_sessions(spark, d):
    from ..streaming.streams import stream_author_sessions as sessions

    e = P.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("email"))
    return sessions(e).withColumns({"session_start": F.unix_micros("session_start"), "session_end": F.unix_micros("session_end")})


# ---- lookups and roll-ups ------------------------------------------------------------------------------


@query("supply", "SELECT 'shop' AS repo_id, src AS key, dst AS other, 'import' AS direction FROM supply UNION ALL SELECT 'shop', dst, src, 'importer' FROM supply")
def neighbors(spark, d):
    return graph.neighbors(P.supply_edges(spark, d))


@query("symbols", "SELECT repo_id, file_path, name, line::INT AS line FROM symbols WHERE name = 'user'")
def search_symbols(spark, d):
    return increments.search_symbols(P.symbols(spark, d), "user", "function").select("repo_id", "file_path", "name", "line")


@query("content", "SELECT repo_id, file, type, severity FROM content WHERE severity = 'high'")
def filter_markers(spark, d):
    return increments.filter_markers(_content(spark, d), severity="HIGH").select("repo_id", "file", "type", "severity")


@query("content", "SELECT repo_id, file, type, severity FROM content WHERE severity <> 'low'")
def min_severity(spark, d):
    return increments.min_severity(_content(spark, d), "medium").select("repo_id", "file", "type", "severity")


@query(
    "org parts",
    """SELECT repo_id, count(*) AS files, round(avg(final), 6) AS mean_score, count(*) FILTER (final < 4) AS red, count(*) FILTER (final >= 4 AND final < 7) AS amber, count(*) FILTER (final >= 7) AS green FROM (
  SELECT p.repo_id, p.path, 10 - least(1.0, coalesce(sum(o.deduction), 0)) AS final FROM parts p LEFT JOIN org o ON o.file = p.path GROUP BY ALL) GROUP BY ALL""",
)
def health_overview(spark, d):
    f = _metric_files(spark, d)
    scores = scoring.file_score(history.organisation_markers(f, P.PARAMS))
    return rounded(scoring.health_overview(scoring.all_file_scores(f, scores)), "mean_score")


@query(
    "org parts",
    """SELECT o.repo_id, o.file, sum(deduction)::DOUBLE AS impact, max(type) AS primary, CASE WHEN size < 100 THEN 'S' WHEN size < 300 THEN 'M' WHEN size < 800 THEN 'L' ELSE 'XL' END AS effort,
  round(sum(deduction) / CASE WHEN size < 100 THEN 1 WHEN size < 300 THEN 2 WHEN size < 800 THEN 4 ELSE 8 END, 6) AS impact_per_effort FROM org o JOIN parts p ON p.path = o.file GROUP BY o.repo_id, o.file, size""",
)
def refactoring_targets(spark, d):
    f = _metric_files(spark, d)
    out = scoring.refactoring_targets(history.organisation_markers(f, P.PARAMS), f.select("repo_id", "path", F.col("size").alias("nloc")))
    return rounded(out, "impact_per_effort").drop("nloc")


def _labelled(spark, d):
    """Parts with their size as community, and co-change edges between them."""
    parts = P.part_files(spark, d)
    nodes = parts.select("repo_id", F.col("path").alias("key"), "path", "pagerank", (F.col("size") / 100).cast("bigint").alias("community_id"))
    return nodes, history.co_changes(P.commits(spark, d), 2).select("repo_id", F.col("a").alias("src"), F.col("b").alias("dst"))


@query(
    "parts cochange",
    """SELECT * FROM (WITH e AS (SELECT x.size // 100 AS ca, y.size // 100 AS cb FROM cochange JOIN parts x ON x.path = a JOIN parts y ON y.path = b),
i AS (SELECT c, count(*) FILTER (inner_) AS internal, count(*) FILTER (NOT inner_) AS crossing FROM (SELECT ca AS c, ca = cb AS inner_ FROM e UNION ALL SELECT cb, false FROM e WHERE ca <> cb) GROUP BY c)
SELECT repo_id, (size // 100)::BIGINT AS community_id, count(*) AS members, coalesce(max(internal), 0) AS internal, coalesce(max(crossing), 0) AS crossing, round(coalesce(max(internal) / nullif(max(internal) + max(crossing), 0), 0), 6) AS cohesion
FROM parts LEFT JOIN i ON c = size // 100 GROUP BY repo_id, size // 100)""",
)
def communities_summary(spark, d):
    out = graph.communities_summary(*_labelled(spark, d)).withColumnRenamed("cross", "crossing").drop("top_file")
    return rounded(out, "cohesion")


@query(
    "parts cochange",
    "SELECT c.repo_id, (x.size // 100)::BIGINT AS source, (y.size // 100)::BIGINT AS target, count(*) AS edge_count FROM cochange c JOIN parts x ON x.path = a JOIN parts y ON y.path = b WHERE x.size <> y.size GROUP BY ALL",
)
def community_links(spark, d):
    return graph.community_links(*_labelled(spark, d))


@query("files", "SELECT repo_id, count(*) AS files, sum(size)::BIGINT AS bytes, count(DISTINCT regexp_extract(path, '^(.*)/', 1)) AS modules FROM files GROUP BY ALL")
def repo_stats(spark, d):
    f = P.files(spark, d)
    none = spark.createDataFrame([], "repo_id string")
    return contracts.repo_stats(f, none, none).select("repo_id", "files", "bytes", "modules")


@query("hot bus", "SELECT count(*) AS \"all\", count(*) FILTER (churn_percentile >= 80) AS hot, count(*) FILTER (bus_factor <= 1) AS bus_factor, count(*) FILTER (commit_count_30d * 3 > commit_count_90d) AS accelerating FROM hot JOIN bus USING (repo_id, path)")
def hotspot_preset_counts(spark, d):
    return reports.hotspot_preset_counts(_hot(spark, d))


@query("commits", "SELECT repo_id, regexp_extract(path, '^([^/]*)', 1) AS module, sum(c)::BIGINT AS covered_lines, (7 * count(*))::BIGINT AS total_lines, round(100 * sum(c) / (7 * count(*)), 6) AS pct FROM (SELECT repo_id, path, commit_id, count(*) AS c FROM commits GROUP BY ALL) GROUP BY ALL")
def coverage_rollup(spark, d):
    rows = P.commits(spark, d).distinct().select("repo_id", "path", F.lit(1).alias("covered_lines"), F.lit(7).alias("total_lines"))
    return rounded(coverage.coverage_rollup(rows), "pct")


@query("symbols", f"SELECT * FROM (WITH {NODES_SQL}\nSELECT repo_id, 'symbol_spotlight:' || key AS page_id, 'symbol_spotlight' AS page_type, key AS subject, 0 AS level FROM nodes)")
def plan_symbol_pages(spark, d):
    nodes = _symbol_graph(spark, d)[0].withColumn("pagerank", F.lit(0.0))
    return planning.plan_symbol_pages(nodes)


@query("files", "SELECT repo_id, page_type, pages::BIGINT AS pages FROM (SELECT repo_id, unnest(['file_page', 'symbol_spotlight', 'module_page', 'scc_page', 'api_contract', 'infra_page', 'repo_overview', 'architecture_diagram', 'onboarding']) AS page_type, unnest([count(*), 0, count(DISTINCT coalesce(lang, 'und')), 0, 0, 0, 1, 1, 1]) AS pages FROM files GROUP BY repo_id)")
def page_counts(spark, d):
    return _counts(spark, d)
