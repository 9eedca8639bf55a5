"""The canonical tables as projections of the benchmark tables (whole tables, no samples)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ext_of
from ..schemas import Params

AS_OF = dt.datetime(2001, 8, 1)
PARAMS = Params(as_of=AS_OF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: repository = source, folder = language."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("lang", F.lit("und")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        F.coalesce("source", F.lit("none")).alias("repo_id"), path.alias("path"), F.lit(True).alias("is_file"), F.lit(".txt").alias("ext"), F.coalesce("text", F.lit("")).alias("content"),
        F.coalesce("n_chars", F.lit(0)).alias("size"), F.lit(None).cast("timestamp").alias("last_mod"), "doc_id", "lang",
    )


def part_path(key: str) -> Column:
    return F.concat(F.lit("m"), F.pmod(F.col(key), F.lit(25)).cast("string"), F.lit("/part_"), F.col(key).cast("string"), F.lit(".go"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as commits: commit = order, path = part, author = the customer's nation, time = order date.

    Orders meet their customers before their lines, which are more, and lines are joined by the commit's id as it is used, so
    they lie by it afterwards and what is grouped by commits needs no other shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit_id"), "l_partkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("commit_id"), "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = li.join(o.join(c, o.o_custkey == c.c_custkey), "commit_id")
    return rows.select(
        F.lit("shop").alias("repo_id"), "commit_id", F.concat(F.lit("n"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("email"), F.col("o_orderdate").cast("timestamp").alias("ts"), part_path("l_partkey").alias("path")
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files; the price stands in for a centrality where one is needed."""
    p = table(spark, sf_dir, "part")
    path = part_path("p_partkey")
    return p.select(
        F.lit("shop").alias("repo_id"), path.alias("path"), F.lit(True).alias("is_file"), ext_of(path).alias("ext"), F.col("p_name").alias("content"), (F.col("p_size") * 100).cast("bigint").alias("size"),
        (F.col("p_retailprice") / 100000).alias("pagerank"), "p_brand", "p_type",
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as symbols: name = role, file = conversation, line = turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.lit("chat").alias("repo_id"), F.col("turn").alias("seq"), F.col("role").alias("name"), F.lit("function").alias("type"), F.col("turn").cast("int").alias("line"), F.col("turn").cast("int").alias("end_line"), F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("file_path"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> part."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.select(F.lit("shop").alias("repo_id"), F.concat(F.lit("sup_"), F.col("l_suppkey").cast("string")).alias("src"), part_path("l_partkey").alias("dst"), F.lit("import").alias("rel"))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as model calls: operation = role, tokens = characters / 4."""
    c = table(spark, sf_dir, "conversations")
    tokens = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)
    return c.select(F.col("role").alias("operation"), tokens.alias("tokens"), (tokens * 3).alias("cost"))


# ---- the same in SQL ---------------------------------------------------------------------------

SQL = {
    "files": """files AS (
  SELECT coalesce(source, 'none') AS repo_id, coalesce(lang, 'und') || '/doc_' || doc_id || '.txt' AS path, '.txt' AS ext, coalesce(text, '') AS content, coalesce(n_chars, 0) AS size, doc_id, lang FROM documents)""",
    "commits": """commits AS (
  SELECT DISTINCT 'shop' AS repo_id, l_orderkey::VARCHAR AS commit_id, 'n' || lpad(c_nationkey::VARCHAR, 2, '0') AS email, o_orderdate::TIMESTAMP AS ts, 'm' || (l_partkey % 25) || '/part_' || l_partkey || '.go' AS path
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)""",
    "stats": """stats AS (SELECT repo_id, path, email, count(*) AS n, max(ts) AS last FROM commits GROUP BY ALL)""",
    "metrics": """metrics AS (
  SELECT repo_id, path, sum(n)::INT AS churn, max(n) / sum(n) AS ownership, (count(*) FILTER (last > TIMESTAMP '2001-08-01' - INTERVAL 90 DAY))::INT AS author_count,
    arg_min(email, n * -100 + substr(email, 2)::INT) AS primary_author, arg_min(last, n * -100 + substr(email, 2)::INT) AS primary_author_last_commit
  FROM stats GROUP BY ALL)""",
    "parts": """parts AS (
  SELECT 'shop' AS repo_id, 'm' || (p_partkey % 25) || '/part_' || p_partkey || '.go' AS path, p_name AS content, p_size * 100 AS size, p_retailprice / 100000 AS pagerank, p_brand, p_type FROM part)""",
    "symbols": """symbols AS (
  SELECT 'chat' AS repo_id, turn AS seq, role AS name, turn AS line, 'conv_' || conv_id AS file_path FROM conversations)""",
    "supply": """supply AS (
  SELECT DISTINCT 'shop' AS repo_id, 'sup_' || l_suppkey AS src, 'm' || (l_partkey % 25) || '/part_' || l_partkey || '.go' AS dst FROM lineitem)""",
    "usage": """usage AS (SELECT role AS operation, floor(length(coalesce(text, '')) / 4)::BIGINT AS tokens, 3 * floor(length(coalesce(text, '')) / 4)::BIGINT AS cost FROM conversations)""",
    "org": """org AS (
  SELECT repo_id, path AS file, 'developer_congestion' AS type, 'medium' AS severity, 'File touched by ' || author_count || ' distinct authors in the last 90 days' AS message, 0.5 AS deduction, 'organizational_risk' AS category FROM metrics WHERE author_count >= 5
  UNION ALL
  SELECT repo_id, path, 'knowledge_loss', 'high', 'Primary author''s last commit was ' || (epoch(TIMESTAMP '2001-08-01' - primary_author_last_commit) / 86400)::BIGINT || ' days ago on a high-churn file', 0.5, 'organizational_risk'
  FROM metrics WHERE primary_author_last_commit <= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY AND churn >= 5)""",
    "content": r"""emails AS (
  SELECT repo_id, path, len(list_filter(regexp_extract_all(content, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}'), lambda e: NOT regexp_matches(e, '(?i)@(example\.com|example\.org|example\.net|test\.com|test\.org|foo\.com|bar\.com|placeholder\.com|noreply\.com|localhost)$'))) AS n FROM files),
content AS (
  SELECT repo_id, path AS file, 'dpdp_pii_exposure' AS type, 'high' AS severity, 'Potential Aadhaar number exposure detected' AS message FROM files WHERE regexp_matches(content, '\b\d{12}\b')
  UNION ALL SELECT repo_id, path, 'dpdp_pii_exposure', 'high', 'Potential PAN number exposure detected' FROM files WHERE regexp_matches(content, '\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b')
  UNION ALL SELECT repo_id, path, 'dpdp_pii_exposure', 'medium', 'Potential UPI ID exposure detected' FROM files WHERE regexp_matches(content, '\b[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64}\b')
  UNION ALL SELECT repo_id, path, 'dpdp_mobile_exposure', 'high', 'Potential Indian mobile number exposure detected' FROM files WHERE regexp_matches(content, '(?:(?:\+91|0091|91)[-.\s]?)?[6-9]\d{9}\b')
  UNION ALL SELECT repo_id, path, 'pii_mobile_exposure', 'medium', 'Potential international mobile number (E.164) exposure detected' FROM files WHERE len(list_filter(regexp_extract_all(content, '\+[1-9]\d{7,14}\b'), lambda x: NOT starts_with(x, '+91'))) > 0
  UNION ALL SELECT repo_id, path, 'pii_email_exposure', 'medium', 'Potential email address exposure detected (' || n || ' occurrence(s))' FROM emails WHERE n > 0
  UNION ALL SELECT repo_id, path, 'untracked_consent_mutation', 'medium', 'State mutation detected without explicit consent check heuristic' FROM files WHERE regexp_matches(content, 'setState|updateUser|db\.Save|db\.Update|mutation') AND NOT contains(lower(content), 'consent')
  UNION ALL SELECT repo_id, path, 'rbi_logger_audit_gap', 'high', 'Financial handler missing correlation ID in logs' FROM files WHERE regexp_matches(content, 'Payment|Transaction') AND NOT regexp_matches(content, 'CorrelationID|RequestID')
  UNION ALL SELECT repo_id, path, 'data_sovereignty_leak', 'critical', 'PII data potentially routed to non-Indian regions' FROM files WHERE regexp_matches(content, 'us-east-1|us-west-2|eu-central-1') AND (regexp_matches(content, '\b\d{12}\b') OR regexp_matches(content, '\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b'))
  UNION ALL SELECT repo_id, path, 'token_bloat', 'low', '' FROM files WHERE floor(octet_length(encode(content)) / 4) / (length(content) - length(replace(content, chr(10), '')) + 1) > 50)""",
    "cochange": """cochange AS (
  SELECT a.repo_id, a.path AS a, b.path AS b, count(*) AS count FROM commits a JOIN commits b ON a.repo_id = b.repo_id AND a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL HAVING count(*) >= 2)""",
    "hot": """hot0 AS (
  SELECT repo_id, path, count(*) FILTER (ts > TIMESTAMP '2001-08-01' - INTERVAL 90 DAY) AS commit_count_90d, count(*) FILTER (ts > TIMESTAMP '2001-08-01' - INTERVAL 30 DAY) AS commit_count_30d,
    sum(exp(-(epoch(TIMESTAMP '2001-08-01' - ts) / 86400) / 90)) AS temporal_hotspot_score FROM commits GROUP BY ALL),
hot AS (SELECT *, 100 * percent_rank() OVER (PARTITION BY repo_id ORDER BY commit_count_90d) AS churn_percentile FROM hot0)""",
    "own": """own AS (SELECT repo_id, path AS key, arg_min(email, n * -100 + substr(email, 2)::INT) AS owner, max(n) / sum(n) AS share FROM stats GROUP BY ALL)""",
    "bus": """ranked AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS run, sum(n) OVER (PARTITION BY repo_id, path) AS total FROM stats WINDOW w AS (PARTITION BY repo_id, path ORDER BY n DESC, email ROWS UNBOUNDED PRECEDING)),
bus AS (SELECT repo_id, path, min(k)::INT AS bus_factor FROM ranked WHERE 2 * run >= total GROUP BY ALL)""",
}
#: What each part builds on.
NEEDS = {"stats": ["commits"], "metrics": ["stats"], "org": ["metrics"], "content": ["files"], "cochange": ["commits"], "hot": ["commits"], "own": ["stats"], "bus": ["stats"]}


def with_parts(parts: str, body: str) -> str:
    """``body`` after the CTEs that ``parts`` names, and what they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in parts.split():
        add(name)
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n" + body
