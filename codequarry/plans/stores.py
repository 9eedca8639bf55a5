"""Queries of sources, stored tables, streams and further rules: what is written to shared storage and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname
from ..operators import clones, coverage, graph, history, increments, planning, reports, rules
from ..sources import files as src
from ..sources import sinks
from ..storage import cut, many_files, shared_dir
from . import projections as P
from .code import KINDS
from .queries import CLONES_SQL, _content, _metric_files, _symbol_graph, query, rounded

# ---- readers --------------------------------------------------------------------------------------


@query("", "SELECT 'r' AS repo_id, 'nation=' || s_nationkey || '/supplier=' || s_suppkey AS path, '.txt' AS ext, s_name || chr(10) AS content, (length(s_name) + 1)::BIGINT AS size FROM supplier WHERE s_nationkey // 10 <> 1")
def read_repo_files(spark, d):
    """Suppliers as a tree of files; an ignore pattern leaves out some folders."""
    root = shared_dir(spark, "tree")
    s = P.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("value"))
    sinks.write_folders(s, root, "nation", "supplier")
    ignored = spark.createDataFrame([(r"(^|/)_SUCCESS$|\.crc$",), (r"nation=1\d/",)], "pattern string")
    f = src.read_repo_files(spark, root, "r", ignored)
    return f.select("repo_id", dirname("path").alias("path"), "ext", "content", "size")


def _logged(spark, d: str) -> DataFrame:
    """Orders as records of a commit log; some paths are renames, every fiftieth header is broken."""
    key, part = F.pmod("l_partkey", F.lit(7)), P.part_path("l_partkey")
    renamed = F.when(key == 0, F.regexp_replace(part, r"/(.*)\.go$", "/{old => $1}.go")).when(key == 1, F.concat(F.lit("old.go => "), part)).otherwise(part)
    li = P.table(spark, d, "lineitem").select("l_orderkey", renamed.alias("p")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("p"), "\n").alias("paths"))
    o = P.table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    seconds = F.when(F.pmod("o_orderkey", F.lit(50)) == 0, "x").otherwise(F.unix_timestamp("o_orderdate").cast("string"))
    return o.select(F.concat(F.lit("n"), F.col("o_custkey").cast("string"), F.lit("\x1f"), seconds, F.lit("\n"), "paths", F.lit("\n")).alias("value"))


@query("", "SELECT 'shop' AS repo_id, 'n' || o_custkey AS email, epoch(o_orderdate)::BIGINT AS ts, 'm' || (l_partkey % 25) || '/part_' || l_partkey || '.go' AS path, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 50 <> 0 GROUP BY ALL")
def read_commit_log(spark, d):
    """The log, written and read back."""
    path = shared_dir(spark, "log")
    _logged(spark, d).write.option("lineSep", "\x1e").text(path)
    log = src.read_commit_log(spark, path, "shop")
    return log.groupBy("repo_id", "email", F.unix_timestamp("ts").alias("ts"), "path").agg(F.count("*").alias("n"))


@query("", "SELECT 'shop' AS repo_id, '/build/o' || l_orderkey || '.go' AS key, round(100 * avg((l_quantity::BIGINT % 3 > 0)::INT), 6) AS pct FROM lineitem GROUP BY ALL")
def read_lcov(spark, d):
    """Orders as records of lcov reports, one DA line an order line."""
    path = shared_dir(spark, "lcov")
    li = P.table(spark, d, "lineitem")
    line = F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string"), F.lit(","), F.pmod(F.col("l_quantity").cast("bigint"), F.lit(3)).cast("string"))
    rows = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("da"))
    rows.select(F.concat(F.lit("TN:\nSF:/build/o"), F.col("l_orderkey").cast("string"), F.lit(".go\n"), "da", F.lit("\nend_of_record")).alias("value")).write.text(path)
    return rounded(src.read_lcov(spark, path, "shop"), "pct")


@query("", "SELECT 'shop' AS repo_id, 'src/s' || s_suppkey || '.go' AS key, round((s_suppkey % 101) / 100 * 100, 6) AS pct FROM supplier")
def read_cobertura(spark, d):
    """One report a nation, one class a supplier."""
    path = shared_dir(spark, "cobertura")
    s = P.table(spark, d, "supplier")
    one = F.concat(F.lit('<class filename="src/s'), F.col("s_suppkey").cast("string"), F.lit('.go" line-rate="'), (F.pmod("s_suppkey", F.lit(101)) / 100).cast("string"), F.lit('"/>'))
    rows = s.groupBy("s_nationkey").agg(F.array_join(F.collect_list(one), "").alias("c"))
    rows.select(F.concat(F.lit("<coverage><packages><package><classes>"), "c", F.lit("</classes></package></packages></coverage>")).alias("value"), "s_nationkey").write.partitionBy("s_nationkey").text(path)
    return rounded(src.read_cobertura(spark, path, "shop"), "pct")


@query("", "SELECT 'shop' AS repo_id, 'src/s' || s_suppkey || '.go' AS key, round(CASE WHEN s_suppkey % 9 > 0 THEN 100 * (s_suppkey % 9 // 2) / (s_suppkey % 9) ELSE 0 END, 6) AS pct FROM supplier")
def read_clover(spark, d):
    path = shared_dir(spark, "clover")
    s, n = P.table(spark, d, "supplier"), F.pmod("s_suppkey", F.lit(9))
    one = F.concat(F.lit('<file name="src/s'), F.col("s_suppkey").cast("string"), F.lit('.go"><metrics statements="'), n.cast("string"), F.lit('" coveredstatements="'), F.floor(n / 2).cast("string"), F.lit('"/></file>'))
    rows = s.groupBy("s_nationkey").agg(F.array_join(F.collect_list(one), "").alias("c"))
    rows.select(F.concat(F.lit("<clover><project>"), "c", F.lit("</project></clover>")).alias("value"), "s_nationkey").write.partitionBy("s_nationkey").text(path)
    return rounded(src.read_clover(spark, path, "shop"), "pct")


FORMATS = ["TN:\nSF:a.go\nend_of_record", '<coverage line-rate="0.5"/>', '<coverage clover="4"><clover/></coverage>', "nothing"]


@query("", "SELECT p_partkey AS id, ['lcov', 'cobertura', 'clover', NULL][1 + p_partkey % 4] AS format FROM part")
def detect_coverage_format(spark, d):
    p = P.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), src.detect_coverage_format(F.array(*map(F.lit, FORMATS))[F.pmod("p_partkey", F.lit(4)).cast("int")]).alias("format"))


@query("", "SELECT s_suppkey AS id, substr(sha256('/repos/' || s_name), 1, 12) AS repo_id FROM supplier")
def repository_id(spark, d):
    return P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), src.repository_id(F.concat(F.lit("/repos/"), "s_name")).alias("repo_id"))


# ---- stored findings and merges ----------------------------------------------------------------------


def _stored(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as findings of their suppliers' repositories; a later run with findings of every second one."""
    li = P.table(spark, d, "lineitem")
    m = rules.marker("dead_code", "low", F.lit("m"), F.col("l_linenumber"), 0.1, "dead_code")
    rows = li.select(F.concat(F.lit("0"), F.col("l_suppkey").cast("string")).alias("repo_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), m.alias("m"), "l_suppkey", "l_returnflag")
    return rows, rows.where("pmod(l_suppkey, 2) = 0 and l_returnflag = 'R'")


@query(
    "",
    """SELECT '0' || l_suppkey AS repo_id, 'o' || l_orderkey AS file, l_linenumber AS line, count(*) AS n FROM lineitem
WHERE CASE WHEN l_suppkey % 5 = 1 THEN false WHEN l_suppkey % 2 = 0 AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') THEN l_returnflag = 'R' ELSE true END GROUP BY ALL""",
)
def stored_markers(spark, d):
    """The findings after two runs: of the second, repositories 1, 6, 11 and so on have lost all of theirs."""
    path = shared_dir(spark, "markers")
    first, second = _stored(spark, d)
    full = lambda rows: rules.attach_suggestion(rows.select("repo_id", "file", "m.*"))
    sinks.write_markers(full(first), path)
    done = first.where("pmod(l_suppkey, 5) = 1").select("repo_id")
    sinks.write_markers(full(second.where("pmod(l_suppkey, 5) <> 1")), path, done)
    advice = rules.SUGGESTIONS["dead_code"]
    return sinks.load_markers(spark, path).where(F.col("suggestion") == advice).groupBy("repo_id", "file", "line").agg(F.count("*").alias("n"))


@query("content", "SELECT file, type FROM content WHERE repo_id = (SELECT min(repo_id) FROM files) AND file = (SELECT min(file) FROM content WHERE repo_id = (SELECT min(repo_id) FROM files))")
def file_markers(spark, d):
    """The findings of one file: the first with any, in the first repository."""
    m = cut(_content(spark, d), "content")
    repo = P.files(spark, d).agg(F.min("repo_id")).first()[0]
    own = increments.repo_markers(m, repo)
    return increments.file_markers(own, repo, own.agg(F.min("file")).first()[0]).select("file", "type")


@query("content", "SELECT file, type, severity FROM content WHERE repo_id = (SELECT min(repo_id) FROM files)")
def repo_markers(spark, d):
    repo = P.files(spark, d).agg(F.min("repo_id")).first()[0]
    return increments.repo_markers(_content(spark, d), repo).select("file", "type", "severity")


@query("", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS created_at FROM customer")
def upsert_repositories(spark, d):
    """Two thirds of the customers are stored; every second one comes (again) with another name."""
    c, k = P.table(spark, d, "customer"), F.col("c_custkey")
    old = c.where("c_custkey % 3 <> 0").select(k.alias("id"), F.col("c_mktsegment").alias("name"), F.lit(1).alias("created_at"))
    new = c.where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.upper("c_mktsegment"), F.lit("!"))).otherwise(F.col("c_mktsegment")).alias("name"), F.lit(2).alias("created_at"))
    return sinks.upsert_repositories(old, new)


@query("", "SELECT c_custkey AS id, c_mktsegment AS name FROM customer")
def list_repositories(spark, d):
    return sinks.list_repositories(P.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name")))


@query("", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = (SELECT arg_max(o_custkey, (o_totalprice, o_custkey)) FROM orders)")
def get_repository(spark, d):
    """The customer of the dearest order."""
    best = P.table(spark, d, "orders").agg(F.max_by("o_custkey", F.struct("o_totalprice", "o_custkey"))).first()[0]
    return sinks.get_repository(P.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), best)


@query("", "SELECT o_orderkey AS id, 'old' AS title, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE 'old' END AS content, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS updated_at FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'new', 'new', 2 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus = 'O'")
def upsert_wiki_pages(spark, d):
    """Open orders come again; a quarter of the orders isn't stored yet."""
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    page = lambda rows, x, at: rows.select("id", F.lit(x).alias("title"), F.lit(x).alias("content"), F.lit(at).alias("updated_at"))
    return sinks.upsert_wiki_pages(page(o.where("id % 4 <> 0"), "old", 1), page(o.where("o_orderstatus = 'O'"), "new", 2))


@query("", "SELECT DISTINCT l_suppkey AS job_id, l_partkey AS page_id FROM lineitem")
def mark_pages_complete(spark, d):
    """Every order line marks its part done for its supplier, some twice."""
    li = P.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("job_id"), F.col("l_partkey").alias("page_id"), "l_linenumber")
    return sinks.mark_pages_complete(li.where("l_linenumber <= 3").drop("l_linenumber"), li.where("l_linenumber > 2").drop("l_linenumber"))


@query("", "SELECT 'nation_' || s_nationkey AS type, count(*) AS pages, sum(length(s_name) + 1)::BIGINT AS bytes FROM supplier GROUP BY ALL")
def export_pages(spark, d):
    """Suppliers as exported pages; the counts told and what the files hold."""
    path = shared_dir(spark, "export")
    s = P.table(spark, d, "supplier").select(F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("type"), F.concat(F.lit("#"), "s_name").alias("subject"), F.col("s_name").alias("content"))
    told = sinks.export_pages(s, path)
    held = many_files(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path))
    held = held.groupBy(F.regexp_extract("path", "page_type=([^/]*)", 1).alias("type")).agg(F.sum("length").alias("bytes"))
    return told.join(held, "type")


@query("files", "SELECT repo_id, md5(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY path)) AS digest FROM files GROUP BY ALL")
def export_docs_bundle(spark, d):
    pages = P.files(spark, d).select("repo_id", F.col("path").alias("target_path"), "content")
    return sinks.export_docs_bundle(pages).select("repo_id", F.md5("bundle").alias("digest"))


# ---- streams -----------------------------------------------------------------------------------------

_CHANGED = P.SQL["files"].replace("coalesce(text, '') AS content", "CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE coalesce(text, '') || ' 123456789012 ' END AS content")


@query("", f"WITH {_CHANGED},\n{P.SQL['content']}\nSELECT repo_id, file, type, severity FROM content")
def stream_markers(spark, d):
    """All files in a first batch, every second one again, without its number, in a second batch of the stream."""
    from ..streaming import streams

    folder, path, state = (shared_dir(spark, n) for n in ("incoming", "found", "state"))
    f = P.files(spark, d).drop("doc_id", "lang")
    wide = f.withColumn("content", F.concat("content", F.lit(" 123456789012 "))).withColumn("last_mod", F.lit("2001-01-01").cast("timestamp"))
    second = P.files(spark, d).where("doc_id % 2 = 0").drop("doc_id", "lang").withColumn("last_mod", F.lit("2001-01-02").cast("timestamp"))
    for batch in (wide, second):
        batch.write.mode("append").parquet(folder)
        streams.stream_markers(spark.readStream.schema(wide.schema).parquet(folder), path, state).awaitTermination()
    return sinks.load_markers(spark, path).select("repo_id", "file", "type", "severity")


# ---- rules on fuller inputs --------------------------------------------------------------------------


@query(
    "files",
    "SELECT * FROM (WITH " + CLONES_SQL + """
SELECT f.repo_id, f.path AS file, f.owner, CASE WHEN a.doc_id % 200 < 90 AND b.doc_id % 200 < 90 THEN 1.5 ELSE 1.0 END::DOUBLE AS deduction FROM firsts f JOIN files a USING (repo_id, path) JOIN files b ON b.path = f.owner AND b.repo_id = f.repo_id)""",
)
def active_clones(spark, d):
    """Duplicated code weighs more where both files changed in the last 90 days; a document's age is its id modulo 200 in days."""
    age = F.expr("make_dt_interval(cast(doc_id % 200 as int))")
    f = P.files(spark, d).withColumn("last_mod", F.lit(P.AS_OF).cast("timestamp") - age)
    m = clones.dry_violations(f, "doc_id", P.PARAMS, None)
    return m.select("repo_id", "file", F.regexp_extract("message", "'(.*)'", 1).alias("owner"), "deduction")


@query(
    "parts metrics",
    """SELECT p.repo_id, p.path AS file, CASE WHEN h THEN 'untested_hotspot' ELSE 'coverage_gap' END AS type, round(CASE WHEN h THEN 1.5 ELSE (60 - pct) / 60 * 0.5 END, 9)::DOUBLE AS deduction FROM (
  SELECT p.*, size / 50 AS pct, coalesce(churn, 0) >= 10 AND size / 50 < 20 AND pagerank >= (SELECT list_sort(list(pagerank))[floor(count(*) * 0.8)::INT + 1] FROM parts) AS h FROM parts p LEFT JOIN metrics m ON m.path = p.path) p WHERE pct < 60""",
)
def untested_hotspots(spark, d):
    """Coverage of twice a part's size in per cent, churn of its commits, rank of its price."""
    f = _metric_files(spark, d)
    report = f.select("repo_id", F.concat(F.lit("/build/"), "path").alias("key"), (F.col("size") / 50).alias("pct"))
    nodes = f.select("repo_id", "path", F.lit("file").alias("node_type"), "pagerank")
    out = coverage.coverage_markers(f.drop("pagerank"), coverage.match_coverage(f, report), nodes, graph.pagerank_threshold(nodes, 0.2), P.PARAMS)
    return rounded(out, "deduction", places=9).select("repo_id", "file", "type", "deduction")


@query("parts metrics", "SELECT p.repo_id, 'Add tests for ' || path || chr(10) || chr(10) || 'Uncovered lines: ' || '1-' || size // 100 AS prompt, path AS file FROM parts p WHERE size >= 200")
def coverage_prompt(spark, d):
    """Parts without any covered line."""
    f = P.part_files(spark, d).where("size >= 200").select("repo_id", "path", (F.col("size") / 100).cast("int").alias("total_lines"), F.array().cast("array<int>").alias("covered"))
    return planning.coverage_prompt(coverage.uncovered_ranges(f))


@query("symbols", "SELECT page_id FROM (SELECT DISTINCT 'symbol_spotlight:' || file_path || ':' || name AS page_id, length(file_path) AS r, file_path, name FROM symbols) ORDER BY r DESC, file_path, name LIMIT 50")
def plan_top_symbol_pages(spark, d):
    """The fifty symbols of the files with the highest ranks, the length of their names."""
    nodes = _symbol_graph(spark, d)[0].withColumn("pagerank", F.length("path").cast("double"))
    return planning.plan_symbol_pages(nodes, 50).select("page_id")


def _kinds_sql(i: int) -> str:
    return "[" + ", ".join(str(x[i]) for x in KINDS) + f"][1 + p_partkey % {len(KINDS)}]"


@query(
    "",
    f"""SELECT 'shop' AS repo_id, page_type, pages::BIGINT AS pages FROM (SELECT
  unnest(['file_page', 'symbol_spotlight', 'module_page', 'scc_page', 'api_contract', 'infra_page', 'repo_overview', 'architecture_diagram', 'onboarding']) AS page_type,
  unnest([count(*), (SELECT count(*) FROM conversations), count(DISTINCT CASE WHEN p_partkey % {len(KINDS)} = 12 THEN 'm' || p_partkey % 25 || '/.github/workflows' WHEN p_partkey % {len(KINDS)} = 13 THEN 'm' || p_partkey % 25 || '/ci' ELSE 'm' || p_partkey % 25 END), count(DISTINCT p_size), sum({_kinds_sql(4)}), sum({_kinds_sql(2)}), 1, 1, 1]) AS pages FROM part)""",
)
def page_counts_by_kind(spark, d):
    """Counts with symbols, communities, contracts, infrastructure and continuous integration."""
    p = P.table(spark, d, "part")
    name = F.array(*[F.lit(x[0]) for x in KINDS])[F.pmod("p_partkey", F.lit(len(KINDS))).cast("int")]
    f = p.select(F.lit("shop").alias("repo_id"), F.concat(F.lit("m"), F.pmod("p_partkey", F.lit(25)).cast("string"), F.lit("/"), name).alias("path"), F.lit(True).alias("is_file"))
    communities = p.select(F.lit("shop").alias("repo_id"), F.col("p_size").alias("community_id"))
    return planning.page_counts(f, P.symbols(spark, d).select(F.lit("shop").alias("repo_id")), communities)


@query("files", r"SELECT repo_id, path AS file FROM files WHERE regexp_matches(content, '\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b') OR regexp_matches(content, '(?:(?:\+91|0091|91)[-.\s]?)?[6-9]\d{9}\b')")
def pii_switches(spark, d):
    """With PAN and mobile numbers switched on alone."""
    m = rules.content_markers(P.files(spark, d), rules.pii_rules(["pan", " MOBILE "]))
    return m.where("type <> 'pii_mobile_exposure'").select("repo_id", "file").distinct()


@query("", "SELECT 'shop' AS repo_id, 'c' || c_custkey AS path, max(o_orderdate) >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY AS recent, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL".replace(">= TIMESTAMP", "> TIMESTAMP"))
def recent_authors(spark, d):
    """Whether a path's one author was active in the last 90 days."""
    o = P.table(spark, d, "orders")
    c = o.select(F.lit("shop").alias("repo_id"), F.col("o_orderkey").cast("string").alias("commit_id"), F.lit("a").alias("email"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"))
    m = history.file_metrics(c, P.PARAMS)
    return m.select("repo_id", "path", (F.col("author_count") > 0).alias("recent"), F.col("churn").cast("bigint").alias("n"))


@query("", "SELECT o_orderpriority AS type, o_orderkey AS subject, o_custkey % 7 AS level FROM orders")
def list_wiki_pages(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("subject"), F.pmod("o_custkey", F.lit(7)).alias("level"))
    return planning.list_wiki_pages(o)


@query("", "SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS created_at FROM orders")
def list_wiki_jobs(spark, d):
    return planning.list_wiki_jobs(P.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").alias("created_at")))


@query("own", "SELECT regexp_extract(key, '^([^/]*)', 1) AS module, round(avg(share), 6) AS score FROM own GROUP BY ALL")
def module_rollup_sort(spark, d):
    """Modules by their files' mean share of the first owner."""
    o = history.ownership(P.commits(spark, d)).groupBy(F.substring_index("key", "/", 1).alias("module")).agg(F.avg("share").alias("score"))
    return rounded(reports.module_rollup_sort(o), "score")
