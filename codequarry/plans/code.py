"""Queries on source code that is written from rows: one function an order, one snippet a part.

The tables hold no code, so a projection writes it, in such a way that SQL knows every metric in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code, paths
from ..operators import graph, increments, rules, security
from . import projections as P
from .queries import query

EXTS = [".go", ".py", ".ts", ".java"]


def _one_of(texts, which: Column) -> Column:
    """The text of a number from 0; a literal array, so no text is put together line by line in a row."""
    return F.array(*map(F.lit, texts))[which.cast("int")]


def _each(last: int, line) -> str:
    """The lines for 1..last, joined."""
    return "".join(map(line, range(1, last + 1)))


def code_files(spark, d: str) -> DataFrame:
    """Orders as files with one function each: k nested branches, m branches in a row, n statements, p parameters."""
    # a row becomes a text of about a kilobyte that Python reads: rows are dealt before, as a small table is few splits of a file
    o = P.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    key = F.col("o_orderkey")
    path = F.concat(F.lit("src"), F.pmod(F.col("o_custkey"), F.lit(20)).cast("string"), F.lit("/f"), key.cast("string"), F.array(*map(F.lit, EXTS))[F.pmod(key, F.lit(4)).cast("int")])
    rows = o.select(
        F.lit("code").alias("repo_id"), path.alias("path"), F.lit(True).alias("is_file"), paths.ext_of(path).alias("ext"), F.concat(F.lit("f"), key.cast("string")).alias("name"), (1 + F.pmod("o_custkey", F.lit(14))).alias("k"),
        F.pmod(key, F.lit(5)).alias("m"), F.pmod(F.floor("o_totalprice"), F.lit(97)).alias("n"), F.pmod(key, F.lit(9)).alias("p"), (F.col("o_totalprice") / 1000000).alias("pagerank"),
    )
    k, m, n, p, name = (F.col(c) for c in ("k", "m", "n", "p", "name"))

    def body(indent: int, opening: tuple[str, str], closing: bool) -> Column:
        tabs = "\t" * indent
        test = lambda i: f"{opening[0]}{i}{opening[1]}"
        end = f"{tabs}}}\n" if closing else ""
        ends = lambda k: _each(k, lambda i: "\t" * (k - i + indent) + "}\n") if closing else ""
        nested = [_each(x, lambda i: "\t" * (i + indent - 1) + test(i)) + "\t" * (x + indent) + "x = 1\n" + ends(x) for x in range(15)]
        flat = [_each(x, lambda i: f"{tabs}{test(i)}{tabs}\ty = 1\n{end}") for x in range(5)]
        return F.concat(_one_of(nested, k), _one_of(flat, m), F.repeat(F.lit(f"{tabs}z = z + 1\n"), n.cast("int")), F.lit(f"{tabs}return z\n"))

    typed = _one_of([", ".join(f"a{i} int" for i in range(1, x + 1)) for x in range(9)], p)
    text = (
        F.when(F.col("ext") == ".go", F.concat(F.lit("package p\n\nfunc "), name, F.lit("("), typed, F.lit(") int {\n"), body(1, ("if a > ", " {\n"), True), F.lit("}\n")))
        .when(F.col("ext") == ".py", F.concat(F.lit("def "), name, F.lit("(a, b):\n"), body(1, ("if a > ", ":\n"), False)))
        .when(F.col("ext") == ".ts", F.concat(F.lit("function "), name, F.lit("(a, b) {\n"), body(1, ("if (a > ", ") {\n"), True), F.lit("}\n")))
        .otherwise(F.concat(F.lit("class C {\n\tpublic int "), name, F.lit("(int a) {\n"), body(2, ("if (a > ", ") {\n"), True), F.lit("\t}\n}\n")))
    )
    return rows.withColumn("content", text)


FUNCTIONS_SQL = """fn AS (
  SELECT 'code' AS repo_id, 'src' || (o_custkey % 20) || '/f' || o_orderkey || ['.go', '.py', '.ts', '.java'][1 + o_orderkey % 4] AS path, ['.go', '.py', '.ts', '.java'][1 + o_orderkey % 4] AS ext, 'f' || o_orderkey AS name,
    1 + o_custkey % 14 AS k, o_orderkey % 5 AS m, floor(o_totalprice)::BIGINT % 97 AS n, o_orderkey % 9 AS p, o_totalprice / 1000000 AS pagerank, [3, 1, 1, 2][1 + o_orderkey % 4] AS start_line FROM orders),
metrics AS (
  SELECT *, (CASE WHEN ext = '.py' THEN k + 2 * m + n + 3 ELSE 2 * k + 3 * m + n + 4 END)::INT AS nloc, (1 + k + m)::INT AS cyclomatic, (CASE WHEN ext = '.py' THEN 0 ELSE 1 + k END)::INT AS max_nesting, m + (k = 1)::INT >= 3 AS bumpy, CASE WHEN ext = '.go' THEN p ELSE 0 END AS params FROM fn)"""


@query("", f"WITH {FUNCTIONS_SQL}\nSELECT repo_id, path, ext, name, start_line::INT AS start_line, (start_line + nloc - CASE WHEN ext = '.py' THEN 0 ELSE 1 END)::INT AS end_line, nloc, cyclomatic, max_nesting, bumpy, params::INT AS params, repeat('int ', params) AS types FROM metrics")
def function_metrics(spark, d):
    """Functions of four languages with all metrics and Go parameter types."""
    m = code.function_metrics(code_files(spark, d))
    return m.withColumn("types", F.array_join(F.transform("params", lambda x: F.concat(x, F.lit(" "))), "")).withColumn("params", F.size("params"))


@query("", f"WITH {FUNCTIONS_SQL}\nSELECT path, CASE WHEN ext IN ('.java', '.py') THEN 80 ELSE 60 END AS large, params AS primitive FROM metrics")
def size_thresholds(spark, d):
    """How many parameters are of primitive types, and what counts as a large method."""
    m = code.function_metrics(code_files(spark, d))
    return m.select("path", code.large_method_threshold("ext").alias("large"), F.size(F.filter("params", lambda x: F.array_contains(code.primitive_types("ext"), x))).cast("bigint").alias("primitive"))


@query(
    "",
    f"""WITH {FUNCTIONS_SQL},
least AS (SELECT list_sort(list(pagerank))[floor(count(*) * 0.9)::INT + 1] AS v FROM fn)
SELECT repo_id, path AS file, type, severity, message, start_line::INT AS line, deduction::DOUBLE AS deduction, category FROM (
  SELECT *, 'brain_method' AS type, 'high' AS severity, 'Brain method ''' || name || ''': NLOC=' || nloc || ' cyclomatic=' || cyclomatic || ' nesting=' || max_nesting AS message, 1.5 AS deduction, 'structural_complexity' AS category FROM metrics, least WHERE nloc > 50 AND cyclomatic >= 15 AND max_nesting >= 4 AND pagerank >= v
  UNION ALL SELECT *, 0, 'nested_complexity', 'medium', 'Nested complexity in ''' || name || ''': max depth=' || max_nesting, 1.0, 'structural_complexity' FROM metrics WHERE max_nesting >= 4
  UNION ALL SELECT *, 0, 'bumpy_road', 'medium', 'Bumpy road in ''' || name || ''': ≥3 sequential branches at same level', 1.0, 'structural_complexity' FROM metrics WHERE bumpy
  UNION ALL SELECT *, 0, 'complex_method', 'medium', 'Complex method ''' || name || ''': cyclomatic=' || cyclomatic, 0.8, 'size_api_complexity' FROM metrics WHERE cyclomatic >= 9
  UNION ALL SELECT *, 0, 'large_method', 'low', 'Large method ''' || name || ''': ' || nloc || ' NLOC (threshold ' || t || ')', 0.6, 'size_api_complexity' FROM (SELECT * FROM metrics), (SELECT unnest([60, 80]) AS t) WHERE nloc > t AND t = CASE WHEN ext IN ('.java', '.py') THEN 80 ELSE 60 END
  UNION ALL SELECT *, 0, 'primitive_obsession', 'low', 'Primitive obsession in ''' || name || ''': ' || params || ' primitive params', 0.6, 'size_api_complexity' FROM metrics WHERE params >= 6)""".replace("SELECT *, 0, 'large_method'", "SELECT *, 'large_method'"),
)
def structural_markers(spark, d):
    """All six findings on functions; PageRank is the order's price."""
    f = code_files(spark, d)
    nodes = f.select("repo_id", "path", F.lit("file").alias("node_type"), "pagerank")
    return code.structural_markers(code.function_metrics(f), nodes, graph.pagerank_threshold(nodes, 0.10), P.PARAMS).select("repo_id", "file", "type", "severity", "message", "line", "deduction", "category")


#: (extension, a line of code, the security rule that it fires or "", the content rule or "").
SNIPPETS = [
    (".go", "go func(n int) { work(n) }(1)", "unsecured_goroutine", ""),
    (".go", "go work(1)", "unsecured_goroutine", ""),
    (".go", "sum := crypto.NewMD5(data)", "broken_crypto", ""),
    (".go", 'rows := db.Query("SELECT a FROM t WHERE id = " + id)', "tainted_sql", ""),
    (".go", "resp, err := http.Get(target)", "ssrf_blind", ""),
    (".go", "func TransferFunds(a int) {", "bypassed_rbac", ""),
    (".go", 'conn.Do("KEYS", "*")', "redis_unbounded_keys_scan", ""),
    (".go", "x := add(1, 2)", "", ""),
    (".ts", "items.forEach(x => { total = x })", "async_race_condition", ""),
    (".ts", "items.forEach(x => { " + "skip(1); " * 20 + "total = x })", "async_race_condition", ""),
    (".ts", "function load(a) { var x = 1; await get(x) }", "read_before_await", ""),
    (".ts", "crypto.createHash('md5')", "broken_crypto", ""),
    (".ts", "db.query('SELECT a FROM t WHERE id = ' + id)", "tainted_sql", ""),
    (".ts", "fetch(address)", "ssrf_blind", ""),
    (".ts", "function withdrawAll(a) {", "bypassed_rbac", ""),
    (".ts", 'connect({ host: "h", password: "" })', "redis_empty_password_auth", ""),
    (".ts", "const y = add(1, 2)", "", ""),
    (".java", "public void run() { count = 1; }", "unsynchronized_mutation", ""),
    (".java", 'MessageDigest.getInstance("MD5")', "broken_crypto", ""),
    (".java", 's.executeQuery("SELECT a FROM t WHERE id = " + id)', "tainted_sql", ""),
    (".java", "address.openStream()", "ssrf_blind", ""),
    (".java", "public int payAll(int a) {", "bypassed_rbac", ""),
    (".py", "await store.load(1)", "logical_race", ""),
    (".py", "hashlib.md5(data)", "broken_crypto", ""),
    (".py", 'cursor.execute("SELECT a FROM t WHERE id = %s" % id)', "tainted_sql", ""),
    (".py", "requests.get(address)", "ssrf_blind", ""),
    (".py", "def delete_all(a):", "bypassed_rbac", ""),
    (".py", "y = add(1, 2)", "", ""),
    (".kt", 'MessageDigest.getInstance("MD5")', "kotlin_broken_crypto", ""),
    (".kt", "GlobalScope.launch { go() }", "kotlin_goroutine_shared_state", ""),
    (".kt", "db.rawQuery(text, args)", "kotlin_tainted_sql", ""),
    (".kt", 'val apiKey = "abc"', "kotlin_hardcoded_secret", ""),
    (".tf", 'ingress { cidr_blocks = ["0.0.0.0/0"] }', "tf_open_ingress", ""),
    (".tf", 'password = "abc"', "tf_hardcoded_secret", ""),
    (".tf", 'resource "aws_s3_bucket" "b" {', "tf_unencrypted_s3", ""),
    (".dart", "await load(); setState(() => x = 1);", "", "dart_setstate_after_await"),
    (".dart", "await load(); Navigator.of(context).pop();", "", "dart_context_after_await"),
    (".dart", "final h = MD5(data);", "", "dart_broken_crypto"),
    (".dart", "final h = add(1, 2);", "", ""),
    (".sql", "SELECT a FROM t WHERE id = CONCAT(a, b);", "", "sql_injection_risk"),
    (".sql", "SELECT * FROM t;", "", "sql_select_star"),
    (".sql", "ALTER USER a PASSWORD 'abcdefgh';", "", "sql_hardcoded_credential"),
    (".sql", "SELECT a FROM t;", "", ""),
]
LEVELS = {"dart_setstate_after_await": "high", "dart_context_after_await": "medium", "dart_broken_crypto": "high", "sql_injection_risk": "high", "sql_select_star": "low", "sql_hardcoded_credential": "critical"}


def snippet_files(spark, d: str) -> DataFrame:
    """Parts as files: as many empty lines as the size modulo 7, then the part's snippet."""
    p = P.table(spark, d, "part")
    which = F.pmod("p_partkey", F.lit(len(SNIPPETS))).cast("int")
    line, ext = F.array(*[F.lit(s) for _, s, _, _ in SNIPPETS])[which], F.array(*[F.lit(e) for e, *_ in SNIPPETS])[which]
    before = F.repeat(F.lit("\n"), F.pmod("p_size", F.lit(7)))
    return p.select(F.lit("snips").alias("repo_id"), F.concat(F.lit("s/part_"), F.col("p_partkey").cast("string"), ext).alias("path"), F.lit(True).alias("is_file"), ext.alias("ext"), F.concat(before, line, F.lit("\n")).alias("content"))


def _names(column: int) -> str:
    return "[" + ", ".join(f"'{x[column]}'" for x in SNIPPETS) + "]"


_SNIPPET = f"1 + p_partkey % {len(SNIPPETS)}"
SNIPPETS_SQL = f"""snips AS (SELECT 'snips' AS repo_id, 's/part_' || p_partkey || {_names(0)}[{_SNIPPET}] AS path, {_names(0)}[{_SNIPPET}] AS ext, {_names(2)}[{_SNIPPET}] AS rule, {_names(3)}[{_SNIPPET}] AS type, (1 + p_size % 7)::INT AS line FROM part)"""


@query("", f"WITH {SNIPPETS_SQL}\nSELECT repo_id, path AS file_path, rule AS name, 'biomarker' AS type, line, line AS end_line FROM snips WHERE rule <> ''")
def security_symbols(spark, d):
    return security.security_symbols(snippet_files(spark, d)).select("repo_id", "file_path", "name", "type", "line", "end_line")


#: (extension, code on several lines, its hits as rule, first and last line); near misses stand in comments, literals and inner blocks.
BLOCKS = [
    (".go", ["go func() {", "\tif a {", "\t\tb = 1", "\t}", "}()", "// go work()", 's := "go func() {"'], [("unsecured_goroutine", 1, 1), ("goroutine_outer_mutation", 1, 1)]),
    (".go", ["/* crypto.NewMD5(x)", "h.NewMD5(x) */", "h.NewSHA1(", "\tdata,", ")", "t := `x.NewDES(y)`"], [("broken_crypto", 3, 5)]),
    (".go", ["db.Query(", '\tjoin(a + b), "x + y",', ")", 'db.Exec("a " +', "\tb)"], [("tainted_sql", 4, 5)]),
    (".go", ["http.Get(f(address))", 'http.Get("u")', "http.Do(a, b.c)", "http.Post(x.y, kind)"], [("ssrf_blind", 3, 3), ("ssrf_blind", 4, 4)]),
    (".go", ['c.Do("GET", "a")', "// c.Do(\"KEYS\")", 'c.Do(x, "keys *")', "log(\"c.Do(\\\"KEYS\\\")\")"], [("ssrf_blind", 3, 3), ("redis_unbounded_keys_scan", 3, 3)]),
    (".ts", ["a.map(x => {", "\tif (x) {", "\t\ty = 1;", "\t}", "\tconst z = 2;", "})", "a.map(x => {", "\tif (x) { f() }", "\tb.c[0] = x;", "})"], [("async_race_condition", 7, 10)]),
    (".ts", ["function f(a) {", "\tvar b = { c: 1 };", "\tif (a) {", "\t\tg();", "\t}", "\tawait h(b);", "}", "function g(a) {", "\tawait h(a);", "\tvar c = 1;", "}"], [("read_before_await", 1, 7)]),
    (".ts", ['const a = { b: 1, password: "" };', "// { password: \"\" }", 'const c = { password: "x" };', "c.createHash('sha256')", 'c.createHash("sha1")'], [("redis_empty_password_auth", 1, 1), ("broken_crypto", 5, 5)]),
    (".java", ["void run(int a) {", "\tif (a == 1) {", "\t\tb = 2;", "\t}", "}", "int rerun() throws E {", "\tint a = 1;", "\tthis.b += a;", "}", "new Trunk(a) { }"], [("unsynchronized_mutation", 6, 9)]),
    (".java", ['getInstance("SHA-256")', 'getInstance(name, "DES")', "s.executeQuery(f(a + b))", "s.executeUpdate(a + b)"], [("broken_crypto", 2, 2), ("tainted_sql", 4, 4)]),
    (".py", ['"""', "await f(x)", "hashlib.md5(x)", '"""', "# await f(x)", "await f(", "    g(x),", ")"], [("logical_race", 6, 8)]),
    (".py", ['c.execute("a", -1)', 'c.execute("a" % b)', "requests.get(f(a), timeout=1)", "requests.post(a, b)"], [("tainted_sql", 2, 2), ("ssrf_blind", 4, 4)]),
    (".kt", ["// GlobalScope.launch { }", "GlobalScope.launch {", "\trun {", "\t}", "}", "db.query()", 'val token: String? = "a"'], [("kotlin_goroutine_shared_state", 2, 5), ("kotlin_hardcoded_secret", 7, 7)]),
    (".tf", ['resource "aws_s3_bucket" "a" {', '  password = "var.x"', "  tags = {", '    token = "b"', "  }", "}", '# resource "aws_s3_bucket" "c" {'], [("tf_unencrypted_s3", 1, 6), ("tf_hardcoded_secret", 4, 4)]),
    (".tf", ["ingress {", "  tags = {", '    a = "b"', "  }", '  cidr_blocks = ["10.0.0.0/8",', '    "0.0.0.0/0"]', "}", "ingress {", '  note = "0.0.0.0/0"', '  cidr_blocks = ["10.0.0.0/8"]', "}"], [("tf_open_ingress", 1, 7)]),
]


def block_files(spark, d: str) -> DataFrame:
    """Parts as files: empty lines as many as the size modulo 7, then the part's code one to three times."""
    p = P.table(spark, d, "part")
    of = lambda values: F.array(*map(F.lit, values))[F.pmod("p_partkey", F.lit(len(BLOCKS))).cast("int")]
    text = F.concat(F.repeat(F.lit("\n"), F.pmod("p_size", F.lit(7))), F.repeat(of(["\n".join(x) + "\n" for _, x, _ in BLOCKS]), 1 + F.pmod("p_size", F.lit(3))))
    ext = of([e for e, *_ in BLOCKS])
    return p.select(F.lit("blocks").alias("repo_id"), F.concat(F.lit("b/part_"), F.col("p_partkey").cast("string"), ext).alias("path"), ext.alias("ext"), text.alias("content"))


_BLOCKS_SQL = f"""hit AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{e}', {len(x)}, '{r}', {a}, {b})" for i, (e, x, h) in enumerate(BLOCKS) for r, a, b in h)}) AS t(i, ext, lines, rule, a, b))"""


@query("", f"WITH {_BLOCKS_SQL}\nSELECT 'b/part_' || p_partkey || ext AS file_path, rule AS name, (p_size % 7 + n * lines + a)::INT AS line, (p_size % 7 + n * lines + b)::INT AS end_line FROM part JOIN hit ON i = p_partkey % {len(BLOCKS)}, range(3) AS r(n) WHERE n <= p_size % 3")
def security_blocks(spark, d):
    """Rules on code of several lines: nested bodies, arguments over lines, several hits, near misses."""
    return security.security_symbols(block_files(spark, d)).select("file_path", "name", "line", "end_line")


_REPORTED = ", ".join(f"'{x}'" for x in security.SECURITY_TYPES)


@query("", f"WITH {SNIPPETS_SQL}\nSELECT repo_id, path AS file, rule AS type, 'high' AS severity, 'Pattern ''' || rule || ''' matched' AS message, line FROM snips WHERE rule IN ({_REPORTED})")
def security_findings(spark, d):
    """The opt-in findings, of the rules that a security report shows."""
    m = security.security_markers(security.security_symbols(snippet_files(spark, d)))
    return security.security_findings(m).select("repo_id", "file", "type", "severity", "message", "line")


_LEVELS = " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in LEVELS.items())


@query("", f"WITH {SNIPPETS_SQL}\nSELECT repo_id, path AS file, type, CASE type {_LEVELS} END AS severity FROM snips WHERE type <> ''")
def language_markers(spark, d):
    """The Dart and SQL rules among all content rules."""
    return rules.content_markers(snippet_files(spark, d)).where(F.col("type").isin(*LEVELS)).select("repo_id", "file", "type", "severity")


_ADVICE = " ".join("WHEN '{}' THEN '{}'".format(t, s.replace("'", "''")) for t, s in rules.SUGGESTIONS.items())


@query(
    "org",
    f"""SELECT * FROM (WITH {SNIPPETS_SQL}
SELECT repo_id, file, type, coalesce(CASE type {_ADVICE} END, '') AS suggestion FROM (SELECT repo_id, file, type FROM org UNION ALL SELECT repo_id, path, rule FROM snips WHERE rule <> '' UNION ALL SELECT repo_id, path, type FROM snips WHERE type <> ''))""",
)
def union_markers(spark, d):
    """Findings of commits, content and security in one table, with advice."""
    from ..operators import history
    from .queries import _metric_files

    f = snippet_files(spark, d)
    content = rules.content_markers(f).where(F.col("type").isin(*LEVELS))
    all_ = rules.union_markers(history.organisation_markers(_metric_files(spark, d), P.PARAMS), security.security_markers(security.security_symbols(f)), content)
    return all_.select("repo_id", "file", "type", "suggestion")


@query("org", f"SELECT DISTINCT type FROM (WITH {SNIPPETS_SQL} SELECT type FROM org UNION ALL SELECT type FROM snips WHERE type <> '')")
def biomarker_options(spark, d):
    from ..operators import history
    from .queries import _metric_files

    content = rules.content_markers(snippet_files(spark, d)).where(F.col("type").isin(*LEVELS))
    return increments.biomarker_options(history.organisation_markers(_metric_files(spark, d), P.PARAMS), content)


@query("", f"WITH {SNIPPETS_SQL}\nSELECT path, map_from_entries([('.go', 'go'), ('.ts', 'typescript'), ('.java', 'java'), ('.py', 'python'), ('.kt', 'kotlin'), ('.tf', 'terraform'), ('.dart', 'dart'), ('.sql', 'sql')])[ext] AS language, ext IN ('.go', '.ts', '.java', '.py', '.kt') AS structural FROM snips")
def file_languages(spark, d):
    """Language of each extension, and whether structural rules know it."""
    return snippet_files(spark, d).select("path", paths.language_of("ext").alias("language"), paths.supported_structural_ext("ext").alias("structural"))


#: Names of files and whether each is a test, infrastructure for the counter, infrastructure for the builder, an API contract.
KINDS = [
    ("pay_test.go", 1, 0, 0, 1), ("pay.go", 0, 0, 0, 1), ("PayTest.java", 1, 0, 0, 1), ("pay.spec.ts", 1, 0, 0, 1), ("pay.test.js", 1, 0, 0, 0), ("PaySpec.kt", 1, 0, 0, 0),
    ("test_pay.py", 1, 0, 0, 1), ("pay_spec.rb", 1, 0, 0, 0), ("Dockerfile", 0, 1, 1, 0), ("main.tf", 0, 1, 1, 0), ("main.hcl", 0, 0, 1, 0), ("Jenkinsfile", 0, 1, 1, 0),
    (".github/workflows/build.yml", 0, 1, 1, 0), ("ci/build.yaml", 0, 1, 0, 0), ("docker-compose.yml", 0, 0, 1, 0), ("notes.md", 0, 0, 0, 0),
]


@query("", "SELECT p_partkey AS id, " + ", ".join(f"[{', '.join(str(bool(x[i])).lower() for x in KINDS)}][1 + p_partkey % {len(KINDS)}] AS {n}" for i, n in ((1, "is_test"), (2, "counted"), (3, "infra"), (4, "api"))) + " FROM part")
def file_kinds(spark, d):
    """Tests, infrastructure, continuous integration and API contracts by name."""
    p = P.table(spark, d, "part")
    name = F.array(*[F.lit(x[0]) for x in KINDS])[F.pmod("p_partkey", F.lit(len(KINDS))).cast("int")]
    path = F.concat(F.lit("m"), F.pmod("p_partkey", F.lit(25)).cast("string"), F.lit("/"), name)
    return p.select(F.col("p_partkey").alias("id"), paths.is_test_filename(path).alias("is_test"), paths.is_infra_counted(path).alias("counted"), paths.is_infra_file(path).alias("infra"), paths.is_api_contract_file(path).alias("api"))
