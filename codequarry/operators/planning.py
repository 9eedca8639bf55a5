"""Documentation planning: counts, prices, plans, ranked pages, prompts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import col, dirname, is_api_contract_file, is_infra_counted, is_infra_file

# Page types with tier, level, and input and output tokens a page.
PAGE_TYPES = [
    ("file_page", "cheap", 1, 2000, 800),
    ("symbol_spotlight", "cheap", 0, 500, 200),
    ("module_page", "medium", 3, 4000, 1500),
    ("scc_page", "medium", 3, 6000, 2000),
    ("api_contract", "medium", 2, 3000, 1200),
    ("infra_page", "medium", 2, 2500, 1000),
    ("repo_overview", "premium", 5, 8000, 3000),
    ("architecture_diagram", "premium", 4, 10000, 4000),
    ("onboarding", "premium", 6, 6000, 2500),
]
SINGLETONS = ["repo_overview", "architecture_diagram", "onboarding"]
COST_GATE = 10.0
FRACTIONS = [0.10, 0.15, 0.20, 0.30, 0.40, 0.50]
RECOMMENDED = 0.20

# Model name prefix, dollars for a million input tokens and a million output tokens.
PRICES = [
    ("claude-3-5-haiku", 0.80, 4.00),
    ("claude-3-5-sonnet", 3.00, 15.00),
    ("claude-3-opus", 15.00, 75.00),
    ("claude-opus-4", 15.00, 75.00),
    ("claude-sonnet-4", 3.00, 15.00),
    ("claude-haiku-4", 0.80, 4.00),
    ("anthropic/claude-3-5-haiku", 0.80, 4.00),
    ("anthropic/claude-3-5-sonnet", 3.00, 15.00),
    ("anthropic/claude-3-opus", 15.00, 75.00),
    ("anthropic/claude-opus-4", 15.00, 75.00),
    ("anthropic/claude-sonnet-4", 3.00, 15.00),
    ("anthropic/claude-haiku-4", 0.80, 4.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4-turbo", 10.00, 30.00),
    ("gpt-4", 10.00, 30.00),
    ("openai/gpt-4o-mini", 0.15, 0.60),
    ("openai/gpt-4o", 2.50, 10.00),
    ("openai/gpt-4-turbo", 10.00, 30.00),
    ("openai/gpt-4", 10.00, 30.00),
    ("gemini-2.0-flash", 0.075, 0.30),
    ("gemini-1.5-pro", 1.25, 5.00),
    ("gemini-1.5-flash", 0.075, 0.30),
    ("gemini-ultra", 10.00, 30.00),
    ("google/gemini-2.0-flash", 0.075, 0.30),
    ("google/gemini-1.5-pro", 1.25, 5.00),
    ("google/gemini-1.5-flash", 0.075, 0.30),
    ("mistralai/mistral-7b-instruct", 0.06, 0.06),
    ("mistralai/mistral-small", 0.20, 0.60),
    ("mistralai/mistral-medium", 2.70, 8.10),
    ("mistralai/mistral-large", 8.00, 24.00),
    ("mistralai/mixtral-8x7b", 0.45, 0.70),
    ("meta-llama/llama-3-8b-instruct", 0.06, 0.06),
    ("meta-llama/llama-3-70b-instruct", 0.52, 0.75),
    ("meta-llama/llama-3.1-8b-instruct", 0.06, 0.06),
    ("meta-llama/llama-3.1-70b-instruct", 0.52, 0.75),
]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "prefix string, input double, output double")


def price_models(models: DataFrame, table: DataFrame, dynamic: DataFrame | None = None) -> DataFrame:
    """(model, input, output): discovered price, else exact name, else longest prefix, else 0.

    The price table is a short list (checked: at most 10 000 rows), so it is broadcast to a prefix join.
    """
    if table.limit(10_001).count() > 10_000:
        raise ValueError("the price table is meant to be a short list")
    names = models.select("model").distinct()
    best = names.join(F.broadcast(table), F.expr("startswith(model, prefix)"), "left")
    best = best.groupBy("model").agg(F.max_by(F.struct("input", "output"), F.length("prefix")).alias("p"))
    out = best.select("model", F.coalesce("p.input", F.lit(0.0)).alias("input"), F.coalesce("p.output", F.lit(0.0)).alias("output"))
    if dynamic is not None:
        d = dynamic.select("model", F.col("input").alias("di"), F.col("output").alias("do"))
        out = out.join(d, "model", "left").select("model", F.coalesce("di", "input").alias("input"), F.coalesce("do", "output").alias("output"))
    return out


def page_counts(files: DataFrame, symbols: DataFrame, communities: DataFrame) -> DataFrame:
    """(repo_id, page_type, pages): how many pages of each type a full run makes."""
    f = files.where("coalesce(is_file, true)")
    module = F.when(dirname("path") != ".", dirname("path"))
    per = f.groupBy("repo_id").agg(
        F.count("*").alias("file_page"), F.count_distinct(module).alias("module_page"), F.count_if(is_infra_counted("path")).alias("infra_page"), F.count_if(is_api_contract_file("path")).alias("api_contract")
    )
    per = per.join(symbols.groupBy("repo_id").agg(F.count("*").alias("symbol_spotlight")), "repo_id", "left")
    per = per.join(communities.groupBy("repo_id").agg(F.count_distinct("community_id").alias("scc_page")), "repo_id", "left").fillna(0)
    entries = [F.struct(F.lit(t).alias("page_type"), (F.lit(1) if t in SINGLETONS else F.col(t)).cast("bigint").alias("pages")) for t, *_ in PAGE_TYPES]
    return per.select("repo_id", F.explode(F.array(*entries)).alias("e")).select("repo_id", "e.*")


def scaled(page_type: Column, pages: Column, pct: Column) -> Column:
    """trunc(pages * pct), at least 1 where there is a page; the singletons as they are."""
    part = F.when(pages == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(pages * pct)))
    return F.when(page_type.isin(*SINGLETONS), pages).otherwise(part).cast("bigint")


def scale_counts(counts: DataFrame, pct: float) -> DataFrame:
    return counts.withColumn("pages", scaled(F.col("page_type"), F.col("pages"), F.lit(pct)))


def token_heuristics(files: DataFrame) -> DataFrame:
    """(repo_id, page_type, input, output): tokens a page, three types from the files' mean size."""
    f = files.where("coalesce(is_file, true)").groupBy("repo_id").agg(F.count_if(F.col("size") > 0).alias("n"), F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("size"))), F.lit(0)).alias("bytes"))
    avg = F.greatest(F.lit(200), F.expr("(bytes div greatest(n, 1)) div 4"))
    derived = {
        "file_page": (avg + 500, F.greatest(F.lit(200), F.floor(avg / 3))),
        "symbol_spotlight": (F.greatest(F.lit(300), F.floor(avg / 4)) + 300, F.greatest(F.lit(100), F.floor(avg / 12))),
        "module_page": (avg * 3 + 1000, F.greatest(F.lit(500), F.floor(avg / 2))),
    }
    entries = []
    for t, _, _, i, o in PAGE_TYPES:
        a, b = derived.get(t, (F.lit(i), F.lit(o)))
        known = F.col("n") > 0
        entries.append(F.struct(F.lit(t).alias("page_type"), F.when(known, a).otherwise(i).cast("bigint").alias("input"), F.when(known, b).otherwise(o).cast("bigint").alias("output")))
    return f.select("repo_id", F.explode(F.array(*entries)).alias("e")).select("repo_id", "e.*")


def tier_of(page_type: Column) -> Column:
    pairs = [F.lit(x) for t, tier, *_ in PAGE_TYPES for x in (t, tier)]
    return F.coalesce(F.create_map(*pairs)[page_type], F.lit("medium"))


def generation_plan(counts: DataFrame, heuristics: DataFrame, tiers: Mapping[str, str], priced: DataFrame) -> DataFrame:
    """(repo_id, page_type, tier, model, pages, est_cost); types without pages are left out."""
    model = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])[F.col("tier")]
    rows = counts.where("pages > 0").withColumn("tier", tier_of(F.col("page_type"))).withColumn("model", model)
    # one price for each of the tiers' models, so what is broadcast is bounded by the parameter
    own = priced.where(F.col("model").isin(*sorted(set(tiers.values())))).groupBy("model").agg(F.max("input").alias("pin"), F.max("output").alias("pout"))
    rows = rows.join(heuristics, ["repo_id", "page_type"]).join(F.broadcast(own), "model", "left").fillna({"pin": 0.0, "pout": 0.0})
    cost = F.col("input") * F.col("pages") * F.col("pin") / 1_000_000 + F.col("output") * F.col("pages") * F.col("pout") / 1_000_000
    return rows.select("repo_id", "page_type", "tier", "model", "pages", cost.alias("est_cost"))


def plan_totals(plan: DataFrame) -> DataFrame:
    """Totals, and whether the cost needs a confirmation."""
    out = plan.groupBy("repo_id").agg(F.sum("pages").alias("total_pages"), F.sum("est_cost").alias("total_cost"))
    return out.withColumn("needs_confirmation", F.col("total_cost") > COST_GATE)


def estimate_page_cost(page_type: Column, pages: Column, price_in: Column, price_out: Column) -> Column:
    i = F.create_map(*[F.lit(x) for t, _, _, a, _ in PAGE_TYPES for x in (t, a)])[page_type]
    o = F.create_map(*[F.lit(x) for t, _, _, _, b in PAGE_TYPES for x in (t, b)])[page_type]
    return F.coalesce(i * pages * price_in / 1_000_000 + o * pages * price_out / 1_000_000, F.lit(0.0))


def coverage_options(counts: DataFrame, heuristics: DataFrame, tiers: Mapping[str, str], priced: DataFrame) -> DataFrame:
    """(repo_id, pct, recommended, total_pages, min_cost, max_cost) for six fractions, one pass over the counts."""
    steps = counts.select("repo_id", "page_type", F.explode(F.array(*map(F.lit, FRACTIONS))).alias("pct"), "pages")
    steps = steps.withColumn("pages", scaled(F.col("page_type"), F.col("pages"), F.col("pct")))
    ids = steps.select(F.struct("repo_id", "pct").alias("repo_id"), "page_type", "pages")
    wide = heuristics.select("repo_id", "page_type", "input", "output", F.explode(F.array(*map(F.lit, FRACTIONS))).alias("pct"))
    plan = generation_plan(ids, wide.select(F.struct("repo_id", "pct").alias("repo_id"), "page_type", "input", "output"), tiers, priced)
    out = plan.groupBy("repo_id").agg(F.sum("pages").alias("total_pages"), F.sum("est_cost").alias("cost"))
    return out.select("repo_id.repo_id", "repo_id.pct", (F.col("repo_id.pct") == RECOMMENDED).alias("recommended"), "total_pages", (F.col("cost") * 0.8).alias("min_cost"), (F.col("cost") * 1.2).alias("max_cost"))


# Words in a model's name by tier, the first tier that matches wins.
TIER_WORDS = [
    ("premium", "opus|ultra|large|gpt-4-turbo|gpt-4-0|gpt-4-1|gpt-4-3|gpt-4-5"),
    ("medium", "gpt-4o|sonnet|pro|medium|70b|mixtral"),
    ("cheap", "mini|haiku|flash|7b|8b|instruct|small|lite|nano"),
]


def classify_tier(model: str | Column) -> Column:
    return F.coalesce(*[F.when(F.lower(col(model)).rlike(words), F.lit(tier)) for tier, words in TIER_WORDS])


def bucket_models_by_tier(models: DataFrame) -> DataFrame:
    rows = models.select("model", classify_tier("model").alias("tier")).where("tier is not null")
    return rows.groupBy("tier").agg(F.sort_array(F.collect_list("model")).alias("models"))


def regeneration_estimate(files: Column, price_in: Column, price_out: Column, incremental: bool = True, tokens_in: int = 2000, tokens_out: int = 800) -> Column:
    """Cost of a tenth of the files' pages (at least one) for an incremental run, else of all; rates for 1 000 tokens."""
    pages = F.greatest(F.lit(1), F.ceil(files * 0.1)) if incremental else files
    return pages * (tokens_in * price_in + tokens_out * price_out) / 1000


def importance_rank(files: DataFrame) -> DataFrame:
    """Files with importance = 0.7 PageRank + 0.3 churn / largest churn (negative churn counts as 0)."""
    most = files.groupBy("repo_id").agg(F.max("churn").alias("most"))
    part = F.when(F.col("most") > 0, F.greatest(F.col("churn"), F.lit(0)) / F.col("most")).otherwise(0.0)
    return files.join(most, "repo_id").withColumn("importance", F.col("pagerank") * 0.7 + part * 0.3).drop("most")


def _top(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of each repository (0: all). Windowed group limits keep n rows a task before the shuffle."""
    if not n:
        return rows
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))).where(F.col("k") <= n).drop("k")


def _pages(rows: DataFrame, page_type: str, subject: Column) -> DataFrame:
    level = {t: lv for t, _, lv, _, _ in PAGE_TYPES}[page_type]
    return rows.select("repo_id", F.concat(F.lit(f"{page_type}:"), subject).alias("page_id"), F.lit(page_type).alias("page_type"), subject.alias("subject"), F.lit(level).alias("level"))


def plan_file_pages(files: DataFrame, page_type: str = "file_page", n: int = 0) -> DataFrame:
    """The most important files that fit the type."""
    rows = importance_rank(files)
    if page_type == "infra_page":
        rows = rows.where(is_infra_file("path"))
    elif page_type == "api_contract":
        rows = rows.where(is_api_contract_file("path"))
    return _pages(_top(rows, [F.desc("importance"), "path"], n), page_type, F.col("path"))


def plan_symbol_pages(nodes: DataFrame, n: int = 0) -> DataFrame:
    """Symbols by the PageRank of their file, path, name."""
    rank = nodes.where("node_type = 'file'").select("repo_id", "path", F.col("pagerank").alias("file_rank"))
    rows = nodes.where("node_type = 'symbol'").join(rank, ["repo_id", "path"], "left").fillna({"file_rank": 0.0})
    return _pages(_top(rows, [F.desc("file_rank"), "path", "name"], n), "symbol_spotlight", F.concat_ws(":", "path", "name"))


def plan_module_pages(files: DataFrame, n: int = 0) -> DataFrame:
    rows = files.select("repo_id", dirname("path").alias("key")).where("key <> '.'").distinct()
    return _pages(_top(rows, ["key"], n), "module_page", F.col("key"))


def plan_community_pages(labels: DataFrame, n: int = 0) -> DataFrame:
    rows = labels.select("repo_id", F.concat(F.lit("community_"), F.col("community_id").cast("string")).alias("key")).distinct()
    return _pages(_top(rows, ["key"], n), "scc_page", F.col("key"))


def plan_singletons(repositories: DataFrame) -> DataFrame:
    rows = repositories.select("repo_id").distinct()
    out = [_pages(rows, t, F.lit("root")) for t in SINGLETONS]
    return out[0].unionByName(out[1]).unionByName(out[2])


def remaining_pages(pages: DataFrame, completed: DataFrame) -> DataFrame:
    """Planned pages without those that are done (page_id), in order of level."""
    return pages.join(completed.select("page_id").distinct(), "page_id", "left_anti").orderBy("level", "page_id")


# Prompt texts. {s} is the subject.
PROMPTS = {
    "file_page": ("Write concise markdown documentation for this source file.\n\nFile: {s}\n\n", "\nDocument: purpose, key functions/types, usage notes, and any flagged issues."),
    "symbol_spotlight": ("Write a short markdown explanation of the symbol `{s}`.\n", "Include: what it does, parameters/return values if applicable, and usage examples."),
    "module_page": ("Write markdown documentation for the module/package at path: {s}\n\n", "Summarize: the module's purpose, key files, main exported symbols, and dependencies."),
    "scc_page": ("Write markdown documentation for code community: {s}\n\n", "Describe the group of related files, their shared responsibility, and key interactions."),
    "api_contract": ("Document the API contract for: {s}\n\n", "List: exported functions/types, their signatures, and expected behavior."),
    "infra_page": ("Document this infrastructure file: {s}\n\n", "Explain: the resource being configured, key settings, and operational notes."),
    "architecture_diagram": ("Write a markdown architecture overview for this codebase.\n\n", "Describe the high-level architecture, major subsystems, data flow, and key dependencies."),
    "repo_overview": ("Write a comprehensive markdown overview for this repository.\n\n", "Cover: purpose, tech stack, directory structure, setup instructions, and contribution notes."),
    "onboarding": ("Write a developer onboarding guide for this repository.\n\n", "Include: getting started, development environment setup, key concepts to understand, important files, and common workflows."),
}
SNIPPET_LINES = {"file_page": 200, "api_contract": 100, "infra_page": 150}


def snippet(content: Column, most: int) -> Column:
    """The first ``most`` lines and how many more there are (a last line break starts no line)."""
    lines = F.split(F.regexp_replace(content, "\n$", ""), "\n")
    more = F.size(lines) - most
    return F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.when(more > 0, F.format_string("\n... (%d more lines)", more)).otherwise(F.lit("")))


def assemble_prompts(pages: DataFrame, files: DataFrame, markers: DataFrame, labels: DataFrame) -> DataFrame:
    """``pages`` with a prompt each: template, the beginning of the file, its findings, repository counts."""
    text = files.select("repo_id", F.col("path").alias("subject"), "content")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "type", "severity", "message"))), lambda m: F.format_string("- %s (%s): %s\n", m["type"], m["severity"], m["message"])), "")
    per_file = markers.groupBy("repo_id", F.col("file").alias("subject")).agg(listed.alias("listed"))
    per_repo = markers.groupBy("repo_id").agg(F.count("*").alias("findings"))
    groups = labels.groupBy("repo_id").agg(F.count_distinct("community_id").alias("groups"))
    rows = pages.join(text, ["repo_id", "subject"], "left").join(per_file, ["repo_id", "subject"], "left").join(per_repo, "repo_id", "left").join(groups, "repo_id", "left")
    shown = F.when(F.col("page_type") == "symbol_spotlight", F.regexp_replace("subject", "^[^:]*:", "")).otherwise(F.col("subject"))
    texts = []
    for t, (head, tail) in PROMPTS.items():
        a, _, b = head.partition("{s}")
        parts = [F.lit(a), shown, F.lit(b)] if "{s}" in head else [F.lit(head)]
        if t in SNIPPET_LINES:
            s = snippet(F.col("content"), SNIPPET_LINES[t])
            parts.append(F.when(F.coalesce(F.length("content"), F.lit(0)) > 0, F.concat(F.lit("```\n"), s, F.lit("\n```\n\n"))).otherwise(F.lit("")))
        if t == "file_page":
            parts.append(F.when(F.col("listed").isNotNull(), F.concat(F.lit("Health markers:\n"), "listed")).otherwise(F.lit("")))
        if t == "architecture_diagram":
            parts.append(F.coalesce(F.format_string("The codebase has %d detected communities. ", "groups"), F.lit("")))
        if t == "repo_overview":
            parts.append(F.when(F.col("findings") > 0, F.format_string("The analysis found %d health markers. ", "findings")).otherwise(F.lit("")))
        texts.append(F.when(F.col("page_type") == t, F.concat(*parts, F.lit(tail))))
    return rows.select("repo_id", "page_id", "page_type", "subject", "level", F.coalesce(*texts).alias("prompt"))


def _bulleted(rows: DataFrame, title: str, limit: int) -> DataFrame:
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("repo_id", "file").orderBy(F.desc("deduction"), "type", "line"))).where(F.col("k") <= limit)
    item = F.format_string("%d. [%s] %s (line %d): %s", F.col("k"), F.col("severity"), F.col("type"), F.col("line"), F.col("message"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("t")))), lambda x: x["t"]), "\n")
    return ranked.groupBy("repo_id", "file").agg(F.concat(F.lit(f"{title} "), F.first("file"), F.lit("\n\n"), body).alias("prompt"))


def refactor_prompt(markers: DataFrame, limit: int = 10) -> DataFrame:
    """Per file: the findings with the largest deductions as a numbered text block."""
    return _bulleted(markers.where("deduction > 0"), "Refactor", limit)


def coverage_prompt(ranges: DataFrame) -> DataFrame:
    """Per file: its uncovered line ranges as a text block (from ``uncovered_ranges``)."""
    more = F.when(F.col("more") > 0, F.format_string(" (+%d more)", "more")).otherwise(F.lit(""))
    return ranges.select("repo_id", F.col("path").alias("file"), F.concat(F.lit("Add tests for "), "path", F.lit("\n\nUncovered lines: "), "ranges", more).alias("prompt"))


def list_wiki_pages(pages: DataFrame) -> DataFrame:
    return pages.orderBy("level", "type", "subject")


def list_wiki_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "id")
