"""Column expressions on paths: parts, kinds of files, languages, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language.
LANGUAGES = {
    ".go": "go",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".py": "python",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".dart": "dart",
    ".tf": "terraform",
    ".hcl": "terraform",
    ".sql": "sql",
}
STRUCTURAL = [".go", ".ts", ".tsx", ".js", ".jsx", ".java", ".kt", ".py"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def dirname(path: str | Column) -> Column:
    """The folder of a path; '.' for a path without one."""
    found = F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)
    return F.when(col(path).contains("/"), F.when(found == "", "/").otherwise(found)).otherwise(".")


def ext_of(path: str | Column) -> Column:
    """The extension with its dot, from the last dot of the last part; '' if there is none."""
    return F.regexp_extract(col(path), r"(\.[^./]*)$", 1)


def prefix(path: str | Column, depth: int) -> Column:
    return F.array_join(F.slice(F.split(col(path), "/"), 1, depth), "/")


def language_of(ext: str | Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.create_map(*pairs)[F.lower(col(ext))]


def supported_structural_ext(ext: str | Column) -> Column:
    return col(ext).isin(*STRUCTURAL)


#: Extensions -> what the name (without its extension) of a test file looks like.
TEST_NAMES = [
    ([".go", ".dart"], r"_test$"),
    ([".java"], r"(Test|Tests)$"),
    ([".rb"], r"(_spec|\.spec|_test)$"),
    ([".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx"], r"(\.test|\.spec)$"),
    ([".kt", ".kts"], r"(Test|Tests|Spec)$"),
    ([".tf", ".hcl"], r"(_test|\.tftest)$"),
]


def is_test_filename(path: str | Column) -> Column:
    base = basename(path)
    ext = ext_of(base)
    name = base.substr(F.lit(1), F.length(base) - F.length(ext))
    out = F.when(ext == "", F.lit(False))
    for exts, pattern in TEST_NAMES:
        out = out.when(F.lower(ext).isin(*exts), name.rlike(pattern))
    return out.otherwise(name.rlike(r"^test_|_test$"))


def is_ci_path(path: str | Column) -> Column:
    """A Jenkinsfile, or YAML below a folder named for continuous integration."""
    p = F.regexp_replace(col(path), r"(^\./)|(/\.(?=/))", "")
    parts = F.split(p, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.exists(dirs, lambda d: (d == ".github") | F.lower(d).isin("ci", ".circleci") | F.lower(d).endswith("-ci"))
    return (basename(p) == "Jenkinsfile") | (F.lower(ext_of(p)).isin(".yml", ".yaml") & named)


def is_infra_counted(path: str | Column) -> Column:
    """What the page counter takes for infrastructure."""
    return (basename(path) == "Dockerfile") | (ext_of(path) == ".tf") | is_ci_path(path)


def is_infra_file(path: str | Column) -> Column:
    """What the page builder takes for infrastructure."""
    names = ["Dockerfile", "Jenkinsfile", "docker-compose.yml", "docker-compose.yaml"]
    return basename(path).isin(*names) | ext_of(path).isin(".tf", ".hcl") | col(path).contains(".github/workflows")


def is_api_contract_file(path: str | Column) -> Column:
    return ext_of(path).isin(".go", ".ts", ".java", ".py")


def round_half_up(x: Column) -> Column:
    """Rounding that takes .5 upwards also below zero."""
    return F.floor(x + 0.5)


def _bands(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    return F.coalesce(*[F.when(x < limit, F.lit(name)) for limit, name in steps], F.when(x.isNotNull(), F.lit(last)))


def score_band(x: str | Column) -> Column:
    return _bands(col(x), [(4, "red"), (7, "amber")], "green")


def coverage_band(x: str | Column) -> Column:
    return _bands(col(x), [(30, "critical"), (60, "low"), (80, "fair")], "good")


def freshness_band(x: str | Column) -> Column:
    return _bands(col(x), [(0.6, "outdated"), (0.8, "stale")], "fresh")


def risk_band(x: str | Column) -> Column:
    return _bands(col(x), [(25, "low"), (45, "moderate"), (70, "high")], "critical")


def confidence_tier(x: str | Column) -> Column:
    return _bands(col(x), [(0.5, "low"), (0.8, "medium")], "high")


def severity_rank(x: str | Column) -> Column:
    s = F.lower(col(x))
    return F.when(s == "critical", 3).when(s == "high", 2).when(s == "medium", 1).when(s == "low", 0).otherwise(-1)
