"""Concurrency and security patterns over source code.

Each hit is one row of ``symbols`` (name = rule, type = 'biomarker') and, on request, one
marker. Rules see code only: comments are blanked, and literals too unless a rule asks what an argument holds. A bracket's
partner is known, so arguments and bodies are looked at as a whole, at their top level, however deep they nest.
A file is the unit, as in ``function_metrics``: nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masked import Source
from ..storage import bound_batches
from .rules import marker

_JS = (".js", ".mjs", ".cjs", ".ts", ".tsx")
_KT, _TF, _PY, _JAVA, _GO = (".kt", ".kts"), (".tf", ".hcl"), (".py",), (".java",), (".go",)
_NAME = r"[A-Za-z_$][\w$]*"


def _some_argument(pattern: str):
    """True if the code of an argument matches."""
    test = re.compile(pattern)
    return lambda source, opening: any(test.search(code) for code, _, _ in source.arguments(opening))


def _some_literal(pattern: str):
    """True if an argument is a literal whose text matches."""
    test = re.compile(pattern)
    return lambda source, opening: any(code.lstrip()[:1] in ("'", '"', "`") and test.search(source.text[a:b]) for code, a, b in source.arguments(opening))


def _statement(*patterns: str):
    """True if the block has statements that match the patterns, in this order."""
    tests = [re.compile(p) for p in patterns]

    def test(source: Source, opening: int) -> bool:
        rest = iter(source.statements(opening))
        return all(any(t.match(s) for s in rest) for t in tests)

    return test


_BODY = re.compile(r"[^{};()]*\{")


def _body(inner=None):
    """The block behind the parameters, if it passes ``inner``."""

    def test(source: Source, opening: int):
        m = opening in source.partner and _BODY.match(source.code, source.partner[opening] + 1)
        return m.end() - 1 if m and (inner is None or inner(source, m.end() - 1)) else False

    return test


def _attribute(name: str, inner: str):
    """True if the block has the attribute at its top level, and the text of its list matches."""
    head, test = re.compile(rf"\b{name}\s*=\s*\["), re.compile(inner)
    lists = lambda source, opening: (at + m.end() - 1 for at, piece in source.top(opening) for m in head.finditer(piece))
    return lambda source, opening: any(test.search(source.text[slice(*source.inside(x))]) for x in lists(source, opening))


_VARIABLE = rf"^\s*{_NAME}\s*$"
_ASSIGNED = rf"{_NAME}(?:\.{_NAME}|\[[^\]]*\])*\s*"

#: (rule, extensions, where it may begin, and what the bracket that ends the pattern has to hold: None for anything).
#: A test gives the bracket that ends the hit, if that is another one.
RULES = [
    ("unsecured_goroutine", _GO, r"\bgo\s+(?=func\b|[A-Za-z_(])", None),
    ("goroutine_outer_mutation", _GO, r"\bgo\s+func\s*\(\s*\)", None),
    ("async_race_condition", _JS, r"=>\s*\{", _statement(rf"{_ASSIGNED}=(?![=>])")),
    ("read_before_await", _JS, rf"\bfunction\s+{_NAME}\s*\(", _body(_statement(r"var\s", r"await\b"))),
    ("unsynchronized_mutation", _JAVA, r"(?<![\w.])(?!(?:new|return|throw|else)\b)[\w>\]]+\s+(?=\w*run)\w++\s*\(", _body(_statement(rf"{_ASSIGNED}[-+*/%&|^]?=(?!=)"))),
    ("logical_race", _PY, r"\bawait\s+[\w.]+\(", None),
    ("broken_crypto", _GO, r"\.(?:NewMD5|NewSHA1|NewDES)\s*\(", None),
    ("broken_crypto", _JS, r"\.(?=\w*createHash)\w++\s*\(", _some_literal("md5|sha1")),
    ("broken_crypto", _JAVA, r"\bgetInstance\s*\(", _some_literal("MD5|SHA-1|DES")),
    ("broken_crypto", _PY, r"\.(?:md5|sha1)\s*\(", None),
    ("tainted_sql", _GO, r"\.(?=\w*(?:Query|Exec))\w++\s*\(", _some_argument(r"\+")),
    ("tainted_sql", _JS, r"\.(?=\w*query)\w++\s*\(", _some_argument(r"\+")),
    ("tainted_sql", _JAVA, r"\b(?:executeQuery|executeUpdate)\s*\(", _some_argument(r"\+")),
    ("tainted_sql", _PY, r"\.(?=\w*execute)\w++\s*\(", _some_argument(r"[\w\"')\]]\s*[-+*/%@&|^]")),
    ("ssrf_blind", _GO, r"\.(?:Get|Post|Do)\s*\(", _some_argument(_VARIABLE)),
    ("ssrf_blind", _JS, r"(?<![\w.$])(?:fetch|axios)\s*\(", _some_argument(_VARIABLE)),
    ("ssrf_blind", _JAVA, r"\b(?:openStream|openConnection)\s*\(", None),
    ("ssrf_blind", _PY, r"\.(?:get|post)\s*\(", _some_argument(_VARIABLE)),
    ("bypassed_rbac", _GO, r"(?m)^func\s+(?:Transfer|Withdraw|Pay|Delete)\w*\s*\(", None),
    ("bypassed_rbac", _JS, r"\bfunction\s+(?:transfer|withdraw|pay|delete)\w*\s*\(", None),
    ("bypassed_rbac", _JAVA, r"(?<![\w.])(?!(?:new|return|throw|else)\b)[\w>\]]+\s+(?:transfer|withdraw|pay|delete)\w*\s*\(", _body()),
    ("bypassed_rbac", _PY, r"\bdef\s+(?:transfer|withdraw|pay|delete)\w*\s*\(", None),
    ("redis_unbounded_keys_scan", _GO, r"\.(?=\w*(?i:Do|Command|Keys))\w++\s*\(", _some_literal('(?i)^\\s*".*KEYS')),
    ("redis_empty_password_auth", _JS, r'[{,]\s*password\s*:\s*""', None),
    ("kotlin_broken_crypto", _KT, r"\b(?=\w*(?:MessageDigest|Cipher|SecretKeyFactory))\w++\.getInstance\s*\(", _some_literal("MD5|SHA1|DES|RC4")),
    ("kotlin_goroutine_shared_state", _KT, r"\b(?:GlobalScope|viewModelScope|lifecycleScope)\.(?=\w*(?:launch|async))\w++\s*[({]", None),
    ("kotlin_tainted_sql", _KT, r"\.(?=\w*(?:execSQL|rawQuery|query))\w++\s*\(", _some_argument(r"\S")),
    ("kotlin_hardcoded_secret", _KT, r"(?i)\bva[lr]\s+(?=\w*(?:password|secret|api_key|token|apikey))\w++\s*(?::\s*\w+\??)?\s*=\s*\"", None),
    ("tf_open_ingress", _TF, r"\bingress\s*\{", _attribute("cidr_blocks", r"0\.0\.0\.0/0")),
    ("tf_hardcoded_secret", _TF, r"(?mi)^[^\S\n]*+(?=\w*(?:password|secret|token|api_key))\w++\s*=\s*\"", None),
    ("tf_unencrypted_s3", _TF, r'\bresource\s+"[^"]*"\s+"[^"]*"\s*\{', None),
]
#: What the text of a hit must have beside its code: literals that stand in the pattern itself.
TEXTS = {"redis_empty_password_auth": r'""$', "tf_hardcoded_secret": r'"$', "tf_unencrypted_s3": r'^resource\s+"[^"]*aws_s3_bucket'}
_COMPILED = [(rule, own, re.compile(pattern), test, re.compile(TEXTS.get(rule, ""))) for rule, own, pattern, test in RULES]


def hits(content: str, ext: str) -> list[tuple[str, int, int]]:
    """(rule, line, end_line) of all hits; a hit ends where the bracket that ends its pattern is closed."""
    source, out = Source(content, ext), []
    for rule, own, pattern, test, text in _COMPILED:
        if ext not in own:
            continue
        for m in pattern.finditer(source.code):
            opening = m.end() - 1
            if not text.search(source.text[m.start() : m.end()]) or rule == "tf_hardcoded_secret" and source.text.startswith("var.", m.end()):
                continue
            found = test is None or test(source, opening)
            if found:
                opening = opening if found is True else found
                end = source.partner.get(opening, opening)
                out.append((rule, source.line(m.start() + len(m[0]) - len(m[0].lstrip())), source.line(end)))
    return out


def security_symbols(files: DataFrame) -> DataFrame:
    """One ``symbols`` row for each hit: line = where it begins, end_line = where it ends."""
    bound_batches(files.sparkSession)
    exts = sorted({e for _, own, *_ in RULES for e in own})
    rows = files.where(F.col("ext").isin(*exts) & F.col("content").isNotNull()).select("repo_id", "path", "ext", "content")

    def run(batches):
        for b in batches:
            repos, paths, kinds, texts = (c.to_pylist() for c in b.columns)
            found = [(r, name, "biomarker", line, end, p) for r, p, e, t in zip(repos, paths, kinds, texts) for name, line, end in hits(t, e)]
            if found:
                types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["repo_id", "name", "type", "line", "end_line", "file_path"])

    return rows.mapInArrow(run, "repo_id string, name string, type string, line int, end_line int, file_path string")


def security_markers(symbols: DataFrame) -> DataFrame:
    """Opt-in: a marker for each hit, without a deduction."""
    m = marker("", "high", F.concat(F.lit("Pattern '"), F.col("name"), F.lit("' matched")), F.col("line"), 0.0, "compliance_appsec")
    rows = symbols.where("type = 'biomarker'").select("repo_id", F.col("file_path").alias("file"), "name", m.alias("m"))
    return rows.select("repo_id", "file", F.col("name").alias("type"), "m.severity", "m.message", "m.line", "m.deduction", "m.category")


#: The rules that a security report shows.
SECURITY_TYPES = sorted({r for r, *_ in RULES if r not in ("unsecured_goroutine", "goroutine_outer_mutation", "async_race_condition", "read_before_await", "unsynchronized_mutation", "logical_race")} | {"sql_injection_risk", "sql_select_star", "sql_hardcoded_credential"})


def security_findings(markers: DataFrame) -> DataFrame:
    return markers.where(F.col("type").isin(*SECURITY_TYPES))
