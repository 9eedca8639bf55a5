"""Findings on file content: a registry of rules that are fused into one projection.

``content_markers`` evaluates every rule in one pass over the files and explodes what fired,
so the text of a file is read once however many rules there are. Users add rules with
``Rule(type, severity, message, predicate, exts)``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Params

# Word edges for ASCII letters, digits and the underscore (the engine's own also know other alphabets).
_L, _R = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

# Patterns.
AADHAAR = _L + r"\d{12}" + _R
PAN = _L + r"[A-Z]{5}[0-9]{4}[A-Z]{1}" + _R
# "." and "-" are no word characters, so the edge in front may lie on either side
UPI = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64}" + _R
INDIAN_MOBILE = r"(?:(?:\+91|0091|91)[-.\s]?)?[6-9]\d{9}" + _R
E164 = r"\+[1-9]\d{7,14}" + _R
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PLACEHOLDER_DOMAINS = [
    "example.com", "example.org", "example.net", "test.com", "test.org",
    "foo.com", "bar.com", "placeholder.com", "noreply.com", "localhost",
]
REGIONS = r"us-east-1|us-west-2|eu-central-1"
SETSTATE_AFTER_AWAIT = r"(?s)await\s+.{1,200}setState\s*\("
CONTEXT_AFTER_AWAIT = r"(?s)await\s+.{1,200}(?:Navigator|ScaffoldMessenger|Theme|MediaQuery)\s*\.of\s*\(\s*context\s*\)"
DART_CRYPTO = r"(?i)MD5|SHA1[^2-9]|DES(?:ede)?[^A-Z]"
SQL_CONCAT = r"""(?i)(SELECT|INSERT|UPDATE|DELETE)\s+.{0,100}(\+\s*['"]|['"]\s*\+|CONCAT\s*\()"""
SQL_STAR = r"(?i)SELECT\s+\*\s+FROM"
SQL_CREDENTIAL = r"""(?i)(PASSWORD|IDENTIFIED BY)\s+['"][^'"]{3,}['"]"""
MUTATIONS = ["setState", "updateUser", "db.Save", "db.Update", "mutation"]

# Advice for each type of finding.
SUGGESTIONS = {
    "brain_method": "Break this method into smaller focused functions. Extract complex conditional blocks, apply Command or Strategy pattern to replace branching, and isolate side-effects.",
    "nested_complexity": "Flatten nesting by extracting inner blocks into helper functions, using early returns/guard clauses, and applying decomposition.",
    "complex_method": "Simplify by extracting helper methods, replacing switch/if chains with a lookup table or polymorphism, and removing redundant conditions.",
    "bumpy_road": "Restructure to reduce alternating nesting levels. Consider a state machine or pipeline pattern.",
    "large_method": "Split into smaller methods at logical boundaries. Each method should do one thing. Consider extracting a class/struct.",
    "primitive_obsession": "Introduce value objects or parameter structs instead of long param lists. Group related parameters into a dedicated type.",
    "dry_violation": "Extract the duplicated logic into a shared utility function or module. Verify both clones evolve together — if diverging intentionally, document why.",
    "untested_hotspot": "Add unit and integration tests for this frequently-changed, high-dependency file. Prioritize edge cases and error paths.",
    "coverage_gap": "Increase test coverage by writing tests for uncovered branches. Focus on business-critical paths first.",
    "developer_congestion": "Assign a clear owner or break the file into smaller owned modules. Consider architectural decomposition to reduce multi-team coupling.",
    "knowledge_loss": "Document key design decisions and ownership. Run a knowledge-transfer session; consider pairing or a code review rotation.",
    "dpdp_pii_exposure": "Remove or mask PII from source code. Store identifiers in secure config; use references, not literals. Review DPDP Act obligations.",
    "dpdp_mobile_exposure": "Remove mobile number literals from source. Use environment variables or a secrets manager. Applies to DPDP-regulated data.",
    "pii_email_exposure": "Remove email literals from source. Use configuration or a contact service instead of hardcoded addresses.",
    "broken_crypto": "Replace deprecated hash/cipher with modern alternatives (SHA-256 or better, AES-GCM). Audit all crypto call sites.",
    "tainted_sql": "Use parameterised queries or an ORM. Never concatenate user input into SQL strings.",
    "ssrf_blind": "Validate and allowlist external URLs before making HTTP calls. Use a proxy with an egress policy.",
    "token_bloat": "Reduce file verbosity: split large files, remove commented-out code, consolidate repetitive patterns. Large token density degrades AI context quality.",
    "dead_code": "Remove unreachable or unused code paths. Dead code increases maintenance burden and can mislead future readers.",
    "zombie_export": "Remove unused exported symbols or make them unexported. Dead exports confuse tooling and bloat public API surface.",
    "pii_mobile_exposure": "Remove mobile number literals from source. Store them in secure config or a secrets manager to comply with data-protection requirements.",
    "dart_setstate_after_await": "Avoid calling setState after an async gap without checking mounted. Guard with 'if (!mounted) return;' before setState to prevent use-after-dispose errors.",
    "dart_context_after_await": "Do not use BuildContext across async gaps. Capture context-dependent values before the await, or use a mounted check and a Navigator/ScaffoldMessenger ref.",
    "dart_broken_crypto": "Replace deprecated or weak Dart/Flutter crypto with modern alternatives. Use package:cryptography with AES-GCM or ChaCha20-Poly1305.",
    "sql_injection_risk": "Use parameterized queries or a query builder. Never interpolate user input directly into SQL strings.",
    "sql_select_star": "Replace SELECT * with explicit column lists. Overly broad queries fetch unnecessary data and break when schema changes.",
    "sql_hardcoded_credential": "Remove hardcoded database credentials from source. Use environment variables or a secrets manager and rotate the leaked credential immediately.",
    "phantom_coupling": "Investigate why these files co-change without a structural dependency. Extract a shared abstraction or document the coupling explicitly.",
    "hallucination_bait": "Rename ambiguous or misleading symbols to clearly describe their purpose. Ambiguous names degrade AI-assisted tooling accuracy.",
    "untracked_consent_mutation": "Document data mutation with explicit consent tracking. Add audit logging to state/database mutations involving user data.",
    "rbi_logger_audit_gap": "Add CorrelationID logging to payment and transaction handlers. RBI compliance requires full audit trails for financial operations.",
    "data_sovereignty_leak": "PII is referenced alongside a non-Indian cloud region. Ensure sensitive data is processed and stored within India per DPDP Act requirements.",
}

PII_NAMES = ("AADHAAR", "PAN", "UPI_ID", "MOBILE", "EMAIL")


def pii_switches(names: Iterable[str] | None = None) -> set[str]:
    """The enabled kinds: trimmed, upper case, UPI is UPI_ID; all five when none are given."""
    wanted = {n.strip().upper() for n in (names or PII_NAMES)} - {""}
    return {"UPI_ID" if n == "UPI" else n for n in wanted}


@dataclass(frozen=True)
class Rule:
    """One finding a file: ``predicate`` and a message that is a function of the content get the content column."""

    type: str
    severity: str
    message: str | Callable[[Column], Column]
    predicate: Callable[[Column], Column]
    exts: tuple[str, ...] = ()


def real_emails(content: Column) -> Column:
    """The email matches that don't end in a placeholder domain."""
    found = F.regexp_extract_all(content, F.lit(EMAIL), F.lit(0))
    ends = "(?i)@(" + "|".join(d.replace(".", "\\.") for d in PLACEHOLDER_DOMAINS) + ")$"
    return F.filter(found, lambda e: ~e.rlike(ends))


def token_estimate(content: Column) -> Column:
    """Four bytes a token: the rule of thumb when no vocabulary is at hand."""
    return F.floor(F.octet_length(content) / 4)


def bpe_tokens(path: str) -> Callable[[Column], Column]:
    """Exact counts for ``standard_rules(tokens=...)``: the tokens of a vocabulary file (.json) on every worker."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(e.ids) for e in _vocabulary(path).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    return count


@functools.cache
def _vocabulary(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pii_rules(names: Iterable[str] | None = None) -> list[Rule]:
    on = pii_switches(names)
    foreign = lambda c: F.exists(F.regexp_extract_all(c, F.lit(E164), F.lit(0)), lambda x: ~x.startswith("+91"))
    rules = {
        "AADHAAR": [Rule("dpdp_pii_exposure", "high", "Potential Aadhaar number exposure detected", lambda c: c.rlike(AADHAAR))],
        "PAN": [Rule("dpdp_pii_exposure", "high", "Potential PAN number exposure detected", lambda c: c.rlike(PAN))],
        "UPI_ID": [Rule("dpdp_pii_exposure", "medium", "Potential UPI ID exposure detected", lambda c: c.contains("@") & c.rlike(UPI))],
        "MOBILE": [
            Rule("dpdp_mobile_exposure", "high", "Potential Indian mobile number exposure detected", lambda c: c.rlike(INDIAN_MOBILE)),
            Rule("pii_mobile_exposure", "medium", "Potential international mobile number (E.164) exposure detected", foreign),
        ],
        "EMAIL": [
            Rule(
                "pii_email_exposure",
                "medium",
                lambda c: F.format_string("Potential email address exposure detected (%d occurrence(s))", F.size(real_emails(c))),
                lambda c: c.contains("@") & (F.size(real_emails(c)) > 0),
            )
        ],
    }
    return [r for name in PII_NAMES if name in on for r in rules[name]]


def standard_rules(p: Params = Params(), pii: Iterable[str] | None = None, tokens: Callable[[Column], Column] = token_estimate) -> list[Rule]:
    """All content rules. ``tokens`` counts tokens of a content column (the estimate unless given)."""
    on = pii_switches(pii)
    personal = [pattern for name, pattern in (("AADHAAR", AADHAAR), ("PAN", PAN)) if name in on]

    def any_of(c: Column, patterns: list[str]) -> Column:
        out = F.lit(False)
        for x in patterns:
            out = out | c.rlike(x)
        return out

    def density(c: Column) -> Column:
        return tokens(c) / (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1)

    def contains(c: Column, words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | c.contains(w)
        return out

    return [
        *pii_rules(pii),
        Rule("untracked_consent_mutation", "medium", "State mutation detected without explicit consent check heuristic", lambda c: contains(c, MUTATIONS) & ~F.lower(c).contains("consent")),
        Rule("rbi_logger_audit_gap", "high", "Financial handler missing correlation ID in logs", lambda c: contains(c, ["Payment", "Transaction"]) & ~contains(c, ["CorrelationID", "RequestID"])),
        Rule("data_sovereignty_leak", "critical", "PII data potentially routed to non-Indian regions", lambda c: c.rlike(REGIONS) & any_of(c, personal)),
        Rule("token_bloat", "low", lambda c: F.format_string("High token density detected: %.2f tokens/line", density(c)), lambda c: density(c) > p.token_bloat),
        Rule("dart_setstate_after_await", "high", "setState() called after await — may operate on disposed widget", lambda c: c.rlike(SETSTATE_AFTER_AWAIT), (".dart",)),
        Rule("dart_context_after_await", "medium", "BuildContext used after async gap — context may be invalid", lambda c: c.rlike(CONTEXT_AFTER_AWAIT), (".dart",)),
        Rule("dart_broken_crypto", "high", "Weak cryptographic algorithm detected (MD5/SHA1/DES)", lambda c: c.rlike(DART_CRYPTO), (".dart",)),
        Rule("sql_injection_risk", "high", "SQL query built with string concatenation — injection risk", lambda c: c.rlike(SQL_CONCAT), (".sql",)),
        Rule("sql_select_star", "low", "SELECT * reduces AI context efficiency and risks data over-exposure", lambda c: c.rlike(SQL_STAR), (".sql",)),
        Rule("sql_hardcoded_credential", "critical", "Hardcoded credential in SQL file", lambda c: c.rlike(SQL_CREDENTIAL), (".sql",)),
    ]


def marker(type_: str, severity: str, message: Column | str, line: Column | None = None, deduction: Column | float = 0.0, category: str = "") -> Column:
    """A finding as a struct; joined with ``repo_id`` and ``file`` it is a row of ``markers``."""
    as_col = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(
        F.lit(type_).alias("type"),
        F.lit(severity).alias("severity"),
        as_col(message, "string").alias("message"),
        (F.lit(0) if line is None else line).cast("int").alias("line"),
        as_col(deduction, "double").alias("deduction"),
        F.lit(category).alias("category"),
    )


def fired(rows: DataFrame, file: str, candidates: list[Column]) -> DataFrame:
    """Explode the candidates (structs or null) of each row into ``markers`` rows without suggestions."""
    hits = rows.select("repo_id", F.col(file).alias("file"), F.explode(F.array_compact(F.array(*candidates))).alias("m"))
    return hits.select("repo_id", "file", "m.*")


def content_markers(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of all content rules, one pass over ``files``."""
    c = F.col("content")
    found = []
    for r in standard_rules() if rules is None else rules:
        hit = r.predicate(c)
        if r.exts:
            hit = F.col("ext").isin(*r.exts) & hit
        found.append(F.when(hit, marker(r.type, r.severity, r.message(c) if callable(r.message) else r.message)))
    return fired(files.where("coalesce(is_file, true) and content is not null"), "path", found)


def attach_suggestion(markers: DataFrame) -> DataFrame:
    """The advice for each type, '' for unknown types. A literal map, so no join."""
    pairs = [F.lit(x) for kv in SUGGESTIONS.items() for x in kv]
    return markers.withColumn("suggestion", F.coalesce(F.create_map(*pairs)[F.col("type")], F.lit("")))


def union_markers(*frames: DataFrame) -> DataFrame:
    """All findings of all rules, with suggestions."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return attach_suggestion(out)
