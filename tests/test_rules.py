"""Findings on content: positive, negative and wrong-extension cases."""

import pytest

from codequarry.operators import rules, security

FILES = "repo_id string, path string, is_file boolean, ext string, content string"


def types(spark, content, ext=".go", **kw):
    df = spark.createDataFrame([("r", f"a{ext}", True, ext, content)], FILES)
    return sorted(r.type for r in rules.content_markers(df, rules.standard_rules(**kw)).collect())


@pytest.mark.parametrize(
    ("content", "ext", "expected"),
    [
        ("id 123456789012 end", ".go", ["dpdp_pii_exposure"]),
        ("id 1234567890123", ".go", []),
        ("id 1239876543210", ".go", ["dpdp_mobile_exposure"]),
        ("pan ABCDE1234F", ".go", ["dpdp_pii_exposure"]),
        ("pan ABCDE1234FX", ".go", []),
        ("pay me@okbank now", ".go", ["dpdp_pii_exposure"]),
        ("call +91-9876543210", ".go", ["dpdp_mobile_exposure"]),
        ("call +14155552671", ".go", ["pii_mobile_exposure"]),
        ("mail jo@corp.io", ".go", ["dpdp_pii_exposure", "pii_email_exposure"]),
        ("mail jo@EXAMPLE.com", ".go", ["dpdp_pii_exposure"]),
        ("db.Save(x)", ".go", ["untracked_consent_mutation"]),
        ("db.Save(x) // Consent given", ".go", []),
        ("handle Payment", ".go", ["rbi_logger_audit_gap"]),
        ("handle Payment RequestID", ".go", []),
        ("us-east-1 123456789012", ".go", ["data_sovereignty_leak", "dpdp_pii_exposure"]),
        ("await f(); setState(() {})", ".dart", ["dart_setstate_after_await", "untracked_consent_mutation"]),
        ("await f(); Navigator.of(context)", ".dart", ["dart_context_after_await"]),
        ("md5.convert(x)", ".dart", ["dart_broken_crypto"]),
        ("md5.convert(x)", ".go", []),
        ("SELECT a FROM t WHERE x = '' + y", ".sql", ["sql_injection_risk"]),
        ("select * from t", ".sql", ["sql_select_star"]),
        ("select * from t", ".go", []),
        ("IDENTIFIED BY 'secret'", ".sql", ["sql_hardcoded_credential"]),
        ("x " * 200, ".go", ["token_bloat"]),
        ("x\n" * 200, ".go", []),
    ],
)
def test_content_rules(spark, content, ext, expected):
    assert types(spark, content, ext) == sorted(expected)


def test_switches(spark):
    assert rules.pii_switches([" upi ", "email", ""]) == {"UPI_ID", "EMAIL"}
    assert rules.pii_switches() == set(rules.PII_NAMES)
    assert types(spark, "pan ABCDE1234F 123456789012", pii=["PAN"]) == ["dpdp_pii_exposure"]


def test_email_message_counts_and_suggestion(spark):
    df = spark.createDataFrame([("r", "a.go", True, ".go", "a@x.io b@y.io c@test.com")], FILES)
    got = {r.type: r for r in rules.attach_suggestion(rules.content_markers(df, rules.pii_rules(["EMAIL"]))).collect()}
    assert got["pii_email_exposure"].message == "Potential email address exposure detected (2 occurrence(s))"
    assert got["pii_email_exposure"].suggestion.startswith("Remove email literals")
    assert (got["pii_email_exposure"].deduction, got["pii_email_exposure"].category) == (0.0, "")


def test_null_and_empty_content(spark):
    df = spark.createDataFrame([("r", "a.go", True, ".go", None), ("r", "b.go", True, ".go", "")], FILES)
    assert rules.content_markers(df).count() == 0


def test_user_rule(spark):
    df = spark.createDataFrame([("r", "a.py", True, ".py", "TODO")], FILES)
    own = rules.Rule("todo", "low", "left over", lambda c: c.contains("TODO"), (".py",))
    assert [r.type for r in rules.content_markers(df, [own]).collect()] == ["todo"]


@pytest.mark.parametrize(
    ("ext", "content", "expected"),
    [
        (".go", "x\ngo func() { y() }()\n", {("unsecured_goroutine", 2), ("goroutine_outer_mutation", 2)}),
        (".go", 'h := crypto.NewMD5()\nrow := db.Query("a" + b)\n', {("broken_crypto", 1), ("tainted_sql", 2)}),
        (".py", "async def f():\n    await g.h(1)\n    hashlib.md5(x)\n", {("logical_race", 2), ("broken_crypto", 3)}),
        (".js", "fetch(url)\nfunction deleteAll(x) {}\n", {("ssrf_blind", 1), ("bypassed_rbac", 2)}),
        (".java", 'MessageDigest.getInstance("MD5");\nst.executeQuery("a" + b);', {("broken_crypto", 1), ("tainted_sql", 2)}),
        (".kt", 'val password = "x"\nGlobalScope.launch { }', {("kotlin_hardcoded_secret", 1), ("kotlin_goroutine_shared_state", 2)}),
        (".tf", 'resource "aws_s3_bucket" "b" {\n}\n', {("tf_unencrypted_s3", 1)}),
        (".tf", 'ingress {\n cidr_blocks = ["0.0.0.0/0"]\n}', {("tf_open_ingress", 1)}),
        (".txt", "go func() {}", set()),
    ],
)
def test_security_patterns(spark, ext, content, expected):
    df = spark.createDataFrame([("r", f"a{ext}", True, ext, content)], FILES)
    got = {(r.name, r.line) for r in security.security_symbols(df).collect()}
    assert got == expected


def test_repeated_hits_get_their_own_lines(spark):
    df = spark.createDataFrame([("r", "a.py", True, ".py", "x.md5(a)\n\nx.md5(a)\n")], FILES)
    s = security.security_symbols(df)
    assert sorted(r.line for r in s.collect()) == [1, 3]
    assert {r.type for r in security.security_markers(s).collect()} == {"broken_crypto"}


def test_exact_token_counts(spark):
    import os

    import pytest

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = ["", "a b c\nd", "x" * 900, "word " * 60, None]
    df = spark.createDataFrame([("r", f"f{i}", True, ".txt", x) for i, x in enumerate(texts)], "repo_id string, path string, is_file boolean, ext string, content string")
    found = rules.content_markers(df, rules.standard_rules(tokens=rules.bpe_tokens(path)))
    got = {r.file: r.message for r in found.where("type = 'token_bloat'").collect()}
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids) / (x.count("\n") + 1)
    assert got == {f"f{i}": f"High token density detected: {count(x):.2f} tokens/line" for i, x in enumerate(texts) if x and count(x) > 50}
    assert len(got) >= 1
