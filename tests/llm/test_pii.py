import random
import re
import time

import pytest

from codequarry.llm import pii


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(1)
    bits = ["4316522678525456", "10.0.0.1", "a@b.co", "+1 (521) 555-2373", "300.1.1.1"]
    for _ in range(6000):
        t = "".join(rnd.choice("0123456789..  --+@@ab(é😀%") if rnd.random() < 0.8 else rnd.choice(bits) for _ in range(rnd.randint(0, 40)))
        found = pii.find_spans(t)
        assert {k: found[k] for k in pii.BASE} == brute(t), t


def test_method_spans():
    t = 'iban: DE89370400440532013000 token = "a1b2c3d4e5f6a7b8c9" http://joe:pw@host.org/x SSN 123-45-6789 accountant'
    found = {k: [t[s:e] for s, e in v] for k, v in pii.find_spans(t).items()}
    assert found["account"] == ["DE89370400440532013000", "a1b2c3d4e5f6a7b8c9", "123-45-6789"]
    assert found["address"] == ["http://joe:pw@host.org"]
    assert pii.find_spans("see http://example.org/a and https://b.c")["address"] == []


def test_redact():
    assert pii.redact("x a@b.co y") == "x [EMAIL] y"
    assert pii.redact("clean") == "clean"


def test_operator_and_odd_rows(spark, odd_docs, no_docs):
    got = pii.detect(odd_docs).collect()
    assert len(got) == odd_docs.count()
    empty = next(r for r in got if r.doc_id == 2)
    assert empty.base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" and empty.spans == ""
    missing = [r for r in got if r.doc_id is None]
    assert sorted(r.n_phone for r in missing) == [0, 1]
    assert pii.detect(no_docs).count() == 0
    staged = pii.pii_stage(spark, odd_docs, "")
    assert staged.columns == odd_docs.columns
    assert "[PHONE]" in next(r.text for r in staged.collect() if r.doc_id is None and r.text)


@pytest.mark.parametrize("piece", ["token=", "1", "1.", "a@", "password ", "+1", "1 ", "iban ", "http://", "mailto:", "1.1.1."])
def test_hostile_texts_take_linear_time(piece):
    begin = time.time()
    pii.find_spans(piece * (1_000_000 // len(piece)))
    assert time.time() - begin < 8


def test_values_behind_failed_ones():
    spans = pii.find_spans("token=token=token=abcdefgh12345678 password=abcdefghijklmnopqrst password=abcdefghijklmnop1")
    assert [s for s in spans["account"]] == [(6, 34), (74, 91)]
