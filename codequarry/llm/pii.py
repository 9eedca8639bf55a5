"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and identifier
cues. At each anchor a deterministic local parser expands to the left and right as far as
its character classes reach and validates what it found, so the work away from anchors is
one automaton step per character and no pattern ever rescans the text.

Kinds, in the order of the result: ``email``, ``ip``, ``card``, ``phone`` (the base kinds)
and two that only this method adds: ``address`` (a scheme whose authority names a user, or a
mailto, tel or sip target) and ``account`` (a value behind an identifier cue: IBAN with valid
check digits, a nine-digit social number, or a quoted or assigned secret of 16 characters or
more that mixes letters and digits).

Defined cases: null or empty text has no spans (its digest is that of the empty string);
positions are code points, end exclusive; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, ship, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")

SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "tel:", "sip:")
CUES = ("iban", "account", "acct", "ssn", "passport", "token", "api_key", "apikey", "secret", "password")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN, _IP = re.compile(r"[0-9.]+"), re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never begins inside a number
_CARD_RUN, _CARD = re.compile(r"[0-9 -]+"), re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:-]+@(?:[A-Za-z0-9-]+\.)*[A-Za-z0-9-]+(?::[0-9]{1,5})?")
_TARGET = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|\+?[0-9][0-9().-]{5,}[0-9]")
_CUE_GAP = re.compile(r"(?:[ _-]?(?:number|no|nr|id|key))?[ \t]*[:=#]?[ \t]*[\"']?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_SECRET = re.compile(r"[A-Za-z0-9_/+=-]{16,}")


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in "0123456789":
        a.add_word(d, ("d", 1))
    for kind, words in (("s", SCHEMES), ("c", CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                a.add_word(form, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _account(text: str, at: int, failed: int):
    """The span of the account value behind a cue that ends at ``at``, or None; and where the last value that is no secret ends."""
    p = _CUE_GAP.match(text, at).end()
    if m := _IBAN.match(text, p):
        for e in range(m.end(), m.start() + 14, -1):  # the longest valid one
            if text[e - 1] != " " and iban_ok(text[p:e]):
                return (p, e), failed
    if m := _SSN.match(text, p):
        return (p, m.end()), failed
    # a part of a value without a letter or without a digit has none either
    if p > at and p >= failed and (m := _SECRET.match(text, p)):
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
            return (p, m.end()), failed
        failed = m.end()
    return None, failed


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """All spans of ``text`` by kind, in order and without overlaps inside a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_end = card_end = phone_end = address_end = account_end = failed = 0
    for last, (kind, size) in _automaton().iter(text):
        if kind == "d":
            if last >= ip_end:
                ip_end = _IP_RUN.match(text, last).end()
                if ip_end - last >= 7:
                    for m in _IP.finditer(text, last, ip_end):
                        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                            out["ip"].append(m.span())
            if last >= card_end:
                card_end = _CARD_RUN.match(text, last).end()
                if card_end - last >= 13:
                    for m in _CARD.finditer(text, last, card_end):
                        digits = m.group().replace(" ", "").replace("-", "")
                        if 13 <= len(digits) <= 19 and luhn(digits):
                            out["card"].append(m.span())
        elif kind == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                out["email"].append((start, email_end))
        elif kind == "+":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif kind == "s":
            start = last - size + 1
            if start >= address_end:
                parser = _AUTHORITY if text[last] == "/" else _TARGET
                if m := parser.match(text, last + 1):
                    address_end = m.end()
                    out["address"].append((start, address_end))
        elif last >= account_end and (last == size - 1 or not text[last - size].isalnum()):
            found, failed = _account(text, last + 1, failed)
            if found:
                account_end = found[1]
                out["account"].append(found)
    return out


def _joined(spans: dict, kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    found = sorted((s, -e, k) for k, x in find_spans(text).items() for s, e in x)
    if not found:
        return text
    parts, at = [], 0
    for s, e, k in found:
        if s >= at:
            parts += [text[at:s], f"[{k.upper()}]"]
            at = -e
        elif -e > at:
            at = -e
    return "".join([*parts, text[at:]])


_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base_sha256, spans and how many spans of each kind (n_email, n_ip, n_card, n_phone, n_address, n_account) for each row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            ids, texts = b.column(0), b.column(1).to_pylist()
            found = [find_spans(t) for t in texts]
            cols = [[len(x[k]) for x in found] for k in KINDS]
            sha = [hashlib.sha256(_joined(x, BASE).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols), pa.array(sha, pa.string()), pa.array([_joined(x, KINDS) for x in found], pa.string())], names=_SCHEMA.names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of its text replaced; null texts stay null, other columns as they are."""
    ship(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches, text_col):
            texts = [None if t is None else redact(t) for t in b.column(at).to_pylist()]
            cols = [b.column(i) if i != at else pa.array(texts, b.schema.field(at).type) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced in the text, and n_chars follows the new text.

    Null texts stay null (with a null n_chars), empty ones empty; repeated rows and rows without an id are treated each for
    themselves; all other columns stay as they are; an empty table stays empty.
    """
    columns = docs.columns
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)
