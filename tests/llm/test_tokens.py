import random
import zlib
from collections import Counter

import numpy as np
import pytest

from codequarry.llm import packing, token_counts

ODD = ["", "  a\n\n b  <|endoftext|> x", "naïve 😀😀 　 x 日本語 12 345 ΑΣ ΑΣ. İx ÉCOLE éa", "\r\n\r\n x  ", "a\x1cb \x85 c\xa0d", "It's 's don't CAN'T 12a b3 é̀ ß ǅ ª²³ \x00 \x7f", "x\n\ny z", "a, b. (c) — d"]


def test_counts_equal_the_library(spark):
    path = token_counts.vocabulary_path(token_counts.VOCABULARY)
    t = token_counts._tokenizer(path)
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in ODD]
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.token_counts(df).collect()}
    assert [got[i].n_tokens for i in range(len(ODD))] == want
    assert [got[i].n_bytes for i in range(len(ODD))] == [len(x.encode()) for x in ODD]


def test_cache_restarts(monkeypatch):
    path = token_counts.vocabulary_path(token_counts.VOCABULARY)
    monkeypatch.setattr(token_counts, "CACHE", 2)
    assert token_counts.count_tokens(["a b c d e f g"], path, {}) == token_counts.count_tokens(["a b c d e f g"], path, {"a": 1})


def test_frequent_chunks_of_all_documents(spark, monkeypatch):
    """A chunk is frequent by all rows and whole texts, wherever it comes; the table has a bounded size."""
    path = token_counts.vocabulary_path(token_counts.VOCABULARY)
    t = token_counts._tokenizer(path)
    texts = ["the cat sat"] * 450 + ["a zebra ran to a zebra"] * 30 + ["b" * 25_000 + " tail" * 9, "the once", "", None, "c" * 70 + " " + "c" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    df = token_counts.id_and_text(df)
    want = Counter(c for x in texts if x for c in token_counts.chunks(x) if len(c) <= token_counts.KEY)
    got = token_counts.frequent_table(df, path)
    assert got == {c: len(t.encode(c, add_special_tokens=False).ids) for c, n in want.items() if n > 1}
    assert {" zebra", " tail"} <= set(got) and " once" not in got
    monkeypatch.setattr(token_counts, "FREQUENT", 4)
    every = sum(want.values())
    assert set(token_counts.frequent_table(df, path)) == {c for c, n in want.items() if n * 4 >= every} == {"the", " cat", " sat"}


def test_odd_rows(odd_docs, no_docs):
    got = token_counts.token_counts(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert next(r for r in got if r.doc_id == 6).over_limit
    assert token_counts.token_counts(no_docs).count() == 0


def check_packing(spark, df):
    path = packing.vocabulary_path(packing.VOCABULARY)
    t = packing._tokenizer(path)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    want = Counter()
    for doc, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[(doc, k, at, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)))] += 1
    got = packing.pack(df).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    return len(by), sum(r.length for r in got)


def test_packing_round_trip(spark, odd_docs, no_docs):
    check_packing(spark, odd_docs)
    check_packing(spark, spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "doc_id long, text string"))
    assert packing.pack(no_docs).count() == 0


def test_packing_is_tight(spark):
    rows = [(i, "word " * (50 + i * 37 % 3000)) for i in range(300)]
    sequences, tokens = check_packing(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sequences <= -(-tokens // 4096) * 1.06


#: Letters whose case, form or spacing differs between Python and the vocabularies, among plain ones.
MIXED = "abcdeXYZ  \n\t.,'0123ΑΣσςΟΔάİıiIßẞéÉe\u0301\u0300ǅﬁﬀ½²①Ⅷж日本ａ😀\u200d\xa0\x85\x1c\u2028_-"


def mixed_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(MIXED) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_random_texts_have_the_librarys_ids():
    t = packing._tokenizer(path := packing.vocabulary_path(packing.VOCABULARY))
    texts = mixed_texts(20_000, 1)
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert packing.token_bytes(text, path) == packing._packed(want.ids), text


def test_random_texts_have_the_librarys_counts():
    t = token_counts._tokenizer(path := token_counts.vocabulary_path(token_counts.VOCABULARY))
    texts = mixed_texts(20_000, 2)
    want = [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    got = token_counts.count_tokens(texts, path, {})
    assert [x for x, a, b in zip(texts, got, want) if a != b] == []


def test_long_chunks_are_not_kept():
    path = token_counts.vocabulary_path(token_counts.VOCABULARY)
    token_counts.count_tokens(["y" * 100_000 + " z"], path, {})
    assert max(map(len, token_counts._caches[path])) <= token_counts.KEY


def test_the_plan_is_small_whatever_the_input():
    histogram = {n: 1 + 10**12 // n**2 for n in range(1, 4097)}
    rows = packing.places(packing.plan_runs(dict(histogram)))
    assert sum(map(len, rows.values())) < 20 * 4096
    for n, x in rows.items():  # the ranks of a length are covered without gaps
        ends = np.append(x[1:, 0], histogram[n])
        assert ((ends - x[:, 0]) % x[:, 2] == 0).all() and x[0, 0] == 0


def test_capital_final_sigma(spark):
    t = packing._tokenizer(path := packing.vocabulary_path(packing.VOCABULARY))
    for text in ("ΟΔΟΣ", "ΟΔΟΣ ΚΑΙ ΑΣ.", "οδος ΣΑΣ", "Σ"):
        assert packing.token_bytes(text, path) == packing._packed(t.encode(text, add_special_tokens=False).ids)
    check_packing(spark, spark.createDataFrame([(1, "ΟΔΟΣ"), (2, "x ΛΟΓΟΣ y")], "doc_id long, text string"))


@pytest.mark.parametrize("histogram", [{}, {4096: 3, 1: 1}, {2048: 3}, {1366: 5}, {2000: 3, 1500: 2}, {1: 5000}, {n: 3 for n in range(1, 4097, 13)}])
def test_plan_places_every_length(histogram):
    used = Counter()
    for count, lengths in packing.plan(dict(histogram)):
        assert sum(lengths) <= 4096 and sum(3 * n > 4096 for n in lengths) <= 2
        for n in lengths:
            used[n] += count
    assert dict(used) == histogram
