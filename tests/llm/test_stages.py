"""Every pipeline stage on odd rows, repeated rows, extra columns and empty tables."""

import pytest

from codequarry.llm import decontam, langid, minhash, packing, pii, token_counts, toxicity
from test_minhash import brute  # beside this file

ITEM = "the quick answer to the benchmark question is forty two and nothing else"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, length string"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(0, ITEM), (1, None), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def rows(*more):
    return [
        (1, "hello world this is a plain text", "en", "s", 10, "a", "b"),
        (1, "hello world this is a plain text", "en", "s", 10, "a", "b"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "", ""),
        (None, "an id is missing here, mail jo@corp.io", "en", "s", 1, "", ""),
        (None, None, None, None, None, None, None),
        (6, "word " * 30_000, "en", "s", 150_000, "", ""),
        (7, f"so {ITEM.upper()} it is", "de", "s", 15, "", ""),
        *more,
    ]


def ids(df):
    return sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())


def test_stages_on_odd_rows(spark, folder):
    df = spark.createDataFrame(rows(), SCHEMA)
    language = langid.language_stage(spark, df, folder)
    assert language.columns == df.columns and ids(language) == [-1, 1, 1, 6, 7]
    near = minhash.near_duplicates_stage(spark, df, folder)
    assert near.columns == df.columns and ids(near) == [-1, -1, 1, 2, 3, 6, 7]
    clean = decontam.decontamination_stage(spark, df, folder)
    assert clean.columns == df.columns and ids(clean) == [-1, -1, 1, 1, 2, 3, 6]
    private = pii.pii_stage(spark, df, folder)
    assert private.columns == df.columns and ids(private) == ids(df)
    assert [r.text for r in private.collect() if r.doc_id is None and r.text] == ["an id is missing here, mail [EMAIL]"]
    packed = packing.packing_stage(spark, df, folder)
    assert [i for i in ids(packed) if i != 6] == [-1, -1, 1, 1, 2, 3, 7]


def test_stages_on_empty_tables(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for stage in (langid.language_stage, minhash.near_duplicates_stage, decontam.decontamination_stage, pii.pii_stage):
        out = stage(spark, none, folder)
        assert out.columns == none.columns and out.count() == 0
    assert packing.packing_stage(spark, none, folder).count() == 0


def test_an_empty_benchmark_keeps_everything(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(rows(), SCHEMA)
    assert ids(decontam.decontamination_stage(spark, df, str(tmp_path))) == ids(df)


def test_rows_that_share_an_id_are_one_document(spark):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(40))
    data = [(5, long), (5, other), (5, other), (8, long), (9, other), (2, long + " end")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute([(5, long), (8, long), (9, other), (2, long + " end")])
    full = df.selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    assert sorted((r.doc_id, r.text) for r in minhash.near_duplicates_stage(spark, full, "").collect()) == [(2, long + " end"), (9, other)]


def test_bands_find_pairs_at_the_threshold():
    import numpy as np

    rng, missed = np.random.default_rng(3), 0
    for _ in range(300):
        size = int(rng.integers(40, 200))
        shared = -(-2 * size * 3 // 7)  # the fewest common shingles at a similarity of 0.75
        values = np.unique(rng.integers(0, 1 << 63, 2 * size - shared + 5, dtype=np.uint64))[: 2 * size - shared]
        rng.shuffle(values)
        keys = minhash._bands([np.sort(values[:size]), np.sort(np.concatenate([values[:shared], values[size:]]))])
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_many_hub_partners_in_chunks(spark, monkeypatch):
    """A hub with more partners than a chunk holds gives the same links."""
    monkeypatch.setattr(minhash, "CHUNK", 3)
    base = [f"w{i}" for i in range(80)]
    docs = [(0, " ".join(base))] + [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(1, 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == brute(docs)


def test_ties_in_packing(spark):
    df = spark.createDataFrame([(i, "word " * 900) for i in range(9)], "doc_id long, text string").repartition(5)
    got = packing.pack(df).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 9 and len({r.sequence_id for r in got}) == 3


def test_few_short_words():
    assert len(toxicity.Scorer(*toxicity.train(["a", "b"], [0, 1]))(["a", "", "b c"])) == 3
    assert toxicity.subwords(["b"])[1].tolist() == [2]


def test_special_strings_count_as_the_library_counts_them():
    path = token_counts.vocabulary_path(token_counts.VOCABULARY)
    t = token_counts._tokenizer(path)
    texts = [f"a {s.content}b" for s in t.get_added_tokens_decoder().values()]
    assert token_counts.count_tokens(texts, path, {}) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_language_stage_without_labels(spark, folder):
    df = spark.createDataFrame([(1, "some words", None, "s", 1, "", ""), (2, "12 34", None, "s", 1, "", "")], SCHEMA)
    assert [(r.doc_id, r.lang) for r in langid.language_stage(spark, df, folder).collect()] == [(1, None)]
