"""The pipeline against plain versions of its stages, each judged on its own input."""

import random
import zlib
from collections import Counter

import corpus_pipeline
from codequarry.llm import decontam, packing, pii
from test_minhash import brute  # beside this file


def test_every_stage_on_its_own_input(spark, tmp_path, near_copies):
    rnd = random.Random(3)
    item = "the quick answer to the benchmark question is forty two and nothing else"
    rows = [(i, t, "en", "s", len(t)) for i, t in near_copies]
    rows += [(900, f"{near_copies[0][1]} {item.upper()}", "en", "s", 1), (901, "12345 ...", "en", "s", 1), (902, None, None, None, None), (903, "mail jo@corp.io now please", "en", "s", 1), (904, "geh du alte hütte und komm nicht wieder", "de", "s", 1)]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    docs, names, seen = spark.read.parquet(f"{d}/documents.parquet"), ["language_id", "near_duplicates", "decontamination", "pii", "packing"], []
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        if i < 4:
            assert docs.columns == columns
            docs.write.parquet(f"{d}/{name}.parquet")
            docs = spark.read.parquet(f"{d}/{name}.parquet")
            seen.append({r.doc_id: r.text for r in docs.collect()})
    whole = {r[0]: r[1] for r in rows}
    language, near, clean, private = seen
    assert set(whole) - set(language) == {901, 902}
    assert set(near) == {c for _, c in brute(list(language.items())).values()}
    index = decontam.Passages([(0, item)])
    assert set(near) - set(clean) == {i for i, t in near.items() if index.matches([t])} == {900}
    assert private == {i: pii.redact(t) for i, t in clean.items()} and "[EMAIL]" in private[903]
    t = packing._tokenizer(packing.vocabulary_path(packing.VOCABULARY))
    got = Counter((r.doc_id, r.length, r.ids_crc32) for r in docs.collect())
    want = Counter()
    for i, text in private.items():
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        want[(i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))] += 1
    assert got == want


def test_run_on_the_small_tables(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and max(r.offset + r.length for r in got) <= 4096
