import math
import random
import zlib

import numpy as np

from codequarry.llm import langid, toxicity
from codequarry.llm.common import labelled_sample


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_learns_words_and_misspellings(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(1500)]
    bad = ["grumbleface", "nastyhead", "vilething"]
    docs, labels = [], []
    for i in range(1600):
        ws = [rnd.choice(words) for _ in range(rnd.randint(10, 200))]
        toxic = i % 5 == 0
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            ws.insert(rnd.randrange(len(ws)), rnd.choice(bad))
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all(got[i].held_out == held(i) for i, _ in docs)
    test = [(got[i].predicted, y) for i, y in labels if held(i)]
    assert sum(p == y for p, y in test) / len(test) > 0.97
    s = toxicity.Scorer(*model)
    long = [rnd.choice(words) for _ in range(3000)]
    assert s([" ".join(long)])[0] < 0.5
    assert s([" ".join([*long, "grumblefacee", "nastyheadd"])])[0] > s([" ".join(long)])[0]


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, none)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and {r.predicted for r in got} == {0} and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (5, 1), (7, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd_docs, toxicity.fit(odd_docs, nulls)).count() == odd_docs.count()


def test_forward_sums_all_segmentations():
    path = langid.vocabulary_path(langid.VOCABULARY)
    _, p = langid.train(["the cat sat on the mat", "der Hund und die Katze"], ["en", "de"], path)
    number = {q: i for i, q in enumerate(langid.pieces(path))}
    words = langid.split_words("thntblere Élèves schön 日本 x " + "a" * 70)
    got = langid.word_scores(path, words, p)
    for w in words:
        for g in range(2):
            a = [1.0] + [0.0] * len(w)
            for i in range(1, len(w) + 1):
                for k in range(1, i + 1):
                    q = w[i - k : i]
                    a[i] += a[i - k] * (p[number[q], g] if q in number else langid.UNKNOWN if k == 1 else 0.0)
            assert abs(got[w][g] - math.log(a[-1])) < 1e-9


def test_long_runs_equal_the_plain_recursion():
    path = langid.vocabulary_path(langid.VOCABULARY)
    _, p = langid.train(["the cat sat on the mat", "der Hund und die Donaudampfschifffahrtsgesellschaftskapitänsmütze"], ["en", "de"], path)
    number = {q: i for i, q in enumerate(langid.pieces(path))}
    t, rnd = langid.table(path), random.Random(6)
    for n in (2, 31, 32, 33, 500, 10_000):
        w = "▁" + "".join(rnd.choice("etaoinshrdlu日ßж") for _ in range(n - 1))
        got = langid.long_word(t, w, p)
        for g in range(2):
            a = [0.0]
            for i in range(1, len(w) + 1):
                terms = []
                for k in range(1, min(i, t.longest) + 1):
                    q = w[i - k : i]
                    x = p[number[q], g] if q in number else langid.UNKNOWN if k == 1 else 0.0
                    if x:
                        terms.append(a[i - k] + math.log(x))
                top = max(terms)
                a.append(top + math.log(sum(math.exp(x - top) for x in terms)))
            assert math.isclose(got[g], a[-1], rel_tol=1e-9)


def test_expectations_of_long_runs():
    """The scaled sums give the same expected counts as all segmentations written out."""
    path = langid.vocabulary_path(langid.VOCABULARY)
    _, p = langid.train(["the cat sat on the mat"], ["en"], path)
    number = {q: i for i, q in enumerate(langid.pieces(path))}
    w, want, total = "▁thecat", {}, 0.0

    def cuts(at):
        if at == len(w):
            yield []
        for k in range(1, len(w) - at + 1):
            q = w[at : at + k]
            if q in number or k == 1:
                yield from ([q, *rest] for rest in cuts(at + k))

    for way in cuts(0):
        x = math.prod(p[number[q], 0] if q in number else langid.UNKNOWN for q in way)
        total += x
        for q in way:
            want[q] = want.get(q, 0.0) + x
    expected = np.zeros((len(number), 1))
    langid._expect_long(langid.table(path), w, np.array([2.0]), p, expected)
    for q, x in want.items():
        if q in number:
            assert math.isclose(expected[number[q], 0], 2 * x / total, rel_tol=1e-9)


def test_texts_without_letters_are_undetermined():
    path = langid.vocabulary_path(langid.VOCABULARY)
    model = langid.train(["the cat", "der Hund"], ["en", "de"], path)
    got = langid.Predictor(*model, path)(["½", "²³ ①", "Ⅷ", "1234 _", "", "x½", "日本"])
    assert [x for x, _ in got[:5]] == ["und"] * 5 and "und" not in {x for x, _ in got[5:]}


def test_ties_go_to_the_first_language():
    path = langid.vocabulary_path(langid.VOCABULARY)
    model = langid.train(["same words here", "same words here"], ["b", "a"], path)
    assert langid.Predictor(*model, path)(["same words"])[0][0] == "a"


def test_samples_hold_whole_texts_of_every_label(spark):
    rows = [(i, "x" * (40_000 if i % 7 == 0 else 10), "rare" if i % 50 == 0 else "usual") for i in range(1_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    texts = {i: t for i, t, _ in rows}
    got = labelled_sample(df.select("doc_id", "label"), df.select("doc_id", "text"), 40, 10_000_000, even=True)
    assert len(got) == min(20, sum(i % 50 == 0 and not held(i) for i in texts)) + 20 and {x for _, _, x in got} == {"rare", "usual"}
    assert all(texts[i] == t and not held(i) for i, t, _ in got) and any(len(t) == 40_000 for _, t, _ in got)
    few = labelled_sample(df.select("doc_id", "label"), df.select("doc_id", "text"), 400, 100_000)
    assert sum(len(t) for _, t, _ in few) <= 100_000 and len(few) > 100
    assert few == labelled_sample(df.repartition(3).select("doc_id", "label"), df.select("doc_id", "text"), 400, 100_000)


def test_gradients_equal_differences():
    rnd, rng = random.Random(9), np.random.default_rng(9)
    docs = [[rnd.choice(["aa", "bbb", "cccc", "ddddd", "e"]) for _ in range(rnd.randint(1, 60))] for _ in range(20)]
    bags = toxicity.Bags(docs, np.arange(20) % 4 == 3)
    E, W, b = rng.normal(size=(len(bags.used), toxicity.SIZE)), rng.normal(size=(toxicity.SIZE, 2)), rng.normal(size=2)
    target = rng.integers(0, 2, len(bags.of_doc)).astype(float)

    def loss(E, W, b):
        _, z = bags.forward(E, W, b)
        cross = np.logaddexp(0, z) - target * z
        return cross[bags.learn].sum() + toxicity.RIDGE / 2 * (E**2).sum()

    _, gE, gW, gb = bags.gradients(E, W, *bags.forward(E, W, b), target)
    own = np.unique(bags.local[: bags.inside])  # buckets of words that are learned
    for at in zip(rng.choice(own, 6), rng.integers(0, toxicity.SIZE, 6)):
        step = np.zeros_like(E)
        step[at] = 1e-5
        assert math.isclose((loss(E + step, W, b) - loss(E - step, W, b)) / 2e-5, gE[at], rel_tol=1e-4, abs_tol=1e-6)
    for at in ((0, 0), (1, 1), (3, 0)):
        step = np.zeros_like(W)
        step[at] = 1e-5
        assert math.isclose((loss(E, W + step, b) - loss(E, W - step, b)) / 2e-5, gW[at], rel_tol=1e-4)
    for k in range(2):
        step = np.eye(2)[k] * 1e-5
        assert math.isclose((loss(E, W, b + step) - loss(E, W, b - step)) / 2e-5, gb[k], rel_tol=1e-4)


def test_scores_equal_a_plain_sum_over_ngrams():
    rnd = np.random.default_rng(1)
    share = rnd.normal(size=toxicity.BUCKETS).astype(np.float32)
    scorer = toxicity.Scorer(share, 0.25)

    def lean(word):
        ids, n = toxicity.subwords([word])
        assert len(ids) == n[0] == sum(max(0, len(word) + 2 - k + 1) for k in (3, 4, 5)) + 1
        return float(np.mean(share[ids].astype(np.float64)))

    for text in ("one two three", "a b", "word " * 60 + "other"):
        words = toxicity.words_of(text)
        z = max(sum(map(lean, s := set(words[i : i + toxicity.PASSAGE]))) / max(len(s), toxicity.LEAST) for i in range(0, len(words), toxicity.PASSAGE))
        assert math.isclose(scorer([text])[0], 1 / (1 + math.exp(-z - 0.25)), rel_tol=1e-9)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    got = langid.predict(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4, 7)} == {"und"}
    assert langid.predict(no_docs, langid.fit(no_docs)).count() == 0
    staged = langid.language_stage(spark, odd_docs, "")
    assert staged.columns == odd_docs.columns and sorted(r.doc_id or -1 for r in staged.collect()) == [-1, 1, 1, 5, 6]
