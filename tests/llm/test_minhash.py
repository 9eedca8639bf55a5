import itertools
import random
import re

import numpy as np

from codequarry.llm import minhash


def brute(docs):
    """doc_id -> (n_shingles, component) by comparing all pairs of plain sets."""
    sets = {}
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def run(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}


def test_equals_brute_force(spark, near_copies):
    df = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(5)
    assert run(df) == brute(near_copies)


def test_links_that_no_star_confirms(spark, near_copies, monkeypatch):
    """When the stars confirm nothing, the comparison across components still links what is alike."""
    real, calls = minhash._confirm, []

    def confirm(pairs, texts):
        calls.append(pairs.count())
        out = real(pairs, texts)
        return out.limit(0) if len(calls) == 1 else out

    monkeypatch.setattr(minhash, "_confirm", confirm)
    stars, peeled = [], []
    cut = minhash.cut

    def kept(df, name):
        out = cut(df, name)
        if name == "pairs":
            stars.append(out)
        if name == "peel_measured":
            peeled.append(out)
        return out

    monkeypatch.setattr(minhash, "cut", kept)
    df = spark.createDataFrame(near_copies, "doc_id long, text string")
    minhash.near_duplicates(df).collect()
    tried = {(r.a, r.b) for r in stars[0].collect()}
    across = {(r.a, r.b) for r in stars[1].collect()} | {tuple(sorted((r.hub, r.other))) for df in peeled for r in df.collect()}
    sets = dict(zip([i for i, _ in near_copies], minhash.shingle_sets([t.encode() for _, t in near_copies])))
    seen = {}
    for i, s in sets.items():
        seen.setdefault(s.tobytes(), i)
    for a, b in itertools.combinations(sorted(seen.values()), 2):
        n = len(np.intersect1d(sets[a], sets[b]))
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            assert (a, b) in tried or (a, b) in across, (a, b)


def test_shingles():
    s = minhash.shingle_sets([b"", b" \n", b"a b", b"A  b", b"a b c d e", b"a b c d e f"])
    assert [len(x) for x in s] == [0, 0, 1, 1, 1, 2]
    assert np.array_equal(s[2], s[3]) and not np.array_equal(s[2], s[4])


def test_odd_rows(spark, odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[3].component_id == 3
    assert by[6].n_shingles == 1
    assert minhash.near_duplicates(no_docs).count() == 0


def test_stage_keeps_one_of_each_group(spark, near_copies):
    rows = [(i, t, "en", "s", len(t)) for i, t in near_copies]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = minhash.near_duplicates_stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(near_copies).values()})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[201] == 200


def groups(size, bases=2, cross=0, words=300, similar=0.7):
    """``size`` edited copies of each of several texts that are ``similar`` to each other, and ``cross`` texts between two of them."""
    rnd = random.Random(size)
    word = lambda: f"w{rnd.randrange(10**7)}"
    first = [word() for _ in range(words)]
    share = int(words * 2 * similar / (1 + similar))
    texts = [first] + [first[:share] + [word() for _ in range(words - share)] for _ in range(bases - 1)]
    docs = []
    for t in texts:
        for _ in range(size):
            own = list(t)
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(words)] = word()
            docs.append(own)
    for _ in range(cross):
        docs.append(first[:share] + texts[1][share : share + (words - share) // 2] + first[share + (words - share) // 2 :])
        docs[-1][rnd.randrange(words)] = word()
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_pairs_grow_with_the_groups(spark, monkeypatch):
    """Groups whose bases are close, but not linked: what is measured follows the number of documents, not its square."""
    real, counts = minhash._measure, []

    def measure(pairs, texts):
        counts.append(pairs.count())
        return real(pairs, texts)

    monkeypatch.setattr(minhash, "_measure", measure)
    monkeypatch.setattr(minhash, "SMALL", 16)
    for docs in (groups(50), groups(50, cross=2), groups(35, bases=3)):
        counts.clear()
        assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
        assert sum(counts) < 12 * len(docs), counts


def test_after_the_last_peel_pairs_are_joined(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PEELS", 1)
    monkeypatch.setattr(minhash, "SMALL", 16)
    docs = groups(34, bases=3)
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_small_tables_of_a_peel_need_no_shuffle(spark, monkeypatch):
    """A peel of few rows is one task a query, and links by rare shingles are no part of its plan: the driver holds little for each."""
    real, plans = minhash.cut, {}

    def cut(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return real(df, name)

    monkeypatch.setattr(minhash, "cut", cut)
    monkeypatch.setattr(minhash, "SMALL", 16)
    docs = groups(34, bases=3)
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
    assert set(plans["peel_rows"]) == {0} and "met" in plans
