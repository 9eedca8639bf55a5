import random
import time

import numpy as np

from codequarry.llm import decontam


def plain(s):
    return " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())


def distance(p, r):
    """Least edits between p and any part of r."""
    row = [0] * (len(r) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(r, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edit(rnd, s, k):
    s = list(s)
    for _ in range(k):
        p = rnd.randrange(len(s))
        o = rnd.random()
        if o < 0.4:
            s[p] = rnd.choice("abcxyz")
        elif o < 0.7:
            s.insert(p, "q")
        else:
            del s[p]
    return "".join(s)


def codes(s):
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


def test_normalise():
    texts = ["", " a", "a ", "..a..b..", "é😀x", "  ", "ÄB\tc\n\nD"]
    c, at = decontam.normalise(texts)
    assert ["".join(map(chr, c[a : b - 1])).lstrip() for a, b in zip(at[:-1], at[1:])] == [plain(t) for t in texts]


def test_alignment_equals_full_table():
    rnd = random.Random(4)
    for _ in range(600):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randint(8, 30)))
        budget = rnd.randint(0, 4)
        r = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, budget + 1))) + edit(rnd, p, rnd.randint(0, 5)))[: len(p) + 2 * (budget + 1)]
        want, got = distance(p, r), decontam.align(codes(p), codes(r), budget)
        assert (got[2] if got else None) == (want if want <= budget else None)


def test_filter_loses_nothing_and_adds_nothing():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rnd.randint(3, 25)))) for k in range(12)]
    index = decontam.Passages(items)
    texts = []
    for i in range(120):
        base = [word() for _ in range(rnd.randint(0, 60))]
        if i % 2:
            k, t = items[i % 12]
            base.insert(rnd.randrange(len(base) + 1), edit(rnd, t, rnd.randint(0, len(t) // 10)))
        texts.append(" ".join(base))
    got = {(t, k) for t, k, *_ in index.matches(texts)}
    want = {(t, k) for t, text in enumerate(texts) for k, p, b in zip(index.item, index.code, index.budget) if distance("".join(map(chr, p)), plain(text)) <= b}
    assert got == want


def test_operator(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(0, "this is a plain text"), (1, None), (2, "short"), (3, "THIS, is a plain TEXT!"), (None, "word word word word word word")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(odd_docs, items).collect()}
    assert got == {(1, 0, 0), (1, 3, 0), (6, None, 0)}
    blocks = {(r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(odd_docs, items, most=10).collect()}
    assert blocks == got
    assert decontam.contaminated(no_docs, items).count() == 0 and decontam.contaminated(odd_docs, items.limit(0)).count() == 0


def test_part_of_a_long_item_is_found(spark):
    long = " ".join(f"token{i} bla{i * 7}" for i in range(60))
    index = decontam.Passages([(9, long)])
    assert {k for _, k, *_ in index.matches(["noise noise " + long[200:460] + " more"])} == {9}
    assert index.matches(["noise noise " + long[200:260] + " more"]) == []


def test_short_leaks_are_found_wherever_they_lie():
    rnd = random.Random(8)
    for size in (74, 155, 250):
        item = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
        index = decontam.Passages([(9, item)])
        for part in (66, 130):
            texts = ["0123 4567 " * 9 + item[a : a + part] + " 8901 2345" * 9 for a in range(0, size - part + 1, 5)]
            assert {t for t, *_ in index.matches(texts)} == set(range(len(texts)))
        for a in range(0, size - 75 + 1, 25):
            assert len(index.matches(["0123 4567 " * 9 + edit(rnd, item[a : a + 75], 6) + " 8901 2345" * 9])) == 1


def test_rows_before_change_nothing():
    item = "the quick brown fox jumps over one lazy dog by a river bank while seven wizards mix vexing potions for the judge who likes warm quilts and old jazz"
    index = decontam.Passages([(1, item)])
    for tail in range(8, 16):
        for before in range(40, 70):
            own = [m[1:] for m in index.matches(["z" * before + item[:tail], item]) if m[0] == 1]
            assert own == [(1, 0, len(item), 0)]


def test_stage_drops_only_what_leaks(spark, tmp_path):
    spark.createDataFrame([(0, "a benchmark question about the moon and the sea")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "x A benchmark question, about the moon and the sea y", "en", "s", 1), (2, "clean text about the moon", "en", "s", 1), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = decontam.decontamination_stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


ITEM = "the quick answer to the benchmark question is forty two and nothing else"


def test_repeated_text_is_searched_once_and_bounded():
    index = decontam.Passages([(0, "word " * 40), (1, ITEM), (2, "word " * 30 + "another end of it")])
    begin = time.time()
    got = index.matches(["word " * 400_000, "line of text\n" * 100_000 + ITEM + " line of text" * 50_000])
    assert time.time() - begin < 20
    assert {(t, i) for t, i, *_ in got} == {(0, 0), (0, 2), (1, 1)}


def test_windows_find_what_the_whole_text_holds(monkeypatch):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(rnd.choice([6, 14, 40, 90]))) for i in range(12)]
    texts = [" ".join([say(rnd.randint(0, 900)), items[rnd.randrange(12)][1], say(300), items[rnd.randrange(12)][1], say(rnd.randint(0, 200))]) for _ in range(12)]
    index = decontam.Passages(items)
    monkeypatch.setattr(decontam, "WINDOW", 10**9)
    whole = index.matches(texts)
    monkeypatch.setattr(decontam, "WINDOW", 700)
    monkeypatch.setattr(decontam, "ENTRIES", 50)
    assert {(t, i, e) for t, i, _, _, e in index.matches(texts)} == {(t, i, e) for t, i, _, _, e in whole}


def test_short_items_are_found_between_word_edges(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4)))
    items = [(i, t) for i, t in enumerate(["a", "AB", "a b", "abba", "b.a", "aabb", "ab ab a", "人工", "工", "", None, "..", "ab"])]
    docs = [(i, rnd.choice(["", "  ", "."]).join([" ".join(word() for _ in range(rnd.randint(0, 12)))] * 2)) for i in range(150)] + [(150, "关于人工智能"), (151, "a工b"), (152, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text in docs:
        for i, item in items:
            own, whole = plain(item or ""), plain(text or "")
            places = [k for k in range(len(whole)) if own and whole.startswith(own, k)]
            free = lambda c: c in "人工智能关于"
            for k in places:
                before, after = whole[k - 1 : k], whole[k + len(own) : k + len(own) + 1]
                if (before.strip() == "" or free(before) or free(own[0])) and (after.strip() == "" or free(after) or free(own[-1])):
                    want.add((d, i, k, k + len(own), 0))
                    break
    assert {tuple(r) for r in decontam.contaminated(df, bench).collect()} == want
    assert {tuple(r) for r in decontam.contaminated(df, bench, most=3).collect()} == want  # many blocks, each stored


def test_stage_with_several_blocks(spark, tmp_path, monkeypatch):
    items = [(i, f"the benchmark item number {i} asks a question about {i * 7} things in a row") for i in range(6)] + [(9, "ab")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(decontam, "BLOCK", 100)
    docs = [(i, f"before {items[i][1].upper()} after" if i < 6 else f"clean text ab {i}") for i in range(12)]
    out = decontam.decontamination_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [6, 7, 8, 9, 10, 11]


def test_passages_by_their_definition():
    rnd = random.Random(5)
    for _ in range(20):
        items = [(i, "x" * rnd.choice([8, 71, 72, 73, 160, 161, 300, 512, 513])) for i in range(rnd.randint(1, 5))]
        p = decontam.Passages(items)
        want = []
        for k, (_, t) in enumerate(items):
            n = len(t)
            want += [(0, k, 0, n)] if n <= 160 else [(0, k, i, 128) for i in (*range(0, n - 128, 64), n - 128)]
            want += [(1, k, i, 72) for i in (*range(0, n - 72, 4), n - 72)] if n > 72 else []
        level = [0 if i < p.level[1] else 1 for i in range(len(p.of))]
        assert list(zip(level, p.of.tolist(), p.begin.tolist(), p.size.tolist())) == sorted(want)
        assert p.least.tolist() == [min(int(b) for b, o in zip(p.bound, p.of) if o == k) for k in range(len(items))]
