"""Exact search and vector codes against plain sums over all pairs; odd rows and empty tables."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from codequarry.llm import lloyd, maxscore
from codequarry.llm.vectors import matrix

SCHEMA = "vec_id long, embedding array<float>, label int, rid long, v string, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "x", "y") for i, v, label in rows], SCHEMA)


def clusters(n, dims=16, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dims))
    return [(i, [float(x) for x in np.float32(centres[i % 5] + 0.3 * rnd.normal(size=dims))], i % 3 if i % 7 else None) for i in range(n)]


ODD = [
    (100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (200, None, 1), (201, [1.0, None], 1), (202, [math.nan, 1.0], 1), (203, [math.inf, 1.0], 1),
    (300, [], None), (None, [1.0, 2.0], None), (7, [3.0, -1.0, 0.5], 2), (8, [1.0, 2.0], 2), (9, [-1e-9, -0.0], 2),
]


def kept(rows, scale):
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def search(rows, k):
    """Every query against every other row: (query, rank, id, score) lists."""
    rows, out = kept(rows, 1024), []
    for q, (name, query, _) in enumerate(rows):
        if name is not None and name % 100 == 0:
            scored = [(-sum(a * b for a, b in zip(query, v)), i is None, i or 0, i) for r, (i, v, _) in enumerate(rows) if r != q]
            out += [(name, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(rows, k=10, **options):
    return sorted((tuple(r) for r in maxscore.top_k(rows, rows.where("vec_id % 100 = 0"), k, **options).collect()), key=repr)


def test_search_equals_all_pairs(spark):
    rows = clusters(901) + [(1000 + i, clusters(3)[1][1], 0) for i in range(40)]  # forty copies of one vector: ties by id
    df = maxscore.quantized(table(spark, rows))
    assert found(df) == search(rows, 10)
    assert found(df, 3, tile=100) == search(rows, 3)


def test_search_of_odd_rows(spark):
    assert found(maxscore.quantized(table(spark, ODD))) == search(ODD, 10)
    assert found(maxscore.quantized(table(spark, []))) == []
    assert found(maxscore.quantized(table(spark, [(100, [1.0], 1)]))) == []


def test_ranges_and_probes_lose_no_row():
    rnd = np.random.default_rng(3)
    for n, dims in ((1, 1), (5, 3), (5000, 24)):
        impacts = rnd.integers(-50, 50, size=(n, dims))
        impacts[: n // 2] *= 3
        ids = rnd.integers(0, 9, size=n)  # many equal ids and scores
        for query in rnd.integers(-20, 20, size=(20, dims)):
            best = maxscore.Best(7, ids, ids == 4)
            maxscore.Postings(impacts.astype(float)).search(query.astype(float), best, 0)
            scores = impacts @ query
            want = sorted((-scores[r], ids[r] == 4, ids[r]) for r in range(1, n))[:7]
            assert [(-s, ids[r] == 4, ids[r]) for s, r in zip(best.scores, best.rows)] == want


def test_scores_beyond_doubles_are_exact():
    big = pa.table({"vec_id": [1, 2], "rid": [1, 2], "v": [[2**40, 3], [2**40, 4]]})
    query = pa.table({"vec_id": [0], "rid": [0], "v": [[2**20, 1]]})
    assert maxscore.search_shard(big, query, 5).to_pylist() == [
        {"query_id": 0, "query_rid": 0, "vec_id": 2, "score": 2**60 + 4}, {"query_id": 0, "query_rid": 0, "vec_id": 1, "score": 2**60 + 3}
    ]


def test_matrix_fills_short_lists():
    assert matrix(pa.array([[1], [], [2, 3]]), 2).tolist() == [[1, 0], [0, 0], [2, 3]]
    assert matrix(pa.array([[9], [1, 2]])[1:], 2).tolist() == [[1, 2]]


def codes(rows, rounds=6):
    """Lloyd over whole lists: {row: (vec_id, code, error, label_error)} and the codebooks' digest."""
    rows = sorted(kept(rows, 4096), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in rows) // 8)
    full = np.array([v + [0] * (8 * width - len(v)) for _, v, _ in rows], dtype=object).reshape(len(rows), 8, width)
    books = [[list(full[e][p]) for e in range(min(16, len(rows)))] for p in range(8)]
    near = lambda p, part: min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(8):
            owners = [near(p, v[p])[1] for v in full]
            for e in set(owners):
                own = [v[p] for v, o in zip(full, owners) if o == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for (i, _, label), v in zip(rows, full):
        got = [near(p, v[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), label))
    by = {x: sum(r[2] for r in out if r[3] == x) for x in {r[3] for r in out}}
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted((((i, code, error, by[label], sha)) for i, code, error, label in out), key=repr)


@pytest.mark.parametrize("rows", [clusters(150), clusters(9, 24), ODD, clusters(40) * 3, [(i, [0.5, 0.25], 1) for i in range(60)] + clusters(20, 2)])
def test_codes_equal_plain_lloyd(spark, tmp_path, rows):
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = lloyd.op13_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == codes(rows)


def test_owners_are_salted(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "MEMBERS", 10)
    rows = clusters(120) + [(500 + i, [1.0] * 16, 1) for i in range(100)]
    out, books = lloyd.compress(table(spark, rows))
    assert sorted((r.vec_id, r.code, r.error) for r in out.collect()) == sorted(r[:3] for r in codes(rows))


def test_codes_of_an_empty_table(spark, tmp_path):
    table(spark, [(1, None, 1)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = lloyd.op13_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.collect() == []


def test_quantized_reads_whole_random_vectors(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-3, 3) for _ in range(rnd.randint(0, 5))], 1) for i in range(50)]
    got = {r.vec_id: r.v for r in maxscore.quantized(table(spark, rows)).collect()}
    assert got == {i: v for i, v, _ in kept(rows, 1024)}
