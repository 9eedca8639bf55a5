"""Exact top-k search by inner product with MaxScore over shards of postings.

Every dimension is a term, and its postings are one impact a row, as embeddings are dense: a shard keeps them term by
term, in ranges of rows with the largest and the smallest impact of each term. A query's bound of a term in a range is
the larger of its products with these two. Terms are ordered by how much they can tell rows apart; those after the
point from which their bounds together stay below the k-th best score are not essential. The postings of essential
terms are traversed for all rows of the range, the others are probed only for rows that are still competitive, and a range whose
bounds together stay below is left out. Shards' results, k rows a query at most, are merged.

Shards and blocks of queries meet in a grid: of at most ``tile`` rows each, dealt by row numbers, so copies of a vector or an id
in a third of all rows fill no task, and nothing passes the driver but two counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship
from .vectors import integers, matrix, numbered, whole

K = 10
SCALE = 1024
#: Rows of a shard and queries of a block at most; small tables get smaller shards, so that all tasks have one.
TILE, LEAST_TILE = 65_536, 2_048
#: Rows of a range with bounds of its own; non-essential terms probed at a time.
RANGE, STEP = 2_048, 8
FOUND = pa.schema([("query_id", pa.int64()), ("query_rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Postings:
    """The impacts of a shard's rows by term, with each term's extremes in every range of rows."""

    def __init__(self, impacts: np.ndarray):
        self.terms = np.ascontiguousarray(impacts.T)
        self.rows = impacts.shape[0]
        self.starts = list(range(0, self.rows, RANGE))
        parts = [self.terms[:, a : a + RANGE] for a in self.starts]
        self.most = np.array([p.max(axis=1) for p in parts])
        self.least = np.array([p.min(axis=1) for p in parts])

    def search(self, query: np.ndarray, best: Best, own: int) -> None:
        """Offer every row but ``own`` that can be among the best."""
        bounds = np.maximum(query * self.most, query * self.least)
        spread = np.abs(query) * (self.most - self.least)
        for i in np.argsort(-bounds.sum(axis=1).astype(np.float64), kind="stable"):
            order = np.argsort(-spread[i].astype(np.float64), kind="stable")
            rest = np.append(np.cumsum(bounds[i][order][::-1])[::-1], 0)  # rest[t]: bound of all terms from the t-th on
            if rest[0] < best.least:
                continue
            below = np.flatnonzero(rest < best.least)
            t = int(below[0]) if len(below) else len(order)
            a = self.starts[i]
            scores = query[order[:t]] @ self.terms[order[:t], a : a + RANGE]
            rows = np.flatnonzero((scores + rest[t] >= best.least) & (np.arange(a, a + len(scores)) != own))
            scores = scores[rows]
            while t < len(order) and len(rows):
                probed = order[t : t + STEP]
                t = min(t + STEP, len(order))
                scores = scores + query[probed] @ self.terms[np.ix_(probed, a + rows)]
                competitive = scores + rest[t] >= best.least
                rows, scores = rows[competitive], scores[competitive]
            best.offer(scores, a + rows)


class Best:
    """The k best rows so far: higher scores, then smaller ids, ids without value last."""

    def __init__(self, k: int, ids: np.ndarray, missing: np.ndarray):
        self.k, self.ids, self.missing = k, ids, missing
        self.scores, self.rows, self.least = np.zeros(0), np.zeros(0, dtype=np.int64), -math.inf

    def offer(self, scores: np.ndarray, rows: np.ndarray) -> None:
        scores, rows = np.concatenate([self.scores, scores]), np.concatenate([self.rows, rows])
        if len(rows) > self.k:
            kth = np.sort(scores)[-self.k]
            scores, rows = scores[scores >= kth], rows[scores >= kth]
        order = np.lexsort((self.ids[rows], self.missing[rows], -scores))[: self.k]
        self.scores, self.rows = scores[order], rows[order]
        if len(order) == self.k:
            self.least = self.scores[-1]


def search_shard(shard: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best rows of the shard for each query: query_id, query_rid, vec_id, score."""
    if not (shard.num_rows and queries.num_rows):
        return FOUND.empty_table()
    dims = max(pc.max(pc.list_value_length(t["v"])).as_py() for t in (shard, queries))
    impacts, wanted = matrix(shard["v"], dims), matrix(queries["v"], dims)
    largest = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (impacts, wanted)]
    exact = np.float64 if largest[0] * largest[1] * max(1, dims) < 2**53 else object  # doubles hold such integers, else Python's
    postings, wanted = Postings(impacts.astype(exact)), wanted.astype(exact)
    ids, rids = shard["vec_id"].combine_chunks(), shard["rid"].to_numpy()
    missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    place = {r: i for i, r in enumerate(rids.tolist())}
    out = []
    for q, name, rid in zip(wanted, queries["vec_id"].to_pylist(), queries["rid"].to_pylist()):
        best = Best(k, ids, missing)
        postings.search(q, best, place.get(rid, -1))
        out += [(name, rid, None if missing[r] else int(ids[r]), max(-(2**63), min(2**63 - 1, int(s)))) for r, s in zip(best.rows, best.scores)]
    if not out:
        return FOUND.empty_table()
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows but its own.

    ``rows`` and ``queries`` have vec_id, rid (the row's number) and v (integers); a query that is one of the rows has its rid.
    Ties go to the smaller vec_id, rows without vec_id last. All, if there are fewer than ``k``. A missing
    component of a shorter vector counts as 0. Scores beyond a long are its ends. Repeated rows are rows of their own,
    as queries and as candidates.
    """
    ship(rows.sparkSession)
    n, m = rows.count(), queries.count()
    each = min(tile, max(LEAST_TILE, math.ceil(n / (2 * rows.sparkSession.sparkContext.defaultParallelism))))
    shards, blocks = max(1, math.ceil(n / each)), max(1, math.ceil(m / tile))
    dealt = lambda parts: F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select("vec_id", "rid", "v", dealt(shards).alias("shard"), every(blocks).alias("block"))
    right = queries.select("vec_id", "rid", "v", every(shards).alias("shard"), dealt(blocks).alias("block"))

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        return search_shard(shard, block, k)

    grid = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    found = grid.applyInArrow(run, "query_id long, query_rid long, vec_id long, score long")
    # the limit on ranks is pushed below the shuffle
    rank = F.row_number().over(Window.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v, rid of the vectors that take part, stored: null vectors and those with null or non-finite components don't."""
    rows = vectors.where(whole(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), integers(vector_col, scale).alias("v"))
    return cut(numbered(rows), "quantized")


def op11_top_k_search(spark, sf_dir: str) -> DataFrame:
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
