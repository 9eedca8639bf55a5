"""Vector codes by Lloyd's rounds over resident members.

A vector is cut into equal parts; each part position has a codebook. A part row lives with its owner, the partition of
(position, entry, salt), where the salt splits an entry that holds many parts. In every round owners sum their resident
members, one row an owner; the codebook, which is small and bounded, is made from these sums; owners compare their
members with it, those that keep their entry stay in place without a shuffle, and only the others migrate to
their new owners in the next shuffle. Members are stored tables in shared storage, so a lost executor costs
one read; a round's table is removed once the next one is written.

The last assignment codes whole vectors in one pass, with the same comparison.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import remove, shared_dir
from .common import cut, ship
from .vectors import integers, matrix, numbered, whole

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Parts of one entry that share a salt, at most in expectation.
MEMBERS = 1 << 22
#: Integers beyond this count as this, so that sums of squared differences stay within a long for parts of up to 128 components.
LARGEST = 1 << 27
#: Rows that are compared with a codebook at a time.
SLICE = 4_096
MEMBER = "rid long, position int, entry int, part array<long>"


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row; ties go to the lower entry."""
    entries, errors = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for a in range(0, len(parts), SLICE):
        d = parts[a : a + SLICE, None, :] - codebook[None]
        d = (d * d).sum(axis=2)
        entries.append(d.argmin(axis=1))
        errors.append(d.min(axis=1))
    return np.concatenate(entries), np.concatenate(errors)


class Residents:
    """The stored part rows: a folder for each round, with the parts that stay and those that have arrived."""

    rounds = 0

    def __init__(self, members: DataFrame, salts: int):
        self.spark, self.salts = members.sparkSession, salts
        self.folder = shared_dir(self.spark, "lloyd")
        self._settle(members, self.folder)

    def _settle(self, members: DataFrame, folder: str) -> None:
        """The way of parts to their owners: the only shuffle of part rows in a round."""
        salt = F.pmod(F.xxhash64("rid"), F.lit(self.salts))
        members.repartition("position", "entry", salt).write.parquet(f"{folder}/arrived")

    def _compared(self, folder: str, moved: bool) -> DataFrame:
        rows = self.spark.read.schema(f"{MEMBER}, moved boolean").parquet(f"{folder}/compared")
        return rows.where(F.col("moved") == moved).drop("moved")

    def read(self) -> DataFrame:
        arrived = self.spark.read.schema(MEMBER).parquet(f"{self.folder}/arrived")
        return arrived.unionByName(self._compared(self.folder, False)) if self.rounds else arrived

    def sums(self, width: int) -> list:
        """(position, entry, component, count, sum): owners sum their residents, then the salts of an entry are combined.

        At most entries x dimensions rows, so they come to the driver.
        """

        def run(batches):
            held: dict[int, list] = {}
            for b in batches:
                key = b.column("position").to_numpy().astype(np.int64) * ENTRIES + b.column("entry").to_numpy()
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                if not len(starts):
                    continue
                totals, counts = np.add.reduceat(matrix(b.column("part"), width)[order], starts, axis=0), np.diff(np.append(starts, len(key)))
                for k, n, s in zip(key[order][starts].tolist(), counts.tolist(), totals):
                    old = held.setdefault(k, [0, np.zeros(width, dtype=np.int64)])
                    old[0], old[1] = old[0] + n, old[1] + s
            rows = [(k // ENTRIES, k % ENTRIES, n, s.tolist()) for k, (n, s) in held.items()]
            if rows:
                kinds = pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["position", "entry", "n", "sums"])

        own = self.read().mapInArrow(run, "position int, entry int, n long, sums array<long>")
        each = own.select("position", "entry", "n", F.posexplode("sums").alias("at", "s"))
        return each.groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()

    def assign(self, books: np.ndarray) -> None:
        """Compare every member with its codebook: who keeps the entry stays in place, the others go to new owners."""
        width = books.shape[2]

        def run(batches):
            for b in batches:
                position, old = b.column("position").to_numpy(), b.column("entry").to_numpy()
                part, entry = matrix(b.column("part"), width), np.zeros(b.num_rows, dtype=np.int32)
                for p in np.unique(position):
                    entry[position == p] = nearest(part[position == p], books[p])[0]
                yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("position"), pa.array(entry), b.column("part"), pa.array(entry != old)], names=["rid", "position", "entry", "part", "moved"])

        folder, old = shared_dir(self.spark, "lloyd"), self.folder
        self.read().mapInArrow(run, f"{MEMBER}, moved boolean").write.partitionBy("moved").parquet(f"{folder}/compared")
        self._settle(self._compared(folder, True), folder)
        self.folder, self.rounds = folder, self.rounds + 1
        remove(self.spark, old)


def train(rows: DataFrame, books: np.ndarray, salts: int, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` rounds over the parts of ``rows`` (rid, v)."""
    parts, _, width = books.shape

    def cut_up(batches):
        for b in batches:
            whole_rows, rids = matrix(b.column("v"), parts * width), b.column("rid").to_numpy()
            for p in range(parts):
                part = np.ascontiguousarray(whole_rows[:, p * width : (p + 1) * width])
                offsets = pa.array(np.arange(len(rids) + 1, dtype=np.int32) * width)
                columns = [pa.array(rids), pa.array(np.full(len(rids), p, dtype=np.int32)), pa.array(nearest(part, books[p])[0].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "position", "entry", "part"])

    members = Residents(rows.select("rid", "v").mapInArrow(cut_up, MEMBER), salts)
    for i in range(rounds):
        new = books.copy()
        for r in members.sums(width):
            new[r.position, r.entry, r.at] = r.s // r.n
        # the members of the last round are not needed once they are summed
        if i + 1 < rounds:
            members.assign(new)
        books = new
    remove(rows.sparkSession, members.folder)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row, in one pass."""
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            v = matrix(b.column("v"), parts * width)
            found = [nearest(v[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            codes = ["".join(f"{e:02x}" for e in row) for row in zip(*(e.tolist() for e, _ in found))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every vector that takes part; the codebooks as positions x entries x components).

    Null vectors and those with null or non-finite components take no part. The first entries are those of the smallest ids,
    ids without value last, equal ids by their vectors; fewer rows than entries make smaller codebooks. Vectors are filled
    with zeros to the longest one's length, rounded up to whole parts. Repeated rows are coded as often as they come.
    """
    spark = vectors.sparkSession
    ship(spark)
    clipped = F.transform(integers(vector_col, SCALE), lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x)))
    rows = vectors.where(whole(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), clipped.alias("v"))
    rows = cut(numbered(rows), "vectors")
    n, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = math.ceil((longest or 0) / PARTS)
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()
    start = np.array([[*r.v, *[0] * (PARTS * width - len(r.v))] for r in first], dtype=np.int64).reshape(len(first), PARTS, width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    if n:
        books = train(rows, books, math.ceil(n / MEMBERS), rounds)
    return encode(rows, books), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = cut(codes, "codes")
    # one row a label: sent to all tasks where Spark measures it as small, else joined by a shuffle that splits large labels
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = codes.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


_ROUND = """
a{i} AS MATERIALIZED (
  SELECT rid, position, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.rid, p.position, b.entry, list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts p JOIN b{i} b USING (position))
  GROUP BY rid, position),
"""
_UPDATE = """
m{i} AS (
  SELECT position, entry, c, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
  FROM (SELECT a.position, a.entry, unnest(part) AS x, unnest(range(len(part))) AS c FROM a{i} a JOIN parts USING (rid, position))
  GROUP BY position, entry, c),
b{j} AS MATERIALIZED (
  SELECT b.position, b.entry, coalesce(n.part, b.part) AS part
  FROM b{i} b LEFT JOIN (SELECT position, entry, list(x ORDER BY c) AS part FROM m{i} GROUP BY position, entry) n USING (position, entry)),
"""
OP13_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, position, v[position * len(v) // 8 + 1 : (position + 1) * len(v) // 8] AS part FROM v, range(8) AS r(position)),
b0 AS (SELECT position, rid - 1 AS entry, part FROM parts WHERE rid <= 16),
"""
    + "".join(_ROUND.format(i=i) + (_UPDATE.format(i=i, j=i + 1) if i < ROUNDS else "") for i in range(ROUNDS + 1))
    + f"""
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
o AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY position) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM o JOIN v USING (rid), h
"""
)
