"""Best-fit packing of token sequences by large-item matching.

The plan is made on the histogram of piece lengths, never on the pieces: there are at most
``CAPACITY`` different lengths, so the driver holds a bounded table however many documents
there are. Lengths above a third of the capacity ("large") are matched greedily, at most two
a sequence: the largest that is left takes the largest partner that still fits. The smaller
lengths, longest first, go to the sequences with the tightest gap that holds them; what fits
nowhere opens new sequences. Equal sequences are planned as one run with a multiplicity: no more than
``4 * CAPACITY`` runs of at most 90 different lengths each, whatever the input, so what goes to
the tasks is bounded too.

Pieces are then dealt to the planned places by their rank among the pieces of their length.
A rank is the piece's rank in its own partition plus the counts of the partitions before it,
so no length is ever gathered into one task.

Defined cases: a null or empty text is one piece of one token (the end id); only documents
longer than the capacity are cut; repeated rows are packed once each; an empty table gives
an empty result. The result has one row per piece.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, ship, slices
from .token_counts import _L, _tokenizer, byte_letters, vocabulary_path

CAPACITY, END_ID, CACHE = 4096, 1, 400_000
VOCABULARY = "word_bpe_49k.json"

_LATIN = re.compile(f"[ -~\\n{_L}]*").fullmatch
#: The vocabulary's public pattern for lower-case Latin text.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+").findall
#: Separators that str.split() takes for white space and the vocabulary does not, a letter whose lower case is two characters, and one whose lower case depends on its place in str.lower() alone.
_ODD = re.compile("[\x1c-\x1fİΣ]").search

_cache: dict[str, bytes] = {}


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _chunk(t, chunk: str) -> bytes:
    if not _LATIN(chunk):
        return _packed(t.encode(chunk, add_special_tokens=False).ids)
    out = []
    for piece in _PIECES(chunk):
        ids = _cache.get(piece)
        if ids is None:
            _cache[piece] = ids = _packed([x.id for x in t.model.tokenize(piece.translate(byte_letters()))])
        out.append(ids)
    return b"".join(out)


def token_bytes(text: str, path: str) -> bytes:
    """The ids of ``text`` as little-endian unsigned 32-bit numbers, without the end id."""
    t = _tokenizer(path)
    if _ODD(text) or any(s.content in text for s in t.get_added_tokens_decoder().values()):
        return _packed(t.encode(text, add_special_tokens=False).ids)
    low = text.lower().split()
    try:
        return b"".join(map(_cache.__getitem__, low))
    except KeyError:
        pass
    if len(_cache) > CACHE:
        _cache.clear()
    for c in low:
        if c not in _cache:
            _cache[c] = _chunk(t, c)
    return b"".join(map(_cache.__getitem__, low))


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (multiplicity, [(length, times in a row)]) that use every length as often as the histogram says."""
    left = {n: c for n, c in histogram.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    runs: list[list] = []  # [multiplicity, [(length, times)]]
    gaps: dict[int, list[list]] = defaultdict(list)
    sizes: list[int] = []  # the gaps in use, in order

    def put(count: int, lengths: list[int], gap: int) -> None:
        run = [count, lengths]
        runs.append(run)
        if gap:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append(run)

    while large:
        n = large[-1]
        k = bisect_left(large, capacity - n + 1) - 1
        if k < 0:
            count, partner = left[n], None
        else:
            partner = large[k]
            count = left[n] // 2 if partner == n else min(left[n], left[partner])
            if count == 0:  # one of this length is left and only fits itself: try the next smaller partner
                count, partner = 1, (large[k - 1] if k else None)
        for m in [n] if partner is None else [n, partner]:
            left[m] -= count
        for m in {n, partner} - {None}:
            if not left[m]:
                large.remove(m)
        pair = [(n, 1)] if partner is None else [(n, 2)] if partner == n else [(n, 1), (partner, 1)]
        put(count, pair, capacity - n - (partner or 0))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            k = bisect_left(sizes, n)
            if k == len(sizes):
                each = capacity // n
                full, rest = divmod(count, each)
                if full:
                    put(full, [(n, each)], capacity - n * each)
                if rest:
                    put(1, [(n, rest)], capacity - n * rest)
                break
            gap = sizes[k]
            run = gaps[gap].pop()
            if not gaps[gap]:
                sizes.pop(k)
            each = gap // n
            full = min(run[0], count // each)
            rest = min(count - full * each, each) if full < run[0] else 0
            lengths, spare = run[1], run[0] - full - (1 if rest else 0)
            runs_left = []
            if full:
                runs_left.append((full, lengths + [(n, each)], gap - n * each))
            if rest:
                runs_left.append((1, lengths + [(n, rest)], gap - n * rest))
            if spare:
                runs_left.append((spare, lengths, gap))
            run[0] = 0
            for r in runs_left:
                put(*r)
            count -= full * each + rest
    return [(c, x) for c, x in runs if c]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """The runs with their lengths written out: (multiplicity, lengths)."""
    return [(c, [n for n, k in lengths for _ in range(k)]) for c, lengths in plan_runs(histogram, capacity)]


def places(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, sequences, offset) of its places, by first rank.

    A run of m sequences that holds a length k times in a row is one row of m * k ranks: rank j of
    them is in its sequence j % m, at the offset plus j // m times the length.
    """
    rows: dict[int, list] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in runs:
        offset = 0
        for n, k in lengths:
            rows[n].append((rank[n], sequence, count, offset))
            rank[n] += count * k
            offset += n * k
        sequence += count
    return {n: np.array(x, dtype=np.int64) for n, x in rows.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, with each one's partition and its rank there among its length."""

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = token_bytes(text, path) + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own) & 0xFFFFFFFF, part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    ship(spark)
    path = path or vocabulary_path(VOCABULARY)
    pieces = cut(cut_pieces(docs, path, capacity, id_col, text_col), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("c"))
    counts = cut(counts, "piece_counts")
    # at most `capacity` rows, whatever the input
    histogram = {r.length: r.c for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    table = spark.sparkContext.broadcast(places(plan_runs(histogram, capacity)))
    # where the ranks of a partition begin: one row for each length and partition
    before = counts.withColumn("base", F.sum("c").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "part", F.coalesce("base", F.lit(0)).alias("base"))
    # a row for each length and partition is too much to broadcast on large inputs
    ranked = pieces.join(before.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def deal(batches):
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                rows, own = table.value[int(n)], np.flatnonzero(length == n)
                k = np.searchsorted(rows[:, 0], rank[own], side="right") - 1
                nth = rank[own] - rows[k, 0]
                sequence[own] = rows[k, 1] + nth % rows[k, 2]
                offset[own] = rows[k, 3] + nth // rows[k, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the remaining documents, packed; null, empty and repeated rows and rows without an id as in ``pack``, extra columns are not read."""
    return pack(docs)
