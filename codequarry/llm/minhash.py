"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation yields two signature values, its minimum and its maximum, so ``HASHES``
evaluations give ``2 * HASHES`` values. They are cut into ``BANDS`` bands of ``ROWS`` values;
documents that agree in a whole band are candidates. With 64 bands of 5 values a pair at
similarity 0.75 escapes all bands with probability (1 - 0.75**5)**64 = 3e-8.

Only links that the components need are confirmed, so a group of copies costs rows in
proportion to its size:

1. documents with equal sets are one class, represented by the smallest id;
2. in each band bucket every class is compared with the bucket's hub: the class that shares the most
   bucket places with others, which in a group of edited copies is the one nearest to all;
3. the confirmed links give components. In a bucket that still holds several of them, classes
   are compared across components, but only where a link is possible at all. Classes that share rare shingles (held by at
   most ``RARE`` documents) meet through these. Others share common shingles only: inside a hub at most as many as
   either shares with the hub, outside it at most as many common ones as either has there, which for independently edited
   copies of the hub is none. So a bucket's components are compared one after the other, each through its hub, in rows in
   proportion to the bucket.

Classes are joined by id as one row each, with their buckets in an array that is exploded afterwards.

Defined cases: null or empty texts have an empty set and link with nothing; fewer than five
words make one shingle; rows that share a doc_id are one document, for which the row with the largest
set stands (ties: the greatest digest of the set); rows with a null doc_id are returned one by one, unlinked,
with a null component and kept; extra columns are neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, ship, slices

WORDS = 5
SIMILAR = 75  # per cent, at least
HASHES, ROWS = 160, 5
BANDS = 2 * HASHES // ROWS
#: A shingle that at most this many documents of the mixed buckets hold is rare.
RARE = 32
#: Components of a bucket that are compared with the others one after the other, each through its hub, and rows of a bucket
#: (half as many pairs for each of them) whose pairs are made at once.
PEELS, SMALL = 4, 64
#: About so many documents are compared with one copy of their hub's text.
CHUNK = 64
#: Up to this many candidate ids (8 bytes each) go to the tasks by broadcast; more are joined by a shuffle.
FEW = 1_000_000
#: Small intermediate tables (links, places in buckets) are read in parts of about so many rows, some 10 MB at most.
PART = 200_000

_U = np.uint64
_PERM = np.random.default_rng(20240229).integers(0, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        inv = _U(pow(int(_BASE), -1, 1 << 64))
        _powers = np.concatenate([[_U(1)], np.cumprod(np.full(n, _BASE, dtype=np.uint64))])
        _inverse = np.concatenate([[_U(1)], np.cumprod(np.full(n, inv, dtype=np.uint64))])
    return _powers, _inverse


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for every word of all texts, and how many words each text has."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    last = np.cumsum(sizes)
    count = np.diff(np.concatenate([[0], np.searchsorted(start, last)]))
    power, inverse = _power(len(buf) + 1)
    total = np.concatenate([[_U(0)], np.cumsum((_LOWER[buf].astype(np.uint64) + _U(1)) * power[: len(buf)], dtype=np.uint64)])
    h = (total[end] - total[start]) * inverse[start]
    return _mix(h ^ (end - start).astype(np.uint64) * _U(0x2545F4914F6CDD1D)), count


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, count = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        rolled[: n - k] += words[k:] * _PLACE[k]
    rolled = _mix(rolled)
    out, at = [], 0
    for c in count:
        if c >= WORDS:
            out.append(np.unique(rolled[at : at + c - WORDS + 1]))
        elif c:
            own = np.sum(words[at : at + c] * _PLACE[:c], dtype=np.uint64, keepdims=True)
            out.append(_mix(own + np.full(1, c, dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += c
    return out


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys (one row of BANDS 64-bit values a set) of non-empty sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    low = np.empty((len(sets), HASHES), dtype=np.uint32)
    high = np.empty_like(low)
    # blocks of about 16k values keep the work inside the cache
    block, at = [], 0
    for i in range(len(sets) + 1):
        if i == len(sets) or (block and sum(sizes[block]) + sizes[i] > 16_384):
            values = np.concatenate([sets[j] for j in block]) if block else None
            starts = np.concatenate([[0], np.cumsum(sizes[block])[:-1]]) if block else None
            for k in range(HASHES if block else 0):
                h = ((values * _PERM[k]) >> _U(32)).astype(np.uint32)
                low[block[0] : block[-1] + 1, k] = np.minimum.reduceat(h, starts)
                high[block[0] : block[-1] + 1, k] = np.maximum.reduceat(h, starts)
            block = []
        if i < len(sets):
            block.append(i)
    # a band never holds both ends of one permutation: minima and maxima alternate by halves
    both = np.concatenate([low, high], axis=1).astype(np.uint64)
    order = np.arange(2 * HASHES).reshape(ROWS, BANDS).T.reshape(-1)
    both = both[:, order].reshape(len(sets), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE, both.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key ^ both[:, :, r] * _PLACE[r])
    return key


def _set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signatures(batches):
    for b in slices(batches):
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = _bands([sets[i] for i in full]).view(np.int64) if full else np.empty((0, BANDS), np.int64)
        offsets = np.zeros(len(sets) + 1, dtype=np.int32)
        sizes = np.zeros(len(sets), dtype=np.int32)
        sizes[full] = BANDS
        offsets[1:] = np.cumsum(sizes)
        own = [_set_key(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))],
            names=["doc_id", "n_shingles", "set_key", "bands"],
        )


def _explode(batches):
    """doc_id, shingle: the sets of the documents, one row a shingle."""
    for b in slices(batches, most=500_000):
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
        ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], names=["doc_id", "shingle"])


def _against(batches):
    """(hub, other, shared, linked) from rows (hub, chunk, member, other, text) by hub and chunk, the hub's own row first."""
    hub = None
    for b in slices(batches):
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in b.column(4).to_pylist()])
        member, shared, linked = b.column(2).to_pylist(), [], []
        for is_member, own in zip(member, sets):
            hub = hub if is_member else own
            n = len(np.intersect1d(hub, own, assume_unique=True)) if is_member else 0
            shared.append(n)
            linked.append(n * 100 >= (len(hub) + len(own) - n) * SIMILAR)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], names=["hub", "other", "shared", "linked"]).filter(pa.array(member, pa.bool_()))


def _gathered(stored: DataFrame, weight: int = 1) -> DataFrame:
    """A stored table in as few partitions as its rows need: a table of up to ``PART`` rows is grouped and joined
    without a shuffle, and a larger one as it is scanned."""
    return stored.coalesce(max(1, -(-stored.count() * weight // PART)))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) stored links  ->  (id, component): the smallest id that each linked id reaches.

    Alternates large-star and small-star rounds: each is one grouping by node in which a node
    hands its neighbours to their minimum, so the depth of the forest shrinks geometrically.
    A hub is grouped by its neighbours, not collected: both rounds are a minimum per node
    (combined before the shuffle) and a join back. The minima are written first, so that join has nothing above or
    below it that needs a hub's rows together, and adaptive execution can split it. Few links (``PART``) need no shuffles.
    """
    keep = lambda df, name: _gathered(cut(df, name))
    edges = keep(_gathered(edges).select("a", "b").where("a <> b").distinct(), name)
    while True:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = keep(large, name)
        least = keep(large.groupBy("b").agg(F.min("a").alias("m")), name)
        small = large.join(least, "b").select("a", "b", "m")
        small = small.select("m", F.explode(F.array("a", "b")).alias("b")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        small = keep(small, name)
        # done when every node has one parent and no parent is a child
        parents = small.groupBy("b").agg(F.count("*").alias("n"))
        open_ = parents.where("n > 1").limit(1).count() or small.select(F.col("a").alias("b")).join(parents, "b", "left_semi").limit(1).count()
        edges = small
        if not open_:
            roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
            return cut(edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots), name)


def _alike(n_a: str, n_b: str):
    """What the sizes alone allow: the smaller set has to hold SIMILAR per cent of the larger."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * SIMILAR


def _measure(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, other, shared, linked) of the pairs (hub, other): how many shingles their full sets share, and if that makes a link.

    A hub's text travels once for about ``CHUNK`` of its partners, and a task holds one hub's set and one slice
    of partners at a time, however many there are. Texts travel, as they are smaller than the sets.
    """
    spread = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("spread"))
    dealt = cut(pairs.join(spread, "hub").select("hub", "other", F.pmod(F.xxhash64("other"), F.col("spread")).cast("int").alias("chunk")), "dealt")
    hubs = dealt.select("hub", "chunk").distinct().join(texts, F.col("hub") == F.col("doc_id")).select("hub", "chunk", F.lit(False).alias("member"), F.col("hub").alias("other"), "text")
    members = dealt.join(texts, F.col("other") == F.col("doc_id")).select("hub", "chunk", F.lit(True).alias("member"), "other", "text")
    rows = hubs.unionByName(members).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "member")
    return rows.mapInArrow(_against, "hub long, other long, shared long, linked boolean")


def _links(measured: DataFrame) -> DataFrame:
    return measured.where("linked").select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"))


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) among the pairs (a, b, hub) whose full sets are similar enough."""
    return _links(_measure(pairs.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other")), texts))


def _company(classes: DataFrame) -> DataFrame:
    """doc_id, n, hs, score: the classes that share a bucket, their shared buckets and those buckets' sizes together."""
    slots = classes.select(F.explode("bands").alias("h"), "doc_id", "n")
    shared = slots.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    return slots.join(shared, "h").groupBy("doc_id").agg(F.first("n").alias("n"), F.collect_list("h").alias("hs"), F.sum("size").alias("score"))


def _stars(company: DataFrame) -> DataFrame:
    """(a, b, hub), a < b: every class with the hub of each of its buckets, where the sizes allow a link."""
    slots = company.select(F.explode("hs").alias("h"), "doc_id", "n", "score")
    hubs = slots.groupBy("h").agg(F.max_by(F.struct("doc_id", "n"), F.struct("score", -F.col("doc_id"))).alias("hub"))
    pairs = slots.join(hubs, "h").where("doc_id <> hub.doc_id").where(_alike("n", "hub.n"))
    return pairs.select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b"), F.col("hub.doc_id").alias("hub")).distinct()


def _possible(shared, n_a, n_b):
    """Sets of these sizes that share at most so many shingles can be linked: i >= s * (na + nb - i)."""
    return shared * (100 + SIMILAR) >= (n_a + n_b) * SIMILAR


def _peeled(rest: DataFrame, rare: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, links, rest): one component of every bucket is compared with the others in it, and leaves.

    ``rest`` has a row (h, id, n, c, m, score) for each bucket of a class: its size, component and common shingles. All are
    measured against the bucket's hub H. Two classes without a shared rare shingle share inside H at most what either shares with H,
    and outside H at most the common shingles that either has there. Where that can't make a link there is no pair. Sides
    are thinned by the best that the other side of their bucket could give before they are joined.
    """
    hubs = rest.groupBy("h").agg(F.max_by(F.struct("id", "n", "c"), F.struct("score", -F.col("id"))).alias("hub"))
    rows = rest.join(hubs, "h").select("h", "id", "n", "c", "m", "score", F.col("hub.id").alias("hub"), F.col("hub.c").alias("hub_c"))
    rows = _gathered(cut(rows, "peel"))
    measured = _gathered(cut(_measure(rows.where(F.col("id") != F.col("hub")).select("hub", F.col("id").alias("other")).distinct(), near), "peel_measured"))
    # from the hubs' side: each of their rare shingles is held by ``RARE`` documents at most
    of_hubs = rare.select(F.col("doc_id").alias("hub"), "shingle").join(measured.select("hub").distinct(), "hub", "left_semi")
    both = of_hubs.join(rare.select(F.col("doc_id").alias("other"), "shingle"), "shingle").groupBy("hub", "other").agg(F.count("*").alias("r"))
    known = measured.join(both, ["hub", "other"], "left").select("hub", F.col("other").alias("id"), "shared", F.coalesce("r", F.lit(0)).alias("r"))
    rows = rows.join(known, ["hub", "id"], "left")
    own = F.col("id") == F.col("hub")
    inside = F.when(own, F.col("n")).otherwise(F.col("shared"))
    outside = F.when(own, F.lit(0)).otherwise(F.col("m") - F.col("shared") + F.col("r"))
    rows = cut(rows.select("h", "id", "n", "c", "m", "score", "hub", (F.col("c") == F.col("hub_c")).alias("first"), inside.alias("i"), outside.alias("k")), "peel_rows")
    rows = _gathered(rows)
    best = lambda f, c, first: f(F.when(F.col("first") == first, F.col(c)))
    other = lambda c: F.when(F.col("first"), F.col(f"{c}_else")).otherwise(F.col(f"{c}_first"))
    best_of = rows.groupBy("h").agg(*[best(f, c, first).alias(f"{c}_{name}") for f, c in ((F.max, "i"), (F.max, "k"), (F.min, "n")) for first, name in ((True, "first"), (False, "else"))])
    least = F.greatest(other("n"), F.ceil(F.col("n") * SIMILAR / 100))
    sides = rows.join(best_of, "h").where(_possible(F.least("i", other("i")) + F.least("k", other("k")), F.col("n"), least)).select(*rows.columns)
    x, y = (sides.where(F.col("first") == first).select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "c", "i", "k", "score")]) for first, s in ((True, "x"), (False, "y")))
    found = x.join(y, "h").where(_possible(F.least("i_x", "i_y") + F.least("k_x", "k_y"), F.col("n_x"), F.col("n_y")))
    return found.select(F.col("id_x").alias("x"), F.col("score_x").alias("sx"), F.col("id_y").alias("y"), F.col("score_y").alias("sy")), _links(measured), rows.where("not first").select(*rest.columns)


def _split(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(small, large): the rows of buckets that hold several components, ``SMALL`` rows at most or more."""
    mixed = rest.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("k")).where("c0 <> c1")
    rows = _gathered(cut(rest.join(mixed.select("h", "k"), "h"), "peel_rest"))
    return rows.where(F.col("k") <= SMALL).drop("k"), rows.where(F.col("k") > SMALL).drop("k")


def _joined(rest: DataFrame) -> DataFrame:
    """(x, sx, y, sy): the pairs of classes of one bucket, but not one component, whose common shingles could make a link."""
    x, y = (rest.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "c", "m", "score")]) for s in ("x", "y"))
    left = x.join(y, "h").where("id_x < id_y and c_x <> c_y").where(_possible(F.least("m_x", "m_y"), F.col("n_x"), F.col("n_y")))
    return left.select(F.col("id_x").alias("x"), F.col("score_x").alias("sx"), F.col("id_y").alias("y"), F.col("score_y").alias("sy"))


def _across(company: DataFrame, found: DataFrame, texts: DataFrame, tried: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """((a, b, hub), a < b: the untried pairs of classes that share a bucket, not a component, and could be linked; links found on the way)."""
    named = company.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id"))
    slots = named.select(F.explode("hs").alias("h"), "doc_id", "n", "c", "score")
    mixed = slots.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
    # one row a class: its buckets that hold several components, and whether it lies outside the first one somewhere
    facts = slots.join(mixed, "h").groupBy("doc_id").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.first("score").alias("score"), F.collect_list("h").alias("hs"), F.max(F.col("c") != F.col("c0")).alias("outside"))
    facts = cut(facts, "mixed")
    if facts.isEmpty():
        return None, []
    grams = cut(texts.join(facts.select("doc_id"), "doc_id", "left_semi").mapInArrow(_explode, "doc_id long, shingle long"), "grams")
    rare = grams.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
    rare = cut(grams.join(rare, "shingle"), "rare")
    scarce = rare.groupBy("doc_id").agg(F.count("*").alias("r"))
    facts = facts.join(scarce, "doc_id", "left").withColumn("m", F.col("n") - F.coalesce("r", F.lit(0)))
    facts = _gathered(cut(facts.drop("r"), "facts"), BANDS)
    # common shingles alone could do: only classes that are rich in them, bucket by bucket, one component after the other
    rest = facts.where(F.col("m") * 100 >= F.col("n") * SIMILAR).select(F.explode("hs").alias("h"), F.col("doc_id").alias("id"), "n", "c", "m", "score")
    pairs, links, own = [], [], None
    for _ in range(PEELS):
        small, rest = _split(rest)
        pairs.append(_joined(small))
        if rest.isEmpty():
            break
        if own is None:  # what is left of the rare shingles in large buckets
            own = _gathered(cut(rare.join(rest.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "peel_rare"))
        some, more, rest = _peeled(rest, own, texts)
        pairs.append(some)
        links.append(more)
    else:
        pairs.append(_joined(rest))
    # else they have to share rare shingles, each of which few documents hold
    shared = rare.where("df > 1").select("shingle", "doc_id")
    met = shared.join(facts.where("outside").select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "x").join(shared.withColumnRenamed("doc_id", "y"), "shingle").where("x <> y")
    of = lambda x: facts.select(F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col("c").alias("c" + x), F.col("m").alias("m" + x), F.col("score").alias("s" + x))
    met = met.groupBy("x", "y").agg(F.count("*").alias("r")).join(of("x"), "x").join(of("y"), "y")
    met = met.where("cx <> cy").where(_possible(F.least("mx", "my") + F.col("r"), F.col("nx"), F.col("ny"))).select("x", "sx", "y", "sy")
    # stored on its own: together with the buckets' pairs it is one plan of thousands of tasks, whose metrics the driver holds
    pairs.append(_gathered(cut(met, "met")))
    every = pairs[0]
    for p in pairs[1:]:
        every = every.unionByName(p)
    hub = F.when(F.struct("sx", -F.col("x")) > F.struct("sy", -F.col("y")), F.col("x")).otherwise(F.col("y"))
    every = every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), hub.alias("hub"))
    return cut(every.distinct().join(tried, ["a", "b"], "left_anti"), "pairs"), links


def _rooted(rows: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """``rows`` with the component of the id in ``column`` as ``root``: itself, where nothing is linked to it."""
    return rows.join(found.select(F.col("id").alias(column), F.col("component").alias("root")), column, "left").withColumn("root", F.coalesce("root", column))


def _repeated(rows: DataFrame) -> DataFrame | None:
    """The ids that several rows share, or None."""
    found = cut(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    return None if found.isEmpty() else found


def _set_keys(batches):
    """(doc_id, set_key, text) of rows (doc_id, text)."""
    for b in slices(batches):
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_set_key(s) for s in sets], pa.binary()), b.column(1)], names=["doc_id", "set_key", "text"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    ship(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    signed = cut(texts.mapInArrow(_signatures, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signatures")
    repeated = _repeated(signed)
    if repeated is not None:  # the row with the largest set stands for its document
        one = signed.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "set_key", "bands")).alias("r")).select("doc_id", "r.*")
        of_one = texts.join(repeated, "doc_id", "left_semi").mapInArrow(_set_keys, "doc_id long, set_key binary, text string")
        of_one = of_one.join(one.select("doc_id", "set_key"), ["doc_id", "set_key"]).dropDuplicates(["doc_id"]).select("doc_id", "text")
        signed = cut(signed.join(repeated, "doc_id", "left_anti").unionByName(one), "signatures")
        texts = texts.join(repeated, "doc_id", "left_anti").unionByName(of_one)
    usable = signed.where("doc_id is not null and set_key is not null")
    classes = cut(
        usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r")).select("set_key", "r.doc_id", F.col("r.n_shingles").alias("n"), "r.bands"), "classes"
    )
    members = usable.join(classes.select("set_key", F.col("doc_id").alias("class_id")), "set_key").select("doc_id", "class_id")

    company = cut(_company(classes), "company")
    ids = company.select("doc_id")
    if ids.limit(FEW + 1).count() <= FEW:
        ids = F.broadcast(ids)
    near = cut(texts.join(ids, "doc_id", "left_semi"), "near_texts")
    tried = cut(_stars(company), "pairs")
    links = cut(_confirm(tried, near), "links")
    found = components(links)
    across, more = _across(company, found, near, tried)
    of_class = _rooted(classes.select(F.col("doc_id").alias("class_id")), "class_id", found).withColumnRenamed("root", "component")
    if across is not None:
        links = _confirm(across, near)
        for df in more:
            links = links.unionByName(df)
        # components are the nodes of what links them
        links = _rooted(_rooted(cut(links, "links"), "a", found).withColumnRenamed("root", "x"), "b", found)
        joined = components(cut(links.select(F.col("x").alias("a"), F.col("root").alias("b")).where("a <> b").distinct(), "links"))
        of_class = _rooted(of_class, "component", joined).select("class_id", F.col("root").alias("component"))
    placed = members.join(of_class, "class_id").select("doc_id", "component")
    known = signed.where("doc_id is not null").select("doc_id", "n_shingles")
    out = known.join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    loose = signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(loose)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_duplicates_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies only the document with the smallest id stays.

    Of rows that share an id the one with the longest text stays (ties: the greatest text); rows without
    an id stay, as nothing tells them apart from other documents.
    """
    columns = docs.columns
    gone = cut(near_duplicates(docs).where("not kept").select("doc_id"), "gone")
    if gone.limit(FEW + 1).count() <= FEW:
        gone = F.broadcast(gone)
    left = docs.join(gone, "doc_id", "left_anti").select(*columns)
    repeated = _repeated(left.select("doc_id"))
    if repeated is None:
        return left
    one = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct(*columns), F.struct(F.length("text"), "text")).alias("r")).select("r.*")
    return left.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(one)


#: Words, shingles, all pairs that share a shingle, then reachability. Shingles are compared as text.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.doc_id),
least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l USING (doc_id)
"""
