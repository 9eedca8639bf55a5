"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared as letters and digits, lower-cased, with one space
between runs. Items longer than ``WHOLE`` characters are searched as overlapping passages of ``PASSAGE``
characters (every ``STEP``, and the last), and all items longer than ``LEAK`` as passages of ``LEAK`` characters
(every ``LEAK_STEP``, and the last) as well: a verbatim part of 66 characters (``LEAK`` less its 6 edits), or a part of 75
(``LEAK + LEAK_STEP - 1``) within 6 edits, is certainly found wherever it lies. A passage of m characters with
an edit budget k shares at least m - q + 1 - k*q of its q-grams with every text that holds it
within k edits, and all of them lie on k + 1 neighbouring diagonals (text place minus passage place). So:

1. hashes of all q-grams of a text are looked up in a bitmap of the items' q-grams, and only
   stretches with enough hits within one passage's reach go on;
2. hits are dealt by item to bands of 2(k + 1) diagonals that overlap by k + 1 (k the largest budget), and
   counted there for each passage;
3. passages that reach their bound in a band are verified by banded alignment within the edit budget.

A long text is searched in overlapping windows of ``WINDOW`` characters, each of which holds every match that begins in
it whole; windows of one text with equal characters (repeated lines) are searched once. Looked-up q-grams are
dealt with in groups of windows, about ``ENTRIES`` at a time, so memory is bounded on hostile texts too.

The benchmark goes to the tasks in blocks of at most ``BLOCK`` characters, one job a block, and each block's findings are
stored before the next one is sent, so what is broadcast and what the driver holds is bounded however large the benchmark is; the
documents are never shuffled. A worker builds a block's index once.

Items with fewer than q characters after normalisation are found as they are, without edits, between word edges (in scripts without
spaces anywhere), at their first place.

Defined cases: null or empty texts and items without letters or digits match nothing, and equal items are each reported; repeated rows are each reported;
a null item text is empty; empty tables give empty results. Positions are those of the normalised text.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, ship, slices, text_of

Q, EDITS = 8, 12  # one edit for every EDITS characters
WHOLE, PASSAGE, STEP = 160, 128, 64
LEAK, LEAK_STEP = 72, 4
BLOCK, LARGE = 4_000_000, 500_000
WINDOW, ENTRIES = 4_096, 1_000_000
_BITS = 22
_B = np.uint32(0x9E3779B1)


def _letters() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    table = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalnum():
            table[c] = True
    return table


_table = None


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, each followed by one 0, and where each begins (with the end)."""
    global _table
    if _table is None:
        _table = _letters()
    low = [t.lower() for t in texts]
    raw = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1) - 1
    word = _table[raw]
    code = np.where(word, raw, np.uint32(32))
    code[ends] = 0
    before = np.concatenate([[False], word[:-1]])
    keep = word | before  # a letter, or the first other character behind one
    keep[ends] = True
    # an end behind a letter needs no space; one behind a space takes the space's place
    place = np.cumsum(keep)
    code, spots = code[keep], place[ends] - 1
    drop = spots[(spots > 0)]
    drop = drop[code[drop - 1] == 32] - 1
    if len(drop):
        left = np.ones(len(code), dtype=bool)
        left[drop] = False
        code = code[left]
        spots = spots - np.searchsorted(drop, spots)
    return code, np.concatenate([[0], spots + 1])


def grams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """A 32-bit hash for the q-gram that begins at each place (the last q - 1 places have none)."""
    n = max(len(code) - q + 1, 0)
    h = np.zeros(n, dtype=np.uint32)
    for j in range(q):
        h = h * _B + code[j : j + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


#: Scripts that write words without spaces between them: first and last code points.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _unspaced(code: np.ndarray) -> np.ndarray:
    out = np.zeros(len(code), dtype=bool)
    for a, b in UNSPACED:
        out |= (code >= a) & (code <= b)
    return out


class Short:
    """Items of fewer than Q characters: they are found as they are, between word edges."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.by_size: dict[int, dict[bytes, list[int]]] = {}
        for item, code in items:
            self.by_size.setdefault(len(code), {}).setdefault(code.tobytes(), []).append(item)
        self.hashes = {n: np.unique(grams(np.frombuffer(b"".join(own), dtype=np.uint32), n)[::n]) for n, own in self.by_size.items()}

    def matches(self, code: np.ndarray, begins: np.ndarray):
        """(text, item, begin, end, 0) of the first place of each item in each text; in scripts without spaces every place is an edge."""
        if not self.by_size or not len(code):
            return
        free, gap = _unspaced(code), (code == 32) | (code == 0)
        edge = np.ones(len(code) + 1, dtype=bool)  # whether a word may begin or end before each place
        edge[1:-1] = gap[1:] | gap[:-1] | free[1:] | free[:-1]
        first: dict[tuple[int, int], int] = {}
        for n, own in self.by_size.items():
            h = grams(code, n)
            begin = np.flatnonzero(edge[: len(h)] & edge[n : n + len(h)] & np.isin(h, self.hashes[n]))
            text = np.searchsorted(begins, begin, side="right") - 1
            for at, t in zip(begin.tolist(), text.tolist()):
                for item in own.get(code[at : at + n].tobytes(), ()):
                    first.setdefault((t, item), at)
        sizes = {item: n for n, own in self.by_size.items() for ids in own.values() for item in ids}
        for (t, item), at in first.items():
            yield t, item, at - int(begins[t]), at - int(begins[t]) + sizes[item], 0


def _steps(sizes: np.ndarray, of: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, begin) of the passages of ``size`` characters of the items ``of``: every ``step`` characters and the last."""
    last = sizes[of] - size
    n = -(-last // step) + 1
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(of, n), np.minimum(place * step, np.repeat(last, n))


class Passages:
    """The passages of a block of items and the index of the items' q-grams.

    Passages come by level, longest first: whole items and passages of ``PASSAGE``, then those of ``LEAK``.
    A passage is a place in its item, so q-grams are indexed once an item, however dense the passages are. All is
    held in arrays.
    """

    def __init__(self, items: list[tuple[int, str]], short: bool = True):
        codes, begins = normalise([t for _, t in items])
        sizes = np.diff(begins) - 1
        long_ = np.flatnonzero(sizes >= Q)
        few = np.flatnonzero((sizes > 0) & (sizes < Q)) if short else ()
        self.short = Short([(items[k][0], codes[begins[k] : begins[k + 1] - 1]) for k in few])
        self.ids = [items[k][0] for k in long_]
        self.codes = [codes[begins[k] : begins[k + 1] - 1] for k in long_]
        sizes = sizes[long_].astype(np.int32)
        every = np.arange(len(sizes), dtype=np.int32)
        brief, wide, leaky = every[sizes <= WHOLE], every[sizes > WHOLE], every[sizes > LEAK]
        parts = [(brief, np.zeros(len(brief), np.int32), sizes[brief]), (*_steps(sizes, wide, PASSAGE, STEP), PASSAGE), (*_steps(sizes, leaky, LEAK, LEAK_STEP), LEAK)]
        of, begin = (np.concatenate([p[i] for p in parts]).astype(np.int32) for i in (0, 1))
        m = np.concatenate([np.broadcast_to(p[2], len(p[0])) for p in parts]).astype(np.int32)
        level = np.repeat([0, 0, 1], [len(p[0]) for p in parts])
        order = np.lexsort((begin, of, level))
        self.of, self.begin, m = of[order], begin[order], m[order]
        self.level = np.searchsorted(level, [0, 1, 2])
        self.budget = np.minimum(m // EDITS, (m - Q) // Q)
        self.bound = m - Q + 1 - self.budget * Q
        self.size = m
        if len(m):
            n = sizes - (Q - 1)
            starts = np.cumsum(n) - n
            place_in = np.arange(n.sum(), dtype=np.int32) - np.repeat(starts.astype(np.int32), n)
            h = grams(codes)[np.repeat(begins[long_].astype(np.int64), n) + place_in]
            # hashes with their places in one number each, so that sorting moves both
            both = np.sort(h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64))
            self.h, order = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
            self.owner, self.at = np.repeat(every, n)[order], place_in[order]
            self.bits = np.zeros(1 << _BITS, dtype=bool)
            self.bits[self.h >> np.uint32(32 - _BITS)] = True
            self.longest = max(map(len, self.codes))
            self.width = int(self.budget.max()) + 1
            bound = self.bound[np.argsort(self.of, kind="stable")]
            self.least = np.minimum.reduceat(bound, np.searchsorted(np.sort(self.of), every))
            # (fewest hits, within how many characters) by edit budget
            same = [self.budget == k for k in np.unique(self.budget)]
            self.dense = [(int(self.bound[x].min()), int((m + self.budget)[x].max())) for x in same]

    @property
    def item(self) -> list:
        return [self.ids[k] for k in self.of]

    @property
    def code(self) -> list[np.ndarray]:
        return [self.codes[k][a : a + n] for k, a, n in zip(self.of, self.begin, self.size)]

    def windows(self, code: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, begin, end) of the stretches to search: whole texts, long ones as their different windows."""
        reach = int((self.size + 2 * self.budget).max())
        size = max(WINDOW, 4 * reach)
        out = []
        for t, (a, b) in enumerate(zip(begins[:-1].tolist(), (begins[1:] - 1).tolist())):
            if b - a <= size:
                out.append((t, a, b))
                continue
            seen = set()
            for x in range(a, b - reach, size - reach):
                y = min(x + size, b)
                own = hashlib.blake2b(code[x:y].tobytes(), digest_size=16).digest()
                if own not in seen:
                    seen.add(own)
                    out.append((t, x, y))
        return out

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, edits): the best place of each item in each text, by the longest level that has one."""
        whole, begins = normalise(texts)
        exact = list(self.short.matches(whole, begins))
        if not len(self.size):
            return sorted(exact, key=lambda f: f[0])
        spans = self.windows(whole, begins)
        code = np.concatenate([np.append(whole[a:b], np.uint32(0)) for _, a, b in spans]) if spans else whole
        edges = np.concatenate([[0], np.cumsum([b - a + 1 for _, a, b in spans])])
        best: dict[tuple[int, int], tuple] = {}
        for w, item, begin, end, edits, level in self._search(code, edges):
            t, a, _ = spans[w]
            row = (level, edits, a - int(begins[t]) + begin, a - int(begins[t]) + end)
            key = (t, item)
            if key not in best or row[:2] < best[key][:2]:
                best[key] = row
        found = [(t, item, begin, end, edits) for (t, item), (_, edits, begin, end) in best.items()]
        return sorted(found + exact, key=lambda f: f[0])

    def _search(self, code: np.ndarray, begins: np.ndarray):
        """(window, item, begin, end, edits, level) of the best place of each item in each window, in order of the windows."""
        h = grams(code)
        hit = np.flatnonzero(self.bits[h >> np.uint32(32 - _BITS)])
        # a hit stays if some window of one passage's reach around it holds enough hits
        near = np.zeros(len(hit), dtype=bool)
        for k, reach in self.dense:
            if len(hit) >= k:
                full = np.flatnonzero(hit[k - 1 :] - hit[: len(hit) - k + 1] < reach)
                mark = np.zeros(len(hit) + 1, dtype=np.int64)
                np.add.at(mark, full, 1)
                np.add.at(mark, full + k, -1)
                near |= np.cumsum(mark[:-1]) > 0
        hit = hit[near]
        if not len(hit):
            return
        lo, hi = np.searchsorted(self.h, h[hit]), np.searchsorted(self.h, h[hit], side="right")
        n = hi - lo
        some = n > 0
        hit, lo, n = hit[some], lo[some], n[some]
        window = np.searchsorted(begins, hit, side="right") - 1
        upto = np.concatenate([[0], np.cumsum(n)])
        starts = np.append(np.flatnonzero(np.diff(window, prepend=-1)), len(hit))  # where each window's hits begin
        at = 0
        while at < len(starts) - 1:
            # whole windows, as many as hold about ENTRIES entries together, one at least
            to = max(at + 1, int(np.searchsorted(upto[starts], upto[starts[at]] + ENTRIES, side="right")) - 1)
            part = slice(starts[at], starts[to])
            yield from self._verify(code, begins, hit[part], lo[part], n[part])
            at = to

    def _verify(self, code: np.ndarray, begins: np.ndarray, hit: np.ndarray, lo: np.ndarray, n: np.ndarray):
        """Bands, counts and alignment of the hits (places in ``code``), whose q-grams are the entries from ``lo`` on."""
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place, of, at = np.repeat(hit, n), self.owner[entry].astype(np.int64), self.at[entry].astype(np.int64)
        # texts lie so far apart here that no band covers diagonals of two of them
        apart = 2 * self.width + self.longest
        text = np.repeat(np.searchsorted(begins, hit, side="right") - 1, n)
        band = (place + text * apart - at + self.longest) // self.width + 1
        most = (len(code) + len(begins) * apart + self.longest) // self.width + 3
        key = np.concatenate([of * most + band, of * most + band - 1])
        bands = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], bands[1:] != bands[:-1]])) if len(bands) else []
        bands = bands[edge]
        rough = np.diff(np.append(edge, len(key)))
        enough = rough >= self.least[bands // most]
        stay = np.flatnonzero(enough[np.searchsorted(bands, key)])
        if not len(stay):
            return
        bands, first, group = np.unique(key[stay], return_index=True, return_inverse=True)
        text = text[stay[first] % len(place)]
        own, low = bands // most, (bands % most - 1) * self.width - self.longest - text * apart
        # the same q-gram at several places of a band must count once for each place of the item
        wide = self.longest + 1
        spots = np.unique(group * wide + at[stay % len(place)])
        base = np.arange(len(bands)) * wide
        ends = np.searchsorted(spots, np.append(base, len(bands) * wide))
        left, right = spots[ends[:-1]] - base, spots[ends[1:] - 1] - base
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        levels: dict[tuple[int, int], int] = {}
        for level, (a, b) in enumerate(zip(self.level[:-1], self.level[1:])):
            if a == b:
                continue
            line = self.of[a:b].astype(np.int64) * wide + self.begin[a:b]
            start = a + np.searchsorted(line, own * wide + np.maximum(left - int(self.size[a:b].max()) + Q, 0))
            n = a + np.searchsorted(line, own * wide + right, side="right") - start
            g = np.repeat(np.arange(len(bands)), n)
            p = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            front = base[g] + self.begin[p]
            count = np.searchsorted(spots, front + self.size[p] - Q, side="right") - np.searchsorted(spots, front)
            full = np.flatnonzero(count >= self.bound[p])
            # with so few shared q-grams a place has at least so many edits
            least = -((count - (self.size[p] - Q + 1)) // Q)
            settled = set(found)
            for i in full[np.argsort(least[full], kind="stable")]:
                t, one = int(text[g[i]]), int(p[i])
                key = (t, self.ids[self.of[one]])
                if key in settled or key in found and found[key][2] <= least[i]:
                    continue
                at0, size, budget = int(low[g[i]] + self.begin[one]), int(self.size[one]), int(self.budget[one])
                x = max(at0, int(begins[t]))
                y = min(at0 + 2 * self.width + size, int(begins[t + 1]) - 1)
                own_code = self.codes[self.of[one]][self.begin[one] : self.begin[one] + size]
                placed = align(own_code, code[x:y], budget)
                if placed and (key not in found or placed[2] < found[key][2]):
                    found[key] = (x + placed[0] - int(begins[t]), x + placed[1] - int(begins[t]), placed[2])
                    levels[key] = level
        for (t, item), x in sorted(found.items(), key=lambda f: f[0][0]):
            yield t, item, *x, levels[t, item]


def align(passage: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(begin, end, edits) of the passage's best place in the region within the budget, or None.

    Rows are the passage's characters. The region is one band of diagonals, so a row has only the cells
    on its diagonals; insertions along a row are a running minimum.
    """
    m, n = len(passage), len(region)
    data, own = region.astype("<u4").tobytes(), passage.astype("<u4").tobytes()
    at = data.find(own)
    while at >= 0 and at % 4:
        at = data.find(own, at + 1)
    if at >= 0:
        return at // 4, at // 4 + m, 0
    width = n - m + 2 * budget + 1  # diagonals -budget .. n - m + budget
    if width <= 0:
        return None
    far = m + n + 1
    text = np.concatenate([np.full(budget + 1, -1, np.int64), region.astype(np.int64), np.full(m + width + 1, -1, np.int64)])
    steps = np.arange(width)
    column = steps - budget  # the place in the region (characters used) at row 0
    cost = np.where((column >= 0) & (column <= n), 0, far)
    begin = np.where(cost == 0, column, 0)
    for i in range(m):
        # diagonal: same slot; deletion of the passage's character: from one slot to the right
        same = cost + (text[budget + 1 + column] != passage[i])
        up = np.append(cost[1:], far) + 1
        new = np.where(up < same, up, same)
        start = np.where(up < same, np.append(begin[1:], 0), begin)
        column = column + 1
        new = np.where((column >= 0) & (column <= n), new, far)
        slack = new - steps
        least = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == least, steps, 0))
        cost, begin = least + steps, start[source]
        if cost.min() > budget:
            return None
    k = int(np.argmin(cost))
    return (int(begin[k]), int(column[k]), int(cost[k])) if cost[k] <= budget else None


def blocks(benchmark: DataFrame, most: int = BLOCK, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of items (id, text), each of at most ``most`` characters (or one item), one after the other."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col).alias("text"))
    own, size = [], 0
    for r in items.toLocalIterator():
        if own and size + len(r.text) > most:
            yield own
            own, size = [], 0
        own.append((r.item_id, r.text))
        size += len(r.text)
    if own:
        yield own


RESULT = "doc_id long, item_id long, begin long, end long, edits long"
_index: tuple = (None, None)


def _passages(held, key: str, short: bool = True) -> Passages:
    """The index of a block. A large one is built once a worker, which keeps the last one; a small one goes with its task."""
    global _index
    if sum(len(t) for _, t in held.value) < LARGE:
        return Passages(held.value, short)
    if _index[0] != (key, short):
        _index = ((key, short), Passages(held.value, short))
    return _index[1]


def _each_block(spark, benchmark: DataFrame, most: int):
    """(items, whether it is the only block) one after the other; the driver holds two blocks at most."""
    every = blocks(benchmark, most)
    own, n = next(every, None), 0
    while own is not None:
        following = next(every, None)
        yield own, n == 0 and following is None
        own, n = following, n + 1


def contaminated(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, begin, end, edits: the best place of each item in each document that holds (a passage of) it.

    With several blocks each one's findings are stored before the next one is sent, and its broadcast ends.
    """
    spark = docs.sparkSession
    ship(spark)
    texts, found = id_and_text(docs, id_col, text_col), []
    for items, only in _each_block(spark, benchmark, most):
        held = spark.sparkContext.broadcast(items)
        rows = texts.mapInArrow(_search(held, uuid.uuid4().hex), RESULT)
        found.append(rows if only else cut(rows, "leaks"))
        if not only:
            held.destroy()
    out = spark.createDataFrame([], RESULT) if not found else found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def _search(held, key: str):
    def run(batches):
        index = _passages(held, key)
        for b in slices(batches):
            rows = index.matches(b.column(1).to_pylist())
            if rows:
                t, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), *(pa.array(c, pa.int64()) for c in rest)], names=["doc_id", "item_id", "begin", "end", "edits"])

    return run


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go; all others stay as they are.

    The benchmark's blocks filter one after the other, inside the tasks: nothing is shuffled or joined; between two blocks the
    documents left are stored. Items of fewer than Q characters (a word or two) are no passage: they take nothing away here,
    ``contaminated`` reports them. Rows with null or empty texts or null ids stay or go by their text alone, repeated rows
    each for themselves, all columns stay as they are, whatever their names; an empty table or an empty benchmark takes nothing away.
    """
    ship(spark)
    schema, at = docs.schema, docs.columns.index("text")
    for items, only in _each_block(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), BLOCK):
        held, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches, held=held, key=key):
            index = _passages(held, key, short=False)
            for b in slices(batches):
                bad = {t for t, *_ in index.matches([x or "" for x in b.column(at).to_pylist()])}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)]))

        docs = docs.mapInArrow(run, schema)
        if not only:
            docs = cut(docs, "clean")
            held.destroy()
    return docs
