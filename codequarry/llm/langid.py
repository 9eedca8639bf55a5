"""Language identification by segmentation-marginalised unigrams.

Every language has its own probabilities for the pieces of one fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces, by the forward
algorithm; a text's is the product over its words (runs of letters of any length, lower-cased, marked at
their begin). Forward sums run over many words at once in numpy and workers keep
the scores of short words they have met, so a repeated word costs one lookup; words of ``LONG`` letters or more
are summed on their own, scaled at every letter, in segments of bounded memory.

The probabilities are learned by expectation maximisation (forward and backward sums) from a sample of the
labelled documents of the training folds: whole texts, at most ``SAMPLE`` rows shared evenly among the languages and at
most ``CHARS`` characters (see ``labelled_sample``). Language, source and id are no inputs of a prediction.

Defined cases: a text that is null or has no letter (Unicode category L) is ``und`` with score 0, as is every text
when nothing is labelled; ties go to the first language in alphabetical order; repeated rows
give repeated results; a null doc_id belongs to the held-out fold; extra columns are neither read nor returned by
``predict`` and stay as they are in ``language_stage``; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_and_text, labelled_sample, ship, slices
from .token_counts import vocabulary_path

SAMPLE, CHARS, ROUNDS, SMOOTH = 3_000, 12_000_000, 3, 0.5
LONG, SEGMENT, UNKNOWN = 32, 4_096, 1e-7
#: Scores that a worker keeps: at most so many words, and at most so many numbers in all.
CACHE, CACHE_NUMBERS = 300_000, 4_000_000
VOCABULARY, UND = "piece_bpe_32k.model", "und"

words_of = regex.compile(r"\p{L}+").findall
letter_in = regex.compile(r"\p{L}").search
_B = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@functools.cache
def pieces(path: str) -> tuple[str, ...]:
    """The vocabulary's pieces of letters, lower case, with ▁ for the begin of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return tuple(sorted({p for p in found if p.lower() == p and (p == "▁" or p.removeprefix("▁").isalpha())}))


class Table:
    """Piece numbers by 64-bit hash in an open table, for whole arrays of hashes at once."""

    def __init__(self, path: str):
        own = pieces(path)
        self.size, self.longest = len(own), max(map(len, own))
        keys = np.array([self._hash(p) for p in own], dtype=np.uint64)
        self.key, self.at = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32)
        self.probes = 1
        for i, k in enumerate(keys):
            slot, n = int(k >> np.uint64(46)), 1
            while self.at[slot] >= 0:
                slot, n = (slot + 1) % _SLOTS, n + 1
            self.key[slot], self.at[slot] = k, i
            self.probes = max(self.probes, n)

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(_B) + ord(c)) % (1 << 64)
        return int(_mix(np.array([h], dtype=np.uint64))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        h = _mix(h)
        slot = (h >> np.uint64(46)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        for _ in range(self.probes):
            same = self.key[slot] == h[todo]
            out[todo[same]] = self.at[slot[same]]
            more = ~same & (self.at[slot] >= 0)
            todo, slot = todo[more], (slot[more] + 1) % _SLOTS
            if not len(todo):
                break
        return out


@functools.cache
def table(path: str) -> Table:
    return Table(path)


def split_words(text: str) -> list[str]:
    """The marked words of a text."""
    return ["▁" + w for w in words_of(text.lower())]


def lattice(t: Table, words: list[str]):
    """For words of one length: the piece (or -1) that ends at each place with each size."""
    n, size = len(words), len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size).astype(np.uint64)
    edges = {}
    for k in range(1, min(size, t.longest) + 1):
        h = np.zeros((n, size - k + 1), dtype=np.uint64)
        for j in range(k):
            h = h * _B + codes[:, j : j + size - k + 1]
        edges[k] = t.find(h.reshape(-1)).reshape(n, size - k + 1)
    return edges, n, size


def forward(t: Table, words: list[str], P: np.ndarray):
    """The forward sums of words of one length: (words, places + 1, languages), and the lattice."""
    edges, n, size = lattice(t, words)
    alpha = np.zeros((size + 1, n, P.shape[1]))
    alpha[0] = 1.0
    for i in range(1, size + 1):
        alpha[i] = alpha[i - 1] * np.where((edges[1][:, i - 1] < 0)[:, None], UNKNOWN, P[edges[1][:, i - 1]])
        for k in range(2, min(i, t.longest) + 1):
            e = edges[k][:, i - k]
            hit = np.flatnonzero(e >= 0)
            if len(hit):
                alpha[i][hit] += alpha[i - k][hit] * P[e[hit]]
    return alpha, edges


def long_word(t: Table, word: str, P: np.ndarray, factors: bool = False):
    """The log probability of a word of any length in each language, summed over all its segmentations.

    ``window[k - 1]`` is the forward sum at k letters before the present one over that at the letter before, so
    nothing runs out of range; each step's factor is the ratio of neighbouring forward sums. With
    ``factors`` these ratios (letters, languages) are returned instead of their summed logarithms.
    """
    reach, languages = t.longest, P.shape[1]
    known = np.concatenate([P, np.zeros((1, languages))])  # piece -1, none, is the last row
    window = np.zeros((reach, languages))
    window[0] = 1.0
    total, kept = np.zeros(languages), []
    for at in range(0, len(word), SEGMENT):
        first = max(0, at - reach + 1)
        part = word[first : at + SEGMENT]
        edges, n = lattice(t, [part])[0], min(SEGMENT, len(word) - at)
        step = np.zeros((n, reach, languages))
        for k, e in edges.items():
            begin = np.arange(at + 1 - k, at + n + 1 - k) - first  # of the pieces of k letters that end at each place
            fits = np.flatnonzero(begin >= 0)
            step[fits, k - 1] = known[e[0][begin[fits]]]
        alone = edges[1][0][at - first : at - first + n]
        step[alone < 0, 0] = UNKNOWN
        ratio = np.empty((n, languages))
        for i in range(n):
            ratio[i] = (window * step[i]).sum(0)
            window[1:] = window[:-1] / ratio[i]
            window[0] = 1.0
        total += np.log(ratio).sum(0)
        if factors:
            kept.append(ratio)
    return np.concatenate(kept) if factors else total


def by_length(words) -> list[list[str]]:
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    return [g[i : i + 8_192] for g in groups.values() for i in range(0, len(g), 8_192)]


def word_scores(path: str, words: list[str], P: np.ndarray) -> dict[str, np.ndarray]:
    """The log probability of each word in each language."""
    out = {w: long_word(table(path), w, P) for w in words if len(w) >= LONG}
    for group in by_length(w for w in words if len(w) < LONG):
        alpha, _ = forward(table(path), group, P)
        out.update(zip(group, np.log(alpha[-1] + 1e-300)))
    return out


def _expect_long(t: Table, word: str, weight: np.ndarray, P: np.ndarray, expected: np.ndarray) -> None:
    """Add the expected piece counts of one long word. ``after[i]``: how likely a piece ends at place i, times the weight."""
    ratio = long_word(t, word, P, factors=True)
    size, languages = ratio.shape
    edges, known = lattice(t, [word])[0], np.concatenate([P, np.zeros((1, languages))])
    after = np.zeros((size + 1, languages))
    after[size] = weight
    for i in range(size - 1, -1, -1):
        reach = min(size - i, t.longest)
        piece = np.array([edges[k][0][i] for k in range(1, reach + 1)])
        p = known[piece]
        if piece[0] < 0:
            p[0] = UNKNOWN
        flow = p / np.cumprod(ratio[i : i + reach], axis=0) * after[i + 1 : i + reach + 1]
        after[i] = flow.sum(0)
        expected[piece[piece >= 0]] += flow[piece >= 0]  # pieces that begin at one place differ


def train(texts: list[str], labels: list[str], path: str) -> tuple[list[str], np.ndarray]:
    """The languages in order and the piece probabilities (pieces, languages)."""
    languages = sorted(set(labels))
    if not languages:
        return [], np.zeros((0, 0))
    counts: dict[str, np.ndarray] = {}
    for text, label in zip(texts, labels):
        g = languages.index(label)
        for w, n in Counter(split_words(text)).items():
            if w not in counts:
                counts[w] = np.zeros(len(languages))
            counts[w][g] += n
    t = table(path)
    # a start that prefers long pieces: every letter costs the same
    start = np.array([0.02 ** (1 if len(p) < 2 else 1.5) for p in pieces(path)])
    P = np.repeat((start / start.sum())[:, None], len(languages), axis=1)
    for _ in range(ROUNDS):
        expected = np.full((t.size, len(languages)), SMOOTH)
        for word in (w for w in counts if len(w) >= LONG):
            _expect_long(t, word, counts[word], P, expected)
        for group in by_length(w for w in counts if len(w) < LONG):
            weight = np.array([counts[w] for w in group])
            alpha, edges = forward(t, group, P)
            size = len(alpha) - 1
            beta = np.zeros_like(alpha)
            beta[size] = weight / (alpha[size] + 1e-300)
            for i in range(size - 1, -1, -1):
                for k in range(1, min(size - i, t.longest) + 1):
                    e = edges[k][:, i]
                    hit = np.flatnonzero(e >= 0) if k > 1 else np.arange(len(group))
                    if not len(hit):
                        continue
                    p = P[e[hit]] if k > 1 else np.where((e < 0)[:, None], UNKNOWN, P[e])
                    beta[i][hit] += p * beta[i + k][hit]
                    known = e[hit] >= 0
                    flow = (alpha[i][hit] * p * beta[i + k][hit])[known]
                    for g in range(len(languages)):
                        expected[:, g] += np.bincount(e[hit][known], weights=flow[:, g], minlength=t.size)
        P = expected / expected.sum(0)
    return languages, P


class Predictor:
    """Predicts texts with a trained model; keeps the scores of the short words it has met."""

    def __init__(self, languages: list[str], P: np.ndarray, path: str):
        self.languages, self.P, self.path = languages, P, path
        self.row: dict[str, int] = {}
        self.most = min(CACHE, CACHE_NUMBERS // max(len(languages), 1))
        self.scores = np.zeros((self.most, len(languages)))

    def _learn(self, words: list[str]) -> None:
        at = len(self.row)
        for group in by_length(words):
            alpha, _ = forward(table(self.path), group, self.P)
            self.scores[at : at + len(group)] = np.log(alpha[-1] + 1e-300)
            self.row.update(zip(group, range(at, at + len(group))))
            at += len(group)

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        docs = [split_words(t) for t in texts]
        if not self.languages:
            return [(UND, 0.0)] * len(docs)
        long = [[w for w in d if len(w) >= LONG] for d in docs]
        docs = [[w for w in d if len(w) < LONG] if x else d for d, x in zip(docs, long)]
        missing = list({w for d in docs for w in d if w not in self.row})
        if len(self.row) + len(missing) > len(self.scores):
            self.row.clear()
            missing = list({w for d in docs for w in d})
            self.scores = np.zeros((max(self.most, len(missing)), len(self.languages)))
        self._learn(missing)
        out = []
        for d, more in zip(docs, long):
            if not d and not more:
                out.append((UND, 0.0))
                continue
            x = self.scores[np.fromiter(map(self.row.__getitem__, d), np.int64, len(d))].sum(0)
            for w in more:
                x = x + long_word(table(self.path), w, self.P)
            k = int(np.argmax(x))
            out.append((self.languages[k], float(1 / np.exp(x - x[k]).sum())))
        return out


def fit(docs: DataFrame, path: str | None = None, most: int = SAMPLE):
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"))
    sample = labelled_sample(rows, id_and_text(docs), most, CHARS, even=True)
    return train([t for _, t, _ in sample], [x for _, _, x in sample], path or vocabulary_path(VOCABULARY))


def predict(docs: DataFrame, model, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    spark = docs.sparkSession
    ship(spark)
    path = path or vocabulary_path(VOCABULARY)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        predictor = Predictor(*held.value, path)
        for b in slices(batches):
            found = predictor(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a language (no letter, or no text) go; lang takes the prediction.

    Repeated rows and rows without an id are judged each for themselves; all other columns stay as they are; an empty table
    stays empty; when nothing is labelled lang stays as it is and only documents without a letter go.
    """
    ship(spark)
    path = vocabulary_path(VOCABULARY)
    held = spark.sparkContext.broadcast(fit(docs, path))
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        predictor = Predictor(*held.value, path)
        for b in slices(batches):
            texts = [t or "" for t in b.column(text_at).to_pylist()]
            keep = pa.array([letter_in(t) is not None for t in texts])
            if predictor.languages:
                langs = pa.array([x for x, _ in predictor(texts)], b.schema.field(lang_at).type)
                b = pa.RecordBatch.from_arrays([langs if i == lang_at else b.column(i) for i in range(b.num_columns)], schema=b.schema)
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema)
