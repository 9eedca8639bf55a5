"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams (3 to 5 letters of ``<word>``)
and of itself, all hashed into ``BUCKETS`` vectors, so a misspelling shares most of its vectors
with the word it stands for. A passage of ``PASSAGE`` words is the average of its different words
and goes into a softmax of two classes. A document is as toxic as its most toxic passage, which
keeps a few words visible in a very long text. In training every passage takes its document's label
at first; later only the passages that look like their document's most toxic one keep it.

The model learns from at most ``SAMPLE`` labelled documents of the training folds, whole texts of at most ``CHARS``
characters together (see ``labelled_sample``). Labels, language,
source and id are never inputs of a score.

Defined cases: null or empty texts and texts without words get the score of an empty passage
(the model's bias); without labels of both classes every score is 0; repeated rows give repeated
results; a null doc_id belongs to the held-out fold.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_and_text, labelled_sample, ship, slices

SAMPLE, CHARS = 3_000, 12_000_000
BUCKETS, SIZE, PASSAGE, LEAST = 1 << 17, 4, 24, 8
EPOCHS, SETTLE, RATE, RIDGE, PRIOR, SEED = 91, 30, 0.3, 0.1, 10.0, 7
CACHE = 400_000

words_of = re.compile(r"[^\W_]+").findall


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' subwords, one after the other, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(start + sizes, sizes) - np.arange(len(codes))  # letters from here to the word's end
    mult = np.uint64(0x100000001B3)
    h = np.full(len(codes), 0xCBF29CE484222325, dtype=np.uint64)
    ids, of = [], []
    for n in range(1, min(5, len(codes)) + 1):
        h[: len(codes) - n + 1] = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * mult
        if n >= 3:
            whole = left >= n
            ids.append(h[whole] ^ (h[whole] >> np.uint64(29)))
            of.append(owner[whole])
    # the word itself: a sum over its letters' place-dependent hashes
    place = (np.arange(len(codes)) - np.repeat(start, sizes)).astype(np.uint64)
    letter = (codes + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    letter ^= letter >> np.uint64(32)
    own = np.add.reduceat(letter * mult, start) if len(words) else np.empty(0, np.uint64)
    ids.append(own ^ (own >> np.uint64(31)))
    of.append(np.arange(len(words)))
    ids, of = np.concatenate(ids), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (ids[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(of, minlength=len(words))


def _bounds(n: int) -> np.ndarray:
    return np.arange(0, max(n, 1), PASSAGE)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(slope, offset, loss) of the logistic curve through documents' top passages, by Newton steps."""
    a = np.array([1.0, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * (a - [1.0, 0.0]))
        a = a + np.clip(step, -2, 2)
    p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
    return float(max(a[0], 0.0)), float(a[1]), float(-np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-9)))


class Bags:
    """The passages of documents as bags of words, and words as bags of subword buckets; sums and gradients over them.

    Documents of ``watch`` only choose and calibrate the model; the others' words are the vocabulary.
    """

    def __init__(self, docs: list[list[str]], watch: np.ndarray):
        vocabulary = dict.fromkeys(w for d, v in zip(docs, watch) if not v for w in d)
        everything = list({**vocabulary, **dict.fromkeys(w for d, v in zip(docs, watch) if v for w in d)})
        number = {w: i for i, w in enumerate(everything)}  # the vocabulary's words come first
        self.mine, self.words = len(vocabulary), len(everything)
        if not self.mine:
            return
        ids, self.counts = subwords(everything)
        self.first = np.cumsum(self.counts) - self.counts
        self.used, self.local = np.unique(ids, return_inverse=True)
        self.inside = int(self.counts[: self.mine].sum())
        word, passage, of_doc, length = [], [], [], []
        for d, ws in enumerate(docs):
            for at in _bounds(len(ws)):
                different = set(ws[at : at + PASSAGE])
                own = sorted(number[w] for w in different if watch[d] or w in vocabulary)
                word += own
                passage += [len(of_doc)] * len(own)
                of_doc.append(d)
                length.append(max(LEAST, len(different)))
        self.word, self.passage, self.of_doc = np.array(word, np.int64), np.array(passage, np.int64), np.array(of_doc, np.int64)
        self.scale = PASSAGE / np.array(length)
        self.learn = ~watch[self.of_doc]
        # a bucket moves by its gradient over (how often it was seen + PRIOR): what is rare stays near zero
        seen, own = np.bincount(self.word[self.learn[self.passage]], minlength=self.words)[: self.mine], self.counts[: self.mine]
        self.curve = np.bincount(self.local[: self.inside], weights=np.repeat(seen / own**2, own), minlength=len(self.used)) + PRIOR

    @staticmethod
    def _sum(index: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(index, weights=weights[:, k], minlength=size) for k in range(weights.shape[1])], axis=1)

    def forward(self, E: np.ndarray, W: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(averaged embedding, logit of the toxic class) of every passage."""
        V = np.add.reduceat(E[self.local], self.first, axis=0) / self.counts[:, None]
        X = self._sum(self.passage, V[self.word], len(self.of_doc)) * self.scale[:, None]
        return X, X @ (W[:, 1] - W[:, 0]) + b[1] - b[0]

    def gradients(self, E: np.ndarray, W: np.ndarray, X: np.ndarray, z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, gradients of E, W and b) of the cross entropy over the learned passages plus RIDGE / 2 of the squares of E."""
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        d1 = np.where(self.learn, p - target, 0.0)
        g = np.stack([-d1, d1], axis=1)
        gX = (g @ W.T) * self.scale[:, None]
        own = self.counts[: self.mine]
        gV = self._sum(self.word, gX[self.passage], self.words)[: self.mine] / own[:, None]
        gE = self._sum(self.local[: self.inside], np.repeat(gV, own, axis=0), len(self.used)) + RIDGE * E
        return p, gE, X[self.learn].T @ g[self.learn], g.sum(0)


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias): what a softmax over averaged embeddings adds up to.

    The logit is linear in the averaged vectors, so after training each bucket's vector
    and the two class vectors fold into one number for each bucket. Every fourth document only
    chooses the number of epochs and sets the slope and bias by which a document's top passage is read.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), -np.inf
    docs = [words_of(t.lower()) for t in texts]
    watch = np.arange(len(docs)) % 4 == 3
    if y[watch].sum() < 4 or y[~watch].sum() < 4:
        watch = np.zeros(len(docs), dtype=bool)
    bags = Bags(docs, watch)
    if not bags.mine:
        return np.zeros(BUCKETS, np.float32), float(np.log(y.mean() / (1 - y.mean())))
    of_doc, learn = bags.of_doc, bags.learn
    target, n = y[of_doc], int(learn.sum())  # each passage takes its document's label
    begin = np.searchsorted(of_doc, np.arange(len(docs)))
    rng = np.random.default_rng(SEED)
    E, W = rng.normal(0, 1e-3, (len(bags.used), SIZE)), np.linspace(-0.5, 0.5, 2 * SIZE).reshape(2, SIZE).T * [-1, 1]
    b = np.array([0.0, np.log(target[learn].mean() / (1 - target[learn].mean()))])
    speed, best = np.zeros_like(E), None
    for epoch in range(1, EPOCHS + 1):
        X, z = bags.forward(E, W, b)
        if epoch % 10 == 1 and epoch > 1:
            top = np.maximum.reduceat(z, begin)
            held = watch if watch.any() else ~watch
            slope, offset, loss = _calibrate(top[held], y[held])
            if best is None or loss < best[0]:
                best = (loss, slope, slope * float(b[1] - b[0]) + offset, E @ (W[:, 1] - W[:, 0]))
        if epoch >= SETTLE and epoch % 10 == 0:
            # of a toxic document only the passages that look like its most toxic one keep the label
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            target = y[of_doc] * (p >= 0.5 * np.maximum.reduceat(p, begin)[of_doc])
        p, gE, gW, gb = bags.gradients(E, W, X, z, target)
        speed = 0.8 * speed - RATE * gE / bags.curve[:, None]
        E = E + speed
        W = W - RATE * gW / n
        b = b - np.clip(gb / (np.where(learn, p * (1 - p), 0.0).sum() + 1.0), -0.2, 0.2) / 2
    _, slope, bias, share = best
    out = np.zeros(BUCKETS, np.float32)
    out[bags.used] = slope * PASSAGE * share
    return out, bias


class Scorer:
    """Scores texts with a trained model; keeps the shares of words it has met (at most ``CACHE``)."""

    def __init__(self, share: np.ndarray, bias: float):
        self.share, self.bias, self.known = share, bias, {}

    def __call__(self, texts: list[str]) -> list[float]:
        docs = [words_of(t.lower()) for t in texts]
        missing = list({w for d in docs for w in d if w not in self.known})
        if len(self.known) + len(missing) > CACHE:
            self.known.clear()
            missing = list({w for d in docs for w in d})
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            ids, counts = subwords(some)
            lean = np.add.reduceat(self.share[ids].astype(np.float64), np.cumsum(counts) - counts) / counts
            self.known.update(zip(some, lean.tolist()))
        get, out = self.known.__getitem__, []
        for d in docs:
            z = -np.inf if d else 0.0
            for at in range(0, len(d), PASSAGE):
                different = set(d[at : at + PASSAGE])
                z = max(z, math.fsum(map(get, different)) / max(len(different), LEAST))
            out.append(float(1 / (1 + math.exp(-min(max(z + self.bias, -500.0), 500.0)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, float]:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    sample = labelled_sample(rows, id_and_text(docs), most, CHARS)
    return train([t for _, t, _ in sample], [int(x > 0) for _, _, x in sample])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(*held.value)
        for b in slices(batches):
            s = scorer(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
