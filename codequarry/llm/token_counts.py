"""Token counts by a two-tier lookup on the map side.

A text is cut at its spaces into chunks, each with the space before it; where spaces are
single and touch no other white space these are unions of whole pre-tokens. Tier one is a
broadcast table of frequent chunks and their token counts: those that make up at least one in ``FREQUENT`` of all
chunks of all texts (so there are at most ``FREQUENT``; the table only saves time, its content never changes a count).
Tier two is a cache in each worker that is filled by encoding misses and that starts anew
at ``CACHE`` entries; keys have at most ``KEY`` characters, longer chunks are encoded whenever they come. Only the chunks' counts are shuffled, combined in the tasks before.

Counts equal the library's: texts with other spacing, or with a special token's string
(which the library recognises before it splits), go to the library as they are.

Defined cases: null counts as empty, an empty text has 0 tokens, repeated rows give
repeated results, texts are never truncated.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, forget
from .common import id_and_text, ship, slices

LIMIT = 1024
FREQUENT, CACHE, KEY = 32_768, 400_000, 64
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def byte_letters() -> dict[int, str]:
    """Byte-level spelling of the Latin letters (and the space) below U+0250, for ``str.translate``.

    The public byte-level alphabet shows printable bytes as themselves and moves the others,
    in order, to U+0100 onwards.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - shown))}
    return {c: "".join(chr(moved.get(b, b)) for b in chr(c).encode()) for c in range(0x250)}


#: Spaces that touch white space or an end, where splitting at spaces could change pre-tokens.
_UNEVEN = re.compile(r"  | [\s]|\s |\A\s|\s\Z")
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Text of Latin letters and printable ASCII only, and the vocabulary's public pattern for such text.
_LATIN = re.compile(f"[ -~\\n{_L}]*").fullmatch
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+").findall

_caches: dict[str, dict[str, int]] = {}


def chunk_length(path: str, chunk: str, cache: dict[str, int]) -> int:
    """Tokens of one space-delimited chunk: Latin text by its pre-tokens, the rest by the library's whole route."""
    t = _tokenizer(path)
    if not _LATIN(chunk):
        return len(t.encode(chunk, add_special_tokens=False).ids)
    n = 0
    for piece in _PIECES(chunk):
        k = cache.get(piece)
        if k is None:
            k = len(t.model.tokenize(piece.translate(byte_letters())))
            if len(piece) <= KEY:
                cache[piece] = k
        n += k
    return n


def chunks(text: str) -> list[str]:
    """Space-delimited chunks, each but the first with the space before it."""
    parts = text.split(" ")
    return [parts[0], *map(" ".__add__, parts[1:])]


def count_tokens(texts: list[str], path: str, frequent: dict[str, int]) -> list[int]:
    """The number of tokens of each text."""
    cache = _caches.setdefault(path, {})
    special = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    out = []
    for t in texts:
        if _UNEVEN.search(t) or any(s in t for s in special):
            out.append(len(_tokenizer(path).encode(t, add_special_tokens=False).ids))
            continue
        n = 0
        for c in chunks(t) if t else ():
            k = frequent.get(c) or cache.get(c)
            if k is None:
                if len(cache) >= CACHE:
                    cache.clear()
                k = chunk_length(path, c, cache)
                if len(c) <= KEY:
                    cache[c] = k
            n += k
        out.append(n)
    return out


def _chunk_counts(batches):
    """(chunk, n) of rows (doc_id, text): how often chunks of at most ``KEY`` characters occur, in parts of about ``CACHE`` different ones."""
    own: Counter = Counter()

    def part():
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["chunk", "n"])

    for b in slices(batches):
        for t in b.column(1).to_pylist():
            own.update([c for c in chunks(t) if 0 < len(c) <= KEY])
        if len(own) >= CACHE:
            yield part()
            own.clear()
    yield part()


def frequent_table(docs: DataFrame, path: str) -> dict[str, int]:
    """Chunks that are at least one in ``FREQUENT`` of those of all rows (doc_id, text) and occur more than once, with their token counts."""
    counts = docs.mapInArrow(_chunk_counts, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = cut(counts, "chunk_counts")
    every = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where((F.col("n") > 1) & (F.col("n") * FREQUENT >= every)).select("chunk").collect()
    forget(counts)
    own: dict[str, int] = {}
    return {r.chunk: chunk_length(path, r.chunk, own) for r in common}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    spark = docs.sparkSession
    ship(spark)
    path = path or vocabulary_path(VOCABULARY)
    texts = id_and_text(docs, id_col, text_col)
    frequent = spark.sparkContext.broadcast(frequent_table(texts, path))

    def run(batches):
        for b in slices(batches):
            rows = b.column(1).to_pylist()
            n = count_tokens(rows, path, frequent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8")) for t in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
