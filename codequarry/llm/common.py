"""Helpers shared by the training-data operators: tasks' batches, shared storage, shipping.

Conventions that hold for every operator of this package:

* An operator reads only the columns it names, so extra columns (also ones whose
  names clash with result columns) never reach it and are not returned.
* A null text counts as the empty text. Null ids are kept as they are.
* Map-like operators return one row per input row, repeated rows included.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, shared_dir  # noqa: F401 - the operators take them from here


#: Bytes of one Arrow batch between the JVM and a Python worker; rows alone don't bound it, as texts may be long.
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session (they may not share the driver's path).

    Also bounds the bytes of Arrow batches.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(sc, "_codequarry_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="codequarry-"), "codequarry_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._codequarry_shipped = True


def text_of(column: str | Column = "text") -> Column:
    """The text column, null as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text ('' for null) of ``docs``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``most`` bytes of ``column`` (one row at least).

    Rows are never split or dropped; a single text longer than ``most`` is a slice of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
        step = max(1, int(n * most / size)) if size > most else n
        for at in range(0, n, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()  # a worker lives on after its task


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 5; fold 0 is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def crc_unsigned(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def labelled_sample(rows: DataFrame, text: DataFrame, most: int, chars: int, even: bool = False) -> list:
    """At most ``most`` labelled rows (doc_id, label) of the training folds, with their whole texts.

    The rows are those with the smallest hashes of their ids: the same at every run and for
    every partitioning, and spread evenly. With ``even`` each label gets an equal share of ``most`` (so that a rare one
    is learned too), else labels come as often as they are. Only ids, labels and sizes are ordered; the texts come
    by a join with these at most ``most`` ids. No text is cut: in the order of their hashes, rows are taken as long as the
    texts hold at most ``chars`` characters together, which bounds the driver's memory; a row that
    would go beyond is passed over.
    """
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold() != 0)).withColumn("order", F.xxhash64("doc_id"))
    spark = text.sparkSession
    if even:
        # the commonest `most` labels at most; a cut by the hash leaves a bounded number of ids of each, with room to spare
        counts = cut(rows.groupBy("label").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "label").limit(most), "labels")
        each = max(1, most // max(1, counts.count()))
        rows = rows.withColumn("order", F.pmod(F.col("order"), F.lit(1 << 30)))
        near = rows.join(F.broadcast(counts), "label").where(F.col("order") / float(1 << 30) * F.col("rows") <= 2 * each + 50)
        chosen, seen = [], Counter()
        for r in sorted(near.select("doc_id", "label", "order").collect(), key=lambda r: (r["order"], r.doc_id, str(r.label))):
            seen[r.label] += 1
            if seen[r.label] <= each:
                chosen.append(r)
    else:
        chosen = rows.orderBy("order", "doc_id", "label").limit(most).select("doc_id", "label", "order").collect()
    if not chosen:
        return []
    kind = rows.schema["label"].dataType.simpleString()
    few = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], f"doc_id long, label {kind}, order long"))
    sized = text.join(few, "doc_id").select("doc_id", "label", "order", F.length("text").alias("size")).collect()
    left, kept = chars, []
    for r in sorted(sized, key=lambda r: (r["order"], r.doc_id, str(r.label), r["size"])):
        if r["size"] <= left:
            left -= r["size"]
            kept.append((r.doc_id, r.label, r["size"]))
    few = F.broadcast(spark.createDataFrame(kept, f"doc_id long, label {kind}, size int").distinct())
    found = text.withColumn("size", F.length("text")).join(few, ["doc_id", "size"]).select("doc_id", "text", "label").collect()
    return sorted(((r.doc_id, r.text, r.label) for r in found), key=lambda r: (r[0], r[1]))
