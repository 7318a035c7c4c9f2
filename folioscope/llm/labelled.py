"""Bounded, class-balanced samples of labelled documents, and the split into learning and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts with their label, at most ``per_class`` of each, and the number of learning rows per label.

    Rows are chosen by a hash of their id among those that are not held out, whose label is 0 or 1
    and whose text has at most ``max_bytes`` bytes. The driver receives at most
    ``2 * per_class * max_bytes`` bytes.
    """
    known = labels.where(~held_out() & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= max_bytes)
    fitting = texts.select("doc_id").join(known, "doc_id")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = [fitting.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    chosen = {(r.doc_id, r.y) for df in picked for r in df.collect()}
    if not chosen:
        return [], counts
    # At most two rows per class member; ids are few by the limit above.
    ids = docs.sparkSession.createDataFrame(sorted(chosen), "doc_id long, y int")
    rows = texts.join(F.broadcast(ids), "doc_id").orderBy(*order, "y", "text").limit(2 * per_class).collect()
    return [(r.text, r.y) for r in rows], counts
