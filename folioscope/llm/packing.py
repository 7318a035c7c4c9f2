"""Packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are the binary digits of its token count (as many
full windows as fit, then descending powers of two). Every piece is a sequence of its own, and the
sequences of one length form a bucket, so no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.tokens import encoded
from folioscope.plans.joins import attach_lookup
from folioscope.session import scratch_path

BATCH_PIECES = 2000
SCHEMA = ("doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
          "bucket int, part int, place long")


def piece_lengths(n: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the binary digits of the rest, largest first."""
    full, rest = divmod(n, longest)
    digits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [longest] * full + digits


def pack(docs: DataFrame, vocabulary: str, longest: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, ids_crc32, doc_tokens, bucket, sequence_id, offset``.

    ``longest`` is a power of two. ``bucket`` is the base-2 logarithm of the length; sequence
    numbers have no gaps and ascend bucket by bucket. With ``added`` strings of special tokens become
    these tokens, else they are ordinary text. Null text counts as empty and gives the end
    id alone; a null ``doc_id`` stays null; repeated rows are packed each for itself; an empty table
    gives no rows; other columns are ignored. A text of any length is one document. Pieces are
    written once to the shared folder, so numbers stay the same when a lost task runs again.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        counts, out = {}, []

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for key, ids in encoded(batches, vocabulary, end_id, added):
            total, start = len(ids) // 4, 0
            for n in piece_lengths(total, longest):
                piece, bucket = ids[4 * start: 4 * (start + n)], n.bit_length() - 1
                place = counts[bucket] = counts.get(bucket, -1) + 1
                out.append((key, start, n, piece, zlib.crc32(piece), total, bucket, part, place))
                start += n
            if len(out) >= BATCH_PIECES:
                yield rows()
                out = []
        if out:
            yield rows()

    path = scratch_path(docs.sparkSession, "pieces")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    narrow.mapInArrow(cut, SCHEMA).write.option("compression", "zstd").parquet(path)
    pieces = docs.sparkSession.read.schema(SCHEMA).parquet(path)
    sizes = pieces.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per bucket, of which there are log2(longest) + 1.
    base = buckets.select("bucket", F.coalesce(F.sum("n").over(before.orderBy("bucket")), F.lit(0)).alias("base"))
    inside = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    firsts = inside.join(F.broadcast(base), "bucket").select("bucket", "part", (F.col("base") + F.col("inside")).alias("first"))
    numbered = attach_lookup(pieces, firsts, ["bucket", "part"])
    return numbered.select(
        "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "bucket",
        (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
