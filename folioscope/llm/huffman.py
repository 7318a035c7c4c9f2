"""Token ids as canonical, length-limited Huffman codes in independent blocks.

The file format is a folder with two Parquet tables. ``codes`` holds the code length of every id
that occurs; canonical codes follow from the lengths. ``blocks`` holds one row per block: number of
the first token in the whole corpus, the documents and their token counts, the bit stream, and the
bit offset of every ``STRIDE``-th token. A block is decoded without any other, and the checkpoints
let all its strides be decoded side by side through one table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.tokens import encoded
from folioscope.plans.joins import attach_lookup
from folioscope.session import scratch_path

MAX_BITS = 20
STRIDE = 128
BLOCK_TOKENS = 1 << 16
CACHED_TILES = 400_000

TOKENS = "part int, part_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, ids binary"
BLOCKS = "start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, stream binary, checkpoints binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(float)
    levels, current = [], leaves
    for _ in range(max_bits):
        order = np.argsort(current, kind="stable") if levels else np.arange(len(leaves))
        levels.append(order < len(leaves))
        merged = current[order]
        pairs = merged[: len(merged) // 2 * 2]
        current = np.r_[leaves, pairs[0::2] + pairs[1::2]]
    taken, found = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        found[:own] += 1
        taken = 2 * (taken - own)
    lengths[used] = found
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and the ids in code order (by length, then id)."""
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    sizes = lengths[order].astype(np.uint64)
    codes = np.zeros(len(lengths), np.uint64)
    ends = np.cumsum(np.uint64(1) << (np.uint64(MAX_BITS) - sizes))
    codes[order] = np.r_[np.uint64(0), ends[:-1]] >> (np.uint64(MAX_BITS) - sizes) if len(order) else codes[order]
    return codes, order


def write_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of the ids, and the bit offset of every ``STRIDE``-th one."""
    sizes = lengths[ids].astype(np.int64)
    place = np.cumsum(sizes) - sizes
    word, shift = place >> 5, place & 31
    wide = codes[ids] << (64 - shift - sizes).astype(np.uint64)
    out = np.zeros(int((sizes.sum() + 31) // 32) + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), place[::STRIDE]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``MAX_BITS`` bits: the id they begin with and its length."""
    _, order = canonical(lengths)
    sizes = lengths[order].astype(np.int64)
    repeats = np.int64(1) << (MAX_BITS - sizes)
    ids, bits = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    filled = int(repeats.sum())
    ids[:filled], bits[:filled] = np.repeat(order, repeats), np.repeat(sizes, repeats)
    return ids, bits


def read_bits(stream: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of a block; every stride is a lane and all lanes advance together."""
    ids, bits = table
    words = np.r_[np.frombuffer(stream, ">u4").astype(np.uint64), np.zeros(2 + STRIDE, np.uint64)]
    # The 64 bits from every word on.
    pairs = words[:-1] << np.uint64(32) | words[1:]
    place = checkpoints.astype(np.uint64)
    out = np.empty((min(STRIDE, n), len(place)), np.uint32)
    last, keep = np.uint64(len(pairs) - 1), np.uint64(64 - MAX_BITS)
    for step in range(len(out)):
        at = np.minimum(place >> np.uint64(5), last).view(np.int64)
        key = (pairs.take(at) << (place & np.uint64(31)) >> keep).view(np.int64)
        ids.take(key, out=out[step], mode="clip")
        place += bits.take(key)
    return out.T.ravel()[:n]


@lru_cache(maxsize=1)
def _table(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    return decode_table(np.frombuffer(lengths, np.uint8))


def _tokenized(docs: DataFrame, vocabulary: str, end_id: int, doc_id: str, text: str, added: bool) -> DataFrame:
    """Blocks of whole documents in ascending ``doc_id`` order, written once below the shared folder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        start, keys, sizes, held, total = 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            narrow = ids.astype("<u2") if ids.max() < 1 << 16 else ids
            values = [part], [start], [total], [keys], [sizes], [narrow.tobytes()]
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            names = [c.split()[0] for c in TOKENS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

        for key, ids in encoded(batches, vocabulary, end_id, added, CACHED_TILES):
            keys.append(key)
            sizes.append(len(ids) // 4)
            held.append(ids)
            total += sizes[-1]
            if total >= BLOCK_TOKENS:
                yield block()
                start, keys, sizes, held, total = start + total, [], [], [], 0
        if keys:
            yield block()

    path = scratch_path(docs.sparkSession, "token-ids")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = narrow.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(cut, TOKENS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(TOKENS).parquet(path)


def stored_ids(value: pa.BinaryScalar, n: int) -> np.ndarray:
    """The ids of a block of ``n`` tokens, kept in two bytes where all of them fit, else in four."""
    held = value.as_buffer()
    return np.frombuffer(held, "<u2" if held.size == 2 * n else "<u4")


def count_ids(tokens: DataFrame) -> DataFrame:
    """Occurrences of every id in the whole corpus; a task sends at most one row per id."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value, n in zip(batch.column(0), batch.column(1).to_pylist()):
                own = np.bincount(stored_ids(value, n))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return tokens.select("ids", "n_tokens").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode_corpus(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", added: bool = False) -> None:
    """Tokenize all documents, append ``end_id`` to each and write the file format to ``folder``.

    With ``added`` strings of special tokens become these tokens, else they are ordinary text.
    Null text counts as empty and is the end id alone. Documents lie in ascending ``doc_id`` order,
    a null id first; repeated ids are kept, ordered by a hash of their text. An empty table writes
    empty ``codes`` and ``blocks``. Other columns are ignored. The driver holds the counts of one
    vocabulary and nothing that grows with the documents.
    """
    spark = docs.sparkSession
    tokens = _tokenized(docs, vocabulary, end_id, doc_id, text, added)
    found = count_ids(tokens).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    rows = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(rows, "id long, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    codes, _ = canonical(lengths)
    shared = spark.sparkContext.broadcast((codes, lengths))
    schema = BLOCKS.replace("start long", "part int, part_start long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                stream, places = write_bits(stored_ids(batch.column(5)[i], batch.column(2)[i].as_py()), codes, lengths)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([
                    row.column(0), row.column(1), row.column(2), row.column(3), row.column(4),
                    pa.array([stream], pa.binary()), pa.array([places.astype("<u8").tobytes()], pa.binary()),
                ], names=[c.split()[0] for c in schema.split(", ")])

    sizes = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toPandas()
    firsts = list(zip(sizes["part"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist()))
    # One row per task of the sort, whatever the number of documents.
    placed = spark.createDataFrame(firsts, "part int, first long")
    packed = attach_lookup(tokens.mapInArrow(pack, schema), placed, ["part"])
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    packed.withColumn("start", F.col("first") + F.col("part_start")).select(names).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def decode_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids, ids_crc32``, ids as 32-bit integers."""
    rows = spark.read.schema("id long, bits int").parquet(f"{folder}/codes").toPandas()
    lengths = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.uint8)
    lengths[rows["id"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(lengths.tobytes())

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                start, n, keys, sizes, stream, places = (batch.column(c)[row] for c in range(6))
                n = n.as_py()
                ids = read_bits(stream.as_buffer(), np.frombuffer(places.as_buffer(), "<u8"), n, table).astype("<u4")
                sizes = np.asarray(sizes.values, np.int64)
                ends = np.cumsum(sizes)
                pieces = [ids[e - s: e].tobytes() for s, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays([
                    keys.values, pa.array(start.as_py() + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(pieces, pa.binary()), pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
