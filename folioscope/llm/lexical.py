"""Ranked lexical search by bags of words: equal bags are found, verified, scored once and expanded.

1. Items come in blocks of bounded size; the terms of a block are its vocabulary. Every document is read
   whole and restricted to it: what stays is a bag (numbers of its terms and how often each occurs)
   and the number of all its terms. A term is found by a 64-bit hash and verified byte by byte.
2. The corpus gives the number of documents and terms, and in how many documents each term occurs. With
   these a document's score for any item depends on its bag and its length number ``m`` alone.
3. Documents of equal bag and ``m`` form a class: they are grouped by a hash of both, and the group's
   keys are the bag and ``m`` themselves, so that different bags never share a class. Every class
   is scored once, for all items, from the items' postings.
4. The best ``k`` classes of an item, ties to the least document, hold its best ``k`` documents, since
   each class ahead of another has a document ahead of it. Their members are looked up by the
   class and expanded by ascending id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.buffers import LOWER, chunks, prefix_hash, raw_bytes, span_hashes, split_sorted, word_spans
from folioscope.session import scratch_path

# Text of items whose vocabulary and postings are sent to every task.
BLOCK_BYTES = 8 << 20
# Scores and postings that a task holds at a time.
SCORES, POSTINGS = 1 << 21, 1 << 21
EXACT = 2.0**53
LATE = np.iinfo(np.int64).max

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BETWEEN = np.ones(256, bool)
for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    BETWEEN[first: last + 1] = False


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII; only A-Z become lower case."""
    return TERM.findall((text or "").encode().lower())


class Vocabulary:
    """The terms of some items, numbered, with the hashes by which they are found in a text."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.asarray([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        hashes = span_hashes(prefix_hash(data), ends - sizes, ends)
        order = np.argsort(hashes, kind="stable")
        if len(np.unique(hashes)) != len(words):
            raise ValueError("two terms of the items have one hash")
        self.words = [words[i] for i in order]
        self.data, self.hashes, self.sizes, self.starts = data, hashes[order], sizes[order], (ends - sizes)[order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``starts`` of the spans that are terms, and the terms' numbers."""
        hashes = span_hashes(prefix_hash(data), starts, ends)
        number = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero((self.hashes[number] == hashes) & (self.sizes[number] == (ends - starts)))
        number = number[at]
        sizes = self.sizes[number]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        differ = data[np.repeat(starts[at], sizes) + inside] != self.data[np.repeat(self.starts[number], sizes) + inside]
        if differ.any():
            wrong = np.unique(np.repeat(np.arange(len(at)), sizes)[differ])
            at, number = np.delete(at, wrong), np.delete(number, wrong)
        return at, number


def bags(docs: DataFrame, vocabulary: Vocabulary, text: str, key: str) -> DataFrame:
    """``doc, n, bag, digest``: all terms of each document counted, those of the vocabulary as numbers and counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in chunks(batches, "text"):
            data = LOWER[data]
            starts, ends, rows = word_spans(data, bounds, BETWEEN)
            at, number = vocabulary.find(data, starts, ends)
            found, times = np.unique(rows[at] * len(vocabulary.words) + number, return_counts=True)
            owner, number = np.divmod(found, len(vocabulary.words))
            edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            packed = [number[i:j].astype("<u4").tobytes() + times[i:j].astype("<u4").tobytes() for i, j in zip(edges, edges[1:])]
            n = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(packed, pa.binary())], names=["doc", "n", "bag"])

    read = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(scan, "doc long, n long, bag binary").where("n > 0")


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and count of every entry of packed bags."""
    data, bounds = raw_bytes(column)
    words = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
    half = np.diff(bounds) // 8
    row = np.repeat(np.arange(len(half)), half)
    at = np.arange(len(row)) + np.repeat(np.cumsum(half) - half, half)
    return row, words[at], words[at + half[row]]


def document_frequencies(stored: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(entries(batch.column(0))[1], minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["term", "n"])

    # One row per term of the vocabulary.
    counted = stored.select("bag").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return out


class Postings:
    """For every term the items that hold it and how often, and its weight."""

    def __init__(self, held: list[Counter], weights: np.ndarray):
        pairs = sorted((t, i, n) for i, found in enumerate(held) for t, n in found.items())
        self.items = np.asarray([p[1] for p in pairs], np.int64)
        self.times = np.asarray([p[2] for p in pairs], np.int64)
        self.count = np.bincount([p[0] for p in pairs], minlength=len(weights)).astype(np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.weights, self.n_items = weights, len(held)
        # A term gives less than a million times its weight; sums below 2**53 are exact in doubles.
        most = max((sum(n * int(weights[t]) for t, n in found.items()) for found in held), default=0) * 1_000_000
        self.exact = most < EXACT

    def scores(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores (bags by items) of the bags with these entries."""
        gain = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        out = np.zeros(len(m) * self.n_items, np.float64 if self.exact else np.int64)
        reach = np.cumsum(self.count[term])
        at = 0
        while at < len(term):
            stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + POSTINGS, side="right")))
            many = self.count[term[at:stop]]
            entry = np.repeat(np.arange(at, stop), many)
            posting = np.arange(len(entry)) + np.repeat(self.start[term[at:stop]] - (np.cumsum(many) - many), many)
            cell, value = row[entry] * self.n_items + self.items[posting], gain[entry] * self.times[posting]
            if self.exact:
                out += np.bincount(cell, value, len(out))
            else:
                np.add.at(out, cell, value)
            at = stop
        return out.reshape(len(m), self.n_items).astype(np.int64)


def best_classes(classes: DataFrame, postings: Postings, k: int) -> DataFrame:
    """``item, score, least, m, bag``: each task's ``k`` best classes (``least, m, bag``) of every item."""
    sent = classes.sparkSession.sparkContext.broadcast(postings)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        item = np.zeros(0, np.int64)
        value, least, m, bag = item, item, item, np.zeros(0, object)
        edge = np.zeros(own.n_items, np.int64)
        for batch in batches:
            step = max(1, SCORES // own.n_items)
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                first = rows.column(0).fill_null(LATE).to_numpy()
                number = rows.column(1).to_numpy()
                found = own.scores(*entries(rows.column(2)), number)
                floor = np.maximum(edge, 1)
                if len(found) > k:
                    floor = np.maximum(floor, np.partition(found, len(found) - k, axis=0)[len(found) - k])
                i, j = np.nonzero(found >= floor)
                item, value, least, m = np.r_[item, j], np.r_[value, found[i, j]], np.r_[least, first[i]], np.r_[m, number[i]]
                bag = np.r_[bag, np.asarray(rows.column(2).to_pylist(), object)[i]]
                order = np.lexsort((least, -value, item))
                begin, end = split_sorted(item[order])
                order = order[np.arange(len(order)) - np.repeat(begin, end - begin) < k]
                item, value, least, m, bag = item[order], value[order], least[order], m[order], bag[order]
                begin, end = split_sorted(item)
                full = end - begin >= k
                edge[item[begin[full]]] = value[end[full] - 1]
        kept = [pa.array(x) for x in (item.astype(np.int32), value, least, m)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(bag.tolist(), pa.binary())], names=["item", "score", "least", "m", "bag"])

    found = classes.select("least", "m", "bag").mapInArrow(score, "item int, score long, least long, m long, bag binary")
    # Tasks are reduced in groups first, so that no task reads the lists of all.
    order = [F.col("score").desc(), "least"]
    part = F.pmod(F.xxhash64("m", "bag"), F.lit(64))
    for by in (["item", "part"], ["item"]):
        found = found.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        found = found.where(F.col("place") <= k).drop("place", "part")
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` documents with the highest score above 0 for every item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. With N documents
    that hold a term, L terms in all and df documents holding a term, its weight is
    ``floor(1000 * ln((2N + 2) / (2df + 1)))``; a document of n terms has
    ``m = 25 + (75 * n * N) div L``; its score adds ``weight * ((10**9 * tf) div (1000 * tf + 8 * m))`` over
    the item's terms with repeats. Equal scores rank by ascending id, a null id last.

    Null and empty texts have no terms; an item without terms, or none of whose terms scores, gives no
    rows. Repeated documents are ranked each; an item row repeated as a whole counts once. Empty
    tables give no rows. Further columns are not read. Texts are read whole.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    schema = f"item_id {dict(asked.dtypes)['item_id']}, rank int, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        # Items of a bounded size in all; a block's number comes from the item, not from its place.
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        held = [(r.item_id, Counter(terms(r.text))) for r in rows]
        held = [h for h in held if h[1]]
        if held:
            out = out.unionByName(_search_block(docs, held, k, text, key, schema))
    return out


def _search_block(docs: DataFrame, held: list[tuple[object, Counter]], k: int, text: str, key: str, schema: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = Vocabulary(sorted({t for _, found in held for t in found}))
    number = {w: i for i, w in enumerate(vocabulary.words)}
    path = scratch_path(spark, "bags")
    bags(docs, vocabulary, text, key).write.parquet(path)
    stored = spark.read.parquet(path)
    size = stored.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    frequency = document_frequencies(stored, len(number))
    weights = np.asarray([math.floor(1000 * math.log((2 * size["n"] + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    postings = Postings([Counter({number[t]: n for t, n in found.items()}) for _, found in held], weights)
    bagged = stored.where(F.octet_length("bag") > 0).select("doc", F.expr(f"25 + (75L * n * {size['n']}L) div {size['l']}L").alias("m"), "bag")
    classes = bagged.groupBy("m", "bag").agg(F.min("doc").alias("least"))
    path = scratch_path(spark, "classes")
    best_classes(classes, postings, k).write.parquet(path)
    # At most k rows for each item of the block.
    best = spark.read.parquet(path)
    won = best.select(F.xxhash64("m", "bag").alias("class"), F.col("m").alias("__m"), F.col("bag").alias("__bag")).distinct()
    bagged = bagged.withColumn("class", F.xxhash64("m", "bag"))
    members = bagged.join(F.broadcast(won), "class").where("m = __m and bag = __bag").select("m", "bag", "doc")
    in_class = Window.partitionBy("m", "bag").orderBy(F.col("doc").asc_nulls_last())
    members = members.withColumn("place", F.row_number().over(in_class)).where(F.col("place") <= k).select("m", "bag", "doc")
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(held)], f"item int, {schema.split(',')[0]}")
    ranked = best.select("item", "score", "m", "bag").join(members, ["m", "bag"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())))
    return ranked.where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
