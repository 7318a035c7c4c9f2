"""Similarity join on word shingles by T-occurrence search with DivideSkip, and its components.

1. Lengths of all inverted lists are counted exactly. Shingle hashes travel packed in binary, by
   hash range; back comes, per document, how many of its shingles occur anywhere else. A link needs
   that share to reach the threshold, so all other documents are settled (no pair is formed).
2. Documents with the same shingle set are one node from here on.
3. Nodes that share a shingle of their prefix (their rarest shingles, one more than a linked set
   may lack) can link. Every inverted list of prefixes names its smallest node as its head, and the
   nodes of all lists with one head form a ball; two nodes of a list are in its head's ball
   together. A ball is compared in blocks of bounded size. Every link is found once: it counts in
   the ball of the smallest shingle that both prefixes share. No pair leaves a task: what does is
   the number of links of each node, and at most one link per node for the components.
4. Comparing runs T-occurrence search over the inverted lists of a block's whole sets: a query's
   short lists are merged by counting, the long ones are probed by binary search for the nodes
   that can still reach the required overlap, and those reaching it link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.buffers import LOWER, addressed, chunks, mixed, prefix_hash, span_hashes, window_hashes, within_rows, word_spans
from folioscope.llm.graph import components
from folioscope.plans.joins import attach_lookup
from folioscope.session import scratch_path

# Shingles that one task of the list counting sorts at a time.
RANGE_SHINGLES = 2_000_000
# Nodes of one block of a ball, and about how many shingles they have.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
# DivideSkip's weight of a probe against a step of the merge, which counts whole arrays.
MU = 1.0


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by both.

    A text of fewer than ``size`` words has one shingle, the whole sequence; without words none.
    """
    starts, ends, rows = word_spans(data, bounds)
    words = span_hashes(prefix_hash(LOWER[data]), starts, ends)
    counts = np.bincount(rows, minlength=len(bounds) - 1)
    inside = np.flatnonzero(within_rows(rows, size))
    found_rows, found = [rows[inside]], [window_hashes(words, size)[inside]]
    for n in range(1, size):
        at = np.flatnonzero(within_rows(rows, n))
        at = at[counts[rows[at]] == n]
        found_rows.append(rows[at])
        found.append(window_hashes(words, n)[at])
    all_rows, hashes = np.concatenate(found_rows), np.concatenate(found)
    order = np.lexsort((hashes, all_rows))
    all_rows, hashes = all_rows[order], hashes[order]
    fresh = np.r_[True, (all_rows[1:] != all_rows[:-1]) | (hashes[1:] != hashes[:-1])][: len(hashes)]
    return all_rows[fresh], hashes[fresh]


def _digests(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit digests of each row's set."""
    counts = np.bincount(rows, minlength=n)
    at = np.r_[0, np.cumsum(counts)]
    with np.errstate(over="ignore"):
        a = np.r_[np.uint64(0), np.cumsum(mixed(hashes))]
        b = np.r_[np.uint64(0), np.cumsum(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))]
        return counts, (a[at[1:]] - a[at[:-1]]).view(np.int64), (b[at[1:]] - b[at[:-1]]).view(np.int64)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, key, text``; the key names a row by its id and text."""
    own, body = F.col(doc_id).cast("long"), F.col(text).cast("string")
    return docs.select(own.alias("doc_id"), F.xxhash64(own, body).alias("key"), body.alias("text"))


def node_id(a: str, b: str) -> Column:
    return F.concat(F.hex(a), F.lit("-"), F.hex(b))


def summarize(rows: DataFrame, size: int) -> DataFrame:
    """``doc_id, key, n_shingles, node`` of every document, written once to the shared folder."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in chunks(batches, "text"):
            counts, a, b = _digests(*shingle_sets(data, bounds, size), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(a), pa.array(b)],
                names=["doc_id", "key", "n_shingles", "a", "b"])

    path = scratch_path(rows.sparkSession, "shingle-sizes")
    rows.mapInArrow(measure, "doc_id long, key long, n_shingles long, a long, b long").select(
        "doc_id", "key", "n_shingles", node_id("a", "b").alias("node")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def shared_counts(rows: DataFrame, size: int, ranges: int) -> DataFrame:
    """``key, shared``: how many shingles of each document occur in another one.

    Hashes are cut to 32 bits within a range, so a count may be a little too high, never too low.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in chunks(batches, "text"):
            docs, hashes = shingle_sets(data, bounds, size)
            target = ((hashes >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(target, kind="stable")
            target, docs, low = target[order], docs[order].astype("<u4"), hashes[order].astype("<u4")
            at = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])[: len(target)]
            stop = np.r_[at[1:], len(target)]
            keys = np.asarray(batch.column(1), dtype=np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(target[at]), pa.array([keys] * len(at), pa.binary()),
                pa.array([docs[i:j].tobytes() for i, j in zip(at, stop)], pa.binary()),
                pa.array([low[i:j].tobytes() for i, j in zip(at, stop)], pa.binary()),
            ], names=["part", "keys", "docs", "low"])

    def count(group: pa.Table) -> pa.Table:
        own = [np.frombuffer(k.as_buffer(), np.int64)[np.frombuffer(d.as_buffer(), "<u4")] for k, d in zip(group["keys"], group["docs"])]
        keys, low = np.concatenate(own), np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in group["low"]])
        order = np.argsort(low, kind="stable")
        found = low[order]
        same = found[1:] == found[:-1]
        hit = np.r_[False, same] | np.r_[same, False]
        docs, n = np.unique(keys[order][hit[: len(found)]], return_counts=True)
        posts = addressed(docs, ranges, n.astype("<i8"))
        return pa.table({"to": pa.array([x[0] for x in posts], pa.int32()), **{c: pa.array([x[i] for x in posts], pa.binary()) for i, c in ((1, "keys"), (2, "n"))}})

    def total(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group["keys"]])
        n = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in group["n"]])
        keys, which = np.unique(keys, return_inverse=True)
        return pa.table({"key": pa.array(keys, pa.int64()), "shared": pa.array(np.bincount(which, n).astype(np.int64))})

    packed = rows.select("doc_id", "key", "text").mapInArrow(scatter, "part int, keys binary, docs binary, low binary")
    return packed.groupBy("part").applyInArrow(count, "to int, keys binary, n binary").groupBy("to").applyInArrow(total, "key long, shared long")


def stored_sets(rows: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """``node, n, shingles, a, b`` of the chosen nodes (``key, node``), written once; a and b make up the node's name."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in chunks(batches, "text"):
            docs, hashes = shingle_sets(data, bounds, size)
            counts, a, b = _digests(docs, hashes, batch.num_rows)
            at = np.r_[0, np.cumsum(counts)]
            sets = [hashes[i:j].astype("<u8").tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), batch.column(1), pa.array(counts, pa.int64()), pa.array(sets, pa.binary())],
                names=["a", "b", "wanted", "n", "shingles"])

    path = scratch_path(rows.sparkSession, "shingle-sets")
    # Counted first: few nodes go to the texts, many are joined by a shuffle.
    texts = attach_lookup(rows.select("key", "text"), chosen.select("key", F.col("node").alias("wanted")), ["key"], "inner").select("key", "wanted", "text")
    found = texts.mapInArrow(shingle, "a long, b long, wanted string, n long, shingles binary").withColumn("node", node_id("a", "b"))
    # Rows repeated with id and text give the same node again.
    found.where("node = wanted").select("node", "n", "shingles", "a", "b").dropDuplicates(["node"]).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def prefixes(sets: DataFrame, percent: int, ranges: int) -> DataFrame:
    """``node, n, own, prefix``: the rarest shingles of each set, one more than may be missing.

    ``own`` counts the shingles that no other node holds; they are part of the prefix but not listed.

    The order is by the exact number of nodes that hold a shingle. Shingles of one node alone come
    first and can't lead to another node, so they only use up places; a node with enough of them is
    settled. Hashes travel packed by range, as for the list lengths.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                values = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column(1)]
                nodes, hashes = np.repeat(np.arange(len(values)), [len(v) for v in values]), np.concatenate(values)
                target = ((hashes >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
                order = np.argsort(target, kind="stable")
                target, nodes, hashes = target[order], nodes[order], hashes[order]
                first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])[: len(target)]
                stop = np.r_[first[1:], len(target)].astype(np.int64)[: len(first)]
                ids, names, which = np.stack([np.asarray(rows.column(c), dtype=np.int64) for c in (2, 3)], 1), [], []
                for i, j in zip(first, stop):
                    present, own = np.unique(nodes[i:j], return_inverse=True)
                    names.append(ids[present].astype("<i8").tobytes())
                    which.append(own.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(target[first]), pa.array(names, pa.binary()), pa.array(which, pa.binary()),
                    pa.array([hashes[i:j].astype("<u8").tobytes() for i, j in zip(first, stop)], pa.binary())],
                    names=["part", "nodes", "which", "hashes"])

    def count(group: pa.Table) -> pa.Table:
        names = np.concatenate([np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2)[np.frombuffer(w.as_buffer(), "<u4")] for x, w in zip(group["nodes"], group["which"])])
        hashes = np.concatenate([np.frombuffer(h.as_buffer(), "<u8") for h in group["hashes"]])
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        times = times[which]
        kept = times > 1
        names, hashes, times = names[kept], hashes[kept], times[kept]
        posts = addressed(np.ascontiguousarray(names[:, 0]), ranges, np.ascontiguousarray(names[:, 1]), hashes, times.astype("<u4"))
        return pa.table({"to": pa.array([x[0] for x in posts], pa.int32()), **{c: pa.array([x[i] for x in posts], pa.binary()) for i, c in enumerate(("a", "b", "hashes", "times"), 1)}})

    def gather(group: pa.Table) -> pa.Table:
        a, b, hashes, times = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group[c]]) for c, kind in (("a", "<i8"), ("b", "<i8"), ("hashes", "<u8"), ("times", "<u4")))
        order = np.lexsort((hashes, times, b, a))
        a, b, hashes, times = a[order], b[order], hashes[order], times[order]
        cut = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        first = np.flatnonzero(cut)
        stop = np.r_[first[1:], len(a)].astype(np.int64)[: len(first)]
        # Rarest first.
        return pa.table({"a": pa.array(a[first]), "b": pa.array(b[first]), "hashes": pa.array([hashes[i:j].tobytes() for i, j in zip(first, stop)], pa.binary())})

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, n, hashes in zip(*(batch.column(c).to_pylist() for c in range(3))):
                hashes = np.frombuffer(hashes, "<i8")
                own = n - len(hashes)
                places = n - -(-percent * n // 100) + 1 - own
                if places > 0:
                    out.append((node, n, own, hashes[:places]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["node", "n", "own", "prefix"])

    packed = sets.select("node", "shingles", "a", "b").mapInArrow(scatter, "part int, nodes binary, which binary, hashes binary")
    replies = packed.groupBy("part").applyInArrow(count, "to int, a binary, b binary, hashes binary, times binary")
    gathered = replies.groupBy("to").applyInArrow(gather, "a long, b long, hashes binary").select(node_id("a", "b").alias("node"), "hashes")
    return gathered.join(sets.select("node", "n"), "node").select("node", "n", "hashes").mapInArrow(take, "node string, n long, own long, prefix array<bigint>")


class Lists:
    """Inverted lists of some sets: the sets that hold each token, in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.n, sizes = len(sets), [len(x) for x in sets]
        owner = np.repeat(np.arange(self.n), sizes)
        _, which = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True)
        self.own = np.split(which, np.cumsum(sizes)[:-1])
        self.keys = np.sort(which * self.n + owner)
        self.sizes = np.bincount(which)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def members(self, tokens: np.ndarray) -> np.ndarray:
        """The lists of the tokens, one after another."""
        sizes = self.sizes[tokens]
        at = np.repeat(self.starts[tokens] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.keys[at] % self.n

    def reach(self, query: int, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets that share as many tokens with the query as ``needed``, and their overlaps (DivideSkip)."""
        tokens = self.own[query]
        tokens = tokens[np.argsort(-self.sizes[tokens], kind="stable")]
        least = max(1, int(needed.min()))
        long = min(least - 1, int(least / (MU * math.log2(max(2, self.sizes[tokens[0]])) + 1))) if len(tokens) else 0
        counts = np.bincount(self.members(tokens[long:]), minlength=self.n)
        near = np.flatnonzero((counts > 0) & (counts + long >= needed))
        if long and len(near):
            probes = (tokens[:long, None] * self.n + near[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            counts[near] += (self.keys[at] == probes).reshape(long, len(near)).sum(0)
        near = near[counts[near] >= needed[near]]
        return near, counts[near]


def overlap_needed(n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (n + sizes) // (100 + percent))


def occurrence_search(query: np.ndarray, others: list[np.ndarray], percent: int) -> tuple[list[bool], list[int]]:
    """Which candidates reach the required overlap (DivideSkip), and the overlap of each."""
    sizes = np.asarray([len(o) for o in others])
    lists = Lists([*others, query])
    counts = np.bincount(lists.members(lists.own[-1]), minlength=len(others) + 1)
    near, _ = lists.reach(len(others), np.r_[overlap_needed(len(query), sizes, percent), len(query)])
    linked = np.isin(np.arange(len(others)), near)
    return linked.tolist(), counts[:-1].tolist()


def block_links(nodes: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], percent: int, within: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All links of ``nodes`` (side, documents, shingles of the ball, prefix, set) that count in the ball.

    Given are a spanning forest of them and, per node, how many documents it links to. With
    ``within`` all nodes are one block; else only nodes of different sides are compared.
    """
    side, copies = np.asarray([x[0] for x in nodes]), np.asarray([x[1] for x in nodes])
    sizes = np.asarray([len(x[4]) for x in nodes])
    prefixes, sets = Lists([x[3] for x in nodes]), Lists([x[4] for x in nodes])
    found, label, links = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), []
    for i, (_, _, mine, prefix, _) in enumerate(nodes):
        if not within and side[i]:
            continue
        # The smallest shared shingle of the prefixes decides; the last of several writes stays.
        order = np.argsort(prefixes.own[i])[::-1]
        tokens, here = prefixes.own[i][order], np.isin(prefix, mine)[order]
        credited = np.zeros(len(nodes), bool)
        credited[prefixes.members(tokens)] = np.repeat(here, prefixes.sizes[tokens])
        credited &= np.arange(len(nodes)) > i if within else side != side[i]
        if not credited.any():
            continue
        near, _ = sets.reach(i, overlap_needed(sizes[i], sizes, percent))
        near = near[credited[near]]
        found[i] += copies[near].sum()
        found[near] += copies[i]
        fresh, at = np.unique(label[near], return_index=True)
        apart = fresh != label[i]
        links += [(i, int(j)) for j in near[at[apart]]]
        if apart.any():
            label[np.isin(label, fresh[apart])] = label[i]
    return links, found


def linked_nodes(sets: DataFrame, copies: DataFrame, percent: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """``node, label`` of all nodes that link with another one, and ``node, linked``: to how many documents of others.

    ``copies`` has ``node, copies``, the number of documents of each node.
    """
    spark = sets.sparkSession
    path = scratch_path(spark, "prefixes")
    prefixes(sets, percent, ranges).write.parquet(path)
    known = spark.read.parquet(path)
    posted = known.select("node", "n", F.explode("prefix").alias("shingle"))
    heads = posted.groupBy("shingle").agg(F.count("*").alias("size"), F.min("node").alias("ball")).where("size > 1").select("shingle", "ball")
    members = posted.join(heads, "shingle").groupBy("ball", "node").agg(F.first("n").alias("n"), F.collect_list("shingle").alias("mine"))
    path = scratch_path(spark, "balls")
    members.write.parquet(path)
    members = spark.read.parquet(path)
    blocks = members.groupBy("ball").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = members.join(blocks, "ball").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = spread.select(
        "ball", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "mine")
    whole = known.join(sets.select("node", "shingles"), "node").join(copies, "node")
    gathered = asked.join(whole.select("node", "copies", "prefix", "shingles"), "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, nodes = None, [], []

        def answer() -> pa.RecordBatch:
            links, found = block_links(nodes, percent, held[1] == held[2])
            some = np.flatnonzero(found).tolist()
            return pa.RecordBatch.from_arrays([
                pa.array([names[i] for i in some] + [names[i] for i, _ in links], pa.string()),
                pa.array([None] * len(some) + [names[j] for _, j in links], pa.string()),
                pa.array([int(found[i]) for i in some] + [0] * len(links), pa.int64())], names=["x", "y", "linked"])

        for batch in batches:
            for ball, i, j, side, node, times, mine, prefix, value in zip(*(batch.column(c).to_pylist() for c in range(9))):
                if (ball, i, j) != held:
                    if len(names) > 1:
                        yield answer()
                    held, names, nodes = (ball, i, j), [], []
                names.append(node)
                nodes.append((side, times, np.asarray(mine, np.int64), np.asarray(prefix, np.int64), np.frombuffer(value, "<u8")))
        if len(names) > 1:
            yield answer()

    ordered = gathered.select("ball", "i", "j", "side", "node", "copies", "mine", "prefix", "shingles").repartition("ball", "i", "j").sortWithinPartitions("ball", "i", "j", "node")
    path = scratch_path(spark, "links")
    ordered.mapInArrow(search, "x string, y string, linked long").write.parquet(path)
    links = spark.read.parquet(path)
    counts = links.where("y IS NULL").groupBy(F.col("x").alias("node")).agg(F.sum("linked").alias("linked"))
    return components(links.where("y IS NOT NULL").select("x", "y")), counts


def similarity_join(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, n_shingles, component_id, n_links`` of every document.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a document's set
    holds its distinct shingles of ``size`` words, or with fewer words the whole sequence. Two
    documents link when ``100 * intersection >= percent * union``. ``component_id`` is the smallest
    ``doc_id`` reachable by links and ``n_links`` counts the other documents it links with (null ids count only where there is no other). Null, empty and
    wordless texts have no shingles and stay alone; repeated rows link with each other; an empty
    table gives no rows; other columns are ignored; texts are read whole.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id, text)
    about = summarize(rows, size)
    total = about.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_SHINGLES))
    shared = shared_counts(rows, size, ranges)
    able = about.where("n_shingles > 0").join(shared, "key").where(100 * F.col("shared") >= percent * F.col("n_shingles"))
    path = scratch_path(spark, "nodes")
    able.groupBy("node").agg(F.min("doc_id").alias("smallest"), F.min("key").alias("key"), F.count("*").alias("copies")).write.parquet(path)
    nodes = spark.read.parquet(path)
    sets = stored_sets(rows, nodes.select("node", "key"), size)
    held = sets.agg(F.sum("n")).first()[0] or 0
    labels, counts = linked_nodes(sets, nodes.select("node", "copies"), percent, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_SHINGLES)))
    joined = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = joined.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = joined.join(groups, "label").join(counts, "node", "left").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return about.join(named, "node", "left").select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one left of each linked group: the one with the smallest ``doc_id``.

    All columns stay. Documents without words are all kept; of rows repeated with id and text one stays.
    """
    found = similarity_join(docs, size, percent, doc_id, text)
    path = scratch_path(docs.sparkSession, "components")
    found.write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"]
    # Without any id in a group its rows share the null component; the text then tells them apart.
    alone = F.when(F.col("component_id").isNull(), F.col("key"))
    keepers = found.where("n_shingles > 0").groupBy("component_id", alone.alias("alone")).agg(first.alias("__key")).select("__key").distinct()
    counts = found.groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("__copies"), F.max("n_shingles").alias("__n"))
    kept = counts.join(keepers.withColumn("__keep", F.lit(True)), "__key", "left").where("__keep OR __n = 0").select("__key", (F.col("__n") > 0).alias("__worded"), "__copies")
    body = docs.withColumn("__key", F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))).join(kept, "__key")
    single = body.where("__copies = 1 OR NOT __worded")
    repeated = body.where("__copies > 1 AND __worded").dropDuplicates(["__key"])
    return single.unionByName(repeated).select(*docs.columns)
