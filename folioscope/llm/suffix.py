"""Removal of every byte inside a string of ``length`` bytes that occurs elsewhere too.

Suffixes are compared to a depth of ``length`` bytes, one bucket of them at a time:

1. Cover sample. Positions of a text whose residue lies in a perfect difference set modulo ``v`` are
   sampled: any two positions reach sampled ones at a common distance below ``v``. Each sample gets
   the name (rank up to equality) of the ``length - v + 1`` bytes that begin there, and names that
   occur once are dropped. Only positions that reach a sample with a shared name within ``v`` bytes
   can begin a repeated string; nearly all positions end here.
2. Suffix buckets. The windows that remain are put into buckets by the least hashed short string
   inside them, so equal windows meet in one bucket and neighbouring windows travel as one slice of
   text. A task holds one bucket after another, names its windows by a rolling hash (the tie beyond
   any prefix is settled by that name, in constant time) and sorts the names; equal neighbours are
   repeated strings. A bucket beyond the working size is sorted in portions against the distinct
   names seen so far.
3. The covered bytes are cut from the texts. Whole copies of a text count as one in the first two
   steps and are removed because of their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.buffers import addressed, chunks, prefix_hash, span_hashes, split_sorted
from folioscope.session import scratch_path

# Samples that one task sorts at a time, and bytes of slices likewise.
RANGE_SAMPLES = 2_000_000
BUCKET_BYTES, PORTION_BYTES = 1 << 20, 8 << 20
ANCHOR_BYTES = 32
PLACE_BITS = np.uint64(28)


@lru_cache(maxsize=8)
def difference_set(q: int) -> np.ndarray:
    """A perfect difference set modulo q*q + q + 1 for a prime q, by Singer's construction.

    Powers of x in GF(q^3) whose x^2 coefficient is zero; the first cubic that gives q + 1 of them
    with distinct differences is used.
    """
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        point, found = (0, 0, 1), []
        for i in range(v):
            if point[0] == 0:
                found.append(i)
            p2, p1, p0 = point
            point = (p1 + p2 * a) % q, (p0 + p2 * b) % q, p2 * c % q
        if len(found) == q + 1 and len({(x - y) % v for x in found for y in found if x != y}) == v - 1:
            return np.asarray(found)
    raise ValueError(f"no difference set for {q}")


def cover(length: int) -> tuple[int, np.ndarray]:
    """Modulus and residues; the modulus takes at most four fifths of the length."""
    primes = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31) if q * q + q + 1 <= length * 4 // 5]
    if not primes:
        raise ValueError("length is too short for a difference cover")
    q = primes[-1]
    return q * q + q + 1, difference_set(q)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive keys."""
    count = len(keys) - width + 1
    if count <= 0:
        return keys[:0]
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1: width - 1 + count])


def runs(places: np.ndarray, *also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive places over which ``also`` stay the same."""
    if not len(places):
        return places.astype(np.int64), places.astype(np.int64)
    cut = places[1:] != places[:-1] + 1
    for other in also:
        cut |= other[1:] != other[:-1]
    return np.flatnonzero(np.r_[True, cut]), np.flatnonzero(np.r_[cut, True])


def _samples(bounds: np.ndarray, modulus: int, residues: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place (from its start) of every sampled position that has ``width`` bytes ahead."""
    sizes = np.maximum(np.diff(bounds) - width + 1, 0)
    periods = -(-sizes // modulus)
    rows = np.repeat(np.arange(len(sizes)), periods)
    nth = np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods)
    places = (nth[:, None] * modulus + residues[None, :]).ravel()
    rows = np.repeat(rows, len(residues))
    inside = places < sizes[rows]
    return rows[inside], places[inside]


def shared_samples(texts: DataFrame, length: int, ranges: int) -> DataFrame:
    """``key, places``: sampled positions of each text whose name occurs at another place or in another text."""
    modulus, residues = cover(length)
    width = length - modulus + 1

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in chunks(batches, "text"):
            rows, places = _samples(bounds, modulus, residues, width)
            starts = bounds[rows] + places
            names = span_hashes(prefix_hash(data), starts, starts + width)
            target = ((names >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(target, kind="stable")
            target, rows, places, low = target[order], rows[order], places[order].astype("<u4"), names[order].astype("<u4")
            at = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])[: len(target)]
            stop = np.r_[at[1:], len(target)].astype(np.int64)[: len(at)]
            keys, out = np.asarray(batch.column(0), dtype=np.int64), ([], [])
            for i, j in zip(at, stop):
                present, which = np.unique(rows[i:j], return_inverse=True)
                out[0].append(keys[present].tobytes())
                out[1].append(which.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array(target[at]), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()),
                pa.array([places[i:j].tobytes() for i, j in zip(at, stop)], pa.binary()),
                pa.array([low[i:j].tobytes() for i, j in zip(at, stop)], pa.binary()),
            ], names=["part", "keys", "rows", "places", "low"])

    def match(group: pa.Table) -> pa.Table:
        column = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in group[name]]
        keys = np.concatenate([k[r] for k, r in zip(column("keys", np.int64), column("rows", "<u4"))])
        places, low = np.concatenate(column("places", "<u4")), np.concatenate(column("low", "<u4"))
        order = np.argsort(low, kind="stable")
        twin = low[order][1:] == low[order][:-1]
        order = order[(np.r_[False, twin] | np.r_[twin, False])[: len(order)]]
        # Copies of one text give the same key and place; they are one occurrence.
        order = order[np.lexsort((places[order], keys[order], low[order]))]
        low, keys, places = low[order], keys[order], places[order]
        fresh = np.r_[True, (low[1:] != low[:-1]) | (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])][: len(low)]
        low, keys, places = low[fresh], keys[fresh], places[fresh]
        twin = low[1:] == low[:-1]
        hit = (np.r_[False, twin] | np.r_[twin, False])[: len(low)]
        keys, places = keys[hit], places[hit]
        posts = addressed(keys, ranges, places)
        return pa.table({"to": pa.array([x[0] for x in posts], pa.int32()), **{n: pa.array([x[i] for x in posts], pa.binary()) for i, n in ((1, "keys"), (2, "places"))}})

    def gather(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group["keys"]])
        places = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in group["places"]])
        order = np.lexsort((places, keys))
        keys, places = keys[order], places[order]
        first, stop = split_sorted(keys)
        return pa.table({"key": pa.array(keys[first], pa.int64()), "places": pa.array([places[i:j].tobytes() for i, j in zip(first, stop)], pa.binary())})

    packed = texts.select("key", "text").mapInArrow(scatter, "part int, keys binary, rows binary, places binary, low binary")
    found = packed.groupBy("part").applyInArrow(match, "to int, keys binary, places binary")
    return found.groupBy("to").applyInArrow(gather, "key long, places binary")


def slices(texts: DataFrame, length: int) -> DataFrame:
    """``anchor, slice, digests, starts``: windows that may repeat, neighbours in one slice.

    ``texts`` has ``key, digest, places, text``, ordered by key and digest so that copies follow one
    another. Equal slices of a chunk are one row with all their occurrences.
    """
    modulus, _ = cover(length)
    short = min(ANCHOR_BYTES, length - modulus + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch, data, bounds in chunks(batches, "text"):
            digests = batch.column(0).to_pylist()
            steps = np.zeros(len(data) + 1, np.int32)
            for row, found in enumerate(batch.column(1)):
                if digests[row] == last:
                    continue
                last = digests[row]
                places = np.frombuffer(found.as_buffer(), "<u4").astype(np.int64)
                most = bounds[row + 1] - bounds[row] - length + 1
                first, end = np.maximum(places - modulus + 1, 0), np.minimum(places + 1, most)
                fits = first < end
                np.add.at(steps, bounds[row] + first[fits], 1)
                np.add.at(steps, bounds[row] + end[fits], -1)
            windows = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
            if not len(windows):
                continue
            prefix = prefix_hash(data)
            heads = np.arange(len(data) - short + 1)
            hashes = span_hashes(prefix, heads, heads + short)
            packed = (hashes >> PLACE_BITS << PLACE_BITS) | heads.astype(np.uint64)
            anchors = (sliding_least(packed, length - short + 1)[windows] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
            rows = np.searchsorted(bounds, windows, side="right") - 1
            first, end = runs(windows, rows, anchors)
            begin, stop, of = windows[first], windows[end] + length, anchors[first]
            content = span_hashes(prefix, begin, stop)
            order = np.lexsort((content, stop - begin, hashes[of]))
            o_content, o_size, o_anchor = content[order], (stop - begin)[order], hashes[of][order]
            fresh = np.flatnonzero(np.r_[True, (o_content[1:] != o_content[:-1]) | (o_size[1:] != o_size[:-1]) | (o_anchor[1:] != o_anchor[:-1])])
            limit = np.r_[fresh[1:], len(order)]
            own, starts = rows[first], (begin - bounds[rows[first]]).astype("<u4")
            out = ([], [], [], [])
            for i, j in zip(fresh, limit):
                group = order[i:j]
                out[0].append(int(hashes[of[group[0]]].view(np.int64)))
                out[1].append(data[begin[group[0]]: stop[group[0]]].tobytes())
                out[2].append(b"".join(digests[r] for r in own[group]))
                out[3].append(starts[group].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=["anchor", "slice", "digests", "starts"])

    return texts.select("digest", "places", "text").mapInArrow(cut, "anchor long, slice binary, digests binary, starts binary")


class Bucket:
    """Names of the windows of one bucket seen so far, with their first occurrence."""

    def __init__(self):
        self.names, self.digests = np.zeros(0, np.uint64), np.zeros(0, "S16")
        self.starts, self.done = np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, rows: list[tuple[bytes, bytes, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Digest and start of every window found to repeat by these rows (slice, digests, starts)."""
        data = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
        sizes = np.asarray([len(r[0]) for r in rows])
        counts = sizes - length + 1
        which = np.repeat(np.arange(len(rows)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = (np.cumsum(sizes) - sizes)[which] + inside
        names = span_hashes(prefix_hash(data), begin, begin + length)
        times = np.asarray([len(r[2]) // 4 for r in rows])
        # Every occurrence of every slice, window by window.
        expand = np.repeat(np.arange(len(names)), times[which])
        nth = np.arange(len(expand)) - np.repeat(np.cumsum(times[which]) - times[which], times[which])
        digests = np.frombuffer(b"".join(r[1] for r in rows), "V16")
        starts = np.frombuffer(b"".join(r[2] for r in rows), "<u4").astype(np.int64)
        at = (np.cumsum(times) - times)[which[expand]] + nth
        names = np.r_[self.names, names[expand]]
        starts = np.r_[self.starts, starts[at] + inside[expand]]
        digests = np.r_[self.digests.view("V16"), digests[at]]
        done = np.r_[self.done, np.zeros(len(expand), bool)]
        words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 2)
        order = np.lexsort((~done, starts, words[:, 1], words[:, 0], names))
        n, s, w = names[order], starts[order], words[order]
        same = n[1:] == n[:-1]
        twin = same & (s[1:] == s[:-1]) & (w[1:] == w[:-1]).all(1)
        order = order[np.r_[True, ~twin][: len(order)]]
        names, starts, digests, done = names[order], starts[order], digests[order], done[order]
        same = names[1:] == names[:-1]
        hit = (np.r_[False, same] | np.r_[same, False])[: len(names)]
        first = np.r_[True, ~same][: len(names)]
        found = hit & ~done
        # A name repeats if two occurrences are here, or if an earlier portion has shown it.
        known = np.maximum.reduceat(done, np.flatnonzero(first)) if len(names) else done
        found |= ~done & known[np.cumsum(first) - 1] if len(names) else found
        self.names, self.starts, self.digests = names[first], starts[first], digests[first]
        self.done = np.maximum.reduceat(hit | done, np.flatnonzero(first)) if len(names) else done
        return digests[found], starts[found]


def repeated_spans(buckets: DataFrame, length: int) -> DataFrame:
    """``digest, spans``: byte ranges (pairs of unsigned 32-bit numbers) that repeated windows cover."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, size, last = Bucket(), [], 0, None

        def flush() -> pa.RecordBatch:
            digests, starts = state.add(held, length)
            words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 2)
            order = np.lexsort((starts, words[:, 1], words[:, 0]))
            words, starts, digests = words[order], starts[order], digests[order]
            first, end = runs(starts, words[:, 0], words[:, 1])
            spans = np.stack([starts[first], starts[end] + length], 1).astype("<u4")
            owner = np.flatnonzero(np.r_[True, (words[first][1:] != words[first][:-1]).any(1)])[: len(first)]
            stop = np.r_[owner[1:], len(first)].astype(np.int64)[: len(owner)]
            return pa.RecordBatch.from_arrays([
                pa.array([digests[first[i]].tobytes() for i in owner], pa.binary()),
                pa.array([spans[i:j].tobytes() for i, j in zip(owner, stop)], pa.binary())], names=["digest", "spans"])

        for batch in batches:
            for anchor, *row in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if anchor != last and size >= BUCKET_BYTES or size >= PORTION_BYTES:
                    yield flush()
                    held, size = [], 0
                    if anchor != last:
                        state = Bucket()
                held.append(row)
                size += len(row[0]) * (1 + len(row[2]) // 64)
                last = anchor
        if held:
            yield flush()

    ordered = buckets.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(sort, "digest binary, spans binary").groupBy("digest").agg(F.collect_list("spans").alias("spans"))


def identified(docs: DataFrame, text: str) -> DataFrame:
    """All columns in ``row``, with the text (null as empty), its digest and key."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), body.alias("text"))
    return held.withColumns({"digest": F.unhex(F.md5(F.col("text").cast("binary"))), "key": F.xxhash64("text")})


def spans_of(docs: DataFrame, length: int, text: str = "text") -> DataFrame:
    """``digest, spans, copies`` of every distinct text that loses bytes."""
    spark, rows = docs.sparkSession, identified(docs, text).drop("row")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    modulus, residues = cover(length)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * len(residues) // modulus // RANGE_SAMPLES + 1)
    able = rows.where(F.octet_length("text") >= length)
    found = shared_samples(able, length, ranges)
    near = able.join(found, "key").sortWithinPartitions("key", "digest")
    spans = repeated_spans(slices(near, length), length)
    copies = able.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    path = scratch_path(spark, "spans")
    spans.join(copies, "digest", "full").write.parquet(path)
    return spark.read.parquet(path)


def merged(pieces: list[bytes]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one, in order."""
    both = np.concatenate([np.frombuffer(p, "<u4").reshape(-1, 2) for p in pieces]).astype(np.int64)
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    first = np.flatnonzero(np.r_[True, both[1:, 0] > reach[:-1]])
    return list(zip(both[first, 0].tolist(), np.r_[reach[first[1:] - 1], reach[-1]].tolist()))


def cut_repeats(docs: DataFrame, length: int = 400, text: str = "text") -> DataFrame:
    """One row per document: ``row`` (all its columns), ``n_bytes, n_removed, n_spans, spans, kept, kept_sha256``.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if it is covered by a string of
    ``length`` bytes that begins anywhere else too, in the same text or another; all strings are
    judged on the input. ``spans`` are the removed byte ranges, ``kept`` is the remaining text without
    characters that lost some of their bytes, ``kept_sha256`` is of all remaining bytes. Texts shorter than ``length`` keep everything; repeated rows remove each other when long enough; an
    empty table gives no rows; further columns stay inside ``row``. Texts are read whole.
    """
    found = spans_of(docs, length, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in chunks(batches, "text"):
            out = [[] for _ in range(5)]
            lost = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for row, (pieces, copies) in enumerate(lost):
                body = data[bounds[row]: bounds[row + 1]]
                spans = [(0, len(body))] if copies else merged(pieces) if pieces else []
                at = [0, *(x for span in spans for x in span), len(body)]
                kept = b"".join(body[i:j].tobytes() for i, j in zip(at[::2], at[1::2]))
                for column, value in zip(out, (len(body), len(body) - len(kept), [list(s) for s in spans], kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.list_(pa.int64()))),
                pa.array(out[3], pa.string()), pa.array(out[4], pa.string())], names=["row", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    # The text travels once, inside its row.
    rows = identified(docs, text).drop("text", "key").join(found, "digest", "left")
    rows = rows.select("row", F.coalesce(F.col("row")[text].cast("string"), F.lit("")).alias("text"), "spans", "copies")
    inner = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(cut, f"row {inner}, n_bytes long, n_removed long, spans array<array<bigint>>, kept string, kept_sha256 string")
    return done.withColumn("n_spans", F.size("spans").cast("long"))
