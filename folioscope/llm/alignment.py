"""Alignment of two tokenizers over the same text, with the fragments of very long documents composed in a tree.

Both token streams of a text end at byte offsets of it; where both end, the text is cut into groups,
and the two tokens that end there are linked. A byte range of a text yields a *fragment*: the tokens
up to its first cut (open to the left), the groups between cuts (closed) and the tokens after its
last cut (open to the right). Fragments of neighbouring ranges compose: the right end of one and the
left end of the other close a group, or stay open. The composition is associative, an empty range is
its neutral element, and so ranges can be tokenized anywhere and joined in any bracketing.

Texts up to ``chunk`` bytes are one fragment. Longer ones are cut into ranges of about that size
which are spread over the cluster; each is tokenized together with the ends of the space-delimited
units that it cuts, since neither vocabulary has a token that reaches over a space inside it. Rounds
of ``FAN`` neighbours at a time reduce the open ends to one fragment a document. The closed groups
don't travel through the tree; the groups that it closes are put between them by their range number.

Tokens linked to each other end at the same byte, so one's bytes are the end of the other's. The two
vocabularies alone thus bound the pairs that any corpus can link, and their counts are one array.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm.buffers import chunks, raw_bytes
from folioscope.llm.tokens import Encoder, byte_symbols
from folioscope.session import scratch_path

CHUNK = 1 << 16
# A cut inside a unit is made only where the unit is this short; a longer one stays in one range.
REACH = 4096
# Fragments that one row of a round of the tree composes.
FAN = 16
# Beyond this a piece goes to the whole tokenizer, whose patterns don't recurse.
RECURSING = 1 << 18
SAFE = re.compile(r"(?<=[\w!-~])(?= [\w!-~])")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
# Fixed value: how the byte-level scheme splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Table:
    """Bytes of every id of a vocabulary in one array, and its decimal digits."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.sizes = np.asarray([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        width = len(str(max(len(entries) - 1, 0)))
        text = [str(i).encode() for i in range(len(entries))]
        self.digits = np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(-1, width)
        self.shown = np.asarray([len(t) for t in text], np.int64)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Aligner:
    """Both tokenizers, their tables and the numbered pairs of ids that can be linked."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.whole = Tokenizer.from_file(bytes_path)
        self.whole.encode_special_tokens = True
        spec = json.loads(self.whole.to_str())
        if Encoder._scheme(spec) != "byte":
            raise ValueError("the first vocabulary must be byte-level")
        back = {s: b for b, s in byte_symbols().items()}
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            entries[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        special = {t["id"] for t in spec.get("added_tokens") or []}
        self.fast = self._ranks(spec, entries, special)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        shown = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in shown):
            raise ValueError("the second vocabulary has tokens that reach over a space")
        self.a = Table(entries)
        self.b = Table([bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in shown])
        self.pairs = self._pairs()
        self.pair_b = (self.pairs % len(self.b.entries)).astype(np.int64)

    @staticmethod
    def _ranks(spec: dict, entries: list[bytes], special: set[int]) -> tiktoken.Encoding | None:
        """The same merges by rank, where the vocabulary numbers its entries in the order of its merges."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocabulary = spec["model"]["vocab"]
        made = [vocabulary.get("".join(m), -1) for m in merges]
        singles = [i for i, e in enumerate(entries) if len(e) == 1 and i not in special]
        if made != sorted(set(made)) or len(singles) != 256 or (made and made[0] <= max(singles)):
            return None
        ranks = {e: i for i, e in enumerate(entries) if i not in special}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _pairs(self) -> np.ndarray:
        """Codes ``a * size of b + b``, sorted, of all ids where one's bytes are the end of the other's."""
        size = len(self.b.entries)

        def ends(longer: list[bytes], other: dict[bytes, list[int]]) -> Iterator[tuple[int, int]]:
            for i, entry in enumerate(longer):
                for at in range(len(entry)):
                    for j in other.get(entry[at:], ()):
                        yield i, j

        by_a, by_b = defaultdict(list), defaultdict(list)
        for table, by in ((self.a.entries, by_a), (self.b.entries, by_b)):
            for i, entry in enumerate(table):
                by[entry].append(i)
        found = {i * size + j for i, j in ends(self.a.entries, by_b)} | {i * size + j for j, i in ends(self.b.entries, by_a)}
        return np.fromiter(sorted(found), np.int64, len(found))

    def ids(self, pieces: list[str]) -> tuple[list, list]:
        """Ids of each piece, which begins with a space; the second tokenizer puts that space there itself."""
        if self.fast is None or any(len(p) > RECURSING for p in pieces):
            a = [e.ids for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]
        else:
            a = [self.fast.encode_ordinary(p) for p in pieces]
        return a, self.pieces.encode([p[1:] for p in pieces], num_threads=1)


@lru_cache(maxsize=2)
def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One a worker process; it is kept between tasks."""
    return Aligner(bytes_path, pieces_path)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(counts.sum(), np.int64)
    at = 0
    for ids, n in zip(lists, counts.tolist()):
        flat[at: at + n] = ids
        at += n
    return flat, counts


class Side(NamedTuple):
    """Tokens of one tokenizer: ids, the piece of each, and whether a group ends with it."""

    ids: np.ndarray
    owner: np.ndarray
    cut: np.ndarray


class Aligned(NamedTuple):
    """Pieces of text: whether both tokenizers spell them, and the tokens that end in the asked range."""

    valid: np.ndarray
    a: Side
    b: Side


def align_pieces(own: Aligner, pieces: list[str], low: np.ndarray | None = None, high: np.ndarray | None = None) -> Aligned:
    """Both sides of pieces that begin with a space; only tokens that end beyond ``low`` and up to ``high`` (bytes) stay."""
    data = [p.encode() for p in pieces]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    base = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(data), np.uint8)
    valid, sides = np.ones(len(pieces), bool), []
    for table, lists in zip((own.a, own.b), own.ids(pieces)):
        ids, counts = _flat(lists)
        owner = np.repeat(np.arange(len(pieces)), counts)
        size = np.bincount(owner, table.sizes[ids], len(pieces)).astype(np.int64)
        same = size == sizes
        if not same.all():
            fits = same[owner]
            ids, owner = ids[fits], owner[fits]
        spelled = table.spell(ids)
        place = np.repeat(base[same] - (np.cumsum(size[same]) - size[same]), size[same]) + np.arange(len(spelled)) if not same.all() else slice(None)
        differ = np.flatnonzero(spelled != text[place])
        if len(differ):
            at = np.arange(len(text))[place][differ]
            same[np.searchsorted(base, at, side="right") - 1] = False
        valid &= same
        # Ends from the start of the piece, of pieces that are spelled to their full length.
        total = np.cumsum(table.sizes[ids])
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])[: len(owner)]
        before = np.zeros(len(pieces), np.int64)
        before[owner[first]] = total[first] - table.sizes[ids[first]]
        sides.append((ids, owner, total - before[owner]))
    ends = []
    for k, (ids, owner, end) in enumerate(sides):
        stays = valid[owner]
        if low is not None:
            stays &= (end > low[owner]) & (end <= high[owner])
        sides[k] = ids[stays], owner[stays]
        ends.append(end[stays] + base[owner[stays]])
    marks = []
    for end in ends:
        mark = np.zeros(len(text) + 1, bool)
        mark[end] = True
        marks.append(mark)
    return Aligned(valid, *(Side(ids, owner, marks[1 - k][ends[k]]) for k, (ids, owner) in enumerate(sides)))


def write_groups(own: Aligner, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups as bytes, and where the text of each group ends in it.

    Tokens after the last group of all are left out; inside, the tokens of a piece that no group
    holds would join the next piece's first group, so callers pass sides that end with a group.
    """
    through_a, through_b = np.flatnonzero(a.cut) + 1, np.flatnonzero(b.cut) + 1
    if not len(through_a):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    ids_a, ids_b = a.ids[: through_a[-1]], b.ids[: through_b[-1]]
    group_a = np.repeat(np.arange(len(through_a)), np.diff(through_a, prepend=0))
    group_b = np.repeat(np.arange(len(through_b)), np.diff(through_b, prepend=0))
    place_a = np.arange(len(ids_a)) + np.r_[0, through_b[:-1]][group_a]
    place_b = np.arange(len(ids_b)) + through_a[group_b]
    shown = np.empty(len(ids_a) + len(ids_b), np.int64)
    shown[place_a], shown[place_b] = own.a.shown[ids_a], own.b.shown[ids_b]
    stop = np.cumsum(shown + 1)
    out = np.full(stop[-1], ord(","), np.uint8)
    for table, ids, place in ((own.a, ids_a, place_a), (own.b, ids_b, place_b)):
        begin, size = (stop - shown - 1)[place], table.shown[ids]
        for k in range(table.digits.shape[1]):
            some = slice(None) if k == 0 else np.flatnonzero(size > k)
            out[begin[some] + k] = table.digits[ids[some], k]
    out[stop[place_a[through_a - 1]] - 1] = ord("|")
    ends = stop[place_b[through_b - 1]]
    out[ends - 1] = ord(";")
    return out, ends


def link_numbers(own: Aligner, a: Side, b: Side) -> np.ndarray:
    """Number of the pair of every link, in order."""
    return np.searchsorted(own.pairs, a.ids[a.cut] * len(own.b.entries) + b.ids[b.cut]).astype("<u4")


class Fragment(NamedTuple):
    """Open ends of a run of byte ranges. Without a cut all of its tokens are in the head and ``first`` is -1."""

    first: int
    head_a: bytes
    head_b: bytes
    tail_a: bytes
    tail_b: bytes


EMPTY = Fragment(-1, b"", b"", b"", b"")


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[int, bytes, bytes] | None]:
    """Both as one, and the group that closes between them: the number of the range it ends in, its ids."""
    if left.first < 0:
        return right._replace(head_a=left.head_a + right.head_a, head_b=left.head_b + right.head_b), None
    if right.first < 0:
        return left._replace(tail_a=left.tail_a + right.head_a, tail_b=left.tail_b + right.head_b), None
    closed = right.first, left.tail_a + right.head_a, left.tail_b + right.head_b
    return left._replace(tail_a=right.tail_a, tail_b=right.tail_b), closed


def ranges(text: str, chunk: int) -> Iterator[tuple[int, int, int, int]]:
    """Begin of the context, begin, end, end of the context (characters) of each range of ``text``.

    A range ends after about ``chunk`` characters, inside a unit if that is short, else behind it.
    """
    context = begin = 0
    while True:
        at = begin + chunk
        if at >= len(text):
            yield context, begin, len(text), len(text)
            return
        after = SAFE.search(text, at + 1)
        if after is None:
            yield context, begin, len(text), len(text)
            return
        floor = max(begin, at - REACH)
        before = None
        for before in SAFE.finditer(text, floor + 1, at + 2):
            pass
        if before is not None and floor < before.start() <= at and after.start() - before.start() <= REACH:
            yield context, begin, at, after.start()
            context, begin = before.start(), at
        else:
            yield context, begin, after.start(), after.start()
            context = begin = after.start()


PIECE = "key string, range int, piece string, low int, high int"
LEAF = "key string, range int, first int, head_a binary, head_b binary, tail_a binary, tail_b binary, valid boolean, n_a long, n_b long, n_groups long, groups binary, links binary"
OPEN = ["first", "head_a", "head_b", "tail_a", "tail_b"]


def cut_ranges(texts: DataFrame, chunk: int) -> DataFrame:
    """``texts`` (``key, text``) as ranges with their contexts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole, held, size = " " + text.as_py(), [], 0
                for n, (left, begin, end, right) in enumerate(ranges(whole, chunk)):
                    piece = whole[left:right]
                    low = len(whole[left:begin].encode())
                    held.append((key, n, piece, low, low + len(whole[begin:end].encode())))
                    size += len(piece)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist([dict(zip(("key", "range", "piece", "low", "high"), h)) for h in held], _schema(PIECE))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(("key", "range", "piece", "low", "high"), h)) for h in held], _schema(PIECE))

    return texts.select("key", "text").mapInArrow(cut, PIECE)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _u4(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def leaf(own: Aligner, number: int, piece: str, low: int, high: int) -> dict:
    """The fragment of one range: open ends, closed groups as text, links of the closed groups."""
    found = align_pieces(own, [piece], np.asarray([low]), np.asarray([high]))
    a, b = found.a, found.b
    row = {"valid": bool(found.valid[0]), "n_a": len(a.ids), "n_b": len(b.ids)}
    cuts_a, cuts_b = np.flatnonzero(a.cut) + 1, np.flatnonzero(b.cut) + 1
    if not len(cuts_a):
        return row | {"first": -1, "head_a": _u4(a.ids), "head_b": _u4(b.ids), "tail_a": b"", "tail_b": b"", "n_groups": 0, "groups": b"", "links": b""}
    inner = [Side(s.ids[c[0]: c[-1]], s.owner[c[0]: c[-1]], s.cut[c[0]: c[-1]]) for s, c in ((a, cuts_a), (b, cuts_b))]
    text, _ = write_groups(own, *inner)
    return row | {
        "first": number, "head_a": _u4(a.ids[: cuts_a[0]]), "head_b": _u4(b.ids[: cuts_b[0]]),
        "tail_a": _u4(a.ids[cuts_a[-1]:]), "tail_b": _u4(b.ids[cuts_b[-1]:]),
        "n_groups": len(cuts_a) - 1, "groups": text.tobytes(), "links": link_numbers(own, *inner).tobytes(),
    }


def fragments(pieces: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = aligner(*paths), _schema(LEAF)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = batch.slice(at, 16).to_pylist()
                yield pa.RecordBatch.from_pylist(
                    [{"key": r["key"], "range": r["range"]} | leaf(own, r["range"], r["piece"], r["low"], r["high"]) for r in rows], schema)

    return pieces.mapInArrow(run, LEAF)


def reduce_tree(leaves: DataFrame, highest: int) -> DataFrame:
    """``key, range, ids_a, ids_b``: every group that closes between ranges, and the first group of each document.

    ``highest`` is the largest range number. Every round composes ``FAN`` neighbours a row and is
    written to the shared folder; a document's fragments thus meet in a logarithm of rounds.
    """
    spark = leaves.sparkSession
    kinds = "key string, range int, first int, head_a binary, head_b binary, tail_a binary, tail_b binary, closed boolean"

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["range"])
        held, out = EMPTY, []
        for r in rows:
            held, closed = compose(held, Fragment(*(r[c] for c in OPEN)))
            if closed:
                out.append({"key": r["key"], "range": closed[0], "head_a": closed[1], "head_b": closed[2], "closed": True})
        out.append({"key": rows[0]["key"], "range": rows[0]["range"] // FAN, "closed": False} | held._asdict())
        return pa.Table.from_pylist(out, _schema(kinds))

    level, closed = leaves.select("key", "range", *OPEN), []
    while True:
        path = scratch_path(spark, "tree")
        level.groupBy("key", (F.col("range") / FAN).cast("int").alias("__parent")).applyInArrow(join, kinds).write.parquet(path)
        done = spark.read.parquet(path)
        closed.append(done.where("closed").select("key", "range", F.col("head_a").alias("ids_a"), F.col("head_b").alias("ids_b")))
        level, highest = done.where("not closed"), highest // FAN
        if not highest:
            break
    # What is open to the left of a document's first cut is its first group.
    closed.append(level.where("first >= 0").select("key", F.col("first").alias("range"), F.col("head_a").alias("ids_a"), F.col("head_b").alias("ids_b")))
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def long_documents(texts: DataFrame, paths: tuple[str, str], chunk: int) -> DataFrame:
    """Written parts of distinct long texts (``key, text``): ``key, links, n_groups``, and one with the digest, ``n_a``, ``n_b``."""
    spark, parts = texts.sparkSession, scratch_path(texts.sparkSession, "ranges")
    fragments(cut_ranges(texts, chunk).repartition("key", "range"), paths).write.parquet(parts)
    leaves = spark.read.parquet(parts)
    highest = leaves.agg(F.max("range")).first()[0]
    schema = "key string, n_groups long, links binary, groups_sha256 string"
    if highest is None:
        return spark.createDataFrame([], schema + ", n_a long, n_b long")
    totals = leaves.groupBy("key").agg(F.min("valid").alias("valid"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    sound = leaves.join(totals.where("valid").select("key"), "key", "left_semi")
    between = reduce_tree(sound, highest)
    inner = sound.select("key", "range", F.lit(1).alias("part"), F.lit(None).cast("binary").alias("ids_a"), F.lit(None).cast("binary").alias("ids_b"), "groups", "links", "n_groups")
    closed = between.select("key", "range", F.lit(0).alias("part"), "ids_a", "ids_b", F.lit(b"").alias("groups"), F.lit(b"").alias("links"), F.lit(1).cast("long").alias("n_groups"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups in the order of the text; only the running digest of a document is held."""
        own, last, digest, held = aligner(*paths), None, None, b""

        def done() -> dict:
            digest.update(held[:-1])
            return {"key": last, "n_groups": 0, "links": b"", "groups_sha256": digest.hexdigest()}

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    if r["key"] != last:
                        if last is not None:
                            out.append(done())
                        last, digest, held = r["key"], hashlib.sha256(), b""
                    text, links = r["groups"], r["links"]
                    if r["part"] == 0:
                        a, b = (Side(ids := np.frombuffer(r[c], "<u4").astype(np.int64), ids, np.arange(len(ids)) == len(ids) - 1) for c in ("ids_a", "ids_b"))
                        text, links = write_groups(own, a, b)[0].tobytes(), link_numbers(own, a, b).tobytes()
                    digest.update(held)
                    held = text
                    out.append({"key": last, "n_groups": r["n_groups"], "links": links, "groups_sha256": None})
                yield pa.RecordBatch.from_pylist(out, _schema(schema))
        if last is not None:
            yield pa.RecordBatch.from_pylist([done()], _schema(schema))

    # The digest of a document runs through all of its groups in order.
    ordered = inner.unionByName(closed).repartition("key").sortWithinPartitions("key", "range", "part")
    path = scratch_path(spark, "long")
    written = ordered.mapInArrow(write, schema)
    own_counts = totals.where("valid").select("key", F.lit(0).cast("long").alias("n_groups"), F.lit(b"").alias("links"), F.lit(None).cast("string").alias("groups_sha256"), "n_a", "n_b")
    written.withColumns({"n_a": F.lit(0).cast("long"), "n_b": F.lit(0).cast("long")}).unionByName(own_counts).write.parquet(path)
    return spark.read.parquet(path)


def short_documents(docs: DataFrame, paths: tuple[str, str], kinds: str) -> DataFrame:
    """One row per document (``row, text``) with its groups' digest, counts and links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch, data, bounds in chunks(batches, "text"):
            some = np.flatnonzero(np.diff(bounds))
            found = align_pieces(own, [" " + bytes(data[bounds[i]: bounds[i + 1]]).decode() for i in some])
            text, ends = write_groups(own, found.a, found.b)
            links = link_numbers(own, found.a, found.b)
            counts = np.zeros((3, batch.num_rows), np.int64)
            counts[0, some] = np.bincount(found.a.owner, minlength=len(some))
            counts[1, some] = np.bincount(found.b.owner, minlength=len(some))
            counts[2, some] = np.bincount(found.a.owner[found.a.cut], minlength=len(some))
            last = np.cumsum(counts[2])
            stop = np.r_[0, ends][last]
            start = np.r_[0, stop[:-1]]
            view = memoryview(text)
            digests = [hashlib.sha256(view[i: j - 1]).hexdigest() if j > i else "" for i, j in zip(start.tolist(), stop.tolist())]
            packed = [links[i:j].tobytes() for i, j in zip((last - counts[2]).tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(packed, pa.binary())],
                names=["row", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return docs.select("row", "text").mapInArrow(run, f"row {kinds}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def pair_counts(linked: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``pair, n``: how often each numbered pair is linked by ``links`` times ``copies``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(aligner(*paths).pairs), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                data, bounds = raw_bytes(rows.column(0))
                numbers = np.frombuffer(data.tobytes(), "<u4")
                times = np.repeat(np.asarray(rows.column(1)), np.diff(bounds) // 4)
                if len(numbers):
                    total[: numbers.max() + 1] += np.bincount(numbers, times).astype(np.int64)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["pair", "n"])

    return linked.select("links", "copies").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_sums(linked: DataFrame, counts: np.ndarray, paths: tuple[str, str], kept: str) -> DataFrame:
    """``n_links, n_best, count_sum`` of the links of every row; ``kept`` names the other columns as DDL."""
    sent = linked.sparkSession.sparkContext.broadcast(counts)
    names = [field.split()[0] for field in kept.split("; ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = aligner(*paths), sent.value
        best = np.zeros(len(own.b.entries), np.int64)
        np.maximum.at(best, own.pair_b, held)
        top = held == best[own.pair_b]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                data, bounds = raw_bytes(rows.column(len(names)))
                numbers = np.frombuffer(data.tobytes(), "<u4")
                edges = bounds // 4
                sums = np.r_[0, np.cumsum(held[numbers])][edges], np.r_[0, np.cumsum(top[numbers])][edges]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(names))), pa.array(np.diff(edges)), pa.array(np.diff(sums[1])), pa.array(np.diff(sums[0]))],
                    names=[*names, "n_links", "n_best", "count_sum"])

    return linked.select(*names, "links").mapInArrow(run, f"{kept.replace('; ', ', ')}, n_links long, n_best long, count_sum long")


def align(docs: DataFrame, bytes_path: str, pieces_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``row`` (the columns named by ``keep``), ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    The first tokenizer (byte-level, a file of the tokenizers library) reads a space and the text,
    the second (a sentencepiece model that adds the space itself) the text; strings of special
    tokens are plain text. A link's count is the number of links of its two ids in the whole table.
    ``n_best`` counts the links whose count no other pair of the same second id exceeds.

    A text that is null, empty, or not spelled byte for byte by both tokenizers has zeros and the
    digest ''. Repeated rows count as often as they occur. An empty table gives no rows. Columns of
    any name stay inside ``row``. Long texts are whole; those over ``chunk`` bytes are aligned in
    ranges, every distinct one once.
    """
    spark, paths = docs.sparkSession, (bytes_path, pieces_path)
    body = docs.select(F.struct(*keep).alias("row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    kinds = body.schema["row"].dataType.simpleString()
    path = scratch_path(spark, "aligned")
    short_documents(body.where(F.octet_length("text") <= chunk), paths, kinds).write.parquet(path)
    short = spark.read.parquet(path)
    path = scratch_path(spark, "long-rows")
    large = body.where(F.octet_length("text") > chunk).withColumn("key", F.sha2("text", 256))
    large.select("row", "key").write.parquet(path)
    rows = spark.read.parquet(path)
    parts = long_documents(large.groupBy("key").agg(F.min("text").alias("text")), paths, chunk)
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    path = scratch_path(spark, "pairs")
    linked = short.select("links", F.lit(1).cast("long").alias("copies")).unionByName(parts.join(copies, "key").select("links", "copies"))
    pair_counts(linked, paths).write.parquet(path)
    # One entry for each pair that the two vocabularies allow, whatever the corpus.
    counts = np.zeros(len(aligner(*paths).pairs), np.int64)
    found = spark.read.parquet(path).toArrow()
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    measures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    done = link_sums(short, counts, paths, f"row {kinds}; n_a long; n_b long; n_groups long; groups_sha256 string").select("row", *measures)
    sums = link_sums(parts, counts, paths, "key string; n_a long; n_b long; n_groups long; groups_sha256 string")
    whole = sums.groupBy("key").agg(*(F.sum(m).alias(m) for m in measures[:-1]), F.max("groups_sha256").alias("groups_sha256"))
    late = rows.join(whole, "key", "left").select(
        "row", *(F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in measures[:-1]), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return done.unionByName(late)
