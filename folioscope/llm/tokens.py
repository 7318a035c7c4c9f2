"""Token ids of whole texts, one call of the vocabulary's merges per distinct piece.

The tokenizer splits a text before it merges, and neither published scheme lets a piece reach over
a single space. The bytes of many texts are therefore cut at such spaces, and inside units of ASCII
and accented letters also where letters, digits, signs and line ends meet, as both schemes split there. Every
distinct tile is tokenized once and its ids are kept in a bounded cache; the ids of the texts are
gathered from these. Units with anything else stay whole: those beyond Latin-1 go through the whole
tokenizer, as do texts with an added token's string and tokenizers with any other scheme.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from folioscope.llm.buffers import LOWER

WHITE = r"\t-\r \x85\xa0"
# How the two public schemes split a text.
BYTE_SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORD_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Text that is tokenized together.
BATCH_BYTES = 1 << 20
# Tiles in one half of a cache; 100,000 take about 20 MB of a worker.
ENTRIES = 200_000
# Tiles beyond these bytes are not kept from batch to batch.
KEPT_BYTES = 128

# Kinds of bytes; from APART on, a byte keeps its unit whole.
LETTER, DIGIT, SIGN, SPACE, BREAK, APART, WHITE_APART = range(7)
KINDS = np.full(256, SIGN, np.uint8)
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[0x30:0x3A] = DIGIT
KINDS[0x20] = SPACE
KINDS[0x09:0x0E] = BREAK
KINDS[[0x27, *range(0x80, 0x100)]] = APART
KINDS[0x1C:0x20] = WHITE_APART


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    others = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(others)}


def wide_white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space beyond ASCII."""
    a, b, c = data, np.r_[data[1:], np.uint8(0)], np.r_[data[2:], np.zeros(2, np.uint8)][: len(data)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    three |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    three |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    out = two | three
    out[1:] |= (two | three)[:-1]
    out[2:] |= three[:-2]
    return out


def tile_starts(data: np.ndarray, bounds: np.ndarray, high: bool) -> np.ndarray:
    """First byte of every tile of the texts that ``bounds`` cut ``data`` into; a tile's ids depend on it alone."""
    kinds = KINDS[data]
    if high:
        # Letters with accents; the two other signs of this range keep their unit whole.
        accents = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kinds[accents] = kinds[accents + 1] = LETTER
    space = kinds == SPACE
    white = space | (kinds == BREAK) | (kinds == WHITE_APART)
    if high:
        white |= wide_white(data)
    filled = bounds[1:] > bounds[:-1]
    first, last = bounds[:-1][filled], bounds[1:][filled] - 1
    before, after = np.r_[True, white[:-1]], np.r_[white[1:], True]
    before[first] = after[last] = True
    # One white byte between two others that are not: a space begins a unit, a line end is a tile.
    alone = white & ~before & ~after
    cut = space & alone
    begins = cut.copy()
    begins[first] = True
    whole = (kinds >= APART) | (white & ~alone)
    # The space before a unit belongs to its first tile.
    step = np.r_[False, (kinds[1:] != kinds[:-1]) & ~cut[:-1]]
    if whole.any():
        units = np.flatnonzero(begins)
        kept = np.logical_or.reduceat(whole, units)
        step &= ~np.repeat(kept, np.diff(np.r_[units, len(data)]))
    return np.flatnonzero(begins | step)


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    With ``added`` the string of a special token becomes its id, as the tokenizer does when loaded;
    without it such strings are ordinary text.
    """

    def __init__(self, path: str, entries: int = ENTRIES, added: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.model, self.entries = self.tokenizer.model, entries
        self.symbols = byte_symbols()
        spec = json.loads(self.tokenizer.to_str())
        tokens = [t for t in spec.get("added_tokens") or [] if added or not t["special"]]
        self.added = [t["content"] for t in tokens]
        # Strings that are found in the normalized text can't be looked for in the text itself.
        self.scheme = None if any(t["normalized"] for t in tokens) else self._scheme(spec)
        # Ids of tiles; the older half is kept until the newer is full.
        self.tiles: dict[bytes, bytes] = {}
        self.older_tiles: dict[bytes, bytes] = {}

    @staticmethod
    def _scheme(spec: dict) -> str | None:
        split, plain = spec.get("pre_tokenizer") or {}, not (spec.get("truncation") or spec.get("padding"))
        if not plain or (spec.get("model") or {}).get("type") != "BPE":
            return None
        if split.get("type") == "ByteLevel" and not spec.get("normalizer"):
            return "byte" if split.get("use_regex", True) and not split.get("add_prefix_space") else None
        parts = [p.get("type") for p in split.get("pretokenizers", [])]
        norms = [p.get("type") for p in (spec.get("normalizer") or {}).get("normalizers", [])]
        if parts == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]:
            first = split["pretokenizers"][0]
            same = (first["pattern"] == {"Regex": WORD_PATTERN} and first["behavior"] == "Removed" and first["invert"]
                    and not split["pretokenizers"][1]["use_regex"] and not split["pretokenizers"][1]["add_prefix_space"])
            return "word" if same else None
        return None

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _tile(self, tile: bytes) -> bytes:
        text = tile.decode()
        word = text[1:] if text[:1] == " " else text
        # The usual word of Latin letters needs no pattern.
        if not word.isalpha() or not word.isascii() and max(word) > "\xff":
            return self._unit(text)
        if self.scheme == "word":
            text = word = word.lower()
        if not text.isascii():
            return self._merged(self._shown(text))
        return self._merged(text if text is word else self.symbols[0x20] + word)

    def _unit(self, unit: str) -> bytes:
        if not unit.isascii() and max(unit) > "\xff":
            return self.whole(unit)
        pieces = WORD_SPLIT.findall(unit.lower()) if self.scheme == "word" else BYTE_SPLIT.findall(unit)
        return b"".join([self._merged(self._shown(p)) for p in pieces])

    def _shown(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.symbols)

    def _merged(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. A batch looks every distinct tile up once, in the cache or the vocabulary."""
        if self.scheme is None:
            return [self.whole(t) if t else b"" for t in texts]
        apart = {i: self.whole(t) for i, t in enumerate(texts) if t and any(a in t for a in self.added)}
        bodies = [t.encode() if t and i not in apart else b"" for i, t in enumerate(texts)]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        bounds = np.cumsum([0, *map(len, bodies)])
        found = self._gathered(data, bounds) if len(data) else [b""] * len(texts)
        return [apart.get(i, ids) for i, ids in enumerate(found)]

    def _gathered(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        high = bool(data.max() >= 0x80)
        at = tile_starts(data, bounds, high)
        if self.scheme == "word" and not high:
            data = LOWER[data]
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[at, len(data)]), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        _, ends, held = coded.dictionary.buffers()
        ends, held = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1].tolist(), held.to_pybytes()
        ids = self._looked_up([held[i:j] for i, j in zip(ends[:-1], ends[1:])])
        pool, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        codes = coded.indices.to_numpy()
        own = sizes[codes]
        stop = np.cumsum(own)
        out = pool[np.repeat((np.cumsum(sizes) - sizes)[codes] - stop + own, own) + np.arange(stop[-1])].tobytes()
        of_texts = (np.r_[0, stop][np.searchsorted(at, bounds)] * 4).tolist()
        return [out[i:j] for i, j in zip(of_texts[:-1], of_texts[1:])]

    def _looked_up(self, tiles: list[bytes]) -> list[bytes]:
        if len(self.tiles) + len(tiles) > self.entries:
            self.tiles, self.older_tiles = {}, self.tiles
        known, older = self.tiles, self.older_tiles
        out = list(map(known.get, tiles))
        for i, found in enumerate(out):
            if found is None:
                tile = tiles[i]
                found = older.get(tile)
                if found is None:
                    found = self._tile(tile)
                if len(tile) <= KEPT_BYTES:
                    known[tile] = found
                out[i] = found
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, added: bool = False, entries: int = ENTRIES) -> Iterator[tuple[int | None, bytes]]:
    """Id (first column) and token ids with the end id of every row (text in the second column)."""
    own, end = encoder(path, added, entries), array("I", [end_id]).tobytes()
    for batch in batches:
        sizes = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)])
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BATCH_BYTES, side="right")) - 1)
            rows = batch.slice(at, stop - at)
            for key, ids in zip(rows.column(0).to_pylist(), own.encode_all(rows.column(1).to_pylist())):
                yield key, ids + end
            at = stop


def encoder(path: str, added: bool = False, entries: int = ENTRIES) -> Encoder:
    """One encoder per worker process, vocabulary and reading of added tokens; it and its bounded cache outlive a task."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = Encoder(path, added=added)
    own = _ENCODERS[path, added]
    own.entries = entries
    return own
