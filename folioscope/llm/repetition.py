"""Quality rules by repetition coverage: characters inside duplicated word n-grams and lines.

Rolling hashes of several n-gram lengths are computed in NumPy over whole chunks of documents; a
character counts once per length however many duplicated n-grams cover it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.buffers import chunks, prefix_hash, span_hashes, window_hashes, within_rows, word_spans

# Largest share of word characters that duplicated n-grams of each length may cover, and the
# shares of lines and of characters in them that may repeat an earlier line.
COVERED = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINES, LINE_CHARS = 0.30, 0.20
MIN_WORDS, MAX_REPEAT = 50, 50

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", " + ", ".join(f"covered_{n} long" for n in COVERED)


def duplicated(rows: np.ndarray, hashes: np.ndarray, later_only: bool = False) -> np.ndarray:
    """Items whose (row, hash) occurs more than once; with ``later_only`` not the first of them."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    same = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    marked = np.r_[False, same]
    if not later_only:
        marked |= np.r_[same, False]
    out = np.zeros(len(rows), bool)
    out[order] = marked[: len(rows)]
    return out


def covered_words(starts: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of ``count`` words lie in a window of ``n`` words beginning at one of the starts."""
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def line_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line; the end of a text ends its last line."""
    breaks = np.flatnonzero(data == 0x0A)
    texts, inside = np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, side="right") - 1
    starts, start_rows = np.r_[bounds[:-1], breaks + 1], np.r_[texts, inside]
    ends, end_rows = np.r_[breaks, bounds[1:]], np.r_[inside, texts]
    by_start, by_end = np.lexsort((starts, start_rows)), np.lexsort((ends, end_rows))
    return starts[by_start], ends[by_end], end_rows[by_end]


def measure_chunk(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """All counts for each text of a chunk."""
    n = len(bounds) - 1
    starts, ends, rows = word_spans(data, bounds)
    prefix = prefix_hash(data)
    words = span_hashes(prefix, starts, ends)
    # Code points: bytes that do not continue one.
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    chars = points[ends] - points[starts]

    def per_row(where: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(where, weights, minlength=n).astype(np.int64)

    out = {"n_words": per_row(rows), "word_chars": per_row(rows, chars)}
    symbols = np.r_[0, np.cumsum(SYMBOL[data])]
    out["n_symbols"] = symbols[bounds[1:]] - symbols[bounds[:-1]]

    line_starts, line_ends, line_rows = line_spans(data, bounds)
    solid = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_rows = line_starts[solid], line_ends[solid], line_rows[solid]
    again = duplicated(line_rows, span_hashes(prefix, line_starts, line_ends), later_only=True)
    out["n_lines"], out["n_dup_lines"] = per_row(line_rows), per_row(line_rows[again])
    out["dup_line_chars"] = per_row(line_rows[again], (points[line_ends] - points[line_starts])[again])

    for size in (3, *COVERED):
        inside = np.flatnonzero(within_rows(rows, size))
        hashes = window_hashes(words, size)[inside]
        hit = inside[duplicated(rows[inside], hashes)]
        covered = covered_words(hit, size, len(words))
        if size == 3:
            out["n_repeat_words"] = per_row(rows[covered])
        else:
            out[f"covered_{size}"] = per_row(rows[covered], chars[covered])
    return out


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base verdict and verdict of every document.

    Columns: ``doc_id``, the counts of ``COLUMNS``, ``covered_n`` characters for each length,
    ``base_failed`` (fewer than 50 words, or over half of them in repeated 3-word windows) and
    ``kept`` (base passed, and no coverage above its limit). Null or empty text has zero counts and
    fails the base; repeated rows are judged each for itself; a null ``doc_id`` stays; an empty table
    gives no rows; other columns are ignored. Whole texts are read, whatever their length.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for rows, data, bounds in chunks(batches, "text"):
            found = measure_chunk(data, bounds)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(found[c], pa.int64()) for c in names[1:]]], names=names)

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = narrow.mapInArrow(judge, SCHEMA)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    fine = (F.col("n_dup_lines") <= LINES * F.col("n_lines")) & (F.col("dup_line_chars") <= LINE_CHARS * F.col("word_chars"))
    for n, limit in COVERED.items():
        fine &= F.col(f"covered_{n}") <= limit * F.col("word_chars")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
