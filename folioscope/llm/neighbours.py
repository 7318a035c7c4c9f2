"""Quality by the vote of the nearest labelled documents in a latent-semantic space.

Texts are counted as hashed byte trigrams and as 4-grams of character classes, weighted by log
frequency and inverse document frequency, and projected onto the leading singular directions of a
bounded labelled sample. The sample's vectors are broadcast; every document is compared with all of
them in blocks (exact cosine products) and its nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.buffers import chunks, mixed, raw_bytes
from folioscope.llm.labelled import sample

BYTE_CELLS, CLASS_CELLS = 4096, 2048
CELLS = BYTE_CELLS + CLASS_CELLS
DIRECTIONS = 48
# Labelled reference: documents per label, and bytes of the longest one.
PER_CLASS, MAX_BYTES = 1200, 1 << 15
NEAREST, SHARPNESS = 15, 6.0
# Texts counted together.
ROWS = 256

CLASS = np.arange(256, dtype=np.uint8)
CLASS[ord("A"): ord("Z") + 1] = ord("A")
CLASS[ord("a"): ord("z") + 1] = ord("a")
CLASS[ord("0"): ord("9") + 1] = ord("0")
CLASS[0x80:] = 0x80


@dataclass
class Space:
    """Weights of the cells, directions, and the labelled vectors with what each vote weighs."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray


def cell_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of every cell for each text."""
    n = len(bounds) - 1
    out = np.zeros((n, CELLS), np.float32)
    rows = np.repeat(np.arange(n), np.diff(bounds))
    for values, size, cells, at in ((data, 3, BYTE_CELLS, 0), (CLASS[data], 4, CLASS_CELLS, BYTE_CELLS)):
        if len(data) < size:
            continue
        wide = values.astype(np.uint64)
        packed = np.zeros(len(data) - size + 1, np.uint64)
        for i in range(size):
            packed = packed << np.uint64(8) | wide[i: len(wide) - size + 1 + i]
        cell = (mixed(packed) % np.uint64(cells)).astype(np.int64)
        inside = rows[: len(packed)] == rows[size - 1:]
        counts = np.bincount(rows[: len(packed)][inside] * cells + cell[inside], minlength=n * cells)
        out[:, at: at + cells] = counts.reshape(n, cells)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def fit(rows: list[tuple[str, int]], counts: dict[int, int]) -> Space:
    """Cell weights, directions by a randomized decomposition of the sample, and its vectors."""
    labels = np.asarray([y for _, y in rows], np.int64)
    if not len(rows):
        return Space(np.ones(CELLS, np.float32), np.zeros((CELLS, 1), np.float32), np.zeros((0, 1), np.float32), labels, np.zeros(0))
    data, bounds = raw_bytes(pa.array([t for t, _ in rows], pa.string()))
    terms = np.vstack([cell_counts(data[bounds[i]: bounds[min(i + ROWS, len(rows))]], bounds[i: i + ROWS + 1] - bounds[i]) for i in range(0, len(rows), ROWS)])
    idf = np.log((1 + len(rows)) / (1 + (terms > 0).sum(0))).astype(np.float32) + 1
    terms = scaled(np.log1p(terms) * idf)
    rng = np.random.default_rng(11)
    basis = np.linalg.qr(terms @ rng.standard_normal((CELLS, min(DIRECTIONS + 16, len(rows)))).astype(np.float32))[0]
    for _ in range(3):
        basis = np.linalg.qr(terms @ (terms.T @ basis))[0]
    _, _, directions = np.linalg.svd(basis.T @ terms, full_matrices=False)
    directions = np.ascontiguousarray(directions[:DIRECTIONS].T)
    # Votes weigh as the labels do among all learning rows, whatever their share of the sample.
    share = {y: counts.get(y, 0) / max(1, (labels == y).sum()) for y in (0, 1)}
    return Space(idf, directions, scaled(terms @ directions), labels, np.asarray([share[y] for y in labels.tolist()]))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Space:
    """Fit on a bounded sample of the learning rows: ``per_class`` documents per label of at most ``max_bytes`` bytes."""
    return fit(*sample(docs, labels, "quality", per_class, max_bytes))


def vote(vectors: np.ndarray, space: Space) -> np.ndarray:
    """Share of label 1 in the similarity-weighted vote of the nearest labelled vectors."""
    if not len(space.labels):
        return np.full(len(vectors), 0.5)
    near = vectors @ space.vectors.T
    k = min(NEAREST, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    power = np.maximum(np.take_along_axis(near, top, 1), 1e-3).astype(float) ** SHARPNESS * space.weights[top]
    found = (power * space.labels[top]).sum(1) / power.sum(1)
    found[~vectors.any(1)] = (space.weights * space.labels).sum() / space.weights.sum()
    return found


def score(docs: DataFrame, space: Space, text: str = "text") -> DataFrame:
    """One row per document: ``row`` (all its columns), ``score, predicted``; predicted is 1 from 0.5 on.

    Null and empty texts have no direction and get the share of label 1 among the learning rows; repeated
    rows score alike; an empty table gives no rows; columns stay inside ``row`` and only the text is
    looked at. Texts are counted whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch, data, bounds in chunks(batches, "text"):
            found = []
            for i in range(0, batch.num_rows, ROWS):
                edge = bounds[i: i + ROWS + 1]
                terms = np.log1p(cell_counts(data[edge[0]: edge[-1]], edge - edge[0])) * space.idf
                found.append(vote(scaled(terms @ space.directions), space))
            value = np.clip(np.concatenate(found), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].cast("string").alias("text"))
    inner = held.schema["row"].dataType.simpleString()
    return held.mapInArrow(run, f"row {inner}, score double, predicted int")
