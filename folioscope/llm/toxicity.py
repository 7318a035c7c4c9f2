"""Toxic spans by a linear-chain conditional random field with two tags.

Tokens are runs of letters, digits and non-ASCII bytes, described by hashes of the word and of its
beginnings. The field is fitted on tokens labelled by their document's label: a token of a toxic
document is toxic if its word or beginning is found far more often in toxic documents than in
others. Forward-backward marginals of a text's tokens give its toxic spans, and their sum, share and
largest value give the document's score through a logistic function.

With two tags, forward and backward messages are products of 2 x 2 matrices. A chunk of texts is cut
into lanes that advance together, and the products of the lanes connect them, so that long texts
cost no more than short ones. At the first token of a text the matrix forgets what came before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.buffers import LOWER, chunks, prefix_hash, raw_bytes, span_hashes, word_spans
from folioscope.llm.labelled import sample

FEATURES = 1 << 18
# Beginnings of a word that describe it besides the whole word, in bytes.
BEGINNINGS = (4, 5, 6)
LANE = 128
# Sample for fitting: documents per label, and bytes of the longest one.
PER_CLASS, MAX_BYTES = 1000, 1 << 14
# Documents whose messages are held at a time while fitting.
BATCH_DOCS = 200
SPAN_MARGINAL = 0.5
REJECT = 0.7

BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass
class Model:
    """Feature weights of the toxic tag, transition and start weights, and the document's logistic weights."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    outer: np.ndarray


def token_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every token, and its feature numbers (one column for each kind)."""
    starts, ends, rows = word_spans(data, bounds, BREAK)
    prefix = prefix_hash(LOWER[data])
    kinds = [span_hashes(prefix, starts, ends)]
    kinds += [np.where(ends - starts >= n, span_hashes(prefix, starts, np.minimum(starts + n, ends)) + np.uint64(n), np.uint64(0)) for n in BEGINNINGS]
    numbers = np.stack([(k % np.uint64(FEATURES - 1) + np.uint64(1)).astype(np.int64) for k in kinds], 1)
    for i, n in enumerate(BEGINNINGS, 1):
        numbers[ends - starts < n, i] = 0
    return starts, ends, rows, numbers


def advance(matrices: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All vectors ``v[t] = v[t-1] @ matrices[t]``, each scaled to sum 1; ``first`` comes before t = 0."""
    n = len(matrices)
    lanes = -(-n // LANE)
    padded = np.zeros((lanes * LANE, 2, 2))
    padded[:n], padded[n:] = matrices, np.eye(2)
    grid = np.ascontiguousarray(padded.reshape(lanes, LANE, 2, 2).transpose(1, 2, 3, 0))
    if lanes > 1:
        a, b, c, d = (np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes))
        for m in grid:
            a, b, c, d = a * m[0, 0] + b * m[1, 0], a * m[0, 1] + b * m[1, 1], c * m[0, 0] + d * m[1, 0], c * m[0, 1] + d * m[1, 1]
            scale = 1 / (a + b + c + d)
            a, b, c, d = a * scale, b * scale, c * scale, d * scale
        whole = np.stack([a, b, c, d], 1).reshape(lanes, 2, 2)
        heads = np.vstack([first, advance(whole, first)[:-1]])
    else:
        heads = first[None, :]
    out = np.empty((LANE, 2, lanes))
    x, y = heads[:, 0].copy(), heads[:, 1].copy()
    for i, m in enumerate(grid):
        x, y = x * m[0, 0] + y * m[1, 0], x * m[0, 1] + y * m[1, 1]
        scale = 1 / (x + y)
        x, y = x * scale, y * scale
        out[i, 0], out[i, 1] = x, y
    return out.transpose(2, 0, 1).reshape(lanes * LANE, 2)[:n]


def forward_backward(scores: np.ndarray, rows: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of the toxic tag for each token; and both messages with the matrices for the gradient."""
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2)), np.zeros(0, bool)
    opens = np.r_[True, rows[1:] != rows[:-1]]
    emit = np.exp(np.clip(scores, -30, 30))
    matrices = np.broadcast_to(np.exp(moves), (n, 2, 2)).copy()
    matrices[opens] = np.exp(start)[None, None, :]
    matrices[:, :, 1] *= emit[:, None]
    ahead = advance(matrices, np.array([0.5, 0.5]))
    back = np.ones((n, 2)) / 2
    if n > 1:
        back[:-1] = advance(matrices[:0:-1].transpose(0, 2, 1), np.array([0.5, 0.5]))[::-1]
    joint = ahead * back
    marginal = joint[:, 1] / joint.sum(1)
    before = np.vstack([[0.5, 0.5], ahead[:-1]])
    pairs = before[:, :, None] * matrices * back[:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    return marginal, pairs, opens


def outer_features(marginal: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Per text: 1, the log odds of the largest marginal, logs of the sum of marginals and of the number of toxic tokens."""
    most = np.full(n, 1e-4)
    np.maximum.at(most, rows, marginal)
    most = np.minimum(most, 1 - 1e-4)
    hits = np.bincount(rows[marginal >= SPAN_MARGINAL], minlength=n)
    return np.stack([np.ones(n), np.log(most / (1 - most)) / 4, np.log1p(np.bincount(rows, marginal, n)), np.log1p(hits)], 1)


def token_labels(rows: np.ndarray, numbers: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic texts with a feature that marks toxic texts.

    It is in three or more of them, and its share there is at least five times that among the others,
    which are taken to have it three times more often than seen.
    """
    seen = np.unique(rows.repeat(numbers.shape[1]) * FEATURES + numbers.ravel())
    doc, feature = seen // FEATURES, seen % FEATURES
    inside = np.bincount(feature[toxic[doc]], minlength=FEATURES)
    outside = np.bincount(feature[~toxic[doc]], minlength=FEATURES)
    ratio = (inside / max(1, toxic.sum())) / ((outside + 3) / max(1, (~toxic).sum()))
    marks = (inside >= 3) & (ratio >= 5)
    marks[0] = False
    return toxic[rows] & marks[numbers].any(1)


def fit(rows: list[tuple[str, int]], counts: dict[int, int], rounds: int = 40, rate: float = 0.5, ridge: float = 1e-4) -> Model:
    """The field by gradient steps of adaptive size on the labelled tokens of all documents, then the logistic weights.

    A step adds up the gradients of batches of ``BATCH_DOCS`` documents, so memory doesn't grow with their messages.
    """
    rows = sorted(dict(rows).items())
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)), np.array([0.0, -2.0]), np.array([-4.0, 1.0, 0.0, 0.0]))
    toxic = np.asarray([y for _, y in rows], bool)
    if not toxic.any() or toxic.all():
        return model
    data, bounds = raw_bytes(pa.array([t for t, _ in rows], pa.string()))
    _, _, docs, numbers = token_features(data, bounds)
    labels = token_labels(docs, numbers, toxic)
    at = np.searchsorted(docs, np.arange(0, len(rows) + BATCH_DOCS, BATCH_DOCS))
    batches = [(i, j) for i, j in zip(at[:-1], at[1:]) if i < j]
    opens = np.r_[True, docs[1:] != docs[:-1]]
    tag, last = labels.astype(int), np.r_[0, labels[:-1].astype(int)]
    seen_moves = np.bincount((last * 2 + tag)[~opens], minlength=4).reshape(2, 2)
    seen_start = np.bincount(tag[opens], minlength=2)
    held = [np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2)]
    for _ in range(rounds):
        steps = [-ridge * model.weights, seen_moves - ridge * model.moves, seen_start - ridge * model.start]
        for i, j in batches:
            part, first = numbers[i:j], opens[i:j]
            marginal, pairs, _ = forward_backward(model.weights[part].sum(1), docs[i:j], model.moves, model.start)
            steps[0] += np.bincount(part.ravel(), np.repeat(labels[i:j] - marginal, part.shape[1]), FEATURES)
            steps[1] -= pairs[~first].sum(0)
            steps[2] -= pairs[first].sum((0, 1))
        for memory, step in zip(held, steps):
            memory += step * step
        scaled = [rate * step / (np.sqrt(memory) + 1e-8) for memory, step in zip(held, steps)]
        model.weights, model.moves, model.start = model.weights + scaled[0], model.moves + scaled[1], model.start + scaled[2]
    model.weights[0] = 0
    marginal = np.zeros(len(docs))
    for i, j in batches:
        marginal[i:j] = forward_backward(model.weights[numbers[i:j]].sum(1), docs[i:j], model.moves, model.start)[0]
    x = outer_features(marginal, docs, len(rows))
    # Each label weighs as it does among all learning rows.
    share = np.where(toxic, counts[1] / toxic.sum(), counts[0] / (~toxic).sum())
    share = share / share.mean()
    outer, pull = np.zeros(4), 1e-3 * share.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ outer, -30, 30)))
        slope = x.T @ (share * (toxic - p)) - pull * outer
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + pull * np.eye(4)
        step = np.linalg.solve(curve, slope)
        outer = outer + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    model.outer = outer
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded sample of the learning rows: ``per_class`` documents per label of at most ``max_bytes`` bytes."""
    rows, counts = sample(docs, labels, "toxic", per_class, max_bytes)
    return fit(rows, counts)


def tag(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """One row per document: ``row`` (all its columns), ``score, predicted, toxic_tokens, spans``.

    ``score`` lies in 0 to 1, ``predicted`` is 1 from 0.7 on, ``toxic_tokens`` sums the marginals and
    ``spans`` lists character offsets ``[start, end)`` of tokens whose marginal is at least a half.
    Null and empty texts score like texts without a toxic token; repeated rows score alike; an empty
    table gives no rows; other columns stay inside ``row`` and are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.moves, model.start, model.outer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves, start, outer = shared.value
        for batch, data, bounds in chunks(batches, "text"):
            n = batch.num_rows
            starts, ends, rows, numbers = token_features(data, bounds)
            marginal, _, _ = forward_backward(weights[numbers].sum(1, dtype=float), rows, moves, start)
            score = 1 / (1 + np.exp(-np.clip(outer_features(marginal, rows, n) @ outer, -30, 30)))
            points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            hit = marginal >= SPAN_MARGINAL
            spans: list[list] = [[] for _ in range(n)]
            for row, i, j in zip(rows[hit].tolist(), points[starts[hit]].tolist(), points[ends[hit]].tolist()):
                base = int(points[bounds[row]])
                spans[row].append([i - base, j - base])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(score), pa.array((score >= REJECT).astype(np.int32)),
                pa.array(np.bincount(rows, marginal, n)), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["row", "score", "predicted", "toxic_tokens", "spans"])

    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].cast("string").alias("text"))
    inner = held.schema["row"].dataType.simpleString()
    return held.mapInArrow(run, f"row {inner}, score double, predicted int, toxic_tokens double, spans array<array<bigint>>")


