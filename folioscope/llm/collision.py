"""Approximate nearest neighbours by collision counting over single random projections.

The index holds, for every shard of vectors, one sorted array per random projection. A query looks
at the windows around its own projections; their width grows by virtual rehashing (the same arrays,
a wider window, only the new margins are read). A vector that falls into the windows of enough
projections has collided often enough to be verified with its exact cosine. The search of a shard
ends when as many verified vectors as asked for lie within the radius the windows stand for; the
last width takes in everything, so a shard always gives an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import scratch_path

PROJECTIONS = 64
# A vector at the radius collides in a projection with probability 0.9; being verified takes this share.
HALF_WIDTH, THRESHOLD = 1.645, 0.78
FIRST_RADIUS, GROWTH = 0.1, 1.5
# Vectors of one shard, and queries that travel together.
SHARD_ROWS, BLOCK_QUERIES = 40_000, 256

INDEX = "dim int, shard long, ids binary, vectors binary, order binary, places binary, copies binary"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part, with ``dim``."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    present = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return present.where(~bad).where(F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def projections(dim: int, count: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, count))


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def build_index(vectors: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard, written once to the shared folder. Every usable vector is in it.

    Equal vectors of a shard are one entry with their ``k + 1`` smallest ids: with ties going to the
    smaller id, no other copy can be among the ``k`` nearest of a query.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    shards = max(1, -(-rows.count() // shard_rows))

    def pack(group: pa.Table) -> pa.Table:
        dim, shard = group["dim"][0].as_py(), group["shard"][0].as_py()
        group = group.sort_by("vec_id").combine_chunks()
        ids = group["vec_id"].to_numpy()
        matrix = group["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        _, first, which = np.unique(np.ascontiguousarray(matrix).view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        counts = np.bincount(which)
        nth = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = order[nth <= k]
        kept = np.minimum(counts, k + 1)
        own = matrix[first]
        places = unit(own) @ projections(dim)
        ranks = np.argsort(places, axis=0, kind="stable")
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()),
            "vectors": pa.array([own.tobytes()], pa.binary()), "order": pa.array([ranks.T.astype("<i4").tobytes()], pa.binary()),
            "places": pa.array([np.take_along_axis(places, ranks, 0).T.astype("<f4").tobytes()], pa.binary()),
            "copies": pa.array([kept.astype("<i4").tobytes()], pa.binary())})

    path = scratch_path(spark, "projection-index")
    rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("dim", "shard").applyInArrow(pack, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Shard:
    def __init__(self, dim: int, ids: bytes, vectors: bytes, order: bytes, places: bytes, copies: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.vectors = np.frombuffer(vectors, "<f8").reshape(-1, dim)
        self.unit = unit(self.vectors)
        n = len(self.vectors)
        self.order = np.frombuffer(order, "<i4").reshape(PROJECTIONS, n)
        self.places = np.frombuffer(places, "<f4").reshape(PROJECTIONS, n)
        self.copies = np.frombuffer(copies, "<i4")
        self.first = np.cumsum(self.copies) - self.copies

    def entries(self, query: np.ndarray, projected: np.ndarray, k: int) -> np.ndarray:
        """Verified entries, enough for the ``k`` nearest with the query itself left out."""
        n, needed = len(self.vectors), int(np.ceil(THRESHOLD * PROJECTIONS))
        counts, checked = np.zeros(n, np.int16), np.zeros(n, bool)
        low = high = None
        radius, found, near = FIRST_RADIUS, np.zeros(0, np.int64), np.zeros(0)
        while True:
            reach = HALF_WIDTH * radius
            left = np.asarray([np.searchsorted(p, x - reach) for p, x in zip(self.places, projected)])
            right = np.asarray([np.searchsorted(p, x + reach, side="right") for p, x in zip(self.places, projected)])
            if low is None:
                parts = [o[i:j] for o, i, j in zip(self.order, left, right)]
            else:
                parts = [o[i:j] for o, i, j in zip(self.order, left, low)] + [o[i:j] for o, i, j in zip(self.order, high, right)]
            counts += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
            low, high = left, right
            new = np.flatnonzero((counts >= needed) & ~checked)
            checked[new] = True
            found = np.r_[found, new]
            near = np.r_[near, self.unit[new] @ query]
            # Cosine of vectors within the radius of a unit vector.
            inside = near >= 1 - radius * radius / 2
            size = self.copies[found[inside]].sum()
            if size > k or len(found) == n:
                return found
            radius *= GROWTH


def search(index: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found by cosine, ties to the smaller id.

    Queries are rows like those of the index and never find a row of their own id. Rows whose vector
    is null, zero or holds a null or non-finite component take no part on either side, nor do null
    ids; vectors of another length than the query's are no candidates. Of rows repeated with id and
    vector a query reports one. Fewer candidates than ``k`` give fewer rows; empty tables give none.
    """
    asked = usable(queries, vec_id, embedding).dropDuplicates()
    blocks = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // BLOCK_QUERIES)))).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    shards = index.select(F.col("dim"), "shard").groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    placed = blocks.join(shards, "dim").select("dim", "block", "queries", F.explode("shards").alias("shard"))
    # Searches are few and costly, so they are spread by a stated number; by their bytes they would meet in one task.
    searches = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // 2)
    joined = placed.join(index, ["dim", "shard"]).repartition(searches, "dim", "shard", "block").drop("block").sortWithinPartitions("dim", "shard")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i] for c, name in enumerate(batch.schema.names)}
                dim, number = row["dim"].as_py(), row["shard"].as_py()
                if (dim, number) != held:
                    held, shard = (dim, number), Shard(dim, *(row[c].as_py() for c in ("ids", "vectors", "order", "places", "copies")))
                values = row["queries"].values
                own = values.field("vec_id").to_numpy()
                matrix = values.field("vector").flatten().to_numpy().reshape(-1, dim)
                units, out = unit(matrix), ([], [], [])
                projected = units @ projections(dim)
                for q, vector, direction, places in zip(own, matrix, units, projected):
                    entries = shard.entries(direction, places.astype("<f4"), k)
                    near = shard.unit[entries] @ direction
                    # Exact scores only where they can matter.
                    edge = np.partition(-near, min(len(near), k + 1) - 1)[min(len(near), k + 1) - 1]
                    entries = entries[-near <= edge + 1e-9]
                    a = shard.vectors[entries]
                    exact = (a * vector).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((vector * vector).sum()))
                    exact = np.where(np.isfinite(exact), exact, shard.unit[entries] @ direction)
                    which = np.repeat(np.arange(len(entries)), shard.copies[entries])
                    at = np.concatenate([np.arange(shard.first[e], shard.first[e] + shard.copies[e]) for e in entries])
                    ids, scores = shard.ids[at], exact[which]
                    ids, scores = ids[ids != q], scores[ids != q]
                    best = np.lexsort((ids, -scores))[:k]
                    out[0].append(np.full(len(best), q))
                    out[1].append(ids[best])
                    out[2].append(scores[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    found = joined.mapInArrow(find, "query_id long, vec_id long, score double").dropDuplicates()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
