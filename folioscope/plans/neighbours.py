"""Exact nearest neighbours by a partitioned join over cells around pivots.

Reference rows are assigned to the nearest of a bounded number of pivots, drawn by key hash. A point
is first compared with its home cell, which bounds how far its ``k``-th neighbour can be; by the
triangle inequality at the pivots only cells whose radius reaches into that bound can hold a nearer
row. Cells near each other form groups of up to ``GROUP_ROWS`` rows, and a point is sent once to every
group that has an open cell, so that what travels is bounded by the number of groups and not of cells;
inside a task the points of a cell are compared with the cells that are open to them. Large cells are
split into parts and the points of a group into blocks, so a task compares two bounded sets whatever the
size of either side. Nothing but the pivots and one row per cell passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import scratch_path

# At most so many pivots; about the square root of the reference rows otherwise.
MAX_PIVOTS = 1024
# Rows of either side that one task compares at a time.
PART_ROWS = 4096
# Rows of either side that meet in a task after that, of as many cells as hold them. A row travels to about
# rows / GROUP_ROWS tasks at most.
GROUP_ROWS = 16384
# Distances held at a time within one task, few enough to stay in the processor cache.
CELLS = 500_000


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gram = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(gram, 0.0)


def smallest(distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` smallest entries per row, ties kept for the caller."""
    if distances.shape[1] <= k:
        rows, columns = np.indices(distances.shape)
        return rows.ravel(), columns.ravel()
    edge = np.partition(distances, k - 1, axis=1)[:, k - 1 : k]
    return np.nonzero(distances <= edge + 1e-9)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(1))


def ranked(group: np.ndarray, distance: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ranks of the ``k`` nearest entries of every group."""
    order = np.lexsort((tie, distance, group))
    sorted_group = group[order]
    at = np.arange(len(order))
    first = np.r_[True, sorted_group[1:] != sorted_group[:-1]] if len(order) else at.astype(bool)
    rank = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
    kept = rank <= k
    return order[kept], rank[kept]


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def nearest(points: DataFrame, reference: DataFrame, k: int, exclude_self: bool = False, probes: int | None = None) -> DataFrame:
    """``point, neighbour, distance, rank`` for ``points`` (``point, vector``) and ``reference`` (``neighbour, vector``).

    Neighbours are ranked by (distance, key). ``probes`` limits a point to that many cells nearest
    to it, a quality parameter; without it the result is that of comparing all pairs. Of equal
    reference vectors only the ``k + 1`` smallest keys can be neighbours, so further copies are left
    out before the comparison. An empty side gives an empty result.
    """
    spark = points.sparkSession
    schema = f"point {dict(points.dtypes)['point']}, neighbour {dict(reference.dtypes)['neighbour']}, distance double"
    empty = spark.createDataFrame([], schema + ", rank int")
    points = points.select("point", F.col("vector").cast("array<double>").alias("vector"))
    reference = reference.select("neighbour", F.col("vector").cast("array<double>").alias("vector"))
    copies = Window.partitionBy("vector").orderBy("neighbour")
    distinct = reference.withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") <= k + 1).drop("__copy")
    distinct = _kept(distinct, "reference")
    count = distinct.count()
    if not count:
        return empty
    wanted = min(MAX_PIVOTS, max(1, int(count**0.5)))
    drawn = distinct.orderBy(F.xxhash64("neighbour"), "neighbour").limit(wanted).toPandas()
    held = spark.sparkContext.broadcast(_matrix(drawn["vector"]))

    def assign(key: str):
        def run(batches):
            pivots = held.value
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch["vector"])
                cell, far = np.empty(len(x), np.int32), np.empty(len(x))
                for at in range(0, len(x), 2048):
                    part = x[at : at + 2048]
                    cell[at : at + 2048] = squared_distances(part, pivots).argmin(1)
                    far[at : at + 2048] = exact_distances(part, pivots[cell[at : at + 2048]])
                yield batch.assign(cell=cell, far=far)

        return run, f"{key}, vector array<double>, cell int, far double"

    run, kinds = assign(f"neighbour {dict(reference.dtypes)['neighbour']}")
    placed = _kept(distinct.mapInPandas(run, kinds), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"), F.max("far").alias("radius"))
    # One row per pivot at most.
    cells = sizes.toPandas().sort_values("cell", ignore_index=True)
    known = spark.createDataFrame(cells, "cell int, parts int, radius double")
    parted = placed.join(F.broadcast(known.select("cell", "parts")), "cell").select(
        "neighbour", "vector", "cell", F.pmod(F.xxhash64("neighbour"), F.col("parts")).cast("int").alias("part"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"point": left["point"][:0], "neighbour": right["neighbour"][:0], "distance": pd.Series([], dtype=float)})
        if not len(left) or not len(right):
            return none
        right = right.sort_values("neighbour", ignore_index=True)
        own, other, bound = left["point"].to_numpy(), right["neighbour"].to_numpy(), left["bound"].to_numpy()
        x, y = _matrix(left["vector"]), _matrix(right["vector"])
        step, out = max(1, CELLS // len(y)), [none]
        for at in range(0, len(x), step):
            i, j = smallest(squared_distances(x[at : at + step], y), k + 1 if exclude_self else k)
            i = i + at
            if exclude_self:
                apart = own[i] != other[j]
                i, j = i[apart], j[apart]
            distance = exact_distances(x[i], y[j])
            # A row beyond the bound from the home cell is no neighbour.
            within = distance <= bound[i]
            i, j, distance = i[within], j[within], distance[within]
            best, _ = ranked(i, distance, j, k)
            out.append(pd.DataFrame({"point": own[i[best]], "neighbour": other[j[best]], "distance": distance[best]}))
        return pd.concat(out[1:]) if len(out) > 1 else none

    def against(asked: DataFrame) -> DataFrame:
        """Best rows of every (point, cell) pair of ``asked``, part by part."""
        blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("blocks"))
        sent = asked.join(blocks, "cell").join(F.broadcast(known.select("cell", "parts")), "cell").select(
            "point", "vector", "bound", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int").alias("block"))
        copied = parted.join(blocks, "cell").select("neighbour", "vector", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        by = ["cell", "part", "block"]
        return sent.groupBy(*by).cogroup(copied.groupBy(*by)).applyInPandas(lambda left, right: compare(left, right), schema)

    run, kinds = assign(f"point {dict(points.dtypes)['point']}")
    homes = _kept(points.mapInPandas(run, kinds), "points")
    first = _kept(against(homes.withColumn("bound", F.lit(float("inf")))), "near")
    order = Window.partitionBy("point").orderBy("distance", "neighbour")
    if probes == 1 or len(cells) == 1:
        return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    bounds = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("point", F.col("distance").alias("bound"))
    number, radius = cells["cell"].to_numpy(), cells["radius"].to_numpy()
    # One row per pivot on either side.
    held_rows = placed.groupBy("cell").count().toPandas().set_index("cell")["count"]
    own_rows = homes.groupBy("cell").count().toPandas().set_index("cell")["count"]
    place = cell_order(_matrix(drawn["vector"]))
    group, block = cell_groups(held_rows, place), cell_groups(own_rows, place)
    group_of = np.full(wanted, -1, np.int32)
    group_of[group["cell"]] = group["group"]
    groups, blocks = spark.createDataFrame(group, "cell int, group int, parts int"), spark.createDataFrame(block, "cell int, group int, parts int")

    def open_cells(x: np.ndarray, home: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells, in the order of ``number``, may hold a neighbour; not the home cell."""
        away = np.sqrt(squared_distances(x, held.value[number]))
        at_home = number == home[:, None]
        # Rounding of the fast distances must not rule a cell out.
        slack = 1e-6 * (1 + away + radius)
        open_ = (away - radius <= bound[:, None] + slack) & ~at_home
        if probes is not None and probes - 1 < open_.shape[1]:
            open_ &= away <= np.partition(np.where(at_home, -1, away), probes - 1, axis=1)[:, probes - 1 : probes]
        return open_

    point = f"point {dict(points.dtypes)['point']}, vector array<double>, cell int, bound double"

    def reach(batches):
        for batch in batches:
            x, home, bound = _matrix(batch["vector"]) if len(batch) else None, batch["cell"].to_numpy(), batch["bound"].fillna(np.inf).to_numpy()
            groups = []
            for at in range(0, len(batch), 1024):
                part = slice(at, at + 1024)
                open_ = open_cells(x[part], home[part], bound[part])
                groups += [np.unique(group_of[number[row]]) for row in open_]
            if len(batch):
                yield pd.DataFrame({"point": batch["point"], "vector": batch["vector"], "cell": home, "bound": bound, "groups": groups})

    def compare_open(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Neighbours of the points of a block among the rows of a group, the points of a cell at a time."""
        out = [pd.DataFrame({"point": left["point"][:0], "neighbour": right["neighbour"][:0], "distance": pd.Series([], dtype=float)})]
        if not len(left) or not len(right):
            return out[0]
        right, left = right.sort_values(["cell", "neighbour"], ignore_index=True), left.sort_values("cell", ignore_index=True)
        own, bound, home, cell = left["point"].to_numpy(), left["bound"].to_numpy(), left["cell"].to_numpy(), right["cell"].to_numpy()
        other, x, y = right["neighbour"].to_numpy(), _matrix(left["vector"]), _matrix(right["vector"])
        open_ = open_cells(x, home, bound)
        # Rank of a row by its key, which settles ties of the distance.
        tie = np.empty(len(other), np.int64)
        tie[np.argsort(other, kind="stable")] = np.arange(len(other))
        # Points of one cell, a bounded number of them, against the cells that any of these has open.
        starts = np.r_[0, np.flatnonzero(home[1:] != home[:-1]) + 1, len(home)]
        for begin, end in zip(starts[:-1], starts[1:]):
            for at in range(begin, end, max(1, CELLS // len(y))):
                rows = np.arange(at, min(at + max(1, CELLS // len(y)), end))
                columns = np.flatnonzero(np.isin(cell, number[open_[rows].any(0)]))
                if not len(columns):
                    continue
                i, j = smallest(squared_distances(x[rows], y[columns]), k + 1 if exclude_self else k)
                i, j = rows[i], columns[j]
                if exclude_self:
                    apart = own[i] != other[j]
                    i, j = i[apart], j[apart]
                distance = exact_distances(x[i], y[j])
                # A row beyond the bound from the home cell is no neighbour; nor is one of a cell that was not asked.
                within = (distance <= bound[i]) & open_[i, np.searchsorted(number, cell[j])]
                i, j, distance = i[within], j[within], distance[within]
                best, _ = ranked(i, distance, tie[j], k)
                out.append(pd.DataFrame({"point": own[i[best]], "neighbour": other[j[best]], "distance": distance[best]}))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    def parted_by(rows: DataFrame, key: str, of: DataFrame, name: str) -> DataFrame:
        """Rows with the number of their group and part, in the columns ``name`` and ``name`` + 'part'."""
        part = F.pmod(F.xxhash64(key), F.col("parts")).cast("int")
        return rows.join(F.broadcast(of), "cell").withColumns({name: F.col("group"), name + "part": part}).drop("group", "parts")

    asked = _kept(homes.drop("far").join(bounds, "point", "left").mapInPandas(reach, point + ", groups array<int>"), "asked")
    sent = parted_by(asked, "point", blocks, "block").withColumn("side", F.explode("groups")).drop("groups")
    ahead = groups.select(F.col("group").alias("side"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sidepart")).distinct()
    by = ["block", "blockpart", "side", "sidepart"]
    sent = sent.join(F.broadcast(ahead), "side")
    # Blocks and groups that meet: a row for every two of them at most.
    meeting = _kept(sent.select(*by).distinct(), "meeting")
    copied = parted_by(placed.drop("far"), "neighbour", groups, "side").join(meeting, ["side", "sidepart"])
    both = first.unionByName(sent.groupBy(*by).cogroup(copied.groupBy(*by)).applyInPandas(compare_open, schema))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cell_order(pivots: np.ndarray) -> np.ndarray:
    """Places of the pivots along the direction in which they vary most, so that neighbours in it form groups."""
    centred = pivots - pivots.mean(0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    out = np.empty(len(pivots), np.int64)
    out[np.argsort(along, kind="stable")] = np.arange(len(pivots))
    return out


def cell_groups(rows: pd.Series, place: np.ndarray) -> pd.DataFrame:
    """``cell, group, parts``: cells in the order of ``place``, as many a group as hold ``GROUP_ROWS`` rows; a larger cell is split."""
    cells, groups, parts, now, held = sorted(rows.index, key=lambda c: place[c]), [], [], -1, GROUP_ROWS
    for c in cells:
        n = int(rows[c])
        if held + n > GROUP_ROWS:
            now, held = now + 1, 0
        held += n
        groups.append(now)
        parts.append(max(1, -(-n // GROUP_ROWS)))
    return pd.DataFrame({"cell": np.array(cells, np.int32), "group": np.array(groups, np.int32), "parts": np.array(parts, np.int32)})


def nearest_to_points(
    points: DataFrame, reference: DataFrame, key: str, vector: str, k: int, exclude_self: bool = False, probes: int | None = None,
) -> DataFrame:
    """``k`` nearest reference rows of every point: ``key``, ``neighbour``, ``distance``, ``rank``."""
    found = nearest(
        points.select(F.col(key).alias("point"), F.col(vector).alias("vector")),
        reference.select(F.col(key).alias("neighbour"), F.col(vector).alias("vector")), k, exclude_self, probes)
    return found.withColumnRenamed("point", key)


def nearest_to_queries(
    corpus: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str, k: int, probes: int | None = None,
) -> DataFrame:
    """``k`` nearest corpus rows of every query: ``query_key``, ``key``, ``distance``, ``rank``."""
    found = nearest(
        queries.select(F.col(query_key).alias("point"), F.col(query_vector).alias("vector")),
        corpus.select(F.col(key).alias("neighbour"), F.col(vector).alias("vector")), k, False, probes)
    return found.select(F.col("point").alias(query_key), F.col("neighbour").alias(key), "distance", "rank")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
