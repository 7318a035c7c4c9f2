"""The density of every row from the neighbour graph, against the exact search and by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.catalog import QUERIES, models
from folioscope.operators import features, outliers, scoring
from folioscope.plans import neighbours, proximity

FOLDER = "/root/testdata/sf0.001"


def brute(matrix, k, novelty=False):
    """k-distance, density and factor of every row, copies being rows of their own."""
    gram = (matrix * matrix).sum(1)
    d = np.sqrt(np.maximum(gram[:, None] + gram[None] - 2 * matrix @ matrix.T, 0))
    d[(d < 1e-6)] = 0
    alone = d.copy()
    np.fill_diagonal(alone, np.inf)
    near = np.argsort(alone, axis=1, kind="stable")[:, :k]
    k_distance = np.take_along_axis(alone, near, 1).max(1)
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), k_distance[near]).mean(1) + 1e-10)
    if not novelty:
        return k_distance, lrd, lrd[near].mean(1) / lrd
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    own = 1 / (np.maximum(np.take_along_axis(d, near, 1), k_distance[near]).mean(1) + 1e-10)
    return k_distance, lrd, lrd[near].mean(1) / own


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 5)) * rng.uniform(0.2, 2, size=(700, 1))
    # Copies of one vector beyond k, and pairs.
    x[100:140], x[200:220] = x[0], x[220:240]
    return x


def frame(spark, matrix, parts=5):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "id long, vec array<double>").repartition(parts)


def test_density_from_the_graph_equals_brute_force(spark, matrix):
    df = frame(spark, matrix)
    found = df.select(F.col("id").alias("row"), proximity.vector_id("vec").alias("id")).join(outliers.graph_density(df, "vec", 12), "id")
    rows = {r.row: r for r in found.collect()}
    assert sorted(rows) == list(range(700))
    # Rows with ties at the edge of their lists may take another of the tied ones.
    for name, novelty in (("lof", False), ("novelty", True)):
        k_distance, lrd, factor = brute(matrix, 12, novelty)
        np.testing.assert_allclose([rows[i].k_distance for i in range(700)], k_distance, rtol=1e-5, atol=1e-6)
        some = [i for i in range(700) if k_distance[i] > 0]
        np.testing.assert_allclose([rows[i].lrd for i in some], lrd[some], rtol=1e-4)
        close = np.isclose([rows[i][name] for i in some], factor[some], rtol=1e-3)
        assert close.mean() > 0.98


def test_rows_without_a_vector_and_no_rows(spark, matrix):
    df = frame(spark, matrix[:30])
    odd = df.unionByName(spark.createDataFrame([(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5)], "id long, vec array<double>"))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(outliers.graph_density(odd, "vec", 5)) == key(outliers.graph_density(df, "vec", 5))
    assert outliers.graph_density(df.where("id < 0"), "vec", 5).count() == 0
    alone = outliers.graph_density(df.where("id = 3"), "vec", 5).collect()
    assert len(alone) == 1 and alone[0].k_distance == 0


@pytest.mark.parametrize("ways", [256, 4])
def test_recall_and_block_sizes(spark, monkeypatch, ways):
    """Blocks of a few hundred rows, cut in one level or in several, against the exact join."""
    monkeypatch.setattr(proximity, "USUAL_ROWS", 250)
    monkeypatch.setattr(proximity, "BLOCK_ROWS", 500)
    monkeypatch.setattr(proximity, "WAYS", ways)
    monkeypatch.setattr(proximity, "SAMPLE_ROWS", 64 if ways == 256 else 256)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 7)) * rng.uniform(0.2, 1, size=(6000, 1))
    df = frame(spark, x)
    vectors = proximity.distinct_vectors(df, "vec")
    placed = proximity.cut_into_blocks(vectors, 6000, 4, 42)
    sizes = placed.groupBy("cut", "cell").count().collect()
    assert sum(r["count"] for r in sizes) == 24_000 and max(r["count"] for r in sizes) <= 800
    found = {cuts: {(r.id, i) for r in proximity.neighbour_graph(vectors, 10, cuts).collect() for i in r.ids} for cuts in (4, 8)}
    points = vectors.select("id", "vector")
    exact = {(r.id, r.neighbour) for r in neighbours.nearest_to_points(points, points, "id", "vector", 10, exclude_self=True).collect()}
    recall = {cuts: len(exact & pairs) / len(exact) for cuts, pairs in found.items()}
    # Blocks of 250 rows are far smaller than usual; more cuts make up for it.
    assert len(exact) == 60_000 and recall[4] > 0.75 and recall[8] > 0.92


def test_the_graph_does_not_depend_on_the_layout(spark, matrix):
    key = lambda d: sorted((r.id, tuple(r.ids), r.k_distance) for r in d.collect())
    graphs = [proximity.neighbour_graph(proximity.distinct_vectors(frame(spark, matrix, parts), "vec"), 6) for parts in (2, 9)]
    assert key(graphs[0]) == key(graphs[1])


def test_registered_queries_score_every_row(spark):
    rows = models.model_rows(spark, FOLDER)
    scaled = scoring.apply_scaler(rows, scoring.fit_scaler(rows, models.MODEL)).select("pk", F.array(*models.MODEL).alias("vector")).collect()
    x = np.asarray([r.vector for r in scaled])
    rows = QUERIES["m9_novelty_scores"](spark, FOLDER).collect()
    found = {r.pk: r.lof for r in rows}
    # One key occurs twice.
    assert len(rows) == len(scaled) == len(found) + 1 and len(set(features.ACT_FEATURES)) == 23
    expected = dict(zip([r.pk for r in scaled], brute(x, 20, True)[2]))
    assert np.corrcoef([found[pk] for pk in found], [expected[pk] for pk in found])[0, 1] > 0.99
    scores = QUERIES["m21_table_scored"](spark, FOLDER)
    assert scores.count() == len(rows) and scores.where("anomaly_score is null").count() == 0
