"""Joins, quantiles, ranks and neighbours under skew, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import outliers, property
from folioscope.plans import joins, neighbours
from folioscope.plans.quantiles import exact_quantiles, quantiles
from folioscope.plans.ranks import value_positions
from folioscope.sources import writers


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, copies among them, NULL keys and NULL values."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(6000):
        group = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"g{rng.integers(200)}")
        value = None if i % 41 == 0 else (5.0 if i % 6 == 0 else float(np.round(rng.normal() * 10 ** rng.integers(0, 9), 3)))
        rows.append((i, group, value))
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(7).persist()


@pytest.mark.parametrize("hot_rows", [1, 100, 10**9])
def test_group_stats(skewed, hot_rows):
    stats = skewed.groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    joined = joins.attach_group_stats(skewed, stats, ["g"], "n", hot_rows)
    expected = skewed.where("g IS NOT NULL").join(stats, "g").select("id", "g", "v", "n", "m")
    expected = expected.unionByName(skewed.where("g IS NULL"), allowMissingColumns=True)
    assert sorted(map(tuple, joined.select("id", "n").collect()), key=str) == sorted(map(tuple, expected.select("id", "n").collect()), key=str)
    assert joined.exceptAll(expected.select(joined.columns)).count() == 0


@pytest.mark.parametrize("max_rows", [0, 10**6])
def test_lookup(skewed, max_rows):
    stats = skewed.groupBy("g").agg(F.count("*").alias("n"))
    joined = joins.attach_lookup(skewed, stats, ["g"], null_safe=True, max_rows=max_rows)
    assert joined.where("n IS NULL").count() == 0 and joined.count() == 6000


@pytest.mark.parametrize("max_targets", [0, 10**6])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles(skewed, keys, max_targets):
    probs = {"q0": 0.0, "q05": 0.05, "q5": 0.5, "q95": 0.95, "q1": 1.0}
    pdf = skewed.toPandas()
    found = exact_quantiles(skewed, keys, "v", probs, max_targets).collect()
    groups = [(None, pdf)] if not keys else list(pdf.groupby("g")) + [(None, pdf[pdf["g"].isna()])]
    expected = {}
    for name, part in groups:
        values = part["v"].dropna()
        if len(values):
            expected[name] = np.quantile(values, list(probs.values()))
    assert len(found) == len(expected)
    for row in found:
        np.testing.assert_allclose([row[p] for p in probs], expected[row.g if keys else None], rtol=1e-12)


def test_quantile_sketch(skewed):
    row = quantiles(skewed, [], "v", {"m": 0.5}, accuracy=10_000).first()
    assert row.m == pytest.approx(np.median(skewed.toPandas()["v"].dropna()), abs=5)


def test_value_positions(skewed):
    found = value_positions(skewed.where("g IS NOT NULL"), ["g"], "v").collect()
    pdf = skewed.toPandas().dropna()
    for row in found[::37]:
        values = pdf[pdf.g == row.g]["v"]
        assert (row.below, row["size"], row.copies) == ((values < row.v).sum(), len(values), (values == row.v).sum())


def transactions(spark, n, hot):
    """``hot`` of ``n`` rows are of one property, several on a day and some without a date."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7919 % 500).cast("int"))
    return spark.range(n).select(
        F.col("id").cast("string").alias("pk"), F.when(F.col("id") < hot, "hot").otherwise(F.col("id").cast("string")).alias("matricula"),
        F.when(F.col("id") % 97 > 0, day).alias("fecha_radicacion"), F.lit(1e8).alias("valor_acto"),
        F.lit("A").alias("departamento"), F.lit("B").alias("municipio"), F.lit("URBANO").alias("tipo_predio"), F.lit("VENTA").alias("nombre_natujur"),
        F.lit(1).alias("count_a"), F.lit(1).alias("count_de"), (F.col("id") % 2 == 0).alias("is_anomaly"), (F.col("id") / n).alias("anomaly_score"))


def test_history_pages_hold_every_row(spark):
    rows = transactions(spark, 1000, 900)
    pages = property.property_history(rows, F.lit(False), page_rows=100).collect()
    hot = sorted((p for p in pages if p.matricula == "hot"), key=lambda p: p.pagina)
    assert [p.pagina for p in hot] == list(range(9)) and {p.paginas for p in hot} == {9} and len(pages) == 109
    entries = [h for p in hot for h in p.historial]
    newest = sorted(entries, key=lambda h: (h.fecha is not None, h.fecha or 0, h.pk), reverse=True)
    assert entries == newest and sorted(int(h.pk) for h in entries) == list(range(900))
    for report in (property.property_report(rows, 100), property.stored_property_report(rows, 100)):
        found = report.where("matricula = 'hot'").collect()
        assert report.count() == 101 and len(found) == 1 and found[0].total_transacciones == 900 and found[0].paginas == 9
        assert [h.pk for h in found[0].historial] == [h.pk for h in entries[:100]]
    assert {"anomaly_score"} < {*found[0].historial[0].asDict()}
    assert property.property_report(rows, 10**6).where("matricula = 'hot'").first().paginas == 1


def test_a_history_of_many_rows_equals_the_sorted_list(spark):
    rows = transactions(spark, 250_100, 250_000)
    pages = property.property_history(rows, F.lit(False), page_rows=30_000).where("matricula = 'hot'")
    found = pages.select("pagina", F.posexplode("historial").alias("nth", "h")).select((F.col("pagina") * 30_000 + F.col("nth")).alias("place"), "h.pk")
    places = {r.pk: r.place for r in found.collect()}
    held = sorted(rows.where("matricula = 'hot'").select("pk", "fecha_radicacion").collect(), key=lambda r: (r.fecha_radicacion is not None, r.fecha_radicacion or 0, r.pk), reverse=True)
    assert len(places) == 250_000 and all(places[r.pk] == n for n, r in enumerate(held))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(300, 5))
    matrix[:20] = matrix[0]
    matrix[-1] = 9.0
    return matrix, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "id long, vec array<double>").repartition(5)


def brute(a, b, k, skip_self):
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    if skip_self:
        np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("part_rows", [10_000, 40])
def test_neighbours(points, part_rows, monkeypatch):
    matrix, df = points
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    found = neighbours.nearest_to_points(df, df, "id", "vec", 6, exclude_self=True).toPandas()
    got = found.sort_values(["id", "rank"])["distance"].to_numpy().reshape(300, 6)
    np.testing.assert_allclose(got, brute(matrix, matrix, 6, True), atol=1e-7)
    queries = df.where("id >= 290").withColumnsRenamed({"id": "q", "vec": "qv"})
    top = neighbours.nearest_to_queries(df, queries, "id", "vec", "q", "qv", 6).toPandas()
    got = top.sort_values(["q", "rank"])["distance"].to_numpy().reshape(10, 6)
    np.testing.assert_allclose(got, brute(matrix[290:], matrix, 6, False), atol=1e-7)


def test_neighbours_of_nothing(points):
    df, none = points[1], points[1].where("id < 0")
    for a, b in ((df, none), (none, df), (none, none)):
        found = neighbours.nearest_to_points(a, b, "id", "vec", 3)
        assert found.columns == ["id", "neighbour", "distance", "rank"] and found.count() == 0


def test_tied_points_do_not_depend_on_the_layout(spark, monkeypatch):
    """A small grid where nearly all distances tie, and a third of the rows are one vector."""
    rows = [(i, [float(i % 5), float(i // 5 % 5)]) if i % 3 else (i, [2.0, 2.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    matrix = np.array([v for _, v in rows])
    d = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    expected = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), d[i]))[:7]}
    for parts, part_rows, pivots in ((3, 4096, 1024), (11, 20, 4)):
        monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
        monkeypatch.setattr(neighbours, "MAX_PIVOTS", pivots)
        shuffled = df.repartition(parts)
        found = neighbours.nearest_to_points(shuffled, shuffled, "id", "vec", 7, exclude_self=True)
        assert {(r.id, r.neighbour) for r in found.collect()} == expected


def test_recall_of_limited_probes(spark):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(2000, 7)) * rng.uniform(0.2, 1, size=(2000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "id long, vec array<double>")
    exact = {(r.id, r.neighbour) for r in neighbours.nearest_to_points(df, df, "id", "vec", 20, exclude_self=True).collect()}
    some = {(r.id, r.neighbour) for r in neighbours.nearest_to_points(df, df, "id", "vec", 20, exclude_self=True, probes=4).collect()}
    assert len(exact) == 40_000 and len(exact & some) / len(exact) > 0.6


def test_density(points):
    df = points[1].where("id >= 20")
    fitted = outliers.fit_density(df, "id", "vec", 10)
    lof = {r.id: r.lof for r in fitted.collect()}
    assert max(lof, key=lof.get) == 299
    new = outliers.density_factor(df, df, fitted, "id", "vec", 10)
    assert {r.id for r in new.collect()} == set(lof)


def test_forest(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(f"p{i}", *map(float, rng.normal(size=3))) for i in range(2000)] + [("far", 40.0, -40.0, 40.0), ("away", -35.0, 35.0, 35.0)]
    df = spark.createDataFrame(rows, "pk string, a double, b double, c double")
    names = ["a", "b", "c"]

    def scores(frame, nodes=None):
        nodes = outliers.fit_forest(frame, "pk", names, trees=50) if nodes is None else nodes
        return {r.pk: r.s for r in frame.select("pk", outliers.forest_score(nodes, [F.col(n) for n in names]).alias("s")).collect()}

    first, again = scores(df.repartition(3)), scores(df.repartition(11))
    assert first == again
    assert set(sorted(first, key=first.get)[-2:]) == {"far", "away"}
    assert 0 < min(first.values()) and max(first.values()) < 1
    nodes = outliers.fit_forest(df, "pk", names, trees=50)
    from folioscope.operators.scoring import fit_scaler

    outliers.save_model(nodes, fit_scaler(df, names), str(tmp_path / "m"))
    assert scores(df, outliers.load_model(spark, str(tmp_path / "m"))[0]) == first
    scored = df.select("pk", outliers.forest_score(nodes, [F.col(n) for n in names]).alias("s"))
    flagged = outliers.flag_by_contamination(scored, "s", 0.1, "x").where("x").count()
    assert abs(flagged - 200) <= 5


def test_reconstruction(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 2))
    rows = [(f"p{i}", float(x), float(y), float(x + y)) for i, (x, y) in enumerate(base)] + [("odd", 1.0, 1.0, -9.0)]
    df = spark.createDataFrame(rows, "pk string, a double, b double, c double")
    scored = outliers.reconstruction_error(df, ["a", "b", "c"], F.col("pk") == "odd", 2)
    assert scored.orderBy(F.desc("error_reconstruccion")).first().pk == "odd"
    assert outliers.flag_by_reconstruction(scored, F.col("pk") == "odd").where("pk = 'odd'").first().anomalia_reconstruccion


def test_insert_ignore_and_update(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    incoming = spark.createDataFrame([("b", 9), ("c", 8), ("c", 7), ("c", 7)], "k string, v int")
    assert [tuple(r) for r in writers.insert_ignore(target, incoming, ["k"], ["v"]).collect()] == [("c", 7)]
    new = writers.update_by_key(target, incoming, "k", ["v"])
    assert sorted(map(tuple, new.collect())) == [("a", 1), ("b", 9)]
    registry = writers.register_models(spark.createDataFrame([("m", True)], "model_name string, is_active boolean"),
                                       spark.createDataFrame([("n",)], "model_name string"))
    assert {r.model_name: r.is_active for r in registry.collect()} == {"m": False, "n": True}
