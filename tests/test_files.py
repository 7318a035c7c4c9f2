"""Readers, sinks and streams over several files and batches."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators.quality import classify
from folioscope.operators.features import split_rows
from folioscope.sources import readers, schemas, writers
from folioscope.streaming import loads


def test_suffix(spark):
    with pytest.raises(ValueError):
        readers.read_any(spark, "/data/registro.xlsx")


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2020-01-01\nx,2020-01-01\n2,not a day\n")
    rows = readers.read_extract(spark, str(tmp_path / "x.csv"), schemas.table(a=schemas.INT, b=schemas.DAY)).cache()
    assert rows.where(f"{readers.CORRUPT} IS NULL").count() == 1 and rows.count() == 3


def test_scan_is_pruned_and_filtered(spark):
    df = readers.read_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], F.col("l_quantity") > 45)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_conform(spark):
    row = schemas.conform(spark.createDataFrame([("7", "x")], "pk string, extra string"), schemas.REVIEW_QUEUE).first()
    assert row.pk == "7" and row.valor_acto is None and len(row) == len(schemas.REVIEW_QUEUE)


def test_datasets_written(spark, tmp_path):
    tx = spark.createDataFrame(
        [("a", 5e6, 1, "A", "B", 2010, "VENTA", "URBANO"), ("b", None, 1, "A", "B", 2010, "VENTA", "URBANO")],
        "pk string, valor_acto double, dinamica_inmobiliaria int, departamento string, municipio string, year_radica int, "
        "nombre_natujur string, tipo_predio string")
    paths = writers.write_quality_datasets(classify(tx), str(tmp_path))
    sizes = {n: spark.read.parquet(p).count() for n, p in paths.items()}
    assert sizes == {"completo": 2, "limpio": 1, "mercado": 1, "ml_training": 1, "errores": 1, "advertencias": 0}


def test_split_is_stable_and_disjoint(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("pk"))
    first = {r.pk for r in split_rows(rows, "pk").where("es_prueba").collect()}
    second = {r.pk for r in split_rows(rows.repartition(9), "pk").where("es_prueba").collect()}
    assert first == second and 850 < len(first) < 1150


SCHEMA = schemas.table(k=schemas.STRING, n=schemas.LONG, ts=schemas.TIME)


def arriving(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k string, n long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return loads.arriving_files(spark, str(tmp_path / "in"), SCHEMA, "parquet", per_batch=1)


def test_clean_and_load_resumes(spark, tmp_path):
    target, state = str(tmp_path / "out"), str(tmp_path / "state")

    def clean(df):
        return df.where("n > 0")

    loads.clean_and_load(arriving(spark, tmp_path, [[("a", 1, None)], [("b", -1, None), ("c", 2, None)]]), clean, target, state)
    loads.clean_and_load(arriving(spark, tmp_path, [[("d", 3, None)]]), clean, target, state)
    assert sorted(r.k for r in spark.read.parquet(f"{target}/filas").collect()) == ["a", "c", "d"]
    assert tuple(loads.load_counters(spark, target).first()) == (4, 3, 1, 3)


def test_once_per_key_over_batches(spark, tmp_path):
    stream = arriving(spark, tmp_path, [[("a", 2, None), ("a", 1, None)], [("a", 0, None), ("b", 5, None)], [("b", 4, None)]])
    loads.load_once_per_key(stream, ["k"], ["n"], str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out")).select("k").collect()
    assert sorted(r.k for r in rows) == ["a", "b"]


def test_windowed_activity_over_batches(spark, tmp_path):
    day = "2024-01-01 0"
    stream = arriving(spark, tmp_path, [[("a", 1, day + "1:00:00"), ("a", 2, day + "2:00:00")], [("a", 3, day + "3:00:00")]])
    counts = loads.windowed_activity(stream, "k", "ts", "1 day", "2 days", 2)
    loads.store_updates(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    rows = loads.latest_counts(spark, str(tmp_path / "out"), "k").collect()
    assert [(r.k, r.n, r.actividad_excesiva) for r in rows] == [("a", 3, True)]
