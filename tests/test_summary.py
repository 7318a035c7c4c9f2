"""The stored summary after an append equals a full rebuild, and other partitions stay as they are."""

from pathlib import Path

from pyspark.sql import functions as F

from folioscope.operators import monitoring


def test_refresh_of_changed_partitions(spark, tmp_path):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 7 > 0, (F.col("id") % 5).cast("string")).alias("departamento"), (2000 + F.col("id") % 4).cast("int").alias("year_radica"),
        F.when(F.col("id") % 11 > 0, F.col("id") / 3000).alias("anomaly_score"), "id")
    path = str(tmp_path / "s")
    monitoring.refresh_summary(rows.where("id < 2000"), path)
    before = {str(f) for f in Path(path).glob("year_radica=200[012]/*.parquet")}
    # The append falls into one year; that year is renewed.
    now = rows.where("id < 2000 or year_radica = 2003")
    monitoring.refresh_summary(now.where("year_radica = 2003"), path)
    assert {str(f) for f in Path(path).glob("year_radica=200[012]/*.parquet")} == before
    key = lambda df: sorted((str(r.departamento), r.total, round(r.avg_score, 12)) for r in df.collect())
    assert key(monitoring.stored_summary(spark, path)) == key(monitoring.department_score_summary(now))
