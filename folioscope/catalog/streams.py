"""Streaming loads, drained and compared with their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import AS_OF, acts, day, over, query
from folioscope.catalog.etl import GOOD
from folioscope.operators.quality import accepted
from folioscope.session import scratch_path
from folioscope.streaming import loads


def event_stream(spark, d):
    path = f"{d}/events.parquet"
    stream = loads.arriving_files(spark, path + "*", spark.read.parquet(path).schema, "parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_files_cleaned_and_loaded", over("acts", f"SELECT pk, valor_acto, municipio FROM acts WHERE {GOOD}"))
def t1(spark, d):
    folder = scratch_path(spark, "stream")
    source = acts(spark, d)
    source.write.parquet(f"{folder}/in")
    stream = loads.arriving_files(spark, f"{folder}/in", source.schema, "parquet", per_batch=4)
    loads.clean_and_load(stream, lambda b: accepted(b, day(AS_OF)), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out/filas").select("pk", "valor_acto", "municipio")


@query("t1_load_counters", over("acts", f"""
SELECT count(*) AS total_rows_read, count(*) FILTER (WHERE {GOOD}) AS total_rows_loaded,
  count(*) - count(*) FILTER (WHERE {GOOD}) AS total_rows_rejected FROM acts"""))
def t1b(spark, d):
    folder = scratch_path(spark, "stream")
    source = acts(spark, d)
    source.write.parquet(f"{folder}/in")
    stream = loads.arriving_files(spark, f"{folder}/in", source.schema, "parquet", per_batch=4)
    loads.clean_and_load(stream, lambda b: accepted(b, day(AS_OF)), f"{folder}/out", f"{folder}/state")
    return loads.load_counters(spark, f"{folder}/out").drop("batches_processed")


@query("t2_loaded_once_per_key", """
SELECT user_id, event_type, dia, event_id FROM (SELECT user_id, event_type, cast(ts AS DATE) AS dia, event_id,
  row_number() OVER (PARTITION BY user_id, event_type, cast(ts AS DATE) ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def t2(spark, d):
    folder = scratch_path(spark, "stream")
    rows = event_stream(spark, d).select("user_id", "event_type", F.col("ts").cast("date").alias("dia"), "event_id")
    loads.load_once_per_key(rows, ["user_id", "event_type", "dia"], ["event_id"], f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").drop("lote")


@query("t3_windowed_activity", """
SELECT date_trunc('day', ts) AS inicio, user_id, count(*) AS n, count(*) > 5 AS actividad_excesiva FROM events GROUP BY 1, 2""")
def t3(spark, d):
    folder = scratch_path(spark, "stream")
    loads.load_window_counts(event_stream(spark, d), "user_id", "ts", "1 day", f"{folder}/out", f"{folder}/state")
    counts = loads.total_counts(spark, f"{folder}/out", "user_id", 5).drop("fin")
    return counts.withColumn("inicio", F.col("inicio").cast("timestamp_ntz"))
