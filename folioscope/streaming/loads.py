"""Incremental loading of arriving files and running activity counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def arriving_files(spark: SparkSession, path: str, schema: T.StructType, form: str = "csv", per_batch: int | None = None) -> DataFrame:
    """Stream of files below ``path``; CSV files have a header."""
    reader = spark.readStream.schema(schema).format(form)
    if form == "csv":
        reader = reader.option("header", True)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path)


# State on local disk with a log of changes per batch, instead of a map in the executors' memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Settings for queries started inside; a query keeps those of its start."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def drain(stream: DataFrame, state: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what has arrived, then stop; progress is kept under ``state``."""
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{state}/progress")
        .trigger(availableNow=True)
        .foreachBatch(write)
    )
    with state_store(stream.sparkSession):
        query = writer.start()
    query.awaitTermination()
    return query


def batch_folder(target: str, batch: int) -> str:
    """Folder of one batch. A repeated batch overwrites its own folder, so no row is stored twice."""
    return f"{target}/lote={batch}"


def clean_and_load(stream: DataFrame, clean: Callable[[DataFrame], DataFrame], target: str, state: str) -> StreamingQuery:
    """Clean arriving rows and append them, with read and loaded counters per batch."""

    def write(batch: DataFrame, number: int) -> None:
        read, loaded = Observation(), Observation()
        observed = batch.observe(read, F.count(F.lit(1)).alias("leidas"))
        cleaned = clean(observed).observe(loaded, F.count(F.lit(1)).alias("cargadas"))
        cleaned.write.mode("overwrite").parquet(batch_folder(f"{target}/filas", number))
        n_read, n_loaded = read.get["leidas"], loaded.get["cargadas"]
        counters = batch.sparkSession.createDataFrame(
            [(n_read, n_loaded, n_read - n_loaded)], "leidas long, cargadas long, rechazadas long"
        )
        counters.write.mode("overwrite").parquet(batch_folder(f"{target}/contadores", number))

    return drain(stream, state, write)


def load_counters(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.parquet(f"{target}/contadores")
    return rows.agg(
        F.sum("leidas").alias("total_rows_read"),
        F.sum("cargadas").alias("total_rows_loaded"),
        F.sum("rechazadas").alias("total_rows_rejected"),
        F.count("*").alias("batches_processed"),
    )


def distinct_in_batches(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns with the copies inside each Arrow batch taken out, so that a key of very many rows
    leaves a task as one row per batch. Keys of nested types pass as they are."""
    found = stream.select(*keys)
    if any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)) for f in found.schema):
        return found

    def distinct(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            yield from rows.group_by(rows.column_names).aggregate([]).to_batches()

    return found.mapInArrow(distinct, found.schema)


def keyed_rows(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The stream's rows (``__nueva`` false), and beside them every key that no earlier batch had
    (``__nueva`` true, other columns NULL).

    The keys seen are Spark's own keyed state: a batch looks up the keys it holds, one by one, and reads
    nothing that was stored before.
    """
    fresh = distinct_in_batches(stream, keys).dropDuplicates(keys).withColumn("__nueva", F.lit(True))
    return stream.withColumn("__nueva", F.lit(False)).unionByName(fresh, allowMissingColumns=True)


def first_of_new_keys(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The smallest row in ``order`` of each new key, from one aggregate over rows and new keys."""
    rest = [c for c in batch.columns if c not in [*keys, "__nueva"]]
    row = F.when(~F.col("__nueva"), F.struct(*rest)) if rest else F.lit(None)
    at = F.when(~F.col("__nueva"), F.struct(*order))
    best = batch.groupBy(*keys).agg(F.min_by(row, at).alias("__row"), F.max("__nueva").alias("__nueva")).where("__nueva")
    chosen = best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
    return chosen.select(*[c for c in batch.columns if c != "__nueva"])


def load_once_per_key(stream: DataFrame, keys: list[str], order: list[str], target: str, state: str) -> StreamingQuery:
    """Store the first row of every key; keys stored by an earlier batch are skipped.

    NULL is a key value like any other. The state is kept below ``state`` in as many parts as the session
    has shuffle partitions when the load is first started, and its size is that of the keys.
    """

    def write(batch: DataFrame, number: int) -> None:
        first_of_new_keys(batch, keys, order).write.mode("overwrite").parquet(batch_folder(target, number))

    return drain(keyed_rows(stream, keys), state, write)


def once_per_key_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Streaming form for late copies within a bounded delay; state older than it is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_activity(stream: DataFrame, key: str, time: str, window: str, delay: str, limit: int) -> DataFrame:
    """Rows per key and time window, marked above a limit.

    Counts are combined before the shuffle and the watermark bounds the state.
    """
    counts = stream.withWatermark(time, delay).groupBy(F.window(time, window), F.col(key)).agg(F.count("*").alias("n"))
    return counts.select(
        F.col("window.start").alias("inicio"), F.col("window.end").alias("fin"), key, "n",
        (F.col("n") > limit).alias("actividad_excesiva"),
    )


def load_window_counts(stream: DataFrame, key: str, time: str, window: str, target: str, state: str) -> StreamingQuery:
    """Store each batch's rows per key and time window; the counts of all batches add up.

    No row is too late: a window may receive counts from any batch, and nothing is kept between them.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"))
        counts.select(F.col("w.start").alias("inicio"), F.col("w.end").alias("fin"), key, "n").write.mode("overwrite").parquet(batch_folder(target, number))

    return drain(stream, state, write)


def total_counts(spark: SparkSession, target: str, key: str, limit: int) -> DataFrame:
    """Rows per key and window over all stored batches, marked above a limit."""
    grouped = spark.read.parquet(target).groupBy("inicio", "fin", key).agg(F.sum("n").alias("n"))
    return grouped.withColumn("actividad_excesiva", F.col("n") > limit)


def store_updates(counts: DataFrame, target: str, state: str) -> StreamingQuery:
    """Write changed counts of every batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(target, number))

    return drain(counts, state, write, "update")


def latest_counts(spark: SparkSession, target: str, key: str) -> DataFrame:
    """Last stored count per key and window."""
    rows = spark.read.parquet(target)
    newest = F.max_by(F.struct("n", "actividad_excesiva"), "lote")
    grouped = rows.groupBy("inicio", "fin", key).agg(newest.alias("u"))
    return grouped.select("inicio", "fin", key, "u.n", "u.actividad_excesiva")
