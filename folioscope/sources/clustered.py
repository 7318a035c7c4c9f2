"""A table laid out by one key, so that looking a key up reads the files that may hold it and no others.

Rows are range-partitioned and sorted by the key. Every range is a folder of its own, and a small index
names the least and largest key of each: a lookup reads the index, then the one or few ranges around the
key, where sorted row groups and a Bloom filter per column chunk leave little to scan. A key that holds
many rows is spread over several ranges, since ranges are cut by (key, place in the input).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "rango"


def write_clustered(df: DataFrame, path: str, key: str, ranges: int | None = None) -> None:
    """Store ``df`` below ``path`` in ``ranges`` folders (default: the shuffle partitions) with their index.

    Rows without a key lie in the first ranges, where no lookup finds them.
    """
    spark = df.sparkSession
    number = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    laid = placed.repartitionByRange(number, key, "__at").sortWithinPartitions(key).drop("__at")
    laid.withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).options(**{
        f"parquet.bloom.filter.enabled#{key}": "true", "parquet.page.size": str(1 << 16)}).mode("overwrite").parquet(f"{path}/rows")
    # An empty table has no ranges; its columns are kept aside.
    laid.withColumn(RANGE, F.lit(0)).limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    stored = _rows(spark, path)
    # One row per range.
    bounds = stored.groupBy(RANGE).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns).parquet(f"{path}/rows")


def ranges_of(spark: SparkSession, path: str, keys: list) -> list[int]:
    """Numbers of the ranges that may hold one of some keys."""
    index = spark.read.parquet(f"{path}/index")
    wanted = F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: k.between(F.col("low"), F.col("high")))
    return [r[0] for r in index.where(wanted).select(RANGE).collect()]


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """The whole table, without the range numbers."""
    return _rows(spark, path).drop(RANGE)


def lookup(spark: SparkSession, path: str, key: str, *values) -> DataFrame:
    """Rows of the given keys, from the ranges that may hold them; an unknown key gives none."""
    rows = _rows(spark, path)
    some = [v for v in values if v is not None]
    found = ranges_of(spark, path, some) if some else []
    return rows.where(F.col(RANGE).isin(found) & F.col(key).isin(some)).drop(RANGE)
