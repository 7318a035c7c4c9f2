"""Scans of registry files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import values as V

CORRUPT = "_corrupt_record"


def read_parquet(
    spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None
) -> DataFrame:
    """Parquet scan; both the column list and the predicate reach the files."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None
) -> DataFrame:
    """CSV scan with a header and a declared schema; files are split among the tasks."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text, for typing by expressions afterwards."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return read_csv(spark, path, schema)


def read_extract(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV; a line that does not fit keeps its text in ``_corrupt_record``."""
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reader chosen by suffix; anything but Parquet and CSV is refused."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix == "parquet":
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if suffix == "csv":
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.csv(path)
    raise ValueError(f"unsupported file type: {suffix or path!r}")


def read_table(spark: SparkSession, name: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    df = spark.table(name)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_jdbc(
    spark: SparkSession, url: str, query: str, key: str, low: int, high: int, partitions: int, **options: str
) -> DataFrame:
    """Relational table or query read in parallel ranges of a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=f"({query}) AS source", partitionColumn=key, **options)
        .option("lowerBound", low)
        .option("upperBound", high)
        .option("numPartitions", partitions)
        .load()
    )


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows, columns, size and modification time per file; only footers and counts are read."""
    df = spark.read.parquet(path)
    width = len(df.columns)
    return (
        df.select("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time")
        .groupBy("file_name", "file_size", "file_modification_time")
        .agg(F.count("*").alias("num_rows"))
        .select(
            "file_name",
            "num_rows",
            F.lit(width).cast("long").alias("num_columns"),
            (F.col("file_size") / (1024 * 1024)).alias("file_size_mb"),
            F.col("file_modification_time").alias("created"),
        )
    )


def spread_over_cores(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a scan that has fewer splits than there are cores.

    A table of one small file would otherwise occupy one task in every stage up to the next
    shuffle. A scan with enough splits, as any large table has, is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows in a declared order."""
    return df.orderBy(*order).limit(n)


def random_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement; the draw depends on the key and the seed alone.

    The ``n`` smallest hashes are taken. A threshold on the hash first leaves a few times ``n``
    rows, so that the final ordering is small whatever the number of partitions.
    """
    drawn = V.stable_number(F.lit(seed), F.col(key)) / 2**32
    share = min(1.0, (4.0 * n + 100) / max(df.count(), 1))
    return df.where(drawn < share).orderBy(drawn, F.col(key)).limit(n)


def random_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def type_text_columns(df: DataFrame) -> DataFrame:
    """Numbers, dates and text of an all-text file turned into one fixed output schema."""
    numbers = {"valor_acto", "area_terreno", "area_construida", "numero_intervinientes", "count_a", "count_de", "orip"}
    dates = {"fecha_radicacion", "fecha_acto"}
    texts = {"departamento", "municipio", "tipo_acto", "nombre_natujur", "tipo_predio", "estado_folio", "matricula"}

    def typed(name: str) -> Column:
        c, low = F.col(name), name.lower()
        if low in numbers:
            return V.money_or_null(c).alias(name)
        if low in dates:
            return F.coalesce(V.day_or_null(c, "yyyy-MM-dd"), V.day_or_null(c, "dd/MM/yyyy")).alias(name)
        if low in texts:
            return F.nullif(V.upper_text(c), F.lit("NAN")).alias(name)
        return c

    return df.select(*[typed(c) for c in df.columns])
