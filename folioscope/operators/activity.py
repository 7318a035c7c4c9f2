"""Business anomalies that need the context of other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.constants import MAX_ANNOTATIONS_PER_YEAR
from folioscope.functions import values as V
from folioscope.plans.joins import HOT_ROWS, attach_group_stats, attach_lookup


def group_sizes(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def with_yearly_annotations(tx: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Annotations of the property in the year of the row; 0 where either is missing."""
    keys = ["matricula", "year_radica"]
    known = tx.where(F.col("matricula").isNotNull() & F.col("year_radica").isNotNull())
    counted = attach_group_stats(tx, group_sizes(known, keys, "anotaciones_por_anio"), keys, "anotaciones_por_anio", hot_rows)
    return counted.withColumn("anotaciones_por_anio", F.coalesce("anotaciones_por_anio", F.lit(0)))


def most_frequent(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent value per key, the smallest on ties, NULL where a key has none."""
    pairs = df.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.count(value).alias("__n"))
    best = F.min_by(F.when(F.col("__n") > 0, F.col(value)), F.struct(-F.col("__n"), F.col(value)))
    return pairs.groupBy(key).agg(best.alias(name))


def with_expected_department(tx: DataFrame) -> DataFrame:
    expected = most_frequent(tx, "orip", "departamento", "depto_esperado_orip")
    return attach_lookup(tx, expected, ["orip"])


def flag_business_anomalies(
    classified: DataFrame, max_per_year: int = MAX_ANNOTATIONS_PER_YEAR, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Excessive yearly activity, office in another department, and the number of flags raised."""
    rows = with_yearly_annotations(with_expected_department(classified), hot_rows)
    busy = F.col("anotaciones_por_anio") > max_per_year
    elsewhere = V.truth(F.col("departamento") != F.col("depto_esperado_orip"))
    flagged = rows.withColumns({"flag_actividad_excesiva": busy, "flag_geo_discrepancia": elsewhere})
    total = F.col("flag_actividad_excesiva").cast("int") + F.col("flag_geo_discrepancia").cast("int")
    return flagged.withColumn("total_flags_anomalia", total)
