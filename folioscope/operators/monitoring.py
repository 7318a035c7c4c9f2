"""Monitoring queries over scored transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.constants import SCORE_BANDS
from folioscope.operators.statistics import percent, total_rows

ANOMALOUS = F.count_if


def risk_class_shares(scored: DataFrame) -> DataFrame:
    """Scored rows per class; the share is of all rows, scored or not."""
    counts = scored.where(F.col("anomaly_score").isNotNull()).groupBy("risk_classification").agg(F.count("*").alias("total"))
    share = F.round(percent(F.col("total"), total_rows(scored)), 2)
    return counts.withColumn("percentage", share).orderBy(F.desc("total"), "risk_classification")


def departments_by_anomaly_rate(scored: DataFrame, n: int = 10) -> DataFrame:
    rates = scored.groupBy("departamento").agg(
        F.count("*").alias("total_transactions"), F.count_if("is_anomaly").alias("anomalies")
    )
    rates = rates.withColumn("anomaly_rate", F.round(percent(F.col("anomalies"), F.col("total_transactions")), 2))
    return rates.orderBy(F.desc("anomaly_rate"), F.asc_nulls_last("departamento")).limit(n)


def band(score: Column, bands=SCORE_BANDS) -> Column:
    """Label of a left-closed score band."""
    chain = F.when(score < bands[0][0], bands[0][1])
    for edge, label in bands[1:-1]:
        chain = chain.when(score < edge, label)
    return chain.otherwise(bands[-1][1])


def score_histogram(scored: DataFrame, bands=SCORE_BANDS) -> DataFrame:
    known = scored.where(F.col("anomaly_score").isNotNull())
    return known.groupBy(band(F.col("anomaly_score"), bands).alias("score_range")).agg(F.count("*").alias("count")).orderBy("score_range")


def top_anomalies(scored: DataFrame, n: int = 10) -> DataFrame:
    rows = scored.where("is_anomaly").orderBy(F.desc("anomaly_score"), "pk").limit(n)
    return rows.select("pk", "matricula", "departamento", "anomaly_score", "risk_classification")


def busiest_properties(tx: DataFrame, n: int = 10) -> DataFrame:
    return tx.groupBy("matricula").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "matricula").limit(n)


def most_expensive(tx: DataFrame, n: int = 10) -> DataFrame:
    rows = tx.where(F.col("valor_acto").isNotNull()).orderBy(F.desc("valor_acto"), "pk").limit(n)
    return rows.select("pk", "matricula", "departamento", "municipio", "valor_acto", "nombre_natujur")


def activity_per_year(tx: DataFrame) -> DataFrame:
    known = tx.where(F.col("year_radica").isNotNull())
    return known.groupBy("year_radica").agg(F.count("*").alias("total")).orderBy(F.desc("year_radica"))


def most_common_acts(tx: DataFrame, n: int = 10) -> DataFrame:
    return tx.groupBy("nombre_natujur").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "nombre_natujur").limit(n)


def properties_with_anomalies(scored: DataFrame, n: int = 20) -> DataFrame:
    rows = scored.groupBy("matricula").agg(
        F.count("*").alias("total_transacciones"),
        F.count_if("is_anomaly").alias("anomalias"),
        F.avg("anomaly_score").alias("avg_score"),
    )
    rows = rows.where(F.col("anomalias") > 0)
    rounded = rows.withColumn("avg_score", F.round("avg_score", 6))
    return rounded.orderBy(F.desc("anomalias"), F.desc("avg_score"), "matricula").limit(n)


def department_score_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("departamento").agg(F.count("*").alias("total"), F.avg("anomaly_score").alias("avg_score"))


def refresh_summary(changed: DataFrame, path: str, by: str = "year_radica") -> None:
    """Renew the stored department summary for the partitions (values of ``by``) that ``changed`` holds.

    What is stored are sums per department and partition, in a folder for each partition. ``changed`` must hold
    all rows of its partitions; the folders of others are neither read nor written.
    """
    sums = changed.groupBy("departamento", by).agg(
        F.count("*").alias("total"), F.sum("anomaly_score").alias("suma"), F.count("anomaly_score").alias("con_score"))
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def stored_summary(spark: SparkSession, path: str) -> DataFrame:
    """Department summary from the stored sums, equal to that of all rows."""
    return spark.read.parquet(path).groupBy("departamento").agg(
        F.sum("total").alias("total"), F.try_divide(F.sum("suma"), F.sum("con_score")).alias("avg_score"))


def first_high_risk(analysed: DataFrame, n: int = 100) -> DataFrame:
    rows = analysed.where(F.col("classification") == "high-risk")
    return rows.orderBy(F.desc("anomaly_score"), "pk").limit(n)


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def pending_reviews(queue: DataFrame) -> DataFrame:
    pending = queue.where(F.col("estado_revision") == "PENDIENTE")
    return pending.orderBy(F.desc("fecha_carga"), "pk").select(
        "pk", "departamento", "municipio", "year_radica", "valor_acto", "tipo_error",
        "calidad_datos", "estado_revision", "fecha_carga",
    )
