"""Statistical fraud rules and the unified anomaly table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.operators.statistics import top_values
from folioscope.plans.joins import attach_lookup
from folioscope.plans.quantiles import exact_quantiles
from folioscope.sources.writers import update_by_key

# Severity of each rule in the unified table (values of this library).
SEVERITY = {
    "URBANO_VALOR_BAJO": 0.8,
    "VALOR_SOBRE_MEDIANA": 0.9,
    "RURAL_SOBRE_URBANO": 0.6,
}


def cheap_urban(tx: DataFrame, cities: int = 10, below: float = K.LOW_VALUE) -> DataFrame:
    """Urban rows of the busiest municipalities with a value that cannot be real."""
    big = F.broadcast(top_values(tx, "municipio", cities).select("municipio"))
    rows = tx.where((F.col("tipo_predio") == "URBANO") & (F.col("valor_acto") < below))
    return rows.join(big, "municipio", "left_semi")


def far_above_median(tx: DataFrame, medians: DataFrame, factor: float = 50) -> DataFrame:
    """Rows above a multiple of the median of their department and year."""
    keys = ["departamento", "year_radica"]
    joined = attach_lookup(tx, medians.select(*keys, "valor_mediano"), keys, "inner")
    return joined.where(F.col("valor_acto") > F.col("valor_mediano") * factor)


def department_year_medians(tx: DataFrame) -> DataFrame:
    return exact_quantiles(tx, ["departamento", "year_radica"], "valor_acto", {"valor_mediano": 0.5})


def rural_above_urban(tx: DataFrame, q: float = 0.95) -> DataFrame:
    """Rural rows above the urban quantile of their department."""
    urban = tx.where(F.col("tipo_predio") == "URBANO")
    edges = exact_quantiles(urban, ["departamento"], "valor_acto", {"p95_urbano": q})
    joined = attach_lookup(tx.where(F.col("tipo_predio") == "RURAL"), edges, ["departamento"], "inner")
    return joined.where(F.col("valor_acto") > F.col("p95_urbano"))


def traded_often(tx: DataFrame, year: int | None = None, more_than: int = 10) -> DataFrame:
    """Properties with many transactions in one year, and their total value."""
    rows = tx if year is None else tx.where(F.col("year_radica") == year)
    grouped = rows.groupBy("matricula", "year_radica").agg(F.count("*").alias("veces"), F.sum("valor_acto").alias("total"))
    return grouped.where(F.col("veces") > more_than)


def repeated_values(tx: DataFrame, more_than: int = 100, municipalities: int = 10) -> DataFrame:
    """Values repeated in many rows and municipalities, with the sorted list of municipalities.

    Rows are counted per value and municipality first, so a value that fills the table reaches the
    list as one entry per municipality.
    """
    pairs = tx.where(F.col("valor_acto").isNotNull()).groupBy("valor_acto", "municipio").agg(F.count("*").alias("n"))
    grouped = pairs.groupBy("valor_acto").agg(
        F.sum("n").alias("repeticiones"),
        F.count("municipio").alias("n_municipios"),
        F.sort_array(F.collect_list("municipio")).alias("municipios"),
    )
    return grouped.where((F.col("repeticiones") > more_than) & (F.col("n_municipios") > municipalities))


def anomaly_rows(df: DataFrame, kind: str, rule: Column, severity: Column) -> DataFrame:
    return df.select(
        "pk", "departamento", "municipio", "year_radica", "valor_acto",
        F.lit(kind).alias("tipo_deteccion"),
        severity.alias("score_severidad"),
        rule.alias("regla_violada"),
        F.lit(K.PENDING).alias("estado_revision"),
    )


def unified_anomalies(tx: DataFrame, scored: DataFrame, factor: float = 50, min_score: float = 0.5) -> DataFrame:
    """Rule hits and model hits in one table waiting for review."""
    hits = {
        "URBANO_VALOR_BAJO": cheap_urban(tx),
        "VALOR_SOBRE_MEDIANA": far_above_median(tx, department_year_medians(tx), factor),
        "RURAL_SOBRE_URBANO": rural_above_urban(tx),
    }
    model = scored.where(F.col("anomaly_score") >= min_score)
    out = anomaly_rows(model, "ML", F.lit("ML_SCORE"), F.col("anomaly_score"))
    for name, rows in hits.items():
        out = out.unionByName(anomaly_rows(rows, "ESTADISTICA", F.lit(name), F.lit(SEVERITY[name])))
    return out


def rule_anomalies(anomalies: DataFrame, rule: str | None = None, min_severity: float = 0.0, n: int = 100) -> DataFrame:
    rows = anomalies.where((F.col("tipo_deteccion") == "ESTADISTICA") & (F.col("score_severidad") >= min_severity))
    rows = rows if rule is None else rows.where(F.col("regla_violada") == rule)
    return rows.orderBy(F.desc("score_severidad"), "pk", "regla_violada").limit(n)


def model_anomalies(anomalies: DataFrame, min_score: float = 0.7, department: str | None = None, n: int = 100) -> DataFrame:
    rows = anomalies.where((F.col("tipo_deteccion") == "ML") & (F.col("score_severidad") >= min_score))
    rows = rows if department is None else rows.where(F.col("departamento") == department.upper())
    return rows.orderBy(F.desc("score_severidad"), "pk").limit(n)


def mark_reviewed(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """New version of the review queue with state and comment of the decided rows."""
    return update_by_key(queue, decisions, "pk", ["estado_revision", "comentario_revision"])
