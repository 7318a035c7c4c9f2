"""Rule scores, risk classes and the explanations attached to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import values as V


def rule_score() -> Column:
    """Sum of the weights of the broken rules, at most 1."""
    value = F.col("valor_acto")
    broken = [
        (value < K.LOW_VALUE, 0.3),
        (value > K.HIGH_VALUE, 0.2),
        (F.col("numero_intervinientes") > 5, 0.2),
        (F.lower("estado_folio").isin("cancelado", "suspendido"), 0.3),
    ]
    total = F.lit(0.0)
    for holds, weight in broken:
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def outside_usual_value() -> Column:
    value = F.col("valor_acto")
    return V.truth((value < K.LOW_VALUE) | (value > K.HIGH_VALUE))


def simple_score() -> Column:
    return F.when(F.col("valor_acto") > 100_000_000, 0.3).otherwise(0.6)


def risk_label(score: Column) -> Column:
    return F.when(score < 0.4, "normal").when(score < 0.7, "suspicious").when(score >= 0.7, "high-risk")


def risk_code(score: Column) -> Column:
    return F.when(score < 0.4, 0).when(score < 0.7, 1).when(score >= 0.7, 2)


def risk_label_by_threshold(score: Column, threshold: float = K.RISK_THRESHOLD) -> Column:
    """High risk from the threshold on, suspicious from 60 % of it on."""
    return F.when(score >= threshold, "high-risk").when(score >= threshold * 0.6, "suspicious").otherwise("normal")


def contributing_features(limit: int = 5) -> Column:
    """Array of the features that speak for an anomaly, strongest first."""

    def entry(name: str, value: Column, weight: float, note: str) -> Column:
        return F.struct(
            F.lit(weight).alias("contribution_score"),
            F.lit(name).alias("feature_name"),
            value.cast("string").alias("value"),
            F.lit(note).alias("explanation"),
        )

    value, parties, state = F.col("valor_acto"), F.col("numero_intervinientes"), F.col("estado_folio")
    found = F.array(
        F.when(value < 50_000_000, entry("valor_acto", value, 0.4, K.LOW_VALUE_NOTE)),
        F.when(parties > 3, entry("numero_intervinientes", parties, 0.3, K.PARTIES_NOTE)),
        F.when(F.lower(state) != "activo", entry("estado_folio", state, 0.25, K.FOLIO_NOTE)),
    )
    present = F.filter(found, lambda f: f.isNotNull())
    return F.slice(F.sort_array(present, asc=False), 1, limit)


def explanation(label: Column, features: Column) -> Column:
    names = F.array_join(F.transform(F.slice(features, 1, 3), lambda f: f["feature_name"]), ", ")
    normal = F.concat(
        F.lit("Transacción normal de "), F.col("tipo_acto"), F.lit(" en "), F.col("municipio"),
        F.lit(". No se detectaron anomalías significativas."),
    )
    high = F.concat(
        F.lit("Transacción de ALTO RIESGO detectada. Factores principales: "), names,
        F.lit(". Se recomienda revisión manual inmediata."),
    )
    suspicious = F.concat(F.lit("Transacción SOSPECHOSA. Revisar: "), names, F.lit(". Validación adicional recomendada."))
    return F.when(label == "normal", normal).when(label == "high-risk", high).otherwise(suspicious)


def texts(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def recommendations(label: Column) -> Column:
    return (
        F.when(label == "normal", texts(K.NORMAL_ADVICE))
        .when(label == "high-risk", texts(K.SUSPICIOUS_ADVICE + K.HIGH_RISK_ADVICE))
        .otherwise(texts(K.SUSPICIOUS_ADVICE))
    )


def simple_analysis(df: DataFrame) -> DataFrame:
    scored = df.withColumn("anomaly_score", simple_score())
    described = F.concat(
        F.lit("Transacción de tipo "), F.col("tipo_acto"), F.lit(" por valor de "),
        V.display_money(F.col("valor_acto")), F.lit(" COP en "), F.col("municipio"),
    )
    return scored.withColumns({"classification": risk_label(F.col("anomaly_score")), "explanation": described})


def analyse(df: DataFrame, forest_score: Column, density_score: Column, threshold: float = K.RISK_THRESHOLD) -> DataFrame:
    """Score, class and nested explanation of every transaction.

    The two model scores are raw decision values (low means anomalous) or NULL without a model;
    they are squashed to 0-1, with 0.5 standing for a missing model.
    """
    from folioscope.operators.scoring import squashed

    score = 0.4 * squashed(forest_score) + 0.3 * squashed(density_score) + 0.3 * rule_score()
    scored = df.withColumn("anomaly_score", score)
    labelled = scored.withColumns({
        "classification": risk_label_by_threshold(F.col("anomaly_score"), threshold),
        "contributing_features": contributing_features(),
    })
    return labelled.withColumns({
        "confidence": F.lit(0.85),
        "explanation": explanation(F.col("classification"), F.col("contributing_features")),
        "recommendations": recommendations(F.col("classification")),
    })


def map_tier(rate: Column) -> Column:
    return F.when(rate > 0.2, "Alto riesgo").when(rate > 0.15, "Riesgo medio").otherwise("Bajo riesgo")


def map_colour(rate: Column) -> Column:
    return F.when(rate > 0.2, "#ef4444").when(rate > 0.15, "#f59e0b").otherwise("#10b981")


def marker_radius(count: Column) -> Column:
    return F.when(count > 10000, 25).when(count > 5000, 18).when(count > 2000, 12).otherwise(8)
