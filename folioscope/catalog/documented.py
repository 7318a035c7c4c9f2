"""Unified anomalies and the data sets of maps, indicators, charts and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import AS_OF, cl, day, fl, over, query, rounded, sc, tx
from folioscope.catalog.models import e6
from folioscope.catalog.risk import MEDIANS
from folioscope.operators import cleaning, dashboard, outliers, rules
from folioscope.operators.quality import dataset
from folioscope.operators.statistics import yearly_trend

RULE_HITS = """
SELECT pk, departamento, municipio, year_radica, valor_acto, 'ML' AS tipo_deteccion, anomaly_score AS score_severidad,
  'ML_SCORE' AS regla_violada, 'PENDIENTE' AS estado_revision FROM sc WHERE anomaly_score >= 0.5
UNION ALL SELECT pk, departamento, municipio, year_radica, valor_acto, 'ESTADISTICA', 0.8, 'URBANO_VALOR_BAJO', 'PENDIENTE' FROM tx
  WHERE tipo_predio = 'URBANO' AND valor_acto < 10000000 AND municipio IN
  (SELECT municipio FROM tx WHERE municipio IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, municipio LIMIT 10)
UNION ALL SELECT pk, departamento, municipio, year_radica, valor_acto, 'ESTADISTICA', 0.9, 'VALOR_SOBRE_MEDIANA', 'PENDIENTE' FROM tx
  JOIN medianas USING (departamento, year_radica) WHERE valor_acto > mediana * 20
UNION ALL SELECT pk, departamento, municipio, year_radica, valor_acto, 'ESTADISTICA', 0.6, 'RURAL_SOBRE_URBANO', 'PENDIENTE' FROM tx
  JOIN (SELECT departamento, quantile_cont(valor_acto, 0.95) AS p95 FROM tx WHERE tipo_predio = 'URBANO' GROUP BY 1) USING (departamento)
  WHERE tipo_predio = 'RURAL' AND valor_acto > p95"""


def unified(body):
    return over("sc", body, medianas=MEDIANS, anomalias=RULE_HITS)


def anomalies(spark, d):
    return rules.unified_anomalies(tx(spark, d), sc(spark, d), 20)


@query("e8_unified_anomalies", unified("SELECT * REPLACE (score_severidad::DOUBLE AS score_severidad) FROM anomalias"))
def e8(spark, d):
    return anomalies(spark, d)


@query("e9_rule_anomalies", unified("""
SELECT pk, regla_violada, score_severidad::DOUBLE AS score_severidad FROM anomalias WHERE tipo_deteccion = 'ESTADISTICA'
  AND score_severidad >= 0.7 ORDER BY score_severidad DESC, pk, regla_violada LIMIT 100"""))
def e9(spark, d):
    return rules.rule_anomalies(anomalies(spark, d), min_severity=0.7).select("pk", "regla_violada", "score_severidad")


@query("e9_model_anomalies", unified("""
SELECT pk, departamento, score_severidad::DOUBLE AS score_severidad FROM anomalias WHERE tipo_deteccion = 'ML' AND score_severidad >= 0.7
  AND departamento = 'NATION_7' ORDER BY score_severidad DESC, pk LIMIT 100"""))
def e9b(spark, d):
    found = rules.model_anomalies(anomalies(spark, d), 0.7, "nation_7")
    return found.select("pk", "departamento", "score_severidad")


@query("e10_reviews_marked", over("cl", """
SELECT pk, CASE WHEN tipo_error = 'YEAR_INVALIDO' THEN 'REVISADO' ELSE 'PENDIENTE' END AS estado_revision,
  CASE WHEN tipo_error = 'YEAR_INVALIDO' THEN 'fecha corregida' END AS comentario_revision
FROM cl WHERE calidad_datos IN ('ERROR', 'ADVERTENCIA')"""))
def e10(spark, d):
    queue = cleaning.review_queue(cl(spark, d), day(AS_OF).cast("timestamp"))
    wrong = queue.where(F.col("tipo_error") == "YEAR_INVALIDO").select("pk").distinct()
    decisions = wrong.select("pk", F.lit("REVISADO").alias("estado_revision"), F.lit("fecha corregida").alias("comentario_revision"))
    return rules.mark_reviewed(queue, decisions).select("pk", "estado_revision", "comentario_revision")


TOWNS = """
SELECT departamento, municipio, count(*) AS transaction_count, round(avg(valor_acto), 2) AS average_value,
  count(*) FILTER (WHERE risk_classification = 'high-risk') AS high_risk_count,
  count(*) FILTER (WHERE risk_classification = 'suspicious') AS suspicious_count,
  count(*) FILTER (WHERE risk_classification = 'normal') AS normal_count,
  round(count(*) FILTER (WHERE is_anomaly) / count(*), 6) AS anomaly_rate
FROM sc WHERE municipio IS NOT NULL {where} GROUP BY 1, 2"""


@query("e11_municipality_map", over("sc", TOWNS.format(where="")))
def e11(spark, d):
    found = dashboard.municipality_map(sc(spark, d))
    return rounded(found.drop("nivel", "color", "radio"), 6, average_value=2)


@query("e11_filtered_map", over("sc", TOWNS.format(where="AND departamento = 'NATION_3' AND fecha_radicacion BETWEEN DATE '2007-01-01' AND DATE '2009-12-31' AND risk_classification = 'high-risk'")))
def e11b(spark, d):
    rows = dashboard.map_rows(sc(spark, d), "nation_3", day("2007-01-01"), day("2009-12-31"), "high-risk")
    return rounded(dashboard.municipality_map(rows).drop("nivel", "color", "radio"), 6, average_value=2)


@query("e11_geo_features", over("sc", """
SELECT departamento, municipio, 'Feature' AS tipo, n AS transaction_count FROM (SELECT departamento, municipio, count(*) AS n
FROM sc WHERE municipio IS NOT NULL GROUP BY 1, 2)"""))
def e11c(spark, d):
    found = dashboard.geo_features(dashboard.municipality_map(sc(spark, d)))
    return found.select(
        "departamento", "municipio", F.get_json_object("feature", "$.type").alias("tipo"),
        F.get_json_object("feature", "$.properties.transaction_count").cast("long").alias("transaction_count"),
    )


@query("e12_heat_map", over("sc", """
SELECT departamento, municipio, n::DOUBLE AS value, round((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()), 6) AS intensity
FROM (SELECT departamento, municipio, count(*) AS n FROM sc WHERE municipio IS NOT NULL GROUP BY 1, 2)"""))
def e12(spark, d):
    return rounded(dashboard.heat_map(dashboard.municipality_map(sc(spark, d)), "transaction_count"), 6)


@query("e13_municipalities_of_department", over("tx", "SELECT DISTINCT departamento, municipio FROM tx WHERE upper(departamento) = 'NATION_5'"))
def e13(spark, d):
    return dashboard.municipalities_of(tx(spark, d), "nation_5")


def period_sql(days):
    now = f"(f > DATE '{AS_OF}' - {days} AND f <= DATE '{AS_OF}')"
    before = f"(f > DATE '{AS_OF}' - {2 * days} AND f <= DATE '{AS_OF}' - {days})"
    n, a, v = "count(*) FILTER (WHERE {p})", "count(*) FILTER (WHERE {p} AND is_anomaly)", "avg(valor_acto) FILTER (WHERE {p})"
    change = "round(({x} - {y}) * 100.0 / nullif({y}, 0), 4)"
    pairs = {c: (t.format(p=now), t.format(p=before)) for c, t in {"transacciones": n, "anomalias": a, "valor": v}.items()}
    return f"""
SELECT {pairs['transacciones'][0]} AS transacciones, round({pairs['anomalias'][0]} * 100.0 / nullif({pairs['transacciones'][0]}, 0), 4) AS tasa_anomalias,
  round({pairs['valor'][0]}, 4) AS valor_promedio,
  round(count(*) FILTER (WHERE {now} AND calidad_datos = 'OK') * 100.0 / nullif({pairs['transacciones'][0]}, 0), 4) AS calidad_datos,
  count(DISTINCT municipio) FILTER (WHERE {now}) AS municipios,
  {', '.join(f"{change.format(x=x, y=y)} AS cambio_{c}" for c, (x, y) in pairs.items())}
FROM (SELECT *, fecha_radicacion AS f FROM sc)"""


@query("e14_indicators", over("sc", period_sql(90)))
def e14(spark, d):
    return rounded(dashboard.indicators(sc(spark, d), AS_OF, 90))


@query("e14_indicators_year", over("sc", period_sql(365)))
def e14b(spark, d):
    return rounded(dashboard.indicators(sc(spark, d), AS_OF, 365))


@query("e15_anomaly_type_shares", over("fl", """
SELECT tipo, count(*) AS cantidad, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS porcentaje FROM (
  SELECT 'Valores atípicos' AS tipo FROM fl WHERE valor_acto < 10000000 OR valor_acto > 5000000000
  UNION ALL SELECT 'Duplicidad sospechosa' FROM fl WHERE flag_actividad_excesiva
  UNION ALL SELECT 'Errores de anotación' FROM fl WHERE flag_geo_discrepancia
  UNION ALL SELECT 'Inconsistencia temporal' FROM fl WHERE year(fecha_radicacion) <> year_radica
  UNION ALL SELECT 'Datos incompletos' FROM fl WHERE departamento IS NULL OR valor_acto IS NULL OR year_radica IS NULL) GROUP BY tipo"""))
def e15(spark, d):
    return rounded(dashboard.anomaly_type_shares(fl(spark, d)))


@query("e16_worst_municipalities", over("sc", """
SELECT municipio, year_radica, alertas, tasa, CASE WHEN tasa > previa THEN 'up' WHEN tasa < previa THEN 'down' ELSE 'flat' END AS tendencia
FROM (SELECT *, lag(tasa) OVER (PARTITION BY municipio ORDER BY year_radica) AS previa,
    row_number() OVER (PARTITION BY municipio ORDER BY year_radica DESC) AS r
  FROM (SELECT municipio, year_radica, count(*) FILTER (WHERE is_anomaly) AS alertas,
    round(count(*) FILTER (WHERE is_anomaly) * 100.0 / count(*), 4) AS tasa
    FROM sc WHERE municipio IS NOT NULL AND year_radica IS NOT NULL GROUP BY 1, 2)) WHERE r = 1
ORDER BY alertas DESC, municipio LIMIT 5"""))
def e16(spark, d):
    return dashboard.worst_municipalities(sc(spark, d))


@query("e17_alert_feed", over("tx", """
SELECT 'fraude' AS alert_type, 'alta' AS severity, municipio AS sujeto, date_trunc('month', fecha_radicacion)::DATE AS mes, count(*) AS cantidad
FROM tx WHERE municipio IS NOT NULL AND fecha_radicacion IS NOT NULL AND valor_acto > 0 AND valor_acto < 10000000 GROUP BY 3, 4 HAVING count(*) >= 15
UNION ALL SELECT 'anomalia', 'media', municipio, mes, n FROM (SELECT *, avg(n) OVER (PARTITION BY municipio) AS m FROM (
  SELECT municipio, date_trunc('month', fecha_radicacion)::DATE AS mes, count(*) AS n FROM tx
  WHERE municipio IS NOT NULL AND fecha_radicacion IS NOT NULL GROUP BY 1, 2)) WHERE n > m * 1.4
UNION ALL SELECT 'calidad', 'media', municipio, NULL, count(*) FROM tx WHERE municipio IS NOT NULL
  AND (departamento IS NULL OR valor_acto IS NULL OR year_radica IS NULL) GROUP BY 3
UNION ALL SELECT 'fraude', 'alta', matricula, date_trunc('month', fecha_radicacion)::DATE, count(*) FROM tx
  WHERE fecha_radicacion IS NOT NULL GROUP BY 3, 4 HAVING count(*) >= 3"""))
def e17(spark, d):
    return dashboard.alert_feed(tx(spark, d), repeated=3).select("alert_type", "severity", "sujeto", "mes", "cantidad")


@query("e18_five_number_summary", over("ml", """
SELECT tipo_predio, count(*) AS n, min(valor_acto) AS minimo, round(quantile_cont(valor_acto, 0.25), 2) AS q1,
  round(quantile_cont(valor_acto, 0.5), 2) AS mediana, round(quantile_cont(valor_acto, 0.75), 2) AS q3, max(valor_acto) AS maximo
FROM ml GROUP BY 1"""))
def e18(spark, d):
    return rounded(outliers.five_numbers(dataset(cl(spark, d), "ml_training"), ["tipo_predio"], "valor_acto"), 2)


@query("e18_price_trend", over("ml", """
SELECT departamento, year_radica, count(*) AS transacciones, round(avg(valor_acto), 2) AS valor_promedio,
  round(quantile_cont(valor_acto, 0.5), 2) AS valor_mediano FROM ml GROUP BY 1, 2"""))
def e18b(spark, d):
    return rounded(yearly_trend(dataset(cl(spark, d), "ml_training")), 2)


@query("e18_value_against_median", over("ml", """
SELECT pk, round(valor_acto / md, 6) AS valor_vs_mediana_dept_year FROM ml
JOIN (SELECT departamento, year_radica, quantile_cont(valor_acto, 0.5) AS md FROM ml GROUP BY ALL) USING (departamento, year_radica)
JOIN (SELECT municipio, year_radica FROM ml GROUP BY ALL) USING (municipio, year_radica)"""))
def e18c(spark, d):
    return e6(spark, d).select("pk", "valor_vs_mediana_dept_year")
