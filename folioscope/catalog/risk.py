"""Rule scores, explanations, property reports and documented fraud rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.catalog.base import MAX_PER_YEAR, acts, flat, over, query, rounded, sc, sql_label, tx
from folioscope.operators import property, risk, rules

RULES = """least(1.0, (CASE WHEN valor_acto < 10000000 THEN 0.3 ELSE 0 END) + (CASE WHEN valor_acto > 5000000000 THEN 0.2 ELSE 0 END)
  + (CASE WHEN numero_intervinientes > 5 THEN 0.2 ELSE 0 END)
  + (CASE WHEN estado_folio IN ('cancelado', 'suspendido') THEN 0.3 ELSE 0 END))"""


@query("b6_rule_score", over("acts", f"SELECT pk, round({RULES}, 4)::DOUBLE AS score FROM acts"))
def b6(spark, d):
    return rounded(acts(spark, d).select("pk", risk.rule_score().alias("score")))


@query("b7_outside_usual_value", over("tx", "SELECT pk, coalesce(valor_acto < 10000000 OR valor_acto > 5000000000, false) AS anomalo FROM tx"))
def b7(spark, d):
    return tx(spark, d).select("pk", risk.outside_usual_value().alias("anomalo"))


@query("b8_simple_analysis", over("acts", """
SELECT pk, CASE WHEN valor_acto > 100000000 THEN 0.3 ELSE 0.6 END::DOUBLE AS anomaly_score,
  CASE WHEN valor_acto > 100000000 THEN 'normal' ELSE 'suspicious' END AS classification,
  'Transacción de tipo ' || tipo_acto || ' por valor de $' || format('{:,}', cast(valor_acto AS BIGINT)) || ' COP en ' || municipio AS explanation
FROM acts"""))
def b8(spark, d):
    return risk.simple_analysis(acts(spark, d)).select("pk", "anomaly_score", "classification", "explanation")


@query("b9_risk_classes", over("tx", f"""
SELECT pk, {sql_label('puntaje_a')} AS etiqueta,
  CASE WHEN puntaje_a < 0.4 THEN 0 WHEN puntaje_a < 0.7 THEN 1 WHEN puntaje_a >= 0.7 THEN 2 END AS codigo FROM tx"""))
def b9(spark, d):
    score = F.col("puntaje_a")
    return tx(spark, d).select("pk", risk.risk_label(score).alias("etiqueta"), risk.risk_code(score).alias("codigo"))


BY_THRESHOLD = "CASE WHEN {s} >= 0.7 THEN 'high-risk' WHEN {s} >= 0.7 * 0.6 THEN 'suspicious' ELSE 'normal' END"


@query("b10_risk_classes_by_threshold", over("tx", f"SELECT pk, {BY_THRESHOLD.format(s='puntaje_a')} AS clase FROM tx"))
def b10(spark, d):
    return tx(spark, d).select("pk", risk.risk_label_by_threshold(F.col("puntaje_a")).alias("clase"))


NAMES = """list_filter([CASE WHEN valor_acto < 50000000 THEN 'valor_acto' END,
  CASE WHEN numero_intervinientes > 3 THEN 'numero_intervinientes' END,
  CASE WHEN estado_folio <> 'activo' THEN 'estado_folio' END], lambda x: x IS NOT NULL)"""


@query("b11_contributing_features", over("acts", f"SELECT pk, array_to_string({NAMES}, ' | ') AS factores FROM acts"))
def b11(spark, d):
    found = acts(spark, d).select("pk", risk.contributing_features().alias("f"))
    return flat(found.select("pk", F.transform("f", lambda x: x["feature_name"]).alias("factores")))


EXPLAINED = f"""CASE WHEN clase = 'normal' THEN 'Transacción normal de ' || tipo_acto || ' en ' || municipio ||
    '. No se detectaron anomalías significativas.'
  WHEN clase = 'high-risk' THEN 'Transacción de ALTO RIESGO detectada. Factores principales: ' || array_to_string({NAMES}, ', ') ||
    '. Se recomienda revisión manual inmediata.'
  ELSE 'Transacción SOSPECHOSA. Revisar: ' || array_to_string({NAMES}, ', ') || '. Validación adicional recomendada.' END"""
CLASSED = f"SELECT *, {BY_THRESHOLD.format(s='puntaje_a')} AS clase FROM acts"


@query("b12_explanations", over("acts", f"SELECT pk, {EXPLAINED} AS explicacion FROM ({CLASSED})"))
def b12(spark, d):
    label = risk.risk_label_by_threshold(F.col("puntaje_a"))
    return acts(spark, d).select("pk", risk.explanation(label, risk.contributing_features()).alias("explicacion"))


def joined(items):
    return "'" + " | ".join(items) + "'"


ADVICE = f"""CASE clase WHEN 'normal' THEN {joined(K.NORMAL_ADVICE)} WHEN 'high-risk' THEN {joined(K.SUSPICIOUS_ADVICE + K.HIGH_RISK_ADVICE)}
  ELSE {joined(K.SUSPICIOUS_ADVICE)} END"""


@query("b13_recommendations", over("acts", f"SELECT pk, {ADVICE} AS recomendaciones FROM ({CLASSED})"))
def b13(spark, d):
    label = risk.risk_label_by_threshold(F.col("puntaje_a"))
    return flat(acts(spark, d).select("pk", risk.recommendations(label).alias("recomendaciones")))


SUMMARY = """
SELECT matricula, count(*) AS n, count(*) FILTER (WHERE valor_acto < 10000000 OR valor_acto > 5000000000) AS anomalias,
  avg(valor_acto) AS promedio, CASE WHEN count(*) FILTER (WHERE valor_acto > 0) > 1
    THEN stddev_pop(valor_acto) FILTER (WHERE valor_acto > 0) / avg(valor_acto) FILTER (WHERE valor_acto > 0) ELSE 0 END AS cv,
  min(valor_acto) FILTER (WHERE valor_acto > 0) AS bajo, max(valor_acto) FILTER (WHERE valor_acto > 0) AS alto,
  count(*) FILTER (WHERE valor_acto > 0) AS positivos FROM tx GROUP BY matricula"""
SCORED_SUMMARY = """
SELECT *, anomalias / n * 100 AS tasa, round_even(0.4 * least(anomalias / n * 100 / 50, 1) + 0.3 * least(cv, 1)
  + 0.3 * CASE WHEN n > 10 THEN least(n / 20, 1) ELSE 0 END, 3) AS score FROM resumen"""
ALERTS = f"""list_filter([
  CASE WHEN tasa > 30 THEN '{K.ALERT_RATE}' || format('{{:.1f}}', tasa) || '%)' END,
  CASE WHEN score > 0.7 THEN '{K.ALERT_SCORE_HIGH}' WHEN score > 0.4 THEN '{K.ALERT_SCORE_MEDIUM}' END,
  CASE WHEN n > 5 THEN '{K.ALERT_HISTORY}' || n || ' transacciones registradas)' END,
  CASE WHEN positivos > 1 AND alto > bajo * 3 THEN '{K.ALERT_SPREAD}' END], lambda x: x IS NOT NULL)"""


@query("b14_property_score", over("tx", "SELECT matricula, n AS total_transacciones, round(tasa, 4) AS tasa_anomalias, score AS score_riesgo FROM puntuado",
                                  resumen=SUMMARY, puntuado=SCORED_SUMMARY))
def b14(spark, d):
    found = property.property_summary(tx(spark, d))
    return rounded(found.select("matricula", "total_transacciones", "tasa_anomalias", "score_riesgo"))


@query("b15_property_alerts", over("tx", f"""
SELECT matricula, CASE WHEN len(a) > 0 THEN array_to_string(a, ' | ') ELSE '{K.ALERT_NONE}' END AS alertas
FROM (SELECT matricula, {ALERTS} AS a FROM puntuado)""", resumen=SUMMARY, puntuado=SCORED_SUMMARY))
def b15(spark, d):
    return flat(property.property_summary(tx(spark, d)).select("matricula", "alertas"))


STORED = """
SELECT matricula, count(*) AS n, count(*) FILTER (WHERE is_anomaly) AS anomalias, avg(valor_acto) FILTER (WHERE valor_acto > 0) AS promedio,
  round(sum(coalesce(anomaly_score, 0)) / count(*), 6) AS score, count(*) FILTER (WHERE is_anomaly) / count(*) * 100 AS tasa
FROM sc GROUP BY matricula"""
STORED_ALERTS = f"""list_filter([
  CASE WHEN tasa > 50 THEN '{K.STORED_RATE_HIGH}' WHEN tasa > 25 THEN '{K.STORED_RATE_MEDIUM}' END,
  CASE WHEN score >= 0.7 THEN '{K.STORED_SCORE_HIGH}' WHEN score >= 0.4 THEN '{K.STORED_SCORE_MEDIUM}' END,
  CASE WHEN n = 1 THEN '{K.STORED_SINGLE}' END,
  CASE WHEN promedio < 1000000 THEN '{K.STORED_LOW_PRICES}' END], lambda x: x IS NOT NULL)"""


@query("b16_stored_property_alerts", over("sc", f"""
SELECT matricula, n AS total_transacciones, round(tasa, 4) AS tasa_anomalias, round(promedio, 2) AS precio_promedio,
  round(score, 6) AS score_riesgo, CASE WHEN len(a) > 0 THEN array_to_string(a, ' | ') ELSE '{K.STORED_NONE}' END AS alertas
FROM (SELECT *, {STORED_ALERTS} AS a FROM guardado)""", guardado=STORED))
def b16(spark, d):
    found = property.stored_property_summary(sc(spark, d))
    columns = ["matricula", "total_transacciones", "tasa_anomalias", "precio_promedio", "score_riesgo", "alertas"]
    return flat(rounded(found.select(*columns), 4, precio_promedio=2, score_riesgo=6))


HISTORY = """coalesce(strftime(fecha_radicacion, '%Y-%m-%d'), '') || ':' || pk || ':' || coalesce(nombre_natujur, 'N/A') || ':' || coalesce(valor_acto, 0)::BIGINT || ':' ||
  coalesce(departamento, 'N/A') || ':' || coalesce(municipio, 'N/A') || ':' || coalesce(tipo_predio, 'N/A') || ':' || (coalesce(count_a, 0) + coalesce(count_de, 0))"""


def history_text(*also):
    """All fields of the entries of a history page, as text."""
    def entry(h):
        day = F.coalesce(F.date_format(h["fecha"], "yyyy-MM-dd"), F.lit(""))
        fields = [h["pk"], h["tipo_acto"], h["valor"].cast("long"), h["departamento"], h["municipio"], h["tipo_predio"], h["count_intervinientes"], *[f(h) for f in also]]
        return F.concat_ws(":", day, *[f.cast("string") for f in fields])

    return F.array_join(F.transform("historial", entry), " ").alias("historial")


@query("b20_property_report", over("tx", f"""
SELECT p.matricula, n AS total_transacciones, round(tasa, 3) AS tasa_anomalias, round(promedio, 4) AS precio_promedio, ultima AS precio_ultima,
  score AS score_riesgo, CASE WHEN len({ALERTS}) > 0 THEN array_to_string({ALERTS}, ' | ') ELSE '{K.ALERT_NONE}' END AS alertas,
  departamento, municipio, true AS encontrada, 1 AS paginas, historial FROM puntuado p
LEFT JOIN (SELECT matricula, valor_acto AS ultima FROM (SELECT *, row_number() OVER (PARTITION BY matricula
  ORDER BY coalesce(fecha_radicacion, DATE '1900-01-01') DESC, pk DESC) AS r FROM tx WHERE valor_acto > 0) WHERE r = 1) USING (matricula)
LEFT JOIN (SELECT matricula, departamento, coalesce(municipio, 'N/A') AS municipio FROM (SELECT *, row_number() OVER (PARTITION BY matricula
  ORDER BY coalesce(fecha_radicacion, DATE '1900-01-01'), pk) AS r FROM tx) WHERE r = 1) USING (matricula)
LEFT JOIN (SELECT matricula, string_agg({HISTORY} || ':' ||
  coalesce(valor_acto < 10000000 OR valor_acto > 5000000000, false), ' ' ORDER BY fecha_radicacion DESC NULLS LAST, pk DESC)
  AS historial FROM tx GROUP BY 1) USING (matricula)""", resumen=SUMMARY, puntuado=SCORED_SUMMARY))
def b20(spark, d):
    report = property.property_report(tx(spark, d))
    out = report.select(
        "matricula", "total_transacciones", "tasa_anomalias", "precio_promedio", "precio_ultima", "score_riesgo", "alertas",
        "ubicacion.departamento", "ubicacion.municipio", "encontrada", "paginas", history_text(lambda h: h["es_anomalo"]))
    return flat(rounded(out, 3, precio_promedio=4, precio_ultima=2))


@query("b20_stored_property_report", over("sc", f"""
SELECT g.matricula, n AS total_transacciones, round(tasa, 3) AS tasa_anomalias, round(promedio, 2) AS precio_promedio, ultima AS precio_ultima, round(score, 6) AS score_riesgo,
  CASE WHEN len({STORED_ALERTS}) > 0 THEN array_to_string({STORED_ALERTS}, ' | ') ELSE '{K.STORED_NONE}' END AS alertas,
  departamento, municipio, true AS encontrada, 1 AS paginas, historial FROM guardado g
LEFT JOIN (SELECT matricula, valor_acto AS ultima FROM (SELECT *, row_number() OVER (PARTITION BY matricula
  ORDER BY coalesce(fecha_radicacion, DATE '1900-01-01') DESC, pk DESC) AS r FROM sc WHERE valor_acto > 0) WHERE r = 1) USING (matricula)
LEFT JOIN (SELECT matricula, departamento, coalesce(municipio, 'N/A') AS municipio FROM (SELECT *, row_number() OVER (PARTITION BY matricula
  ORDER BY coalesce(fecha_radicacion, DATE '1900-01-01') DESC, pk DESC) AS r FROM sc WHERE departamento IS NOT NULL) WHERE r = 1)
  USING (matricula)
LEFT JOIN (SELECT matricula, string_agg({HISTORY} || ':' || is_anomaly || ':' || coalesce(floor(anomaly_score * 10000 + 0.5)::BIGINT::VARCHAR, ''), ' '
  ORDER BY fecha_radicacion DESC NULLS LAST, pk DESC) AS historial
  FROM sc GROUP BY 1) USING (matricula)""", guardado=STORED))
def b20b(spark, d):
    report = property.stored_property_report(sc(spark, d))
    score = lambda h: F.coalesce(F.floor(h["anomaly_score"] * 10000 + 0.5).cast("string"), F.lit(""))
    out = report.select(
        "matricula", "total_transacciones", "tasa_anomalias", "precio_promedio", "precio_ultima", "score_riesgo", "alertas",
        "ubicacion.departamento", "ubicacion.municipio", "encontrada", "paginas", history_text(lambda h: h["es_anomalo"], score))
    return flat(rounded(out, 2, score_riesgo=6, tasa_anomalias=3))


COMBINED = f"""SELECT *, 0.4 * (1 / (1 + exp(puntaje_a - 1))) + 0.3 * (1 / (1 + exp(puntaje_b - 1.0))) + 0.3 * {RULES} AS s
FROM (SELECT * REPLACE (coalesce(puntaje_a, 1.0) AS puntaje_a) FROM acts)"""


@query("b21_batch_analysis", over("acts", f"""
SELECT pk, round(s, 6)::DOUBLE AS anomaly_score, clase AS classification, {EXPLAINED} AS explanation, {ADVICE} AS recommendations
FROM (SELECT *, {BY_THRESHOLD.format(s='s')} AS clase FROM ({COMBINED}))
WHERE tipo_acto IN ('compraventa', 'hipoteca', 'donacion', 'permuta', 'dacion_pago', 'adjudicacion', 'sucesion', 'otro')
  AND valor_acto > 0 AND fecha_acto IS NOT NULL AND length(departamento) >= 2 AND length(municipio) >= 2
  AND tipo_predio IN ('urbano', 'rural', 'mixto') AND numero_intervinientes >= 1
  AND estado_folio IN ('activo', 'cancelado', 'cerrado', 'suspendido')
  AND coalesce(area_terreno > 0, true) AND coalesce(area_construida > 0, true)"""))
def b21(spark, d):
    from folioscope.operators.quality import constraint_messages

    good = acts(spark, d).where(F.size(constraint_messages()) == 0)
    forest = F.coalesce("puntaje_a", F.lit(1.0)) - 1
    analysed = risk.analyse(good, forest, F.col("puntaje_b") - 1)
    return flat(rounded(analysed.select("pk", "anomaly_score", "classification", "explanation", "recommendations"), 6))


TIERS = """CASE WHEN tasa > 0.2 THEN 'Alto riesgo' WHEN tasa > 0.15 THEN 'Riesgo medio' ELSE 'Bajo riesgo' END AS nivel,
  CASE WHEN tasa > 0.2 THEN '#ef4444' WHEN tasa > 0.15 THEN '#f59e0b' ELSE '#10b981' END AS color,
  CASE WHEN n > 10000 THEN 25 WHEN n > 5000 THEN 18 WHEN n > 2000 THEN 12 ELSE 8 END AS radio"""


@query("b19_map_tiers", over("sc", f"""
SELECT departamento, municipio, n, {TIERS} FROM (SELECT departamento, municipio, count(*) AS n,
  count(*) FILTER (WHERE is_anomaly) / count(*) AS tasa FROM sc WHERE municipio IS NOT NULL GROUP BY 1, 2)"""))
def b19(spark, d):
    from folioscope.operators.dashboard import municipality_map

    found = municipality_map(sc(spark, d))
    return found.select("departamento", "municipio", F.col("transaction_count").alias("n"), "nivel", "color", "radio")


# --- documented rules -----------------------------------------------------------------------------


@query("e1_cheap_urban", over("tx", """
SELECT pk, municipio, valor_acto FROM tx WHERE tipo_predio = 'URBANO' AND valor_acto < 10000000 AND municipio IN
  (SELECT municipio FROM tx WHERE municipio IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, municipio LIMIT 10)"""))
def e1(spark, d):
    return rules.cheap_urban(tx(spark, d)).select("pk", "municipio", "valor_acto")


MEDIANS = "SELECT departamento, year_radica, quantile_cont(valor_acto, 0.5) AS mediana FROM tx WHERE valor_acto IS NOT NULL GROUP BY 1, 2"


@query("e2_far_above_median", over("tx", """
SELECT pk, valor_acto, round(mediana, 2) AS valor_mediano FROM tx JOIN medianas USING (departamento, year_radica)
WHERE valor_acto > mediana * 20""", medianas=MEDIANS))
def e2(spark, d):
    rows = tx(spark, d)
    found = rules.far_above_median(rows, rules.department_year_medians(rows), 20)
    return rounded(found.select("pk", "valor_acto", "valor_mediano"), 2)


@query("e3_rural_above_urban", over("tx", """
SELECT pk, valor_acto FROM tx t WHERE tipo_predio = 'RURAL' AND valor_acto > (SELECT quantile_cont(valor_acto, 0.95) FROM tx u
  WHERE u.tipo_predio = 'URBANO' AND u.departamento = t.departamento)"""))
def e3(spark, d):
    return rules.rural_above_urban(tx(spark, d)).select("pk", "valor_acto")


@query("e4_traded_often", over("tx", f"""
SELECT matricula, year_radica, count(*) AS veces, sum(valor_acto) AS total FROM tx GROUP BY 1, 2 HAVING count(*) > {MAX_PER_YEAR}"""))
def e4(spark, d):
    return rules.traded_often(tx(spark, d))


@query("e5_repeated_values", over("tx", """
SELECT valor_acto, count(*) AS repeticiones, count(DISTINCT municipio) AS n_municipios,
  array_to_string(list_sort(list(DISTINCT municipio)), ' | ') AS municipios
FROM tx WHERE valor_acto IS NOT NULL GROUP BY 1 HAVING count(*) > 100 AND count(DISTINCT municipio) > 10"""))
def e5(spark, d):
    return flat(rules.repeated_values(tx(spark, d)))
