"""Grouped statistics, windows, top-k, profiles and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.catalog.base import AS_OF, acts, cl, day, fl, over, query, rounded, sc, tx, with_scores
from folioscope.catalog.etl import TOP50
from folioscope.operators import activity, cleaning, monitoring, profiling, property, quality, statistics
from folioscope.session import scratch_path
from folioscope.sources import readers


def ml(spark, d):
    return quality.dataset(cl(spark, d), "ml_training")


# --- grouped statistics ---------------------------------------------------------------------------


@query("a1_department_year_stats", over("ml", """
SELECT departamento, year_radica AS year, count(valor_acto) AS transacciones, round(avg(valor_acto), 2) AS valor_medio,
  round(quantile_cont(valor_acto, 0.5), 2) AS valor_mediano, round(stddev_samp(valor_acto), 1) AS valor_std,
  min(valor_acto) AS valor_min, max(valor_acto) AS valor_max, count(pk) AS total_registros
FROM ml WHERE departamento IS NOT NULL AND year_radica IS NOT NULL GROUP BY ALL"""))
def a1(spark, d):
    return rounded(statistics.department_year_stats(ml(spark, d)), 2, valor_std=1)


@query("a2_municipality_year_stats", over("ml", f"""
SELECT municipio, departamento, year_radica AS year, count(valor_acto) AS transacciones, round(avg(valor_acto), 2) AS valor_medio,
  round(quantile_cont(valor_acto, 0.5), 2) AS valor_mediano, round(stddev_samp(valor_acto), 1) AS valor_std,
  count(pk) AS total_registros
FROM ml WHERE municipio IN {TOP50} AND departamento IS NOT NULL AND year_radica IS NOT NULL GROUP BY ALL"""))
def a2(spark, d):
    return rounded(statistics.municipality_year_stats(ml(spark, d)), 2, valor_std=1)


@query("a3_property_kind_year_stats", over("ml", """
SELECT tipo_predio, year_radica AS year, count(valor_acto) AS transacciones, round(avg(valor_acto), 2) AS valor_medio,
  round(quantile_cont(valor_acto, 0.5), 2) AS valor_mediano, count(pk) AS total_registros
FROM ml WHERE tipo_predio IS NOT NULL AND year_radica IS NOT NULL GROUP BY ALL"""))
def a3(spark, d):
    return rounded(statistics.property_kind_year_stats(ml(spark, d)), 2)


@query("a4_most_frequent_department", over("expected", "SELECT orip, depto_esperado_orip FROM expected"))
def a4(spark, d):
    return activity.most_frequent(tx(spark, d), "orip", "departamento", "depto_esperado_orip")


@query("a5_group_sizes", over("tx", "SELECT matricula, year_radica, count(*) AS n FROM tx GROUP BY ALL"))
def a5(spark, d):
    return activity.group_sizes(tx(spark, d), ["matricula", "year_radica"])


@query("a6_department_summary", over("cl", """
SELECT departamento, count(*) AS total_transacciones, count(*) FILTER (WHERE es_mercado_valido) AS transacciones_mercado,
  count(*) FILTER (WHERE valor_valido) AS transacciones_valor_valido,
  count(*) FILTER (WHERE calidad_datos = 'ERROR') AS registros_error,
  count(*) FILTER (WHERE calidad_datos = 'ADVERTENCIA') AS registros_advertencia,
  round(avg(valor_acto) FILTER (WHERE valor_valido), 2) AS valor_promedio,
  round(quantile_cont(valor_acto, 0.5) FILTER (WHERE valor_valido), 2) AS valor_mediano
FROM cl WHERE year_radica >= 2012 - 5 GROUP BY departamento"""))
def a6(spark, d):
    return rounded(statistics.department_summary(cl(spark, d), 2012), 2)


@query("a7_yearly_trend", over("cl", """
SELECT departamento, year_radica, count(*) AS transacciones, round(avg(valor_acto), 2) AS valor_promedio,
  round(quantile_cont(valor_acto, 0.5), 2) AS valor_mediano
FROM cl WHERE es_mercado_valido AND valor_valido GROUP BY ALL"""))
def a7(spark, d):
    return rounded(statistics.yearly_trend(cl(spark, d)), 2)


@query("a8_error_types", over("cl", """
SELECT tipo_error, calidad_datos, count(*) AS cantidad, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS porcentaje
FROM cl WHERE tipo_error IS NOT NULL GROUP BY tipo_error, calidad_datos"""))
def a8(spark, d):
    return rounded(statistics.error_types(cl(spark, d)))


@query("a9_dashboard_stats", over("sc", """
SELECT count(*) AS total_transactions, count(*) FILTER (WHERE calidad_datos = 'OK') AS clean_transactions,
  count(*) FILTER (WHERE anomaly_score > 0.7) AS high_risk_count,
  count(*) FILTER (WHERE anomaly_score BETWEEN 0.4 AND 0.7) AS suspicious_count,
  round(avg(valor_acto), 2) AS avg_transaction_value, count(DISTINCT municipio) AS municipalities_covered,
  max(fecha_radicacion) AS last_updated FROM sc"""))
def a9(spark, d):
    return rounded(statistics.dashboard_stats(sc(spark, d), "fecha_radicacion"), 2)


@query("a10_metric_table", over("tx", f"""
SELECT 'total_transactions' AS metric_name, cast(count(*) AS DOUBLE) AS metric_value, DATE '{AS_OF}' AS metric_date,
  NULL AS departamento, NULL AS municipio FROM tx
UNION ALL SELECT 'transactions_by_dept', cast(count(*) AS DOUBLE), DATE '{AS_OF}', departamento, NULL FROM tx
  WHERE departamento IS NOT NULL GROUP BY departamento
UNION ALL SELECT 'avg_transaction_value', round(avg(valor_acto), 2), DATE '{AS_OF}', NULL, municipio FROM tx
  WHERE valor_acto IS NOT NULL AND municipio IS NOT NULL GROUP BY municipio"""))
def a10(spark, d):
    return rounded(statistics.metric_table(tx(spark, d), day(AS_OF)), 2)


@query("a11_dataset_statistics", over("acts", """
SELECT count(*) AS total_records, min(fecha_acto) AS date_min, max(fecha_acto) AS date_max,
  round(avg(valor_acto), 2) AS valor_mean, round(quantile_cont(valor_acto, 0.5), 2) AS valor_median,
  min(valor_acto) AS valor_min, max(valor_acto) AS valor_max, count(DISTINCT departamento) AS departamentos,
  count(DISTINCT municipio) AS municipios,
  (SELECT string_agg(tipo_acto || '=' || n, ',' ORDER BY tipo_acto) FROM (SELECT tipo_acto, count(*) AS n FROM acts GROUP BY 1))
    AS tipos_acto FROM acts"""))
def a11(spark, d):
    rows = acts(spark, d)
    stats = statistics.with_act_types(rounded(statistics.dataset_statistics(rows), 2), statistics.act_type_counts(rows))
    entries = F.transform(F.array_sort(F.map_entries("tipos_acto")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stats.withColumn("tipos_acto", F.array_join(entries, ","))


@query("a11_act_types", over("acts", "SELECT tipo_acto, count(*) AS n FROM acts WHERE tipo_acto IS NOT NULL GROUP BY 1"))
def a11b(spark, d):
    return statistics.act_type_counts(acts(spark, d))


@query("a12_property_totals", over("sc", """
SELECT count(DISTINCT matricula) AS total_propiedades, count(pk) AS total_transacciones,
  count(*) FILTER (WHERE is_anomaly) AS transacciones_anomalas,
  round(count(*) FILTER (WHERE is_anomaly) * 100.0 / count(*), 4) AS tasa_anomalias_global,
  round(count(pk) / count(DISTINCT matricula), 4) AS promedio_tx_por_propiedad FROM sc"""))
def a12(spark, d):
    return rounded(statistics.property_totals(sc(spark, d)))


@query("a13_score_coverage", over("sc", """
SELECT count(*) AS total, count(anomaly_score) AS con_scores, round(count(anomaly_score) * 100.0 / count(*), 4) AS coverage_pct FROM sc"""))
def a13(spark, d):
    return rounded(statistics.score_coverage(sc(spark, d)))


PROFILED = ["matricula", "year_radica", "orip", "departamento", "municipio", "tipo_predio", "valor_acto"]


@query("a14_column_profile", over("tx", " UNION ALL ".join(
    f"""SELECT '{c}' AS columna, '{t}' AS tipo, count(*) - count({c}) AS nulos,
  round((count(*) - count({c})) * 100.0 / count(*), 4) AS nulos_pct, count(DISTINCT {c}) AS unicos FROM tx"""
    for c, t in zip(PROFILED, ["string", "int", "double", "string", "string", "string", "double"]))))
def a14(spark, d):
    return rounded(profiling.column_profile(tx(spark, d).select(*PROFILED)))


@query("a14_numeric_profile", over("tx", " UNION ALL ".join(
    f"""SELECT '{c}' AS columna, cast(min({c}) AS DOUBLE) AS minimo, cast(max({c}) AS DOUBLE) AS maximo, round(avg({c}), 2) AS media,
  round(quantile_cont({c}, 0.5), 2) AS mediana FROM tx""" for c in ("year_radica", "orip", "valor_acto"))))
def a14b(spark, d):
    return rounded(profiling.numeric_profile(tx(spark, d).select("year_radica", "orip", "valor_acto")), 2)


@query("a14_category_profile", over("tx", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS columna, {c} AS valor, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM tx), 4) AS porcentaje
  FROM tx WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) FROM tx) <= 50 GROUP BY {c} ORDER BY n DESC, valor LIMIT 5)"""
    for c in ("departamento", "municipio", "tipo_predio", "nombre_natujur"))))
def a14c(spark, d):
    return rounded(profiling.category_profile(tx(spark, d), ["departamento", "municipio", "tipo_predio", "nombre_natujur"]))


@query("a15_value_summary", over("tx", """
SELECT count(*) AS total, count(valor_acto) AS con_valor, count(*) - count(valor_acto) AS sin_valor, min(valor_acto) AS minimo,
  max(valor_acto) AS maximo, round(avg(valor_acto), 2) AS media, round(stddev_samp(valor_acto), 1) AS desviacion,
  round(quantile_cont(valor_acto, 0.5), 2) AS mediana FROM tx"""))
def a15(spark, d):
    return rounded(statistics.value_statistics(tx(spark, d)), 2, desviacion=1)


@query("a16_value_histogram", over("tx", """
SELECT CASE WHEN valor_acto > 0 AND valor_acto <= 1e7 THEN '< 10M' WHEN valor_acto > 1e7 AND valor_acto <= 5e7 THEN '10M-50M'
  WHEN valor_acto > 5e7 AND valor_acto <= 1e8 THEN '50M-100M' WHEN valor_acto > 1e8 AND valor_acto <= 5e8 THEN '100M-500M'
  WHEN valor_acto > 5e8 THEN '> 500M' END AS rango, count(*) AS n FROM tx WHERE valor_acto > 0 GROUP BY rango"""))
def a16(spark, d):
    return profiling.value_histogram(tx(spark, d), F.col("valor_acto"), K.VALUE_EDGES_5, K.VALUE_LABELS_5)


@query("a16_valid_value_histogram", over("tx", """
SELECT CASE WHEN valor_acto <= 1e7 THEN '1M-10M' WHEN valor_acto <= 5e7 THEN '10M-50M' WHEN valor_acto <= 1e8 THEN '50M-100M'
  WHEN valor_acto <= 5e8 THEN '100M-500M' WHEN valor_acto <= 1e9 THEN '500M-1B' ELSE '1B-10B' END AS rango, count(*) AS n
FROM tx WHERE valor_acto > 1e6 AND valor_acto <= 1e10 GROUP BY rango"""))
def a16b(spark, d):
    return profiling.value_histogram(tx(spark, d), F.col("valor_acto"), K.VALUE_EDGES_6, K.VALUE_LABELS_6)


@query("a17_market_comparison", over("tx", """
SELECT dinamica_inmobiliaria, count(*) AS total, count(valor_texto) AS con_texto, count(valor_acto) AS numericos,
  count(*) FILTER (WHERE valor_acto = 0) AS ceros, count(*) FILTER (WHERE valor_acto > 0) AS positivos,
  count(*) FILTER (WHERE valor_acto BETWEEN 1000000 AND 10000000000) AS validos,
  round(avg(valor_acto) FILTER (WHERE valor_acto > 0), 2) AS media_positivos,
  round(avg(valor_acto) FILTER (WHERE valor_acto BETWEEN 1000000 AND 10000000000), 2) AS media_validos,
  round(quantile_cont(valor_acto, 0.5) FILTER (WHERE valor_acto > 0), 2) AS mediana_positivos
FROM tx WHERE dinamica_inmobiliaria IN (0, 1) GROUP BY ALL"""))
def a17(spark, d):
    return rounded(profiling.market_comparison(tx(spark, d)), 2)


@query("a18_frequency_table", over("tx", """
SELECT municipio, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM tx), 4) AS porcentaje FROM tx
WHERE municipio IS NOT NULL GROUP BY municipio ORDER BY n DESC, municipio LIMIT 10"""))
def a18(spark, d):
    return rounded(statistics.frequency_table(tx(spark, d), "municipio", 10))


@query("a20_batch_summary", over("sc", """
SELECT count(*) AS total_transactions, count(*) FILTER (WHERE risk_classification = 'normal') AS normal_count,
  count(*) FILTER (WHERE risk_classification = 'suspicious') AS suspicious_count,
  count(*) FILTER (WHERE risk_classification = 'high-risk') AS high_risk_count, round(avg(anomaly_score), 4) AS average_score FROM sc"""))
def a20(spark, d):
    return rounded(statistics.batch_summary(sc(spark, d).withColumnRenamed("risk_classification", "classification")))


@query("a21_run_report", over("cl", """
SELECT count(*) AS registros_entrada, count(*) FILTER (WHERE ml) AS registros_salida, count(*) FILTER (WHERE NOT ml) AS registros_descartados,
  count(*) FILTER (WHERE calidad_datos = 'ERROR') AS registros_con_errores,
  count(*) FILTER (WHERE calidad_datos = 'ADVERTENCIA') AS registros_sospechosos,
  round(count(*) FILTER (WHERE ml) * 100.0 / count(*), 4) AS tasa_aprovechamiento
FROM (SELECT *, es_mercado_valido AND valor_valido AND calidad_datos = 'OK' AS ml FROM cl)"""))
def a21(spark, d):
    return rounded(statistics.run_report(cl(spark, d)))


@query("a22_risk_class_shares", over("sc", """
SELECT risk_classification, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM sc), 4) AS porcentaje FROM sc GROUP BY 1"""))
def a22(spark, d):
    return rounded(statistics.shares(sc(spark, d), ["risk_classification"]))


STEPS = [
    ("mercado", "dinamica_inmobiliaria = 1"), ("valor presente", "valor_texto IS NOT NULL"), ("valor numérico", "valor_acto IS NOT NULL"),
    ("valor mayor que cero", "valor_acto > 0"), ("valor mínimo", "valor_acto >= 1000000"), ("valor máximo", "valor_acto <= 10000000000"),
]


def funnel_sql():
    parts = []
    for i, (name, _) in enumerate(STEPS, 1):
        now = " AND ".join(f"({c})" for _, c in STEPS[:i])
        before = " AND ".join(f"({c})" for _, c in STEPS[: i - 1]) or "true"
        n, b = f"count(*) FILTER (WHERE {now})", f"count(*) FILTER (WHERE {before})"
        parts.append(f"SELECT {i} AS paso, '{name}' AS filtro, {b} - {n} AS descartados, {n} AS restantes, "
                     f"round(({b} - {n}) * 100.0 / count(*), 4) AS descartados_pct FROM tx")
    return " UNION ALL ".join(parts)


@query("a23_filter_funnel", over("tx", funnel_sql()))
def a23(spark, d):
    return rounded(profiling.filter_funnel(tx(spark, d)))


@query("a24_unparsable_values", over("tx", """
SELECT valor_texto, count(*) AS n FROM tx WHERE valor_texto IS NOT NULL AND valor_acto IS NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50"""))
def a24(spark, d):
    return profiling.frequent_unparsable(tx(spark, d))


@query("a25_code_structure", over("tx", """
SELECT 'longitud' AS medida, cast(length(divipola) AS VARCHAR) AS valor, count(*) AS n FROM tx WHERE divipola IS NOT NULL GROUP BY 2
UNION ALL SELECT 'prefijo', substr(divipola, 1, 2), count(*) FROM tx WHERE divipola IS NOT NULL GROUP BY 2"""))
def a25(spark, d):
    return profiling.code_structure(tx(spark, d))


@query("a25_office_summary", over("tx", """
SELECT count(orip) AS n, round(avg(orip), 4) AS media, round(stddev_samp(orip), 4) AS desviacion, min(orip) AS minimo, max(orip) AS maximo,
  quantile_cont(orip, 0.25) AS q25, quantile_cont(orip, 0.5) AS q50, quantile_cont(orip, 0.75) AS q75 FROM tx"""))
def a25b(spark, d):
    return rounded(profiling.number_summary(tx(spark, d), "orip"))


@query("a26_missing_per_column", over("tx", " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(*) FILTER (WHERE {c} IS NULL) AS nulos FROM tx" for c in PROFILED)))
def a26(spark, d):
    return profiling.missing_per_column(tx(spark, d).select(*PROFILED))


@query("a27_copies_dropped", "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def a27(spark, d):
    rows = readers.read_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return cleaning.drop_copies(rows.unionByName(rows))


# --- windows and top-k ------------------------------------------------------------------------------


@query("w1_group_count_on_rows", over("tx", """
SELECT pk, CASE WHEN matricula IS NULL OR year_radica IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY matricula, year_radica) END
  AS anotaciones_por_anio FROM tx"""))
def w1(spark, d):
    return activity.with_yearly_annotations(tx(spark, d).select("pk", "matricula", "year_radica")).select("pk", "anotaciones_por_anio")


@query("w2_share_of_total", over("cl", """
SELECT calidad_datos, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS porcentaje FROM cl GROUP BY calidad_datos"""))
def w2(spark, d):
    return rounded(statistics.shares(cl(spark, d), ["calidad_datos"]))


@query("w3_latest_price", over("tx", """
SELECT matricula, valor_acto AS precio_ultima FROM (SELECT *, row_number() OVER (PARTITION BY matricula
  ORDER BY coalesce(fecha_radicacion, DATE '1900-01-01') DESC, pk DESC) AS r FROM tx WHERE valor_acto > 0) WHERE r = 1"""))
def w3(spark, d):
    rows = tx(spark, d).where(F.col("valor_acto") > 0)
    return rows.groupBy("matricula").agg(property.latest_price().alias("precio_ultima"))


@query("w4_ordered_history", over("tx", """
SELECT matricula, string_agg(pk, ' ' ORDER BY fecha_radicacion DESC NULLS LAST, pk DESC) AS historial FROM tx GROUP BY matricula"""))
def w4(spark, d):
    history = property.property_history(tx(spark, d), F.lit(False))
    return history.select("matricula", F.array_join(F.transform("historial", lambda h: h["pk"]), " ").alias("historial"))


@query("w5_first_place", over("tx", """
SELECT matricula, departamento, coalesce(municipio, 'N/A') AS municipio FROM (SELECT *, row_number() OVER (PARTITION BY matricula
  ORDER BY coalesce(fecha_radicacion, DATE '1900-01-01'), pk) AS r FROM tx) WHERE r = 1"""))
def w5(spark, d):
    found = tx(spark, d).groupBy("matricula").agg(property.first_place().alias("u"))
    return found.select("matricula", "u.departamento", "u.municipio")


@query("l1_top_municipalities", over("ml", """
SELECT municipio, count(*) AS n FROM ml WHERE municipio IS NOT NULL GROUP BY municipio ORDER BY n DESC, municipio LIMIT 50"""))
def l1(spark, d):
    return statistics.top_values(ml(spark, d), "municipio", 50)


@query("l2_largest_values", over("tx", "SELECT pk, valor_acto FROM tx WHERE valor_acto IS NOT NULL ORDER BY valor_acto DESC, pk LIMIT 30"))
def l2(spark, d):
    return profiling.largest_values(tx(spark, d).select("pk", "valor_acto"))


@query("l3_by_score_nulls_last", over("sc", "SELECT pk, anomaly_score FROM sc ORDER BY anomaly_score DESC NULLS LAST, pk"))
def l3(spark, d):
    return sc(spark, d).select("pk", "anomaly_score").orderBy(F.desc_nulls_last("anomaly_score"), "pk")


@query("l4_page", over("tx", "SELECT pk, valor_acto FROM tx ORDER BY pk LIMIT 200 OFFSET 400"))
def l4(spark, d):
    return monitoring.page(tx(spark, d).select("pk", "valor_acto"), ["pk"], 400, 200)


@query("l5_first_high_risk", over("sc", """
SELECT pk, anomaly_score FROM sc WHERE risk_classification = 'high-risk' ORDER BY anomaly_score DESC, pk LIMIT 100"""))
def l5(spark, d):
    rows = sc(spark, d).withColumnRenamed("risk_classification", "classification")
    return monitoring.first_high_risk(rows).select("pk", "anomaly_score")


# --- monitoring ---------------------------------------------------------------------------------------


@query("q1_risk_class_shares", over("sc", """
SELECT risk_classification, count(*) AS total, round(cast(count(*) * 100.0 / (SELECT count(*) FROM sc) AS DECIMAL(20, 8)), 2)::DOUBLE AS percentage
FROM sc WHERE anomaly_score IS NOT NULL GROUP BY 1"""))
def q1(spark, d):
    return monitoring.risk_class_shares(sc(spark, d))


@query("q2_departments_by_anomaly_rate", over("sc", """
SELECT departamento, count(*) AS total_transactions, count(*) FILTER (WHERE is_anomaly) AS anomalies,
  round(cast(count(*) FILTER (WHERE is_anomaly) * 100.0 / count(*) AS DECIMAL(20, 8)), 2)::DOUBLE AS anomaly_rate
FROM sc GROUP BY departamento ORDER BY anomaly_rate DESC, departamento NULLS LAST LIMIT 10"""))
def q2(spark, d):
    return monitoring.departments_by_anomaly_rate(sc(spark, d))


def histogram_sql(bands):
    cases = " ".join(f"WHEN anomaly_score < {edge} THEN '{label}'" for edge, label in bands[:-1])
    return f"""SELECT CASE {cases} ELSE '{bands[-1][1]}' END AS score_range, count(*) AS count
FROM sc WHERE anomaly_score IS NOT NULL GROUP BY 1"""


@query("q3_score_histogram", over("sc", histogram_sql(K.SCORE_BANDS)))
def q3(spark, d):
    return monitoring.score_histogram(sc(spark, d))


@query("q3_score_histogram_named", over("sc", histogram_sql(K.SCORE_BANDS_NAMED)))
def q3b(spark, d):
    return monitoring.score_histogram(sc(spark, d), K.SCORE_BANDS_NAMED)


@query("q4_score_coverage", over("sc", """
SELECT count(*) AS total, count(anomaly_score) AS con_scores, round(cast(count(anomaly_score) * 100.0 / count(*) AS DECIMAL(20, 8)), 2)::DOUBLE AS coverage_pct FROM sc"""))
def q4(spark, d):
    return rounded(statistics.score_coverage(sc(spark, d)), 2)


@query("q5_top_anomalies", over("sc", """
SELECT pk, matricula, departamento, anomaly_score, risk_classification FROM sc WHERE is_anomaly
ORDER BY anomaly_score DESC, pk LIMIT 10"""))
def q5(spark, d):
    return monitoring.top_anomalies(sc(spark, d))


@query("q6_busiest_properties", over("tx", "SELECT matricula, count(*) AS total FROM tx GROUP BY 1 ORDER BY total DESC, matricula LIMIT 10"))
def q6(spark, d):
    return monitoring.busiest_properties(tx(spark, d))


@query("q7_most_expensive", over("tx", """
SELECT pk, matricula, departamento, municipio, valor_acto, nombre_natujur FROM tx WHERE valor_acto IS NOT NULL
ORDER BY valor_acto DESC, pk LIMIT 10"""))
def q7(spark, d):
    return monitoring.most_expensive(tx(spark, d))


@query("q8_activity_per_year", over("tx", "SELECT year_radica, count(*) AS total FROM tx WHERE year_radica IS NOT NULL GROUP BY 1"))
def q8(spark, d):
    return monitoring.activity_per_year(tx(spark, d))


@query("q9_most_common_acts", over("tx", "SELECT nombre_natujur, count(*) AS total FROM tx GROUP BY 1 ORDER BY total DESC, 1 LIMIT 10"))
def q9(spark, d):
    return monitoring.most_common_acts(tx(spark, d))


@query("q10_properties_with_anomalies", over("sc", """
SELECT matricula, count(*) AS total_transacciones, count(*) FILTER (WHERE is_anomaly) AS anomalias,
  round(avg(anomaly_score), 6) AS avg_score FROM sc GROUP BY 1 HAVING count(*) FILTER (WHERE is_anomaly) > 0
ORDER BY anomalias DESC, avg_score DESC, matricula LIMIT 20"""))
def q10(spark, d):
    return monitoring.properties_with_anomalies(sc(spark, d))


@query("q11_department_score_summary", over("sc", """
SELECT departamento, count(*) AS total, round(avg(anomaly_score), 4) AS avg_score FROM sc GROUP BY 1"""))
def q11(spark, d):
    return rounded(monitoring.department_score_summary(sc(spark, d)))


@query("q11_stored_summary_refreshed", over("sc", """
SELECT departamento, count(*) AS total, round(avg(anomaly_score), 4) AS avg_score FROM sc GROUP BY 1"""))
def q11b(spark, d):
    """Stored for the rows up to a day, then renewed for the years that later rows fall into."""
    rows, path = sc(spark, d), scratch_path(spark, "resumen")
    late = F.coalesce(F.col("fecha_radicacion") > "2010-06-30", F.lit(False))
    monitoring.refresh_summary(rows.where(~late), path)
    years = rows.where(late).select("year_radica").distinct().withColumnRenamed("year_radica", "y")
    monitoring.refresh_summary(rows.join(F.broadcast(years), rows["year_radica"].eqNullSafe(years["y"]), "left_semi"), path)
    return rounded(monitoring.stored_summary(spark, path))


@query("e20_high_risk_listing", over("fsc", """
SELECT pk, anomaly_score, flag_actividad_excesiva, flag_geo_discrepancia, round(m, 2) AS municipal_avg_value FROM fsc
LEFT JOIN (SELECT municipio, avg(valor_acto) AS m FROM fsc GROUP BY 1) USING (municipio)
WHERE anomaly_score > 0.7 OR flag_actividad_excesiva OR flag_geo_discrepancia"""))
def e20(spark, d):
    metrics = statistics.metric_table(tx(spark, d), day(AS_OF))
    listed = statistics.high_risk_listing(with_scores(fl(spark, d)), metrics, day(AS_OF))
    columns = ["pk", "anomaly_score", "flag_actividad_excesiva", "flag_geo_discrepancia", "municipal_avg_value"]
    return rounded(listed.select(*columns), 2)
