"""Features, score algebra, outlier models and the price model."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import acts, cl, fl, over, query, rounded, sc, sql_label, table, tx
from folioscope.operators import features, outliers, pricing, profiling, scoring
from folioscope.plans import proximity
from folioscope.session import scratch_path

# --- features -----------------------------------------------------------------------------------

FEATURES = """
SELECT transaction_id, coalesce(year(f), 0) AS year, coalesce(month(f), 0) AS month, coalesce(quarter(f), 0) AS quarter,
  coalesce(isodow(f) - 1, 0) AS day_of_week, cast(coalesce(isodow(f) >= 6, false) AS INTEGER) AS is_weekend,
  coalesce(date_diff('day', DATE '2015-01-01', f), 0) AS days_since_2015, v AS valor_acto, round(ln(1 + v), 6) AS log_valor,
  round(v / 1e6, 6) AS valor_millones, round(v / 1e9, 9) AS valor_miles_millones,
  cast(v < 50000000 AS INTEGER) AS valor_bajo, cast(v >= 50000000 AND v < 500000000 AS INTEGER) AS valor_medio,
  cast(v >= 500000000 AS INTEGER) AS valor_alto, 0 AS area_terreno, 0 AS area_construida, 0 AS area_total, 0 AS log_area_terreno,
  0 AS log_area_construida, 0 AS ratio_construccion, 0 AS valor_m2_terreno, 0 AS valor_m2_construida,
  anotaciones_por_anio, round(ln(1 + anotaciones_por_anio), 6) AS log_anotaciones,
  cast(anotaciones_por_anio > 10 AS INTEGER) AS actividad_alta, cast(coalesce(contains(tipo_predio, 'URBANO'), false) AS INTEGER) AS es_urbano,
  cast(coalesce(contains(tipo_predio, 'RURAL'), false) AS INTEGER) AS es_rural,
  cast(coalesce(NOT (contains(tipo_predio, 'URBANO') OR contains(tipo_predio, 'RURAL')), false) AS INTEGER) AS sin_zona,
  cast(coalesce(contains(tipo_predio, 'NPH'), false) AS INTEGER) AS predio_nph,
  cast(coalesce(contains(tipo_predio, 'MATRIZ'), false) AS INTEGER) AS predio_matriz,
  cast(coalesce(contains(tipo_predio, 'MATRIZ NPH'), false) AS INTEGER) AS predio_matriz_nph,
  cast(flag_actividad_excesiva AS INTEGER) AS flag_actividad_excesiva, cast(flag_geo_discrepancia AS INTEGER) AS flag_geo_discrepancia,
  total_flags_anomalia, coalesce(tiene_valor, 1) AS tiene_valor, coalesce(try_cast(cod_natujur AS DOUBLE), 0) AS cod_naturaleza_num,
  cast(floor(coalesce(try_cast(cod_natujur AS DOUBLE), 0) / 100) AS BIGINT) AS cod_naturaleza_grupo,
  coalesce(count_a, 0) AS count_a, coalesce(count_de, 0) AS count_de, coalesce(predios_nuevos, 0) AS predios_nuevos
FROM (SELECT *, fecha_radicacion AS f, coalesce(valor_acto, 0) AS v FROM fl)"""


@query("m1_transaction_features", over("fl", FEATURES))
def m1(spark, d):
    return rounded(features.transaction_features(fl(spark, d)), 6, valor_miles_millones=9, valor_acto=-1)


FALLBACKS = ["year", "month", "quarter", "day_of_week", "is_weekend", "days_since_2015", "es_urbano", "es_rural", "sin_zona", "predio_nph"]


@query("m1_year_and_class_features", over("fl", """
SELECT transaction_id, coalesce(year_radica, 0) AS year, 6 AS month, 2 AS quarter, 3 AS day_of_week, 0 AS is_weekend,
  coalesce((year_radica - 2015) * 365, 0) AS days_since_2015, cast(coalesce(right(categoria_ruralidad, 1) = '1', false) AS INTEGER) AS es_urbano,
  cast(coalesce(right(categoria_ruralidad, 1) IN ('2', '3'), false) AS INTEGER) AS es_rural,
  cast(categoria_ruralidad IS NULL AS INTEGER) AS sin_zona, 0 AS predio_nph FROM fl"""))
def m1c(spark, d):
    """Features of an extract that has the year and the rurality class, and neither date nor zone."""
    rows = fl(spark, d).drop("fecha_radicacion", "tipo_predio")
    return features.transaction_features(rows).select("transaction_id", *FALLBACKS)


@query("m1_missing_features", over("fl", " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(*) - count({c}) AS nulos FROM f" for c in features.TRANSACTION_FEATURES), f=FEATURES))
def m1b(spark, d):
    return profiling.missing_per_column(features.transaction_features(fl(spark, d)).select(*features.TRANSACTION_FEATURES))


ACTS = """
SELECT pk, coalesce(valor_acto, 0) AS valor_acto, round(coalesce(ln(1 + valor_acto), 0), 6) AS log_valor,
  round(coalesce(valor_acto / 1e6, 0), 6) AS valor_millions, coalesce(numero_intervinientes, 0)::DOUBLE AS numero_intervinientes,
  coalesce(year(fecha_acto), 0)::DOUBLE AS year, coalesce(month(fecha_acto), 0)::DOUBLE AS month,
  coalesce(isodow(fecha_acto) - 1, 0)::DOUBLE AS day_of_week, coalesce(quarter(fecha_acto), 0)::DOUBLE AS quarter,
  coalesce(isodow(fecha_acto) >= 6, false)::INTEGER::DOUBLE AS is_weekend, area_terreno, area_construida,
  CASE WHEN area_terreno > 0 THEN round(area_construida / area_terreno, 6) ELSE 0 END AS construction_ratio,
  round(coalesce(CASE WHEN area_terreno > 0 THEN valor_acto / area_terreno ELSE 0 END, 0), 4) AS valor_m2_terreno,
  round(coalesce(CASE WHEN area_construida > 0 THEN valor_acto / area_construida ELSE 0 END, 0), 4) AS valor_m2_construida,
  coalesce(numero_intervinientes > 2, false)::INTEGER::DOUBLE AS multiple_intervinientes,
  coalesce(numero_intervinientes > 5, false)::INTEGER::DOUBLE AS many_intervinientes,
  (numero_catastral IS NULL)::INTEGER::DOUBLE AS missing_catastral,
  (area_terreno = 0 OR area_construida = 0)::INTEGER::DOUBLE AS missing_areas,
  {codes}
FROM acts""".replace("{codes}", ",\n  ".join(
    f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 END::DOUBLE AS {c}_encoded" for c in features.ACT_CATEGORIES))


@query("m2_act_features", over("acts", ACTS))
def m2(spark, d):
    return rounded(act_rows(spark, d), 6, valor_m2_terreno=4, valor_m2_construida=4, valor_acto=-1)


@query("m3_label_codes", over("tx", """
SELECT categoria_ruralidad, cast(row_number() OVER (ORDER BY categoria_ruralidad) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT coalesce(categoria_ruralidad, 'UNKNOWN') AS categoria_ruralidad FROM tx)"""))
def m3(spark, d):
    return features.fit_codes(tx(spark, d), "categoria_ruralidad", "UNKNOWN")


@query("m4_scaler", "SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size, "
       "round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice FROM part")
def m4(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(scoring.apply_scaler(rows, scoring.fit_scaler(rows, ["p_size", "p_retailprice"])), 6)


@query("m5_online_features", over("acts", """
SELECT pk, valor_acto AS v0, numero_intervinientes::DOUBLE AS v1, year(fecha_acto)::DOUBLE AS v2, month(fecha_acto)::DOUBLE AS v3, (isodow(fecha_acto) - 1)::DOUBLE AS v4,
  CASE tipo_acto WHEN 'compraventa' THEN 1 WHEN 'hipoteca' THEN 2 WHEN 'donacion' THEN 3 WHEN 'sucesion' THEN 7 ELSE 0 END::DOUBLE AS v5,
  CASE tipo_predio WHEN 'urbano' THEN 1 WHEN 'rural' THEN 2 WHEN 'mixto' THEN 3 ELSE 0 END::DOUBLE AS v6,
  CASE estado_folio WHEN 'activo' THEN 1 WHEN 'cancelado' THEN 2 WHEN 'cerrado' THEN 3 ELSE 0 END::DOUBLE AS v7,
  coalesce(area_terreno, 0)::DOUBLE AS v8, coalesce(area_construida, 0)::DOUBLE AS v9,
  round(CASE WHEN area_construida > 0 THEN valor_acto / area_construida ELSE 0 END, 4) AS v10,
  (('0x' || left(md5(concat_ws('_', departamento, municipio)), 8))::BIGINT % 1000)::DOUBLE AS v11 FROM acts"""))
def m5(spark, d):
    found = acts(spark, d).select("pk", features.online_features().alias("v"))
    return rounded(found.select("pk", *[F.col("v")[i].cast("double").alias(f"v{i}") for i in range(12)]), 4, v0=-1)


@query("m6_stable_split", over("tx", """
SELECT ('0x' || left(md5('42|' || pk), 8))::BIGINT % 10000 < 2000 AS es_prueba, count(*) AS n FROM tx GROUP BY 1"""))
def m6(spark, d):
    marked = features.split_rows(tx(spark, d).select("pk"), "pk")
    return marked.groupBy("es_prueba").agg(F.count("*").alias("n"))


@query("e6_relative_values", over("ml", """
SELECT pk, round(valor_acto / md, 6) AS valor_vs_mediana_dept_year, round(valor_acto / mm, 6) AS valor_vs_mediana_mun_year,
  round(CASE WHEN s > 0 THEN (valor_acto - m) / s ELSE 0 END, 6) AS zscore_valor_grupo, round(p, 6) AS percentil_valor_dept
FROM (SELECT *, avg(valor_acto) OVER g AS m, stddev_samp(valor_acto) OVER g AS s,
    percent_rank() OVER (PARTITION BY departamento ORDER BY valor_acto) AS p
  FROM ml WHERE year_radica IS NOT NULL WINDOW g AS (PARTITION BY departamento, year_radica, tipo_predio))
JOIN (SELECT departamento, year_radica, quantile_cont(valor_acto, 0.5) AS md FROM ml GROUP BY ALL) a
  USING (departamento, year_radica)
JOIN (SELECT municipio, year_radica, quantile_cont(valor_acto, 0.5) AS mm FROM ml GROUP BY ALL) b USING (municipio, year_radica)"""))
def e6(spark, d):
    from folioscope.operators.quality import dataset

    rows = dataset(cl(spark, d), "ml_training").where(F.col("year_radica").isNotNull())
    columns = ["valor_vs_mediana_dept_year", "valor_vs_mediana_mun_year", "zscore_valor_grupo", "percentil_valor_dept"]
    return rounded(features.with_relative_values(rows).select("pk", *columns), 6)


def listed(column, n):
    return f"(SELECT {column} FROM tx WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {column} LIMIT {n})"


@query("e7_market_indicators", over("tx", f"""
SELECT pk, CASE WHEN municipio IN {listed('municipio', 100)} THEN municipio ELSE 'OTROS' END AS municipio_agrupado,
  coalesce(municipio IN {listed('municipio', 10)}, false)::INTEGER AS es_ciudad_grande,
  coalesce(departamento IN {listed('departamento', 5)}, false)::INTEGER AS es_departamento_top5,
  year_radica - 2015 AS anios_desde_2015 FROM tx"""))
def e7(spark, d):
    found = features.with_market_indicators(tx(spark, d))
    return found.select("pk", "municipio_agrupado", "es_ciudad_grande", "es_departamento_top5", "anios_desde_2015")


# --- score algebra --------------------------------------------------------------------------------

CLIPPED = """
SELECT pk, CASE WHEN hi > lo THEN (greatest(least(area_construida, hi), lo) - lo) / (hi - lo) ELSE 0 END AS s FROM tx,
  (SELECT quantile_cont(area_construida, 0.05) AS lo, quantile_cont(area_construida, 0.95) AS hi FROM tx)"""
INVERTED = "1 - ({c} - (SELECT min({c}) FROM tx)) / ((SELECT max({c}) FROM tx) - (SELECT min({c}) FROM tx))"


@query("m10_clipped_scores", over("tx", f"SELECT pk, round(s, 6) AS score FROM ({CLIPPED})"))
def m10(spark, d):
    rows = tx(spark, d).select("pk", "area_construida")
    return rounded(rows.select("pk", scoring.clipped_score(rows, "area_construida").alias("score")), 6)


@query("m11_inverted_scores", over("tx", f"SELECT pk, round({INVERTED.format(c='area_construida')}, 6) AS score FROM tx"))
def m11(spark, d):
    rows = tx(spark, d).select("pk", "area_construida")
    return rounded(rows.select("pk", scoring.inverted_score(rows, "area_construida").alias("score")), 6)


@query("m12_weighted_ensemble", over("tx", f"""
SELECT pk, round(e, 6) AS ensemble, round(t, 6) AS de_tres, e >= 0.5 AS es_anomalia FROM (
  SELECT pk, 0.6 * ({INVERTED.format(c='area_construida')}) + 0.4 * ({INVERTED.format(c='puntaje_b')}) AS e,
    0.4 * ({INVERTED.format(c='area_construida')}) + 0.3 * ({INVERTED.format(c='puntaje_b')}) + 0.3 * coalesce(puntaje_a, 0) AS t FROM tx)"""))
def m12(spark, d):
    rows = tx(spark, d).select("pk", "area_construida", "puntaje_a", "puntaje_b")
    first, second = scoring.inverted_score(rows, "area_construida"), scoring.inverted_score(rows, "puntaje_b")
    third = F.coalesce("puntaje_a", F.lit(0.0))
    scored = rows.select("pk", scoring.weighted((0.6, first), (0.4, second)).alias("ensemble"),
                         scoring.weighted((0.4, first), (0.3, second), (0.3, third)).alias("de_tres"))
    return rounded(scored.withColumn("es_anomalia", F.col("ensemble") >= 0.5), 6)


@query("m13_squashed_scores", over("tx", "SELECT pk, round(coalesce(1 / (1 + exp(puntaje_a)), 0.5), 6) AS score FROM tx"))
def m13(spark, d):
    return rounded(tx(spark, d).select("pk", scoring.squashed(F.col("puntaje_a")).alias("score")), 6)


@query("m14_evaluation", """
SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score
FROM (SELECT count(*) FILTER (WHERE NOT y AND NOT p) AS tn, count(*) FILTER (WHERE NOT y AND p) AS fp,
  count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE y AND p) AS tp
  FROM (SELECT toxic = 1 AS y, least(n_chars / 4000.0, 1.0) >= 0.5 AS p FROM documents JOIN labels USING (doc_id)))""")
def m14(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rounded(scoring.evaluation(rows, F.col("toxic") == 1, F.least(F.col("n_chars") / 4000.0, F.lit(1.0))), 6)


IMPORTANT = ["valor_acto", "area_construida", "count_a", "count_de", "puntaje_b"]


@query("m15_feature_importance", over("cl", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, puntaje_a)), 6) AS importance FROM base" for c in IMPORTANT),
    base="SELECT coalesce(valor_acto, 0) AS valor_acto, area_construida, count_a, count_de, puntaje_a, puntaje_b FROM cl WHERE puntaje_a IS NOT NULL"))
def m15(spark, d):
    rows = cl(spark, d).where(F.col("puntaje_a").isNotNull()).withColumn("valor_acto", F.coalesce("valor_acto", F.lit(0.0)))
    return rounded(scoring.feature_importance(rows, IMPORTANT, "puntaje_a"), 6)


@query("l6_top_features", over("cl", f"""
SELECT feature, importance FROM ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, puntaje_a)), 6) AS importance FROM base" for c in IMPORTANT)})
ORDER BY importance DESC, feature LIMIT 3""",
    base="SELECT coalesce(valor_acto, 0) AS valor_acto, area_construida, count_a, count_de, puntaje_a, puntaje_b FROM cl WHERE puntaje_a IS NOT NULL"))
def l6(spark, d):
    return scoring.top_features(m15(spark, d), 3)


@query("u3_two_detectors_combined", over("tx", """
SELECT pk, a AND b AS confirmada, a OR b AS candidata FROM (SELECT pk, coalesce(puntaje_a >= 0.5, false) AS a, puntaje_b >= 0.5 AS b FROM tx)"""))
def u3(spark, d):
    rows = tx(spark, d).select("pk", F.coalesce(F.col("puntaje_a") >= 0.5, F.lit(False)).alias("a"), (F.col("puntaje_b") >= 0.5).alias("b"))
    return rows.select("pk", *[c.alias(n) for n, c in scoring.combined_flags(F.col("a"), F.col("b")).items()])


@query("u4_vote_counts", over("tx", """
SELECT coalesce(puntaje_a >= 0.5, false) OR puntaje_b >= 0.5 AS anomalia, count(*) AS n,
  round(count(*) * 100.0 / (SELECT count(*) FROM tx), 4) AS porcentaje FROM tx GROUP BY 1"""))
def u4(spark, d):
    vote = F.coalesce(F.col("puntaje_a") >= 0.5, F.lit(False)) | (F.col("puntaje_b") >= 0.5)
    return rounded(scoring.class_shares(tx(spark, d).select(vote.alias("anomalia")), "anomalia"))


@query("k6_table_scored_by_key", over("sc", f"""
SELECT pk, round(puntaje_b, 4) AS anomaly_score, puntaje_b >= 0.5 AS is_anomaly, {sql_label('puntaje_b')} AS risk_classification
FROM sc"""))
def k6b(spark, d):
    from folioscope.sources.writers import first_per_key

    rows = sc(spark, d).select("pk", "anomaly_score", "is_anomaly", "risk_classification")
    scores = first_per_key(tx(spark, d).select("pk", F.col("puntaje_b").alias("anomaly_score")), ["pk"], ["anomaly_score"])
    return rounded(scoring.write_scores(rows, scores))


# --- outlier models -------------------------------------------------------------------------------

MODEL = ["valor_acto", "year_radica", "count_a", "count_de", "area_terreno", "area_construida", "orip"]


def model_rows(spark, d):
    rows = cl(spark, d)
    return rows.select("pk", *features.select_numbers(rows, MODEL))


def act_rows(spark, d):
    """All 23 act features, encoded categories included."""
    built = features.encode_categories(features.act_features(acts(spark, d)), features.ACT_CATEGORIES)
    return built.select("pk", *features.select_numbers(built, features.ACT_FEATURES))


@query("m7_forest_nodes")
def m7(spark, d):
    nodes = outliers.fit_forest(model_rows(spark, d), "pk", MODEL)
    return nodes.groupBy("tree").agg(F.count("*").alias("nodos"), F.max("length").alias("profundidad"))


@query("m8_forest_scores")
def m8(spark, d):
    rows = model_rows(spark, d)
    nodes = outliers.fit_forest(rows, "pk", MODEL)
    scored = rows.select("pk", outliers.forest_score(nodes, [F.col(c) for c in MODEL]).alias("if_score"))
    return outliers.flag_by_contamination(scored.persist(), "if_score", 0.1, "es_anomalia")


LOF = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
pares AS (SELECT vec_id, neighbour, distance FROM (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r
  FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE r <= 20),
alcance AS (SELECT vec_id, max(distance) AS k_distance FROM pares GROUP BY 1),
densidad AS (SELECT p.vec_id, 1 / (avg(greatest(distance, k_distance)) + 1e-10) AS lrd FROM pares p
  JOIN alcance a ON p.neighbour = a.vec_id GROUP BY 1)
SELECT p.vec_id, round(any_value(k_distance), 6) AS k_distance, round(any_value(own.lrd), 4) AS lrd,
  round(avg(other.lrd) / any_value(own.lrd), 6) AS lof
FROM pares p JOIN densidad other ON p.neighbour = other.vec_id JOIN densidad own ON p.vec_id = own.vec_id
JOIN alcance a ON p.vec_id = a.vec_id GROUP BY p.vec_id"""


@query("m9_local_outlier_factor", LOF)
def m9(spark, d):
    points = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rounded(outliers.fit_density(points, "vec_id", "embedding", 20), 6, lrd=4)


@query("m9_novelty_scores")
def m9b(spark, d):
    rows = model_rows(spark, d)
    scaled = scoring.apply_scaler(rows, scoring.fit_scaler(rows, MODEL)).select("pk", F.array(*MODEL).alias("vector"))
    found = outliers.graph_density(scaled, "vector", 20).select("id", F.col("novelty").alias("lof"))
    return scaled.select("pk", proximity.vector_id("vector").alias("id")).join(found, "id").select("pk", "lof")


@query("m20_reconstruction_error")
def m20(spark, d):
    source = cl(spark, d)
    flag = F.coalesce(F.col("puntaje_a") >= 0.9, F.lit(False)).alias("marcada")
    rows = source.select("pk", *features.select_numbers(source, MODEL), flag)
    scored = outliers.reconstruction_error(rows, MODEL, F.col("marcada"), 4)
    return outliers.flag_by_reconstruction(scored, F.col("marcada")).select("pk", "error_reconstruccion", "anomalia_reconstruccion")


@query("m21_table_scored")
def m21(spark, d):
    scores = outliers.score_table(act_rows(spark, d), "pk", features.ACT_FEATURES)
    target = cl(spark, d).select(
        "pk", F.lit(None).cast("double").alias("anomaly_score"), F.lit(None).cast("boolean").alias("is_anomaly"),
        F.lit(None).cast("string").alias("risk_classification"),
    )
    return scoring.write_scores(target, scores)


@query("m22_saved_model_scores")
def m22(spark, d):
    """Fitted on the acts up to a year, stored, and used on all acts."""
    rows, path = acts(spark, d), scratch_path(spark, "model")
    outliers.save_bundle(rows.where(F.year("fecha_acto") <= 2006), "pk", path)
    return outliers.score_with_bundle(rows, "pk", path)


SUMMARY = f"""
SELECT *, {len(IMPORTANT)} AS n_features, (SELECT string_agg(feature, ',' ORDER BY importance DESC, feature DESC) FROM pesos) AS variables,
  (SELECT string_agg(floor(importance * 1000000 + 0.5)::BIGINT, ',' ORDER BY importance DESC, feature DESC) FROM pesos) AS pesos
FROM (SELECT count(*) AS n_samples, count(*) FILTER (WHERE puntaje_a >= 0.7) AS high_risk,
  count(*) FILTER (WHERE puntaje_a >= 0.4 AND puntaje_a < 0.7) AS suspicious, count(*) FILTER (WHERE puntaje_a < 0.4) AS normal FROM cl)"""
WEIGHTS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(covar_pop({c}, puntaje_a) / (stddev_pop({c}) FILTER (WHERE puntaje_a IS NOT NULL) * stddev_pop(puntaje_a))) AS importance FROM cl"
    for c in IMPORTANT)


@query("m23_training_summary", over("cl", SUMMARY, pesos=WEIGHTS))
def m23(spark, d):
    rows = cl(spark, d).withColumn("anomaly_score", F.col("puntaje_a"))
    importance = scoring.feature_importance(rows, IMPORTANT, "puntaje_a")
    found = scoring.training_summary(rows, importance, IMPORTANT)
    listed = lambda f: F.array_join(F.transform("top_features", f), ",")
    return found.select(
        "n_samples", "high_risk", "suspicious", "normal", "n_features", listed(lambda t: t["feature"]).alias("variables"),
        listed(lambda t: F.floor(t["importance"] * 1_000_000 + 0.5).cast("string")).alias("pesos"))


@query("e19_segment_outliers", over("ml", """
SELECT pk, round(limite_inferior, 2) AS limite_inferior, round(limite_superior, 2) AS limite_superior,
  valor_acto < limite_inferior OR valor_acto > limite_superior AS es_atipico FROM ml
JOIN (SELECT departamento, tipo_predio, q1 - 1.5 * (q3 - q1) AS limite_inferior, q3 + 1.5 * (q3 - q1) AS limite_superior
  FROM (SELECT departamento, tipo_predio, quantile_cont(valor_acto, 0.25) AS q1, quantile_cont(valor_acto, 0.75) AS q3 FROM ml GROUP BY ALL))
  USING (departamento, tipo_predio)"""))
def e19(spark, d):
    from folioscope.operators.quality import dataset

    rows = dataset(cl(spark, d), "ml_training")
    found = outliers.segment_outliers(rows, ["departamento", "tipo_predio"], "valor_acto")
    return rounded(found.select("pk", "limite_inferior", "limite_superior", "es_atipico"), 2)


@query("e19_segment_z_outliers", over("ml", """
SELECT pk, coalesce(abs(valor_acto - m) > 3 * s, false) AS es_atipico FROM (SELECT pk, valor_acto, avg(valor_acto) OVER g AS m,
  stddev_samp(valor_acto) OVER g AS s FROM ml WINDOW g AS (PARTITION BY orip, tipo_predio))"""))
def e19b(spark, d):
    from folioscope.operators.quality import dataset

    rows = dataset(cl(spark, d), "ml_training")
    return outliers.segment_outliers(rows, ["orip", "tipo_predio"], "valor_acto", "z", 3).select("pk", "es_atipico")


# --- prices ---------------------------------------------------------------------------------------

DEVIATION = "abs(valor_acto - p) / p"
PRICED = "SELECT pk, valor_acto, valor_acto * (0.6 + puntaje_b) AS p FROM tx WHERE valor_acto > 0"


def priced(spark, d):
    rows = tx(spark, d).where(F.col("valor_acto") > 0)
    return rows.select("pk", "valor_acto", (F.col("valor_acto") * (0.6 + F.col("puntaje_b"))).alias("precio_predicho"))


@query("b17_price_deviation", over("tx", f"""
SELECT pk, round(least({DEVIATION}, 1), 6) AS anomaly_score, least({DEVIATION}, 1) > 0.3 AS es_sospechoso,
  round({DEVIATION} * 100, 4) AS desviacion_porcentaje FROM ({PRICED})"""))
def b17(spark, d):
    found = pricing.price_deviation(F.col("valor_acto"), F.col("precio_predicho"))
    chosen = ["anomaly_score", "es_sospechoso", "desviacion_porcentaje"]
    return rounded(priced(spark, d).select("pk", *[found[n].alias(n) for n in chosen]), 6, desviacion_porcentaje=4)


@query("b18_price_verdict", over("tx", f"""
SELECT pk, CASE WHEN d < 15 THEN 'normal' WHEN d < 30 THEN 'precaucion' ELSE 'sospechoso' END AS clasificacion,
  round(greatest(0, 1 - d / 100), 6) AS score_confianza,
  CASE WHEN d < 15 THEN 0 WHEN d < 30 THEN 3 WHEN valor_acto < p THEN 5 ELSE 3 END AS n_recomendaciones
FROM (SELECT *, {DEVIATION} * 100 AS d FROM ({PRICED}))"""))
def b18(spark, d):
    judged = pricing.valuation(priced(spark, d))
    return rounded(judged.select("pk", "clasificacion", "score_confianza", F.size("recomendaciones").alias("n_recomendaciones")), 6)


@query("m17_regression_metrics", over("tx", f"""
SELECT count(*) AS n, round(avg(abs(p - valor_acto)), 2) AS mae, round(sqrt(avg((p - valor_acto) ** 2)), 1) AS rmse,
  round(1 - avg((p - valor_acto) ** 2) / var_pop(valor_acto), 6) AS r2 FROM ({PRICED})"""))
def m17(spark, d):
    found = scoring.regression_metrics(priced(spark, d), F.col("valor_acto"), F.col("precio_predicho"))
    return rounded(found, 2, rmse=1, r2=6)


@query("a19_price_statistics", over("tx", """
SELECT count(valor_acto) AS n, round(avg(valor_acto), 2) AS media, round(quantile_cont(valor_acto, 0.5), 2) AS mediana,
  min(valor_acto) AS minimo, max(valor_acto) AS maximo, round(stddev_samp(valor_acto), 1) AS desviacion
FROM (SELECT valor_acto FROM tx WHERE municipio IS NOT NULL AND departamento IS NOT NULL AND valor_acto BETWEEN
  (SELECT quantile_cont(valor_acto, 0.01) FROM tx WHERE municipio IS NOT NULL AND departamento IS NOT NULL)
  AND (SELECT quantile_cont(valor_acto, 0.99) FROM tx WHERE municipio IS NOT NULL AND departamento IS NOT NULL))"""))
def a19(spark, d):
    found = pricing.price_statistics(pricing.price_rows(tx(spark, d))).withColumnRenamed("con_valor", "n")
    return rounded(found.drop("total", "sin_valor"), 2, desviacion=1)


@query("p23_price_statistics_text", over("tx", """
SELECT count(valor_acto) AS con_valor, '$' || format('{:,}', round_even(avg(valor_acto), 0)::BIGINT) AS precio_promedio_fmt,
  '$' || format('{:,}', round_even(quantile_cont(valor_acto, 0.5), 0)::BIGINT) AS precio_mediano_fmt FROM tx"""))
def p23b(spark, d):
    return pricing.formatted_price_statistics(tx(spark, d))


FITTED = {}


def fitted_prices(spark, d):
    """Price model fitted on the market rows with a value, kept for the queries that share it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in FITTED:
        from folioscope.operators.quality import market_with_value

        # The rows are trimmed once, for all codes and the model, and keep the columns that these need.
        rows = pricing.price_rows(market_with_value(tx(spark, d))).select("pk", "valor_acto", *pricing.PRICE_CATEGORIES, *pricing.PRICE_NUMBERS).persist()
        codes = pricing.fit_price_codes(rows)
        names = pricing.feature_names(codes)
        ready = pricing.price_features(rows, codes).select("pk", "valor_acto", *names).persist()
        FITTED[key] = pricing.fit_price_model(ready, names, trees=40, depth=10), ready, names
        rows.unpersist()
    return FITTED[key]


@query("m16_price_predictions")
def m16(spark, d):
    model, rows, names = fitted_prices(spark, d)
    return pricing.predict(rows, model, names).select("pk", "valor_acto", "precio_predicho")


@query("m17_price_model_metrics")
def m17b(spark, d):
    model, rows, names = fitted_prices(spark, d)
    return pricing.price_model_metrics(pricing.predict(rows, model, names))


PRICE_ROWS = {
    "conocidas": """SELECT pk, valor_acto FROM tx WHERE tiene_valor = 1 AND valor_acto > 0 AND dinamica_inmobiliaria = 1
  AND municipio IS NOT NULL AND departamento IS NOT NULL""",
    "precios": """SELECT * FROM conocidas WHERE valor_acto BETWEEN (SELECT quantile_cont(valor_acto, 0.01) FROM conocidas)
  AND (SELECT quantile_cont(valor_acto, 0.99) FROM conocidas)""",
}


@query("m16_price_sides", over("tx", """
SELECT ('0x' || left(md5('42|' || pk), 8))::BIGINT % 10000 < 2000 AS es_prueba, count(*) AS n, min(valor_acto) AS minimo,
  max(valor_acto) AS maximo, round(avg(valor_acto), 2) AS media FROM precios GROUP BY 1""", **PRICE_ROWS))
def m16b(spark, d):
    """Rows that the price model is fitted and judged on."""
    from folioscope.operators.quality import market_with_value

    marked = features.split_rows(pricing.price_rows(market_with_value(tx(spark, d))), "pk")
    v = F.col("valor_acto")
    sides = marked.groupBy("es_prueba").agg(F.count("*").alias("n"), F.min(v).alias("minimo"), F.max(v).alias("maximo"), F.avg(v).alias("media"))
    return rounded(sides, 2)


@query("m18_price_importances")
def m18(spark, d):
    model, _, names = fitted_prices(spark, d)
    return pricing.model_importances(model, names)


@query("m19_tree_means", over("tx", """
SELECT count(*) AS n, count(*) AS media_igual, count(*) AS intervalo_ordenado FROM precios""", **PRICE_ROWS))
def m19b(spark, d):
    """Rows whose price is the mean of their trees, and whose interval lies within the trees' range."""
    model, rows, names = fitted_prices(spark, d)
    found = pricing.with_tree_predictions(rows, model, names, scratch_path(spark, "price-model"), "arboles")
    found = pricing.with_price_interval(found.drop("precio_predicho"), model, names, scratch_path(spark, "price-model"))
    mean = F.aggregate("arboles", F.lit(0.0), lambda a, x: a + x) / F.size("arboles")
    low, high = F.col("precio_minimo"), F.col("precio_maximo")
    ordered = (F.array_min("arboles") <= low) & (low <= high) & (high <= F.array_max("arboles"))
    return found.agg(
        F.count("*").alias("n"),
        F.count_if(F.abs(mean - F.col("precio_predicho")) <= 1e-9 * F.abs(mean)).alias("media_igual"),
        F.count_if(ordered).alias("intervalo_ordenado"))


@query("m19_price_intervals")
def m19(spark, d):
    model, rows, names = fitted_prices(spark, d)
    found = pricing.with_price_interval(rows, model, names, scratch_path(spark, "price-model"))
    return pricing.valuation(found).select("pk", "precio_predicho", "precio_minimo", "precio_maximo", "clasificacion")
