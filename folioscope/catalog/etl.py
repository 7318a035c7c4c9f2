"""Sources, sinks, cleaning, filters, joins and the business-anomaly flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import (
    AS_OF, acts, cl, classified, day, fl, flat, over, query, raw, rounded, sc, sql_label, sql_number, table, tx, typed,
)
from folioscope.functions import values as V
from folioscope.operators import activity, cleaning, features, monitoring, quality, statistics
from folioscope.session import scratch_path
from folioscope.sources import clustered, readers, schemas, writers

EXTRACT_COLUMNS = (
    "pk", "matricula", "fecha_radicacion", "year_radica", "departamento", "municipio", "tipo_predio",
    "nombre_natujur", "valor_acto", "count_a", "count_de", "estado_folio", "area_terreno", "area_construida",
)

# --- sources ------------------------------------------------------------------------------------


@query("s1_parquet_columns", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def s1(spark, d):
    return readers.read_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("s2_parquet_predicate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def s2(spark, d):
    keep = (F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R")
    return readers.read_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber"], keep)


@query("s3_file_metadata")
def s3(spark, d):
    return readers.file_metadata(spark, f"{d}/lineitem.parquet")


@query("s3_rows_per_file", "SELECT count(*) AS num_rows, (SELECT count(*) FROM (DESCRIBE lineitem)) AS num_columns FROM lineitem")
def s3b(spark, d):
    return readers.file_metadata(spark, f"{d}/lineitem.parquet").groupBy("num_columns").agg(F.sum("num_rows").alias("num_rows"))


def csv_copy(spark, d):
    """The orders as CSV files, written by Spark."""
    path = scratch_path(spark, "csv") + "/orders.csv"
    table(spark, d, "orders").write.option("header", True).csv(path)
    return path


ORDERS = schemas.table(
    o_orderkey=schemas.LONG, o_custkey=schemas.LONG, o_orderstatus=schemas.STRING, o_totalprice=schemas.DOUBLE,
    o_orderdate=schemas.TIME, o_orderpriority=schemas.STRING,
)


@query("s4_csv_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def s4(spark, d):
    return readers.read_csv(spark, csv_copy(spark, d), ORDERS, ["o_orderkey", "o_totalprice"])


@query("s5_csv_splits", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def s5(spark, d):
    rows = readers.read_csv(spark, csv_copy(spark, d), ORDERS)
    total = F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), total.alias("total"))


def extract_csv(spark, d):
    path = scratch_path(spark, "extract") + "/extract.csv"
    rows = tx(spark, d).withColumn("pk", F.xxhash64("pk")).select(*EXTRACT_COLUMNS)
    rows.write.option("header", True).csv(path)
    return path


EXTRACT_SCHEMA = schemas.T.StructType([f for f in schemas.EXTRACT.fields if f.name in EXTRACT_COLUMNS])


@query("s6_csv_declared_types", over("tx", """
SELECT matricula, fecha_radicacion, year_radica, departamento, municipio, tipo_predio, nombre_natujur, valor_acto,
  count_a, count_de, estado_folio, area_terreno, area_construida FROM tx"""))
def s6(spark, d):
    ordered = schemas.T.StructType([schemas.EXTRACT[c] for c in EXTRACT_COLUMNS])
    return readers.read_extract(spark, extract_csv(spark, d), ordered).where(f"{readers.CORRUPT} IS NULL").drop("pk", readers.CORRUPT)


@query("s7_text_csv_typed", over("raw", f"""
SELECT pk, upper(trim(departamento)) AS departamento, upper(trim(municipio)) AS municipio,
  upper(trim(nombre_natujur)) AS nombre_natujur, {sql_number("replace(valor, ',', '')")} AS valor_acto,
  {sql_number('count_a')} AS count_a, {sql_number('count_de')} AS count_de, orip,
  cast(try_strptime(fecha_radica_texto, '%d/%m/%Y') AS DATE) AS fecha_radicacion FROM raw"""))
def s7(spark, d):
    columns = ["pk", "departamento", "municipio", "nombre_natujur", "valor", "count_a", "count_de", "orip", "fecha_radica_texto"]
    folder = scratch_path(spark, "text")
    raw(spark, d).select(*columns).write.option("header", True).csv(f"{folder}/texto.csv")
    text = readers.read_csv_text(spark, f"{folder}/texto.csv", columns)
    typed = readers.type_text_columns(cleaning.rename_registry(text))
    typed.write.parquet(f"{folder}/datos.parquet")
    return readers.read_any(spark, f"{folder}/datos.parquet")


@query("s8_reader_by_suffix", "SELECT 'csv' AS formato, count(*) AS n FROM orders UNION ALL SELECT 'parquet', count(*) FROM orders")
def s8(spark, d):
    counts = [
        readers.read_any(spark, path, ORDERS).agg(F.count("*").alias("n")).select(F.lit(form).alias("formato"), "n")
        for form, path in (("csv", csv_copy(spark, d)), ("parquet", f"{d}/orders.parquet"))
    ]
    return counts[0].unionByName(counts[1])


@query("s9_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def s9(spark, d):
    return readers.first_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 500, ["o_orderkey"])


@query("s10_random_rows", "SELECT * FROM orders ORDER BY ('0x' || left(md5('42|' || o_orderkey), 8))::BIGINT, o_orderkey LIMIT 1000")
def s10(spark, d):
    return readers.random_rows(table(spark, d, "orders"), 1000, "o_orderkey")


@query("s11_table_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def s11(spark, d):
    writers.replace_view(spark, "folioscope_orders", table(spark, d, "orders"))
    return readers.read_table(spark, "folioscope_orders", ["o_orderkey", "o_custkey"], F.col("o_orderstatus") == "F")


# --- sinks --------------------------------------------------------------------------------------

SPLITS = """
SELECT 'completo' AS dataset, count(*) AS n, round(sum(valor_acto), 2) AS suma FROM cl
UNION ALL SELECT 'limpio', count(*), round(sum(valor_acto), 2) FROM cl WHERE calidad_datos = 'OK'
UNION ALL SELECT 'mercado', count(*), round(sum(valor_acto), 2) FROM cl WHERE es_mercado_valido AND calidad_datos <> 'ERROR'
UNION ALL SELECT 'ml_training', count(*), round(sum(valor_acto), 2) FROM cl
  WHERE es_mercado_valido AND valor_valido AND calidad_datos = 'OK'
UNION ALL SELECT 'errores', count(*), round(sum(valor_acto), 2) FROM cl WHERE calidad_datos = 'ERROR'
UNION ALL SELECT 'advertencias', count(*), round(sum(valor_acto), 2) FROM cl WHERE calidad_datos = 'ADVERTENCIA'"""


def dataset_totals(df, name):
    return df.agg(F.count("*").alias("n"), F.round(F.sum("valor_acto"), 2).alias("suma")).select(F.lit(name).alias("dataset"), "n", "suma")


def stacked(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("k1_quality_datasets_written", over("cl", SPLITS))
def k1(spark, d):
    paths = writers.write_quality_datasets(classified(spark, d), scratch_path(spark, "datasets"))
    return stacked([dataset_totals(spark.read.parquet(p), n) for n, p in paths.items()])


@query("k2_statistics_written", over("cl", """
SELECT count(*) AS registros_entrada, count(*) FILTER (WHERE ml) AS registros_salida, count(*) FILTER (WHERE NOT ml) AS registros_descartados,
  count(*) FILTER (WHERE calidad_datos = 'ERROR') AS registros_con_errores,
  count(*) FILTER (WHERE calidad_datos = 'ADVERTENCIA') AS registros_sospechosos,
  round(count(*) FILTER (WHERE ml) * 100.0 / count(*), 4) AS tasa_aprovechamiento, true AS con_fecha
FROM (SELECT *, es_mercado_valido AND valor_valido AND calidad_datos = 'OK' AS ml FROM cl)"""))
def k2(spark, d):
    folder = scratch_path(spark, "stats")
    # The statistics pass over the rows many times, so they read the stored table.
    rows = cl(spark, d)
    kinds = statistics.property_kind_year_stats(quality.dataset(rows, "ml_training"))
    writers.write_statistics({"por_tipo_predio": kinds}, statistics.run_report(rows), folder)
    counts = ["registros_entrada", "registros_salida", "registros_descartados", "registros_con_errores", "registros_sospechosos"]
    report = spark.read.option("header", True).csv(f"{folder}/etl_report.csv")
    # The time of the run is no result; that it is there is.
    return report.select(
        *[F.col(c).cast("long").alias(c) for c in counts], F.round(F.col("tasa_aprovechamiento").cast("double"), 4).alias("tasa_aprovechamiento"),
        F.col("fecha_proceso").cast("timestamp").isNotNull().alias("con_fecha"))


@query("k3_statistics_json", over("acts", """
SELECT count(*) AS total_records, round(avg(valor_acto), 2) AS media, count(DISTINCT departamento) AS departamentos,
  count(DISTINCT municipio) AS municipios FROM acts"""))
def k3(spark, d):
    path = scratch_path(spark, "json")
    rows = acts(spark, d)
    stats = statistics.with_act_types(statistics.dataset_statistics(rows), statistics.act_type_counts(rows))
    writers.write_json_document(statistics.statistics_document(stats), path)
    document = spark.read.json(path)
    return document.select(
        "total_records", F.round(F.col("valor_acto.mean"), 2).alias("media"), "departamentos", "municipios"
    )


@query("k4_table_load", over("tx", "SELECT year_radica, count(*) AS n FROM tx GROUP BY ALL"))
def k4(spark, d):
    path = scratch_path(spark, "table")
    name = "transacciones_" + path.rsplit("-", 1)[-1]
    writers.save_table(tx(spark, d).select("pk", "year_radica", "valor_acto"), name, path=path, cluster_by="pk", buckets=8)
    return readers.read_table(spark, name).groupBy("year_radica").agg(F.count("*").alias("n"))


@query("k5_insert_ignore", over("cl", """
SELECT transaction_id, pk, valor_acto FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY pk) AS r FROM cl)
WHERE r = 1 AND transaction_id NOT IN (SELECT transaction_id FROM cl WHERE calidad_datos = 'ERROR')"""))
def k5(spark, d):
    rows = cl(spark, d).select("transaction_id", "pk", "valor_acto", "calidad_datos")
    stored = rows.where(F.col("calidad_datos") == "ERROR").select("transaction_id")
    return writers.insert_ignore(stored, rows.drop("calidad_datos"), ["transaction_id"], ["pk"])


@query("k6_scores_updated_by_key", over("sc", """
SELECT pk, coalesce(nuevo, anomaly_score) AS anomaly_score FROM sc
LEFT JOIN (SELECT DISTINCT ON (pk) pk, puntaje_b AS nuevo FROM sc WHERE calidad_datos = 'OK' ORDER BY pk, puntaje_b) USING (pk)"""))
def k6(spark, d):
    rows = sc(spark, d)
    ok = rows.where(F.col("calidad_datos") == "OK")
    new = writers.first_per_key(ok.select("pk", F.col("puntaje_b").alias("anomaly_score")), ["pk"], ["anomaly_score"])
    return writers.update_by_key(rows.select("pk", "anomaly_score"), new, "pk", ["anomaly_score"])


@query("k7_model_registry", """
SELECT p_type AS model_name, count(*) AS training_samples, false AS is_active FROM part GROUP BY ALL
UNION ALL SELECT p_brand, count(*), true FROM part GROUP BY ALL""")
def k7(spark, d):
    part = table(spark, d, "part")

    def entries(column):
        return part.groupBy(F.col(column).alias("model_name")).agg(F.count("*").alias("training_samples"))

    old = entries("p_type").withColumn("is_active", F.lit(True))
    return writers.register_models(old, entries("p_brand"))


@query("k8_declared_schema", over("cl", """
SELECT transaction_id, pk, matricula, fecha_radicacion, year_radica, orip, divipola, departamento, municipio, tipo_predio,
  categoria_ruralidad, num_anotacion, estado_folio, dinamica_inmobiliaria, cod_natujur, nombre_natujur, numero_catastral,
  count_a, count_de, predios_nuevos, tiene_valor, tiene_mas_de_un_valor, valor_acto, calidad_datos, tipo_error,
  es_mercado_valido, valor_valido FROM cl"""))
def k8(spark, d):
    path = scratch_path(spark, "conformed")
    schemas.conform(cl(spark, d), schemas.TRANSACTIONS).write.parquet(path)
    return spark.read.schema(schemas.TRANSACTIONS).parquet(path)


# --- projections --------------------------------------------------------------------------------


@query("p1_transaction_id", over("tx", "SELECT pk, transaction_id FROM tx"))
def p1(spark, d):
    return cleaning.with_transaction_id(cleaning.rename_registry(raw(spark, d))).select("pk", "transaction_id")


@query("p2_whole_numbers", over("tx", "SELECT pk, year_radica, count_a, count_de FROM tx"))
def p2(spark, d):
    return typed(spark, d).select("pk", "year_radica", "count_a", "count_de")


@query("p3_flags", over("tx", "SELECT pk, dinamica_inmobiliaria, predios_nuevos, tiene_valor, tiene_mas_de_un_valor FROM tx"))
def p3(spark, d):
    return typed(spark, d).select("pk", "dinamica_inmobiliaria", "predios_nuevos", "tiene_valor", "tiene_mas_de_un_valor")


@query("p4_money_text", over("tx", "SELECT pk, valor_texto, valor_acto FROM tx"))
def p4(spark, d):
    return typed(spark, d).select("pk", "valor_texto", "valor_acto")


@query("p5_categories", over("tx", "SELECT pk, departamento, municipio, tipo_predio, categoria_ruralidad, estado_folio FROM tx"))
def p5(spark, d):
    return typed(spark, d).select("pk", "departamento", "municipio", "tipo_predio", "categoria_ruralidad", "estado_folio")


@query("p6_office_range", over("tx", "SELECT pk, orip FROM tx"))
def p6(spark, d):
    return typed(spark, d).select("pk", "orip")


@query("p7_text_cleaned", over("raw", """
SELECT pk, CASE WHEN upper(trim(departamento)) NOT IN ('NAN', 'NONE', '') THEN upper(trim(departamento)) END AS departamento,
  CASE WHEN upper(trim(nombre_natujur)) NOT IN ('NAN', 'NONE', '') THEN upper(trim(nombre_natujur)) END AS nombre_natujur
FROM raw"""))
def p7(spark, d):
    return cleaning.clean_text_columns(cleaning.rename_registry(raw(spark, d))).select("pk", "departamento", "nombre_natujur")


@query("p8_out_of_range_dropped", """
SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 1000000000000 THEN c_acctbal END AS valor_acto FROM customer""")
def p8(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("valor_acto"))
    return cleaning.drop_out_of_range(rows)


@query("p9_out_of_range_clamped", over("tx", """
SELECT pk, CASE WHEN orip >= 0 THEN least(orip, 10000) END AS orip,
  CASE WHEN numero_intervinientes >= 1 THEN least(numero_intervinientes, 100.0) END AS numero_intervinientes,
  CASE WHEN valor_acto >= 0 THEN least(valor_acto, 1e12) END AS valor_acto
FROM (SELECT *, cast(count_a AS DOUBLE) * 40 AS numero_intervinientes FROM tx)"""))
def p9(spark, d):
    rows = typed(spark, d).withColumn("numero_intervinientes", F.col("count_a").cast("double") * 40)
    return cleaning.clamp_out_of_range(rows).select("pk", "orip", "numero_intervinientes", "valor_acto")


@query("p10_impossible_dates", over("tx", f"""
SELECT pk, CASE WHEN fecha_radicacion BETWEEN DATE '1900-01-01' AND DATE '{AS_OF}' THEN fecha_radicacion END AS fecha_radicacion
FROM tx"""))
def p10(spark, d):
    return cleaning.drop_impossible_dates(typed(spark, d), day(AS_OF)).select("pk", "fecha_radicacion")


@query("p11_dates_parsed", over("raw", """
SELECT pk, fecha_radica_texto, cast(try_strptime(fecha_radica_texto, '%d/%m/%Y') AS DATE) AS fecha FROM raw"""))
def p11(spark, d):
    return raw(spark, d).select("pk", "fecha_radica_texto", V.day_or_null(F.col("fecha_radica_texto")).alias("fecha"))


@query("p12_has_value", over("tx", "SELECT pk, coalesce(valor_acto > 0, false) AS tiene_valor FROM tx"))
def p12(spark, d):
    return cleaning.with_has_value(typed(spark, d)).select("pk", "tiene_valor")


@query("p13_missing_areas_filled", over("tx", """
SELECT pk, coalesce(area_terreno, 0) AS area_terreno, coalesce(area_construida, 0) AS area_construida
FROM (SELECT pk, nullif(area_terreno, 0) AS area_terreno, area_construida FROM tx)"""))
def p13(spark, d):
    rows = typed(spark, d).withColumn("area_terreno", F.nullif("area_terreno", F.lit(0.0)))
    return cleaning.fill_missing_areas(rows).select("pk", "area_terreno", "area_construida")


@query("p14_names_normalised", "SELECT p_partkey AS clave_de_parte, p_name AS nombre FROM part")
def p14(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("Clave DE Parte"), F.col("p_name").alias("NOMBRE"))
    return cleaning.normalise_names(rows)


@query("p15_registry_renamed", over("raw", """
SELECT pk, matricula, fecha_radica_texto AS fecha_radicacion, tipo_predio_zona AS tipo_predio, valor AS valor_acto FROM raw"""))
def p15(spark, d):
    return cleaning.rename_registry(raw(spark, d)).select("pk", "matricula", "fecha_radicacion", "tipo_predio", "valor_acto")


QUEUE = f"""
SELECT pk, departamento, municipio, year_radica, valor_acto, tipo_predio, calidad_datos, tipo_error, dinamica_inmobiliaria,
  'PENDIENTE' AS estado_revision FROM cl WHERE calidad_datos IN ('ERROR', 'ADVERTENCIA')"""


@query("p16_review_queue", over("cl", QUEUE))
def p16(spark, d):
    queue = cleaning.review_queue(cl(spark, d), day(AS_OF).cast("timestamp"))
    return queue.drop("fecha_carga", "comentario_revision", "revisado_por", "fecha_revision")


@query("p17_text_sanitised", r"""
SELECT doc_id, upper(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) AS texto
FROM documents""")
def p17(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("texto"))
    return cleaning.sanitise_column(rows, "texto")


@query("p18_price_inputs", over("tx", """
SELECT pk, coalesce(cast(count_a AS DOUBLE), 1) AS count_a, coalesce(cast(count_de AS DOUBLE), 1) AS count_de,
  coalesce(cast(dinamica_inmobiliaria AS DOUBLE), 1) AS dinamica_inmobiliaria,
  coalesce(cast(count_a AS DOUBLE), 1) + coalesce(cast(count_de AS DOUBLE), 1) AS total_intervinientes,
  coalesce(cast(year_radica AS DOUBLE), 2024) AS anio, 1.0::DOUBLE AS mes, 1.0::DOUBLE AS trimestre FROM tx"""))
def p18(spark, d):
    columns = ["pk", "count_a", "count_de", "dinamica_inmobiliaria", "total_intervinientes", "anio", "mes", "trimestre"]
    return cleaning.price_inputs(typed(spark, d)).select(*columns)


@query("p19_code_maps", over("acts", """
SELECT pk, CASE tipo_acto WHEN 'compraventa' THEN 1.0 WHEN 'hipoteca' THEN 2.0 WHEN 'donacion' THEN 3.0 WHEN 'permuta' THEN 4.0
    WHEN 'dacion_pago' THEN 5.0 WHEN 'adjudicacion' THEN 6.0 WHEN 'sucesion' THEN 7.0 WHEN 'otro' THEN 8.0 ELSE 0.0 END::DOUBLE AS acto,
  CASE tipo_predio WHEN 'urbano' THEN 1.0 WHEN 'rural' THEN 2.0 WHEN 'mixto' THEN 3.0 ELSE 0.0 END::DOUBLE AS predio,
  CASE estado_folio WHEN 'activo' THEN 1.0 WHEN 'cancelado' THEN 2.0 WHEN 'cerrado' THEN 3.0 WHEN 'suspendido' THEN 4.0
    ELSE 0.0 END::DOUBLE AS estado
FROM acts"""))
def p19(spark, d):
    from folioscope import constants as K

    return acts(spark, d).select(
        "pk",
        V.code_of(F.col("tipo_acto"), K.ACT_CODES).alias("acto"),
        V.code_of(F.col("tipo_predio"), K.PROPERTY_KIND_CODES).alias("predio"),
        V.code_of(F.col("estado_folio"), K.FOLIO_STATE_CODES).alias("estado"),
    )


@query("p20_location_bucket", over("tx", """
SELECT pk, ('0x' || left(md5(concat_ws('_', departamento, municipio)), 8))::BIGINT % 1000 AS location_hash FROM tx"""))
def p20(spark, d):
    return tx(spark, d).select("pk", features.location_bucket().alias("location_hash"))


@query("p21_request_text", over("raw", "SELECT pk, upper(trim(departamento)) AS departamento, upper(trim(municipio)) AS municipio FROM raw"))
def p21(spark, d):
    return quality.normalise_request(raw(spark, d)).select("pk", "departamento", "municipio")


@query("p22_numeric_inputs", over("tx", """
SELECT coalesce(cast(year_radica AS DOUBLE), 0) AS year_radica, coalesce(cast(count_a AS DOUBLE), 0) AS count_a,
  coalesce(valor_acto, 0) AS valor_acto, coalesce(orip, 0) AS orip FROM tx"""))
def p22(spark, d):
    rows = tx(spark, d).select("pk", "year_radica", "count_a", "valor_acto", "orip", "departamento")
    return cleaning.numeric_inputs(rows, ["pk"])


@query("p23_display_money", "SELECT p_partkey, '$' || format('{:,}', cast(p_size * 1000003 AS BIGINT)) AS precio FROM part")
def p23(spark, d):
    return table(spark, d, "part").select("p_partkey", V.display_money(F.col("p_size") * 1000003).alias("precio"))


# --- filters ------------------------------------------------------------------------------------


@query("f1_required_key", over("raw", "SELECT pk, divipola FROM raw WHERE divipola IS NOT NULL AND trim(divipola) <> '' AND upper(trim(divipola)) <> 'NONE'"))
def f1(spark, d):
    return quality.with_required_folio(raw(spark, d), "divipola").select("pk", "divipola")


GOOD = f"""valor_acto IS NOT NULL AND tipo_acto IS NOT NULL AND fecha_acto IS NOT NULL AND departamento IS NOT NULL
  AND municipio IS NOT NULL AND tipo_predio IS NOT NULL AND numero_intervinientes IS NOT NULL AND estado_folio IS NOT NULL
  AND valor_acto > 0 AND valor_acto < 100000000000 AND numero_intervinientes > 0 AND numero_intervinientes < 100
  AND fecha_acto <= DATE '{AS_OF}' AND year(fecha_acto) >= 1990"""


@query("f2_ingestible_rows", over("acts", f"SELECT pk, valor_acto, fecha_acto FROM acts WHERE {GOOD}"))
def f2(spark, d):
    return quality.accepted(acts(spark, d), day(AS_OF)).select("pk", "valor_acto", "fecha_acto")


@query("f2_ingestion_counts", over("acts", f"""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE {GOOD}) AS valid_rows,
  count(*) - count(*) FILTER (WHERE {GOOD}) AS invalid_rows FROM acts"""))
def f2b(spark, d):
    return quality.ingestion_counts(acts(spark, d), day(AS_OF))


@query("f3_empty_rows_dropped", over("tx", """
SELECT orip, divipola, departamento FROM tx WHERE orip IS NOT NULL OR divipola IS NOT NULL OR departamento IS NOT NULL"""))
def f3(spark, d):
    return cleaning.drop_empty_rows(typed(spark, d).select("orip", "divipola", "departamento"))


@query("f4_dataset_splits", over("cl", SPLITS))
def f4(spark, d):
    rows = classified(spark, d)
    keep = quality.dataset_filters()
    one = rows.agg(*[
        F.struct(
            F.lit(n).alias("dataset"), F.count_if(c).alias("n"),
            F.round(F.sum(F.when(c, F.col("valor_acto"))), 2).alias("suma"),
        ).alias(n) for n, c in keep.items()
    ])
    return one.select(F.inline(F.array(*keep)))


@query("f5_market_with_value", over("tx", """
SELECT pk, valor_acto FROM tx WHERE tiene_valor = 1 AND valor_acto > 0 AND dinamica_inmobiliaria = 1"""))
def f5(spark, d):
    return quality.market_with_value(typed(spark, d)).select("pk", "valor_acto")


@query("f6_quantile_trim", over("tx", """
SELECT pk, valor_acto FROM tx WHERE valor_acto BETWEEN (SELECT quantile_cont(valor_acto, 0.01) FROM tx)
  AND (SELECT quantile_cont(valor_acto, 0.99) FROM tx)"""))
def f6(spark, d):
    return quality.trim_by_quantiles(tx(spark, d).select("pk", "valor_acto"), "valor_acto")


MESSAGES = f"""list_filter([
  CASE WHEN valor_acto <= 0 THEN 'valor_acto must be positive' END,
  CASE WHEN valor_acto > 100000000000 THEN 'valor_acto exceeds reasonable maximum' END,
  CASE WHEN fecha_acto > DATE '{AS_OF}' THEN 'fecha_acto cannot be in the future' END,
  CASE WHEN year(fecha_acto) < 1990 THEN 'fecha_acto too far in the past' END,
  CASE WHEN numero_intervinientes < 1 THEN 'numero_intervinientes must be at least 1' END,
  CASE WHEN numero_intervinientes > 50 THEN 'numero_intervinientes exceeds reasonable maximum' END,
  CASE WHEN area_terreno < 0 THEN 'area_terreno cannot be negative' END,
  CASE WHEN area_terreno > 1000000 THEN 'area_terreno exceeds reasonable maximum' END,
  CASE WHEN area_construida < 0 THEN 'area_construida cannot be negative' END,
  CASE WHEN area_terreno <> 0 AND area_construida > area_terreno THEN 'area_construida cannot exceed area_terreno' END,
  CASE WHEN numero_catastral <> '' AND NOT regexp_full_match(upper(numero_catastral), '[A-Z0-9]{{20,35}}')
    THEN 'numero_catastral format is invalid' END,
  CASE WHEN matricula_inmobiliaria <> '' AND NOT regexp_full_match(upper(matricula_inmobiliaria), '[A-Z0-9]+-\\d+')
    THEN 'matricula_inmobiliaria format is invalid' END], lambda x: x IS NOT NULL)"""


@query("f7_validation_messages", over("acts", f"""
SELECT pk, array_to_string({MESSAGES}, ' | ') AS errores, len({MESSAGES}) = 0 AS es_valida FROM acts"""))
def f7(spark, d):
    return flat(quality.with_validation(acts(spark, d), day(AS_OF)).select("pk", "errores", "es_valida"))


@query("f8_cadastral_format", over("tx", """
SELECT pk, coalesce(regexp_full_match(upper(numero_catastral), '[A-Z0-9]{20,35}'), false) AS valido FROM tx"""))
def f8(spark, d):
    return typed(spark, d).select("pk", V.is_cadastral_number(F.col("numero_catastral")).alias("valido"))


@query("f9_folio_format", over("tx", """
SELECT pk, coalesce(regexp_full_match(upper(matricula_inmobiliaria), '[A-Z0-9]+-\\d+'), false) AS valido FROM tx"""))
def f9(spark, d):
    return typed(spark, d).select("pk", V.is_folio_number(F.col("matricula_inmobiliaria")).alias("valido"))


@query("f10_known_department", over("tx", """
SELECT pk, departamento, coalesce(departamento IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_8'), false)
  AS departamento_valido FROM tx"""))
def f10(spark, d):
    names = ["NATION_1", "NATION_2", "NATION_3", "NATION_5", "NATION_8"]
    return quality.in_known_department(tx(spark, d), names).select("pk", "departamento", "departamento_valido")


@query("f11_field_constraints", over("acts", """
SELECT pk, array_to_string(list_filter([
  CASE WHEN NOT coalesce(valor_acto > 0, false) THEN 'valor_acto' END,
  CASE WHEN NOT coalesce(tipo_acto IN ('compraventa', 'hipoteca', 'donacion', 'permuta', 'dacion_pago', 'adjudicacion',
    'sucesion', 'otro'), false) THEN 'tipo_acto' END,
  CASE WHEN fecha_acto IS NULL THEN 'fecha_acto' END,
  CASE WHEN NOT coalesce(length(departamento) >= 2, false) THEN 'departamento' END,
  CASE WHEN NOT coalesce(length(municipio) >= 2, false) THEN 'municipio' END,
  CASE WHEN NOT coalesce(tipo_predio IN ('urbano', 'rural', 'mixto'), false) THEN 'tipo_predio' END,
  CASE WHEN NOT coalesce(numero_intervinientes >= 1, false) THEN 'numero_intervinientes' END,
  CASE WHEN NOT coalesce(estado_folio IN ('activo', 'cancelado', 'cerrado', 'suspendido'), false) THEN 'estado_folio' END,
  CASE WHEN area_terreno <= 0 THEN 'area_terreno' END,
  CASE WHEN area_construida <= 0 THEN 'area_construida' END], lambda x: x IS NOT NULL), ' | ') AS campos FROM acts"""))
def f11(spark, d):
    return flat(acts(spark, d).select("pk", quality.constraint_messages().alias("campos")))


def clustered_by_property(spark, d):
    """Folder of the transactions laid out by property, written once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in CLUSTERED:
        CLUSTERED[key] = scratch_path(spark, "por-matricula")
        clustered.write_clustered(tx(spark, d), CLUSTERED[key], "matricula")
    return CLUSTERED[key]


CLUSTERED: dict[tuple[str, str], str] = {}


@query("f12_one_property", over("tx", "SELECT pk, matricula, valor_acto FROM tx WHERE matricula = '17'"))
def f12(spark, d):
    path = clustered_by_property(spark, d)
    return clustered.lookup(spark, path, "matricula", "17").select("pk", "matricula", "valor_acto")


@query("f12_many_properties", over("tx", """
SELECT pk, matricula FROM tx WHERE matricula IN (SELECT cast(p_partkey AS VARCHAR) FROM part WHERE p_type = 'SMALL')"""))
def f12b(spark, d):
    wanted = table(spark, d, "part").where(F.col("p_type") == "SMALL").select(F.col("p_partkey").cast("string").alias("matricula"))
    return quality.for_properties(tx(spark, d), wanted).select("pk", "matricula")


@query("f13_pending_reviews", over("cl", f"SELECT pk, departamento, municipio, year_radica, valor_acto, tipo_error, calidad_datos, estado_revision FROM ({QUEUE})"))
def f13(spark, d):
    return monitoring.pending_reviews(cleaning.review_queue(cl(spark, d), day(AS_OF).cast("timestamp"))).drop("fecha_carga")


@query("f14_value_classes", over("tx", """
SELECT pk, CASE WHEN valor_texto IS NULL THEN 'NULO' WHEN valor_acto IS NULL THEN 'NO_NUMERICO' WHEN valor_acto = 0 THEN 'CERO'
  WHEN valor_acto < 0 THEN 'NEGATIVO' WHEN valor_acto < 1000000 THEN 'PEQUENO' WHEN valor_acto > 10000000000 THEN 'EXTREMO'
  ELSE 'VALIDO' END AS clase FROM tx"""))
def f14(spark, d):
    return typed(spark, d).select("pk", quality.value_class(F.col("valor_texto")).alias("clase"))


@query("f15_area_consistency", over("tx", """
SELECT pk, NOT coalesce(area_terreno <> 0 AND area_construida > area_terreno, false) AS coherente FROM tx"""))
def f15(spark, d):
    return typed(spark, d).select("pk", quality.area_consistent().alias("coherente"))


# --- quality classes, joins, flags ----------------------------------------------------------------


@query("b1_quality_classes", over("cl", "SELECT pk, transaction_id, calidad_datos, tipo_error FROM cl"))
def b1(spark, d):
    return classified(spark, d).select("pk", "transaction_id", "calidad_datos", "tipo_error")


@query("b2_market_and_valid_value", over("cl", "SELECT pk, es_mercado_valido, valor_valido FROM cl"))
def b2(spark, d):
    return classified(spark, d).select("pk", "es_mercado_valido", "valor_valido")


@query("j1_yearly_annotations", over("fl", "SELECT pk, matricula, year_radica, anotaciones_por_anio FROM fl"))
def j1(spark, d):
    rows = tx(spark, d).select("pk", "matricula", "year_radica")
    return activity.with_yearly_annotations(rows)


@query("j2_expected_department", over("fl", "SELECT pk, orip, departamento, depto_esperado_orip FROM fl"))
def j2(spark, d):
    return activity.with_expected_department(tx(spark, d).select("pk", "orip", "departamento"))


@query("b3_excessive_activity", over("fl", "SELECT pk, flag_actividad_excesiva FROM fl"))
def b3(spark, d):
    return fl(spark, d).select("pk", "flag_actividad_excesiva")


@query("b4_office_mismatch", over("fl", "SELECT pk, flag_geo_discrepancia FROM fl"))
def b4(spark, d):
    return fl(spark, d).select("pk", "flag_geo_discrepancia")


@query("b5_flag_total", over("fl", "SELECT pk, transaction_id, anotaciones_por_anio, depto_esperado_orip, total_flags_anomalia FROM fl"))
def b5(spark, d):
    return fl(spark, d).select("pk", "transaction_id", "anotaciones_por_anio", "depto_esperado_orip", "total_flags_anomalia")


@query("j3_municipal_average_attached", over("tx", f"""
SELECT pk, municipio, round(m, 2) AS municipal_avg_value FROM tx
LEFT JOIN (SELECT municipio, avg(valor_acto) AS m FROM tx WHERE valor_acto IS NOT NULL GROUP BY municipio) USING (municipio)"""))
def j3(spark, d):
    rows = tx(spark, d)
    metrics = statistics.metric_table(rows, day(AS_OF))
    return rounded(statistics.with_municipal_average(rows.select("pk", "municipio"), metrics, day(AS_OF)), 2)


TOP50 = """(SELECT municipio FROM ml WHERE municipio IS NOT NULL GROUP BY municipio ORDER BY count(*) DESC, municipio LIMIT 50)"""


@query("j4_top_municipality_rows", over("ml", f"SELECT pk, municipio FROM ml WHERE municipio IN {TOP50}"))
def j4(spark, d):
    return statistics.in_top_municipalities(quality.dataset(cl(spark, d), "ml_training")).select("pk", "municipio")


@query("j5_existing_keys_skipped", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def j5(spark, d):
    taken = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return writers.delete_by_key(table(spark, d, "customer").select("c_custkey"), taken, "c_custkey")


@query("j6_codes_attached", over("cl", """
SELECT pk, departamento, coalesce(code, -1) AS departamento_encoded FROM cl
LEFT JOIN (SELECT departamento, cast(row_number() OVER (ORDER BY departamento) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT departamento FROM cl WHERE calidad_datos = 'OK' AND departamento IS NOT NULL AND departamento <> 'NATION_1'))
  USING (departamento)"""))
def j6(spark, d):
    rows = cl(spark, d).select("pk", "departamento", "calidad_datos")
    fitted = rows.where((F.col("calidad_datos") == "OK") & (F.col("departamento") != "NATION_1"))
    codes = features.fit_codes(fitted, "departamento")
    return features.apply_codes(rows.drop("calidad_datos"), codes, "departamento")


@query("u1_files_stacked", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders")
def u1(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rows.unionByName(rows)


@query("u2_review_union", over("cl", "SELECT pk, calidad_datos FROM cl WHERE calidad_datos = 'ERROR' UNION ALL SELECT pk, calidad_datos FROM cl WHERE calidad_datos = 'ADVERTENCIA'"))
def u2(spark, d):
    rows = cl(spark, d).select("pk", "calidad_datos", "es_mercado_valido", "valor_valido")
    return quality.dataset(rows, "errores").unionByName(quality.dataset(rows, "advertencias")).select("pk", "calidad_datos")


@query("scored_listing", over("sc", f"SELECT pk, anomaly_score, {sql_label('anomaly_score')} AS risk_classification FROM sc"))
def scored_listing(spark, d):
    return sc(spark, d).select("pk", "anomaly_score", "risk_classification")
