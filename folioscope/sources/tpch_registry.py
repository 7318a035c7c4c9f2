"""Binding of a star schema of orders to the raw property registry.

The statement is plain SQL that Spark and other engines read alike. A line item becomes a registry
row; its part is the property, the supplier's nation the department.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.sources.readers import spread_over_cores

TABLES = ["lineitem", "orders", "part", "supplier", "nation"]

RAW_REGISTRY = """
SELECT
  cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || cast(l_partkey AS string)
    || '-' || cast(l_suppkey AS string) AS pk,
  cast(l_partkey AS string) AS matricula,
  lpad(cast(day(l_shipdate) AS string), 2, '0') || '/' || lpad(cast(month(l_shipdate) AS string), 2, '0')
    || '/' || cast(year(l_shipdate) + 10 AS string) AS fecha_radica_texto,
  CASE WHEN l_orderkey % 97 = 0 THEN cast(1990 + l_orderkey % 7 AS string)
       WHEN l_orderkey % 89 = 0 THEN NULL
       WHEN l_orderkey % 83 = 0 THEN 'N/D'
       ELSE cast(year(l_shipdate) + 10 AS string) END AS year_radica,
  cast(CASE WHEN l_orderkey % 79 = 0 THEN 1000 ELSE l_suppkey % 10 + 1 END AS double) AS orip,
  CASE WHEN l_orderkey % 73 = 0 THEN NULL ELSE lpad(cast(n_nationkey AS string), 5, '0') END AS divipola,
  CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE ' ' || lower(n_name) END AS departamento,
  n_name || '-' || cast(l_suppkey % 7 AS string) AS municipio,
  CASE l_linenumber WHEN 1 THEN 'URBANO' WHEN 2 THEN 'RURAL' WHEN 3 THEN 'SIN INFORMACION' WHEN 4 THEN 'MIXTO'
       WHEN 5 THEN ' urbano ' WHEN 6 THEN NULL ELSE 'OTRO' END AS tipo_predio_zona,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'Categoria ' || cast(p_size % 4 AS string) END AS categoria_ruralidad,
  cast(l_linenumber AS string) AS num_anotacion,
  CASE o_orderstatus WHEN 'F' THEN 'ACTIVO' WHEN 'O' THEN 'CERRADO' ELSE 'CANCELADO' END AS estado_folio,
  CASE WHEN l_orderkey % 61 = 0 THEN NULL WHEN l_linestatus = 'O' THEN '1' ELSE '0' END AS dinamica_inmobiliaria,
  cast(100 + 7 * p_size AS string) AS cod_natujur,
  CASE p_type WHEN 'STANDARD' THEN 'COMPRAVENTA' WHEN 'ECONOMY' THEN 'Hipoteca' WHEN 'MEDIUM' THEN 'DONACION'
       WHEN 'SMALL' THEN 'MUTUO' WHEN 'LARGE' THEN 'SUCESION' ELSE 'REMATE' END AS nombre_natujur,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN 'AB-12'
       ELSE lpad(cast(l_partkey AS string), 25, '0') END AS numero_catastral,
  CASE WHEN l_orderkey % 17 = 0 THEN 'SIN NUMERO'
       ELSE cast(l_suppkey % 90 AS string) || 'c-' || cast(l_partkey AS string) END AS matricula_inmobiliaria,
  cast(l_orderkey % 4 AS string) AS count_a,
  cast(l_partkey % 5 AS string) AS count_de,
  CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS predios_nuevos,
  CASE WHEN l_orderkey % 53 = 0 THEN '0' ELSE '1' END AS tiene_valor,
  CASE WHEN l_orderkey % 59 = 0 THEN '1' ELSE '0' END AS tiene_mas_de_un_valor,
  CASE WHEN l_orderkey % 53 = 0 THEN NULL WHEN l_orderkey % 47 = 0 THEN '0'
       WHEN l_orderkey % 43 = 0 THEN 'SIN VALOR' WHEN l_orderkey % 41 = 0 THEN '999,999'
       WHEN l_orderkey % 37 = 0 THEN '20,000,000,000'
       ELSE cast(cast(round(l_extendedprice * 10000) AS bigint) AS string) END AS valor,
  CASE WHEN l_orderkey % 29 = 0 THEN 0.0e0 ELSE 10 * l_quantity END AS area_terreno,
  7 * l_quantity AS area_construida,
  CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE round(l_discount * 10, 2) END AS puntaje_a,
  round(l_tax * 10, 2) AS puntaje_b
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {part} ON l_partkey = p_partkey
JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey
"""


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Raw registry rows; join order and broadcasts are left to Catalyst."""
    tables = {t: load_table(spark, folder, t) for t in TABLES}
    tables["lineitem"] = spread_over_cores(tables["lineitem"])
    return spark.sql(RAW_REGISTRY, **tables)
