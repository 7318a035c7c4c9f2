"""Registration of queries and the shared inputs on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.operators.activity import flag_business_anomalies
from folioscope.operators.cleaning import clean_registry
from folioscope.operators.quality import classify
from folioscope.operators.risk import risk_label
from folioscope.session import scratch_path
from folioscope.sources.tpch_registry import RAW_REGISTRY, TABLES, load_table, raw_registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AS_OF = "2012-01-01"
MAX_PER_YEAR = 10


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the equivalent SQL where there is one."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_table(spark, folder, name)


STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """A derived table, written below the shared folder once per application and read back.

    The registry is a stored file to begin with and its cleaned form is the table every statistic
    reads, so the queries scan the columns they need instead of joining and typing the rows anew.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in STORED:
        path, df = scratch_path(spark, name), build()
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(path)
        STORED[key] = path, df.schema
    path, schema = STORED[key]
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw registry text, as it would arrive."""
    return stored(spark, folder, "registro", lambda: raw_registry(spark, folder))


def typed(spark: SparkSession, folder: str) -> DataFrame:
    """Raw registry cleaned on the fly; the value text is kept next to the number."""
    return clean_registry(raw(spark, folder).withColumn("valor_texto", F.col("valor")))


def classified(spark: SparkSession, folder: str) -> DataFrame:
    return classify(typed(spark, folder))


def cl(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned and classified table, stored by quality class."""
    return stored(spark, folder, "completo", lambda: classified(spark, folder), "calidad_datos")


def tx(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions of the stored table without their quality columns."""
    return cl(spark, folder).drop("calidad_datos", "tipo_error", "es_mercado_valido", "valor_valido")


def fl(spark: SparkSession, folder: str) -> DataFrame:
    return flag_business_anomalies(cl(spark, folder), MAX_PER_YEAR)


def with_scores(df: DataFrame) -> DataFrame:
    """Stored scores stand-in: the discount gives the score, missing for some rows."""
    score = F.col("puntaje_a")
    return df.withColumns({
        "anomaly_score": score,
        "is_anomaly": F.coalesce(score >= 0.5, F.lit(False)),
        "risk_classification": risk_label(score),
    })


def sc(spark: SparkSession, folder: str) -> DataFrame:
    return with_scores(cl(spark, folder))


def acts(spark: SparkSession, folder: str) -> DataFrame:
    """Ingest records: one registered act with its parties and areas."""
    return tx(spark, folder).select(
        "pk",
        "valor_acto",
        F.lower("nombre_natujur").alias("tipo_acto"),
        F.col("fecha_radicacion").alias("fecha_acto"),
        "departamento",
        "municipio",
        F.lower("tipo_predio").alias("tipo_predio"),
        (F.col("count_a") + F.col("count_de")).alias("numero_intervinientes"),
        F.lower("estado_folio").alias("estado_folio"),
        "numero_catastral",
        "matricula_inmobiliaria",
        "area_terreno",
        "area_construida",
        "puntaje_a",
        "puntaje_b",
    )


def flat(df: DataFrame) -> DataFrame:
    """Text arrays joined to one text, so that results compare by value."""
    out = {c: F.array_join(c, " | ") for c, kind in df.dtypes if kind.startswith("array<string")}
    return df.withColumns(out) if out else df


def rounded(df: DataFrame, digits: int = 4, **own: int) -> DataFrame:
    """Doubles rounded for comparison; -1 in ``own`` leaves a column alone."""
    kinds = [c for c, kind in df.dtypes if kind == "double" and own.get(c, digits) >= 0]
    return df.withColumns({c: F.round(c, own.get(c, digits)) for c in kinds}) if kinds else df


# --- the same inputs in SQL -------------------------------------------------------------------

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def sql_number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUMBER}') THEN try_cast(trim({x}) AS DOUBLE) END"


def sql_whole(x: str) -> str:
    n = f"({sql_number(x)})"
    return f"CASE WHEN {n} = floor({n}) THEN cast({n} AS INTEGER) END"


def sql_flag(x: str) -> str:
    return f"CASE {x} WHEN '1' THEN 1 WHEN '0' THEN 0 END"


def sql_category(x: str) -> str:
    return f"nullif(upper(trim({x})), 'NONE')"


def sql_label(x: str) -> str:
    return f"CASE WHEN {x} < 0.4 THEN 'normal' WHEN {x} < 0.7 THEN 'suspicious' WHEN {x} >= 0.7 THEN 'high-risk' END"


CTE = {
    "raw": RAW_REGISTRY.format(**{t: t for t in TABLES}),
    "tx": f"""
SELECT coalesce(trim(divipola), 'UNK') || '_' || coalesce(trim(matricula), 'UNK') || '_'
    || coalesce(trim(num_anotacion), '0') || '_' || coalesce(trim(cod_natujur), 'UNK') || '_'
    || coalesce(trim(year_radica), '0') AS transaction_id,
  pk, matricula, cast(try_strptime(fecha_radica_texto, '%d/%m/%Y') AS DATE) AS fecha_radicacion,
  {sql_whole('year_radica')} AS year_radica,
  CASE WHEN orip BETWEEN 1 AND 999 THEN orip END AS orip, divipola,
  {sql_category('departamento')} AS departamento, {sql_category('municipio')} AS municipio,
  {sql_category('tipo_predio_zona')} AS tipo_predio, {sql_category('categoria_ruralidad')} AS categoria_ruralidad,
  num_anotacion, {sql_category('estado_folio')} AS estado_folio,
  {sql_flag('dinamica_inmobiliaria')} AS dinamica_inmobiliaria, cod_natujur, nombre_natujur, numero_catastral,
  matricula_inmobiliaria, {sql_whole('count_a')} AS count_a, {sql_whole('count_de')} AS count_de,
  {sql_flag('predios_nuevos')} AS predios_nuevos, {sql_flag('tiene_valor')} AS tiene_valor,
  {sql_flag('tiene_mas_de_un_valor')} AS tiene_mas_de_un_valor,
  {sql_number("replace(valor, ',', '')")} AS valor_acto, valor AS valor_texto,
  area_terreno, area_construida, puntaje_a, puntaje_b
FROM raw""",
    "cl": """
SELECT *, CASE
    WHEN valor_acto > 10000000000 THEN 'ERROR'
    WHEN dinamica_inmobiliaria = 1 AND (valor_acto IS NULL OR valor_acto = 0) THEN 'ERROR'
    WHEN departamento IS NULL OR municipio IS NULL THEN 'ERROR'
    WHEN year_radica < 2000 OR year_radica > 2025 THEN 'ERROR'
    WHEN dinamica_inmobiliaria IS NULL THEN 'ERROR'
    WHEN regexp_matches(upper(nombre_natujur), 'COMPRAVENTA|HIPOTECA|VENTA|MUTUO') AND valor_acto > 0
      AND valor_acto < 1000000 THEN 'ADVERTENCIA'
    WHEN tipo_predio IS NULL OR tipo_predio NOT IN ('URBANO', 'RURAL', 'SIN INFORMACION', 'MIXTO') THEN 'ADVERTENCIA'
    ELSE 'OK' END AS calidad_datos,
  CASE
    WHEN valor_acto > 10000000000 THEN 'VALOR_EXTREMO_DIGITACION'
    WHEN dinamica_inmobiliaria = 1 AND (valor_acto IS NULL OR valor_acto = 0) THEN 'MERCADO_SIN_VALOR'
    WHEN departamento IS NULL OR municipio IS NULL THEN 'GEOGRAFIA_INVALIDA'
    WHEN year_radica < 2000 OR year_radica > 2025 THEN 'YEAR_INVALIDO'
    WHEN dinamica_inmobiliaria IS NULL THEN 'DINAMICA_INVALIDA'
    WHEN regexp_matches(upper(nombre_natujur), 'COMPRAVENTA|HIPOTECA|VENTA|MUTUO') AND valor_acto > 0
      AND valor_acto < 1000000 THEN 'VALOR_IRRISIORIO'
    WHEN tipo_predio IS NULL OR tipo_predio NOT IN ('URBANO', 'RURAL', 'SIN INFORMACION', 'MIXTO')
      THEN 'TIPO_PREDIO_INVALIDO' END AS tipo_error,
  coalesce(dinamica_inmobiliaria = 1, false) AS es_mercado_valido,
  coalesce(dinamica_inmobiliaria = 1 AND valor_acto BETWEEN 1000000 AND 10000000000, false) AS valor_valido
FROM tx""",
    "ml": "SELECT * FROM cl WHERE es_mercado_valido AND valor_valido AND calidad_datos = 'OK'",
    "expected": """
SELECT orip, departamento AS depto_esperado_orip FROM (
  SELECT orip, departamento, row_number() OVER (PARTITION BY orip ORDER BY count(departamento) DESC, departamento) AS r
  FROM tx WHERE orip IS NOT NULL GROUP BY orip, departamento) WHERE r = 1""",
    "fl": """
SELECT cl.*, depto_esperado_orip, coalesce(n, 0) AS anotaciones_por_anio,
  coalesce(n, 0) > 10 AS flag_actividad_excesiva,
  coalesce(departamento <> depto_esperado_orip, false) AS flag_geo_discrepancia,
  cast(coalesce(n, 0) > 10 AS INTEGER) + cast(coalesce(departamento <> depto_esperado_orip, false) AS INTEGER)
    AS total_flags_anomalia
FROM cl LEFT JOIN expected USING (orip)
LEFT JOIN (SELECT matricula, year_radica, count(*) AS n FROM tx GROUP BY ALL) USING (matricula, year_radica)""",
    "sc": f"""
SELECT *, puntaje_a AS anomaly_score, coalesce(puntaje_a >= 0.5, false) AS is_anomaly,
  {sql_label('puntaje_a')} AS risk_classification FROM cl""",
    "fsc": f"""
SELECT *, puntaje_a AS anomaly_score, coalesce(puntaje_a >= 0.5, false) AS is_anomaly,
  {sql_label('puntaje_a')} AS risk_classification FROM fl""",
    "acts": """
SELECT pk, valor_acto, lower(nombre_natujur) AS tipo_acto, fecha_radicacion AS fecha_acto, departamento, municipio,
  lower(tipo_predio) AS tipo_predio, count_a + count_de AS numero_intervinientes, lower(estado_folio) AS estado_folio,
  numero_catastral, matricula_inmobiliaria, area_terreno, area_construida, puntaje_a, puntaje_b
FROM tx""",
}
NEEDS = {
    "raw": [], "tx": ["raw"], "cl": ["raw", "tx"], "ml": ["raw", "tx", "cl"], "expected": ["raw", "tx"],
    "fl": ["raw", "tx", "cl", "expected"], "sc": ["raw", "tx", "cl"],
    "fsc": ["raw", "tx", "cl", "expected", "fl"], "acts": ["raw", "tx"],
}


def over(name: str, body: str, **more: str) -> str:
    """SQL over one of the shared inputs, with further named subqueries before the body."""
    parts = [f"{n} AS ({CTE[n]})" for n in [*NEEDS[name], name]]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
