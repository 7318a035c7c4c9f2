"""Model features, encodings and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import values as V
from folioscope.operators.statistics import top_values
from folioscope.plans.joins import attach_group_stats, attach_lookup, matches, prefixed
from folioscope.plans.quantiles import exact_quantiles
from folioscope.plans.ranks import value_positions

AREA_FEATURES = [
    "area_terreno", "area_construida", "area_total", "log_area_terreno", "log_area_construida",
    "ratio_construccion", "valor_m2_terreno", "valor_m2_construida",
]


def column_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def bit(c: Column) -> Column:
    return V.truth(c).cast("int")


def calendar_features(tx: DataFrame) -> dict[str, Column]:
    """Date features; a table with a year and no date gets those of a day in the middle of the year."""
    if "fecha_radicacion" in tx.columns:
        day = F.col("fecha_radicacion")
        return {
            "year": F.year(day), "month": F.month(day), "quarter": F.quarter(day), "day_of_week": F.weekday(day),
            "is_weekend": bit(F.weekday(day) >= 5), "days_since_2015": F.datediff(day, F.lit("2015-01-01").cast("date")),
        }
    if "year_radica" in tx.columns:
        year, middle = F.col("year_radica").cast("int"), {"month": 6, "quarter": 2, "day_of_week": 3, "is_weekend": 0}
        return {"year": year, **{n: F.lit(v) for n, v in middle.items()}, "days_since_2015": (year - 2015) * 365}
    return {n: F.lit(0) for n in ["year", "month", "quarter", "day_of_week", "is_weekend", "days_since_2015"]}


def zone_features(tx: DataFrame) -> dict[str, Column]:
    """Zone of a property; a table without zones takes it from the rurality class: 1 urban, 2 and 3 rural.

    The class is a number, or the number that ends its text.
    """
    if "tipo_predio" in tx.columns:
        kind = F.col("tipo_predio")
        return {
            "es_urbano": bit(kind.contains("URBANO")),
            "es_rural": bit(kind.contains("RURAL")),
            "sin_zona": bit(kind.isNotNull() & ~kind.rlike("URBANO|RURAL")),
            "predio_nph": bit(kind.contains("NPH")),
            "predio_matriz": bit(kind.contains("MATRIZ")),
            "predio_matriz_nph": bit(kind.contains("MATRIZ NPH")),
        }
    unknown = {n: F.lit(0) for n in ["predio_nph", "predio_matriz", "predio_matriz_nph"]}
    if "categoria_ruralidad" not in tx.columns:
        return {"es_urbano": F.lit(0), "es_rural": F.lit(0), "sin_zona": F.lit(1), **unknown}
    text = F.col("categoria_ruralidad").cast("string")
    number = F.regexp_extract(text, r"(?:^|\D)0*(\d+)(?:\.0*)?\s*$", 1)
    return {"es_urbano": bit(number == "1"), "es_rural": bit(number.isin("2", "3")), "sin_zona": text.isNull().cast("int"), **unknown}


def transaction_features(tx: DataFrame) -> DataFrame:
    """The 39 features of a transaction, missing values as 0, next to ``transaction_id``.

    Without a date column the year stands in for it, without a zone column the rurality class.
    """
    value = F.coalesce("valor_acto", F.lit(0.0))
    yearly = F.coalesce(column_or(tx, "anotaciones_por_anio", 1), F.lit(1))
    has_yearly = "anotaciones_por_anio" in tx.columns
    code = F.coalesce(V.number_or_null(F.col("cod_natujur")), F.lit(0.0))
    features = {
        **calendar_features(tx),
        "valor_acto": value,
        "log_valor": F.log1p(value),
        "valor_millones": value / 1e6,
        "valor_miles_millones": value / 1e9,
        "valor_bajo": bit(value < 50_000_000),
        "valor_medio": bit((value >= 50_000_000) & (value < 500_000_000)),
        "valor_alto": bit(value >= 500_000_000),
        **{name: F.lit(0) for name in AREA_FEATURES},
        "anotaciones_por_anio": yearly,
        "log_anotaciones": F.log1p(yearly.cast("double")) if has_yearly else F.lit(0.0),
        "actividad_alta": bit(yearly > 10) if has_yearly else F.lit(0),
        **zone_features(tx),
        "flag_actividad_excesiva": bit(column_or(tx, "flag_actividad_excesiva", False)),
        "flag_geo_discrepancia": bit(column_or(tx, "flag_geo_discrepancia", False)),
        "total_flags_anomalia": V.as_int(column_or(tx, "total_flags_anomalia", 0)),
        "tiene_valor": F.coalesce(column_or(tx, "tiene_valor", 1).cast("int"), F.lit(1)),
        "cod_naturaleza_num": code,
        "cod_naturaleza_grupo": F.floor(code / 100),
        "count_a": V.as_int(column_or(tx, "count_a", 0)),
        "count_de": V.as_int(column_or(tx, "count_de", 0)),
        "predios_nuevos": V.as_int(column_or(tx, "predios_nuevos", 0)),
    }
    return tx.select("transaction_id", *[F.coalesce(c, F.lit(0)).alias(n) for n, c in features.items()])


TRANSACTION_FEATURES = [
    "year", "month", "quarter", "day_of_week", "is_weekend", "days_since_2015", "valor_acto", "log_valor",
    "valor_millones", "valor_miles_millones", "valor_bajo", "valor_medio", "valor_alto", *AREA_FEATURES,
    "anotaciones_por_anio", "log_anotaciones", "actividad_alta", "es_urbano", "es_rural", "sin_zona",
    "predio_nph", "predio_matriz", "predio_matriz_nph", "flag_actividad_excesiva", "flag_geo_discrepancia",
    "total_flags_anomalia", "tiene_valor", "cod_naturaleza_num", "cod_naturaleza_grupo", "count_a",
    "count_de", "predios_nuevos",
]


def act_features(acts: DataFrame) -> DataFrame:
    """Calendar, value, area, party and missing-data features of an act; source columns stay."""
    day, value = F.col("fecha_acto"), F.col("valor_acto")
    land, built = F.coalesce("area_terreno", F.lit(0.0)), F.coalesce("area_construida", F.lit(0.0))
    filled = acts.withColumns({"area_terreno": land, "area_construida": built})
    land, built = F.col("area_terreno"), F.col("area_construida")
    parties = F.col("numero_intervinientes")
    cadastral = F.col("numero_catastral").isNull() if "numero_catastral" in acts.columns else F.lit(False)
    return filled.withColumns({
        "year": F.year(day),
        "month": F.month(day),
        "day_of_week": F.weekday(day),
        "quarter": F.quarter(day),
        "is_weekend": bit(F.weekday(day) >= 5),
        "log_valor": F.log1p(value),
        "valor_millions": value / 1e6,
        "construction_ratio": F.when(land > 0, built / land).otherwise(0.0),
        "valor_m2_terreno": F.when(land > 0, value / land).otherwise(0.0),
        "valor_m2_construida": F.when(built > 0, value / built).otherwise(0.0),
        "multiple_intervinientes": bit(parties > 2),
        "many_intervinientes": bit(parties > 5),
        "missing_catastral": cadastral.cast("int"),
        "missing_areas": bit((land == 0) | (built == 0)),
    })


ACT_CATEGORIES = ["tipo_acto", "tipo_predio", "estado_folio", "departamento", "municipio"]
ACT_FEATURES = [
    "valor_acto", "log_valor", "valor_millions", "numero_intervinientes", "year", "month", "day_of_week",
    "quarter", "is_weekend", "area_terreno", "area_construida", "construction_ratio", "valor_m2_terreno",
    "valor_m2_construida", "multiple_intervinientes", "many_intervinientes", "missing_catastral",
    "missing_areas", *[c + "_encoded" for c in ACT_CATEGORIES],
]


def select_numbers(df: DataFrame, names: list[str]) -> list[Column]:
    """Features as doubles with NULL as 0, in a fixed order; absent ones are 0."""
    return [F.coalesce(column_or(df, n, 0.0).cast("double"), F.lit(0.0)).alias(n) for n in names]


def fit_codes(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """Alphabetical code per distinct value: ``column``, ``code``.

    Positions come from a dictionary sorted over the cluster, so no task sorts all distinct values.
    """
    c = F.col(column).cast("string")
    value = F.coalesce(c, F.lit(missing)) if missing is not None else c
    distinct = df.select(value.alias(column)).where(F.col(column).isNotNull()).distinct()
    return value_positions(distinct, [], column).select(column, F.col("below").cast("int").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, column: str, missing: str | None = None, name: str | None = None) -> DataFrame:
    """Attach stored codes; a value without a code becomes -1."""
    c = F.col(column).cast("string")
    value = F.coalesce(c, F.lit(missing)) if missing is not None else c
    keyed = df.withColumn("__key", value)
    joined = attach_lookup(keyed, codes.select(F.col(column).alias("__key"), F.col("code").alias("__code")), ["__key"])
    encoded = F.coalesce("__code", F.lit(-1)).alias(name or f"{column}_encoded")
    return joined.select(*df.columns, encoded)


def encode_categories(df: DataFrame, columns: list[str], missing: str | None = None) -> DataFrame:
    out = df
    for c in columns:
        out = apply_codes(out, fit_codes(df, c, missing), c, missing)
    return out


def online_features() -> Column:
    """The 12 numbers the online detector expects, as an array."""
    built = F.coalesce("area_construida", F.lit(0.0))
    names = {
        "valor_acto": F.col("valor_acto"),
        "numero_intervinientes": F.col("numero_intervinientes").cast("double"),
        "year": F.year("fecha_acto").cast("double"),
        "month": F.month("fecha_acto").cast("double"),
        "day_of_week": F.weekday("fecha_acto").cast("double"),
        "tipo_acto": V.code_of(F.lower("tipo_acto"), K.ACT_CODES),
        "tipo_predio": V.code_of(F.lower("tipo_predio"), K.PROPERTY_KIND_CODES),
        "estado_folio": V.code_of(F.lower("estado_folio"), K.FOLIO_STATE_CODES),
        "area_terreno": F.coalesce("area_terreno", F.lit(0.0)),
        "area_construida": built,
        "valor_m2": F.when(built > 0, F.col("valor_acto") / built).otherwise(0.0),
        "location_hash": location_bucket().cast("double"),
    }
    return F.array(*names.values())


def location_bucket(buckets: int = 1000) -> Column:
    return V.stable_number(F.concat_ws("_", "departamento", "municipio")) % buckets


def split_rows(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark test rows by a hash of the key: the same on every run and every partitioning."""
    bucket = V.stable_number(F.lit(seed), F.col(key)) % 10_000
    return df.withColumn("es_prueba", bucket < int(test_share * 10_000))


def with_relative_values(tx: DataFrame) -> DataFrame:
    """Value against its market: ratios to two medians, group z-score and percentile in group."""
    rows = tx.where(F.col("valor_acto").isNotNull())
    area_year = ["departamento", "year_radica"]
    town_year = ["municipio", "year_radica"]
    kind_year = ["departamento", "year_radica", "tipo_predio"]
    v = F.col("valor_acto")
    by_area = exact_quantiles(rows, area_year, "valor_acto", {"mediana_dept_year": 0.5})
    spread = rows.groupBy(*area_year).agg(F.stddev_samp(v).alias("std_dept_year"))
    other = prefixed(spread, area_year, "__s_")
    by_area = by_area.join(other, matches(by_area, other, area_year, "__s_")).drop(*["__s_" + k for k in area_year])
    by_town = exact_quantiles(rows, town_year, "valor_acto", {"mediana_mun_year": 0.5})
    by_kind = rows.groupBy(*kind_year).agg(F.avg(v).alias("__mean"), F.stddev_samp(v).alias("__std"))
    out = attach_lookup(rows, by_area, area_year, null_safe=True)
    out = attach_lookup(out, by_town, town_year, null_safe=True)
    out = attach_lookup(out, by_kind, kind_year, null_safe=True)
    out = with_percent_rank(out, ["departamento"], "valor_acto", "percentil_valor_dept")
    return out.withColumns({
        "valor_vs_mediana_dept_year": F.try_divide(v, F.col("mediana_dept_year")),
        "valor_vs_mediana_mun_year": F.try_divide(v, F.col("mediana_mun_year")),
        "zscore_valor_grupo": F.when(F.col("__std") > 0, (v - F.col("__mean")) / F.col("__std")).otherwise(F.lit(0.0)),
    }).drop("__mean", "__std")


def with_percent_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Relative rank of each value in its group: rows below over rows minus one.

    Ranks are found per distinct value; the rows are joined to them on group and value. Rows
    without a group or a value have no rank.
    """
    positions = value_positions(df, keys, value)
    rank = F.when(F.col("size") > 1, F.col("below") / (F.col("size") - 1)).otherwise(F.lit(0.0))
    ranks = positions.select(*keys, value, "copies", rank.alias(name))
    return attach_group_stats(df, ranks, [*keys, value], "copies").drop("copies")


def with_market_indicators(tx: DataFrame, cities: int = 100, big_cities: int = 10, departments: int = 5) -> DataFrame:
    """Rare municipalities as OTROS, big-city and top-department marks, years since 2015.

    The three lists have a fixed number of rows each and are broadcast.
    """
    listed = top_values(tx, "municipio", cities).select("municipio", F.lit(True).alias("__listed"))
    big = top_values(tx, "municipio", big_cities).select("municipio", F.lit(True).alias("__big"))
    leading = top_values(tx, "departamento", departments).select("departamento", F.lit(True).alias("__leading"))
    out = tx.join(F.broadcast(listed), "municipio", "left").join(F.broadcast(big), "municipio", "left")
    out = out.join(F.broadcast(leading), "departamento", "left")
    return out.select(
        *tx.columns,
        F.when(F.col("__listed"), F.col("municipio")).otherwise("OTROS").alias("municipio_agrupado"),
        bit(F.col("__big")).alias("es_ciudad_grande"),
        bit(F.col("__leading")).alias("es_departamento_top5"),
        (F.col("year_radica") - 2015).alias("anios_desde_2015"),
    )
