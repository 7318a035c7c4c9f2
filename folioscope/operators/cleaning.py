"""Naming, keys, typing and value cleaning of registry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.constants import CLAMP_BOUNDS, MAX_ACCEPTED_AREA, MAX_ACCEPTED_VALUE, PENDING, REGISTRY_NAMES
from folioscope.functions import values as V

WHOLE = ["year_radica", "count_a", "count_de"]
FLAGS = ["dinamica_inmobiliaria", "predios_nuevos", "tiene_valor", "tiene_mas_de_un_valor"]
CATEGORIES = ["departamento", "municipio", "tipo_predio", "categoria_ruralidad", "estado_folio"]
NAMES = ["matricula", "departamento", "municipio", "tipo_predio", "nombre_natujur", "estado_folio"]
AREAS = ["area_terreno", "area_construida"]


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace columns that exist, in place; absent ones are skipped."""
    return df.withColumns({name: c for name, c in new.items() if name in df.columns})


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def rename_registry(df: DataFrame) -> DataFrame:
    """Raw registry names, in any letter case, to transaction names."""
    names = {raw.lower(): new for raw, new in REGISTRY_NAMES.items()}
    return df.toDF(*[names.get(c.lower(), c) for c in df.columns])


def with_transaction_id(df: DataFrame) -> DataFrame:
    """Composite key from the raw text, with a placeholder for every missing part."""
    parts = {"divipola": "UNK", "matricula": "UNK", "num_anotacion": "0", "cod_natujur": "UNK", "year_radica": "0"}
    key = F.concat_ws("_", *[F.coalesce(V.stripped(F.col(c).cast("string")), F.lit(d)) for c, d in parts.items()])
    return df.withColumn("transaction_id", key)


def type_columns(df: DataFrame) -> DataFrame:
    """Text columns to their types; whatever does not parse becomes NULL.

    Numbers are parsed in a step of their own: their checks name them several times, and in one step
    every mention would be parsed anew.
    """
    kinds = dict(df.dtypes)

    def parsed(name: str) -> Column:
        # A number needs no detour over its text, whose digits give the same double again.
        if kinds[name] in ("double", "bigint", "int", "smallint", "tinyint"):
            return F.col(name).cast("double")
        return V.parsed_number(V.money_text(F.col(name)) if name == "valor_acto" else F.col(name))

    df = replace_columns(df, {c: parsed(c) for c in [*WHOLE, "orip", "valor_acto"] if c in kinds})
    new = {c: V.whole(F.col(c)) for c in WHOLE}
    new |= {c: V.flag_or_null(F.col(c)) for c in FLAGS}
    new |= {c: V.category_or_null(F.col(c)) for c in CATEGORIES}
    new |= {c: V.day_or_null(F.col(c)) for c in ("fecha_radicacion", "fecha_apertura")}
    new["valor_acto"] = V.finite(F.col("valor_acto"))
    new["orip"] = V.in_range_or_null(F.col("orip"), 1, 999)
    return replace_columns(df, new)


def clean_registry(raw: DataFrame) -> DataFrame:
    """Raw registry to typed transactions."""
    return type_columns(with_transaction_id(rename_registry(raw)))


def clean_text_columns(df: DataFrame) -> DataFrame:
    """Upper-case, stripped text in which NAN, NONE and blanks are missing."""
    return replace_columns(df, {c: V.text_or_null(F.col(c)) for c in NAMES})


def drop_out_of_range(df: DataFrame) -> DataFrame:
    """Values and areas outside their bounds become NULL."""
    new = {"valor_acto": V.in_range_or_null(F.col("valor_acto"), 0, MAX_ACCEPTED_VALUE)}
    new |= {c: V.in_range_or_null(F.col(c), 0, MAX_ACCEPTED_AREA) for c in AREAS}
    return replace_columns(df, new)


def clamp_out_of_range(df: DataFrame) -> DataFrame:
    """Below the minimum becomes NULL, above the maximum becomes the maximum."""
    return replace_columns(
        df, {c: V.clamped_or_null(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in CLAMP_BOUNDS.items()}
    )


def drop_impossible_dates(df: DataFrame, as_of: Column, column: str = "fecha_radicacion") -> DataFrame:
    first = F.lit("1900-01-01").cast("date")
    return replace_columns(df, {column: V.in_range_or_null(F.col(column), first, as_of)})


def with_has_value(df: DataFrame) -> DataFrame:
    return df.withColumn("tiene_valor", V.truth(F.col("valor_acto") > 0))


def clean_extract(df: DataFrame, as_of: Column) -> DataFrame:
    """Cleaning of a typed extract: text, ranges, dates, required folio, value flag."""
    out = drop_impossible_dates(drop_out_of_range(clean_text_columns(df)), as_of)
    out = out.where(F.col("matricula").isNotNull())
    return out if "tiene_valor" in df.columns else with_has_value(out)


def fill_missing_areas(df: DataFrame) -> DataFrame:
    return df.na.fill(0.0, [c for c in AREAS if c in df.columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def drop_copies(df: DataFrame) -> DataFrame:
    """Whole-row duplicates removed over the full table."""
    return df.dropDuplicates()


def sanitise_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(V.sanitised(F.col(column)), F.lit("")))


def review_queue(classified: DataFrame, loaded_at: Column) -> DataFrame:
    """Rows with an error or a warning, waiting for review."""
    return classified.where(F.col("calidad_datos").isin("ERROR", "ADVERTENCIA")).select(
        "pk", "departamento", "municipio", "year_radica", "valor_acto", "tipo_predio",
        "calidad_datos", "tipo_error", "dinamica_inmobiliaria",
        loaded_at.alias("fecha_carga"),
        F.lit(PENDING).alias("estado_revision"),
        F.lit(None).cast("string").alias("comentario_revision"),
        F.lit(None).cast("string").alias("revisado_por"),
        F.lit(None).cast("timestamp").alias("fecha_revision"),
    )


def price_inputs(df: DataFrame) -> DataFrame:
    """Numeric defaults, parties total and calendar fallbacks of the price model."""
    defaults = {"count_a": 1, "count_de": 1, "predios_nuevos": 0, "dinamica_inmobiliaria": 1}

    def number(name: str, default) -> Column:
        if name not in df.columns:
            return F.lit(float(default))
        return F.coalesce(V.number_or_null(F.col(name)), F.lit(float(default)))

    out = df.withColumns({c: number(c, d) for c, d in defaults.items()})
    year = "year" if "year" in df.columns else "year_radica"
    return out.withColumns({
        "total_intervinientes": F.col("count_a") + F.col("count_de"),
        "anio": number(year, 2024),
        "mes": number("month", 1),
        "trimestre": number("quarter", 1),
    })


def numeric_inputs(df: DataFrame, identifiers: list[str]) -> DataFrame:
    """Every numeric column but the identifiers, as doubles with NULL as 0."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    names = [n for n, kind in df.dtypes if (kind in numeric or kind.startswith("decimal")) and n not in identifiers]
    return df.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
