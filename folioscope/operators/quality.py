"""Contextual quality classes, dataset splits and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import values as V


def quality_verdict(
    min_value: float = K.MIN_VALID_VALUE,
    max_value: float = K.MAX_VALID_VALUE,
    first_year: int = K.FIRST_VALID_YEAR,
    last_year: int = K.LAST_VALID_YEAR,
) -> Column:
    """Struct of quality class and error type; the first rule that holds decides.

    Errors come in order of precedence; warnings are reached by rows without an error only.
    """
    value, year, kind = F.col("valor_acto"), F.col("year_radica"), F.col("tipo_predio")
    market = F.col("dinamica_inmobiliaria") == 1
    valued_act = F.col("nombre_natujur").rlike(f"(?i){K.VALUED_ACTS}")
    rules = [
        (value > max_value, K.ERROR, K.EXTREME_VALUE),
        (market & (value.isNull() | (value == 0)), K.ERROR, K.MARKET_WITHOUT_VALUE),
        (F.col("departamento").isNull() | F.col("municipio").isNull(), K.ERROR, K.BAD_GEOGRAPHY),
        ((year < first_year) | (year > last_year), K.ERROR, K.BAD_YEAR),
        (F.col("dinamica_inmobiliaria").isNull(), K.ERROR, K.BAD_MARKET_FLAG),
        (valued_act & (value > 0) & (value < min_value), K.WARNING, K.TINY_VALUE),
        (kind.isNull() | ~kind.isin(K.PROPERTY_KINDS), K.WARNING, K.BAD_PROPERTY_KIND),
    ]

    def verdict(label: str, cause: str | None) -> Column:
        return F.struct(F.lit(label).alias("calidad_datos"), F.lit(cause).cast("string").alias("tipo_error"))

    chain = F.when(rules[0][0], verdict(*rules[0][1:]))
    for holds, label, cause in rules[1:]:
        chain = chain.when(holds, verdict(label, cause))
    return chain.otherwise(verdict(K.OK, None))


def classify(
    tx: DataFrame,
    min_value: float = K.MIN_VALID_VALUE,
    max_value: float = K.MAX_VALID_VALUE,
    first_year: int = K.FIRST_VALID_YEAR,
    last_year: int = K.LAST_VALID_YEAR,
) -> DataFrame:
    """Add ``calidad_datos``, ``tipo_error``, ``es_mercado_valido`` and ``valor_valido``."""
    market = V.truth(F.col("dinamica_inmobiliaria") == 1)
    judged = tx.withColumn("__verdict", quality_verdict(min_value, max_value, first_year, last_year))
    return judged.select(
        *tx.columns,
        F.col("__verdict.calidad_datos").alias("calidad_datos"),
        F.col("__verdict.tipo_error").alias("tipo_error"),
        market.alias("es_mercado_valido"),
        (market & V.truth(F.col("valor_acto").between(min_value, max_value))).alias("valor_valido"),
    )


def dataset_filters() -> dict[str, Column]:
    """The six datasets cut from the classified rows."""
    quality, market = F.col("calidad_datos"), F.col("es_mercado_valido")
    return {
        "completo": F.lit(True),
        "limpio": quality == K.OK,
        "mercado": market & (quality != K.ERROR),
        "ml_training": market & F.col("valor_valido") & (quality == K.OK),
        "errores": quality == K.ERROR,
        "advertencias": quality == K.WARNING,
    }


def dataset(classified: DataFrame, name: str) -> DataFrame:
    return classified.where(dataset_filters()[name])


def with_required_folio(df: DataFrame, column: str = "matricula") -> DataFrame:
    folio = V.stripped(F.col(column))
    return df.where(folio.isNotNull() & (folio != "") & (F.upper(folio) != "NONE"))


REQUIRED = [
    "valor_acto", "tipo_acto", "fecha_acto", "departamento", "municipio", "tipo_predio",
    "numero_intervinientes", "estado_folio",
]


def ingestible(df: DataFrame, as_of: Column) -> Column:
    """Condition a row has to meet to be ingested; never NULL."""
    rule = F.lit(True)
    for name in REQUIRED:
        if name in df.columns:
            rule = rule & F.col(name).isNotNull()
    rule = rule & (F.col("valor_acto") > 0) & (F.col("valor_acto") < 100_000_000_000)
    if "numero_intervinientes" in df.columns:
        rule = rule & (F.col("numero_intervinientes") > 0) & (F.col("numero_intervinientes") < 100)
    if "fecha_acto" in df.columns:
        when = F.col("fecha_acto").try_cast("timestamp")
        rule = rule & (when <= as_of) & (F.year(when) >= 1990)
    return V.truth(rule)


def accepted(df: DataFrame, as_of: Column) -> DataFrame:
    return df.where(ingestible(df, as_of))


def ingestion_counts(df: DataFrame, as_of: Column) -> DataFrame:
    good = ingestible(df, as_of)
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(good).alias("valid_rows"),
        F.count_if(~good).alias("invalid_rows"),
    )


def market_with_value(tx: DataFrame) -> DataFrame:
    """Rows of the price model: declared value above zero and, where known, a market act."""
    kept = tx.where((F.col("tiene_valor") == 1) & (F.col("valor_acto") > 0))
    return kept.where(F.col("dinamica_inmobiliaria") == 1) if "dinamica_inmobiliaria" in tx.columns else kept


def validation_messages(as_of: Column) -> Column:
    """Every business rule a transaction breaks."""
    value, when, parties = F.col("valor_acto"), F.col("fecha_acto"), F.col("numero_intervinientes")
    land, built = F.col("area_terreno"), F.col("area_construida")
    cadastral, folio = F.col("numero_catastral"), F.col("matricula_inmobiliaria")
    return V.messages(
        (value <= 0, F.lit(K.INVALID_VALUE)),
        (value > 100_000_000_000, F.lit(K.VALUE_TOO_LARGE)),
        (when > as_of, F.lit(K.FUTURE_DATE)),
        (F.year(when) < 1990, F.lit(K.DATE_TOO_OLD)),
        (parties < 1, F.lit(K.TOO_FEW_PARTIES)),
        (parties > 50, F.lit(K.TOO_MANY_PARTIES)),
        (land < 0, F.lit(K.NEGATIVE_LAND)),
        (land > 1_000_000, F.lit(K.LAND_TOO_LARGE)),
        (built < 0, F.lit(K.NEGATIVE_BUILT)),
        ((land != 0) & (built > land), F.lit(K.BUILT_OVER_LAND)),
        ((cadastral != "") & ~V.is_cadastral_number(cadastral), F.lit(K.BAD_CADASTRAL)),
        ((folio != "") & ~V.is_folio_number(folio), F.lit(K.BAD_FOLIO)),
    )


def with_validation(df: DataFrame, as_of: Column) -> DataFrame:
    found = df.withColumn("errores", validation_messages(as_of))
    return found.withColumn("es_valida", F.size("errores") == 0)


def constraint_messages() -> Column:
    """Names of the request fields that break their declared constraint; a missing field breaks it."""

    def broken(holds: Column) -> Column:
        return ~V.truth(holds)

    return V.messages(
        (broken(F.col("valor_acto") > 0), F.lit("valor_acto")),
        (broken(F.col("tipo_acto").isin(list(K.ACT_CODES))), F.lit("tipo_acto")),
        (F.col("fecha_acto").isNull(), F.lit("fecha_acto")),
        (broken(F.length("departamento") >= 2), F.lit("departamento")),
        (broken(F.length("municipio") >= 2), F.lit("municipio")),
        (broken(F.col("tipo_predio").isin(list(K.PROPERTY_KIND_CODES))), F.lit("tipo_predio")),
        (broken(F.col("numero_intervinientes") >= 1), F.lit("numero_intervinientes")),
        (broken(F.col("estado_folio").isin(list(K.FOLIO_STATE_CODES))), F.lit("estado_folio")),
        (F.col("area_terreno") <= 0, F.lit("area_terreno")),
        (F.col("area_construida") <= 0, F.lit("area_construida")),
    )


def normalise_request(df: DataFrame) -> DataFrame:
    return df.withColumns({c: V.upper_text(F.col(c)) for c in ("departamento", "municipio")})


def in_known_department(df: DataFrame, names: list[str] = K.DEPARTMENTS) -> DataFrame:
    return df.withColumn("departamento_valido", V.truth(F.upper("departamento").isin(names)))


def area_consistent() -> Column:
    """Built area does not exceed land area; unknown or zero land cannot contradict it."""
    return ~V.truth((F.col("area_terreno") != 0) & (F.col("area_construida") > F.col("area_terreno")))


def value_class(raw: Column) -> Column:
    """Class of a value text: absent, not a number, zero, negative, tiny, extreme or valid."""
    number = V.money_or_null(raw)
    return (
        F.when(raw.isNull(), "NULO")
        .when(number.isNull(), "NO_NUMERICO")
        .when(number == 0, "CERO")
        .when(number < 0, "NEGATIVO")
        .when(number < K.MIN_VALID_VALUE, "PEQUENO")
        .when(number > K.MAX_VALID_VALUE, "EXTREMO")
        .otherwise("VALIDO")
    )


def for_property(df: DataFrame, folio: str) -> DataFrame:
    return df.where(F.col("matricula") == folio)


def for_properties(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of all wanted properties; the list is counted before it may be broadcast."""
    from folioscope.plans.joins import attach_lookup

    return attach_lookup(df, wanted.select("matricula").distinct(), ["matricula"], "left_semi")


def trim_by_quantiles(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Keep values between two exact quantiles, both included."""
    from folioscope.plans.quantiles import exact_quantiles

    bounds = exact_quantiles(df, [], column, {"lo": low, "hi": high}).select(F.struct("lo", "hi").alias("b")).scalar()
    return df.where(F.col(column).between(bounds["lo"], bounds["hi"]))
