"""Declared schemas of the stored tables and of incoming files."""

from __future__ import annotations

from pyspark.sql import types as T

from folioscope.constants import REGISTRY_NAMES

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
BOOL, DAY, TIME = T.BooleanType(), T.DateType(), T.TimestampType()
MONEY, AREA, DEGREES, SCORE = T.DecimalType(18, 2), T.DecimalType(15, 2), T.DecimalType(10, 6), T.DecimalType(5, 4)


def table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# The raw registry arrives as text only.
RAW_REGISTRY = T.StructType([T.StructField(name, STRING) for name in REGISTRY_NAMES])

# A CSV extract with declared types; anything unparsable lands in ``_corrupt_record``.
EXTRACT = table(
    pk=LONG, matricula=STRING, fecha_radicacion=DAY, fecha_apertura=DAY, year_radica=INT,
    orip=STRING, divipola=STRING, departamento=STRING, municipio=STRING, tipo_predio=STRING,
    nombre_natujur=STRING, valor_acto=DOUBLE, tiene_valor=BOOL, count_a=INT, count_de=INT,
    estado_folio=STRING, numero_catastral=STRING, matricula_inmobiliaria=STRING,
    area_terreno=DOUBLE, area_construida=DOUBLE,
)

QUALITY_FIELDS = table(
    calidad_datos=STRING, tipo_error=STRING, es_mercado_valido=BOOL, valor_valido=BOOL,
)

TRANSACTIONS = T.StructType(
    table(
        transaction_id=STRING, pk=STRING, matricula=STRING, fecha_radicacion=DAY, year_radica=INT,
        orip=DOUBLE, divipola=STRING, departamento=STRING, municipio=STRING, tipo_predio=STRING,
        categoria_ruralidad=STRING, num_anotacion=STRING, estado_folio=STRING,
        dinamica_inmobiliaria=INT, cod_natujur=STRING, nombre_natujur=STRING,
        numero_catastral=STRING, count_a=INT, count_de=INT, predios_nuevos=INT, tiene_valor=INT,
        tiene_mas_de_un_valor=INT, valor_acto=DOUBLE,
    ).fields
    + QUALITY_FIELDS.fields
)

SCORED_TRANSACTIONS = T.StructType(
    TRANSACTIONS.fields
    + table(anomaly_score=DOUBLE, is_anomaly=BOOL, risk_classification=STRING, updated_at=TIME).fields
)

# The registry table with geographic coordinates, exact money and areas.
GEO_TRANSACTIONS = table(
    transaction_id=STRING, divipola=STRING, departamento=STRING, municipio=STRING, codigo_orip=STRING,
    numero_matricula=STRING, numero_predial=STRING, tipo_predio=STRING, area_terreno=AREA,
    area_construida=AREA, numero_anotacion=STRING, codigo_naturaleza_juridica=STRING,
    descripcion_naturaleza_juridica=STRING, dinamica_mercado=INT, tipo_acto=STRING, fecha_acto=DAY,
    year_radica=INT, valor_acto=MONEY, numero_intervinientes=INT, tipo_zona=STRING,
    latitud=DEGREES, longitud=DEGREES, calidad_datos=STRING, tiene_valor_nulo=BOOL,
    tiene_area_cero=BOOL, flag_actividad_excesiva=BOOL, anotaciones_por_anio=INT,
    flag_discrepancia_geografica=BOOL, anomaly_score=SCORE, risk_classification=STRING,
    created_at=TIME, updated_at=TIME,
)

METRICS = table(
    metric_name=STRING, metric_value=MONEY, metric_date=DAY, departamento=STRING, municipio=STRING,
)

ALERTS = table(
    transaction_id=STRING, alert_type=STRING, severity=STRING, description=STRING, status=STRING,
    created_at=TIME, resolved_at=TIME,
)

REVIEW_QUEUE = table(
    pk=STRING, departamento=STRING, municipio=STRING, year_radica=INT, valor_acto=DOUBLE,
    tipo_predio=STRING, calidad_datos=STRING, tipo_error=STRING, dinamica_inmobiliaria=INT,
    fecha_carga=TIME, estado_revision=STRING, comentario_revision=STRING, revisado_por=STRING,
    fecha_revision=TIME,
)

DEPARTMENT_YEAR_STATS = table(
    departamento=STRING, year=INT, transacciones=LONG, valor_medio=DOUBLE, valor_mediano=DOUBLE,
    valor_std=DOUBLE, valor_min=DOUBLE, valor_max=DOUBLE, total_registros=LONG,
)

MUNICIPALITY_YEAR_STATS = table(
    municipio=STRING, departamento=STRING, year=INT, transacciones=LONG, valor_medio=DOUBLE,
    valor_mediano=DOUBLE, valor_std=DOUBLE, total_registros=LONG,
)

MODEL_REGISTRY = table(
    model_name=STRING, model_version=STRING, model_type=STRING, trained_at=TIME,
    training_samples=LONG, features_used=STRING, accuracy=DOUBLE, precision=DOUBLE,
    recall=DOUBLE, f1_score=DOUBLE, model_path=STRING, is_active=BOOL,
)

DOCUMENTS = table(
    id=STRING, document=STRING, embedding=T.ArrayType(T.FloatType()),
    metadata=T.MapType(STRING, STRING),
)


def conform(df, schema: T.StructType):
    """Project a frame onto a declared schema: missing columns become NULL, types are cast."""
    from pyspark.sql import functions as F

    present = {c.lower() for c in df.columns}
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name.lower() in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
