"""Data sets behind maps, indicators, charts and alert feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import values as V
from folioscope.operators.risk import map_colour, map_tier, marker_radius
from folioscope.operators.statistics import percent

PLACE = ["departamento", "municipio"]


def map_rows(
    scored: DataFrame, department: str | None = None, start: Column | None = None, end: Column | None = None,
    risk: str | None = None,
) -> DataFrame:
    rows = scored
    if department is not None:
        rows = rows.where(F.col("departamento") == department.upper())
    if start is not None:
        rows = rows.where(F.col("fecha_radicacion") >= start)
    if end is not None:
        rows = rows.where(F.col("fecha_radicacion") <= end)
    if risk is not None:
        rows = rows.where(F.col("risk_classification") == risk)
    return rows


def municipality_map(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Count, mean value, class counts and anomaly rate per municipality, with its display tier."""
    label = F.col("risk_classification")
    grouped = rows.where(F.col("municipio").isNotNull()).groupBy(*PLACE).agg(
        F.count("*").alias("transaction_count"),
        F.avg("valor_acto").alias("average_value"),
        F.count_if(label == "high-risk").alias("high_risk_count"),
        F.count_if(label == "suspicious").alias("suspicious_count"),
        F.count_if(label == "normal").alias("normal_count"),
        (F.count_if("is_anomaly") / F.count("*")).alias("anomaly_rate"),
    )
    rate, count = F.col("anomaly_rate"), F.col("transaction_count")
    shown = grouped.withColumns({"nivel": map_tier(rate), "color": map_colour(rate), "radio": marker_radius(count)})
    return shown if n is None else shown.orderBy(F.desc("transaction_count"), *PLACE).limit(n)


def geo_features(summary: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """One GeoJSON feature per municipality; without coordinates the geometry is empty."""
    if coordinates is not None:
        from folioscope.plans.joins import attach_lookup

        summary = attach_lookup(summary, coordinates.select(*PLACE, "lon", "lat"), PLACE)
        geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    else:
        geometry = F.lit(None).cast("struct<type:string,coordinates:array<double>>")
    properties = F.struct(*[c for c in summary.columns if c not in ("lon", "lat")])
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return summary.select(*PLACE, F.to_json(feature).alias("feature"))


def heat_map(summary: DataFrame, metric: str) -> DataFrame:
    """Chosen metric per municipality and its 0-1 intensity."""
    c = F.col(metric)
    bounds = summary.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("b")).scalar()
    intensity = F.coalesce(F.try_divide(c - bounds["lo"], bounds["hi"] - bounds["lo"]), F.lit(0.0))
    return summary.select(*PLACE, c.cast("double").alias("value"), intensity.alias("intensity"))


def municipalities_of(tx: DataFrame, department: str) -> DataFrame:
    return tx.where(F.upper("departamento") == department.upper()).select("departamento", "municipio").distinct()


def municipalities_per_department(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("departamento").isNotNull()).select("departamento", "municipio").distinct()


def indicators(scored: DataFrame, as_of: str, days: int) -> DataFrame:
    """Indicators of the last ``days`` before ``as_of`` and their change from the period before."""
    end = F.lit(as_of).cast("date")
    day = F.col("fecha_radicacion")
    rows = scored.where((day > F.date_sub(end, 2 * days)) & (day <= end))
    current = day > F.date_sub(end, days)
    period = rows.withColumn("periodo", F.when(current, "actual").otherwise("anterior"))

    def measures(chosen: str) -> list[Column]:
        here = F.col("periodo") == chosen
        return [
            F.count_if(here).alias(f"n_{chosen}"),
            F.count_if(here & F.col("is_anomaly")).alias(f"anomalias_{chosen}"),
            F.avg(F.when(here, F.col("valor_acto"))).alias(f"valor_{chosen}"),
            F.count_if(here & (F.col("calidad_datos") == "OK")).alias(f"limpias_{chosen}"),
        ]

    wide = period.agg(
        *measures("actual"), *measures("anterior"),
        F.count_distinct(F.when(F.col("periodo") == "actual", F.col("municipio"))).alias("municipios"),
    )

    def change(name: str) -> Column:
        now, before = F.col(f"{name}_actual"), F.col(f"{name}_anterior")
        return percent(now - before, before)

    return wide.select(
        F.col("n_actual").alias("transacciones"),
        percent(F.col("anomalias_actual"), F.col("n_actual")).alias("tasa_anomalias"),
        F.col("valor_actual").alias("valor_promedio"),
        percent(F.col("limpias_actual"), F.col("n_actual")).alias("calidad_datos"),
        "municipios",
        change("n").alias("cambio_transacciones"),
        change("anomalias").alias("cambio_anomalias"),
        change("valor").alias("cambio_valor"),
    )


def anomaly_type_shares(flagged: DataFrame) -> DataFrame:
    """Kinds of anomaly over all rows; a row counts once per kind it shows."""
    day, year = F.col("fecha_radicacion"), F.col("year_radica")
    value = F.col("valor_acto")
    kinds = V.messages(
        ((value < K.LOW_VALUE) | (value > K.HIGH_VALUE), F.lit("Valores atípicos")),
        (F.col("flag_actividad_excesiva"), F.lit("Duplicidad sospechosa")),
        (F.col("flag_geo_discrepancia"), F.lit("Errores de anotación")),
        (F.year(day) != year, F.lit("Inconsistencia temporal")),
        (F.col("departamento").isNull() | F.col("valor_acto").isNull() | year.isNull(), F.lit("Datos incompletos")),
    )
    counts = flagged.select(F.explode(kinds).alias("tipo")).groupBy("tipo").agg(F.count("*").alias("cantidad"))
    # The grouped result has one row per kind.
    return counts.withColumn("porcentaje", percent(F.col("cantidad"), F.sum("cantidad").over(Window.partitionBy())))


def worst_municipalities(scored: DataFrame, n: int = 5) -> DataFrame:
    """Municipalities with most alerts in their last year, the rate and its trend.

    The window runs over one row per municipality and year.
    """
    known = scored.where(F.col("municipio").isNotNull() & F.col("year_radica").isNotNull())
    yearly = known.groupBy("municipio", "year_radica").agg(
        F.count("*").alias("n"), F.count_if("is_anomaly").alias("alertas")
    ).withColumn("tasa", F.round(percent(F.col("alertas"), F.col("n")), 4))
    order = Window.partitionBy("municipio").orderBy("year_radica")
    newest = Window.partitionBy("municipio").orderBy(F.desc("year_radica"))
    compared = yearly.withColumns({"tasa_previa": F.lag("tasa").over(order), "__r": F.row_number().over(newest)})
    trend = F.when(F.col("tasa") > F.col("tasa_previa"), "up").when(F.col("tasa") < F.col("tasa_previa"), "down").otherwise("flat")
    latest = compared.where(F.col("__r") == 1).withColumn("tendencia", trend)
    return latest.orderBy(F.desc("alertas"), "municipio").limit(n).select("municipio", "year_radica", "alertas", "tasa", "tendencia")


def alert_feed(tx: DataFrame, low_cluster: int = 15, spike: float = 1.4, repeated: int = 8) -> DataFrame:
    """Low-value clusters, monthly spikes, incomplete rows and repeated folios as one feed."""
    town = tx.where(F.col("municipio").isNotNull())
    monthly = town.where(F.col("fecha_radicacion").isNotNull()).withColumn("mes", F.date_trunc("month", "fecha_radicacion").cast("date"))

    def feed(df: DataFrame, kind: str, severity: str, subject: str, amount: str, note: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"),
            F.col(subject).alias("sujeto"), F.col("mes"), F.col(amount).cast("long").alias("cantidad"),
            F.concat(F.col(amount).cast("string"), F.lit(note)).alias("description"), F.lit("active").alias("status"),
        )

    cheap = monthly.where((F.col("valor_acto") > 0) & (F.col("valor_acto") < K.LOW_VALUE))
    cheap = cheap.groupBy("municipio", "mes").agg(F.count("*").alias("n")).where(F.col("n") >= low_cluster)
    counts = monthly.groupBy("municipio", "mes").agg(F.count("*").alias("n"))
    # One row per municipality and month is left for the window.
    mean = F.avg("n").over(Window.partitionBy("municipio"))
    spikes = counts.withColumn("__mean", mean).where(F.col("n") > F.col("__mean") * spike)
    lacking = F.col("departamento").isNull() | F.col("valor_acto").isNull() | F.col("year_radica").isNull()
    incomplete = town.where(lacking).groupBy("municipio").agg(F.count("*").alias("n")).withColumn("mes", F.lit(None).cast("date"))
    doubled = tx.where(F.col("fecha_radicacion").isNotNull()).withColumn("mes", F.date_trunc("month", "fecha_radicacion").cast("date"))
    doubled = doubled.groupBy("matricula", "mes").agg(F.count("*").alias("n")).where(F.col("n") >= repeated)
    return (
        feed(cheap, "fraude", "alta", "municipio", "n", " transacciones con valores sospechosamente bajos")
        .unionByName(feed(spikes, "anomalia", "media", "municipio", "n", " transacciones sobre el promedio mensual"))
        .unionByName(feed(incomplete, "calidad", "media", "municipio", "n", " registros con campos obligatorios incompletos"))
        .unionByName(feed(doubled, "fraude", "alta", "matricula", "n", " transacciones con la misma matrícula"))
    )
