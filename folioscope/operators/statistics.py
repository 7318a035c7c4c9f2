"""Grouped statistics, views and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.plans.joins import attach_lookup
from folioscope.plans.quantiles import with_quantiles

VALUE = F.col
MEDIAN = {"valor_mediano": 0.5}


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def total_rows(df: DataFrame) -> Column:
    """Row count of a frame as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()


def department_year_stats(ml_rows: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Count, mean, median, deviation and range of value per department and year."""
    rows = ml_rows.where(F.col("departamento").isNotNull() & F.col("year_radica").isNotNull())
    rows = rows.withColumnRenamed("year_radica", "year")
    keys, v = ["departamento", "year"], F.col("valor_acto")
    summary = rows.groupBy(*keys).agg(
        F.count(v).alias("transacciones"),
        F.avg(v).alias("valor_medio"),
        F.stddev_samp(v).alias("valor_std"),
        F.min(v).alias("valor_min"),
        F.max(v).alias("valor_max"),
        F.count("pk").alias("total_registros"),
    )
    return with_quantiles(summary, rows, keys, "valor_acto", MEDIAN, accuracy)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """Most frequent values of a column, ties by name."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(n)


def in_top_municipalities(df: DataFrame, n: int = 50) -> DataFrame:
    """Rows of the ``n`` busiest municipalities; the list has ``n`` rows and is broadcast."""
    top = F.broadcast(top_values(df, "municipio", n).select("municipio"))
    return df.join(top, "municipio", "left_semi")


def municipality_year_stats(ml_rows: DataFrame, n: int = 50, accuracy: int | None = None) -> DataFrame:
    rows = in_top_municipalities(ml_rows, n).where(F.col("departamento").isNotNull() & F.col("year_radica").isNotNull())
    rows = rows.withColumnRenamed("year_radica", "year")
    keys, v = ["municipio", "departamento", "year"], F.col("valor_acto")
    summary = rows.groupBy(*keys).agg(
        F.count(v).alias("transacciones"),
        F.avg(v).alias("valor_medio"),
        F.stddev_samp(v).alias("valor_std"),
        F.count("pk").alias("total_registros"),
    )
    return with_quantiles(summary, rows, keys, "valor_acto", MEDIAN, accuracy)


def property_kind_year_stats(ml_rows: DataFrame, accuracy: int | None = None) -> DataFrame:
    rows = ml_rows.where(F.col("tipo_predio").isNotNull() & F.col("year_radica").isNotNull())
    rows = rows.withColumnRenamed("year_radica", "year")
    keys, v = ["tipo_predio", "year"], F.col("valor_acto")
    summary = rows.groupBy(*keys).agg(
        F.count(v).alias("transacciones"),
        F.avg(v).alias("valor_medio"),
        F.count("pk").alias("total_registros"),
    )
    return with_quantiles(summary, rows, keys, "valor_acto", MEDIAN, accuracy)


def department_summary(classified: DataFrame, as_of_year: int, years: int = 5, accuracy: int | None = None) -> DataFrame:
    """Totals, market rows, errors, warnings and valid-value statistics of recent years."""
    recent = classified.where(F.col("year_radica") >= as_of_year - years)
    valid = F.when(F.col("valor_valido"), F.col("valor_acto"))
    rows = recent.withColumn("__valid", valid)
    summary = rows.groupBy("departamento").agg(
        F.count("*").alias("total_transacciones"),
        F.count_if("es_mercado_valido").alias("transacciones_mercado"),
        F.count_if("valor_valido").alias("transacciones_valor_valido"),
        F.count_if(F.col("calidad_datos") == "ERROR").alias("registros_error"),
        F.count_if(F.col("calidad_datos") == "ADVERTENCIA").alias("registros_advertencia"),
        F.avg("__valid").alias("valor_promedio"),
    )
    return with_quantiles(summary, rows, ["departamento"], "__valid", MEDIAN, accuracy)


def yearly_trend(classified: DataFrame, accuracy: int | None = None) -> DataFrame:
    rows = classified.where(F.col("es_mercado_valido") & F.col("valor_valido"))
    keys = ["departamento", "year_radica"]
    summary = rows.groupBy(*keys).agg(F.count("*").alias("transacciones"), F.avg("valor_acto").alias("valor_promedio"))
    return with_quantiles(summary, rows, keys, "valor_acto", MEDIAN, accuracy)


def error_types(classified: DataFrame) -> DataFrame:
    """Rows and share per error type."""
    wrong = classified.where(F.col("tipo_error").isNotNull())
    counts = wrong.groupBy("tipo_error", "calidad_datos").agg(F.count("*").alias("cantidad"))
    return counts.withColumn("porcentaje", percent(F.col("cantidad"), total_rows(wrong)))


def dashboard_stats(scored: DataFrame, updated: str = "created_at") -> DataFrame:
    score = F.col("anomaly_score")
    return scored.agg(
        F.count("*").alias("total_transactions"),
        F.count_if(F.col("calidad_datos") == "OK").alias("clean_transactions"),
        F.count_if(score > 0.7).alias("high_risk_count"),
        F.count_if(score.between(0.4, 0.7)).alias("suspicious_count"),
        F.avg("valor_acto").alias("avg_transaction_value"),
        F.count_distinct("municipio").alias("municipalities_covered"),
        F.max(updated).alias("last_updated"),
    )


def metric_table(tx: DataFrame, as_of: Column) -> DataFrame:
    """Total, rows per department and mean value per municipality in long form."""
    total = tx.agg(F.count("*").cast("double").alias("metric_value")).withColumn("metric_name", F.lit("total_transactions"))
    by_department = (
        tx.where(F.col("departamento").isNotNull())
        .groupBy("departamento")
        .agg(F.count("*").cast("double").alias("metric_value"))
        .withColumn("metric_name", F.lit("transactions_by_dept"))
    )
    by_municipality = (
        tx.where(F.col("municipio").isNotNull() & F.col("valor_acto").isNotNull())
        .groupBy("municipio")
        .agg(F.avg("valor_acto").alias("metric_value"))
        .withColumn("metric_name", F.lit("avg_transaction_value"))
    )
    parts = total.unionByName(by_department, allowMissingColumns=True)
    parts = parts.unionByName(by_municipality, allowMissingColumns=True)
    return parts.select("metric_name", "metric_value", as_of.alias("metric_date"), "departamento", "municipio")


def act_type_counts(df: DataFrame) -> DataFrame:
    """Rows per act type, one row each, however many types there are."""
    return df.where(F.col("tipo_acto").isNotNull()).groupBy("tipo_acto").agg(F.count("*").alias("n"))


def dataset_statistics(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """One row describing an ingested dataset; ``act_type_counts`` lists its act types."""
    v = F.col("valor_acto")
    base = df.agg(
        F.count("*").alias("total_records"),
        F.min("fecha_acto").alias("date_min"),
        F.max("fecha_acto").alias("date_max"),
        F.avg(v).alias("valor_mean"),
        F.min(v).alias("valor_min"),
        F.max(v).alias("valor_max"),
        F.count_distinct("departamento").alias("departamentos"),
        F.count_distinct("municipio").alias("municipios"),
    )
    return with_quantiles(base, df, [], "valor_acto", {"valor_median": 0.5}, accuracy)


def with_act_types(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """Statistics with the counts of ``act_type_counts`` as a map, which the JSON document needs whole.

    The map holds one entry per type; a data set with unbounded types is described by its rows instead.
    """
    entries = F.array_sort(F.collect_list(F.struct("tipo_acto", "n")))
    return stats.withColumn("tipos_acto", counts.agg(F.map_from_entries(entries).alias("m")).scalar())


def statistics_document(stats: DataFrame) -> DataFrame:
    """Dataset statistics with their act types, nested as in the published JSON document."""
    return stats.select(
        F.col("total_records"),
        F.struct(F.col("date_min").alias("min"), F.col("date_max").alias("max")).alias("date_range"),
        F.struct(
            F.col("valor_mean").alias("mean"), F.col("valor_median").alias("median"),
            F.col("valor_min").alias("min"), F.col("valor_max").alias("max"),
        ).alias("valor_acto"),
        "departamentos", "municipios", "tipos_acto",
    )


def property_totals(scored: DataFrame) -> DataFrame:
    totals = scored.agg(
        F.count_distinct("matricula").alias("total_propiedades"),
        F.count("pk").alias("total_transacciones"),
        F.count_if("is_anomaly").alias("transacciones_anomalas"),
    )
    return totals.withColumns({
        "tasa_anomalias_global": percent(F.col("transacciones_anomalas"), F.col("total_transacciones")),
        "promedio_tx_por_propiedad": F.try_divide(F.col("total_transacciones"), F.col("total_propiedades")),
    })


def score_coverage(scored: DataFrame) -> DataFrame:
    counts = scored.agg(F.count("*").alias("total"), F.count("anomaly_score").alias("con_scores"))
    return counts.withColumn("coverage_pct", percent(F.col("con_scores"), F.col("total")))


def value_statistics(df: DataFrame, column: str = "valor_acto", accuracy: int | None = None) -> DataFrame:
    """Rows with and without a value, range, mean, median and deviation."""
    v = F.col(column)
    summary = df.agg(
        F.count("*").alias("total"),
        F.count(v).alias("con_valor"),
        F.count_if(v.isNull()).alias("sin_valor"),
        F.min(v).alias("minimo"),
        F.max(v).alias("maximo"),
        F.avg(v).alias("media"),
        F.stddev_samp(v).alias("desviacion"),
    )
    return with_quantiles(summary, df, [], column, {"mediana": 0.5}, accuracy)


def batch_summary(analysed: DataFrame) -> DataFrame:
    label = F.col("classification")
    return analysed.agg(
        F.count("*").alias("total_transactions"),
        F.count_if(label == "normal").alias("normal_count"),
        F.count_if(label == "suspicious").alias("suspicious_count"),
        F.count_if(label == "high-risk").alias("high_risk_count"),
        F.coalesce(F.avg("anomaly_score"), F.lit(0.0)).alias("average_score"),
    )


def run_report(classified: DataFrame) -> DataFrame:
    """Rows in, kept for training, discarded, wrong and suspicious, and the yield."""
    quality = F.col("calidad_datos")
    kept = F.col("es_mercado_valido") & F.col("valor_valido") & (quality == "OK")
    counts = classified.agg(
        F.count("*").alias("registros_entrada"),
        F.count_if(kept).alias("registros_salida"),
        F.count_if(~kept).alias("registros_descartados"),
        F.count_if(quality == "ERROR").alias("registros_con_errores"),
        F.count_if(quality == "ADVERTENCIA").alias("registros_sospechosos"),
    )
    return counts.withColumn("tasa_aprovechamiento", percent(F.col("registros_salida"), F.col("registros_entrada")))


def shares(df: DataFrame, columns: list[str], count: str = "n", share: str = "porcentaje") -> DataFrame:
    """Rows and share of all rows per combination of values."""
    counts = df.groupBy(*columns).agg(F.count("*").alias(count))
    return counts.withColumn(share, percent(F.col(count), total_rows(df)))


def frequency_table(df: DataFrame, column: str, n: int) -> DataFrame:
    """Most frequent values with their share of all rows."""
    return top_values(df, column, n).withColumn("porcentaje", percent(F.col("n"), total_rows(df)))


def with_municipal_average(scored: DataFrame, metrics: DataFrame, as_of: Column) -> DataFrame:
    """Attach the municipal mean value of one day; rows without a match keep NULL."""
    chosen = metrics.where((F.col("metric_name") == "avg_transaction_value") & (F.col("metric_date") == as_of))
    chosen = chosen.where(F.col("municipio").isNotNull()).select("municipio", F.col("metric_value").alias("municipal_avg_value"))
    return attach_lookup(scored, chosen, ["municipio"])


def high_risk_listing(flagged: DataFrame, metrics: DataFrame, as_of: Column) -> DataFrame:
    """Scores above 0.7 or any flag, with the municipal average, highest score first."""
    risky = flagged.where(
        (F.col("anomaly_score") > 0.7) | F.col("flag_actividad_excesiva") | F.col("flag_geo_discrepancia")
    )
    return with_municipal_average(risky, metrics, as_of).orderBy(F.desc_nulls_last("anomaly_score"), "pk")
