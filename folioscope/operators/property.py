"""Risk report per property: history, prices, location, alerts and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import values as V
from folioscope.operators.risk import outside_usual_value
from folioscope.plans.joins import attach_lookup
from folioscope.plans.ranks import row_positions

# A history page holds about this many transactions; a property with more gets further pages.
PAGE_ROWS = 100_000

NEWEST = ["fecha_radicacion", "pk"]


def positive_value() -> Column:
    return F.when(F.col("valor_acto") > 0, F.col("valor_acto"))


def order_key() -> Column:
    day = F.coalesce(F.col("fecha_radicacion"), F.lit("1900-01-01").cast("date"))
    return F.struct(day.alias("day"), F.col("pk").alias("pk"))


def latest_price() -> Column:
    """Newest value above zero, by date and then key."""
    return F.max_by(F.col("valor_acto"), F.when(F.col("valor_acto") > 0, order_key()))


def place() -> Column:
    return F.struct(F.col("departamento"), F.coalesce("municipio", F.lit("N/A")).alias("municipio"))


def first_place() -> Column:
    return F.min_by(place(), order_key())


def newest_place() -> Column:
    """Place of the newest row whose department is known."""
    return F.max_by(place(), F.when(F.col("departamento").isNotNull(), order_key()))


def price_variation() -> Column:
    """Population deviation over mean of the positive values, 0 with fewer than two."""
    v = positive_value()
    return F.when(F.count(v) > 1, F.try_divide(F.stddev_pop(v), F.avg(v))).otherwise(F.lit(0.0))


def property_score(n: Column, rate: Column, variation: Column) -> Column:
    frequent = F.when(n > 10, F.least(n / 20, F.lit(1.0))).otherwise(F.lit(0.0))
    score = 0.4 * F.least(rate / 50, F.lit(1.0)) + 0.3 * F.least(variation, F.lit(1.0)) + 0.3 * frequent
    return F.bround(score, 3)


def alerts(n: Column, rate: Column, score: Column, low: Column, high: Column, positives: Column) -> Column:
    found = V.messages(
        (rate > 30, F.concat(F.lit(K.ALERT_RATE), F.format_number(rate, 1), F.lit("%)"))),
        (score > 0.7, F.lit(K.ALERT_SCORE_HIGH)),
        ((score > 0.4) & (score <= 0.7), F.lit(K.ALERT_SCORE_MEDIUM)),
        (n > 5, F.concat(F.lit(K.ALERT_HISTORY), n.cast("string"), F.lit(" transacciones registradas)"))),
        ((positives > 1) & (high > low * 3), F.lit(K.ALERT_SPREAD)),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(K.ALERT_NONE)))


def stored_alerts(n: Column, rate: Column, score: Column, mean: Column) -> Column:
    found = V.messages(
        (rate > 50, F.lit(K.STORED_RATE_HIGH)),
        ((rate > 25) & (rate <= 50), F.lit(K.STORED_RATE_MEDIUM)),
        (score >= 0.7, F.lit(K.STORED_SCORE_HIGH)),
        ((score >= 0.4) & (score < 0.7), F.lit(K.STORED_SCORE_MEDIUM)),
        (n == 1, F.lit(K.STORED_SINGLE)),
        (mean < 1_000_000, F.lit(K.STORED_LOW_PRICES)),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(K.STORED_NONE)))


def property_summary(tx: DataFrame) -> DataFrame:
    """Heuristic report without history: one row per property, combined map-side."""
    v = F.col("valor_acto")
    grouped = tx.where(F.col("matricula").isNotNull()).groupBy("matricula").agg(
        F.count("*").alias("total_transacciones"),
        F.count_if(outside_usual_value()).alias("anomalias"),
        F.avg(v).alias("precio_promedio"),
        latest_price().alias("precio_ultima"),
        first_place().alias("ubicacion"),
        price_variation().alias("__variation"),
        F.min(positive_value()).alias("__low"),
        F.max(positive_value()).alias("__high"),
        F.count(positive_value()).alias("__positives"),
    )
    rate = F.col("anomalias") / F.col("total_transacciones") * 100
    scored = grouped.withColumn("tasa_anomalias", rate)
    scored = scored.withColumn(
        "score_riesgo", property_score(F.col("total_transacciones"), F.col("tasa_anomalias"), F.col("__variation"))
    )
    found = alerts(
        F.col("total_transacciones"), F.col("tasa_anomalias"), F.col("score_riesgo"),
        F.col("__low"), F.col("__high"), F.col("__positives"),
    )
    return scored.withColumn("alertas", found).drop("__variation", "__low", "__high", "__positives")


def stored_property_summary(scored: DataFrame) -> DataFrame:
    """Report from stored scores: values above zero only, mean stored score as risk."""
    grouped = scored.where(F.col("matricula").isNotNull()).groupBy("matricula").agg(
        F.count("*").alias("total_transacciones"),
        F.count_if("is_anomaly").alias("anomalias"),
        F.avg(positive_value()).alias("precio_promedio"),
        latest_price().alias("precio_ultima"),
        newest_place().alias("ubicacion"),
        # Rounded, so that a score on a limit does not depend on the order of the sum.
        F.round(F.sum(F.coalesce("anomaly_score", F.lit(0.0))) / F.count("*"), 6).alias("score_riesgo"),
    )
    rated = grouped.withColumn("tasa_anomalias", F.col("anomalias") / F.col("total_transacciones") * 100)
    found = stored_alerts(
        F.col("total_transacciones"), F.col("tasa_anomalias"), F.col("score_riesgo"), F.col("precio_promedio")
    )
    return rated.withColumn("alertas", found)


def history_entry(anomalous: Column, also: tuple[str, ...] = ()) -> Column:
    """Sortable history record; the key breaks ties of the date."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("N/A")).alias(name)

    return F.struct(
        F.col("fecha_radicacion").alias("fecha"),
        F.col("pk"),
        F.coalesce("nombre_natujur", F.lit("N/A")).alias("tipo_acto"),
        F.coalesce("valor_acto", F.lit(0.0)).alias("valor"),
        text("departamento"),
        text("municipio"),
        text("tipo_predio"),
        (V.as_int(F.col("count_a")) + V.as_int(F.col("count_de"))).alias("count_intervinientes"),
        anomalous.alias("es_anomalo"),
        *[F.col(c) for c in also],
    )


def property_history(tx: DataFrame, anomalous: Column, page_rows: int = PAGE_ROWS, also: tuple[str, ...] = ()) -> DataFrame:
    """History per property in pages of ``page_rows``, newest first: page 0 holds the newest.

    Pages are cut by the rank in (date, key) order, so they follow on from one another, and each is sorted.
    Properties of more than one page are ranked by a sort over the whole cluster; no row ever has to
    hold an unbounded list and no transaction is left out. ``also`` names columns that entries carry
    besides the usual ones.
    """
    entry = history_entry(anomalous, also)
    known = tx.where(F.col("matricula").isNotNull()).select("matricula", entry.alias("h"))
    # At most one row for ``page_rows`` transactions.
    large = known.groupBy("matricula").agg(F.count("*").alias("__n")).where(F.col("__n") > page_rows)
    pages = F.ceil(F.col("__n") / page_rows).cast("int")
    sized = attach_lookup(known, large.withColumn("paginas", pages).drop("__n"), ["matricula"])
    entries = F.sort_array(F.collect_list("h"), asc=False).alias("historial")
    single = sized.where(F.col("paginas").isNull()).groupBy("matricula").agg(entries)
    history = single.select("matricula", F.lit(0).alias("pagina"), F.lit(1).alias("paginas"), "historial")
    if large.isEmpty():
        return history
    many = row_positions(sized.where(F.col("paginas").isNotNull()), ["matricula"], [F.col("h").desc_nulls_last()], "__rank")
    many = many.withColumn("pagina", F.floor(F.col("__rank") / page_rows).cast("int")).groupBy("matricula", "pagina", "paginas").agg(entries)
    return history.unionByName(many)


def with_newest_page(summary: DataFrame, history: DataFrame) -> DataFrame:
    """One report per property, with its newest page; ``paginas`` tells how many the history has."""
    newest = history.where(F.col("pagina") == 0).drop("pagina")
    return summary.join(newest, "matricula").withColumn("encontrada", F.lit(True))


def property_report(tx: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Heuristic report with the newest page of its history, one row for every property."""
    return with_newest_page(property_summary(tx), property_history(tx, outside_usual_value(), page_rows))


def stored_property_report(scored: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Report from stored scores, one row for every property; entries carry their ``anomaly_score``."""
    return with_newest_page(stored_property_summary(scored), property_history(scored, V.truth(F.col("is_anomaly")), page_rows, ("anomaly_score",)))
