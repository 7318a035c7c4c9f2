"""Parsing, classification and rule edges on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscope.functions import values as V
from folioscope.operators import activity, cleaning, features, profiling, property, quality, retrieval, risk, scoring
from folioscope.operators.pricing import price_verdict
from folioscope import constants as K


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,number", [
    ("12", 12.0), (" 12 ", 12.0), ("1,234,567", 1234567.0), ("1e5", 100000.0), (".5", 0.5), ("-3", -3.0),
    ("12d", None), ("12f", None), ("inf", None), ("nan", None), ("", None), ("1e400", None), ("SIN VALOR", None), (None, None),
])
def test_money(spark, text, number):
    assert one(spark, text, "string", V.money_or_null) == number


@pytest.mark.parametrize("text,number", [("2015", 2015), ("2015.0", 2015), ("2015.5", None), ("N/D", None), ("99999999999", None)])
def test_whole(spark, text, number):
    assert one(spark, text, "string", V.whole_or_null) == number


def test_dates(spark):
    assert one(spark, "31/02/2024", "string", V.day_or_null) is None
    assert one(spark, "29/02/2024", "string", V.day_or_null) == dt.date(2024, 2, 29)


def test_text(spark):
    assert one(spark, "\t bogotá \n", "string", V.category_or_null) == "BOGOTÁ"
    assert one(spark, "none", "string", V.category_or_null) is None
    assert one(spark, " nan ", "string", V.text_or_null) is None
    assert one(spark, "a-b  c\n d!", "string", V.sanitised) == "AB C D"


@pytest.mark.parametrize("folio,valid", [("50C-1234567", True), ("50c-1", True), ("50C1234567", False), ("-12", False), (None, False)])
def test_folio(spark, folio, valid):
    assert one(spark, folio, "string", V.is_folio_number) is valid


TX = ("pk string, valor_acto double, dinamica_inmobiliaria int, departamento string, municipio string, year_radica int, "
      "nombre_natujur string, tipo_predio string")


@pytest.mark.parametrize("row,expected", [
    # Overlapping rules: the earlier one decides.
    ((1e10 + 1, None, None, None, 1990, "VENTA", None), ("ERROR", K.EXTREME_VALUE, False)),
    ((1e10, 1, "A", "B", 2010, "VENTA", "URBANO"), ("OK", None, True)),
    ((1e6, 1, "A", "B", 2010, "VENTA", "URBANO"), ("OK", None, True)),
    ((None, 1, None, "B", 1990, "VENTA", None), ("ERROR", K.MARKET_WITHOUT_VALUE, False)),
    ((0.0, 1, "A", "B", 2010, "VENTA", "URBANO"), ("ERROR", K.MARKET_WITHOUT_VALUE, False)),
    ((0.0, 0, "A", "B", 2010, "VENTA", "URBANO"), ("OK", None, False)),
    ((5e6, None, None, "B", 1990, "X", None), ("ERROR", K.BAD_GEOGRAPHY, False)),
    ((5e6, None, "A", "B", 1999, "X", None), ("ERROR", K.BAD_YEAR, False)),
    ((5e6, None, "A", "B", 2026, "X", None), ("ERROR", K.BAD_YEAR, False)),
    ((5e6, 1, "A", "B", 2000, "X", "RURAL"), ("OK", None, True)),
    ((5e6, 1, "A", "B", 2025, "X", "RURAL"), ("OK", None, True)),
    ((5e6, 1, "A", "B", None, "X", "RURAL"), ("OK", None, True)),
    ((5e6, None, "A", "B", None, "X", None), ("ERROR", K.BAD_MARKET_FLAG, False)),
    ((999_999.0, 0, "A", "B", 2010, "compraventa", None), ("WARN", K.TINY_VALUE, False)),
    ((999_999.0, 0, "A", "B", 2010, "DONACION", "MIXTO"), ("OK", None, False)),
    ((5e6, 0, "A", "B", 2010, "X", None), ("WARN", K.BAD_PROPERTY_KIND, False)),
    ((5e6, 0, "A", "B", 2010, None, "OTRO"), ("WARN", K.BAD_PROPERTY_KIND, False)),
    ((-5.0, 1, "A", "B", 2010, "VENTA", "URBANO"), ("OK", None, False)),
])
def test_quality(spark, row, expected):
    found = quality.classify(spark.createDataFrame([("p", *row)], TX)).first()
    label = K.WARNING if expected[0] == "WARN" else expected[0]
    assert (found.calidad_datos, found.tipo_error, found.valor_valido) == (label, *expected[1:])


def test_splits_cover_everything(spark):
    rows = quality.classify(spark.createDataFrame([
        ("a", 5e6, 1, "A", "B", 2010, "VENTA", "URBANO"), ("b", None, 1, "A", "B", 2010, "VENTA", "URBANO"),
        ("c", 5e6, 0, "A", "B", 2010, "VENTA", None)], TX))
    sizes = {n: quality.dataset(rows, n).count() for n in quality.dataset_filters()}
    assert sizes["limpio"] + sizes["errores"] + sizes["advertencias"] == sizes["completo"] == 3
    assert sizes["ml_training"] == 1


def test_missing_keys_count_zero(spark):
    rows = spark.createDataFrame([("1", "m", 2010), ("2", "m", 2010), ("3", None, 2010), ("4", "m", None)], "pk string, matricula string, year_radica int")
    found = {r.pk: r.anotaciones_por_anio for r in activity.with_yearly_annotations(rows).collect()}
    assert found == {"1": 2, "2": 2, "3": 0, "4": 0}


def test_mode_ties_and_empty_groups(spark):
    rows = spark.createDataFrame([(1.0, "B"), (1.0, "A"), (2.0, None), (3.0, "Z"), (3.0, None), (3.0, None), (None, "Q")], "orip double, d string")
    found = {r.orip: r.m for r in activity.most_frequent(rows, "orip", "d", "m").collect()}
    assert found == {1.0: "A", 2.0: None, 3.0: "Z"}


def test_right_closed_bins(spark):
    rows = spark.createDataFrame([(1e6,), (1e6 + 1,), (1e7,), (1e10,), (1e10 + 1,)], "v double")

    def label(lowest):
        return [r[0] for r in rows.select(profiling.bin_label(F.col("v"), K.VALUE_EDGES_6, K.VALUE_LABELS_6, lowest)).collect()]

    assert label(False) == [None, "1M-10M", "1M-10M", "1B-10B", None]
    assert label(True)[0] == "1M-10M"


@pytest.mark.parametrize("score,plain,threshold", [(0.39, "normal", "normal"), (0.4, "suspicious", "normal"), (0.42, "suspicious", "suspicious"),
                                                   (0.5, "suspicious", "suspicious"), (0.7, "high-risk", "high-risk")])
def test_risk_limits(spark, score, plain, threshold):
    row = spark.createDataFrame([(score,)], "s double").select(risk.risk_label(F.col("s")), risk.risk_label_by_threshold(F.col("s"))).first()
    assert tuple(row) == (plain, threshold)


@pytest.mark.parametrize("deviation,label", [(14.99, "normal"), (15.0, "precaucion"), (29.99, "precaucion"), (30.0, "sospechoso")])
def test_verdict_limits(spark, deviation, label):
    row = spark.createDataFrame([(deviation, 1.0, 2.0)], "d double, a double, p double")
    found = row.select(*[c.alias(n) for n, c in price_verdict(F.col("d"), F.col("a"), F.col("p")).items()]).first()
    assert found.clasificacion == label
    assert len(found.recomendaciones) == {"normal": 0, "precaucion": 3, "sospechoso": 5}[label]


@pytest.mark.parametrize("n,alerts", [(1, 0), (5, 0), (6, 1), (10, 1), (11, 1), (21, 1)])
def test_history_alert(spark, n, alerts):
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("pk"), F.lit("m").alias("matricula"), F.lit(None).cast("date").alias("fecha_radicacion"),
        F.lit(1e8).alias("valor_acto"), F.lit("A").alias("departamento"), F.lit("B").alias("municipio"))
    found = property.property_summary(rows).first()
    assert sum(K.ALERT_HISTORY in a for a in found.alertas) == alerts
    assert found.score_riesgo == pytest.approx(0.0 if n <= 10 else round(0.3 * min(n / 20, 1), 3))


def test_scaler_constant_feature(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    found = scoring.apply_scaler(rows, scoring.fit_scaler(rows, ["a", "b"])).orderBy("a").collect()
    assert [tuple(r) for r in found] == [(-1.0, 0.0), (1.0, 0.0)]
    importance = {r.feature: r.importance for r in scoring.feature_importance(rows, ["a", "b"], "a").collect()}
    assert importance["a"] == pytest.approx(1.0) and importance["b"] is None


def test_codes(spark):
    fitted = features.fit_codes(spark.createDataFrame([("b",), ("a",), ("á",), ("Z",), ("a",)], "c string"), "c")
    assert {r.c: r.code for r in fitted.collect()} == {"Z": 0, "a": 1, "b": 2, "á": 3}
    other = features.apply_codes(spark.createDataFrame([("a",), ("new",), (None,)], "c string"), fitted, "c")
    assert sorted(r.c_encoded for r in other.collect()) == [-1, -1, 1]


def test_source_excerpt(spark):
    rows = spark.createDataFrame([("x" * 200, 0.5), ("x" * 201, 0.5)], "document string, distance double")
    assert [len(r.content) for r in retrieval.sources(rows).collect()] == [200, 203]


def test_confidence_without_results(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    found = spark.createDataFrame([(1, 1.0), (1, 0.0)], "query_id int, distance double")
    assert {r.query_id: r.confianza for r in retrieval.confidence(found, queries).collect()} == {1: 0.75, 2: 0.0}


def test_transaction_id_placeholders(spark):
    row = spark.createDataFrame([(None, " 7 ", None, "x", None)], "divipola string, matricula string, num_anotacion string, cod_natujur string, year_radica string")
    assert cleaning.with_transaction_id(row).first().transaction_id == "UNK_7_0_x_0"


def test_missing_columns_are_optional(spark):
    row = spark.createDataFrame([("t", None, 5e7, "URBANO", "152")], "transaction_id string, fecha_radicacion date, valor_acto double, tipo_predio string, cod_natujur string")
    found = features.transaction_features(row).first()
    assert (found.anotaciones_por_anio, found.log_anotaciones, found.tiene_valor, found.cod_naturaleza_grupo, found.year) == (1, 0.0, 1, 1, 0)


def test_year_and_class_stand_in_for_date_and_zone(spark):
    rows = [("a", 2016, "1"), ("b", None, "2.0"), ("c", 2014, None), ("d", 2015, "CATEGORIA 3"), ("e", 2015, "CATEGORIA 13"), ("f", 2015, "01 "), ("g", 2015, "")]
    df = spark.createDataFrame(rows, "transaction_id string, year_radica int, categoria_ruralidad string")
    df = df.withColumn("valor_acto", F.lit(None).cast("double")).withColumn("cod_natujur", F.lit(None).cast("string"))
    found = {r.transaction_id: r for r in features.transaction_features(df).collect()}
    assert all(len(r) == 1 + len(features.TRANSACTION_FEATURES) and None not in tuple(r) for r in found.values())
    assert {k: (r.es_urbano, r.es_rural, r.sin_zona) for k, r in found.items()} == {
        "a": (1, 0, 0), "b": (0, 1, 0), "c": (0, 0, 1), "d": (0, 1, 0), "e": (0, 0, 0), "f": (1, 0, 0), "g": (0, 0, 0)}
    assert [(r.year, r.month, r.days_since_2015) for r in (found["a"], found["b"], found["c"])] == [(2016, 6, 365), (0, 6, 0), (2014, 6, -365)]
    bare = features.transaction_features(df.drop("year_radica", "categoria_ruralidad")).first()
    assert (bare.year, bare.month, bare.sin_zona, bare.es_urbano) == (0, 0, 1, 0)
