"""The market comparison parses its texts once."""

from folioscope.operators.profiling import market_comparison


def test_market_texts_are_parsed_once(spark):
    texts = ["1,000,000", "0", None, "x", "nan", "2500000", " 3000000 ", "1e999"]
    rows = spark.createDataFrame([(i % 2 if i < 14 else None, t) for i, t in enumerate(texts * 2)], "dinamica_inmobiliaria int, valor_texto string")
    found = market_comparison(rows)
    assert "regexp_extract" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.dinamica_inmobiliaria: (r.total, r.con_texto, r.numericos, r.ceros, r.positivos, r.validos, r.mediana_positivos) for r in found.collect()}
    assert got == {0: (7, 5, 3, 0, 3, 3, 1000000.0), 1: (7, 7, 4, 2, 2, 2, 2500000.0)}
