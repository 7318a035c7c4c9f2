"""Numbers are not typed through their text."""

import pytest

from folioscope.operators.cleaning import type_columns


@pytest.mark.parametrize("kind", ["double", "long", "int"])
def test_numbers_are_typed_without_their_text(spark, kind):
    values = [1.0, 999.0, 1000.0, 0.0, -3.0, 2.0**31 - 1, None]
    if kind == "double":
        values += [2.5, -0.0, 1e300, float("nan"), float("inf"), -float("inf")]
    else:
        values = [v if v is None else int(v) for v in values]
    rows = spark.createDataFrame([(i, v, v, v) for i, v in enumerate(values)], f"i int, orip {kind}, year_radica {kind}, valor_acto {kind}")
    typed = type_columns(rows)
    assert "regexp_extract" not in typed._jdf.queryExecution().optimizedPlan().toString()
    as_text = type_columns(rows.selectExpr("i", *[f"cast({c} AS string) AS {c}" for c in rows.columns[1:]]))
    assert sorted(map(str, typed.collect())) == sorted(map(str, as_text.collect()))
