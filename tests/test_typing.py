"""Typing of registry text: odd numbers, and generated code that the JVM still compiles."""

import re

import pytest

from folioscope.functions import values as V
from folioscope.operators.cleaning import clean_registry
from folioscope.operators.quality import classify
from folioscope.sources.tpch_registry import RAW_REGISTRY

TEXTS = {
    "12": (12.0, 12), " 12\n": (12.0, 12), "-3.0": (-3.0, -3), "1e3": (1000.0, 1000), ".5": (0.5, None), "7.": (7.0, 7), "1e999": (None, None),
    "-1e999": (None, None), "12d": (None, None), "nan": (None, None), "Infinity": (None, None), "": (None, None), " ": (None, None), "1 2": (None, None),
    "12\u0085": (None, None), "12 ": (None, None), "0x1F": (None, None), "2147483648": (2147483648.0, None), "-2147483648": (-2147483648.0, None), None: (None, None),
}


def registry(spark, texts):
    columns = re.findall(r"AS (\w+)(?:,|\nFROM)", RAW_REGISTRY)
    rows = [(str(i), *[t] * (len(columns) - 1)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def test_numbers_of_odd_texts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", V.number_or_null(V.F.col("t")).alias("n"), V.whole_or_null(V.F.col("t")).alias("w"))
    assert {r.t: (r.n, r.w) for r in rows.collect()} == TEXTS
    typed = clean_registry(registry(spark, TEXTS)).select("pk", "valor_acto", "year_radica", "orip").collect()
    for r in typed:
        number, integer = list(TEXTS.values())[int(r.pk)]
        assert (r.valor_acto, r.year_radica) == (number, integer)
        assert r.orip == (number if number is not None and 1 <= number <= 999 else None)


@pytest.mark.parametrize("build", [clean_registry, lambda r: classify(clean_registry(r)).sortWithinPartitions("calidad_datos")])
def test_typing_is_compiled(spark, tmp_path, build):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter, which takes several times as long."""
    registry(spark, TEXTS).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    code = spark._jvm.PythonSQLUtils.explainString(build(raw.withColumn("valor_texto", raw["valor"]))._jdf.queryExecution(), "codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
