"""Profiles of whole tables: every type of value, NULLs, repeats, hot values, names and the plan."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioscope.operators import profiling, statistics

SCHEMA = """txt string, num double, real float, raw binary, day date, at timestamp, naive timestamp_ntz, yes boolean, big decimal(38,2),
    list array<double>, nested struct<a: int, b: timestamp>, `a.b` int, c int, columna string, valor string, n long"""
AT = dt.datetime(2024, 5, 1, 10, 0, 0, 1)
ROWS = [
    ("a", 0.0, 0.0, b"\xff", dt.date(2024, 1, 1), AT, AT, True, Decimal(1), [1.0, None], (1, AT), 1, 1, "x", "x", 1),
    ("a", -0.0, -0.0, b"\xfe", dt.date(2024, 1, 2), AT.replace(microsecond=2), AT.replace(microsecond=2), False, Decimal(2), [1.0], (None, AT.replace(microsecond=2)), 1, 2, "y", "x", 2),
    ("", float("nan"), 1.5, b"", None, AT, AT, None, None, [], (1, None), 2, 3, None, None, 2**60),
    (None, float("nan"), None, None, dt.date(2024, 1, 1), None, None, True, Decimal(1), None, None, None, 4, "x", "z", 2**60 + 1),
    ("A", None, float("inf"), b"\xff", None, AT, None, None, Decimal(1), [1.0, None], (1, AT), 1, 5, "x", "z", None),
]


def plain(df):
    return {r.columna: (r.tipo, r.nulos, r.nulos_pct, r.unicos) for r in df.collect()}


@pytest.mark.parametrize("copies", [1, 40])
def test_all_types_against_separate_counts(spark, copies):
    df = spark.createDataFrame(ROWS * copies, SCHEMA).repartition(5)
    found = plain(profiling.column_profile(df))
    assert len(found) == len(df.columns)
    for i, (name, kind) in enumerate(df.dtypes):
        c = profiling.column_of(df, i)
        nulls, distinct = df.agg(F.count_if(c.isNull()), F.count_distinct(c)).first()
        assert found[name] == (kind, nulls, nulls * 100 / (5 * copies), distinct), name


def test_sketches_count_few_values_exactly(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).select("txt", "`a.b`", "c", "columna", "n")
    assert plain(profiling.column_profile(df, approximate=True)) == plain(profiling.column_profile(df))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for approximate in (False, True):
        found = plain(profiling.column_profile(empty, approximate))
        assert len(found) == 16 and set((v[1:]) for v in found.values()) == {(0, None, 0)}


def test_values_are_combined_before_one_shuffle(spark):
    """No copy of a whole row per column, and a hot value is one row per task."""
    wide = spark.range(60_000).select(*[F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias(f"v{i}") for i in range(12)])
    counts = profiling.stacked_counts(wide)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan and "partial_count" in plan
    assert counts.where("valor = 'hot'").agg(F.count("*"), F.min("n"), F.max("n")).first() == (12, 40_000, 40_000)
    assert {r.unicos for r in profiling.column_profile(wide).collect()} == {20_001}


def test_many_act_types_are_rows(spark):
    acts = spark.range(50_000).select(
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("tipo "), (F.col("id") % 20_000).cast("string"))).alias("tipo_acto"))
    counts = statistics.act_type_counts(acts)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "map_from" not in plan
    assert counts.count() == 16_000 and counts.agg(F.sum("n")).first()[0] == 40_000
    assert statistics.act_type_counts(acts.limit(0)).count() == 0
