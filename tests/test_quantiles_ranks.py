"""Quantiles and positions where values crowd into few buckets, groups or prefixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import features
from folioscope.plans import quantiles, ranks

PROBS = {"q0": 0.0, "q1": 0.01, "q2": 0.25, "q3": 0.5, "q4": 0.9, "q5": 1.0}


def crowded():
    rng = np.random.default_rng(4)
    return {
        "narrow": 1e9 + rng.random(4000) * 1e6,
        "tiny": rng.random(4000) * 1e-3,
        "ties": np.r_[np.full(3000, 0.25), 0.25 + rng.random(1000) * 1e-9],
        "steep": 1e-3 * 10.0 ** -(rng.random(3000) * 40),
        "wide": rng.choice([-1.7e308, 1.7e308, 0.0, 1.0], 2000) * rng.random(2000),
        "one": np.full(500, 7.5),
    }


@pytest.mark.parametrize("targets", [200_000, 0])
def test_buckets_are_refined(spark, monkeypatch, targets):
    monkeypatch.setattr(quantiles, "WINDOW_ROWS", 40)
    monkeypatch.setattr(quantiles, "CUTS", 16)
    values = crowded()
    rows = [(g, float(v)) for g, held in values.items() for v in held] + [(None, 3.0), (None, 5.0), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    found = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", PROBS, targets).collect()}
    assert set(found) == {*values, None}
    for g, held in values.items():
        with np.errstate(over="ignore"):
            np.testing.assert_allclose([found[g][n] for n in PROBS], np.quantile(held / 4, list(PROBS.values())) * 4, rtol=1e-12)
    assert found[None].q3 == 4.0


@pytest.mark.parametrize("low,high", [(1e9, 1.001e9), (0.0, 0.001)])
def test_no_window_sorts_more_than_its_share(spark, monkeypatch, low, high):
    """The last pass meets as many distinct values for a rank as stated, of 200,000 in one or two buckets."""
    monkeypatch.setattr(quantiles, "WINDOW_ROWS", 1000)
    seen = []
    real = quantiles.is_small

    def counting(lookup, most):
        kept, small = real(lookup, most)
        seen.append(kept.agg(F.max("__n")).first()[0])
        return kept, small

    monkeypatch.setattr(quantiles, "is_small", counting)
    df = spark.range(200_000).select((low + (high - low) * F.col("id") / 199_999).alias("v"))
    found = quantiles.exact_quantiles(df, [], "v", {"a": 0.1, "b": 0.95}).first()
    assert found.a == pytest.approx(low + (high - low) * 0.1, rel=1e-12) and found.b == pytest.approx(low + (high - low) * 0.95, rel=1e-12)
    assert seen[0] > 50_000 and seen[-1] <= 1000


def test_positions(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 40, 300)] + [("c", 1.0), ("c", None)]
    found = ranks.value_positions(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v").collect()
    held = {}
    for g, v in rows:
        if v is not None:
            held.setdefault(g, []).append(v)
    expected = {(g, v, vs.count(v), sum(x < v for x in vs), len(vs)) for g, vs in held.items() for v in vs}
    assert {(r.g, r.v, r.copies, r.below, r.size) for r in found} == expected and len(found) == len(expected)


def test_codes_of_values_with_one_prefix(spark):
    """A million values that agree in twenty characters: no task holds more than a few times its share."""
    values = spark.range(1_000_000).select(F.concat(F.lit("x" * 20), F.lpad(F.col("id").cast("string"), 7, "0")).alias("c"))
    codes = features.fit_codes(values, "c")
    wrong = codes.where(F.col("code") != F.substring("c", 21, 7).cast("int")).count()
    assert wrong == 0 and codes.count() == 1_000_000
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = values.repartitionByRange(parts, "c").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in shares) < 3 * 1_000_000 / parts
