"""Scaling, score algebra, evaluation and stored scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import values as V
from folioscope.operators.risk import risk_label
from folioscope.operators.statistics import percent, shares
from folioscope.plans.quantiles import exact_quantiles
from folioscope.sources.writers import update_by_key


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation per feature, one row each; a deviation of zero counts as 1."""
    aggregates = [f(F.col(c)).alias(f"{c}__{n}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    wide = df.agg(*aggregates)
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"{c}__m").alias("mean"),
            F.when(F.col(f"{c}__s") == 0, 1.0).otherwise(F.col(f"{c}__s")).alias("std"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*entries)))


def apply_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Standardise the fitted features; the scaler has one row per feature."""
    fitted = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def clipped_score(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> Column:
    """Score clipped to two exact quantiles and stretched to 0-1; 0 when they coincide."""
    bounds = exact_quantiles(df, [], column, {"lo": low, "hi": high}).select(F.struct("lo", "hi").alias("b")).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    clipped = F.greatest(F.least(F.col(column), hi), lo)
    return F.when(hi > lo, (clipped - lo) / (hi - lo)).otherwise(F.lit(0.0))


def inverted_score(df: DataFrame, column: str) -> Column:
    """Min-max over the whole table, inverted: the lowest raw score becomes 1."""
    c = F.col(column)
    bounds = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("b")).scalar()
    return 1 - F.coalesce(F.try_divide(c - bounds["lo"], bounds["hi"] - bounds["lo"]), F.lit(0.0))


def weighted(*terms: tuple[float, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in terms])


def squashed(raw: Column) -> Column:
    """Logistic squash of a raw decision value; 0.5 without a model."""
    return F.coalesce(1 / (1 + F.exp(raw)), F.lit(0.5))


def combined_flags(first: Column, second: Column) -> dict[str, Column]:
    """Confirmed by both detectors, candidate of at least one."""
    return {"confirmada": first & second, "candidata": first | second}


def evaluation(df: DataFrame, truth: Column, score: Column, cut: float = 0.5) -> DataFrame:
    """Confusion counts and the ratios of the positive class, from one aggregate."""
    predicted = score >= cut
    counts = df.agg(
        F.count_if(~truth & ~predicted).alias("tn"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
        F.count_if(truth & predicted).alias("tp"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
    })


def feature_importance(df: DataFrame, features: list[str], score: str) -> DataFrame:
    """Absolute correlation of every feature with the score; constant features have none."""
    aggregates = []
    for f in features:
        c = F.col(f).cast("double")
        aggregates.append(F.covar_pop(c, F.col(score)).alias(f"{f}__c"))
        aggregates.append(F.stddev_pop(F.when(F.col(score).isNotNull(), c)).alias(f"{f}__s"))
    wide = df.agg(*aggregates, F.stddev_pop(score).alias("__s"))
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            F.abs(F.try_divide(F.col(f"{f}__c"), F.col(f"{f}__s") * F.col("__s"))).alias("importance"),
        )
        for f in features
    ]
    return wide.select(F.inline(F.array(*entries)))


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.desc_nulls_last("importance"), "feature").limit(n)


def regression_metrics(df: DataFrame, actual: Column, predicted: Column, group: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R2 from one aggregate."""
    error = predicted - actual
    sums = df.groupBy(*(group or [])).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error * error).alias("__mse"),
        F.var_pop(actual).alias("__var"),
    )
    return sums.withColumn("r2", 1 - F.try_divide(F.col("__mse"), F.col("__var"))).drop("__mse", "__var")


def class_shares(df: DataFrame, label: str) -> DataFrame:
    return shares(df, [label])


def write_scores(target: DataFrame, scores: DataFrame, key: str = "pk", at: Column | None = None) -> DataFrame:
    """New version of the table with score, flag and class of the rows that were scored."""
    score = F.col("anomaly_score")
    new = scores.select(
        key, "anomaly_score",
        V.truth(score >= 0.5).alias("is_anomaly"),
        risk_label(score).alias("risk_classification"),
        (F.current_timestamp() if at is None else at).alias("updated_at"),
    )
    columns = [c for c in ("anomaly_score", "is_anomaly", "risk_classification", "updated_at") if c in target.columns]
    return update_by_key(target, new, key, columns)


def training_summary(scored: DataFrame, importance: DataFrame, features: list[str], top: int = 15) -> DataFrame:
    """One row: samples, features, class counts and the leading features."""
    label = risk_label(F.col("anomaly_score"))
    counts = scored.agg(
        F.count("*").alias("n_samples"),
        F.count_if(label == "high-risk").alias("high_risk"),
        F.count_if(label == "suspicious").alias("suspicious"),
        F.count_if(label == "normal").alias("normal"),
    )
    ranked = top_features(importance, top).agg(
        F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False).alias("t")
    ).scalar()
    return counts.withColumns({"n_features": F.lit(len(features)), "top_features": ranked})


def anomaly_rate(flags: Column) -> Column:
    return percent(F.count_if(flags), F.count("*"))
