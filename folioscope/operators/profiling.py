"""Column profiles, audits and filter funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import values as V
from folioscope.operators.statistics import percent, total_rows
from folioscope.plans.quantiles import exact_quantiles, with_quantiles
from folioscope.session import scratch_path

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def value_text(c: Column, kind: str) -> Column:
    """Text of a value that differs wherever values differ; both zeros have one, as has every NaN.

    Nested values are JSON.
    """
    if kind in ("float", "double"):
        return (c + F.lit(0).cast(kind)).cast("string")
    if kind == "binary":
        return F.hex(c)
    if kind == "timestamp":
        return F.unix_micros(c).cast("string")
    if kind.startswith(("array", "struct", "map", "variant")):
        return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")), STAMPS))
    return c.cast("string")


def stacked_counts(df: DataFrame) -> DataFrame:
    """Rows per (number of a column, value) of all columns, NULL values included.

    The table is read once and counts are combined before the only shuffle of values, so a value that
    fills a column leaves each task as one row.
    """
    cells = [F.struct(F.lit(i).alias("c"), value_text(column_of(df, i), kind).alias("valor")) for i, (_, kind) in enumerate(df.dtypes)]
    return df.select(F.inline(F.array(*cells))).groupBy("c", "valor").agg(F.count("*").alias("n"))


def column_of(df: DataFrame, i: int) -> Column:
    """A column by its place, whatever its name holds."""
    return F.col("`" + df.columns[i].replace("`", "``") + "`")


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, NULL count and share, and distinct count of every column, from one scan.

    Columns of an empty table have no NULLs, no values and no share. With ``approximate`` the distinct
    counts come from mergeable sketches instead of a shuffle of every column's values.
    """
    listed = [F.struct(F.lit(i).alias("c"), F.lit(name).alias("columna"), F.lit(kind).alias("tipo")) for i, (name, kind) in enumerate(df.dtypes)]
    columns = df.sparkSession.range(1).select(F.inline(F.array(*listed)))
    if approximate:
        aggregates = [F.count("*").alias("__rows")]
        for i in range(len(df.columns)):
            aggregates.append(F.count(column_of(df, i)).alias(f"n{i}"))
            aggregates.append(F.approx_count_distinct(column_of(df, i)).alias(f"d{i}"))
        entries = [
            F.struct(F.lit(i).alias("c"), F.col("__rows").alias("filas"), (F.col("__rows") - F.col(f"n{i}")).alias("nulos"), F.col(f"d{i}").alias("unicos"))
            for i in range(len(df.columns))
        ]
        found = df.agg(*aggregates).select(F.inline(F.array(*entries)))
    else:
        found = stacked_counts(df).groupBy("c").agg(
            F.sum("n").alias("filas"), F.sum(F.when(F.col("valor").isNull(), F.col("n"))).alias("nulos"), F.count("valor").alias("unicos"))
    # One row per column.
    joined = columns.join(F.broadcast(found), "c", "left")
    return joined.select(
        "columna", "tipo", F.coalesce("nulos", F.lit(0)).alias("nulos"),
        percent(F.coalesce("nulos", F.lit(0)), F.col("filas")).alias("nulos_pct"), F.coalesce("unicos", F.lit(0)).alias("unicos"))


def numeric_profile(df: DataFrame, exclude: tuple[str, ...] = ("pk",), accuracy: int | None = None) -> DataFrame:
    """Range, mean and median of every numeric column.

    The columns are stacked to (column, value) pairs and grouped, so all medians share one plan.
    """
    names = [n for n, kind in df.dtypes if kind in NUMERIC and n not in exclude]
    pairs = F.array(*[F.struct(F.lit(n).alias("columna"), F.col(n).cast("double").alias("valor")) for n in names])
    long = df.select(F.inline(pairs)).where(F.col("valor").isNotNull())
    summary = long.groupBy("columna").agg(
        F.min("valor").alias("minimo"), F.max("valor").alias("maximo"), F.avg("valor").alias("media")
    )
    return with_quantiles(summary, long, ["columna"], "valor", {"mediana": 0.5}, accuracy)


def category_profile(df: DataFrame, columns: list[str], max_distinct: int = 50, top: int = 5) -> DataFrame:
    """Most frequent values of the text columns that have few distinct ones."""
    pairs = F.array(*[F.struct(F.lit(n).alias("columna"), F.col(n).alias("valor")) for n in columns])
    counts = (
        df.select(F.inline(pairs)).where(F.col("valor").isNotNull())
        .groupBy("columna", "valor").agg(F.count("*").alias("n"))
    )
    few = counts.groupBy("columna").agg(F.count("*").alias("unicos")).where(F.col("unicos") <= max_distinct)
    # At most one row per profiled column; and only ``max_distinct`` values per kept column.
    kept = counts.join(F.broadcast(few.select("columna")), "columna", "left_semi")
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "valor"))), 1, top)
    best = kept.groupBy("columna").agg(ranked.alias("__top")).select("columna", F.explode("__top").alias("t"))
    rows = best.select("columna", F.col("t.valor").alias("valor"), (-F.col("t.k")).alias("n"))
    return rows.withColumn("porcentaje", percent(F.col("n"), total_rows(df)))


def bin_label(value: Column, edges: list, labels: list[str], include_lowest: bool = False) -> Column:
    """Label of the right-closed bin (low, high]; an open last edge is infinity."""
    chain = None
    for low, high, label in zip(edges, edges[1:], labels):
        above = value > low
        if include_lowest and low == edges[0]:
            above = value >= low
        inside = above if high is None else above & (value <= high)
        chain = F.when(inside, label) if chain is None else chain.when(inside, label)
    return chain


def value_histogram(df: DataFrame, value: Column, edges: list, labels: list[str], include_lowest: bool = False) -> DataFrame:
    binned = df.select(bin_label(value, edges, labels, include_lowest).alias("rango")).where(F.col("rango").isNotNull())
    return binned.groupBy("rango").agg(F.count("*").alias("n"))


def market_comparison(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Market against non-market rows: texts, numbers, zeros, valid values, mean and median.

    ``df`` carries the market flag and the raw text in ``valor_texto``. The texts are parsed once, into a
    narrow table, since the median passes over the numbers several times.
    """
    market, text = F.col("dinamica_inmobiliaria"), F.col("valor_texto")
    path = scratch_path(df.sparkSession, "market-values")
    parsed = df.where(market.isin(0, 1)).select(market, text.isNotNull().alias("__text"), V.money_or_null(text).alias("__v"))
    parsed.write.parquet(path)
    known = df.sparkSession.read.schema(parsed.schema).parquet(path)
    valid = F.when(F.col("__v").between(K.MIN_VALID_VALUE, K.MAX_VALID_VALUE), F.col("__v"))
    rows = known.withColumns({"__valid": valid, "__positive": F.when(F.col("__v") > 0, F.col("__v"))})
    summary = rows.groupBy("dinamica_inmobiliaria").agg(
        F.count("*").alias("total"),
        F.count_if("__text").alias("con_texto"),
        F.count("__v").alias("numericos"),
        F.count_if(F.col("__v") == 0).alias("ceros"),
        F.count("__positive").alias("positivos"),
        F.count("__valid").alias("validos"),
        F.avg("__positive").alias("media_positivos"),
        F.avg("__valid").alias("media_validos"),
    )
    return with_quantiles(summary, rows, ["dinamica_inmobiliaria"], "__positive", {"mediana_positivos": 0.5}, accuracy)


def value_class_counts(df: DataFrame, raw: str = "valor_texto") -> DataFrame:
    from folioscope.operators.quality import value_class

    return df.groupBy(value_class(F.col(raw)).alias("clase")).agg(F.count("*").alias("n"))


def filter_funnel(df: DataFrame) -> DataFrame:
    """Six filters in order with the rows each drops and leaves, from one aggregate."""
    raw = F.col("valor_texto")
    number = V.money_or_null(raw)
    steps = [
        ("mercado", F.col("dinamica_inmobiliaria") == 1),
        ("valor presente", raw.isNotNull()),
        ("valor numérico", number.isNotNull()),
        ("valor mayor que cero", number > 0),
        ("valor mínimo", number >= K.MIN_VALID_VALUE),
        ("valor máximo", number <= K.MAX_VALID_VALUE),
    ]
    passed = F.lit(True)
    counts = [F.count("*").alias("__0")]
    for i, (_, holds) in enumerate(steps, 1):
        passed = passed & V.truth(holds)
        counts.append(F.count_if(passed).alias(f"__{i}"))
    wide = df.agg(*counts)
    entries = [
        F.struct(
            F.lit(i).alias("paso"),
            F.lit(name).alias("filtro"),
            (F.col(f"__{i - 1}") - F.col(f"__{i}")).alias("descartados"),
            F.col(f"__{i}").alias("restantes"),
            percent(F.col(f"__{i - 1}") - F.col(f"__{i}"), F.col("__0")).alias("descartados_pct"),
        )
        for i, (name, _) in enumerate(steps, 1)
    ]
    return wide.select(F.inline(F.array(*entries)))


def frequent_unparsable(df: DataFrame, raw: str = "valor_texto", n: int = 50) -> DataFrame:
    wrong = df.where(F.col(raw).isNotNull() & V.money_or_null(F.col(raw)).isNull())
    return wrong.groupBy(raw).agg(F.count("*").alias("n")).orderBy(F.desc("n"), raw).limit(n)


def code_structure(df: DataFrame, column: str = "divipola", prefix: int = 2) -> DataFrame:
    """Distribution of code lengths and of code prefixes in long form."""
    known = df.where(F.col(column).isNotNull())
    pairs = F.array(
        F.struct(F.lit("longitud").alias("medida"), F.length(column).cast("string").alias("valor")),
        F.struct(F.lit("prefijo").alias("medida"), F.substring(column, 1, prefix).alias("valor")),
    )
    return known.select(F.inline(pairs)).groupBy("medida", "valor").agg(F.count("*").alias("n"))


def number_summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, range and quartiles of one number."""
    c = F.col(column)
    base = df.agg(
        F.count(c).alias("n"), F.avg(c).alias("media"), F.stddev_samp(c).alias("desviacion"),
        F.min(c).alias("minimo"), F.max(c).alias("maximo"),
    )
    return with_quantiles(base, df, [], column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def missing_per_column(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(c).alias("nulos")) for c in df.columns])))


def largest_values(df: DataFrame, column: str = "valor_acto", n: int = 30, key: str = "pk") -> DataFrame:
    return df.where(F.col(column).isNotNull()).orderBy(F.desc(column), key).limit(n)


def percentiles(df: DataFrame, column: str, probs: dict[str, float]) -> DataFrame:
    return exact_quantiles(df, [], column, probs)
