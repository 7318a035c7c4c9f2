"""Exact quantiles that never gather a whole group in one task.

A first pass counts values per group and logarithmic bucket, which is combined map-side and stays
bounded however large a group is. Running totals over the buckets tell which bucket holds each
wanted rank. Where such a bucket holds more than ``WINDOW_ROWS`` rows of different values, it is cut
between its own least and largest value into ``CUTS`` parts, which are counted likewise, until the part
that holds the rank is small or is one value. A last pass reads only the values of those parts,
counts equal values together and picks the ranks. Interpolation is linear between the two
neighbouring ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.plans.joins import LOOKUP_ROWS, is_small, matches, prefixed

BUCKETS_PER_E = 512.0
# Rows that the last pass may sort for one rank, parts of a bucket that holds more, and rounds of cutting.
# A round narrows a bucket a thousandfold; doubles of one bucket are equal after a few.
WINDOW_ROWS, CUTS, ROUNDS = 100_000, 1024, 12


def value_bucket(c: Column) -> Column:
    """Bucket number that never decreases with the value; at most 363,000 on either side of zero."""
    return (F.signum(c) * F.floor(F.log1p(F.abs(c)) * F.lit(BUCKETS_PER_E))).cast("long")


def part_share(v: Column, low: Column, high: Column) -> Column:
    """Where a value lies between two others, 0 to 1; on a scale of ratios where they are far apart and positive."""
    ratios = (F.log(v) - F.log(low)) / (F.log(high) - F.log(low))
    # The difference of two doubles may overflow; that of their halves doesn't.
    return F.when((low > 0) & (high > 4 * low), ratios).otherwise((v / 2 - low / 2) / (high / 2 - low / 2))


def exact_quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    max_targets: int = LOOKUP_ROWS,
) -> DataFrame:
    """One row per group with the requested quantiles; groups without a value are left out."""
    number = F.col(value).cast("double")
    base = rows.where(number.isNotNull()).select(*keys, number.alias("__v"), value_bucket(number).alias("__b"))

    counts = [F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")]
    sizes = base.groupBy(*keys, "__b").agg(*counts)
    group = Window.partitionBy(*keys)
    running = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sizes.withColumns({"__end": F.sum("__n").over(running), "__total": F.sum("__n").over(group)})
    ranks = {name: F.lit(float(p)) * (F.col("__total") - 1) for name, p in probs.items()}

    def within(rank: Column, start: Column, end: Column) -> Column:
        return (rank >= start) & (rank < end)

    def holding_a_rank(found: DataFrame) -> DataFrame:
        """Parts (``__n`` rows that end at rank ``__end``) that hold a wanted rank, with their first rank."""
        start, end = F.col("__end") - F.col("__n"), F.col("__end")
        wanted = [within(edge(rank), start, end) for rank in ranks.values() for edge in (F.floor, F.ceil)]
        return found.where(reduce(lambda a, b: a | b, wanted)).select(*keys, "__b", "__n", "__low", "__high", start.alias("__start"), "__total")

    on = [*keys, "__b"]

    def inside(targets: DataFrame, small: bool, of: DataFrame) -> DataFrame:
        """Values of the targets' buckets that lie in the targets' parts of them."""
        other = prefixed(F.broadcast(targets) if small else targets, [*on, "__n"], "__r_")
        part = matches(of, other, on, "__r_") & of["__v"].between(other["__low"], other["__high"])
        return of.join(other, part, "inner").drop(*["__r_" + k for k in on], "__r___n")

    # Copies are counted together before a shuffled join, so that a hot value is one row.
    distinct = base.groupBy(*on, "__v").agg(F.count("*").alias("__copies"))
    single = base.withColumn("__copies", F.lit(1).cast("long"))
    kept, small = is_small(holding_a_rank(placed), max_targets)
    for _ in range(ROUNDS):
        many = (F.col("__n") > WINDOW_ROWS) & (F.col("__low") < F.col("__high"))
        if kept.where(many).isEmpty():
            break
        held = inside(kept.where(many), small, single if small else distinct)
        share = part_share(F.col("__v"), F.col("__low"), F.col("__high"))
        of = [*on, "__start", "__total"]
        parts = held.withColumn("__part", F.least(F.floor(share * CUTS), F.lit(CUTS - 1))).groupBy(*of, "__part").agg(
            F.sum("__copies").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        upto = Window.partitionBy(*of).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        finer = holding_a_rank(parts.withColumn("__end", F.col("__start") + F.sum("__n").over(upto)))
        kept, small = is_small(kept.where(~many).unionByName(finer), max_targets)
    counted = inside(kept, small, single if small else distinct).groupBy(*on, "__start", "__total", "__v").agg(F.sum("__copies").alias("__n"))

    upto = Window.partitionBy(*on, "__start").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = counted.withColumn("__to", F.col("__start") + F.sum("__n").over(upto))
    begin, stop = F.col("__to") - F.col("__n"), F.col("__to")
    picks = []
    for i, rank in enumerate(ranks.values()):
        picks.append(F.max(F.when(within(F.floor(rank), begin, stop), F.col("__v"))).alias(f"__lo{i}"))
        picks.append(F.max(F.when(within(F.ceil(rank), begin, stop), F.col("__v"))).alias(f"__hi{i}"))
    picked = runs.groupBy(*keys, "__total").agg(*picks)
    return picked.select(
        *keys,
        *[
            (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (rank - F.floor(rank))).alias(name)
            for i, (name, rank) in enumerate(ranks.items())
        ],
    )


def quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    accuracy: int | None = None,
) -> DataFrame:
    """Exact by default; with ``accuracy`` a single pass over mergeable sketches."""
    if accuracy is None:
        return exact_quantiles(rows, keys, value, probs)
    number = F.col(value).cast("double")
    found = [F.approx_percentile(number, F.lit(float(p)), F.lit(accuracy)).alias(n) for n, p in probs.items()]
    return rows.where(number.isNotNull()).groupBy(*keys).agg(*found)


def with_quantiles(
    summary: DataFrame,
    rows: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    accuracy: int | None = None,
) -> DataFrame:
    """Add quantile columns to a grouped summary over the same keys."""
    if not keys:
        found = quantiles(rows, keys, value, probs, accuracy)
        packed = found.select(F.struct(*probs).alias("q")).scalar()
        return summary.select("*", *[packed[n].alias(n) for n in probs])
    found = prefixed(quantiles(rows, keys, value, probs, accuracy), keys, "__q_")
    joined = summary.join(found, matches(summary, found, keys, "__q_"), "left")
    return joined.drop(*["__q_" + k for k in keys])
