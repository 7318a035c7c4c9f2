"""Joins whose broadcast side has a proven or checked size, with another way beyond it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

# A lookup is broadcast only when it has been counted and holds no more rows than this.
LOOKUP_ROWS = 200_000
# A group of at least this many rows is treated as hot. N rows hold at most N / HOT_ROWS such
# groups, which bounds the broadcast of their statistics.
HOT_ROWS = 1_000_000


def matches(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    """Null-safe equality of ``keys`` with their prefixed copies on the right."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys])


def prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in keys})


def is_small(lookup: DataFrame, max_rows: int = LOOKUP_ROWS) -> tuple[DataFrame, bool]:
    """Count a grouped result and tell whether it may be broadcast; a small one is kept for reuse."""
    kept = lookup.persist(StorageLevel.MEMORY_AND_DISK)
    if kept.count() <= max_rows:
        return kept, True
    return kept.unpersist(), False


def attach_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    null_safe: bool = False,
    max_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """Equi-join with a grouped lookup.

    The lookup is counted first. Up to ``max_rows`` it is broadcast and the rows are not
    shuffled; beyond, the join is left to Catalyst, where AQE splits the hot partitions.
    """
    kept, small = is_small(lookup, max_rows)
    side = F.broadcast(kept) if small else kept
    if not null_safe:
        return rows.join(side, keys, how)
    other = prefixed(side, keys, "__r_")
    joined = rows.join(other, matches(rows, other, keys, "__r_"), how)
    return joined.drop(*["__r_" + k for k in keys])


def attach_group_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: list[str],
    size: str,
    hot_rows: int = HOT_ROWS,
    spread: int = 256,
) -> DataFrame:
    """Left-join per-group statistics to the rows of groups of any size, in one pass over the rows.

    ``size`` names the row count in ``stats``. Hot groups take their statistics from a broadcast
    of at most N / hot_rows entries and are then spread over ``spread`` salts, so that no task of
    the shuffled join for the remaining groups receives them. Rows with a NULL key match nothing.
    """
    payload = [c for c in stats.columns if c not in keys]
    packed = stats.select(*keys, F.struct(*payload).alias("__stats"), F.col(size).alias("__size"))
    hot = prefixed(packed.where(F.col("__size") >= hot_rows), keys, "__h_").withColumnRenamed("__stats", "__hot")
    hot = hot.drop("__size")
    # Where even the hot groups are too many to be sent to every task, they are joined by a shuffle.
    kept, small = is_small(hot)
    on_hot = reduce(lambda a, b: a & b, [rows[k] == kept["__h_" + k] for k in keys])
    tagged = rows.join(F.broadcast(kept) if small else kept, on_hot, "left").drop(*["__h_" + k for k in keys])
    # NULL keys match nothing either; they are spread as well. The partition id separates exact
    # copies of one row and is the same when a lost task is run again.
    loose = F.col("__hot").isNotNull() | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    hashed = F.xxhash64(*[rows[c] for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))])
    spreaded = F.pmod(hashed + F.spark_partition_id(), F.lit(spread)) + 1
    tagged = tagged.withColumn("__salt", F.when(loose, spreaded).otherwise(F.lit(0)).cast("int"))
    cold = prefixed(packed.where(F.col("__size") < hot_rows), keys, "__c_").withColumnRenamed("__stats", "__cold")
    cold = cold.drop("__size").withColumn("__c_salt", F.lit(0))
    on_cold = reduce(
        lambda a, b: a & b,
        [tagged[k] == cold["__c_" + k] for k in keys] + [tagged["__salt"] == cold["__c_salt"]],
    )
    joined = tagged.join(cold, on_cold, "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*[tagged[c] for c in rows.columns], *[found[c].alias(c) for c in payload])
