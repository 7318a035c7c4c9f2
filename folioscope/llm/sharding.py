"""Placement of documents into shards by a hierarchical weighted hash tree, DataFrame functions only.

Shards are the leaves of a tree of regions and racks; the weight of a node is the sum of its leaves'.
From the root down, every child of a node draws a number from a hash of the document's id and the
child's name, and the least ``-ln(draw) / weight`` is descended into: a child is met with the
probability of its share of its node's weight. A draw depends on nothing but the id and the child, so
where a weight changes, documents move only into (or, where it falls, out of) the subtrees that
hold the change; what lies between other subtrees stays.

A cluster starts with ``founded`` shards in regions and racks of equal size. A shard added later opens
a region of its own. Thus the one subtree whose weight changes is that shard, and it takes rows
only into itself.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import scratch_path

RACKS, SHARDS = 2, 4
# Places in one partition when slots are numbered.
PART_ROWS = 2_000_000


class Leaf(NamedTuple):
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def layout(shards: int, founded: int = 24, racks: int = RACKS, per_rack: int = SHARDS) -> list[Leaf]:
    """The tree of so many shards: ``founded`` ones fill regions in turn, later ones open regions of their own."""
    size = racks * per_rack
    old = min(shards, founded)
    leaves = [Leaf(s, s // size, s % size // per_rack) for s in range(old)]
    regions = -(-founded // size)
    return leaves + [Leaf(s, regions + s - founded, 0) for s in range(old, shards)]


def draw(key: Column, name: str) -> Column:
    """Uniform in (0, 1) from 52 bits of the hash of ``key`` and a node's name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("#" + name)).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def _least(key: Column, children: list[tuple[str, float, int]]) -> Column:
    """Number of the child (name, weight, number) whose draw is least; equal draws go to the first."""
    if len(children) == 1:
        return F.lit(children[0][2])
    raced = [F.struct((-F.log(draw(key, name)) / F.lit(weight)).alias("at"), F.lit(n).alias("n")) for name, weight, n in children]
    return F.least(*raced)["n"]


def _choice(cases: list[tuple[Column, Column]]) -> Column:
    if len(cases) == 1:
        return cases[0][1]
    head, *rest = cases
    return reduce(lambda made, case: made.when(*case), rest, F.when(*head))


def descend(docs: DataFrame, key: Column, leaves: list[Leaf], name: str) -> DataFrame:
    """``docs`` with the shard of ``key`` in the tree of ``leaves``, level by level, as column ``name``.

    Leaves of weight zero get nothing. The text of ``key`` must not be null.
    """
    leaves = [leaf for leaf in leaves if leaf.weight > 0]
    if not leaves:
        raise ValueError("no shard has a weight")
    weigh = lambda some: sum(leaf.weight for leaf in some)
    regions = {r: [leaf for leaf in leaves if leaf.region == r] for r in sorted({leaf.region for leaf in leaves})}
    racks = {(r, k): [leaf for leaf in held if leaf.rack == k] for r, held in regions.items() for k in sorted({leaf.rack for leaf in held})}
    region, rack = f"__{name}_region", f"__{name}_rack"
    placed = docs.withColumn(region, _least(key, [(f"r{r}", weigh(held), r) for r, held in regions.items()]))
    placed = placed.withColumn(rack, _choice([
        (F.col(region) == r, _least(key, [(f"r{r}k{k}", weigh(racks[r, k]), k) for q, k in racks if q == r])) for r in regions]))
    placed = placed.withColumn(name, _choice([
        ((F.col(region) == r) & (F.col(rack) == k), _least(key, [(f"r{r}k{k}s{leaf.shard}", leaf.weight, leaf.shard) for leaf in held]))
        for (r, k), held in racks.items()]))
    return placed.drop(region, rack)


def number(placed: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """``placed`` with ``slot``: numbers from 0 without gaps in each shard, in the given order.

    Rows are sorted over the whole cluster by (shard, order), and the place that each has in its
    partition is stored. A partition holds few shards, so the sizes that lie before a row are one row
    per partition and shard border. Rows that are alike in ``order`` are spread by their place in the
    input, so no number of them meets in one task.
    """
    spark = placed.sparkSession
    path = scratch_path(spark, "placed")
    placed.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored.count() // PART_ROWS + 1)
    keys = [shard, *order, "__at"]
    path = scratch_path(spark, "sorted")
    stored.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns(
        {"__part": F.spark_partition_id(), "__nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    laid = spark.read.parquet(path)
    runs = laid.groupBy(shard, "__part").agg(F.min("__nth").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(F.col(shard).alias("__shard"), F.col("__part").alias("__run"), (before - F.col("__first")).alias("__shift"))
    # At most one row for each partition and one more for each shard.
    starts = F.broadcast(starts)
    joined = laid.join(starts, (laid[shard] == starts["__shard"]) & (laid["__part"] == starts["__run"]))
    return joined.select(*placed.columns, (F.col("__nth") + F.col("__shift")).cast("long").alias("slot"))


def shard_documents(
    docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per document: ``row`` (the columns named by ``keep``), ``size, text_crc32, shard, slot, grown_shard``.

    The key and the tree decide the shard: rows of one key share it, also where the key is null.
    ``size`` is the text's UTF-8 bytes and eight more (null: none), ``text_crc32`` of the same bytes. Slots
    number each shard's rows by ascending (key, checksum). ``grown_shard`` is the shard in the tree
    ``grown``, or null. Repeated rows have slots of their own; an empty table gives no rows; columns
    of any name stay inside ``row``. Texts are read once and are not moved.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    held = docs.select(
        F.struct(*keep).alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(key).alias("order"),
        (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = descend(held, F.col("key"), leaves, "shard")
    placed = descend(placed, F.col("key"), grown, "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    return number(placed.drop("key"), "shard", ["order", "text_crc32"]).select("row", "size", "text_crc32", "shard", "slot", "grown_shard")
