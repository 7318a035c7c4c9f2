"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

Every source asks for a share of the total by weight. A source whose share exceeds its cap is
clamped there and the excess goes to the others by weight, until none is above. In order of
cap / weight the clamped sources come first, so the final level follows from running sums.
A document is repeated as often as fits wholly into its source's target; the rest goes to documents
in the order of a seeded hash, until the words reach the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.plans.joins import attach_lookup

WORD = r"[^\x20\x09-\x0D]+"
# Hash buckets that a source is split into, so that its running sum never sorts all its rows.
HEX_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """Add ``target`` to rows of ``source, weight, source_size`` (one row per source)."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    asked = sources.withColumns({"cap": cap, "ratio": cap / F.col("weight"), "total": total})
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = asked.withColumn("level", level)
    # The first source in this order whose cap is not reached has the final level.
    free = F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.struct(F.col("source").isNull(), "source"), "level"))
    final = F.min(free).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    target = F.coalesce(F.least("cap", final * F.col("weight")), F.col("cap"))
    return levels.withColumn("target", target).select("source", "weight", "source_size", "target")


def mix(
    docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 2, seed: str = "mix",
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per document: ``row`` (all its columns), ``doc_id, size, source_size, target, repeats, taken``.

    The mix holds ``share`` times all words. Sources in code-point order, null last, take the weights
    in turn. ``repeats`` is how often the document is taken, at most ``max_epochs`` times, and
    ``taken`` its words times that. A null source is a source of its own; null or wordless text has
    size 0 and is never repeated; repeated rows count each; an empty table gives no rows; columns of
    any other name stay inside ``row``. Sources are an aggregate of one row each; the rows of a source
    are never sorted as a whole, only one of its hash buckets.
    """
    hashed = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f"#{seed}")).cast("binary"))
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"), hashed.alias("hash"),
    ).withColumn("bucket", F.conv(F.substring("hash", 1, HEX_DIGITS), 16, 10).cast("int"))
    parts = base.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sources = parts.groupBy("source").agg(F.sum("n").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = water_fill(sources.withColumn("weight", given), F.sum("source_size").over(everything) * F.lit(float(share)), max_epochs)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    filled = filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # The bucket of each source in which the running sum passes the rest.
    renamed = filled.withColumnRenamed("source", "known")
    running = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = parts.withColumn("upto", running).join(renamed, F.col("source").eqNullSafe(F.col("known")))
    edge = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))))
    lookup = placed.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("whole").alias("whole"),
        F.first("rest").alias("rest"), edge.alias("edge"))
    known = attach_lookup(base, lookup, ["source"], null_safe=True)
    at_edge = F.col("bucket") == F.col("edge.bucket")
    clear = known.where(~F.coalesce(at_edge, F.lit(False))).withColumn("extra", F.coalesce(F.col("bucket") < F.col("edge.bucket"), F.lit(True)))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("edge.before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = known.where(at_edge).withColumn("extra", 2 * earlier + F.col("size") <= 2 * F.col("rest"))
    repeats = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("extra").cast("int"), F.lit(max_epochs))).otherwise(0).cast("int")
    return clear.unionByName(cut).withColumn("repeats", repeats).select(
        "row", "doc_id", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    found = mix(docs, **options)
    return found.where("repeats > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("repeats"))).alias("n")).select("row.*")
