"""Interval algebra on closed integer ranges, per key, by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalise(ranges: DataFrame, key: str, start: str = "start", end: str = "end", last: str | None = None, note: str | None = None) -> DataFrame:
    """Union of each key's ranges: reversed bounds swapped, clamped to 1..last, overlapping and adjacent ones merged.

    last: a column with the largest bound (none: no upper clamp). note: a column of which the first non-null value
    in a merged range stays.
    """
    low, high = F.greatest(F.lit(1), F.least(start, end)), F.greatest(F.lit(1), F.greatest(start, end))
    if last is not None:
        low, high = F.least(low, F.greatest(F.lit(1), F.col(last))), F.least(high, F.greatest(F.lit(1), F.col(last)))
    rows = ranges.select(key, low.alias("_a"), high.alias("_b"), (F.col(note) if note else F.lit(None).cast("string")).alias("_note"))
    order = Window.partitionBy(key).orderBy("_a", "_b", "_note")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = rows.withColumn("_new", F.coalesce((F.col("_a") > F.max("_b").over(before) + 1).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(key, "_island").agg(F.min("_a").alias(start), F.max("_b").alias(end), F.min_by("_note", F.when(F.col("_note").isNotNull(), F.struct("_a", "_b"))).alias("_note"))
    return merged.select(key, start, end, *([F.col("_note").alias(note)] if note else []))


def subtract(ranges: DataFrame, removed: DataFrame, key: str, start: str = "start", end: str = "end", partitions: int | None = None) -> DataFrame:
    """ranges (already disjoint per key) without what `removed` covers; a range may be split.

    Both sides become edges with a weight; a sweep over the edges of a key finds where only `ranges` is open. Edges are
    moved and sorted once and gathered in no table of groups. partitions: how many parts they are moved to (none: as
    many as the session says), so that a task's part need not grow with the input.
    """
    def edges(side: DataFrame, mine: int, theirs: int) -> DataFrame:
        both = F.array(F.struct(F.col(start).alias("at"), F.lit(mine).alias("m"), F.lit(theirs).alias("t")), F.struct((F.col(end) + 1).alias("at"), F.lit(-mine).alias("m"), F.lit(-theirs).alias("t")))
        return side.select(key, F.inline(both))

    points = edges(ranges, 1, 0).unionByName(edges(removed, 0, 1))
    if partitions is not None:
        points = points.repartition(partitions, key)
    # edges at one place count together: frames by value, and the last of them speaks for the place
    order = Window.partitionBy(key).orderBy("at")
    upto, here = order.rangeBetween(Window.unboundedPreceding, Window.currentRow), order.rangeBetween(Window.currentRow, Window.currentRow)
    swept = points.select(key, "at", F.sum("m").over(upto).alias("mine"), F.sum("t").over(upto).alias("theirs"), F.sum("m").over(here).alias("m"), F.sum("t").over(here).alias("t"), F.lead("at").over(order).alias("next"))
    is_open, was_open = F.expr("mine > 0 AND theirs = 0"), F.expr("mine - m > 0 AND theirs - t = 0")
    begins = is_open & (~was_open | (F.col("m") > 0))
    bounds = swept.where(~F.col("next").eqNullSafe(F.col("at"))).select(key, "at", begins.alias("begins"), (was_open & ~is_open).alias("closes")).where("begins OR closes")
    return bounds.withColumn("next", F.lead("at").over(order)).where("begins AND next IS NOT NULL").select(key, F.col("at").alias(start), (F.col("next") - 1).alias(end))
