"""A running number over a whole table without bringing it into one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Uses the shared folder that spark.checkpoint.dir names. Where none is named, a local session (tests) gets a
    temporary one; on a cluster that is an error, since executors could not read it."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-"))


def work_folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    ready_to_checkpoint(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def numbered(rows: DataFrame, order: list[Column | str], column: str, first: int = 0) -> DataFrame:
    """rows with their place in the order, from `first`.

    Rows are dealt into ranges of the order and kept there by a checkpoint; a range's places begin after the rows
    of all ranges before it. Rows that the order does not tell apart are numbered in no stated order.
    """
    ready_to_checkpoint(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return placed.join(F.broadcast(starts), "_range").withColumn(column, (F.col("_start") + F.col("_own") + (first - 1)).cast("long")).drop("_range", "_start", "_own")


def summed(rows: DataFrame, order: list[Column | str], cost: str, column: str) -> DataFrame:
    """rows with the sum of `cost` over all rows before them in the order, without bringing the table into one task."""
    ready_to_checkpoint(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("_range").agg(F.sum(cost).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_own", F.coalesce(F.sum(cost).over(own), F.lit(0)))
    return placed.join(F.broadcast(starts), "_range").withColumn(column, (F.col("_start") + F.col("_own")).cast("long")).drop("_range", "_start", "_own")


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """rows with running sums, and with the last value that is not null, both up to each row in the order; lasts may use
    the sums. No task holds more than a range of the order: what a range ends with is carried into the next ones."""
    ready_to_checkpoint(rows.sparkSession)
    ranged = rows.withColumns(sums).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if sums:
        starts = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums]).select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_of_{c}") for c in sums])
        ranged = ranged.join(F.broadcast(starts), "_range").withColumns({c: F.sum(c).over(own) + F.col(f"_of_{c}") for c in sums}).drop(*[f"_of_{c}" for c in sums])
    if lasts:
        ranged = ranged.withColumns(lasts)
        ends = ranged.groupBy("_range").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in lasts])
        starts = ends.select("_range", *[F.last(c, ignorenulls=True).over(before).alias(f"_of_{c}") for c in lasts])
        ranged = ranged.join(F.broadcast(starts), "_range").withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col(f"_of_{c}")) for c in lasts}).drop(*[f"_of_{c}" for c in lasts])
    return ranged.drop("_range")
