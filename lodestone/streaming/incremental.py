"""Catalog tables that follow a stream of files: content hashes decide what is computed anew.

Arriving files are held against the table by (path, content hash); only new contents are worked on and appended.
A batch that is run twice after a failure finds its rows there and adds nothing, so the sink is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import text as T

SCHEMA = "path string, content_sha256 string, size long, tokens long, batch long"


def measured(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("content_sha256"), T.utf8_bytes("content").alias("size"), T.estimate_tokens("content").alias("tokens"))


def fold(batch: DataFrame, number: int, table: str) -> None:
    """Appends what the table does not hold yet."""
    spark = batch.sparkSession
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(table)  # so that there is a table to read
    known = spark.read.schema(SCHEMA).parquet(table).select("path", "content_sha256")
    fresh = measured(batch).dropDuplicates(["path", "content_sha256"]).join(known, ["path", "content_sha256"], "left_anti")
    fresh.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(table)


def follow(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str) -> StreamingQuery:
    """Runs over all files of (path, content) rows that have arrived in the folder since the last run."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(lambda df, n: fold(df, n, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The latest row of each path."""
    rows = spark.read.schema(SCHEMA).parquet(table)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("batch"), "content_sha256"))).where("_n = 1").drop("_n")


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Changes by path and hour from a stream of (path, ts) events; what is later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "path").agg(F.count(F.lit(1)).alias("changes")).select(F.col("window.start").alias("hour"), "path", "changes")
