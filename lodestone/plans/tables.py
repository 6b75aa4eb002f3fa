"""The driver's tables as the models of this library see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files."""
    return corpus.from_documents(table(spark, sf_dir, "documents"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.paths_of_pages(table(spark, sf_dir, "pages"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a history: each user is a path, latest first."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id").alias("pos"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as line ranges of an order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 20).cast("long").alias("start"), (F.col("l_linenumber") * 20 + F.col("l_quantity").cast("long")).alias("end"))


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a selection: toxic documents as codemaps, good ones in full."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    mode = F.when(F.col("toxic") == 1, F.lit("codemap")).when(F.col("quality") == 1, F.lit("full"))
    path = corpus.from_documents(docs).columns[0]
    joined = docs.join(labels, "doc_id").withColumn("mode", mode).where("mode IS NOT NULL")
    return joined.select(F.coalesce("lang", F.lit("und")).alias("session_id"), F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias(path), "mode", F.array().cast("array<struct<start:int,end:int,description:string>>").alias("slices"))
