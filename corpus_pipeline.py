"""A corpus pipeline of stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language_id, packing, quality_rules, simhash
from lodestone.llm.shared import work_folder

#: A text whose best language has less than this probability is rejected. One class of the net is for texts in no
#: language, so the share of the best language has no lower bound.
MIN_LANGUAGE = 0.2


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (2): rejects texts without a letter and texts that no learned language fits."""
    net = language_id.fit(docs.select("doc_id", "text", "lang"))
    judged = language_id.identify(docs, net, label_as="_lang", score_as="_score")
    return judged.where((F.col("_lang") != language_id.UNDETERMINED) & (F.col("_score") >= MIN_LANGUAGE)).select(*docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (3): rejects what fails the counted rules or the model."""
    model = quality_rules.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, model).where("kept").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (6): of each group of linked documents the one with the smallest doc_id stays."""
    return simhash.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (5): the pieces of all documents that are left, in sequences of 2048 tokens."""
    pieces = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("quality_rules", of_quality),
    ("simhash_dedup", without_near_duplicates),
    ("packing", packed),
]

#: The stages apply trained models and hashes that SQL lacks; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each result written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = work_folder(spark, f"stage-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
