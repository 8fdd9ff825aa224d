"""A corpus from raw documents to packed sequences, as stages that are each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import exact, language, packing, simhash, toxicity
from hushframe.llm.common import held_out, table
from hushframe.plans.materialise import new_path

#: SQL cannot express the models and tokens; tests hold the rows against brute force.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or whose n-grams belong to no language learned.

    Where no language can be learned, only documents without a letter go.
    """
    model = language.learn_languages(docs, ~held_out(F.col("doc_id")))
    return language.drop_unknown(docs, model)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the grammar predicts to be toxic."""
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the one with the longest original text stays."""
    return exact.drop_exact_copies(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and place."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


STAGES = [
    ("language", keep_known_languages),
    ("toxicity", keep_civil),
    ("exact_copies", keep_one_copy),
    ("near_copies", keep_one_near_copy),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
