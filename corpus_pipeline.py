"""
A training corpus in five stages, each on all that the one before it kept:

quality       a Kneser-Ney model of trusted texts rejects unlikely documents
exact_dedup   of equal texts the row with the largest id stays
near_dedup    of each group of near copies (five words, similarity 0.8) the row with the smallest id stays
mix           sources are mixed to their target weights: a row per pass that takes words of a document
encode        texts become SentencePiece ids, which decode to the text again

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. What a stage decides for null, empty,
very long, repeated and tied rows is said where its operator is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import exact_dedup, mixing, quality, sentencepiece_codec, simhash
from wakeline.llm.common import cut, documents


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of documents labelled good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.survivors(docs, trusted(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.Mix(docs).mixed()
    if "n_chars" in mixed.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text."""
    coded = sentencepiece_codec.encode(docs.select("doc_id", "text", "lang", "source"), exact="exact")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"), "exact")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix),
    ("encode", encode),
]

# The first, third and fifth stage have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written once to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
