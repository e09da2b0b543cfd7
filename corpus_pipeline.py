"""The corpus pipeline: documents through language identification, near-duplicate and substring removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame with the columns of documents; the last gives
the encoded documents. run() applies them in turn. SQL can't express the models and the codec, so the
pipeline is tested stage by stage against plain Python.
"""

from __future__ import annotations

from glyphward.llm import language_id, piece_codec, simhash_dedup, source_mix, substring_dedup
from glyphward.llm.common import table
from glyphward.llm.queries import tokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing language is filled in."""
    return language_id.keep_accepted(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.keep_one(docs)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that also stand earlier; n_chars follows the text."""
    return substring_dedup.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded."""
    return piece_codec.encode_documents(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_substrings),
    ("source_mix", mix_sources),
    ("piece_codec", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
