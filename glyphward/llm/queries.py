"""The ten queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language_id, media_sequences, piece_codec, posting_lists, simhash_dedup, source_mix, substring_dedup, token_counts, toxicity, url_filter
from .common import table


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def settled(df: DataFrame) -> DataFrame:
    """df, dealt out so that its few narrow rows make files of the advisory size, not one for each task before."""
    return df.hint("rebalance")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(substring_dedup.deduplicate(table(spark, sf_dir, "documents"), digest=True))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return settled(language_id.identify(docs, language_id.train(docs)))


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return settled(toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(piece_codec.digest_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op10_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(media_sequences.document_media(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_substring_dedup, op3_source_mix, op4_language_id, op5_posting_lists, op6_toxicity, op7_simhash_dedup, op8_piece_codec, op9_token_counts, op10_media_sequences)}
ORACLE_SQL = {"op1_url_filter": url_filter.oracle(), "op2_substring_dedup": substring_dedup.ORACLE, "op3_source_mix": source_mix.ORACLE}
