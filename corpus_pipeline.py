"""From raw documents to encoded training text: quality, exact and near duplicates, the source mix, byte-pair encoding.

Every stage is a function of (spark, docs, sf_dir). Its result is written and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seatward.llm import bpe, dedup, jaccard, mixing, quality
from seatward.llm.common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior or the base rules reject go."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return dedup.drop_repeats(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.75 or more connect, the one with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time the mix draws a document, shard by shard and shuffled; documents it does not draw go."""
    return mixing.shuffled_shards(mixing.mixed_rows(docs)).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids counted and digested per row, and the decoded text's digest."""
    columns = ["doc_id", "source"]
    return bpe.encoding_digests(docs, bpe.vocabulary(), carry=columns).select(*columns, "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_encoding),
]

# The learned verdict, the components and the random deal have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return docs
