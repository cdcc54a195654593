"""A training-data pipeline over `documents`: language, quality, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Stages take nulls in any column, empty
tables and repeated rows; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import bpe, langid, mixing, quality, similarity
from terrafold.storage import new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose language is known and sure enough. A null text and one without a letter go; so does all of a
    table in which no row has a language to learn from. Repeated rows stay or go together."""
    return langid.keep_identified(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that are probably of the best grade, good and not toxic; all do where no label can be learned from. A
    null text is graded like an empty one. Repeated rows stay or go together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (shingles of five words, similarity 0.8 or more) the row of the smallest doc_id stays,
    null ones last, then that of the smallest text. Rows without words are classes of their own and stay, repeated ones
    too."""
    return similarity.keep_one(docs, k=5, least=Fraction(4, 5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; rows repeat where a source is taken more than once, and the last one taken may be cut
    short. Rows without a word (a null or empty text) are never taken; null is a source."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every row of the mix, repeated ones too; a null text has no ids."""
    return bpe.encode_documents(docs, ids=True)


STAGES = [("language", language), ("quality", good_quality), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]

#: The stages' models and joins are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two stages goes to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
