"""A training corpus from raw documents: five stages, each a stored table for the next.

Language (rejected documents go), quality (rejected documents go), near-duplicates (one
document of each group stays), mixing of sources (documents repeat as often as the mix
takes them), tokens. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelweave.llm import bpe, language, mixing, near_dup, quality
from reelweave.llm.common import cut_lineage, read_table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learned from the labelled documents; rejected documents go."""
    return language.accepted(docs, language.learn(docs))


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality by document and site; rejected documents go."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: the document with the least id of a group stays."""
    return near_dup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; a document is repeated as often as it is taken."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and of the decoded text."""
    return bpe.encoded(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_languages),
    ("quality", keep_good_documents),
    ("near_duplicates", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Trained models and registers are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
