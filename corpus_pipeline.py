"""A corpus pipeline: quality filter, line dedup, near-dedup, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of docs. Stages take rows with
null ids, null, empty and very long texts, repeated rows and other columns; what each does with them stands in its docstring.
An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwright.llm import linededup, mixing, quality, simhash
from sparkwright.llm.common import discard, table, written
from sparkwright.llm.queries import token_digests


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of sf_dir, gives at least 0.5.

    Null and empty texts are scored as padding; repeated rows are kept or go alike; without labels of both kinds all or none stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the line chunks that occurred before.

    Every row stays: null texts as null, texts without anything new as empty ones; of repeated rows the first keeps its lines.
    """
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null and empty texts are one group; repeated rows become one; rows that share an id are told apart by their texts; rows
    without an id all stay.
    """
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; one drawn in several epochs stands several times.

    Null and empty texts have no tokens and are never drawn; rows that share an id are drawn together; null languages and
    sources are leaves of their own.
    """
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text; a null text counts as empty, repeated rows stay."""
    return token_digests(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mixture),
    ("bpe_tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again before the next; a table goes once the next is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer have no form in SQL; the stages are tested one by one.
ORACLE_SQL = None
