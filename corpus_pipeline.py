"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

All stages but the last return the columns that they got, whatever else they are called besides doc_id, text, lang and source; rows of any null
column, repeated rows and very long texts are rows like others; an empty table gives an empty result, of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillion.llm import langid, mixing, packing, pii, simhash
from quillion.llm.queries import vocabulary
from quillion.llm.shared import noting, remove, stash

#: Tables that the last stage to run has written for itself.
_own_tables: list[str] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(function: Stage) -> Stage:
    """A stage's result is written before the next stage begins, so what it was made of can go then."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _own_tables)
        with noting(_own_tables):
            return function(spark, docs, sf_dir)

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined: null and empty texts and those without a letter, or all if nothing could be
    learned. Very long texts are scored whole; ties of languages matter to no row; a null lang or doc_id is just not learned from."""
    return langid.accepted(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest doc_id (null last); of equal ids and texts one
    row. Null, empty and blank texts are one group; very long texts are compared whole."""
    return simhash.representatives(docs)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and the terms that give it away, in the texts; n_chars follows. Every row stays: a null text null, an empty
    one empty, repeated rows each; of overlapping finds the first one's mark stands."""
    return pii.sanitise(docs)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their sources' targets say, in the order of the schedule; the last one of a source is cut to fit and
    n_chars follows. Null and blank texts have no words and are not taken; a null source is a source; ties go by hash."""
    return mixing.mixed_documents(docs)


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents into pieces and packs them into sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    null or empty text is its closing id; copies of a document are packed each."""
    return packing.pack(packing.cut_documents(docs, vocabulary()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL can express none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results: list[str] = []
    for name, stage in STAGES[:-1]:
        read = list(results)
        results.clear()
        made = stage(spark, docs, sf_dir)
        with noting(results):
            docs = stash(made, name)
        remove(spark, read)  # the next stage reads this one's result alone
    return STAGES[-1][1](spark, docs, sf_dir)
