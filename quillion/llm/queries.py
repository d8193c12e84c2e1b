"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, mixing, packing, pii, search, simhash, tokens, urls, vectors

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary(), ["doc_id"])


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.rules_frame(spark, urls.RULES))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = mixing.mix(mixing.sizes(_table(spark, sf_dir, "documents")))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_documents(_table(spark, sf_dir, "documents"), vocabulary()))


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.quantised(_table(spark, sf_dir, "embeddings"))
    return search.nearest(rows, search.stated_queries(rows, 50), 5)


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(langid.remainder() == 2, F.lit(False)))
    return langid.identify(docs, langid.fit(docs), ["doc_id", "held_out"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_licenses, op2_pii, op3_tokens, op4_urls, op5_mixing, op6_packing, op7_search, op8_vectors, op9_simhash, op10_langid, pipeline)}


def oracle_sql() -> dict:
    return {"op4_urls": urls.ORACLE, "op5_mixing": mixing.ORACLE, "op7_search": search.ORACLE, "op8_vectors": vectors.ORACLE}
