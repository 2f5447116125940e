"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originline.llm import (
    collocations, decontaminate, embedding_dedup, filter_audit, fingerprint, language, licenses, mixing, ngram_join, pages, quality,
    shards, tokens,
)
from originline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_language")
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the three quarters not held out."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"))
    model = language.train(docs.where("doc_id is not null and not held_out"))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in every document."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_shards")
def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document under the law of equal bytes."""
    return shards.assign_shards(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("op4_licenses")
def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in every document, with their best containment."""
    return licenses.scan(table(spark, folder, "documents"))


@query("op5_mixing", mixing.ORACLE_SQL)
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that the weighted mix of sources takes."""
    return mixing.mix(table(spark, folder, "documents"))


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Multiset fingerprint of every document and of its edited text."""
    return fingerprint.fingerprints(table(spark, folder, "documents"))


@query("op7_ngram_join", ngram_join.ORACLE_SQL)
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of shingle sets."""
    return ngram_join.link_components(table(spark, folder, "documents"))


@query("op8_tokens")
def op8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the word-end byte-pair vocabulary."""
    docs = table(spark, folder, "documents")
    return tokens.token_counts(docs, tokenizer_path("word_bpe_49k.json"))


@query("op9_quality")
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality verdict on every document, learned from the label table."""
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_pages")
def op10_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, folder, "pages"))


@query("op11_collocations", collocations.ORACLE_SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of every language whose words keep together, by their weakest cut."""
    return collocations.collocations(table(spark, folder, "documents"))


@query("op12_filter_audit", filter_audit.ORACLE_SQL)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove in every order, by source, from a stream over the documents' files."""
    return filter_audit.audit(spark, f"{folder}/documents.parquet", table(spark, folder, "labels"))


@query("op13_embedding_dedup", embedding_dedup.ORACLE_SQL)
def op13_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector under a cosine of 0.95."""
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))
