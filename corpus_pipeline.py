"""From raw documents to training sequences, as stages that each call one operator of docloom.llm.

Every stage gets what its predecessor kept, written as Parquet and read again. All but the last
return the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, ngram_join, packing, secret_scan, toxicity
from docloom.llm._common import fresh
from docloom.scratch import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches the threshold; empty and null texts stay, and so do their columns.

    Rows that repeat an id are scored by their own texts. An empty table stays empty.
    """
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the row with the smallest id stays, once.

    Null and empty texts are copies of each other. A row without an id stays only if no copy has one; of rows that
    repeat an id with the same text one stays. Other columns come along as they are.
    """
    # An id and a digest as one key: joined and deduplicated by it, the texts move once.
    name = fresh(docs, "copy_key")
    kept = exact_dedup.group_exact(docs).filter("kept").select(F.concat_ws("|", "doc_id", "text_sha256").alias(name))
    keyed = docs.withColumn(name, F.concat_ws("|", "doc_id", F.sha2(exact_dedup.normalised(F.col("text")), 256)))
    return keyed.join(kept.hint("merge"), name, "left_semi").dropDuplicates([name]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest id stays; null ids always do.

    Rows that share an id are kept or dropped together. Texts without words link with nothing and stay.
    """
    found = ngram_join.ngram_components(docs, words=5, percent=80)
    gone = found.filter("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    stays = found.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(gone.join(stays, "doc_id", "left_anti").hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark; every document stays, with its length counted anew. Null texts stay null."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of at most 4,096 tokens; a null or empty text is its end id alone.

    Rows that repeat an id, or have none, are packed each. An empty table gives no pieces; other columns are left out.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: Forests of conditional random fields, similarity graphs and linear programs are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
