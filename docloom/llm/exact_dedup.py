"""Exact dedup by content-defined chunk recipes.

A text is normalised and cut into chunks at places that its own words define. Chunks are
deduplicated to identifiers, and each identifier is verified: all chunks that carry it have the same length and the same
longer digest. A document is then its ordered list of identifiers, about 3 % of its bytes; equal lists
are equal texts, so documents meet as lists and no text ever moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.scratch import stage

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: At least 1,024 characters, then up to the next word gap of a certain kind; 4,096 at most.
CHUNK = r"(?s).{1024,4095}?(?<=[a-z])\x20(?=[a-h])|.{1,4096}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def chunks_of(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def group_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id keep_id group_size kept text_sha256`` and ``row_id``.

    Nulls count as empty texts. The row with the smallest id stays; rows with a null id come last,
    and of rows that repeat an id with the same text exactly one stays. Texts of any length are cut
    into chunks of at most 4,096 characters. An empty table gives an empty result.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    recipes = stage(
        norm.withColumn("chunks", chunks_of(F.col("norm"))).select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            F.array_join(F.transform("chunks", F.md5), "").alias("recipe"),
            F.transform("chunks", lambda c: F.struct(F.unhex(F.md5(c)).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest"), F.length(c).alias("n"))).alias("parts"),
        ),
        "recipes",
    )
    if not chunks_verified(recipes):
        # Two chunks share an identifier: lists can't be trusted, so the texts themselves are the lists.
        recipes = stage(
            norm.select(
                F.monotonically_increasing_id().alias("row_id"),
                "doc_id",
                F.sha2("norm", 256).alias("text_sha256"),
                F.col("norm").alias("recipe"),
            ),
            "recipes",
        )
    groups = stage(
        recipes.groupBy("recipe").agg(
            F.min(F.struct(F.isnull("doc_id").alias("n"), "doc_id", "row_id")).alias("first"),
            F.count("*").alias("group_size"),
        ),
        "recipe-groups",
    )
    # Both sides come straight from files, so a hot recipe's partition can be split by the skew join.
    return recipes.join(groups, "recipe").select(
        F.col("row_id"),
        F.col("doc_id"),
        F.col("first.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        "text_sha256",
    )


def chunks_verified(recipes: DataFrame) -> bool:
    """Whether chunks with the same identifier are the same chunk, over all chunks of all documents.

    Compared are their lengths and 256-bit digests, reduced to their extremes before they are shuffled.
    """
    part = recipes.select(F.explode("parts").alias("p")).select("p.id", F.struct("p.digest", "p.n").alias("what"))
    return part.groupBy("id").agg((F.min("what") != F.max("what")).alias("differs")).filter("differs").isEmpty()


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return group_exact(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
