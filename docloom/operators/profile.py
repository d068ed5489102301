"""Profiles of texts and pages before anything is parsed further."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_profile(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Documents, text bytes, the longest text, and whether there is any text, for each value of ``by``."""
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(t).cast("long")
    return df.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum(size).alias("text_bytes"), F.max(size).alias("longest"), F.bool_or(t != "").alias("has_text"))
