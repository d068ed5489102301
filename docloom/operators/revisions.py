"""Append-only revisions: last writer wins, states as of a point, and their bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.scratch import shuffle_width, stage


def latest_wins(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key; partial maxima keep a hot key cheap."""
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])


def as_of(df: DataFrame, keys: list[str], order: list[str], values: list[str], until: Column) -> DataFrame:
    return latest_wins(df.filter(until), keys, order, values)


def first_wins(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("v")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])


def bounds(df: DataFrame, keys: list[str], order: list[str], end: str, start: str) -> DataFrame:
    """Each row's end together with its predecessor's, from which it starts; null for the first of a key.

    Rows are dealt by ranges of (keys, order), so a hot key spreads over many tasks; the first row of
    a key in a range starts where the key's last row in an earlier range ends.
    """
    ranged = stage(df.repartitionByRange(shuffle_width(df.sparkSession), *keys, *order).withColumn("_range", F.spark_partition_id()), "bounds")
    groups = [*keys, "_range"]
    lasts = ranged.groupBy(*groups).agg(F.max_by(end, F.struct(*order)).alias("_last"))
    before = lasts.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")))
    before = before.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], "_before")
    within = Window.partitionBy(*groups).orderBy(*order)
    placed = ranged.withColumns({"_first": F.row_number().over(within) == 1, "_lag": F.lag(end).over(within)})
    on = [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(groups)]
    found = placed.join(before, on).withColumn(start, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")))
    return found.drop("_range", "_first", "_lag", "_before", *[f"_k{i}" for i in range(len(groups))])
