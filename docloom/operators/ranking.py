"""Ranks in an order, without one task for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.scratch import shuffle_width, stage


def ordered_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds the 1-based place within ``keys`` in ``order`` (which must be total).

    Rows are dealt by ranges of (keys, order), so a hot key spreads over many tasks; a place is the
    rows of the key in earlier ranges plus the place within the range.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *by).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    groups = [*keys, "_range"]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    skips = ranged.groupBy(*groups).count().withColumn("_skip", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy(*groups).orderBy(*order)
    placed = ranged.withColumn("_place", F.row_number().over(within))
    skips = skips.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], "_skip")
    on = [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(groups)]
    return placed.join(skips, on).withColumn(name, (F.col("_skip") + F.col("_place")).cast("long")).drop("_range", "_place", "_skip", *[f"_k{i}" for i in range(len(groups))])
