"""Incremental maintenance: last-writer states and grouped summaries under inserts and retractions.

Rows carry a count (``_n``: 1 inserted, -1 retracted), and every view is linear in them: a batch of
revisions touches some keys, whose old and new states differ by a few rows with counts, and those
rows are all that the summary above has to add up. Each table is a folder of batches, so that a
batch only appends, and its files lie in buckets of keys, so that a batch reads its own buckets only.
A batch that is written again, after a failure, replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.scratch import stage

BUCKETS = 64


class LastWriter:
    """The newest version of each key, and counts and sums of them by group.

    ``keys`` name a row, ``order`` (total within a key) says which version is newest, ``values`` are the others; ``group`` and ``amount``
    are expressions over these for the summary. State lies below ``path``, in a folder that all executors see.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], values: list[str], group: Column, amount: Column, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self.keys, self.order, self.values, self.group, self.amount = keys, order, values, group, amount
        self.columns = [*keys, *order, *[v for v in values if v not in order]]

    def _exists(self, table: str) -> bool:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there)

    def _read(self, table: str, before: int) -> DataFrame | None:
        """All batches of a table before one."""
        if not self._exists(table):
            return None
        types = {"versions": f"{self.schema}, _n long, batch int, bucket int", "summary": f"`group` {self._group_type()}, n long, amount double, batch int"}
        return self.spark.read.schema(types[table]).parquet(f"{self.path}/{table}").filter(F.col("batch") < before)

    def _group_type(self) -> str:
        return dict(self.spark.createDataFrame([], self.schema).select(self.group.alias("g")).dtypes)["g"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _newest(self, versions: DataFrame) -> DataFrame:
        """Each key's newest version of those whose counts add up to more than none."""
        live = versions.groupBy(*self.columns).agg(F.sum("_n").alias("_n")).filter("_n > 0")
        rest = [c for c in self.columns if c not in self.keys]
        return live.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_v")).select(*self.keys, *[F.col(f"_v.{c}").alias(c) for c in rest])

    def touched(self, batch: int, changes: DataFrame) -> DataFrame | None:
        """Earlier versions of the keys of a batch, from its buckets alone."""
        past = self._read("versions", batch)
        if past is None:
            return None
        buckets = [r.bucket for r in changes.select("bucket").distinct().collect()]  # at most self.buckets
        keys = changes.select(*self.keys).distinct()
        return past.filter(F.col("bucket").isin(buckets)).join(keys, self.keys, "left_semi")

    def apply(self, batch: int, changes: DataFrame) -> DataFrame:
        """Adds a batch (columns of the schema and ``_n``) and returns what it changes: newest versions gone (-1) and come (1).

        Retracting a version brings the one before it back; retractions that come before their insertion cancel
        with it. Batches are numbered upwards from 0 and given once each, or again after a failure.
        """
        new = stage(changes.select(*self.columns, F.col("_n").cast("long").alias("_n")).groupBy(*self.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").withColumn("bucket", self._bucket()), "delta-changes")
        past = self.touched(batch, new)
        after = new.select(*self.columns, "_n")
        if past is not None:
            past = past.select(*self.columns, "_n")
            after = after.unionByName(past)
        moved = self._newest(after).withColumn("_n", F.lit(1).cast("long"))
        if past is not None:
            moved = moved.unionByName(self._newest(past).withColumn("_n", F.lit(-1).cast("long")))
        # Equal rows gone and come are no change.
        moved = stage(moved.groupBy(*self.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0"), "delta-newest")
        amount = moved.select(self.group.alias("group"), (self.amount * F.col("_n")).alias("_a"), "_n").groupBy("group").agg(F.sum("_n").alias("n"), F.sum("_a").cast("double").alias("amount"))
        amount.write.mode("overwrite").parquet(f"{self.path}/summary/batch={batch}")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/versions/batch={batch}")
        return moved

    def newest(self) -> DataFrame:
        """The whole state, from all batches."""
        past = self._read("versions", 1 << 30)
        return self._newest(self.spark.createDataFrame([], f"{self.schema}, _n long") if past is None else past.select(*self.columns, "_n"))

    def summary(self) -> DataFrame:
        """``group n amount`` over the newest versions, by adding up what the batches changed."""
        past = self._read("summary", 1 << 30)
        if past is None:
            return self.spark.createDataFrame([], f"`group` {self._group_type()}, n long, amount double")
        return past.groupBy("group").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")).filter("n > 0")
