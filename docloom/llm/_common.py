"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.scratch import discard, stage


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a few MB, so that long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


_CACHES: dict[str, Callable[[], None]] = {}


def claim_cache(name: str, clear: Callable[[], None]) -> None:
    """A Python worker serves many tasks: whoever fills a cache first empties those of other operators."""
    others = [k for k in _CACHES if k != name]
    for other in others:
        _CACHES.pop(other)()
    if others:
        trim()
    _CACHES[name] = clear


def trim() -> None:
    """Give freed memory back to the machine: idle workers stay while other stages run."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def off_driver(spark: SparkSession, work: Callable[[], object]) -> object:
    """What ``work()`` gives, computed in one Python worker; input and result have to be bounded.

    Beside the driver runs a JVM, and threaded linear algebra may not come back from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work())], pa.binary())], ["result"])

    return pickle.loads(bytes(spark.range(0, 1, 1, 1).mapInArrow(run, "result binary").first().result))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the runs [start, start + len), in order."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    return shift + np.arange(total)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node component``: smallest node reachable over undirected ``edges(a, b)``, by contraction.

    In a round every node hooks to the first of itself and its neighbours by hash and follows that once;
    edges between what is left are the next round's, so that all rounds together make little more rows than there are
    edges. Labels are tables; no part of the graph is collected. Hot nodes are pre-aggregated map-side, and joins on them
    start from files so that the skew join can split them. Nodes without an edge do not appear.
    """
    open_ = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges")
    steps: list[DataFrame] = []
    while True:
        ends = open_.select("a", "b").union(open_.select("b", "a"))
        # By hash, as chains of rising ids would be followed link by link.
        first = F.min(F.least(F.struct(F.xxhash64("a"), "a"), F.struct(F.xxhash64("b"), F.col("b").alias("a"))))["a"]
        hooks = stage(ends.groupBy("a").agg(first.alias("up")).select(F.col("a").alias("node"), "up"), f"{label}-hooks")
        steps.append(stage(hooks.join(hooks.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root"), f"{label}-step"))
        root = steps[-1].withColumnRenamed("root", "r")
        moved = open_.join(root.withColumnRenamed("node", "a"), "a").select("b", F.col("r").alias("x")).join(root.withColumnRenamed("node", "b"), "b")
        left = stage(moved.filter("x <> r").select(F.least("x", "r").alias("a"), F.greatest("x", "r").alias("b")).distinct(), f"{label}-edges")
        discard(open_, hooks)  # superseded
        open_ = left
        if open_.isEmpty():
            break
    # Roots of a round are nodes of later ones as long as they have edges.
    roots = steps[-1]
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("r"))
        roots = step.join(later, "root", "left").select("node", F.coalesce("r", "root").alias("root"))
    roots = stage(roots, f"{label}-roots")
    low = roots.groupBy("root").agg(F.min("node").alias("component"))
    labels = stage(roots.join(low, "root").select("node", "component"), f"{label}-labels")
    discard(open_, roots, *steps)
    return labels


def joined(labels: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """``node component`` after further ``links(a, b)`` between nodes of ``labels``: only what these connect is labelled anew."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    between = links.join(at("a"), "a").join(at("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    new = components(between, label).select(F.col("node").alias("component"), F.col("component").alias("low"))
    return stage(labels.join(new, "component", "left").select("node", F.coalesce("low", "component").alias("component")), f"{label}-joined")


def ranked_within(df: DataFrame, key: str, order: list[str], count: str, per_bucket: int, max_buckets: int) -> DataFrame:
    """Adds ``rank``: gapless from 0 within ``key``, of which a value may hold any share of the rows.

    Rows are dealt to hash buckets within a key; ranks are a bucket's offset plus a place in it.
    ``count``: rows of the largest key, as text for the bucket count.
    """
    n = max(1, min(max_buckets, -(-int(count) // per_bucket)))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    skips = dealt.groupBy(key, "bucket").count().select(key, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy(key, "bucket").orderBy(*order)
    return (
        dealt.withColumn("place", F.row_number().over(within))
        .join(skips, [key, "bucket"])
        .withColumn("rank", (F.col("skip") + F.col("place") - 1).cast("long"))
        .drop("place", "skip", "bucket")
    )
