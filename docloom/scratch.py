"""Shared scratch tables: the place where long plans are cut.

``stage`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back, so that
later jobs (and retries after an executor is lost) start from files that every executor can see.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_APPS: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only for a local master without a setting."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/") + "/docloom"
    if spark.sparkContext.master.startswith("local"):
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="docloom-")
            atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
        return "file://" + _LOCAL["dir"]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_docloom_scratch"


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared scratch folder and return it read back, with its lineage cut."""
    spark = df.sparkSession
    app = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}"
    if app not in _APPS:
        _APPS.add(app)
        atexit.register(_delete, spark, app)
    path = f"{app}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again. Others, and those that are left, go when the program ends."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            _delete(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):  # what the last job still holds goes a moment after it has ended
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
