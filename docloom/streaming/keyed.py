"""Keyed states over a stream: first and last versions, rows that come too late, and keys that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.scratch import scratch_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key long, kind string, ts_us long, event_id long, value double, n long"


def _before(a: tuple, b: tuple) -> bool:
    """Order by time, then id; a null id comes last."""
    return (a[0], a[1] is None, a[1] or 0) < (b[0], b[1] is None, b[1] or 0)


class Versions(StatefulProcessor):
    """For each key the first and the last version, by (time, id), of all rows that are not too late.

    Rows ``key ts_us event_id value``. Every batch gives a row ``first`` and a row ``last`` of each key that it changed, and a
    row ``late`` of each row more than ``late_us`` behind the newest of its key, which counts no further. A timer, ``idle_us`` of event
    time after the newest row, gives a row ``closed`` and forgets the key.
    """

    def __init__(self, late_us: int, idle_us: int):
        self.late_us, self.idle_us = late_us, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("versions", "first_us long, first_id long, first_value double, last_us long, last_id long, last_value double, n long")

    def _timer(self, newest_us: int) -> int:
        return (newest_us + self.idle_us) // 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # Every call on state or timers asks the JVM: one read and one write a key and batch, and timers only if they move.
        before = self.state.get()
        newest_before = before[3] if before else None
        first = last = None
        n = 0
        for r in rows:  # in any order
            at = (r["ts_us"], r["event_id"], r["value"])
            if newest_before is not None and at[0] < newest_before - self.late_us:
                yield Row(key=key[0], kind="late", ts_us=at[0], event_id=at[1], value=at[2], n=None)
                continue
            n += 1
            if first is None or _before(at, first):
                first = at
            if last is None or _before(last, at):
                last = at
        if not n:
            return
        if before:
            old_first, old_last, n = tuple(before[:3]), tuple(before[3:6]), n + before[6]
            first = first if _before(first, old_first) else old_first
            last = last if _before(old_last, last) else old_last
        self.state.update((*first, *last, n))
        if last[0] != newest_before:
            if before:
                self.handle.deleteTimer(self._timer(newest_before))
            self.handle.registerTimer(self._timer(last[0]))
        yield Row(key=key[0], kind="first", ts_us=first[0], event_id=first[1], value=first[2], n=n)
        yield Row(key=key[0], kind="last", ts_us=last[0], event_id=last[1], value=last[2], n=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state = self.state.get()
        self.state.clear()
        if state:
            yield Row(key=key[0], kind="closed", ts_us=state[3], event_id=state[4], value=state[5], n=state[6])

    def close(self) -> None:
        pass


def versions(events: DataFrame, late_us: int, idle_us: int, watermark: str = "0 seconds") -> DataFrame:
    """``OUT`` rows of a stream ``key ts event_id value``; rows without a key or a time are left out.

    The watermark moves timers only if it is far behind: rows behind it would be dropped before they could be told apart.
    """
    rows = events.filter("key is not null and ts is not null").withWatermark("ts", watermark).withColumn("ts_us", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithState(Versions(late_us, idle_us), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs until all files that there are have been read; batches replace their own output, so that a restart repeats nothing."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def read_output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{OUT}, batch int").parquet(out)


def newest_of(rows: DataFrame, kind: str) -> DataFrame:
    """The last row of a kind for each key."""
    return rows.filter(F.col("kind") == kind).groupBy("key").agg(F.max_by(F.struct("ts_us", "event_id", "value", "n"), "batch").alias("v")).select("key", "v.*")


def replay(spark: SparkSession, path: str, columns: list[str], files_a_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream of ``key ts event_id value`` (named by ``columns``), some files at a time."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return stream.select(*[F.col(c).alias(n) for c, n in zip(columns, ("key", "ts", "event_id", "value"), strict=True)]).withColumn("ts", F.col("ts").cast("timestamp"))


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared scratch folder."""
    import uuid

    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
