"""Streaming forms of the revision operators (an extension: sources of the library are batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window under a watermark, for append or update mode."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
    )


def latest_wins(events: DataFrame, time: str, keys: list[str], order: list[str], values: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The newest values of each key and window; state is bounded by the watermark."""
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(newest).select(F.col("window.start").alias("start"), *keys, *[F.col(f"v.{v}").alias(v) for v in values])


def sliding_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", slide: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Counts by windows that overlap."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by sessions: events of a key of which each follows the one before within the gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One event of each key; state goes when the watermark has passed it. On a batch: the earliest."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(time)).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])
