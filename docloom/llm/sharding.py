"""Sharding by a minimax contiguous partition.

Documents of equal text form one atomic group. In the order of the groups those larger than an equal
share come first, the largest ahead, and all others follow by a 63-bit hash of their text. Shards are contiguous
in that order: a group larger than an equal share is a shard (no cut can make that shard smaller), and for the rest,
with so many shards less, the smallest capacity for which a greedy sweep needs no more shards is found by
binary search, and the order is cut there, as evenly as that capacity allows.

The driver never sees groups. It holds sums over at most 65,536 hash blocks and splits only those
blocks in which a cut falls, by another 16 bits at a time, so what it collects has a fixed bound.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.scratch import stage

LEVEL_BITS = 16
TOP_SHIFT = 47
MAX_BUCKETS = 4096
ROWS_PER_BUCKET = 2000


@dataclass(frozen=True)
class Block:
    """Groups whose key lies in [lo, hi); ``atomic`` if they are a single group."""

    lo: int
    hi: int
    size: int
    atomic: bool
    shift: int


class GroupOrder:
    """Sizes of groups in key order, as blocks that are split where someone asks for it."""

    def __init__(self, keyed: DataFrame):
        self.keyed = keyed
        self.blocks = self._fetch([None], TOP_SHIFT)

    def _fetch(self, ranges: list[Block | None], shift: int) -> list[Block]:
        df = self.keyed
        if ranges != [None]:
            keep = F.lit(False)
            for b in ranges:
                keep = keep | ((F.col("group_key") >= b.lo) & (F.col("group_key") < b.hi))
            df = df.filter(keep)
        rows = (
            df.groupBy(F.shiftright("group_key", shift).alias("b"))
            .agg(F.sum("size").alias("s"), F.min("group_key").alias("lo"), F.max("group_key").alias("hi"))
            .collect()
        )
        return sorted((Block(r.lo, r.hi + 1, r.s, r.lo == r.hi, shift) for r in rows), key=lambda b: b.lo)

    def split(self, which: set[Block]) -> None:
        """Replace these blocks by their parts, one level finer."""
        for shift in sorted({b.shift for b in which}, reverse=True):
            part = [b for b in which if b.shift == shift]
            gone = set(part)
            finer = self._fetch(part, max(0, shift - LEVEL_BITS))
            self.blocks = sorted([b for b in self.blocks if b not in gone] + finer, key=lambda b: b.lo)


def _sweep(blocks: list[Block], prefix: list[int], cap: int, shards: int) -> tuple[list[int] | None, set[Block]]:
    """Greedy ends (as block indexes) for a capacity, and the blocks that have to be split to be sure."""
    ends, open_blocks, at = [], set(), 0
    for _ in range(shards):
        end = bisect_right(prefix, prefix[at] + cap) - 1
        if end < len(blocks) and not blocks[end].atomic and prefix[at] + cap > prefix[end]:
            open_blocks.add(blocks[end])
        ends.append(end)
        at = end
        if at == len(blocks):
            break
    return (ends if at == len(blocks) else None), open_blocks


def minimax_cuts(order: GroupOrder, n_shards: int) -> tuple[list[int], list[int]]:
    """Keys of groups with a shard of their own, and the first keys of the shards that follow."""
    alone: list[Block] = []
    while True:
        rest = [b for b in order.blocks if b not in alone]
        shards, total = n_shards - len(alone), sum(b.size for b in rest)
        if shards <= 1:
            break
        heavy = [b for b in rest if b.size * shards > total]
        if inner := {b for b in heavy if not b.atomic}:
            order.split(inner)
        elif heavy and len(rest) > 1:
            alone.append(max(heavy, key=lambda b: b.size))
        else:
            break

    def view() -> tuple[list[Block], list[int]]:
        blocks, prefix = [b for b in order.blocks if b not in alone], [0]
        for b in blocks:
            prefix.append(prefix[-1] + b.size)
        return blocks, prefix

    blocks, prefix = view()
    if not blocks or shards <= 1:
        return [b.lo for b in alone], []
    total = prefix[-1]
    lo = max(-(-total // shards), max((b.size for b in blocks if b.atomic), default=0))
    hi = -(-total // shards) + max(b.size for b in blocks)
    while lo < hi:
        cap = (lo + hi) // 2
        ends, open_blocks = _sweep(blocks, prefix, cap, shards)
        if ends is not None:
            hi = cap
        elif open_blocks:
            order.split(open_blocks)
            blocks, prefix = view()
        else:
            lo = cap + 1
    cap = lo

    def latest(at: int) -> int:
        """Last prefix that a shard starting at this prefix may reach, after splitting what is in doubt."""
        nonlocal blocks, prefix
        while True:
            end = bisect_right(prefix, at + cap) - 1
            if end == len(blocks) or blocks[end].atomic or prefix[end] == at + cap:
                return prefix[end]
            order.split({blocks[end]})
            blocks, prefix = view()

    def earliest(at: int) -> int:
        """First prefix from which one shard reaches this prefix."""
        nonlocal blocks, prefix
        while True:
            i = bisect_right(prefix, at - cap - 1)
            if at - cap <= 0:
                return 0
            if blocks[i - 1].atomic or prefix[i] == at - cap:
                return prefix[i]
            order.split({blocks[i - 1]})
            blocks, prefix = view()

    floors = [total]
    for _ in range(shards - 1):
        floors.append(earliest(floors[-1]))
    floors = floors[::-1]  # floors[j]: where shard j may end at the earliest, so that the rest still fits
    cuts, at = [], 0
    for j in range(shards - 1):
        most = latest(at)
        want = min(max(at + (total - at) // (shards - j), floors[j]), most)
        while True:
            i = bisect_right(prefix, want) - 1
            if i == len(blocks) or blocks[i].atomic or prefix[i] == want:
                break
            order.split({blocks[i]})
            blocks, prefix = view()
        near = [p for p in prefix[i : i + 2] if floors[j] <= p <= most] or [most]
        at = min(near, key=lambda p: abs(p - want))
        cuts.append(at)
    starts = [blocks[k].lo if (k := bisect_right(prefix, c) - 1) < len(blocks) else 1 << 63 for c in cuts]
    return [b.lo for b in alone], starts


def shard_documents(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document with its shard and a gapless slot in it, under the law ``bytes``.

    Size is the UTF-8 length of the text plus 1. Null texts count as empty and form one group with
    them. Null or repeated ids keep one row each; slots order rows by id within hash buckets, ties by
    their group. An empty table gives an empty result. Other columns of the input are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("group_key"),
        ),
        "shard-keys",
    )
    alone, starts = minimax_cuts(GroupOrder(keyed), n_shards)
    key = F.col("group_key")
    shard = F.lit(len(alone))
    for s in starts:
        shard = shard + ((key >= s) if s < 1 << 63 else F.lit(False)).cast("int")
    for i, k in reversed(list(enumerate(alone))):
        shard = F.when(key == k, F.lit(i)).otherwise(shard)

    n_buckets = max(1, min(MAX_BUCKETS, -(-keyed.count() // (n_shards * ROWS_PER_BUCKET))))
    placed = keyed.withColumn("shard", shard.cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(n_buckets)).cast("int")
    )
    # At most n_shards * MAX_BUCKETS rows, whatever the input.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "bucket")
        .count()
        .select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "group_key", "size")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("skip") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
