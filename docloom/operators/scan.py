"""Ordered folds and as-of joins as scans over ranges: a key of any size spreads over many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.scratch import shuffle_width, stage


def _starts(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> np.ndarray:
    """Whether each row begins another key than the row before it."""
    out = np.zeros(batch.num_rows, bool)
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= np.asarray(differs)
    out[0] = last is None or tuple(batch.column(k)[0].as_py() for k in keys) != last
    return out


def composed(m: np.ndarray, c: np.ndarray, starts: np.ndarray, modulus: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of x -> m x + c within runs that begin where ``starts`` holds, by doubling."""
    m, c, whole = m.copy(), c.copy(), starts.copy()
    step = 1
    while step < len(m) and not whole.all():
        # ``whole``: the composition reaches back to the start of its run.
        at = np.flatnonzero(~whole[step:]) + step
        before = at - step
        c_new, m_new, done = m[at] * c[before] + c[at], m[at] * m[before], whole[before]
        c[at], m[at] = (c_new % modulus, m_new % modulus) if modulus else (c_new, m_new)
        whole[at] = done
        step *= 2
    return m, c


def running_transform(
    df: DataFrame, keys: list[str], order: list[str], factor: Column, addend: Column, reset: Column | None = None, start: float = 0, modulus: int | None = None, name: str = "state"
) -> DataFrame:
    """Adds the state after each row of its key in ``order`` (total): ``state = state * factor + addend``, from ``start``.

    Where ``reset`` holds the state before the row is ``start`` again. With a ``modulus`` (below 2^31) all are integers and exact,
    else doubles, whose last bits depend on how the rows were grouped. Maps x -> m x + c are associative: each range of (keys,
    order) composes its own, the maps of a key's earlier ranges (at most one a range) give what comes in, and states
    follow. Null factors count as 1, null addends as 0; null keys are a key. Keys may not be floating numbers.
    """
    kind, number = ("long", pa.int64()) if modulus else ("double", pa.float64())
    names, back = [f"_k{i}" for i in range(len(keys))], "_row"
    m, c = F.coalesce(factor, F.lit(1)).cast(kind), F.coalesce(addend, F.lit(0)).cast(kind)
    if modulus:
        m, c = F.pmod(m, F.lit(modulus)), F.pmod(c, F.lit(modulus))
    again = F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)
    # A reset drops what came before it: the map is constant.
    through = F.lit(start).cast(kind) * m + c
    rows = df.select(F.struct(*df.columns).alias(back), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*order).alias("_order"),
                     F.when(again, F.lit(0).cast(kind)).otherwise(m).alias("m"), F.when(again, F.pmod(through, F.lit(modulus)) if modulus else through).otherwise(c).alias("c"))
    dealt = rows.repartitionByRange(shuffle_width(df.sparkSession), *names, "_order").withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*names, "_order")
    row_type = dict(dealt.dtypes)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, nth = None, (1, 0), 0
        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts(b, names, last) if names else np.arange(b.num_rows) + nth == 0
            m, c = (np.array(b.column(x).to_numpy(zero_copy_only=False)) for x in ("m", "c"))
            if not starts[0]:  # a run goes on from the last batch
                m[0], c[0] = m[0] * carry[0], m[0] * carry[1] + c[0]
                if modulus:
                    m[0], c[0] = m[0] % modulus, c[0] % modulus
            whole = starts.copy()
            whole[0] = True
            m, c = composed(m, c, whole, modulus)
            last, carry, nth = tuple(b.column(k)[-1].as_py() for k in names), (m[-1], c[-1]), nth + b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in (back, *names, "_range", "_order")), pa.array(m, number), pa.array(c, number)], [back, *names, "_range", "_order", "m", "c"])

    fields = ", ".join(f"`{x}` {row_type[x]}" for x in (back, *names, "_range", "_order"))
    local = stage(dealt.mapInArrow(prefixes, f"{fields}, m {kind}, c {kind}"), "scan-local")
    groups = [*names, "_range"]
    lasts = local.groupBy(*groups).agg(F.max_by(F.struct("m", "c"), "_order").alias("map"))
    earlier = (Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    step = lambda x, t: F.pmod(t["m"] * x + t["c"], F.lit(modulus)) if modulus else t["m"] * x + t["c"]
    comes_in = lasts.select(*[F.col(g).alias(f"_g{g}") for g in groups], F.aggregate(F.collect_list("map").over(earlier), F.lit(start).cast(kind), step).alias("_in"))
    joined = local.join(comes_in, [F.col(g).eqNullSafe(F.col(f"_g{g}")) for g in groups])
    return joined.select(f"{back}.*", step(F.col("_in"), {"m": F.col("m"), "c": F.col("c")}).alias(name))


def asof_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], left_time: str, right_time: str, values: list[str], tie: list[str] = ()) -> DataFrame:
    """Left rows with the ``values`` of the last right row of their key whose time is not later; null where there is none.

    Both sides are dealt by ranges of (keys, time), so a hot key spreads; a range starts with the last right row of each key
    in the ranges before it. Of right rows at one time the last in ``tie`` counts. Null keys meet nothing, a
    null time has no row before it, and right rows without a time are left out. Left rows stay as often as they occur.
    """
    names = [f"_k{i}" for i in range(len(left_keys))]
    take = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    ties = [F.col(t).alias(f"t{i}") for i, t in enumerate(tie)]
    r = right.filter(F.col(right_time).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(right_keys, names, strict=True)], F.col(right_time).alias("_t"), F.struct(F.lit(1).alias("has"), *ties).alias("_tie"), take.alias("_v"), F.lit(False).alias("_left"))
    r = r.filter(" and ".join(f"{n} is not null" for n in names)) if names else r
    l_ = left.select(*[F.col(k).alias(n) for k, n in zip(left_keys, names, strict=True)], F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(True).alias("_left"))
    both = r.unionByName(l_, allowMissingColumns=True)
    # At one time right rows come first, in the order of their ties.
    by = [*names, "_t", "_left", "_tie"]
    ranged = stage(both.repartitionByRange(shuffle_width(left.sparkSession), *by).withColumn("_range", F.spark_partition_id()), "asof-ranges")
    groups = [*names, "_range"]
    lasts = ranged.filter("not _left").groupBy(*groups).agg(F.max_by("_v", F.struct("_t", "_tie")).alias("_last"))
    # Every range of a key, also those without a right row of it, sees the last one before.
    present = ranged.select(*groups).distinct().join(lasts, groups, "left") if names else ranged.select("_range").distinct().join(lasts, "_range", "left")
    earlier = (Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = present.select(*[F.col(g).alias(f"_g{g}") for g in groups], F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    so_far = Window.partitionBy(*groups).orderBy("_t", "_left", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn("_seen", F.last("_v", ignorenulls=True).over(so_far)).filter("_left")
    joined = seen.join(before, [F.col(g).eqNullSafe(F.col(f"_g{g}")) for g in groups], "left").withColumn("_found", F.when(F.col("_t").isNotNull(), F.coalesce("_seen", "_before")))
    return joined.select("_row.*", *[F.col(f"_found.v{i}").alias(v) for i, v in enumerate(values)])
