"""Longest common subsequences of long sequences, as tiles of the table of both on a wavefront.

A pair's table of rows (left) and columns (right) is cut into tiles of TILE positions a side. Inside a
tile a row is one integer whose bit is 0 where the length grows by a column, and an addition moves all
columns at once; what a tile hands to the one below are those bits, to the one beside it a carry for
each row. Tiles of one diagonal depend on earlier diagonals only, so that each round computes a
diagonal of all pairs: a pair of any length spreads over tasks and no task holds more than a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.ranking import ordered_rank
from docloom.scratch import stage

#: Positions of a side of a tile.
TILE = 1 << 15
#: Rows of a tile between those that are kept while a path is followed back.
STRIP = 256
#: Positions of a token in a tile from which on its columns are kept as one integer.
OFTEN = 8
#: Tokens of a side up to which a pair is computed whole, in one row of bits.
AT_ONCE = 1 << 15


class _Tile:
    """Rows of left tokens over the bits of right tokens; null tokens (-1) equal nothing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, bits: int, carries: np.ndarray):
        self.left, self.width = left.tolist(), len(right)
        self.full, self.bits, self.carries = (1 << self.width) - 1, bits, carries.tolist()
        order = np.argsort(right, kind="stable")
        tokens, starts = np.unique(right[order], return_index=True)
        self.where: dict = dict(zip(tokens.tolist(), np.split(order, starts[1:]), strict=True)) if len(right) else {}
        self.where.pop(-1, None)
        self.masks: dict[int, int] = {}

    def mask(self, token: int) -> int:
        """The columns of a token."""
        if (known := self.masks.get(token)) is not None:
            return known
        at = self.where.get(token)
        if at is None:
            return 0
        if len(at) < OFTEN:
            return sum(1 << p for p in at.tolist())
        flags = np.zeros(self.width, np.uint8)
        flags[at] = 1
        self.masks[token] = made = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        return made

    def rows(self, start: int, end: int, bits: int) -> Iterator[tuple[int, int]]:
        """Bits after each row, and the carry that leaves it."""
        full, width, mask = self.full, self.width, self.mask
        for i in range(start, end):
            same = bits & mask(self.left[i])
            total = bits + same + self.carries[i]
            bits = total & full | bits ^ same
            yield bits, total >> width

    def run(self) -> tuple[int, np.ndarray, list[int]]:
        """The last bits, all carries, and the bits before each strip."""
        bits, out, kept = self.bits, bytearray(), []
        for i, (row, carry) in enumerate(self.rows(0, len(self.left), bits)):
            if i % STRIP == 0:
                kept.append(bits)
            bits = row
            out.append(carry)
        return bits, np.frombuffer(bytes(out), np.uint8), kept

    def back(self, i: int, j: int) -> tuple[list[tuple[int, int]], int, int]:
        """Matches on the way back from before row i and column j, and where the way leaves the tile.

        Equal tokens match; else the right one goes where the length doesn't need it, else the left one.
        """
        kept = self.run()[2]
        out = []
        while i and j:
            first = (i - 1) // STRIP * STRIP
            strip = [row for row, _ in self.rows(first, i, kept[first // STRIP])]
            while i > first and j:
                same = self.mask(self.left[i - 1])
                j = ((same | ~strip[i - 1 - first]) & ((1 << j) - 1)).bit_length()
                if not j:
                    break
                i -= 1
                if same >> (j - 1) & 1:
                    j -= 1
                    out.append((i, j))
        return out, i, j


def _bits(data: bytes | None, width: int, default: int) -> np.ndarray:
    return np.full(width, default, np.uint8) if data is None else np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:width]


def _tiles(batch: pa.RecordBatch) -> Iterator[tuple[int, _Tile]]:
    for r in range(batch.num_rows):
        a, b = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("a", "b"))
        v, h = batch.column("v")[r].as_py(), batch.column("h")[r].as_py()
        yield r, _Tile(a, b, (1 << len(b)) - 1 if v is None else int.from_bytes(v, "little"), _bits(h, len(a), 0))


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tile's bits and carries out of those that come in, and how many columns the length grows by."""
    for batch in batches:
        v, h, zeros = [], [], []
        for _, tile in _tiles(batch):
            bits, carries, _ = tile.run()
            v.append(bits.to_bytes((tile.width + 7) // 8, "little"))
            h.append(np.packbits(carries, bitorder="little").tobytes())
            zeros.append(tile.width - bits.bit_count())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pair", "ti", "tj")), pa.array(v, pa.binary()), pa.array(h, pa.binary()), pa.array(zeros, pa.int64())], ["pair", "ti", "tj", "v_out", "h_out", "zeros"])


def _backward(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """One row a match, and one that is none and says where in the tile the way leaves it."""
    for batch in batches:
        for r, tile in _tiles(batch):
            pair, ti, tj, i, j = (batch.column(c)[r].as_py() for c in ("pair", "ti", "tj", "i", "j"))
            matches, i, j = tile.back(i, j)
            places = [ti * side + m for m, _ in matches], [tj * side + n for _, n in matches]
            n = len(matches)
            cols = [[pair] * (n + 1), [*places[0], i], [*places[1], j], [True] * n + [False], [ti] * (n + 1), [tj] * (n + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 2, strict=True)], ["pair", "i", "j", "match", "ti", "tj"])


class Sequences:
    """Both sides as blocks of ``tile`` token numbers: ``pair ti a`` and ``pair tj b``, with their pairs' keys.

    ``left`` and ``right`` have ``keys``, a total order ``order`` within them, and ``token``. Null tokens equal nothing,
    null keys meet. Tokens that both sides hold are numbered exactly, by an equi join of the distinct ones.
    """

    def __init__(self, left: DataFrame, right: DataFrame, keys: list[str], order: list[str], token: str, whole: bool, tile: int):
        self.keys = keys
        names = [f"_k{i}" for i in range(len(keys))]
        pick = lambda df: df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(token).alias("_token"))
        orders = [f"_o{i}" for i in range(len(order))]
        sides = [stage(pick(df), "sequence-side") for df in (left, right)]
        counts = [s.groupBy(*names).agg(F.count("*").alias("n")) for s in sides]
        on = [F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) for n in names]
        self.pairs = stage(
            counts[0].alias("x").join(counts[1].alias("y"), on, "full_outer")
            .select(*[F.coalesce(f"x.{n}", f"y.{n}").alias(n) for n in names], F.coalesce("x.n", F.lit(0)).alias("n_left"), F.coalesce("y.n", F.lit(0)).alias("n_right"))
            .withColumn("pair", F.monotonically_increasing_id()),
            "sequence-pairs",
        )
        both = self.pairs.filter("n_left > 0 and n_right > 0").select(*names, "pair")
        keyed = []
        for s in sides:
            meet = [F.col(f"s.{n}").eqNullSafe(F.col(f"p.{n}")) for n in names]
            keyed.append(s.alias("s").join(both.alias("p"), meet).select("p.pair", *[f"s.{o}" for o in orders], "s._token"))
        ranked = [stage(ordered_rank(k, ["pair"], orders, "_rank").select("pair", "_rank", "_token"), "sequence-rank") for k in keyed]
        tokens = [r.filter("_token is not null").groupBy("pair", "_token").agg(F.min("_rank").alias("id")) for r in ranked]
        shared = stage(tokens[0].join(tokens[1].select("pair", "_token"), ["pair", "_token"], "left_semi"), "shared-tokens")
        self.blocks = []
        for r, (block, name) in zip(ranked, (("ti", "a"), ("tj", "b")), strict=True):
            rows = r.join(shared, ["pair", "_token"], "left" if whole else "inner").select("pair", (F.col("_rank") - 1).alias("at"), F.coalesce("id", F.lit(-1)).alias("id"))
            if not whole:  # tokens of one side alone are in no common sequence
                rows = ordered_rank(rows, ["pair"], ["at"], "_kept").select("pair", (F.col("_kept") - 1).alias("at"), "id")
            tokens_of = F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias(name)
            self.blocks.append(stage(rows.groupBy("pair", F.floor(F.col("at") / tile).alias(block)).agg(tokens_of), "sequence-blocks"))

    def named(self, df: DataFrame) -> DataFrame:
        """With the columns of keys in place of ``pair``."""
        out = df.join(self.pairs.drop("n_left", "n_right"), "pair").drop("pair")
        names = [f"_k{i}" for i in range(len(self.keys))]
        return out.select(*[F.col(n).alias(k) for n, k in zip(names, self.keys, strict=True)], *[c for c in out.columns if c not in names])

    def tiles(self) -> DataFrame:
        """``pair ti tj v_out h_out zeros`` of every tile, diagonal by diagonal."""
        a, b = self.blocks
        ends = a.groupBy("pair").agg(F.max("ti").alias("m")).join(b.groupBy("pair").agg(F.max("tj").alias("n")), "pair")
        last = ends.agg(F.max(F.col("m") + F.col("n"))).first()[0]
        done = None
        for d in range(0 if last is None else last + 1):
            work = a.join(b, ["pair"]) if last == 0 else a.join(b.withColumn("ti", d - F.col("tj")), ["pair", "ti"])
            if done is None:
                work = work.withColumns({"v": F.lit(None).cast("binary"), "h": F.lit(None).cast("binary")})
            else:
                above = done.select("pair", (F.col("ti") + 1).alias("ti"), "tj", F.col("v_out").alias("v"))
                beside = done.select("pair", "ti", (F.col("tj") + 1).alias("tj"), F.col("h_out").alias("h"))
                work = work.join(above, ["pair", "ti", "tj"], "left").join(beside, ["pair", "ti", "tj"], "left")
            work = work.select("pair", "ti", "tj", "a", "b", "v", "h").repartition("pair", "ti", "tj")
            now = stage(work.mapInArrow(_forward, "pair long, ti long, tj long, v_out binary, h_out binary, zeros long"), "tiles")
            yield now
            done = now


def lcs_lengths(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], token: str, tile: int = TILE) -> DataFrame:
    """``keys n_left n_right lcs`` of all keys of either side: the exact length of a longest common subsequence."""
    s = Sequences(left, right, keys, order, token, whole=False, tile=tile)
    bottoms = s.blocks[0].groupBy("pair").agg(F.max("ti").alias("ti"))
    total = None
    for tiles in s.tiles():  # zeros of the lowest row of tiles
        part = tiles.select("pair", "ti", "zeros").join(bottoms, ["pair", "ti"]).select("pair", "zeros")
        total = part if total is None else total.unionByName(part)
    found = s.pairs.select("pair", "n_left", "n_right")
    if total is None:
        return s.named(found.withColumn("lcs", F.lit(0).cast("long")))
    return s.named(found.join(total.groupBy("pair").agg(F.sum("zeros").alias("lcs")), "pair", "left").withColumn("lcs", F.coalesce("lcs", F.lit(0))))


def _length(a: list, b: list) -> int:
    """Of two lists without nulls, by a row of bits over the longer one."""
    if len(a) > len(b):
        a, b = b, a
    both = set(a) & set(b)
    a, b = [t for t in a if t in both], [t for t in b if t in both]
    if not a:
        return 0
    width, where = len(b), {}
    for i, t in enumerate(b):
        where.setdefault(t, []).append(i)
    masks = {}
    for t, at in where.items():
        if len(at) < OFTEN:
            masks[t] = sum([1 << p for p in at])
        else:
            flags = np.zeros(width, np.uint8)
            flags[at] = 1
            masks[t] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    bits = full = (1 << width) - 1
    for t in a:
        same = bits & masks[t]
        bits = bits + same & full | bits ^ same
    return width - bits.bit_count()


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [pc.fill_null(batch.column(c), []) if batch.column(c).null_count else batch.column(c) for c in ("_a", "_b")]
        ends = [np.concatenate(([0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False)))).tolist() for x in lists]
        tokens = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()
        first, out = ends[0][-1], []
        for r in range(batch.num_rows):
            a, b = tokens[ends[0][r] : ends[0][r + 1]], tokens[first + ends[1][r] : first + ends[1][r + 1]]
            out.append(_length([t for t in a if t >= 0], [t for t in b if t >= 0]))
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in ("_a", "_b")), pa.array(out, pa.int64())], [*(n for n in batch.schema.names if n not in ("_a", "_b")), "lcs"])


def lcs_lengths_of(left: DataFrame, right: DataFrame, keys: list[str], tokens: str, at_once: int = AT_ONCE) -> DataFrame:
    """``lcs_lengths`` of sequences that are arrays ``tokens`` of a row each: a pair moves as the two arrays.

    Pairs above ``at_once`` tokens a side, and keys that a side holds twice, are taken apart and go by tiles; the tokens
    of a key's rows then stand by their places in the arrays. Null and empty arrays are no sequence.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    sides = [df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(tokens).alias("_t")) for df in (left, right)]
    meet = lambda x, y: [F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}")) for n in names]
    held = [s.select(*names, F.lit(i).alias("_side")) for i, s in enumerate(sides)]
    often = stage(held[0].unionByName(held[1]).groupBy(*names, "_side").count().filter("count > 1").select(*names).distinct(), "sequence-often")
    once, apart = sides, []
    if not often.isEmpty():
        once = [s.alias("s").join(often.alias("o"), meet("s", "o"), "left_anti") for s in sides]
        apart = [[s.alias("s").join(often.alias("o"), meet("s", "o"), "left_semi") for s in sides]]
    a, b = (s.filter(F.size("_t") > 0) for s in once)
    sizes = [F.greatest(F.size(c), F.lit(0)).cast("long") for c in ("x._t", "y._t")]
    both = stage(
        a.alias("x").join(b.alias("y"), meet("x", "y"), "full_outer")
        .select(*[F.coalesce(f"x.{n}", f"y.{n}").alias(n) for n in names], F.coalesce(sizes[0], F.lit(0)).alias("n_left"), F.coalesce(sizes[1], F.lit(0)).alias("n_right"), F.col("x._t").alias("_a"), F.col("y._t").alias("_b")),
        "sequence-pairs",
    )
    long = (F.col("n_left") > at_once) | (F.col("n_right") > at_once)
    if not both.filter(long).isEmpty():
        apart.append([both.filter(long).select(*names, F.col(c).alias("_t")) for c in ("_a", "_b")])
    kinds = ", ".join(f"{n} {both.schema[n].dataType.simpleString()}" for n in names)
    out = both.filter(~long).mapInArrow(_lengths, f"{kinds}, n_left long, n_right long, lcs long")
    for sides in apart:
        out = out.unionByName(lcs_lengths(*[s.select(*names, F.posexplode("_t").alias("_pos", "_token")) for s in sides], names, ["_pos"], "_token"))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "n_left", "n_right", "lcs")


def lcs_matches(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], token: str, tile: int = TILE) -> DataFrame:
    """``keys left_place right_place`` (from 0, within keys) of one longest common subsequence.

    Of several the one that a walk from the ends finds: equal tokens match; else the right one is dropped unless
    that shortens the rest, else the left one. Keys of one side alone, and empty tables, give no rows.
    """
    s = Sequences(left, right, keys, order, token, whole=True, tile=tile)
    rounds = list(s.tiles())
    found = None
    if rounds:
        states = rounds[0]
        for r in rounds[1:]:
            states = states.unionByName(r)
        a, b = s.blocks
        above = states.select("pair", (F.col("ti") + 1).alias("ti"), "tj", F.col("v_out").alias("v"))
        beside = states.select("pair", "ti", (F.col("tj") + 1).alias("tj"), F.col("h_out").alias("h"))
        at = a.withColumn("i", F.size("a").cast("long")).groupBy("pair").agg(F.max_by(F.struct("ti", "i"), "ti").alias("x"))
        to = b.withColumn("j", F.size("b").cast("long")).groupBy("pair").agg(F.max_by(F.struct("tj", "j"), "tj").alias("y"))
        way = stage(at.join(to, "pair").select("pair", "x.ti", "y.tj", "x.i", "y.j"), "tile-way")
        while True:
            work = way.join(a, ["pair", "ti"]).join(b, ["pair", "tj"]).join(above, ["pair", "ti", "tj"], "left").join(beside, ["pair", "ti", "tj"], "left")
            work = work.select("pair", "ti", "tj", "i", "j", "a", "b", "v", "h").repartition("pair")
            step = stage(work.mapInArrow(lambda batches: _backward(batches, tile), "pair long, i long, j long, match boolean, ti long, tj long"), "tile-matches")
            some = step.filter("match").select("pair", F.col("i").alias("left_place"), F.col("j").alias("right_place"))
            found = some if found is None else found.unionByName(some)
            # A way that leaves by its upper or left edge goes on at the end of the next tile there.
            up, side = F.col("i") == 0, F.col("j") == 0
            on = step.filter("not match").select(
                "pair", F.when(up, F.col("ti") - 1).otherwise(F.col("ti")).alias("ti"), F.when(side, F.col("tj") - 1).otherwise(F.col("tj")).alias("tj"),
                F.when(up, F.lit(tile)).otherwise(F.col("i")).cast("long").alias("i"), F.when(side, F.lit(tile)).otherwise(F.col("j")).cast("long").alias("j"),
            ).filter("ti >= 0 and tj >= 0")
            way = stage(on, "tile-way")
            if way.isEmpty():
                break
    if found is None:
        found = s.pairs.select("pair", F.lit(0).cast("long").alias("left_place"), F.lit(0).cast("long").alias("right_place")).limit(0)
    return s.named(found)
