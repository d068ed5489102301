"""Document differences: keyed, positional, banded, greedy and sequence-aligned matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.scratch import stage


#: Pairs of pages that a task holds as Python objects at a time.
PAGES_AT_ONCE = 500
#: Candidates of ``band_match`` that a part of a cell meets, about.
CELL_PAIRS = 1 << 22


def keyed_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join on the keys with ``category``: added, removed, modified or equal."""
    a = left.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_r"))
    kind = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "equal").otherwise("modified")
    return a.join(b, keys, "full_outer").withColumn("category", kind).drop("_l", "_r")


def added(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return right.join(left.select(*keys).distinct(), keys, "left_anti")


def removed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def band_match(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], a: str, b: str, tolerance: float) -> DataFrame:
    """Pairs with |a - b| < tolerance: an equi join on cells as wide as the tolerance and their neighbours.

    There may be many more pairs than rows, so rows are dealt by cells whatever the size of the tables, and the left rows of a
    cell into parts, each of which meets about CELL_PAIRS candidates. Nulls meet nothing.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    keys = [*[f"_k{i}" for i in range(len(equal))], "_cell"]

    def side(df: DataFrame, i: int, cells: Column, *more: Column) -> DataFrame:
        return stage(df.select("*", *[F.col(e[i]).alias(k) for e, k in zip(equal, keys, strict=False)], cells.alias("_cell"), *more).dropna(subset=keys), "band-cells")

    x = side(left, 0, cell(a), F.monotonically_increasing_id().alias("_id"))
    y = side(right, 1, F.explode(F.array(cell(b) - 1, cell(b), cell(b) + 1)))
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    hot = stage(count(x, "_n").join(count(y, "_m"), keys).select(*keys, F.ceil(F.col("_n") * F.col("_m") / CELL_PAIRS).alias("_parts")).filter("_parts > 1"), "band-parts")
    parts = F.coalesce("_parts", F.lit(1))
    x = x.join(hot, keys, "left").withColumn("_part", F.pmod("_id", parts)).drop("_parts", "_id")
    y = y.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    pairs = x.hint("merge").join(y, [*keys, "_part"]).filter(F.abs(F.col(a) - F.col(b)) < tolerance)
    return pairs.select(*left.columns, *right.columns)


def moved(items: DataFrame, digest: Column, item: str, other: str) -> DataFrame:
    """Each later copy of the same bytes with the first place where they stood."""
    keyed = items.withColumn("_digest", digest)
    # From a written table, so that the skew join can split the copies of one text.
    firsts = stage(keyed.groupBy("_digest").agg(F.min(item).alias(other)), "first-places")
    return keyed.join(firsts, "_digest").filter(F.col(item) > F.col(other)).drop("_digest")


def best_match(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """For each right row the left row of the best score, the smaller one of equals."""
    best = F.max_by(F.struct(left, score), F.struct(F.col(score), -F.col(left))).alias("_b")
    return pairs.groupBy(right).agg(best).select(right, f"_b.{left}", f"_b.{score}")


@dataclass(frozen=True)
class CompareOptions:
    ignore_case: bool = False
    ignore_space: bool = False
    tolerance: float = 5.0
    detect_moves: bool = True
    sensitivity: str = "normal"
    #: What of two texts at one place is compared: element (the texts), word (their words), char (their characters).
    granularity: str = "element"
    #: How far apart the same text may stand and count as moved; None: any distance.
    move_distance: float | None = None
    #: Metadata fields and kinds of differences that don't count.
    ignore_metadata: tuple[str, ...] = ()
    ignore_kinds: tuple[str, ...] = ()


ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text: str, o: CompareOptions) -> str:
    if o.ignore_case:
        text = text.translate(ASCII_LOWER)
    return "".join(text.split(" ")).translate(str.maketrans("", "", "\t\r\n")) if o.ignore_space else text


def plain_case(text: str, o: CompareOptions) -> str:
    return text.translate(ASCII_LOWER) if o.ignore_case else text


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs; of equal moves back, the one that drops from b.

    Rows of the table are vectors: with c = matches or the row above, a prefix maximum gives the row,
    so it takes len(a) vector steps. Common ends are set aside first.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    ids = {k: i for i, k in enumerate(dict.fromkeys([*x, *y]))}
    p, q = np.array([ids[k] for k in x], np.int64), np.array([ids[k] for k in y], np.int64)
    table = np.zeros((len(p) + 1, len(q) + 1), np.int32)
    for i in range(1, len(p) + 1):
        here = np.where(q == p[i - 1], table[i - 1, :-1] + 1, table[i - 1, 1:])
        table[i, 1:] = np.maximum.accumulate(here)
    out, i, j = [], len(p), len(q)
    while i and j:
        if p[i - 1] == q[j - 1]:
            out.append((head + i - 1, head + j - 1))
            i, j = i - 1, j - 1
        elif table[i - 1, j] > table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    return [(k, k) for k in range(head)] + out[::-1] + ends


def change_ratio(a: str, b: str) -> float:
    x, y = a.encode(), b.encode()
    if not x and not y:
        return 0.0
    return (sum(p != q for p, q in zip(x, y, strict=False)) + abs(len(x) - len(y))) / max(len(x), len(y))


def split_words(text: str) -> list[str]:
    return re.findall("[A-Za-z0-9]+", text)


def word_ratio(a: str, b: str) -> float:
    """Share of words that are in no longest common sequence of both."""
    x, y = split_words(a), split_words(b)
    return 1 - len(lcs_pairs(x, y)) / max(len(x), len(y)) if x or y else 0.0


def align(left: list[dict], right: list[dict], o: CompareOptions) -> list[dict]:
    """Differences of two pages of text elements (dicts with text, x, y, font_name, font_size).

    Phases, each one-to-one in reading order: the same text at the same place; another text at the
    same place unless its text stands elsewhere; the same text in sequence (LCS) or moved; the rest.
    Texts at one place differ by ``granularity``: where their words (or characters, as far as
    they count) are the same they are equal.
    """
    if o.granularity not in ("element", "word", "char"):
        raise ValueError(f"no granularity {o.granularity}")

    def changed(i: int, j: int) -> list[dict]:
        a, b = plain_case(left[i]["text"], o), plain_case(right[j]["text"], o)
        if o.granularity == "word" and split_words(a) == split_words(b) or o.granularity == "char" and plain(a, o) == plain(b, o):
            return []
        return [{"kind": "modified", "left_idx": i, "right_idx": j, "ratio": word_ratio(a, b) if o.granularity == "word" else change_ratio(left[i]["text"], right[j]["text"])}]

    key = [[(plain(t["text"], o), t.get("font_name"), t.get("font_size")) for t in side] for side in (left, right)]
    free = [dict.fromkeys(range(len(left))), dict.fromkeys(range(len(right)))]
    near = lambda i, j: abs(left[i]["x"] - right[j]["x"]) < o.tolerance and abs(left[i]["y"] - right[j]["y"]) < o.tolerance
    grid: dict[tuple[int, int], list[int]] = {}
    cell = lambda t: (int(t["x"] // o.tolerance), int(t["y"] // o.tolerance))
    for j, t in enumerate(right):
        grid.setdefault(cell(t), []).append(j)

    def around(i: int) -> list[int]:
        cx, cy = cell(left[i])
        return sorted(j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in grid.get((cx + dx, cy + dy), ()) if j in free[1] and near(i, j))

    for i in range(len(left)):
        if (j := next((j for j in around(i) if key[0][i][0] == key[1][j][0]), None)) is not None:
            del free[0][i], free[1][j]
    out = []
    waiting = [{k[0] for n, k in enumerate(key[side]) if n in free[side]} for side in (0, 1)]
    for i in list(free[0]):
        j = next((j for j in around(i) if key[1][j][0] not in waiting[0] and key[0][i][0] not in waiting[1]), None)
        if j is not None:
            out += changed(i, j)
            del free[0][i], free[1][j]
    a, b = list(free[0]), list(free[1])
    for p, q in lcs_pairs([key[0][i] for i in a], [key[1][j] for j in b]):
        i, j = a[p], b[q]
        if o.detect_moves and o.move_distance is not None and max(abs(left[i]["x"] - right[j]["x"]), abs(left[i]["y"] - right[j]["y"])) > o.move_distance:
            continue
        if o.detect_moves and not near(i, j):
            out.append({"kind": "moved", "left_idx": i, "right_idx": j, "ratio": 0.0})
        del free[0][i], free[1][j]
    if o.detect_moves:
        by_text: dict[str, list[int]] = {}
        for j in free[1]:
            by_text.setdefault(key[1][j][0], []).append(j)
        for i in list(free[0]):
            if options := by_text.get(key[0][i][0]):
                far = lambda j: max(abs(left[i]["x"] - right[j]["x"]), abs(left[i]["y"] - right[j]["y"]))  # noqa: B023, E731
                at = next((k for k, j in enumerate(options) if o.move_distance is None or far(j) <= o.move_distance), None)
                if at is None:
                    continue
                j = options.pop(at)
                out.append({"kind": "moved", "left_idx": i, "right_idx": j, "ratio": 0.0})
                del free[0][i], free[1][j]
    for i in list(free[0]):
        if (j := next(iter(around(i)), None)) is not None:
            out += changed(i, j)
            del free[0][i], free[1][j]
    out += [{"kind": "removed", "left_idx": i, "right_idx": None, "ratio": 1.0} for i in free[0]]
    out += [{"kind": "added", "left_idx": None, "right_idx": j, "ratio": 1.0} for j in free[1]]
    if o.sensitivity == "relaxed":
        out = [d for d in out if d["kind"] != "modified" or d["ratio"] > 0.1]
    return out


def align_elements(left: DataFrame, right: DataFrame, keys: list[str], options: CompareOptions = CompareOptions()) -> DataFrame:
    """``align`` for each group of keys (a pair of pages): keys, kind, left_idx, right_idx, ratio.

    A page is the unit of the comparison and is bounded by what fits a page. Pages are gathered by Spark as rows of both
    sides' elements, so that a batch holds many pairs.
    """
    fields = ["text", "x", "y", "font_name", "font_size"]
    kinds = dict(left.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", kind string, left_idx long, right_idx long, ratio double"
    found = pa.struct([("kind", pa.string()), ("left_idx", pa.int64()), ("right_idx", pa.int64()), ("ratio", pa.float64())])

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(*keys, F.struct(F.lit(n).alias("side"), "idx", *[F.col(f).cast("double").alias(f) if f in ("x", "y") else F.col(f) for f in fields]).alias("_e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES_AT_ONCE):
                b = whole.slice(at, PAGES_AT_ONCE)
                takes, rows = [], []
                for i, elements in enumerate(b.column("_e").to_pylist()):
                    sides = [[e for e in elements if e["side"] == n] for n in (0, 1)]
                    for d in align(*sides, options):
                        name = lambda s, c: None if d[c] is None else sides[s][d[c]]["idx"]  # noqa: B023, E731
                        takes.append(i)
                        rows.append({"kind": d["kind"], "left_idx": name(0, "left_idx"), "right_idx": name(1, "right_idx"), "ratio": d["ratio"]})
                taken = pa.array(takes, pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(taken) for k in keys], *pa.array(rows, found).flatten()], names=[*keys, *[f.name for f in found]])

    pages = side(left, 0).unionByName(side(right, 1)).groupBy(*keys).agg(F.sort_array(F.collect_list("_e")).alias("_e"))
    return pages.mapInArrow(run, schema)
