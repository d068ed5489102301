"""N-gram Jaccard self-join with signature trees.

Texts become sets of hashed word n-grams; equal sets are one class from then on. All sets are read in
one order of the n-grams, those that many texts hold last. Two sets that link share an n-gram
among the first ones of each (a set of n needs n - t n + 1 of them), so each such n-gram is the root of
a signature tree over the classes that have it there. Below it, classes stand by size; a node
holds the OR and the AND of their token bitmaps, the range of their sizes and the most that can still
follow in them. Each tree is traversed against itself, and pairs of nodes are pruned by the largest overlap that they can
reach. What is left of all trees are candidate pairs, which are counted exactly on the whole sets.

Nothing is left to chance: the order of the n-grams decides how much work there is, not what is found.
Trees with very many classes (copies of one text that all differ a little) are cut into cells. Their
likeliest pairs are counted first and connect most of their classes; then every pair of classes that is
not connected by then meets, in one cell each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import bounded_batches, components, joined, mix64
from docloom.llm.shingles import LEAST_BITS, bitmap_bits, bitmaps, folded, later_in_run, set_id, shingle_sets
from docloom.scratch import release, shuffle_width, stage

LEAF = 32
#: Classes of a tree whose candidate pairs are all sent on at once, and of a cell of a larger tree.
WHOLE, CELL = 128, 2048
#: Bytes of bitmaps that are compared at once.
COMPARED = 1 << 24
#: n-grams are read last if about so many classes hold them; at most 2^18 are, the most frequent ones.
LEAST_FREQUENT, MOST_FREQUENT = 16, 1 << 18
#: Elements of sets in a window in which n-grams are counted, and the least count that is passed on.
WINDOW, LEAST_LOCAL = 1 << 21, 3
#: Elements of sets that meet in one cell of the exact count, about; prefix n-grams of a bucket.
CELL_ELEMENTS, BUCKET_ELEMENTS = 1 << 18, 1 << 19
FILTER_BITS = 1 << 25


def prefix_size(n: np.ndarray | int, percent: int):
    """A set of n and any set that it links with share one of this many first elements."""
    return n + (-percent * n) // 100 + 1


def may_link(size_a, left_a, size_b, left_b, percent: int):
    """Whether sets of these sizes can link if at most so many elements of each are common."""
    least, most = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (100 * least >= percent * most) & ((100 + percent) * np.minimum(left_a, left_b) >= percent * (size_a + size_b))


class Frequent:
    """The n-grams that are read last, rarest first. Bounded by ``MOST_FREQUENT``, whatever the input."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]
        self.rank = np.empty(len(by), np.int64)
        self.rank[np.lexsort((self.tokens, self.counts))] = np.arange(len(by))
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.tokens >> np.uint64(42)).astype(np.int64)] = True

    def prefix(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The first elements of a set (sorted by hash), and how many classes are known to hold each (0: few)."""
        n = prefix_size(len(s), percent)
        maybe = np.flatnonzero(self.sieve[(s >> np.uint64(42)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.tokens, s[maybe]), len(self.tokens) - 1)
            hit = self.tokens[at] == s[maybe]
            maybe, at = maybe[hit], at[hit]
        if not len(maybe):
            return s[:n], np.zeros(n, np.int64)
        rest = np.delete(s, maybe)[:n]
        last = at[np.argsort(self.rank[at])][: n - len(rest)]
        return np.concatenate((rest, self.tokens[last])), np.concatenate((np.zeros(len(rest), np.int64), self.counts[last]))


def _packed(bucket: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows (bucket, packed columns) for each bucket that has any."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket[by])) + 1, [len(by)])) if len(by) else [0]
    return [(int(bucket[by[p]]), *(c[by[p:q]].tobytes() for c in columns)) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]


def _missing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits of x that y lacks, by row."""
    return np.bitwise_count(x & ~y).sum(-1, dtype=np.int64)


class Members:
    """Classes of one tree or of many (``tree``), with what prunes them. ``left``: elements from the shared one on."""

    def __init__(self, tree: np.ndarray, sizes: np.ndarray, left: np.ndarray, bits: list[bytes], labels: np.ndarray | None, percent: int):
        self.order = np.lexsort((sizes, tree))
        self.tree, self.sizes, self.left = tree[self.order], sizes[self.order].astype(np.int64), left[self.order].astype(np.int64)
        self.labels = None if labels is None else labels[self.order]
        self.percent = percent
        # Sets that can link differ in size by less than 2 if percent is above 50, and their bitmaps by one level then.
        self.level = np.log2(bitmap_bits(self.sizes)).astype(np.int64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # level: place of each member, bitmaps folded to it
        self.coarse = np.zeros((len(self.order), LEAST_BITS // 64), np.uint64)
        for level in np.unique(self.level).tolist():
            some = np.flatnonzero(self.level == level)
            rows = np.frombuffer(b"".join(bits[k] for k in self.order[some].tolist()), np.uint64).reshape(len(some), -1)
            self._hold(level, some, rows)
            self.coarse[some] = folded(rows, LEAST_BITS)

    def _hold(self, level: int, some: np.ndarray, rows: np.ndarray) -> None:
        for lower in np.unique(self.level[self.level <= level]).tolist():
            if level - lower > 1 and self.percent > 50:
                continue
            place, held = self.at.get(lower, (np.full(len(self.order), -1), np.zeros((0, (1 << lower) // 64), np.uint64)))
            place[some] = len(held) + np.arange(len(some))
            self.at[lower] = place, np.concatenate((held, folded(rows, 1 << lower)))

    def linkable(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these pairs no bound excludes, and the most that they can have in common."""
        ok = np.flatnonzero(may_link(self.sizes[i], self.left[i], self.sizes[j], self.left[j], self.percent))
        if self.labels is not None:
            ok = ok[self.labels[i[ok]] != self.labels[j[ok]]]
        out, reach = [ok[:0]], [ok[:0]]
        low = np.minimum(self.level[i[ok]], self.level[j[ok]])
        for level in np.unique(low).tolist():
            some = ok[low == level]
            place, rows = self.at[level]
            step = max(1, COMPARED * 8 >> level)
            for lo in range(0, len(some), step):
                k = some[lo : lo + step]
                a, b = i[k], j[k]
                p, q = rows[place[a]], rows[place[b]]
                x, y = self.sizes[a] - _missing(p, q), self.sizes[b] - _missing(q, p)
                fits = may_link(self.sizes[a], x, self.sizes[b], y, self.percent)
                out.append(k[fits])
                reach.append(np.minimum(x, y)[fits])
        return np.concatenate(out), np.concatenate(reach)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidate pairs (indexes as given) of all trees, and the most that they can have in common."""
        found = []
        starts = np.flatnonzero(np.concatenate(([True], self.tree[1:] != self.tree[:-1]))) if len(self.tree) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(self.tree))
        small = np.repeat(ends - starts <= LEAF, ends - starts)
        at = np.flatnonzero(small)  # trees of one leaf, all at once
        for i, j in later_in_run(self.tree[at]):
            k, most = self.linkable(at[i], at[j])
            found.append((at[i[k]], at[j[k]], most))
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            if hi - lo > LEAF:
                found += self._traversed(lo, hi)
        i, j, most = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
        return self.order[i], self.order[j], most

    def _traversed(self, first: int, last: int) -> list[tuple[np.ndarray, ...]]:
        nodes: list[tuple] = []  # first, last, OR, AND, most left, the one label, children

        def build(lo: int, hi: int) -> int:
            kids = ()
            if hi - lo > LEAF:
                mid = (lo + hi) // 2
                kids = (build(lo, mid), build(mid, hi))
                a, b = nodes[kids[0]], nodes[kids[1]]
                nodes.append((lo, hi, a[2] | b[2], a[3] & b[3], max(a[4], b[4]), a[5] if a[5] == b[5] else None, kids))
            else:
                one = None
                if self.labels is not None and (self.labels[lo:hi] == self.labels[lo]).all():
                    one = int(self.labels[lo])
                nodes.append((lo, hi, np.bitwise_or.reduce(self.coarse[lo:hi]), np.bitwise_and.reduce(self.coarse[lo:hi]), int(self.left[lo:hi].max()), one, kids))
            return len(nodes) - 1

        def pruned(x: tuple, y: tuple) -> bool:
            if x[5] is not None and x[5] == y[5]:
                return True
            low, high = (x, y) if x[0] <= y[0] else (y, x)  # smaller sets, larger sets
            least, most = int(self.sizes[high[0]]), int(self.sizes[low[1] - 1])
            if 100 * most < self.percent * least:
                return True
            reach = min(most - int(_missing(low[3], high[2])), int(self.sizes[high[1] - 1]) - int(_missing(high[3], low[2])), x[4], y[4])
            return (100 + self.percent) * reach < self.percent * (int(self.sizes[low[0]]) + least)

        out = []
        todo = [(r := build(first, last), r)]
        while todo:
            i, j = todo.pop()
            x, y = nodes[i], nodes[j]
            if pruned(x, y) if i != j else x[5] is not None:
                continue
            if not x[6] and not y[6]:
                a, b = (g.ravel() for g in np.meshgrid(np.arange(x[0], x[1]), np.arange(y[0], y[1]), indexing="ij"))
                if i == j:
                    a, b = a[a < b], b[a < b]
                k, most = self.linkable(a, b)
                out.append((a[k], b[k], most))
            elif i == j:
                a, b = x[6]
                todo += [(a, b), (a, a), (b, b)]
            elif x[6] and (not y[6] or x[1] - x[0] >= y[1] - y[0]):
                todo += [(k, j) for k in x[6]]
            else:
                todo += [(i, k) for k in y[6]]
        return out


def _met(group: pd.DataFrame, percent: int, whole: int, cell: int) -> pd.DataFrame:
    """The prefix n-grams of a bucket that can matter: others have the n-gram too, of fitting size and place."""
    t, o, n, p, c = (np.frombuffer(b"".join(group[k]), k2) for k, k2 in (("tokens", np.uint64), ("owners", np.int64), ("sizes", np.int32), ("places", np.int32), ("counts", np.int32)))
    by = np.lexsort((o, t))
    by = by[np.concatenate(([True], (t[by][1:] != t[by][:-1]) | (o[by][1:] != o[by][:-1])))] if len(by) else by
    t, o, n, p, c = t[by], o[by], n[by].astype(np.int64), p[by].astype(np.int64), c[by]
    run = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.zeros(0, bool)
    group_of = np.cumsum(run) - 1
    size = np.bincount(group_of)[group_of] if len(t) else group_of
    # A large tree's classes are dealt over buckets, so that only others know its size.
    large = (c > cell) | (size > whole)
    alive = large.copy()
    few = np.flatnonzero(~large & (size > 1))
    for i, j in later_in_run(t[few]):
        i, j = few[i], few[j]
        ok = may_link(n[i], n[i] - p[i], n[j], n[j] - p[j], percent)
        alive[i[ok]] = True
        alive[j[ok]] = True
    k = np.flatnonzero(alive)
    return pd.DataFrame({"token": t[k].view(np.int64), "owner": o[k], "size": n[k], "rest": n[k] - p[k], "large": large[k]})


_PAIRS = "a long, b long, size_a int, size_b int"


def _likeliest(i: np.ndarray, j: np.ndarray, share: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Indexes of a spanning forest of these pairs over labels, of the likeliest ones: each round takes every part's best pair."""
    by = np.argsort(-share, kind="stable")
    part = np.unique(labels, return_inverse=True)[1]
    taken = []
    while len(by := by[part[i[by]] != part[j[by]]]):
        ends = np.stack((part[i[by]], part[j[by]]), 1).ravel()
        best = np.unique(np.unique(ends, return_index=True)[1] // 2)
        taken.append(by[best])
        up = np.arange(part.max() + 1)
        a, b = part[i[by[best]]], part[j[by[best]]]
        while True:
            low = np.minimum(up[a], up[b])
            new = up.copy()
            np.minimum.at(new, up[a], low)
            np.minimum.at(new, up[b], low)
            new = new[new]
            if (new == up).all():
                break
            up = new
        part = up[part]
    return np.concatenate(taken) if taken else by


def _candidates(group: pd.DataFrame, percent: int, forest: bool = False) -> pd.DataFrame:
    """Distinct candidate pairs of the trees of a group. ``forest``: of one tree, the likeliest that connect what can be connected."""
    owners, sizes = group["owner"].to_numpy(), group["size"].to_numpy()
    tree = np.unique(group["token"].to_numpy(), return_inverse=True)[1]
    labels = group["label"].to_numpy() if "label" in group else None
    i, j, most = Members(tree, sizes, group["rest"].to_numpy(), group["bits"].tolist(), labels, percent).pairs()
    if forest:
        k = _likeliest(i, j, most / (sizes[i] + sizes[j] - most), labels)
        i, j = i[k], j[k]
    a, b = np.where(owners[i] < owners[j], i, j), np.where(owners[i] < owners[j], j, i)
    out = pd.DataFrame({"a": owners[a], "b": owners[b], "size_a": sizes[a], "size_b": sizes[b]})
    return out[out["a"] != out["b"]].drop_duplicates(["a", "b"])


def _counted(pairs: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The pairs whose whole sets link."""
    whole = {o: np.frombuffer(e, np.uint64) for o, e in zip(sets["owner"], sets["elements"], strict=True)}
    rows = []
    for a, b in zip(pairs["a"], pairs["b"], strict=True):
        x, y = whole[a], whole[b]
        if len(x) > len(y):
            x, y = y, x
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        if 100 * both >= percent * (len(x) + len(y) - both):
            rows.append((a, b))
    return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, label: str, few: bool = False) -> DataFrame:
    """``a b`` of the candidate pairs that link, counted on whole sets (a staged table).

    A pair meets at the smallest class that either side has a candidate in, so that sets of copies
    move once; what meets in one place is dealt by size. ``few``: no class has many pairs, and each meets at its first.
    """
    pairs = stage(pairs.distinct(), f"{label}-pairs")
    if few:
        dealt = pairs.select(F.col("a").alias("cell"), F.lit(0).alias("p"), F.lit(0).alias("q"), "a", "b")
    else:
        ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = stage(ends.groupBy("x").agg(F.least("x", F.min("y")).alias("m")), f"{label}-least")
        met = pairs.join(least.withColumnsRenamed({"x": "a", "m": "ma"}), "a").join(least.withColumnsRenamed({"x": "b", "m": "mb"}), "b")
        met = stage(met.select("a", "b", "size_a", "size_b", F.least("ma", "mb").alias("cell")), f"{label}-met")
        weight = met.select("cell", F.col("a").alias("x"), F.col("size_a").alias("n")).union(met.select("cell", "b", "size_b")).distinct()
        parts = stage(weight.groupBy("cell").agg(F.ceil(F.sum("n") / CELL_ELEMENTS).cast("int").alias("parts")), f"{label}-parts")
        deal = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
        dealt = stage(met.join(parts, "cell").select("cell", deal("a").alias("p"), deal("b").alias("q"), "a", "b"), f"{label}-dealt")
    key = ["cell", "p", "q"]
    needed = dealt.select("cell", "p", "q", F.col("a").alias("owner")).union(dealt.select("cell", "p", "q", "b")).distinct().toDF("at", "at_p", "at_q", "owner")
    there = needed.join(sets.hint("merge"), "owner").select("at", "at_p", "at_q", "owner", "elements")
    return stage(
        dealt.groupBy(*key).cogroup(there.groupBy("at", "at_p", "at_q")).applyInPandas(lambda p, s: _counted(p, s, percent), "a long, b long"),
        f"{label}-links",
    )


def _sets_of(text: DataFrame, wanted: DataFrame, words: int, salt: int, label: str) -> DataFrame:
    """``owner elements``: the whole sets of the wanted classes (a staged table).

    A filter of a fixed size keeps most other texts from being sent; the join makes it exact.
    """
    spark = text.sparkSession

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = _filter_places(b["owner"].to_numpy())
            yield pd.DataFrame({"word": at >> 6, "bit": np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)})

    # At most FILTER_BITS / 64 rows.
    flags = wanted.mapInPandas(marked, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[flags["word"].to_numpy(np.int64)] = flags["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for s in shingle_sets(b["text"].tolist(), words):
                if len(s) and (k := set_id(s, salt)[0]) not in seen:
                    at = _filter_places(np.array([k]))
                    if (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all():
                        seen.add(k)
                        rows.append((k, s.tobytes()))
            yield pd.DataFrame(rows, columns=["owner", "elements"])

    got = text.select("text").mapInPandas(fetched, "owner long, elements binary")
    return stage(got.join(wanted.hint("merge"), "owner", "left_semi").dropDuplicates(["owner"]), label)


def _filter_places(keys: np.ndarray) -> np.ndarray:
    h = mix64(keys.astype(np.int64).view(np.uint64))
    return np.concatenate((h % np.uint64(FILTER_BITS), (h >> np.uint64(32)) % np.uint64(FILTER_BITS))).astype(np.int64)


def _frequent(known: DataFrame) -> Frequent:
    """The most frequent n-grams: the counts that windows passed on, above the least power of two that keeps them few."""

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": np.frombuffer(b"".join(b["tokens"]), np.int64), "n": np.frombuffer(b"".join(b["counts"]), np.int64)})

    told = known.filter("tokens is not null").select("tokens", "counts").mapInPandas(unpacked, "token long, n long")
    sums = stage(told.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_FREQUENT), "shingle-counts")
    scale = sorted(((r.e, r["count"]) for r in sums.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()), reverse=True)  # at most 64 rows
    total, least = 0, 63
    for e, n in scale:
        if (total := total + n) > MOST_FREQUENT:
            break
        least = e
    rows = sums.filter(F.floor(F.log2("n")) >= least).toPandas()
    return Frequent(rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))


def _identified(text: DataFrame, words: int, salt: int) -> DataFrame:
    """A row for each text (``doc_id n_shingles k1 k2 bits``), and rows of n-gram counts (``tokens counts``)."""

    def identify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        window, held = [], 0

        def counts() -> pd.DataFrame:
            t, n = np.unique(np.concatenate(window), return_counts=True)
            many = n >= LEAST_LOCAL
            return pd.DataFrame({"doc_id": [None], "tokens": [t[many].tobytes()], "counts": [n[many].astype(np.int64).tobytes()]}).reindex(columns=columns)

        columns = ["doc_id", "n_shingles", "k1", "k2", "bits", "tokens", "counts"]
        for b in batches:
            sets = shingle_sets(b["text"].tolist(), words)
            keys = [set_id(s, salt) for s in sets]
            flags = bitmaps(sets)
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets], "k1": [k[0] for k in keys], "k2": [k[1] for k in keys],
                "bits": [f if len(s) else None for f, s in zip(flags, sets, strict=True)], "tokens": None, "counts": None,
            })
            for s, (k, _) in zip(sets, keys, strict=True):
                if k not in seen:
                    seen.add(k)
                    window.append(s)
                    held += len(s)
                    if held >= WINDOW:
                        yield counts()
                        window, held = [], 0
        if held:
            yield counts()

    return stage(text.mapInPandas(identify, "doc_id long, n_shingles long, k1 long, k2 long, bits binary, tokens binary, counts binary"), "shingle-sets")


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id n_shingles component_id``.

    Nulls, empty texts and texts without a word have an empty set and link with nothing. Equal sets
    are one class, and links between classes are found without any cap. Rows with a null id are
    compared like others; a component is named by its smallest id, or null if it has none. Repeated
    rows keep one row each. Very long texts are whole sets. An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be between 1 and 100")
    spark = docs.sparkSession
    bounded_batches(spark)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    salt = 0
    while True:
        known = _identified(text, words, salt)
        rows = known.filter("tokens is null")
        classes = stage(
            rows.filter("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("low"), F.first("bits").alias("bits")),
            "shingle-classes",
        )
        if classes.groupBy("k1").count().filter("count > 1").isEmpty():
            break
        salt += 1  # two classes share the half of their digest that they meet by: take another digest
    frequent = spark.sparkContext.broadcast(_frequent(known))
    elements = classes.agg(F.sum("n_shingles")).first()[0] or 0
    whole, cell = WHOLE, CELL
    width = max(shuffle_width(spark), int(elements * (100 - percent) / 100) // BUCKET_ELEMENTS + 1)

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Prefix n-grams of each class, packed by the bucket that they will meet in."""
        seen: set[int] = set()
        for b in batches:
            tokens, owners, sizes, places, counts = [], [], [], [], []
            for s in shingle_sets(b["text"].tolist(), words):
                if len(s) and (k := set_id(s, salt)[0]) not in seen:
                    seen.add(k)
                    first, held = frequent.value.prefix(s, percent)
                    tokens.append(first)
                    counts.append(held.astype(np.int32))
                    owners.append(np.full(len(first), k, np.int64))
                    sizes.append(np.full(len(first), len(s), np.int32))
                    places.append(np.arange(len(first), dtype=np.int32))
            if not tokens:
                continue
            t, o, c = np.concatenate(tokens), np.concatenate(owners), np.concatenate(counts)
            spread = mix64(o.view(np.uint64)) % (c // cell + 1).astype(np.uint64) * (c > cell)
            bucket = (mix64(t ^ mix64(spread)) % np.uint64(width)).astype(np.int64)
            yield pd.DataFrame(_packed(bucket, t, o, np.concatenate(sizes), np.concatenate(places), c), columns=["bucket", "tokens", "owners", "sizes", "places", "counts"])

    packed = text.mapInPandas(posted, "bucket long, tokens binary, owners binary, sizes binary, places binary, counts binary")
    postings = stage(packed.groupBy("bucket").applyInPandas(lambda g: _met(g, percent, whole, cell), "token long, owner long, size int, rest int, large boolean"), "shingle-postings")
    del packed
    release(spark)

    # With bitmaps, whole trees meet in buckets.
    bits = classes.select(F.col("k1").alias("owner"), "bits")
    trees = postings.filter("not large").join(bits, "owner").withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(width)))
    pairs = stage(trees.groupBy("bucket").applyInPandas(lambda g: _candidates(g, percent), _PAIRS), "shingle-pairs")
    del trees
    ends = pairs.select(F.col("a").alias("owner")).union(pairs.select("b")).union(postings.filter("large").select("owner"))
    wanted = stage(ends.distinct(), "shingle-wanted")
    sets = _sets_of(text, wanted, words, salt, "shingle-whole")
    labels = components(_linked(pairs, sets, percent, "shingle"), "shingle")
    if not postings.filter("large").isEmpty():
        labels = _large_trees(postings.filter("large").drop("large"), bits, sets, labels, percent)
    release(spark)
    named = classes.join(labels.withColumnsRenamed({"node": "k1", "component": "label"}), "k1", "left").select("k1", "k2", "low", F.coalesce("label", "k1").alias("label"))
    low = named.groupBy("label").agg(F.min("low").alias("component_id"))
    final = stage(named.join(low, "label").select("k1", "k2", "component_id"), "shingle-components")
    return rows.join(final, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _large_trees(large: DataFrame, bits: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Labels after the trees that are too large for a task: ``token owner size rest``."""
    counts = stage(large.groupBy("token").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")), "tree-sizes")
    flags = stage(bits.join(large.select("owner").distinct(), "owner"), "tree-bits")
    alone = flags.select(F.col("owner").alias("node")).join(labels, "node", "left_anti")
    labels = stage(labels.unionByName(alone.withColumn("component", F.col("node"))), "tree-labels")

    def labelled() -> tuple[DataFrame, DataFrame]:
        """The members with their labels, without and with their bitmaps."""
        known = labels.withColumnsRenamed({"node": "owner", "component": "label"})
        return large.join(known, "owner"), large.join(counts, "token").join(flags.join(known, "owner"), "owner")

    def apart() -> int:
        """How many labels there are in trees that have several."""
        return plain.groupBy("token", "label").agg(F.lit(1)).groupBy("token").count().filter("count > 1").agg(F.sum("count")).first()[0] or 0

    plain, now = labelled()
    cells = counts.agg(F.max("parts")).first()[0]
    before, turn = None, 0
    while True:
        # The likeliest pairs of each cell connect nearly all that links. Where a tree has several cells, other deals follow.
        cell = F.pmod(F.xxhash64("owner", F.lit(turn)), F.col("parts")).cast("int")
        near = now.withColumn("cell", cell).groupBy("token", "cell").applyInPandas(lambda g: _candidates(g, percent, forest=True), _PAIRS)
        labels, turn = joined(labels, _linked(near, sets, percent, f"tree-{turn}", few=True), "tree"), turn + 1
        plain, now = labelled()
        if cells == 1:
            break
        was, before = before, apart()
        if not before or was and before > 0.9 * was:
            break
    # What is still apart: of each tree all but the classes of its largest label meet everyone.
    shares = plain.groupBy("token", "label").count()
    top = stage(
        shares.groupBy("token").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("all"), F.count("*").alias("labels"))
        .filter("labels > 1")
        .select("token", F.col("top.label").alias("top"), F.ceil(F.col("top.count") / CELL).cast("int").alias("tops"), F.ceil((F.col("all") - F.col("top.count")) / CELL).cast("int").alias("others")),
        "tree-tops",
    )
    rest = now.drop("parts").join(top, "token").withColumn("main", F.col("label") == F.col("top"))
    place = F.when(F.col("main"), F.pmod(F.xxhash64("owner"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("owner"), F.col("others")) + F.col("tops")).cast("int")
    others = F.sequence(F.col("tops"), F.col("tops") + F.col("others") - 1)
    each = F.when(F.col("main"), others).otherwise(F.sequence(F.lit(0), F.col("tops") + F.col("others") - 1))
    dealt = rest.withColumn("place", place).withColumn("other", F.explode(each)).withColumns({"p": F.least("place", "other"), "q": F.greatest("place", "other")})
    every = dealt.select("token", "owner", "size", "rest", "bits", "label", "p", "q").groupBy("token", "p", "q").applyInPandas(lambda g: _candidates(g, percent), _PAIRS)
    return joined(labels, _linked(every, sets, percent, "tree-rest", few=True), "tree")


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)
