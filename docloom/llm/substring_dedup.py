"""Substring dedup by a hash-compared suffix sort.

A byte goes if a ``length``-byte string over it also starts earlier in the corpus. Every such string
contains an anchor: the position of its least gram hash, which depends on its content alone, so both
occurrences carry the same anchor gram at the same place. Anchors whose gram occurs once can't
matter. The others ship the bytes around them to the bucket of their gram. There, suffixes that
start at the anchors of one gram are put in order by a mergesort that compares them through prefix
polynomial hashes: a binary search over lengths finds the common extension of two suffixes, so a
comparison is logarithmic. Neighbours' common extensions cut the order into runs that share the
right part of a string; the hash of its left part completes the class, whose first member stays.
Equal hashes are verified on the bytes.

Equal contexts are reduced to their first within a batch before they are shipped, so a passage that
a third of the corpus shares arrives once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import bounded_batches, mix64, ragged
from docloom.scratch import release, shuffle_width, stage

GRAM = 24
BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 21
GROUP_BYTES = 8 << 20
CHUNK_CONTEXTS = 8192


def _geometric(first: int, ratio: int, n: int) -> np.ndarray:
    p = np.full(n, ratio & (1 << 64) - 1, np.uint64)
    p[0] = first
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_TABLES.get("pow", ())) < n:
        _TABLES["pow"] = _geometric(1, BASE, n)
        _TABLES["inv"] = _geometric(1, pow(BASE, -1, 1 << 64), n)
    return _TABLES["pow"], _TABLES["inv"]


def gathered(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of the runs [start, start + len), in order, without an index of them all at once."""
    ends = np.cumsum(lens)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(0, len(lens), CHUNK_CONTEXTS):
        j = min(len(lens), i + CHUNK_CONTEXTS)
        out[ends[i] - lens[i] : ends[j - 1]] = data[ragged(starts[i:j], lens[i:j])]
    return out


def grams_at(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Gram hashes at these positions, the same as ``anchors_of`` gives."""
    power, out = _powers(GRAM)[0][:GRAM], np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(starts), CHUNK_CONTEXTS):
            part = data[starts[i : i + CHUNK_CONTEXTS, None] + np.arange(GRAM)].astype(np.uint64)
            out[i : i + CHUNK_CONTEXTS] = mix64(((part + np.uint64(1)) * power).sum(1, dtype=np.uint64))
    return out


def anchors_of(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all strings of ``length`` within the given stretches, and their gram hashes."""
    n, width = len(data), length - GRAM + 1
    if n < length or not (lens >= length).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        gram = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    # The place in the low bits makes the leftmost of equal grams the least.
    bits = np.uint64(max(1, int(n).bit_length()))
    keys = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    pad = -len(keys) % width
    grid = np.concatenate((keys, np.full(pad, ~np.uint64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    count = len(keys) - width + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    whole = ragged(starts[lens >= length], lens[lens >= length] - length + 1)
    at = (least[whole] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = np.unique(at)
    return at, gram[at]


def doc_anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, position, gram hash) of all anchors, a few MB of text at a time."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        lens = np.array([len(b) for _, _, b in parts], np.int64)
        starts = np.cumsum(lens) - lens
        at, gram = anchors_of(np.frombuffer(b"".join(b for _, _, b in parts), np.uint8), starts, lens, length)
        k = np.searchsorted(starts, at, side="right") - 1
        who, off = np.array([i for i, _, _ in parts]), np.array([o for _, o, _ in parts])
        return who[k], at - starts[k] + off[k], gram

    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - length + 1), CHUNK_BYTES):
            part = t[o : o + CHUNK_BYTES + length - 1]
            if len(part) < length:
                continue
            parts.append((i, o, part))
            size += len(part)
            if size >= CHUNK_BYTES:
                yield flush()
                parts, size = [], 0
    if parts:
        yield flush()


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and (bucket, first, last) of each bucket that has any, in time that the number of buckets has no part in."""
    by = np.argsort(bucket, kind="stable")
    if not len(by):
        return by, []
    there = bucket[by]
    first = np.flatnonzero(np.concatenate(([True], there[1:] != there[:-1])))
    return by, list(zip(there[first].tolist(), first.tolist(), np.append(first[1:], len(by)).tolist(), strict=True))


def _pack(bucket: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows (bucket, packed columns) for each bucket that has any."""
    by, cuts = _cuts(bucket)
    return [(b, *(c[by[p:q]].tobytes() for c in columns)) for b, p, q in cuts]


class Contexts:
    """Bytes around anchors, ``left`` before and ``right`` from the anchor on, as a padded matrix."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        size = int((left + right).max())
        power, self.inverse = _powers(size + 1)
        cols = np.arange(size)
        inside = cols < (left + right)[:, None]
        self.bytes = np.where(inside, data[np.minimum(starts[:, None] + cols, len(data) - 1)], 0).astype(np.uint8)
        with np.errstate(over="ignore"):
            self.sums = np.zeros((len(left), size + 1), np.uint64)
            np.cumsum(np.where(inside, self.bytes.astype(np.uint64) + np.uint64(1), np.uint64(0)) * power[:size], axis=1, out=self.sums[:, 1:])

    def hash(self, who: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[who, start + size] - self.sums[who, start]) * self.inverse[start]

    def whole(self) -> np.ndarray:
        n = self.left + self.right
        return mix64(self.hash(np.arange(len(n)), np.zeros_like(n), n) ^ mix64((self.left * 4096 + self.right).astype(np.uint64)))

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at two anchors: binary search over prefix hashes."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.right[x], self.right[y])
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.hash(x, self.left[x], mid) == self.hash(y, self.left[y], mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix x stands before y; of equal ones, ``ties``."""
        n = self.common(x, y)
        end = np.minimum(self.right[x], self.right[y])
        top = self.bytes.shape[1] - 1
        bx, by = self.bytes[x, np.minimum(self.left[x] + n, top)], self.bytes[y, np.minimum(self.left[y] + n, top)]
        shorter = np.where(self.right[x] == self.right[y], ties, self.right[x] < self.right[y])
        return np.where(n < end, bx < by, shorter)

    def sort(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes within each group (``order``: elements, groups together).

        Runs of all groups are merged at once: each element finds its rank in the sibling run by
        binary search over comparisons.
        """
        first = np.searchsorted(group, group, side="left")
        size = np.searchsorted(group, group, side="right") - first
        place = np.arange(len(order)) - first
        run = 1
        while run < (size.max() if len(size) else 0):
            mine = place // run
            sibling = mine ^ 1
            base = np.minimum(sibling * run, size)
            lo, hi = np.zeros(len(order), np.int64), np.minimum(base + run, size) - base
            while len(live := np.flatnonzero(lo < hi)):
                mid = (lo[live] + hi[live]) // 2
                other = order[first[live] + base[live] + mid]
                odd = mine[live] & 1
                # From the right run, equal suffixes of the left run stand before; from the left run, they don't.
                before = np.where(odd == 1, ~self.less(order[live], other, False), self.less(other, order[live], False))
                lo[live], hi[live] = np.where(before, mid + 1, lo[live]), np.where(before, hi[live], mid)
            to = first + np.minimum(mine, sibling) * run + place - mine * run + lo
            new = np.empty_like(order)
            new[to] = order
            order, run = new, run * 2
        return order


def first_of(classes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each element, the index of the element of least rank in its class."""
    by = np.lexsort((rank, classes))
    head = np.concatenate(([True], classes[by][1:] != classes[by][:-1]))
    out = np.empty(len(by), np.int64)
    out[by] = by[head][np.cumsum(head) - 1]
    return out


def repeated_intervals(
    data: np.ndarray, gram: np.ndarray, owner: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, only_equal: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Covered intervals (element, start, end) of contexts, and which elements are first of equal contexts.

    All windows over an anchor lie next to each other, so what they cover is one interval.
    ``only_equal``: stop after equal contexts.
    """
    n = len(gram)
    starts = np.cumsum(left + right) - left - right
    rank = np.empty(n, np.int64)
    rank[np.lexsort((at, owner))] = np.arange(n)
    by = np.argsort(gram, kind="stable")
    cover_lo, cover_hi, first = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
    lo = 0
    while lo < n:
        hi = min(n, lo + CHUNK_CONTEXTS)
        while hi < n and gram[by[hi]] == gram[by[hi - 1]]:
            hi += 1
        some = by[lo:hi]
        lo = hi
        c = Contexts(data, starts[some], left[some], right[some])
        lead = first_of(mix64(c.whole() ^ mix64(gram[some])), rank[some])
        extra = np.flatnonzero(lead != np.arange(len(some)))
        true = (c.bytes[extra] == c.bytes[lead[extra]]).all(1) & (gram[some[extra]] == gram[some[lead[extra]]]) & (c.left[extra] == c.left[lead[extra]])
        extra = extra[true]
        cover_lo[some[extra]], cover_hi[some[extra]] = at[some[extra]] - left[some[extra]], at[some[extra]] + right[some[extra]]
        first[some[extra]] = False
        if only_equal:
            continue
        rest = np.flatnonzero(first[some])
        g = gram[some[rest]]
        alone = np.concatenate((g[1:] != g[:-1], [True])) & np.concatenate(([True], g[1:] != g[:-1]))
        rest = rest[~alone]
        if not len(rest):
            continue
        group = np.unique(gram[some[rest]], return_inverse=True)[1]
        order = c.sort(rest, group)
        shared = np.zeros(len(order), np.int64)
        inner = np.flatnonzero(group[1:] == group[:-1]) + 1
        shared[inner] = c.common(order[inner], order[inner - 1])
        rk, lf, rg = rank[some[order]], c.left[order], c.right[order]
        least, most = np.full(len(order), 1 << 30), np.full(len(order), -1)
        was = np.full(len(order), -1)
        for back in range(length - GRAM + 1):
            ok = np.flatnonzero((lf >= back) & (rg >= length - back))
            if not len(ok):
                was[:] = -1
                continue
            run = np.cumsum((shared < length - back) | np.concatenate(([True], group[1:] != group[:-1])))[ok]
            tail = c.hash(order[ok], lf[ok] - back, np.full(len(ok), back))
            lead = first_of(mix64(tail ^ mix64(run.astype(np.uint64))), rk[ok])
            hit = np.flatnonzero(lead != np.arange(len(ok)))
            x, y = ok[hit], ok[lead[hit]]
            kept = was[x] == y  # compared already but for the byte that is new on the left
            good = c.bytes[order[x], lf[x] - back] == c.bytes[order[y], lf[y] - back]
            fresh = np.flatnonzero(~kept)
            if len(fresh):
                cols = np.arange(length)
                a, b = order[x[fresh]], order[y[fresh]]
                good[fresh] = (c.bytes[a[:, None], (lf[x[fresh]] - back)[:, None] + cols] == c.bytes[b[:, None], (lf[y[fresh]] - back)[:, None] + cols]).all(1)
            for k in np.flatnonzero(~good):  # two strings share their hashes: look for a true one among all
                me = c.bytes[order[x[k]], lf[x[k]] - back : lf[x[k]] - back + length]
                good[k] = any(rk[z] < rk[x[k]] and (c.bytes[order[z], lf[z] - back : lf[z] - back + length] == me).all() for z in ok if group[z] == group[x[k]])
            was[:] = -1
            was[x[good]] = y[good]
            least[x[good]] = np.minimum(least[x[good]], back)
            most[x[good]] = back
        cov = np.flatnonzero(most >= 0)
        e = some[order[cov]]
        cover_lo[e], cover_hi[e] = at[e] - most[cov], at[e] - least[cov] + length
    covered = np.flatnonzero(cover_lo >= 0)
    return covered, cover_lo[covered], cover_hi[covered], np.flatnonzero(first)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs."""
    by = np.argsort(starts, kind="stable")
    s, e = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(e) - 1]))]


def _merge_by_owner(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions within each owner."""
    if not len(owner):
        return owner, lo, hi
    by = np.lexsort((lo, owner))
    o, s, e = owner[by], lo[by], hi[by]
    change = np.concatenate(([True], o[1:] != o[:-1]))
    shift = np.cumsum(change) * (int(e.max()) + 2)
    a, b = merged(s + shift, e + shift)
    k = np.searchsorted(s + shift, a)
    return o[k], a - shift[k], b - shift[k]


def _bucket_of(owner: np.ndarray, n: int) -> np.ndarray:
    return (mix64(owner.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def drop_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id n_bytes n_removed n_spans kept_sha256`` (and ``kept_text`` bytes).

    Nulls count as empty texts; texts shorter than ``length`` lose nothing. Texts are whole. Rows are
    ordered by id; if ids repeat or are null, rows of an id follow each other by their text, nulls
    come last, and each row is a document of its own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    ids = base.groupBy("doc_id").count()
    shape = base.agg(F.sum(F.octet_length("data")).alias("bytes")).first()
    if ids.filter("doc_id is null or count > 1").isEmpty():
        base = base.withColumn("ord", F.col("doc_id"))
    else:
        # Ids that increase along a global sort are a total order.
        base = stage(base.orderBy(F.col("doc_id").asc_nulls_last(), "data").withColumn("ord", F.monotonically_increasing_id()), "ordered")
    width = groups = max(shuffle_width(spark), (shape.bytes or 0) // GROUP_BYTES + 1)
    before = length - GRAM

    def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Grams by bucket with their documents; those already seen twice need no count."""
        for b in batches:
            b = b.sort_values("ord")
            owner = b["ord"].to_numpy()
            for who, _, gram in doc_anchors(b["data"].tolist(), length):
                by = np.lexsort((who, gram))
                g, o = gram[by], owner[who[by]]
                new = np.concatenate(([True], g[1:] != g[:-1]))
                twice = np.diff(np.append(np.flatnonzero(new), len(g))) > 1
                head = np.flatnonzero(new)
                told = np.flatnonzero(~new | np.repeat(twice, np.diff(np.append(head, len(g)))))
                told = told[np.concatenate(([True], (g[told][1:] != g[told][:-1]) | (o[told][1:] != o[told][:-1])))] if len(told) else told
                sent = [(x, False, y, z) for x, y, z in _pack((g[head] % np.uint64(width)).astype(np.int64), g[head], o[head])]
                # Known to be repeated: spread over buckets, since they are only passed on.
                sent += [(x, True, y, z) for x, y, z in _pack(_bucket_of(o[told], width), g[told], o[told])]
                yield pd.DataFrame(sent, columns=["bucket", "known", "grams", "owners"])

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        """Documents with the grams that occur elsewhere, by document bucket."""
        asked, known = group[~group["known"]], group[group["known"]]
        g, o = (np.frombuffer(b"".join(asked[c]), t) for c, t in (("grams", np.uint64), ("owners", np.int64)))
        by = np.argsort(g, kind="stable")
        g, o = g[by], o[by]
        same = g[1:] == g[:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(g) else np.zeros(0, bool)
        g = np.concatenate((g[twice], np.frombuffer(b"".join(known["grams"]), np.uint64)))
        o = np.concatenate((o[twice], np.frombuffer(b"".join(known["owners"]), np.int64)))
        return pd.DataFrame(_pack(_bucket_of(o, groups), g, o), columns=["part", "grams", "owners"])

    packed = base.select("ord", "data").mapInPandas(anchored, "bucket int, known boolean, grams binary, owners binary")
    # The plans behind staged tables are not kept, so that their shuffle files can go.
    repeated = stage(packed.groupBy("bucket").applyInPandas(counted, "part int, grams binary, owners binary"), "repeated-grams")
    del packed
    release(spark)

    @F.pandas_udf("int")
    def part_of(owner: pd.Series) -> pd.Series:
        return pd.Series(_bucket_of(owner.to_numpy(), groups).astype(np.int32))

    dealt = base.select("ord", "doc_id", "data").withColumn("part", part_of("ord"))

    def surrounded(texts: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
        """Contexts of repeated anchors by gram bucket, after equal ones within the group were reduced."""
        g, o = np.frombuffer(b"".join(grams["grams"]), np.uint64), np.frombuffer(b"".join(grams["owners"]), np.int64)
        wanted = np.unique(mix64(g ^ mix64(o.astype(np.uint64))))
        rows = []
        texts = texts.sort_values("ord")
        owner, data = texts["ord"].to_numpy(), texts["data"].tolist()
        sizes = np.array([len(d) for d in data], np.int64)
        if len(wanted):
            found = [(w[k], p[k], m[k]) for w, p, m in doc_anchors(data, length) if len(k := np.flatnonzero(np.isin(mix64(m ^ mix64(owner[w].astype(np.uint64))), wanted)))]
            if found:
                who, at, gram = (np.concatenate(x) for x in zip(*found, strict=True))
                flat = np.frombuffer(b"".join(data), np.uint8)
                offset = np.cumsum(sizes) - sizes
                left, right = np.minimum(at, before), np.minimum(sizes[who] - at, length)
                near = gathered(flat, offset[who] + at - left, left + right)
                cov, lo, hi, first = repeated_intervals(near, gram, owner[who], at, left, right, length, only_equal=True)
                o, s, e = _merge_by_owner(owner[who[cov]], lo, hi)
                rows += [(b, True, x, y, z, None, None) for b, x, y, z in _pack(_bucket_of(o, width), o, s, e)]
                spot = np.cumsum(left + right) - left - right
                by, cuts = _cuts((gram[first] % np.uint64(width)).astype(np.int64))
                for b, p, q in cuts:
                    k = first[by[p:q]]
                    sides = np.stack((left[k], right[k]), 1).astype(np.uint8)
                    rows.append((b, False, owner[who[k]].tobytes(), at[k].tobytes(), None, sides.tobytes(), gathered(near, spot[k], left[k] + right[k]).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "done", "owners", "x", "y", "sides", "bytes"])

    def sorted_(group: pd.DataFrame) -> pd.DataFrame:
        """Covered intervals of a gram bucket, by document bucket."""
        done, some = group[group["done"]], group[~group["done"]]
        cat = lambda c, t, f: np.frombuffer(b"".join(f[c]), t)
        o, lo, hi = cat("owners", np.int64, done), cat("x", np.int64, done), cat("y", np.int64, done)
        if len(some):
            owner, at, near = cat("owners", np.int64, some), cat("x", np.int64, some), cat("bytes", np.uint8, some)
            sides = cat("sides", np.uint8, some).reshape(-1, 2).astype(np.int64)
            size = sides.sum(1)
            gram = grams_at(near, np.cumsum(size) - size + sides[:, 0])
            cov, s, e, _ = repeated_intervals(near, gram, owner, at, sides[:, 0], sides[:, 1], length)
            o, lo, hi = np.concatenate((o, owner[cov])), np.concatenate((lo, s)), np.concatenate((hi, e))
        o, lo, hi = _merge_by_owner(o, lo, hi)
        return pd.DataFrame(_pack(_bucket_of(o, groups), o, lo, hi), columns=["part", "owners", "starts", "ends"])

    contexts = dealt.groupBy("part").cogroup(repeated.groupBy("part")).applyInPandas(surrounded, "bucket int, done boolean, owners binary, x binary, y binary, sides binary, bytes binary")
    intervals = stage(contexts.groupBy("bucket").applyInPandas(sorted_, "part int, owners binary, starts binary, ends binary"), "repeated-intervals")
    del contexts
    release(spark)

    def kept(texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        o, lo, hi = (np.frombuffer(b"".join(spans[c]), np.int64) for c in ("owners", "starts", "ends"))
        o, lo, hi = _merge_by_owner(o, lo, hi)
        rows = []
        for doc, who, data in zip(texts["doc_id"], texts["ord"], texts["data"], strict=True):
            a, b = np.searchsorted(o, who, side="left"), np.searchsorted(o, who, side="right")
            at, out = 0, []
            for s, e in zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True):
                out.append(data[at:s])
                at = e
            left = b"".join([*out, data[at:]])
            rows.append((doc, len(data), len(data) - len(left), b - a, hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text binary" if with_text else "")
    return dealt.groupBy("part").cogroup(intervals.groupBy("part")).applyInPandas(kept, schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
