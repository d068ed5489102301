"""Packing documents into sequences as a cutting-stock problem.

Documents are tokenised once and cut only where they exceed a sequence. Piece lengths, in classes of
16 tokens, give a histogram of at most 256 bins; a linear program over patterns (multisets of
classes that fit a sequence) is solved by column generation, an unbounded-knapsack dynamic program
pricing new patterns. Rounded patterns are assigned to pieces by their rank within their class.
The driver sees the histogram only, whose size is bounded by the sequence length.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm._common import bounded_batches, claim_cache, ragged, ranked_within, trim
from docloom.scratch import stage

SEQUENCE = 4096
GRAIN = 16
END_ID = 2
#: Characters of texts that are encoded at a time.
SLICE = 3_000_000
#: Words and pre-tokens that a worker remembers before it starts anew: some 150 MB, as an executor has several workers.
CACHE_WORDS, CACHE_PARTS = 250_000, 60_000
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Words and texts that only the tokenizer itself splits and lower-cases right.
ODD = re.compile(r"<\||[\x00-\x1f\x7f-\x9fΣİ]")
ODD_TEXT = re.compile(r"<\||[\x00-\x08\x0e-\x1f\x7f-\x9fΣİ]")
#: Signs that are one pre-token where they end a word of letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of a pre-token from which on the tokenizer merges it: rows of letters are merged in time that grows with their square.
LONG = 64
#: White space to Python but not to the tokenizer; such texts go to it whole.
NOT_SPACE = re.compile(r"[\x1c-\x1f]")


class PairMerger:
    """Byte-pair merges of many pre-tokens at once; those of the same length are a matrix.

    In each round every row merges its leftmost pair of lowest rank. Ranks come from an open hash
    table over pairs, and only the two pairs beside a merge are looked up again.
    """

    NONE = np.int32(2**31 - 1)
    BITS = 20

    def __init__(self, vocab: dict[str, int], merges: list):
        # Bytes that are not printable get the letters from U+0100 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + "</w>"] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        size = 1 << self.BITS
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, self.NONE, np.int32)
        packed = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        for rank, (key, at) in enumerate(zip(packed.tolist(), self._slot(packed).tolist(), strict=True)):
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) & (size - 1)
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        at = self._slot(keys)
        got = self.keys[at]
        while (more := (got != keys) & (got >= 0)).any():
            at = np.where(more, (at + 1) & ((1 << self.BITS) - 1), at)
            got = self.keys[at]
        return np.where(got == keys, self.ranks[at], self.NONE)

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in turn, and how many each has."""
        n, width = ids.shape
        lens = np.full(n, width)
        if width > 1:
            rank = self._rank(ids[:, :-1], ids[:, 1:])
            live = np.flatnonzero(rank.min(1) < self.NONE)
            while len(live):
                part, r, m = ids[live], rank[live], lens[live]
                rows, at = np.arange(len(live)), r.argmin(1)
                part[rows, at] = self.made[r[rows, at]]
                m -= 1
                cols = np.arange(width)
                part = np.take_along_axis(part, np.minimum(cols + (cols > at[:, None]), width - 1), 1)
                cols = np.arange(width - 1)
                r = np.take_along_axis(r, np.minimum(cols + (cols > at[:, None]), width - 2), 1)
                r[:, -1] = self.NONE
                has = at + 1 < m
                r[rows, at] = np.where(has, self._rank(part[rows, at], part[rows, np.minimum(at + 1, width - 1)]), self.NONE)
                back = np.flatnonzero(at > 0)
                r[back, at[back] - 1] = self._rank(part[back, at[back] - 1], part[back, at[back]])
                ids[live], rank[live], lens[live] = part, r, m
                live = live[r.min(1) < self.NONE]
        return ids[np.arange(width) < lens[:, None]], lens

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, and where those of each start and how many they are."""
        column = pa.array(words, pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64)[: len(words) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        size = np.diff(at)
        order = np.argsort(size, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(size[order])) + 1, [len(order)])) if len(order) else [0]
        found, lens = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64)
        for p, q in zip(cuts[:-1], cuts[1:], strict=True):
            length = int(size[order[p]])
            step = max(1, 200_000 // max(1, length))
            for lo in range(p, q if length else p, step):
                some = order[lo : min(lo + step, q)]
                grid = data[at[some][:, None] + np.arange(length)]
                ids = self.first[grid]
                ids[:, -1] = self.last[grid[:, -1]]
                flat, lens[some] = self._merge(ids)
                found.append(flat)
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        return np.concatenate(found), starts, lens


class WordTokenizer:
    """Token ids of whole texts by way of their distinct words.

    The vocabulary never joins across white space, so ids of a text are ids of its words in turn.
    Unknown words are split into pre-tokens, and unknown pre-tokens are merged together in batches.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.split = regex.compile(PRETOKEN).findall
        spec = json.loads(self.tok.to_str())
        self.merger = PairMerger(spec["model"]["vocab"], spec["model"]["merges"])
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.sub: dict[str, list[int]] = {}
        self.flat, self.starts, self.lens, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _parts(self, w: str) -> list[str] | None:
        """Pre-tokens of a word; None if only the tokenizer finds them."""
        if ODD.search(w):
            return None
        low = w if w.islower() and w.isascii() else unicodedata.normalize("NFC", w).lower()
        return self.split(low) if unicodedata.is_normalized("NFC", low) else None

    def _learn(self, words: list[str], plain: bool) -> None:
        """``plain``: they are words of texts in lower case without anything odd."""
        # Words of letters are one pre-token each and need no parts.
        whole = [w for w in words if w.isalpha() and len(w) <= LONG // 4] if plain else []
        if whole:
            self._keep(whole, *self.merger.encode(whole))
            words = [w for w in words if w not in self.place]
        parts: list[list[str] | None] = []
        for w in words:
            if plain and w.isalpha():
                parts.append([w])
                continue
            body = w.rstrip(MARKS)
            if plain:
                parts.append([body, w[len(body) :]] if body.isalpha() else self.split(w))
                continue
            # Lower-case letters are one pre-token, and so are signs behind them.
            if body.isascii() and body.isalpha() and body.islower() or body.isalpha() and body == body.lower() and unicodedata.is_normalized("NFC", body) and not ODD.search(w):
                parts.append([body, w[len(body) :]] if len(body) < len(w) else [body])
            else:
                parts.append(self._parts(w))
        new = list({p for ps in parts if ps for p in ps if p not in self.sub})
        # Pre-tokens of one merge table: the tokenizer's own ids of long ones are the same.
        long = {p: self.tok.encode(p, add_special_tokens=False).ids for p in new if len(p) > LONG // 4 and len(p.encode()) > LONG}
        if long:
            new = [p for p in new if p not in long]
            self.sub.update(long)
        ids, starts, lens = self.merger.encode(new)
        self.sub.update((p, ids[i : i + n].tolist()) for p, i, n in zip(new, starts.tolist(), lens.tolist(), strict=True))
        sub = self.sub
        lists = [
            self.tok.encode(w, add_special_tokens=False).ids
            if ps is None
            else sub[ps[0]]
            if len(ps) == 1
            else list(itertools.chain.from_iterable(map(sub.__getitem__, ps)))
            for w, ps in zip(words, parts, strict=True)
        ]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        self._keep(words, np.fromiter(itertools.chain.from_iterable(lists), np.int32), np.cumsum(lens) - lens, lens)

    def _keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        n0 = len(self.place)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n0 + len(words) > len(self.starts):
            self.starts, self.lens = np.concatenate((self.starts, np.zeros_like(self.starts))), np.concatenate((self.lens, np.zeros_like(self.lens)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n0 : n0 + len(words)] = self.used + starts
        self.lens[n0 : n0 + len(words)] = lens
        self.used += len(ids)
        self.place.update(zip(words, range(n0, n0 + len(words)), strict=True))

    @staticmethod
    def _plain(t: str) -> str | None:
        """A text in lower case, if that and its words are plain."""
        if ODD_TEXT.search(t):
            return None
        low = t.lower()
        return low if t.isascii() or unicodedata.is_normalized("NFC", t) and unicodedata.is_normalized("NFC", low) else None

    def _ids(self, words: list[str], plain: bool) -> np.ndarray:
        """Places of distinct words among those known, after learning the others."""
        if len(self.sub) > CACHE_PARTS:
            self.sub = {}
        unknown = [w for w in words if w not in self.place]
        if unknown and len(self.place) + len(unknown) > CACHE_WORDS:
            self._clear()
            trim()
            unknown = words
        if unknown:
            self._learn(unknown, plain)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def _units(self, words: pa.DictionaryArray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of what plain words are made of, and where texts end among them: letters and the signs behind them are known apart."""
        bodies = pc.utf8_rtrim(words.dictionary, MARKS)
        cut = pc.and_(pc.utf8_is_alpha(bodies), pc.less(pc.binary_length(bodies), pc.binary_length(words.dictionary)))
        signs = [w[n:] for w, n in zip(words.dictionary.filter(cut).to_pylist(), pc.utf8_length(bodies.filter(cut)).to_pylist(), strict=True)]
        some = pa.chunked_array([pc.if_else(cut, bodies, words.dictionary), pa.array(signs, pa.large_string())]).combine_chunks().dictionary_encode()
        place = self._ids(some.dictionary.to_pylist(), True)[some.indices.to_numpy()]
        both = np.full((len(bodies), 2), -1, np.int64)
        both[:, 0] = place[: len(bodies)]
        both[np.asarray(cut), 1] = place[len(bodies) :]
        at = both[words.indices.to_numpy()].ravel()
        many = np.cumsum(at.reshape(-1, 2)[:, 1] >= 0)
        return at[at >= 0], ends + np.concatenate(([0], many))[ends]

    def _of(self, at: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        lens = self.lens[at].astype(np.int64)
        ids = self.flat[ragged(self.starts[at], lens)]
        return np.split(ids, np.concatenate(([0], np.cumsum(lens)))[ends][:-1]) if len(ends) else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # Where lower-casing is plain it is done for the whole text, so that there are fewer words to know.
        low = [self._plain(t) for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        if easy := [i for i, t in enumerate(low) if t is not None]:
            lists = pc.utf8_split_whitespace(pa.array([low[i] for i in easy], pa.large_string()))
            words = lists.flatten().dictionary_encode()
            ends = np.asarray(lists.offsets)[1:].astype(np.int64) - lists.offsets[0].as_py()
            at, ends = self._units(words, ends) if len(words) else (np.zeros(0, np.int64), ends)
            for i, ids in zip(easy, self._of(at, ends), strict=True):
                out[i] = ids
        for i, t in enumerate(texts):
            if out[i] is None:
                parts = [t] if NOT_SPACE.search(t) else t.split()
                distinct = list(dict.fromkeys(parts))
                where = dict(zip(distinct, self._ids(distinct, False).tolist(), strict=True))
                out[i] = self._of(np.array([where[w] for w in parts], np.int64), np.array([len(parts)]))[0]
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    claim_cache("packing", _TOKENIZERS.clear)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of tokenised documents: full sequences and one rest each, with a checksum of their ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(tokenizer_path)
        for b in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            # Some MB of text at a time: enough for its words to repeat.
            starts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // SLICE, prepend=-1))
            for i, j in zip(starts, [*starts[1:], len(texts)], strict=True):
                for d, ids in zip(b["doc_id"][i:j], tok.encode(texts[i:j]), strict=True):
                    ids = np.append(ids, END_ID).astype("<u4")
                    for s in range(0, len(ids), SEQUENCE):
                        part = ids[s : s + SEQUENCE]
                        rows.append((d, s, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.tolist()] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the multiset of sizes of the highest value."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    small = int(sizes.min())
    for c in range(small, capacity + 1):
        k = int(np.searchsorted(sizes, c, side="right"))
        got = values[:k] + best[c - sizes[:k]]
        i = int(got.argmax())
        if got[i] > best[c - 1] + 1e-12:
            best[c], took[c] = got[i], i
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), counts


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps over whole rows. The driver holds a JVM beside it, where threaded linear algebra may not come back."""
    n = len(matrix)
    both = np.hstack((matrix, np.eye(n)))
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, n:]


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, max_rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is used, covering the demand exactly; by column generation.

    Revised simplex over the pattern LP. Columns are priced by ``best_pattern``, at duals drawn towards those of
    the best bound so far, which keeps them from swinging; Farley's bound
    stops it within ``gap`` of the optimum. Floors of the solution are kept, and what they leave
    uncovered is placed best-fit decreasing. Products are sums of elements, without a threaded library.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = (inverse * demand).sum(1)
    bound, centre = 0.0, np.zeros(m)
    for round_ in range(max_rounds):
        duals = inverse.sum(axis=0)
        for pull in (0.8, 0.0):
            at = np.maximum(pull * centre + (1 - pull) * duals, 0)
            value, column = best_pattern(at, sizes, capacity)
            if (lower := float((at * demand).sum()) / max(value, 1e-12)) > bound:
                bound, centre = lower, at / value
            if (duals * column).sum() > 1 + 1e-9:
                break
        else:
            break  # no pattern is worth more than a sequence
        if x.sum() <= bound * (1 + gap):
            break
        step = (inverse * column).sum(1)
        up = step > 1e-9
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = max(0.0, ratio[out])
        x = x - theta * step
        x[out] = theta
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        if round_ % 200 == 199:
            inverse = _inverse(basis)
            x = np.maximum((inverse * demand).sum(1), 0)
    left = demand.astype(np.int64).copy()
    out_patterns: list[tuple[np.ndarray, int]] = []
    for j in np.argsort(-x):
        column = np.rint(basis[:, j]).astype(np.int64)
        need = column > 0
        uses = min(int(x[j] + 1e-7), int((left[need] // column[need]).min()) if need.any() else 0)
        if uses > 0:
            out_patterns.append((column, uses))
            left -= uses * column
    bins: list[list] = []  # room, counts
    for i in range(m - 1, -1, -1):
        for _ in range(int(left[i])):
            fits = [b for b in bins if b[0] >= sizes[i]]
            b = min(fits, key=lambda b: b[0]) if fits else [capacity, np.zeros(m, np.int64)]
            if not fits:
                bins.append(b)
            b[0] -= sizes[i]
            b[1][i] += 1
    return out_patterns + [(b[1], 1) for b in bins]


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id start length ids_crc32 doc_tokens sequence_id offset``.

    A null or empty text is a document of the end id alone. Texts longer than a sequence are cut into
    full sequences and a rest. Rows that repeat an id are packed as often as they occur; ties of rank are
    rows that are the same. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = stage(
        cut_pieces(docs, tokenizer_path, id_col, text_col).withColumn("cls", F.ceil(F.col("length") / GRAIN).cast("int")),
        "pieces",
    )
    # At most SEQUENCE / GRAIN rows.
    histogram = sorted((r.cls, r["count"]) for r in pieces.groupBy("cls").count().collect())
    sizes, demand = np.array([c for c, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    patterns = cutting_stock(sizes, demand, SEQUENCE // GRAIN) if histogram else []
    # Per class: from which rank on a pattern is used, its first sequence, pieces a sequence, first slot there.
    table: dict[int, list[np.ndarray]] = {int(c): [np.zeros(0, np.int64)] * 4 for c in sizes}
    runs: dict[int, list[tuple[int, int, int, int]]] = {int(c): [] for c in sizes}
    used, sequence = np.zeros(len(sizes), np.int64), 0
    for column, uses in patterns:
        slot = 0
        for i in np.flatnonzero(column):
            runs[int(sizes[i])].append((int(used[i]), sequence, int(column[i]), slot))
            used[i] += uses * column[i]
            slot += int(column[i])
        sequence += uses
    table = {c: [np.array(v, np.int64) for v in zip(*r, strict=True)] for c, r in runs.items()}

    @F.pandas_udf("struct<sequence_id: long, slot: long>")
    def assigned(cls: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        kinds, ranks = cls.to_numpy(), rank.to_numpy()
        for c in np.unique(kinds):
            of = kinds == c
            since, first, each, at = table[int(c)]
            k = np.searchsorted(since, ranks[of], side="right") - 1
            past = ranks[of] - since[k]
            seq[of], slot[of] = first[k] + past // each[k], at[k] + past % each[k]
        return pd.DataFrame({"sequence_id": seq, "slot": slot})

    ranked = ranked_within(pieces, "cls", ["doc_id", "start", "ids_crc32"], str(max(demand, default=0)), 256, 1024)
    placed = ranked.withColumn("to", assigned("cls", "rank"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "to.sequence_id", "to.slot").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
