"""Sets of hashed word n-grams of many texts at once, and their bitmaps."""

from __future__ import annotations

import hashlib

import numpy as np

from docloom.llm._common import mix64, ragged

WORD_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed together; texts are gathered up to this size, longer ones go block by block.
BLOCK_BYTES = 1 << 19
#: Bits of a set's bitmap, by its size.
LEAST_BITS, MOST_BITS = 512, 1 << 16
_MASK = (1 << 64) - 1
_INVERSE = pow(WORD_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int) -> np.ndarray:
    p = np.full(BLOCK_BYTES, base, np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["pow"], _TABLES["inv"] = _powers(WORD_BASE), _powers(_INVERSE)
    return _TABLES["pow"], _TABLES["inv"]


def _hash_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a byte array, by prefix polynomial sums."""
    power, inverse = _tables()
    edge = np.flatnonzero(np.diff((~_SPACE[b]).view(np.int8), prepend=0, append=0))
    sums, shift = np.empty(len(edge), np.uint64), np.empty(len(edge), np.uint64)
    carry, scale, back = np.zeros(1, np.uint64), 1, 1
    with np.errstate(over="ignore"):
        for lo in range(0, len(b) + 1, BLOCK_BYTES):
            part = b[lo : lo + BLOCK_BYTES]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
            here = slice(*np.searchsorted(edge, [lo, lo + BLOCK_BYTES]))
            sums[here] = carry + total[edge[here] - lo] * np.uint64(scale)
            shift[here] = inverse[edge[here] - lo] * np.uint64(back)
            carry = carry + total[-1:] * np.uint64(scale)
            scale, back = scale * pow(WORD_BASE, BLOCK_BYTES, 1 << 64) & _MASK, back * pow(_INVERSE, BLOCK_BYTES, 1 << 64) & _MASK
        # Scaling to a common power makes equal words at different places equal.
        h = (sums[1::2] - sums[::2]) * shift[::2]
        return edge[::2], mix64(h ^ (edge[1::2] - edge[::2]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash for each word, A-Z lower-cased, text after text; and the words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    found, counts = [], np.zeros(len(raw), np.int64)
    lo = 0
    while lo < len(raw):
        hi, size = lo, 0
        while hi < len(raw) and (hi == lo or size + len(raw[hi]) <= BLOCK_BYTES):
            size += len(raw[hi]) + 1
            hi += 1
        at, h = _hash_words(np.frombuffer(b" ".join(raw[lo:hi]), np.uint8))
        starts = np.cumsum([0, *(len(r) + 1 for r in raw[lo : hi - 1])])
        counts[lo:hi] = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=hi - lo)
        found.append(h)
        lo = hi
    return np.concatenate([np.zeros(0, np.uint64), *found]), counts


def _rolled(w: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words."""
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(w) - n + 1), n, np.uint64)
        for i in range(n if len(h) else 0):
            h = mix64(h * np.uint64(0x9FB21C651E98DF25) + w[i : len(h) + i])
    return h


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a shorter text is one n-gram, no word none."""
    w, counts = word_hashes([t if isinstance(t, str) else "" for t in texts])
    ends = np.cumsum(counts)
    rolled = _rolled(w, words)
    out = []
    for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        out.append(np.unique(rolled[lo : hi - words + 1] if hi - lo >= words else _rolled(w[lo:hi], hi - lo) if hi > lo else w[:0]))
    return out


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return shingle_sets([text], words)[0]


def set_id(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    d = hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if not salt else hashlib.md5(salt.to_bytes(8, "little") + s.tobytes(), usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of two from twice its size on, within bounds."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    """A bitmap of each set, an element at its value modulo the bits: halves of one, combined, are one of half the bits."""
    out: list[bytes] = [b""] * len(sets)
    bits = bitmap_bits(np.array([len(s) for s in sets], np.int64))
    for width in np.unique(bits).tolist():
        where = np.flatnonzero(bits == width)
        step = max(1, (1 << 22) // width)
        for lo in range(0, len(where), step):
            some = where[lo : lo + step].tolist()
            grid = np.zeros((len(some), width), bool)
            grid[np.repeat(np.arange(len(some)), [len(sets[i]) for i in some]), (np.concatenate([sets[i] for i in some]) % np.uint64(width)).astype(np.int64)] = True
            for i, row in zip(some, np.packbits(grid, axis=1, bitorder="little"), strict=True):
                out[i] = row.tobytes()
    return out


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as bitmaps of fewer bits."""
    while rows.shape[1] * 64 > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


def later_in_run(run: np.ndarray, most: int = 1 << 21):
    """Index pairs (i, j), i before j, within runs of equal values, some at a time."""
    n = len(run)
    if not n:
        return
    end = np.searchsorted(run, run, side="right")
    left = end - np.arange(n) - 1
    total = np.cumsum(left)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        i = np.repeat(np.arange(lo, hi), left[lo:hi])
        if len(i):
            yield i, ragged(np.arange(lo, hi) + 1, left[lo:hi])
        lo = hi
