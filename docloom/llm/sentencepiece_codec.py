"""SentencePiece encoding and decoding by batched Viterbi.

Pieces never join across a space, so a text is its words in turn. Unknown words of the same length
advance together: at each position the hashes of all substrings that end there probe the sorted
hashes of the pieces, and a vectorised maximum over where the last piece starts stores backpointers.
Characters outside the vocabulary become byte pieces, which makes decoding exact.

The best segmentation is the one of the highest sum of piece scores; of ties, the one whose last
piece is longest, at every position.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import bounded_batches, claim_cache, mix64, ragged

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
LENGTH_SALT = np.uint64(0xD6E8FEB86659FD93)
#: The sieve has a flag for each value of the top 22 bits of a piece's hash.
SIEVE_SHIFT = np.uint64(42)
#: Score of a character that has to be spelt in bytes: below any chain of pieces over the same span.
BYTE_SCORE = -1e12
CACHE_WORDS = 600_000
#: Characters from which on a word is cut where no piece spans, so that its parts advance together.
LONG = 40
PUNCTUATION = ",.;:!?()[]{}<>\"#$%&*+=|~^@`"


class PieceCodec:
    """Encoder and decoder over the pieces and scores of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.longest = max(len(self.pieces[i]) for i in usable)
        with np.errstate(over="ignore"):
            keys = np.array([self._hash(self._points(self.pieces[i])) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(keys >> SIEVE_SHIFT).astype(np.int64)] = True
        with np.errstate(over="ignore"):
            self.powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(self.longest, BASE, np.uint64))))
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        assert len(np.unique(self.keys)) == len(self.keys), "two pieces share a hash"
        self.scores = np.array([sp.get_score(int(i)) for i in self.ids])
        self.lengths = np.array([len(self.pieces[i]) for i in self.ids])
        width = self.longest
        self.table = np.zeros((len(self.ids), width), np.uint32)
        for r, i in enumerate(self.ids):
            p = self._points(self.pieces[i])
            self.table[r, : len(p)] = p
        self.out = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        # No piece joins these to what stands before them, so a word may end there: fewer words to know.
        ends = set(PUNCTUATION)
        pairs = {(a, b) for i in usable for a, b in zip(self.pieces[i], self.pieces[i][1:])}
        self.pairs = {a + b for a, b in pairs}
        while cut := {b for a, b in pairs if b in ends and a not in ends and a != SPACE}:
            ends -= cut
        e = "".join(map(re.escape, sorted(ends)))
        # A word with the spaces before it; line breaks are in no piece and stand alone.
        self.words = re.compile(rf" *[^ \n{e}]+| *[{e}]+[^ \n{e}]*|\n| +" if ends else r" *[^ \n]+|\n| +").findall
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.known: list[np.ndarray] = []
        self.flat, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _points(s: str) -> np.ndarray:
        return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)

    @staticmethod
    def _hash(points: np.ndarray) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for p in points:
                h = h * BASE + np.uint64(p) + np.uint64(1)
            return mix64(np.array([h + np.uint64(len(points)) * LENGTH_SALT]))[0]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the sorted pieces with these hashes, -1 where there is none."""
        row = np.full(hashes.shape, -1, np.int32)
        maybe = np.nonzero(self.sieve[(hashes >> SIEVE_SHIFT).astype(np.int64)])
        h = hashes[maybe]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        row[maybe] = np.where(self.keys[at] == h, at, -1)
        return row

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers for a matrix of words of one length: last piece's start and its row (-1: bytes)."""
        n, length = words.shape
        best = np.zeros((n, length + 1))
        start, row = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        prefix = np.zeros((n, length + 1), np.uint64)
        rows = np.arange(n)
        with np.errstate(over="ignore"):
            for end in range(1, length + 1):
                prefix[:, end] = prefix[:, end - 1] * BASE + words[:, end - 1].astype(np.uint64) + np.uint64(1)
            for end in range(1, length + 1):
                first = max(0, end - self.longest)
                size = np.arange(end - first, 0, -1)
                h = mix64(prefix[:, end][:, None] - prefix[:, first:end] * self.powers[size] + size.astype(np.uint64) * LENGTH_SALT)
                which = self._find(h)
                hit = which >= 0
                for k in np.flatnonzero(hit.any(0)):  # the same characters, not only the same hash
                    r = np.flatnonzero(hit[:, k])
                    ok = (self.table[which[r, k], : size[k]] == words[r, first + k : end]).all(1) & (self.lengths[which[r, k]] == size[k])
                    if not ok.all():
                        hit[r[~ok], k] = False
                total = np.where(hit, best[:, first:end] + self.scores[which], -np.inf)
                spelt = ~hit[:, -1]
                total[spelt, -1] = best[spelt, end - 1] + BYTE_SCORE
                pick = total.argmax(1)
                best[:, end], start[:, end] = total[rows, pick], first + pick
                row[:, end] = np.where(hit[rows, pick], which[rows, pick], -1)
        return start, row

    def _cut(self, word: str) -> list[str]:
        """Parts of a long word that no piece spans: the best segmentation goes through every such place."""
        ends = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs]
        return [word[i:j] for i, j in zip([0, *ends], [*ends, len(word)], strict=True)]

    def segment(self, words: list[str]) -> list[list[int]]:
        """Piece ids of each word, which is taken as it is (spaces already marked)."""
        parts = [self._cut(w) if len(w) > LONG else [w] for w in words]
        known = list(dict.fromkeys(itertools.chain.from_iterable(parts)))
        ids = dict(zip(known, self._segment(known), strict=True))
        return [ids[p[0]] if len(p) == 1 else list(itertools.chain.from_iterable(map(ids.__getitem__, p))) for p in parts]

    def _segment(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, where in by_length.items():
            step = max(1, 100_000 // max(1, length))
            for lo in range(0, len(where), step):
                some = where[lo : lo + step]
                points = self._points("".join(words[i] for i in some)).reshape(len(some), length)
                start, row = self.viterbi(points)
                rows, at, steps, spelt = np.arange(len(some)), np.full(len(some), length), [], np.zeros(len(some), bool)
                while (live := at > 0).any():
                    s, r = start[rows, at], row[rows, at]
                    spelt |= live & (r < 0)
                    steps.append(np.where(live, np.where(r >= 0, self.ids[r], -2 - s), -1))
                    at = np.where(live, s, at)
                path = np.stack(steps[::-1], axis=1)  # right-aligned: -1 before a shorter path
                skip = (path == -1).sum(1).tolist()
                for i, ids, k, odd, j in zip(some, path.tolist(), skip, spelt.tolist(), range(len(some)), strict=True):
                    ids = ids[k:]
                    if odd:
                        ids = [x for v in ids for x in ([v] if v >= 0 else self.byte_ids[list(chr(points[j, -2 - v]).encode("utf-8", "surrogatepass"))].tolist())]
                    out[i] = ids
        return out

    def _learn(self, new: list[str]) -> None:
        # A mark that stands in the text itself is spelt in bytes, so that it comes back as a mark.
        parts = [w.replace(SPACE, "\0").replace(" ", SPACE) if SPACE in w else w.replace(" ", SPACE) for w in new]
        mark = self.byte_ids[list(SPACE.encode())].tolist()
        nul = int(self.byte_ids[0])
        lists = self.segment(parts)
        for i, w in enumerate(new):
            if SPACE in w:
                zero = iter([c == "\0" for c in w.replace(SPACE, "\1") if c in "\0\1"])
                lists[i] = list(itertools.chain.from_iterable(([x] if x != nul or next(zero) else mark) for x in lists[i]))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
        self.lens = np.concatenate((self.lens, lens))
        self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(lens.sum()))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a space is put before it, as the models expect, unless it is empty."""
        words = [self.words(" " + t) if t else [] for t in texts]
        unknown = set(itertools.chain.from_iterable(words)) - self.place.keys()
        if len(self.place) + len(unknown) > CACHE_WORDS:
            self._clear()
            unknown = set(itertools.chain.from_iterable(words))
        if unknown:
            self._learn(list(unknown))
        at = np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(words)), np.int64)
        lens = self.lens[at]
        ids = self.flat[ragged(self.starts[at], lens)] if len(at) else np.zeros(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(lens)))[np.cumsum([len(w) for w in words], dtype=np.int64)] if words else []
        return np.split(ids, ends[:-1]) if len(ends) else []

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


_CODECS: dict[str, PieceCodec] = {}


def _codec(path: str) -> PieceCodec:
    claim_cache("pieces", _CODECS.clear)
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for each row. A null or empty text has no ids; texts are whole."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(model_path)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "ids": codec.encode(texts)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` for each row; null ids count as none and give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(model_path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": [codec.decode(np.asarray(i)) if i is not None else "" for i in b["ids"]]})

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, text string")


def codec_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id n_ids ids_crc32 decoded_crc32 round_trip``: every text encoded, decoded and compared."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(model_path)
        for b in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for lo in range(0, len(texts), 256):
                for d, t, ids in zip(b["doc_id"][lo : lo + 256], texts[lo : lo + 256], codec.encode(texts[lo : lo + 256]), strict=True):
                    back = codec.decode(ids)
                    rows.append((d, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == t))
            yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return codec_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
