"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A text is cut into words by the vocabulary's pattern, and each distinct word is merged once. A short
word holds its part boundaries and the ranks of adjacent parts in contiguous arrays: the minimum is
scanned for, its boundary deleted and the two ranks beside it refreshed, until no pair has a rank. In
words of more than LONG bytes, where such scans would grow with the square of the length, the same
merges are taken in the same order from a heap over linked parts.

Ranks belong to pairs of parts, not to the bytes they make: a pair that no merge names never joins,
even where its bytes are a token.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import claim_cache, ragged

#: Bytes of a word up to which its ranks are scanned, and up to which it is remembered.
LONG = 64
#: Words that a worker remembers before it starts anew.
CACHE_WORDS = 500_000
#: Bytes of text that are encoded at a time.
SLICE = 4 << 20
NONE = 1 << 30
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BytePairs:
    """Merges over the bytes of one word."""

    def __init__(self, vocab: dict[str, int], merges: list):
        # Bytes that are not printable stand as the letters from U+0100 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.byte_of = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            self.rank.setdefault(vocab[a] << 20 | vocab[b], r)
        self.made = [vocab[a + b] for a, b in pairs]

    def encode(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        return self._scan(parts)[0] if len(parts) <= LONG else self._heap(parts)

    def _scan(self, parts: list[int]) -> tuple[list[int], list[int]]:
        """Token ids and their boundaries in the word."""
        rank, made = self.rank.get, self.made
        bounds = list(range(len(parts) + 1))
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < NONE:
            at = ranks.index(low)  # of equal ranks the leftmost
            parts[at] = made[low]
            del parts[at + 1], bounds[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] << 20 | parts[at + 1], NONE)
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 20 | parts[at], NONE)
        return parts, bounds

    def _heap(self, parts: list[int]) -> list[int]:
        rank, made, n = self.rank.get, self.made, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:  # one of them has been merged since
                continue
            parts[i], parts[j], after[i] = made[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(parts[a] << 20 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]


class _Words(dict):
    """Little-endian ids of each word seen; long words are not kept."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.encode(raw)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= LONG:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed


class ByteBpeCodec:
    """Encoder and decoder over a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], spec["added_tokens"]
        pairs = BytePairs(vocab, spec["model"]["merges"])
        self.known = _Words(pairs.encode)
        self.split = regex.compile(PRETOKEN).findall
        # Letters and digits that came to Unicode of late are such to one library and not to another.
        wide = regex.compile(r"[\p{L}\p{N}]").match
        late = np.array([i for i in range(0x80, 0x110000) if unicodedata.category(chr(i)) == "Cn" and wide(chr(i))])
        runs = np.split(late, np.flatnonzero(np.diff(late) > 1) + 1) if len(late) else []
        self.late = re.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) + "]").search if runs else lambda text: None
        self.split_late = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in added}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None
        table = {i: bytes(map(pairs.byte_of.__getitem__, t)) for t, i in vocab.items() if t not in self.added}
        table |= {i: t.encode() for t, i in self.added.items()}
        out = [table.get(i, b"") for i in range(max(table) + 1)]
        self.lens = np.array([*map(len, out), 0])
        self.starts, self.flat = np.cumsum(self.lens) - self.lens, np.frombuffer(b"".join(out), np.uint8)

    def _words(self, text: str) -> list[str]:
        if not text.isascii() and self.late(text):
            return [text[a:b] for _, (a, b) in self.split_late(text)]
        return self.split(text)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; the vocabulary's added tokens are found in it first."""
        look = self.known.__getitem__
        if self.cut_added is None or not any(t in text for t in self.added):
            return np.frombuffer(b"".join(map(look, self._words(text))), "<u4")
        parts = self.cut_added(text)  # texts and added tokens in turn
        return np.frombuffer(b"".join(struct.pack("<I", self.added[p]) if i % 2 else b"".join(map(look, self._words(p))) for i, p in enumerate(parts)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Their bytes as text; ids that the vocabulary lacks are nothing, broken characters the replacement mark."""
        at = np.minimum(np.asarray(ids, np.int64), len(self.lens) - 1)
        at[at < 0] = len(self.lens) - 1
        return self.flat[ragged(self.starts[at], self.lens[at])].tobytes().decode("utf-8", "replace")


_CODECS: dict[str, ByteBpeCodec] = {}


def _codec(path: str) -> ByteBpeCodec:
    claim_cache("byte pairs", _CODECS.clear)
    if path not in _CODECS:
        _CODECS[path] = ByteBpeCodec(path)
    return _CODECS[path]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE bytes of text, one row at least."""
    sizes = np.asarray(batch.column(column).cast(pa.large_string()).fill_null("").to_pandas().map(len), np.int64)
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1
    for a, b in zip([0, *ends], [*ends, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<long>`` of each row. A null or empty text has no ids; texts are whole, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            for s in slices(b, "text"):
                ids = [codec.encode(t or "").astype(np.int64) for t in s.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<long>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of each row. Null ids, also single ones, count as none; no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            texts = [codec.decode(np.array([i for i in ids or [] if i is not None], np.int64)) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def codec_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id n_tokens ids_sha256 decoded_sha256`` of each row: its text encoded, and decoded from those ids.

    Null texts count as empty, null ids of documents stay null, repeated rows stay, and other columns are left
    out. Only digests leave a task, so no long list of ids moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            for s in slices(b, "text"):
                n, raw, back = [], [], []
                for t in s.column("text").to_pylist():
                    ids = codec.encode(t or "")
                    n.append(len(ids))
                    raw.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    back.append(hashlib.sha256(codec.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(n, pa.int64()), pa.array(raw, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return codec_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
