"""Piece ids against the library's own Viterbi, on the same pieces read as a model of that kind."""

import random
import struct
import time

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from docloom.llm import sentencepiece_codec

SF = "/root/testdata/sf0.001"


def varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value, shift, i = value | (b[i] & 127) << shift, shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def made(value: int) -> bytes:
    return bytes([value]) if value < 128 else bytes([value & 127 | 128]) + made(value >> 7)


def fields(b: bytes):
    i = 0
    while i < len(b):
        start = i
        key, i = varint(b, i)
        size, i = varint(b, i) if key & 7 == 2 else (4 if key & 7 == 5 else 8, i) if key & 7 in (1, 5) else (0, varint(b, i)[1])
        yield key >> 3, b[i : i + size], b[start : i + size]
        i += size


def message(number: int, body: bytes) -> bytes:
    return made(number << 3 | 2) + made(len(body)) + body


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces with the kind of the model set to the one that Viterbi decodes; scores stay within single precision."""
    out = b""
    for number, body, raw in fields(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()):
        if number == 1:
            raw = message(1, b"".join(made(2 << 3 | 5) + struct.pack("<f", max(-5e4, struct.unpack("<f", v)[0])) if k == 2 else r for k, v, r in fields(body)))
        elif number == 2:
            raw = message(2, b"".join(made(3 << 3) + made(1) if k == 3 else r for k, _, r in fields(body)))
        out += raw
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(out)
    return str(path)


def test_ids_are_the_librarys(unigram):
    texts = [t or "" for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()]
    rng = random.Random(4)
    texts += ["".join(rng.choice("abcdeésT  .,漢字語🙂\n") for _ in range(rng.randrange(120))) for _ in range(300)]
    texts += ["supercalifragilistic" * 30, "漢字かな交じり文" * 50, "x" * 700, "aAbB9_" * 200]
    codec, library = sentencepiece_codec.PieceCodec(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text[:80]
        assert codec.decode(ids) == text


def test_a_word_without_spaces_takes_little_time():
    codec = sentencepiece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "漢字仮名交文日本語学校時間"):
        word = "".join(rng.choice(letters) for _ in range(200_000))
        began = time.process_time()
        assert codec.decode(codec.encode([word])[0]) == word
        assert time.process_time() - began < 30
