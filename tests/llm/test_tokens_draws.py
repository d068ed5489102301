"""Byte-pair codes, fill-in-middle and resampling against the library, exact round trips and plain programs."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import bpe_codec, fill_middle, resampling

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "TEXT string, doc_id long, text string, rank long, score string"


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.ByteBpeCodec(BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def odd_texts(n: int) -> list[str]:
    rnd = random.Random(5)
    signs = "abcdeéß \n\t'0123٣中文<|>՘ \U00010940 don't we'll ...!!\x00\x1c\x85\xa0‍👩"
    made = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    made += [t + "<|endoftext|>" + t for t in made[:50]] + ["<|endoftext|>", "<|endoftext|><|endoftext|> <|endoftext", "  <|endoftext|>  "]
    made += ["".join(rnd.choice("abcdehtion") for _ in range(k)) for k in (63, 64, 65, 66, 500)] + ["a" * 1000, " " * 300, "é" * 200, "\n" * 100 + "x"]
    return made


def test_bpe_ids_are_the_librarys(codec, library):
    for t in odd_texts(3000):
        want = library.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert got.tolist() == want, repr(t)
        assert codec.decode(got) == t


def test_bpe_decodes_any_ids(codec, library):
    rnd = random.Random(6)
    for _ in range(500):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 12))]
        assert codec.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode(np.array([-1, 60_000, 64])) == library.decode([64])


def test_bpe_boundaries_and_long_words(codec):
    pairs = codec.known.encode.__self__
    word = b"internationalization"
    parts, bounds = pairs._scan([pairs.first[b] for b in word])
    out = [codec.flat[codec.starts[p] : codec.starts[p] + codec.lens[p]].tobytes() for p in parts]
    assert out == [word[a:b] for a, b in zip(bounds, bounds[1:])]
    rnd = random.Random(7)
    for _ in range(300):  # both ways to merge agree on words of any length
        w = "".join(rnd.choice("aeinrst ") for _ in range(rnd.randint(1, 150))).encode()
        first = [pairs.first[b] for b in w]
        assert pairs._scan(list(first))[0] == pairs._heap(list(first))


def test_bpe_of_the_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe_codec.op13_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_edges(spark, library):
    rows = [("a", 1, None, 1, "x"), ("b", 1, "", 2, None), (None, None, "héllo  wörld", 3, "y"), ("c", 2, "same", 4, "z"), ("c", 2, "same", 4, "z"), ("d", 3, "word " * 50_000, 5, "z")]
    docs = spark.createDataFrame([r[1:] for r in rows], SCHEMA.removeprefix("TEXT string, "))
    got = bpe_codec.codec_digests(docs, BPE).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((r[1] or 0, len(library.encode(r[2] or "").ids)) for r in rows)
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(docs, BPE), BPE).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[1] or 0, r[2] or "") for r in rows)
    assert bpe_codec.codec_digests(docs.limit(0), BPE).count() == 0
    broken = spark.createDataFrame([(1, None), (2, [None, 64]), (3, [])], "doc_id long, ids array<long>")
    assert {r.doc_id: r.text for r in bpe_codec.decode_documents(broken, BPE).collect()} == {1: "", 2: "a", 3: ""}


def plain_fill(doc_id, text) -> tuple:
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, digest = len(tokens), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle_against_plain(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = fill_middle.op12_fill_middle(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, pre, mid, out = plain_fill(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, pre, mid, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_fill_middle_edges(spark):
    odd = ["", None, " ", "\t\n", "<P>", "a <S> b", "<M", "P> <S", "<", ">", "<<P", "a\x00b  c", " 中文　é 👩‍👩 ", "\x0b\x0c x", "x\x1cy \x85 z", "w " * 60_000]
    rows = [(i * 20 + k, t, 1, None) for i, t in enumerate(odd) for k in range(20)] + [(None, "no id here", 1, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, output string")
    made = fill_middle.fill_in_middle(docs)
    want = sorted((-1 if d is None else d, *plain_fill(d, t)[:2], plain_fill(d, t)[4]) for d, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n, r.form, r.output) for r in made.collect()) == want
    back = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in fill_middle.restore(made).collect())
    assert back == sorted((-1 if d is None else d, t or "") for d, t, *_ in rows)
    assert fill_middle.fill_digests(docs.limit(0)).count() == 0
    share = [r.form for r in fill_middle.fill_in_middle(docs, fim=100, spm=0).filter("doc_id >= 240").collect()]
    assert set(share) == {"psm"} and fill_middle.fill_in_middle(docs, fim=0).filter("form <> 'plain'").count() == 0


def plain_features(text) -> tuple[int, list[int]]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain_draw(docs: list, target: list, percent=25, least=20) -> list:
    raw, want = np.zeros(10000), np.zeros(10000)
    for _, t in docs:
        np.add.at(raw, plain_features(t)[1], 1)
    for t in target:
        np.add.at(want, plain_features(t)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (raw.sum() + 10000) / ((a + 1) * (want.sum() + 10000)))) for a, b in zip(raw, want)]
    out = []
    for d, t in docs:
        n, found = plain_features(t)
        weight = math.floor(sum(gain[f] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100]):
        r.append(place + 1)
    return [tuple(r[:4] + [r[5] if len(r) > 5 else None]) for r in out]


def order(rows) -> list:
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_features_of_odd_texts():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aBcéÉ中 z09-.\x7f\x00") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["", None, "x" * 100 + " " + "y" * 33 + " " + "z" * 32 + " q", "é" * 50 + " a " + "b" * 40, "end", "start"]
    found, text, n = resampling.hashed_features(pa.array(["skipped", *texts])[1:])
    for i, t in enumerate(texts):
        words, want = plain_features(t)
        assert n[i] == words and sorted(found[text == i].tolist()) == sorted(want), repr(t)
    assert [len(x) for x in resampling.hashed_features(pa.array([], pa.string()))] == [0, 0, 0]


def test_resampling_against_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in resampling.op11_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert order(rows) == order(plain_draw(docs, target))


def test_resampling_edges(spark):
    rnd = random.Random(8)
    text = lambda k: " ".join(rnd.choice("red green blue Grün 你好 7".split()) for _ in range(k))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(400)] + [(5000, "one hot text of just a few words " * 4)] * 300 + [(None, text(30)), (None, text(30)), (900, None), (901, ""), (902, "word " * 60_000)]
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, rank long, score string").repartition(7)
    target = spark.createDataFrame([("Red green!", 1), (None, 2)], "text string, doc_id long")
    for rows in (4096, 20):  # one range, and many of which the last is cut
        got = [tuple(r) for r in resampling.resample(table, target, range_rows=rows).collect()]
        assert order(got) == order(plain_draw(docs, ["Red green!"]))
    assert resampling.resample(table.limit(0), target).count() == 0
    none = resampling.resample(table, target.limit(0)).collect()
    assert order(map(tuple, none)) == order(plain_draw(docs, []))
    short = resampling.resample(table.filter("length(text) < 8"), target)
    assert short.filter("rank is not null").count() == 0 and short.count() == table.filter("length(text) < 8").count()


def test_tournament_merges_and_stops():
    rnd = random.Random(9)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted((rnd.randrange(30), i, j) for j in range(rnd.randrange(20))) for i in range(k)]
        want = sorted(x for r in runs for x in r)
        assert list(resampling.Tournament(runs).take(10**6)) == want
        tree = resampling.Tournament(runs)
        assert list(tree.take(5)) == want[:5] and sum(tree.at) == len(want[:5])


@pytest.mark.parametrize("name, query, sql", [("op11", resampling.op11_resampling, resampling.OP11_SQL), ("op12", fill_middle.op12_fill_middle, fill_middle.OP12_SQL)])
def test_sql_agrees(spark, name, query, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(sql)
    assert order(query(spark, SF).select(*want.columns).collect()) == order(want.fetchall())
