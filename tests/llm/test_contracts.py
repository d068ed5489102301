"""Whole rows of queries against plain programs: every column that their contracts name."""

import bisect
import hashlib
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import packing, secret_scan, sharding, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def least_capacity(sizes: list[int], shards: int) -> int:
    """By plain dynamic programming over where the last shard starts."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = [0] + [sums[i] for i in range(1, len(sums))]
    for _ in range(shards - 1):
        new = [0]
        for i in range(1, len(sums)):
            # The larger of both parts falls and then rises with the cut.
            lo, hi = 0, i - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if best[mid] < sums[i] - sums[mid]:
                    lo = mid + 1
                else:
                    hi = mid
            new.append(min(max(best[k], sums[i] - sums[k]) for k in {lo, max(0, lo - 1)}))
        best = new
    return best[-1]


def test_sharding_rows(spark, docs):
    rows = {r.doc_id: r for r in sharding.op1_sharding(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) == set(texts)
    slots: dict = {}
    for d, t in texts.items():
        b = (t or "").encode()
        r = rows[d]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Groups in their order: those above an equal share, each with a shard of its own, then the others by the hash of their text.
    key = {r.doc_id: r.k for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("k")).collect()}
    groups: dict = {}
    for d in texts:
        groups.setdefault(texts[d] or "", []).append(d)
    order = sorted((key[ds[0]], sum(rows[d]["size"] for d in ds), {rows[d].shard for d in ds}) for ds in groups.values())
    assert all(len(s) == 1 for _, _, s in order)
    shards, alone = 8, []
    while heavy := [g for g in order if g[1] * shards > sum(x[1] for x in order)]:
        g = max(heavy, key=lambda g: g[1])
        order.remove(g)
        alone.append(g)
        shards -= 1
    assert [g[2] for g in alone] == [{i} for i in range(len(alone))]
    walk = [next(iter(s)) for _, _, s in order]
    assert walk == sorted(walk) and not set(walk) & set(range(len(alone)))  # contiguous
    load: dict = {}
    for _, size, s in order:
        load[next(iter(s))] = load.get(next(iter(s)), 0) + size
    assert max(load.values()) == least_capacity([g[1] for g in order], shards)


def test_packing_rows(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.op2_packing(spark, SF).collect()
    pieces: dict = {}
    sequences: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(pieces) == set(texts)
    total = 0
    for d, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(raw))
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
    padded = sum(n if (n := sum(r.length for r in s)) & n - 1 == 0 else 4096 for s in sequences.values())
    assert padded <= 1.05 * total + 2 * 4096


def test_toxicity_rows(spark, docs):
    model = toxicity.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {r.doc_id: r for r in toxicity.op7_toxicity(spark, SF).collect()}
    assert set(rows) == set(texts)
    for d, t in texts.items():
        r = rows[d]
        alone = float(model.scores([t])[0])  # whatever else stands in a batch
        assert r.score == pytest.approx(alone, abs=1e-9) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
        for a, b in (map(int, s.split(":")) for s in r.toxic_spans.split(",") if s):
            assert 0 <= a < b <= len(t) and not t[a].isspace() and not re.search(r" ", t[a:b])


def plain_base(t: str) -> list[tuple[int, int, int]]:
    """Base spans by walking through the text."""
    out = []
    word = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])")
    value, i = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), 0
    while m := word.search(t, i):
        i, at = m.start() + 1, m.end()
        at += t[at : at + 1] in ("'", '"')
        while t[at : at + 1] == " ":
            at += 1
        if t[at : at + 1] not in (":", "="):
            continue
        at += 1
        while t[at : at + 1] == " ":
            at += 1
        at += t[at : at + 1] in ("'", '"')
        end = at
        while end < len(t) and t[end] in value:
            end += 1
        if end > at:
            i = end
            out += [(m.start(), 0, end)] if end - at >= 6 else []
    i = 0
    while (k := t.find("AKIA", i)) >= 0:
        end = k + 4
        while end < len(t) and t[end] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
            end += 1
        out += [(k, 1, end)] if end - k >= 20 else []
        i = end
    run = 0
    for k, c in enumerate([*t, " "]):
        if c not in "0123456789abcdef":
            out += [(k - run, 2, k)] if run >= 24 else []
            run = 0
        else:
            run += 1
    return sorted(out)


def test_secret_rows(spark):
    made = ["token : 'abc123=='", 'API_KEY="x9" Secret=abcdef password=token=abcdefg', "AKIA" * 8, "deadbeef" * 3 + "AKIA" + "Z" * 16, "ſecret = abcdefgh", "passwd =\tabcdefgh", "secret:  abcde secretsecret=aaaaaa", "", None]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in secret_scan.scan_secrets(docs).collect():
        base = plain_base(texts[r.doc_id])
        names = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3)), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("novel")] == names
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), ("assign", "access", "hex", "novel").index(s.split(":")[0])))


def test_spans_are_found_in_time_that_grows_with_the_text():
    known = secret_scan.base_spans("token: abcdefgh1234 " * 10_000)
    assert len(known) == 10_000
    starts = [s for s, _, _ in known]
    assert bisect.bisect(starts, starts[5000]) == 5001
    import time

    began = time.process_time()
    secret_scan.scan_text("token: abcdefgh1234 auth " * 10_000)
    assert time.process_time() - began < 20
