"""Operators that SQL can't express, against plain brute force on small tables."""

import hashlib
import re

import numpy as np
import pytest

from docloom.llm import embedding_dedup, html_extract, ngram_join, packing, secret_scan, sentencepiece_codec, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        up[b] = a
    return [find(i) for i in range(n)]


def jaccard_components(texts: dict, words: int, percent: int) -> dict:
    ids, sets = sorted(texts), []
    for d in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[d]))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return {d: (len(s), ids[r]) for d, s, r in zip(ids, sets, roots(len(ids), links), strict=True)}


def near_copies(seed: int) -> dict:
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(words, 12))
    out: dict[int, str] = {}
    for size in (4, 8, 13, 20, 40, 90, 300):
        base = rng.choice(words, size).tolist()
        for _ in range(9):
            own = list(base)
            for k in rng.integers(0, size, rng.integers(0, max(2, size // 20) + 1)):
                own[k] = str(rng.choice(words))
            out[len(out)] = " ".join(own)
        out[len(out)] = line + " " + " ".join(rng.choice(words, size))
    return out


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, words, percent):
    made = near_copies(words)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, words, percent).collect()}
    assert got == jaccard_components(made, words, percent)


def test_tree_prunes_no_link():
    sets = [s for s in ngram_join.shingle_sets(list(near_copies(7).values()), 4) if len(s)]
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    sizes = np.array([len(s) for s in sets])
    for labels in (None, np.arange(len(sets)) % 2):
        want = {(i, j) for i, j in links if labels is None or labels[i] != labels[j]}
        i, j, most = ngram_join.Members(np.zeros(len(sets), int), sizes, sizes, ngram_join.bitmaps(sets), labels, 85).pairs()
        got = {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
        assert all(len(np.intersect1d(sets[a], sets[b])) <= m for a, b, m in zip(i.tolist(), j.tolist(), most.tolist(), strict=True))
        assert want <= got and len(got) < len(sets) * (len(sets) - 1) // 4


@pytest.mark.parametrize("sizes", [(3, 5), (128, 1024)])
def test_large_trees_and_null_ids(spark, monkeypatch, sizes):
    """A chain of near copies, a common line, rows without an id, and trees that are cut into cells."""
    monkeypatch.setattr(ngram_join, "WHOLE", sizes[0])
    monkeypatch.setattr(ngram_join, "CELL", sizes[1])
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(words, 30))
    base = rng.choice(words, 120).tolist()
    made = {}
    for i in range(60):
        base = list(base)
        base[int(rng.integers(120))] = str(rng.choice(words))
        made[i] = " ".join(base)
    made |= {100 + i: line + " " + " ".join(rng.choice(words, int(rng.integers(1, 60)))) for i in range(60)}
    rows = [(d, t) for d, t in made.items()]
    # Two ids that are linked only through a row without one.
    a, b, c = (" ".join([*(f"m{i}" for i in range(200)), *extra]) for extra in ([f"x{i}" for i in range(20)], [], [f"y{i}" for i in range(20)]))
    rows += [(900, a), (None, b), (901, c), (None, "alone and without any id"), (902, "alone and without any id of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.ngram_components(df, 4, 85).collect()
    want = jaccard_components({k: t for k, (_, t) in enumerate(rows)}, 4, 85)
    by_root: dict = {}
    for k, (d, _) in enumerate(rows):
        by_root.setdefault(want[k][1], []).append(d)
    low = {r: min((d for d in ds if d is not None), default=None) for r, ds in by_root.items()}
    expected = sorted(repr((d, want[k][0], low[want[k][1]])) for k, (d, _) in enumerate(rows))
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == expected
    assert {r.component_id for r in got if r.doc_id in (900, 901)} == {900}


@pytest.mark.parametrize("per_cell", [0.02, 2.0, None])
def test_embedding_links(spark, monkeypatch, per_cell):
    """With the usual two centroids a half, with few and with many."""
    if per_cell:
        monkeypatch.setattr(embedding_dedup, "PER_CELL", per_cell)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate((base, base[rng.integers(0, 60, 200)] + rng.normal(scale=0.05, size=(200, 16)), base[:5], base[:1].repeat(40, 0)))
    label = np.concatenate((np.arange(60) % 3, rng.integers(0, 3, 200), np.arange(5) % 3, np.zeros(40, int)))
    df = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_embeddings(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    r = roots(len(x), [(i, j) for i, j in zip(*np.nonzero(link), strict=True)])
    assert got == {i: (int(link[i].sum()), r[i]) for i in range(len(x))} and link.sum() > 500


def test_multi_sequence_visits_all_cells_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    got = embedding_dedup.multi_sequence(a, b, 0.7)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.7}


def repeats(rows: dict, length: int) -> dict:
    seen, out = set(), {}
    for d in sorted(rows):
        b = (rows[d] or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out[d] = (len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    return out


def test_substrings_of_the_table(spark, texts):
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.drop_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == repeats(texts, 100)


@pytest.mark.parametrize("parts", [1, 6])
def test_substrings_of_shared_passages(spark, parts):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 6))) for _ in range(60)]
    passages = [" ".join(rng.choice(words, rng.integers(15, 60))) for _ in range(6)]
    rows = {i: " ".join([*rng.choice(words, rng.integers(0, 40)), passages[rng.integers(6)], *rng.choice(words, rng.integers(0, 30)), passages[rng.integers(6)]]) for i in range(120)}
    rows |= {200: None, 201: "", 202: "a" * 500, 203: "a" * 99 + "b" + "a" * 300, 204: rows[3], 205: rows[5][:150], 206: "ab" * 300, 207: "é" * 120}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(parts)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.drop_repeats(df).collect()}
    assert got == repeats(rows, 100)


def test_packing_by_bucket():
    assert substring_dedup._pack(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []
    got = substring_dedup._pack(np.array([7, 2, 7]), np.array([1, 2, 3]))
    assert [(b, np.frombuffer(c, np.int64).tolist()) for b, c in got] == [(2, [2]), (7, [1, 3])]


def test_suffix_sort_is_the_plain_order():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.choice([97, 98], rng.integers(24, 90)).astype(np.uint8)) for _ in range(80)]
    strings[40:60] = [strings[3] + s[:5] for s in strings[40:60]]
    lens = np.array([len(s) for s in strings])
    c = substring_dedup.Contexts(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lens) - lens, np.zeros_like(lens), lens)
    group = np.sort(rng.integers(0, 4, 80))
    got = c.sort(np.arange(80), group)
    want = sorted(range(80), key=lambda i: (group[i], strings[i]))
    assert [strings[i] for i in got] == [strings[i] for i in want]


def test_secret_bases(texts):
    for t in texts.values():
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secret_scan.base_spans(t) == sorted(want)


def test_novelty_finds_keys_and_not_words():
    text = "the auth header carries q7Zp4Rk9Xw2Lm8Vt3Ns6 and the auth settings carry configuration_settings_directory_path1 there"
    found = secret_scan.novel_spans(text, [])
    assert [text[s:e] for s, _, e in found] == ["q7Zp4Rk9Xw2Lm8Vt3Ns6"]


def test_viterbi_is_the_best_segmentation():
    import public_tokenizers

    c = sentencepiece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    score = {c.pieces[i]: s for i, s in zip(c.ids, c.scores, strict=True)}
    for word in ["▁unbelievable", "▁internationalisation", "▁étudié", "▁日本", "xyzzy", "▁▁▁a"]:
        best = [(0.0, [])] + [None] * len(word)
        for end in range(1, len(word) + 1):
            options = [(best[i][0] + score[word[i:end]], [*best[i][1], word[i:end]]) for i in range(end) if word[i:end] in score]
            options = options or [(best[end - 1][0] + sentencepiece_codec.BYTE_SCORE, [*best[end - 1][1], None])]
            best[end] = max(options, key=lambda o: o[0])
        got = c.segment([word])[0]
        if None not in best[-1][1]:
            assert [c.pieces[i] for i in got] == best[-1][1]


def test_codec_agrees_with_the_librarys_decoder(texts):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    c, sp = sentencepiece_codec.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    some = list(texts.values())
    for t, ids in zip(some, c.encode(some), strict=True):
        assert sp.decode(ids.tolist()) == t == c.decode(ids)


def test_chain_marginals_by_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    score, start, move = rng.normal(size=7), 0.3, rng.normal(size=(2, 2))
    ends = np.array([0, 0, 1, 1, 0, 0, 1], bool)
    p, _, _ = toxicity.Chain(ends).marginals(score, start, move)
    for a, z in ((0, 3), (3, 4), (4, 7)):
        total, on = 0.0, np.zeros(z - a)
        for y in itertools.product((0, 1), repeat=z - a):
            w = np.exp(y[0] * start + sum(s * v for s, v in zip(score[a:z], y, strict=True)) + sum(move[i, j] for i, j in zip(y, y[1:], strict=False)))
            total += w
            on += w * np.array(y)
        assert np.allclose(p[a:z], on / total)


def test_tags_are_the_marginals_and_texts_are_tagged_once(monkeypatch):
    """Tags from slices by place and words scored together equal the marginals over chunk after chunk."""
    toxic = toxicity.ToxicityModel({"wfoul": 4.0, "pgrim": 2.5, "sness": 1.5, "qgrimy": 1.0, "wß": 2.0}, -2.0, 0.4, np.array([[0.3, -0.7], [-0.2, 0.9]]), np.array([-3.0, 2.0, 1.0, 4.0, 0.1]))
    texts = ["Foul grimness. a b\nfoul! x", "", " ", "GRIMY-ness (foul) ß 12 foul3 don't. İs ΣΑΣ.", "foul " * 40 + "end", "word " * 30 + "foul."]
    chunks = [c for t in texts for c in t.replace("\n", " \n ").split(" ")]
    lens = [len(t.replace("\n", " \n ").split(" ")) for t in texts]
    score = np.array([toxic.bias + sum(toxic.weights.get(f, 0.0) for f in toxicity.features(w)) if (w := toxicity.chunk_word(c)[0] if c else "") else -30.0 for c in chunks])
    ends = np.array([c != "" and (c == "\n" or c[-1] in ".!?") for c in chunks])
    ends[np.cumsum(lens) - 1] = True
    want = toxicity.Chain(ends).marginals(score, toxic.start, toxic.move)[0]
    want[score <= -30] = 0
    assert np.allclose(np.concatenate(list(toxic.tags(texts))), want, rtol=1e-12, atol=0)
    calls, real = [], toxicity.ToxicityModel.tag
    monkeypatch.setattr(toxicity.ToxicityModel, "tag", lambda self, some: calls.extend(some) or real(self, some))
    scores, spans = toxic.scores_and_spans(texts, 0.7)
    assert calls == texts
    assert np.allclose(scores, toxic.scores(texts)) and spans == [toxic.spans(t) if s >= 0.7 else [] for t, s in zip(texts, scores, strict=True)] and any(spans)


def test_packing_workers_remember_a_bounded_number_of_words():
    """Words without end, as invented ones are: several workers of an executor hold some 150 MB each."""
    import public_tokenizers

    w = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for lo in range(0, 360_000, 60_000):
        texts = [" ".join(f"a{i}" for i in range(lo, lo + 60_000))]
        ids = w.encode(texts)[0]
    assert len(w.place) <= 300_000 and len(w.sub) <= 130_000
    assert ids.tolist() == w.tok.encode(texts[0], add_special_tokens=False).ids


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    assert not any(p and not y for p, y in held)


def test_html_of_the_table(spark):
    import html

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_extract.op6_html_extraction(spark, SF).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_column_generation_against_enumeration():
    sizes, demand = np.array([3, 5, 7]), np.array([10, 8, 6])
    value, counts = packing.best_pattern(np.array([0.3, 0.52, 0.7]), sizes, 16)
    best = max((0.3 * a + 0.52 * b + 0.7 * c) for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16)
    assert abs(value - best) < 1e-9 and (counts * sizes).sum() <= 16
    patterns = packing.cutting_stock(sizes, demand, 16)
    assert (sum(c * n for c, n in patterns) == demand).all() and sum(n for _, n in patterns) <= 8
