"""Toxicity by a linear-chain conditional random field.

Labels mark documents. Word features that stand out in toxic documents turn them into labelled
tokens, on which a two-state chain (clean, toxic) is trained by gradient steps of the likelihood;
a chain is a sentence. Forward-backward marginals tag tokens, and their sums over a document feed
a logistic score. The fit sees a bounded sample; scoring sees every whole text.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import bounded_batches, claim_cache, fresh, trim

#: Bounds of the fit: labelled rows, in the order of a hash of their ids; bytes of such a text; sentences that the
#: chain is trained on, a third of them with toxic tokens.
SAMPLE_ROWS, SAMPLE_BYTES, MAX_SENTENCES = 6000, 20_000, 15_000
#: A feature marks tokens if it is in so many toxic documents and so many times as frequent there.
LEAST_DOCS, LEAST_ODDS = 4, 20.0
REJECT = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
#: Signs that hold no letter and may end a word.
MARKS = ".,;:!?)\"'"
#: Characters of texts that are tagged together.
TAGGED = 1 << 20


def features(word: str) -> list[str]:
    """Features of a lower-case word: itself and, of longer words, prefixes and an ending."""
    out = ["w" + word]
    if len(word) >= 5:
        out += ["p" + word[:4], "s" + word[-4:]]
    if len(word) >= 6:
        out.append("q" + word[:5])
    return out


def chunk_word(chunk: str) -> tuple[str, bool]:
    """The letters of a run of non-space characters, lower-cased, and whether a sentence ends there."""
    return "".join(LETTERS.findall(chunk.lower())), chunk[-1] in ".!?"


def sentences_of(texts: list[str]) -> tuple[list[list[str]], list[int]]:
    """Runs of non-space characters of each text, in order; sentences end at marks and line breaks."""
    words = [t.replace("\n", " \n ").split(" ") for t in texts]
    return words, [len(w) for w in words]


class Chain:
    """Padded sentences of a flat token list, and forward-backward over all of them at once."""

    def __init__(self, ends: np.ndarray):
        n = len(ends)
        first = np.concatenate(([True], ends[:-1])) if n else np.zeros(0, bool)
        self.starts = np.flatnonzero(first)
        self.lens = np.diff(np.append(self.starts, n))
        order = np.argsort(-self.lens, kind="stable")
        self.starts, self.lens = self.starts[order], self.lens[order]
        self.depth = int(self.lens[0]) if n else 0
        self.alive = [int(k) for k in np.searchsorted(-self.lens, -np.arange(1, self.depth + 1), side="right")]

    def tagged(self, score: np.ndarray, start: float, move: np.ndarray) -> np.ndarray:
        """P(toxic) of each token, as ``marginals`` has it, from the ratios of toxic to clean on both sides.

        Tokens stand by their place in a sentence, longest sentences first, so that a step is a slice.
        """
        n = len(score)
        if not n:
            return np.zeros(0)
        lens = self.lens
        offsets = np.concatenate(([0], np.cumsum(self.alive)))
        within = np.arange(n) - np.repeat(np.cumsum(lens) - lens, lens)
        at = np.empty(n, np.int64)
        at[offsets[within] + np.repeat(np.arange(len(lens)), lens)] = np.repeat(self.starts, lens) + within
        odds = np.exp(np.clip(score, -30, 30))[at]
        (clean, into), (out_of, on) = np.exp(move).tolist()
        offsets = offsets.tolist()
        fwd = np.empty(n)
        fwd[: self.alive[0]] = np.exp(start) * odds[: self.alive[0]]
        for t in range(1, self.depth):
            lo, k = offsets[t], self.alive[t]
            before = fwd[offsets[t - 1] : offsets[t - 1] + k]
            here = before * on
            here += into
            here /= before * out_of + clean
            np.multiply(here, odds[lo : lo + k], out=fwd[lo : lo + k])
        back = np.ones(n)
        for t in range(self.depth - 2, -1, -1):
            hi, k = offsets[t + 1], self.alive[t + 1]
            ahead = back[hi : hi + k] * odds[hi : hi + k]
            there = ahead * on
            there += out_of
            ahead *= into
            ahead += clean
            np.divide(there, ahead, out=back[offsets[t] : offsets[t] + k])
        fwd *= back
        p = np.empty(n)
        p[at] = fwd / (1 + fwd)
        return p

    def marginals(self, score: np.ndarray, start: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(toxic) of each token, expected moves and starts; ``score`` is toxic minus clean."""
        odds = np.exp(np.clip(score, -30, 30))
        m = np.exp(move)
        fwd = np.zeros((len(score), 2))
        for t, k in enumerate(self.alive):
            at = self.starts[:k] + t
            if t == 0:
                a = np.stack((np.ones(k), np.full(k, np.exp(start))), 1)
            else:
                a = fwd[at - 1] @ m
            a[:, 1] *= odds[at]
            fwd[at] = a / a.sum(1, keepdims=True)
        back = np.ones((len(score), 2))
        pairs = np.zeros((2, 2))
        for t in range(self.depth - 2, -1, -1):
            k = self.alive[t + 1]
            at = self.starts[:k] + t
            nxt = back[at + 1].copy()
            nxt[:, 1] *= odds[at + 1]
            joint = fwd[at][:, :, None] * m[None] * nxt[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = nxt @ m.T
            back[at] = b / b.sum(1, keepdims=True)
        p = fwd * back
        p = p[:, 1] / p.sum(1)
        return p, pairs, p[self.starts]


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    start: float = 0.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc_weights: np.ndarray = field(default_factory=lambda: np.zeros(5))
    _tables: dict | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def _scores(self, chunks: list[str]) -> np.ndarray:
        """Toxic minus clean for each of some lower-case chunks; those without letters are surely clean."""
        words = [c if c.isalpha() else c[:-1] if c and c[-1] in MARKS and c[:-1].isalpha() else "".join(LETTERS.findall(c)) for c in chunks]
        if self._tables is None:
            found = {kind: {f[1:]: x for f, x in self.weights.items() if f[0] == kind} for kind in "wpsq"}
            self._tables = {kind: (pa.array(list(x), pa.large_string()), np.array([*x.values(), 0.0])) for kind, x in found.items()}
        word = pa.array(words, pa.large_string())
        length = pc.utf8_length(word).to_numpy()
        total = np.zeros(len(words))
        for kind, part, least in (("w", word, 0), ("p", pc.utf8_slice_codeunits(word, 0, 4), 5), ("s", pc.utf8_slice_codeunits(word, -4), 5), ("q", pc.utf8_slice_codeunits(word, 0, 5), 6)):
            names, weights = self._tables[kind]
            total += np.where(length >= least, weights[pc.fill_null(pc.index_in(part, names), len(names)).to_numpy()], 0.0)
        return np.where(length > 0, self.bias + total, -30.0)

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """P(toxic) of each space-separated chunk of each text."""
        if not texts:
            return []
        claim_cache("toxicity", lambda: None)
        lists = pc.split_pattern(pa.array([t.lower().replace("\n", " \n ") for t in texts], pa.large_string()), " ")
        chunks = lists.flatten().dictionary_encode()
        cuts = np.asarray(lists.offsets)[1:]
        distinct = chunks.dictionary.to_pylist()
        at = chunks.indices.to_numpy()
        scores = self._scores(distinct)[at]
        ends = np.array([c != "" and c[-1] in ".!?\n" for c in distinct])[at]
        ends[cuts - 1] = True
        p = Chain(ends).tagged(scores, self.start, self.move)
        p[scores <= -30.0] = 0
        return np.split(p, cuts[:-1])

    def doc_features(self, p: np.ndarray) -> np.ndarray:
        total = float(p.sum())
        return np.array([1.0, np.log1p(total), np.log1p(1000 * total / (len(p) + 20)) / 3, float(p.max(initial=0)), np.log1p(len(p)) / 5])

    def tags(self, texts: list[str]) -> Iterator[np.ndarray]:
        """``tag``, some texts at a time."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= TAGGED):
                size += len(texts[hi])
                hi += 1
            yield from self.tag(texts[lo:hi])
            lo = hi

    def _of(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.doc_weights, -30, 30)))

    def scores(self, texts: list[str]) -> np.ndarray:
        return self._of(np.array([self.doc_features(p) for p in self.tags(texts)]).reshape(-1, 5))

    def scores_and_spans(self, texts: list[str], reject: float) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and the spans of the texts that reach ``reject``; a text is tagged once for both."""
        x, spans = [], []
        for t, p in zip(texts, self.tags(texts), strict=True):
            x.append(self.doc_features(p))
            # A single row may round otherwise than all at once: spans of what is near the bound are dropped below.
            spans.append(self._spans(t, p) if self._of(x[-1]) >= reject - 1e-6 else [])
        score = self._of(np.array(x).reshape(-1, 5))
        return score, [found if s >= reject else [] for s, found in zip(score.tolist(), spans, strict=True)]

    @staticmethod
    def _spans(text: str, tags: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
        out, at = [], 0
        for w, p in zip(sentences_of([text])[0][0], tags.tolist(), strict=True):
            i = text.find(w, at) if w else at
            if p >= least and w.strip():
                out.append((i, i + len(w)))
            at = i + len(w)
        return out

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int]]:
        """Code-point offsets of the chunks tagged toxic."""
        return self._spans(text, self.tag([text])[0], least)


def fit(texts: list[str], labels: list[int], max_sentences: int = MAX_SENTENCES) -> ToxicityModel:
    """Label tokens, train the chain on at most ``max_sentences``, then the document score on all texts."""
    model = ToxicityModel()
    y_docs = np.array(labels)
    n1, n0 = int(y_docs.sum()), int((1 - y_docs).sum())
    if not n1 or not n0:
        model.doc_weights[0] = 30.0 if n1 else -30.0
        return model
    known: dict[str, tuple[str, bool]] = {"": ("", False), "\n": ("", True)}
    words = [[known.get(c) or known.setdefault(c, chunk_word(c)) for c in doc] for doc in sentences_of(texts)[0]]
    # Copies of a document repeat its words in the same places: in toxic documents an occurrence counts
    # once for each pair of neighbours, so that what is frequent is a word and not a text.
    seen = (Counter(), Counter())
    places: set[int] = set()
    for doc in (d for d, y in zip(words, labels, strict=True) if y):
        plain = [w for w, _ in doc if w]
        new = set()
        for before, w, after in zip(["", *plain], plain, [*plain[1:], ""], strict=False):
            if w not in new and (place := zlib.crc32(f"{before} {w} {after}".encode())) not in places:
                places.add(place)
                new.add(w)
        seen[1].update({f for w in new for f in features(w)})
    for doc in (d for d, y in zip(words, labels, strict=True) if not y):
        seen[0].update({f for w in {w for w, _ in doc if w} for f in features(w) if f in seen[1]})
    odds = {f: ((c + 0.5) / (n1 + 1)) / ((seen[0][f] + 0.5) / (n0 + 1)) for f, c in seen[1].items() if c >= LEAST_DOCS}
    marks = {f for f, r in odds.items() if r >= LEAST_ODDS}

    tokens, truth, ends = [], [], []
    kept = {0: 0, 1: 0}
    for doc, y in zip(words, labels, strict=True):
        sentence: list[str] = []
        for w, end in doc:
            if w:
                sentence.append(w)
            if end and sentence:
                hit = [int(y and any(f in marks for f in features(x))) for x in sentence]
                kind = int(any(hit))
                if kept[kind] < max_sentences * (1 if kind else 2) // 3 and (kind or not y):
                    kept[kind] += 1
                    tokens += sentence
                    truth += hit
                    ends += [False] * (len(sentence) - 1) + [True]
                sentence = []
    if not any(truth):
        model.doc_weights[0] = float(np.log((n1 + 0.5) / (n0 + 0.5)))
        return model
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
    names = {f: i for i, f in enumerate(dict.fromkeys(f for w in vocabulary for f in features(w)))}
    of_word = [[names[f] for f in features(w)] for w in vocabulary]
    flat = np.array(list(itertools.chain.from_iterable(of_word)))
    owner = np.repeat(np.arange(len(of_word)), [len(x) for x in of_word])
    at, y = np.array([vocabulary[w] for w in tokens]), np.array(truth, float)
    chain = Chain(np.array(ends))
    not_first = np.ones(len(y), bool)
    not_first[chain.starts] = False
    here = np.flatnonzero(not_first)
    real = np.zeros((2, 2))
    np.add.at(real, (y[here - 1].astype(int), y[here].astype(int)), 1)
    w, bias, start, move = np.zeros(len(names)), -4.0, -4.0, np.zeros((2, 2))
    g2 = [np.full(len(names), 1e-3), 1e-3, 1e-3, np.full((2, 2), 1e-3)]
    for _ in range(30):
        score = bias + np.bincount(owner, w[flat], len(of_word))
        p, pairs, firsts = chain.marginals(score[at], start, move)
        miss = np.bincount(at, y - p, len(of_word))
        steps = [np.bincount(flat, miss[owner], len(names)) - 0.05 * w, (y - p).sum(), (y[chain.starts] - firsts).sum(), real - pairs - 0.05 * move]
        for k, s in enumerate(steps):
            g2[k] = g2[k] + s * s
        w, bias, start, move = (v + 0.5 * s / np.sqrt(g) for v, s, g in zip((w, bias, start, move), steps, g2, strict=True))
    keep = np.abs(w) > 1e-2
    model.weights = {f: float(w[i]) for f, i in names.items() if keep[i]}
    model.bias, model.start, model.move = float(bias), float(start), np.asarray(move)
    tags = list(itertools.chain.from_iterable(model.tag(texts[i : i + 256]) for i in range(0, len(texts), 256)))
    x = np.array([model.doc_features(p) for p in tags])
    v = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        v = v + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(v)), x.T @ (y_docs - p) - 0.3 * v)
    model.doc_weights = v
    return model


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; remainder 1 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES, sentences: int = MAX_SENTENCES) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    The bounds: at most ``rows`` rows (the first by a hash of their ids) with texts of at most ``text_bytes``
    bytes, longer ones are not sampled; the chain is trained on at most ``sentences`` of their sentences.
    Labels that are null or other than 0 and 1 are ignored; of several labels of an id, toxic counts; rows that
    repeat a labelled id count as rows. Without labels of both kinds every text gets the score of the one kind.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic in (0, 1)")
        .filter(fold() != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # At most that many pairs of numbers, so this side can be sent to every executor.
    sample = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .filter(F.octet_length("text") <= text_bytes)
        .join(F.broadcast(picked), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(rows)
        .toPandas()
    )
    return fit(sample["text"].tolist(), sample["toxic"].tolist(), sentences)


def _score(model: ToxicityModel):
    """The score of a text column; a worker gives its memory back after each task, since it may be idle for long."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([t if isinstance(t, str) else "" for t in texts]))
        trim()

    return scored


def reject_toxic(docs: DataFrame, model: ToxicityModel, least: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, with their columns. Null and empty texts score as no evidence."""
    bounded_batches(docs.sparkSession)
    name = fresh(docs, "toxic_score")
    return docs.withColumn(name, _score(model)(F.col("text"))).filter(F.col(name) < least).drop(name)


def score_toxicity(docs: DataFrame, model: ToxicityModel, with_spans: bool = False) -> DataFrame:
    """The rows and columns of ``docs`` with ``toxic_score`` (and ``toxic_spans``, of rejected texts).

    Nulls count as empty texts, which get the score of no evidence. Texts are scored whole, by
    sentences; repeated rows get the same score. An empty table gives an empty result. Columns of
    ``docs`` that have these names are replaced, all others stay as they are.
    """
    bounded_batches(docs.sparkSession)
    if not with_spans:
        return docs.withColumn("toxic_score", _score(model)(F.col("text")))

    @F.pandas_udf("struct<score: double, spans: string>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            plain = [t if isinstance(t, str) else "" for t in texts]
            score, spans = model.scores_and_spans(plain, REJECT)
            yield pd.DataFrame({"score": score, "spans": [",".join(f"{a}:{b}" for a, b in found) for found in spans]})
        trim()

    name = fresh(docs, "toxic")
    return docs.withColumn(name, both(F.col("text"))).withColumns({"toxic_score": F.col(f"{name}.score"), "toxic_spans": F.col(f"{name}.spans")}).drop(name)


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select("doc_id", "text"), model, with_spans=True).select(
        "doc_id",
        F.coalesce(fold() == 1, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= REJECT).cast("int").alias("predicted"),
        "toxic_spans",
    )
