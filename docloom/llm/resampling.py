"""Importance resampling towards a target distribution of hashed n-grams.

Counts of hashed features over all raw and all target texts give each bucket a gain; a document's
weight is the mean gain of its features, taken from the array of gains by numpy. The scored rows are
written as one run for each partition, sorted best first. Exact counts of the scores tell the lowest
one that is drawn; rows from there up are dealt to ranges of the order, and in each range a tournament
tree merges what every run has there, stopping after the number of rows that the draw still takes.
No task holds more than a range, the driver two arrays of buckets and the counts by score, which is an integer
within some 10^5 values.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bpe_codec import slices
from docloom.scratch import discard, shuffle_width, stage

BUCKETS = 10_000
#: Bytes of a word up to which its checksum is computed with those of others.
SHORT = 32
#: Rows that one task merges; ranges are made to hold about so many.
RANGE_ROWS = 1 << 19

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c
#: Lower-cases A-Z, and whether a byte is one of a word: digits, letters and all of signs beyond ASCII.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _zero_tables() -> np.ndarray:
    """``[n, k, b]``: what byte k of a checksum state of value b becomes after n zero bytes."""
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, SHORT + 1):
        out[n] = _CRC[out[n - 1] & 0xFF] ^ out[n - 1] >> np.uint32(8)
    return out


_ZEROS = _zero_tables()


def _word_sums(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: short ones of equal length advance together."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-np.minimum(lens, SHORT + 1), kind="stable")
    n_long = int((lens > SHORT).sum())
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lens[i]].tobytes())
    rest = order[n_long:]
    state, at, size = np.full(len(rest), 0xFFFFFFFF, np.uint32), starts[rest], lens[rest]
    for j in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -j, "left"))  # words of more than j bytes come first
        s = state[:live]
        state[:live] = _CRC[(s ^ data[at[:live] + j]) & 0xFF] ^ s >> np.uint32(8)
    out[rest] = ~state
    return out


def hashed_features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of the texts, with the text of each, and each text's number of words.

    The checksum of a pair comes from those of its words: zero bytes shift the first one's state over the second.
    """
    arr = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    raw = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(arr) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    data = _LOWER[raw]
    # A text's last byte and the next one's first may both be of words: words end with their text.
    inside = np.concatenate(([False], _WORD[data], [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    starts = starts[starts < len(data)]
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    lens = ends - starts
    text = np.searchsorted(bounds, starts, "right") - 1
    n_words = np.bincount(text, minlength=len(arr)).astype(np.int64)
    sums = _word_sums(data, starts, lens)
    pairs = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    first, second, size = sums[pairs], sums[pairs + 1], lens[pairs + 1]
    spaced = ~(_CRC[(~first ^ np.uint32(32)) & 0xFF] ^ ~first >> np.uint32(8))  # the word and a space
    n = np.minimum(size, SHORT)
    both = second.copy()
    for k in range(4):
        both ^= _ZEROS[n, k, spaced >> np.uint32(8 * k) & 0xFF]
    for i in np.flatnonzero(size > SHORT).tolist():
        a = starts[pairs[i] + 1]
        both[i] = zlib.crc32(data[a : a + size[i]].tobytes(), int(spaced[i]))
    found = np.concatenate((sums, both)).astype(np.int64) % buckets
    return found, np.concatenate((text, text[pairs])), n_words


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket, summed in each task before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for s in slices(b, "text"):
                total += np.bincount(hashed_features(s.column("text"), buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    found = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed distributions, rounded down, by bucket."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    k = len(s)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id n_words n_features weight score`` of each row, by the array of gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                found, text, n_words = hashed_features(s.column("text"), len(gain))
                total = np.zeros(len(n_words), np.int64)
                np.add.at(total, text, gain[found])
                n = n_words + np.maximum(n_words - 1, 0)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


class Tournament:
    """A tree of losers over sorted runs: each step gives the best head, then replays its path to the root."""

    END = (np.inf,)

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        heads = [(r[0] if r else self.END, i) for i, r in enumerate(runs)] + [(self.END, i) for i in range(len(runs), size)]
        winners = [*[None] * size, *heads]
        self.losers: list = [None] * size
        for k in range(size - 1, 0, -1):
            a, b = winners[2 * k], winners[2 * k + 1]
            winners[k], self.losers[k] = (a, b) if a <= b else (b, a)
        self.best = winners[1]

    def take(self, count: int) -> Iterator[tuple]:
        """The next ``count`` rows of all runs, or as many as there are."""
        for _ in range(count):
            row, i = self.best
            if row is self.END:
                return
            yield row
            self.at[i] += 1
            run = self.runs[i]
            now = (run[self.at[i]] if self.at[i] < len(run) else self.END, i)
            k = (i + self.size) // 2
            while k:
                if self.losers[k] < now:
                    now, self.losers[k] = self.losers[k], now
                k //= 2
            self.best = now


def _merge(part: pa.Table, skip: dict[int, int], draw: int) -> pa.Table:
    """Ranks of one range: its rows of every run, merged until the draw is full; the other rows have none."""
    cols = {c: part.column(c).to_numpy() for c in ("score", "missing", "id", "run", "place")}
    order = np.lexsort((cols["place"], cols["run"]))  # each run as it was written, best first
    keys = np.stack([-cols["score"], cols["missing"], cols["id"], cols["run"], cols["place"], np.arange(len(order))], 1)[order]
    cuts = np.flatnonzero(np.diff(cols["run"][order])) + 1
    before = skip[int(part.column("part")[0].as_py())]
    quota = min(len(order), max(0, draw - before))
    rank, valid = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
    if quota:
        tree = Tournament([list(map(tuple, k.tolist())) for k in np.split(keys, cuts)])
        won = np.fromiter((row[-1] for row in tree.take(quota)), np.int64, quota)
        rank[won], valid[won] = before + 1 + np.arange(quota), True
    return part.select(["doc_id", "n_features", "weight", "score"]).append_column("rank", pa.array(rank, mask=~valid))


def resample(
    docs: DataFrame, target: DataFrame, seed: int = 7, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``doc_id n_features weight score rank`` of each row of ``docs``; ``rank`` from 1 for those drawn, else null.

    Of the N rows with at least ``least_words`` words, ``floor(percent * N / 100)`` of the highest scores are drawn, ties
    to the smaller id. Null and empty texts have no features, weight 0 and are not drawn. A row without an id
    hashes as no digits and comes last of its score; rows that repeat an id count each, equal ones in any order.
    No target texts, or none at all, leave only the smoothing. Other columns are left out.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    # A run is what one task has scored, best first.
    ranked = scored(docs, gain, seed, id_col, text_col).withColumn("fits", F.col("n_words") >= least_words).withColumn("run", F.spark_partition_id().cast("long"))
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("doc_id")]
    runs = stage(ranked.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "resample-runs")
    counts = sorted(runs.filter("fits").groupBy("score").count().collect(), reverse=True)  # one row a score
    draw = percent * sum(c["count"] for c in counts) // 100
    least, seen = None, 0
    for score, n in counts:
        if seen >= draw:
            break
        least, seen = score, seen + n
    columns = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if least is None:
        return runs.select(*columns, unranked)
    drawn = (F.col("fits")) & (F.col("score") >= least)
    n_ranges = max(1, min(shuffle_width(spark), -(-seen // 4096)), -(-seen // range_rows))
    dealt = (
        runs.filter(drawn).withColumn("missing", F.col("doc_id").isNull().cast("long")).withColumn("id", F.coalesce("doc_id", F.lit(0)))
        .repartitionByRange(n_ranges, F.desc("score"), "missing", "id", "run", "place").withColumn("part", F.spark_partition_id())
    )
    dealt = stage(dealt, "resample-ranges")
    skip, total = {}, 0
    for part, n in sorted(tuple(r) for r in dealt.groupBy("part").count().collect()):  # one row a range
        skip[part], total = total, total + n
    merged = dealt.groupBy("part").applyInArrow(lambda part: _merge(part, skip, draw), "doc_id long, n_features long, weight long, score long, rank long")
    return merged.unionByName(runs.filter(~drawn).select(*columns, unranked))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# The checksum runs over the hexadecimal digits of a feature's bytes, four bits at a step.
OP11_SQL = r"""
WITH nibble AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i, 1, 2, 3, 4], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab
), words AS (
  SELECT doc_id, FALSE AS wanted, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT item_id, TRUE, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS (
  SELECT doc_id, wanted, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM words
), counted AS (
  SELECT doc_id, wanted, feature, count(*) AS n FROM features GROUP BY ALL
), hashed AS (
  SELECT feature, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(feature) * 2 + 1), lambda i:
      strpos('0123456789ABCDEF', hex(encode(feature))[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END])::BIGINT - 1)),
    lambda c, d: xor(c // 16, tab[xor(c % 16, d) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), nibble
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (NOT wanted), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (wanted), 0)::DOUBLE AS t FROM counted JOIN hashed USING (feature) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM buckets) + 10000) / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000))))::BIGINT AS g FROM buckets
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight
  FROM counted JOIN hashed USING (feature) JOIN gain USING (bucket) WHERE NOT wanted GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) >= 20 AS fits, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (doc_id) WHERE NOT wanted
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fits) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""
