"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut into halves; a codebook for each half is fitted on a bounded sample, and the
pair of nearest centroids is a vector's cell in the product grid. A query visits cells by the
multi-sequence order of their lower bounds: the distance of each half to the cell's Voronoi face.
A partner at the wanted cosine can't lie in a cell whose bound is larger, so visiting stops there
with a recall of 1. Vectors of visited cells are verified by cosine in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import bounded_batches, components, off_driver
from docloom.scratch import stage

#: Vectors that the codebooks are fitted on, in the order of a hash of their ids.
SAMPLE = 16_384
#: Vectors of a cell that one task compares with as many queries.
BLOCK = 1024
MAX_CENTROIDS = 512
PER_CELL = 32


def _fit(half: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows of the sorted first principal axis; deterministic."""
    axis = np.linalg.svd(half - half.mean(0), full_matrices=False)[2][0]
    order = np.argsort(half @ axis, kind="stable")
    centres = half[order[np.linspace(0, len(half) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        near = _dist2(half, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, half)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(centres, axis=0)


def _dist2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x = x / np.abs(x).max(1)[:, None]  # squares of very large and very small components stay finite and above zero
    return x / np.sqrt((x * x).sum(1))[:, None]


def _face_bounds(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, and squared lower bounds of the distance to every other centroid's region."""
    d2 = _dist2(half, centres)
    near = d2.argmin(1)
    apart = np.sqrt(_dist2(centres, centres))[near]
    gap = d2 - d2[np.arange(len(d2)), near][:, None]
    bound = np.where(apart > 0, gap / (2 * np.where(apart > 0, apart, 1)), 0)
    return near, np.maximum(bound - 1e-9, 0) ** 2


def multi_sequence(b1: np.ndarray, b2: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Cells (i, j) in the order of b1[i] + b2[j], up to ``most``."""
    o1, o2 = np.argsort(b1, kind="stable"), np.argsort(b2, kind="stable")
    heap, seen, out = [(b1[o1[0]] + b2[o2[0]], 0, 0)], {(0, 0)}, []
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > most:
            break
        out.append((int(o1[i]), int(o2[j])))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (b1[o1[a]] + b2[o2[b]], a, b))
    return out


def link_embeddings(
    vectors: DataFrame, min_cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per vector: ``vec_id n_links component_id kept``.

    Vectors that are null, empty, zero or hold null or non-finite components, rows with a null
    label or id, and vectors of different lengths link with nothing. Identical vectors are linked;
    they are compared with others once. Rows that repeat an id are vectors of their own, each with its
    links; a component is named by the smallest id of its rows. Components of any finite size count, also those
    whose squares are not finite. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = stage(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
        .withColumn("usable", F.coalesce(usable, F.lit(False))),
        "vectors",
    )
    classes = stage(
        rows.filter("usable").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumns({"dim": F.size("v"), "class_id": F.monotonically_increasing_id()}),
        "vector-classes",
    )
    sample = classes.orderBy(F.xxhash64("v"), "least").limit(SAMPLE).select("v", "dim").toPandas()
    if sample.empty:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    shape = classes.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    dim = int(sample["dim"].mode()[0])
    fit_on = _unit(sample["v"][sample["dim"] == dim])
    k = int(min(MAX_CENTROIDS, len(fit_on), max(2, (shape.n / max(1, shape.labels) / PER_CELL) ** 0.5)))
    half = max(1, dim // 2)
    books = off_driver(spark, lambda: (_fit(fit_on[:, :half], k), _fit(fit_on[:, half:], k) if dim > 1 else np.zeros((1, 0))))
    most = 2 - 2 * min_cosine + 1e-9

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each class once as data in its own cell and once as a query in each cell it visits."""
        for b in batches:
            parts = []
            for d, g in b.groupby("dim"):
                if d != dim:
                    cells = [[(0, 0)]] * len(g)
                    own = [(0, 0)] * len(g)
                else:
                    x = _unit(g["v"])
                    n1, b1 = _face_bounds(x[:, :half], books[0])
                    n2, b2 = _face_bounds(x[:, half:], books[1]) if dim > 1 else (np.zeros(len(x), int), np.zeros((len(x), 1)))
                    own = list(zip(n1.tolist(), n2.tolist(), strict=True))
                    cells = [multi_sequence(p, q, most) for p, q in zip(b1, b2, strict=True)]
                ids, labels, dims = g["class_id"].tolist(), g["label"].tolist(), g["dim"].tolist()
                for i in range(len(g)):
                    parts.append((ids[i], labels[i], dims[i], own[i][0] * 65536 + own[i][1], False))
                    parts += [(ids[i], labels[i], dims[i], c[0] * 65536 + c[1], True) for c in cells[i]]
            yield pd.DataFrame(parts, columns=["class_id", "label", "dim", "cell", "asks"])

    label_type = dict(classes.dtypes)["label"]
    key = ["label", "dim", "cell"]
    visits = stage(classes.select("class_id", "label", "dim", "v").mapInPandas(placed, f"class_id long, label {label_type}, dim int, cell long, asks boolean"), "visits")
    counts = stage(
        visits.groupBy(*key).agg(
            F.ceil(F.sum(F.when(~F.col("asks"), 1).otherwise(0)) / BLOCK).cast("int").alias("data_blocks"),
            F.ceil(F.sum(F.when(F.col("asks"), 1).otherwise(0)) / BLOCK).cast("int").alias("query_blocks"),
        ).filter("data_blocks > 0"),
        "cells",
    )
    # A block of a cell's data meets every block of its queries, so a hot cell becomes many small groups.
    own_block = lambda n: F.pmod(F.xxhash64("class_id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    dealt = visits.join(counts, key)
    data = dealt.filter("not asks").withColumn("data_block", own_block("data_blocks")).withColumn("query_block", F.explode(span("query_blocks")))
    asks = dealt.filter("asks").withColumn("query_block", own_block("query_blocks")).withColumn("data_block", F.explode(span("data_blocks")))
    work = data.unionByName(asks).select("class_id", *key, "data_block", "query_block", "asks")
    work = work.join(classes.select("class_id", "v", "copies"), "class_id")

    def verified(group: pd.DataFrame) -> pd.DataFrame:
        asks_ = group["asks"].to_numpy()
        x, ids, copies = _unit(group["v"]), group["class_id"].to_numpy(), group["copies"].to_numpy()
        q, d = np.flatnonzero(asks_), np.flatnonzero(~asks_)
        link = (x[q] @ x[d].T >= min_cosine) & (ids[q][:, None] != ids[d][None, :])
        n = link.astype(np.int64) @ copies[d]
        top = np.iinfo(np.int64).max
        lq, ld = ids[q].copy(), ids[d].copy()
        while True:
            ld2 = np.minimum(ld, np.where(link, lq[:, None], top).min(0, initial=top))
            lq2 = np.minimum(lq, np.where(link, ld2[None, :], top).min(1, initial=top))
            if (ld2 == ld).all() and (lq2 == lq).all():
                break
            lq, ld = lq2, ld2
        some_q, some_d = n > 0, link.any(0)
        return pd.DataFrame({
            "class_id": np.concatenate((ids[q][some_q], ids[d][some_d])),
            "n": np.concatenate((n[some_q], np.zeros(int(some_d.sum()), np.int64))),
            "root": np.concatenate((lq[some_q], ld[some_d])),
        })

    found = stage(work.groupBy(*key, "data_block", "query_block").applyInPandas(verified, "class_id long, n long, root long"), "vector-links")
    joined = components(found.filter("class_id <> root").select(F.col("class_id").alias("a"), F.col("root").alias("b")), "vector")
    links = found.groupBy("class_id").agg(F.sum("n").alias("n"))
    of_class = stage(
        classes.join(links, "class_id", "left").join(joined.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("label", "v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "class_id").alias("component")),
        "vector-class-links",
    )
    named = of_class.groupBy("component").agg(F.min("least").alias("c"))
    linked = rows.filter("usable").join(of_class.join(named, "component"), ["label", "v"]).select(
        "vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), (F.col("vec_id") == F.col("c")).alias("kept")
    )
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(alone)


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
