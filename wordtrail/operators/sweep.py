"""k-means for several numbers of clusters at once: one pass over the rows a round, for all of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from wordtrail.functions.hashing import hash32

Centres = dict[int, np.ndarray]


def first_centres(df: DataFrame, features: str, ks: Sequence[int]) -> Centres:
    """The same start for every k: the first k different rows by a hash of their numbers."""
    rows = df.select(F.col(features).cast("array<double>").alias("f")).distinct()
    picked = [r.f for r in rows.orderBy(hash32(F.col("f").cast("string")), "f").limit(max(ks)).collect()]
    return {k: np.array(picked[:k]) for k in ks if len(picked) >= k}


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (the first of equal ones) and the squared distance to it."""
    far = np.maximum((x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(axis=1), 0)
    at = far.argmin(axis=1)
    return at, ((x - centres[at]) ** 2).sum(axis=1)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cluster_sums(df: DataFrame, centres: Centres) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """By k: number of rows, sums, sums of squared norms of each cluster, and the cost. One pass;
    what a task has summed up travels, and as many numbers as the centres have come back."""
    width = next(iter(centres.values())).shape[1]

    def work(batches):
        total = {k: np.zeros((len(c), width + 3)) for k, c in centres.items()}
        for batch in batches:
            x = _matrix(batch, width)
            norms = (x ** 2).sum(axis=1)
            for k, own in centres.items():
                at, far = _nearest(x, own)
                np.add.at(total[k], at, np.c_[np.ones(len(x)), norms, far, x])
        for k, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.size, k)), pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["k", "at", "v"])

    out = {k: np.zeros(len(c) * (width + 3)) for k, c in centres.items()}
    for r in df.mapInArrow(work, "k long, at long, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect():
        out[r.k][r.at] = r.v
    tables = {k: v.reshape(-1, width + 3) for k, v in out.items()}
    return {k: (t[:, 0], t[:, 3:], t[:, 1], float(t[:, 2].sum())) for k, t in tables.items()}


def _silhouettes(df: DataFrame, centres: Centres, sums: dict) -> dict[int, float]:
    """Mean silhouette by k for squared distances, from the clusters' sums: no pair of rows is formed."""
    width = next(iter(centres.values())).shape[1]

    def work(batches):
        total = dict.fromkeys(centres, 0.0)
        for batch in batches:
            x = _matrix(batch, width)
            norms = (x ** 2).sum(axis=1)
            for k, own in centres.items():
                at, _ = _nearest(x, own)
                n, vectors, squares, _ = sums[k]
                whole = n[None, :] * norms[:, None] + squares - 2 * x @ vectors.T  # summed distances to each cluster
                each, size = np.arange(len(x)), n[at]
                inner = np.where(size > 1, whole[each, at] / np.maximum(size - 1, 1), 0)
                means = np.where(n > 0, whole / np.maximum(n, 1), np.inf)
                means[each, at] = np.inf
                outer = means.min(axis=1)
                most = np.maximum(inner, outer)
                total[k] += float(np.where((size > 1) & (most > 0), (outer - inner) / np.where(most > 0, most, 1), 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], names=["k", "s"])

    found = df.mapInArrow(work, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    return {r.k: r.s / float(sums[r.k][0].sum()) for r in found}


def kmeans_sweep(df: DataFrame, ks: Sequence[int], features: str = "features", rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """``(clusters, silhouette, cost, rounds)`` for each k that has as many different rows.

    Lloyd's steps for all k go on together: a round is one pass over the rows and one aggregate by
    (k, cluster). A k that has settled (no centre moved by more than ``tolerance``) takes no
    further part. A cluster without rows keeps its centre. Rows without features are left out.
    """
    schema = "clusters int, silhouette double, cost double, rounds int"
    kept = df.filter(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("f")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centres = first_centres(kept, "f", ks)
        moving, taken = dict(centres), dict.fromkeys(centres, 0)
        for _ in range(rounds):
            if not moving:
                break
            for k, (n, vectors, _, _) in _cluster_sums(kept, moving).items():
                new = np.where(n[:, None] > 0, vectors / np.maximum(n, 1)[:, None], centres[k])
                if np.sqrt(((new - centres[k]) ** 2).sum(axis=1)).max() <= tolerance:
                    del moving[k]
                else:
                    moving[k] = new
                centres[k], taken[k] = new, taken[k] + 1
        if not centres:
            return df.sparkSession.createDataFrame([], schema)
        sums = _cluster_sums(kept, centres)
        shapes = _silhouettes(kept, centres, sums)
        return df.sparkSession.createDataFrame([(k, shapes[k], sums[k][3], taken[k]) for k in sorted(centres)], schema)
    finally:
        kept.unpersist()
