"""Nearest neighbours by largest inner product: collision-counting hashing.

Inner product becomes distance by one more coordinate: a vector x gets sqrt(M^2 - |x|^2), M being the largest norm, a
query is scaled to norm M and gets 0. Each of ``projections`` random directions (rotated axes, so that together they keep
all of a distance) gives every vector one number; an index block keeps its vectors' numbers sorted by direction. A query's
windows are centred on its own numbers. They widen round by round by the factor ``growth`` (virtual rehashing: the arrays
stay, only the windows change); each round counts only what the windows newly cover, and the first one what they leave
out where that is less. A vector on which ``threshold`` of the windows agree is verified in double precision. A query
stops in a block when the share ``enough`` of the block's vectors, ``least`` or more, is verified, or when the windows cover the
block, in which case every vector has been verified.

Blocks: the index is dealt into bounded blocks by a hash of the ids and is not copied while there are fewer than
BLOCK_QUERIES queries; each query goes to every block, and the best of each are merged for each query. All rows are
indexed; nothing is fitted on a sample. Since every query meets every block, work grows as queries times rows: where
vectors have no structure no window can leave out most of them and still find the nearest.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part
as queries or candidates; fewer candidates than ``k`` give fewer rows; ties go to the smaller vec_id; rows that repeat a
vec_id are candidates each, and none is a candidate of a query of that id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, BLOCK_QUERIES = 16384, 65536


def rotated_axes(count: int, size: int, seed: int) -> np.ndarray:
    """``count`` random directions, orthogonal among each ``size`` of them, of the length of normal ones."""
    rng, out = np.random.default_rng(seed), []
    while sum(map(len, out)) < count:
        out.append(np.linalg.qr(rng.standard_normal((size, size)))[0].T * math.sqrt(size))
    return np.concatenate(out)[:count]


def best(vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, point: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` of ``near`` with the largest inner products, and these; ties go to the smaller id.

    A quick product picks what can be among them; these few are summed alike, so equal vectors get equal scores.
    """
    if len(near) > 2 * k:
        quick = vectors[near] @ point
        limit = np.partition(quick, len(near) - k)[len(near) - k]
        near = near[quick >= limit - 1e-9 * max(1.0, abs(limit))]
    scores = (vectors[near] * point).sum(axis=1)
    order = np.lexsort((ids[near], -scores))[:k]
    return near[order], scores[order]


class CollisionIndex:
    """Sorted single-projection arrays of one block."""

    def __init__(self, vectors: np.ndarray, top_norm: float, projections: int, seed: int):
        self.vectors = vectors
        rest = np.sqrt(np.maximum(top_norm**2 - (vectors**2).sum(axis=1), 0))
        self.directions = rotated_axes(projections, vectors.shape[1] + 1, seed)
        places = np.column_stack([vectors, rest]) @ self.directions.T
        self.order = np.argsort(places, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(places, axis=0).T.copy()
        self.top_norm = top_norm

    def search(self, queries: np.ndarray, width: float, growth: float, threshold: int, enough: float, least: int) -> list[np.ndarray]:
        """For each query the vectors that reach the threshold in the last round it needs: ``least`` of them, or all, at least."""
        n, m = len(self.vectors), len(self.directions)
        norms = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        centres = (queries * (self.top_norm / norms)) @ self.directions[:, :-1].T
        start = np.stack([np.searchsorted(self.sorted[j], centres[:, j]) for j in range(m)], axis=1)
        low, high = start.copy(), start.copy()
        counts = np.zeros((len(queries), n), np.uint16)
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        live, half, first = np.arange(len(queries)), width * self.top_norm / 2, True
        while len(live):
            left = np.stack([np.searchsorted(self.sorted[j], centres[live, j] - half, "left") for j in range(m)], axis=1)
            right = np.stack([np.searchsorted(self.sorted[j], centres[live, j] + half, "right") for j in range(m)], axis=1)
            for k, q in enumerate(live.tolist()):
                a, b, c, d = left[k].tolist(), low[q].tolist(), high[q].tolist(), right[k].tolist()
                if first and sum(d) - sum(a) > m * n / 2:
                    out = [self.order[j, : a[j]] for j in range(m)] + [self.order[j, d[j] :] for j in range(m)]
                    counts[q] = m - np.bincount(np.concatenate(out), minlength=n)
                else:
                    newly = [self.order[j, a[j] : b[j]] for j in range(m)] + [self.order[j, c[j] : d[j]] for j in range(m)]
                    counts[q] += np.bincount(np.concatenate(newly), minlength=n).astype(np.uint16)
            low[live], high[live] = left, right
            reached = counts[live] >= threshold
            enough_now = (reached.sum(axis=1) >= min(n, max(enough * n, least))) | ((low[live] == 0) & (high[live] == n)).all(axis=1)
            for k in np.flatnonzero(enough_now):
                found[live[k]] = np.flatnonzero(reached[k])
            live, first = live[~enough_now], False
            half *= growth
        return found


def _valid(column: str, size: int):
    return F.col(column).isNotNull() & (F.size(column) == size) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 64, width: float = 2.2, growth: float = 1.08, threshold: float = 0.8, enough: float = 0.03, least: int = 300, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull())
    sizes = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("size")).count().orderBy(F.col("count").desc(), "size").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.where(_valid("vector", sizes[0]["size"]))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0)).alias("queries"), F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    blocks, query_blocks = max(1, math.ceil(totals["n"] / BLOCK_ROWS)), max(1, math.ceil(totals["queries"] / BLOCK_QUERIES))
    top_norm = float(totals["norm"] or 1.0)

    def dealt(frame: DataFrame, own: int, other: int, name: str, other_name: str) -> DataFrame:
        """Each row once for each block of the other side."""
        return frame.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(own)).cast("int")).withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    index = dealt(rows, blocks, query_blocks, "block", "query_block")
    queries = dealt(rows.where(is_query).dropDuplicates(["vec_id"]), query_blocks, blocks, "query_block", "block")

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            data, points = np.stack(own["vector"].to_numpy()).astype(np.float64), np.stack(asked["vector"].to_numpy()).astype(np.float64)
            ids = own["vec_id"].to_numpy()
            built = CollisionIndex(data, top_norm, projections, seed)
            for at in range(0, len(points), 256):
                some = points[at : at + 256]
                for query_id, point, near in zip(asked["vec_id"].to_numpy()[at : at + 256], some, built.search(some, width, growth, round(threshold * projections), enough, max(least, 4 * k)), strict=True):
                    near, scores = best(data, ids, near[ids[near] != query_id], point, k)
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[near], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = index.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
