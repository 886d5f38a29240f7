"""Centroid clustering of integer vectors by partial-distance search.

Every component x becomes the integer floor(64 x). A round gives each vector its nearest centroid and moves every
centroid to the exact floored mean of its vectors. Squared differences are summed over the dimensions of largest
variance first, a block at a time; a centroid is given up for a vector once its sum is strictly above the best complete
distance found so far, and those that are left finish all dimensions. Vectors stay where the input has them: a round is
one pass that sends the sums of each partition, cut into limbs of 32 bits, to one row per centroid, dimension and limb.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take no part; ties go to
the smaller centroid number; rows that repeat a vec_id are vectors of their own, and where such rows compete for a place
among the first centroids, the smaller vector (in array order) comes first; a null vec_id takes part, and is a first centroid only
where too few others are; with fewer vectors than centroids there are as many centroids as vectors; an empty table gives
an empty result; other columns are ignored. Components beyond 2^27 are computed with unbounded integers; a distance or
inertia that a long can't hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
BLOCK, SLICE, WIDE = 8, 2048, 1 << 27
_LIMB = 1 << 32


def integers(values: np.ndarray) -> np.ndarray:
    """floor(64 x) of each component, as 64-bit integers where squares of their differences can be summed in them, else as Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not scaled.size or np.abs(scaled).max() <= WIDE:
        return scaled.astype(np.int64)
    # A product that leaves the range of a double is exact in integers: 64 x has no fraction there.
    return np.array([[int(x // 1) if np.isfinite(x) else int(v) * SCALE for x, v in zip(row, own, strict=True)] for row, own in zip(scaled, values, strict=True)], object)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, its squared distance, and how many differences were squared.

    ``order`` names the dimensions, the most telling first.
    """
    v, c = vectors[:, order], centroids[:, order]
    n, k, size = len(v), len(c), v.shape[1]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    first = v[:, None, :BLOCK] - c[None, :, :BLOCK]
    partial = (first * first).sum(axis=2)
    ranked = np.argsort(partial, axis=1, kind="stable")
    label, best, work = np.zeros(n, np.int64), np.zeros(n, partial.dtype), n * k * min(BLOCK, size)
    for place in range(k):
        rows, cols = np.arange(n), ranked[:, place]
        sums = partial[rows, cols]
        if place:
            # Sums equal to the best go on: the smaller number may still win a tie.
            rows = np.flatnonzero(sums <= best)
            cols, sums = cols[rows], sums[rows]
            if not len(rows):
                break
        for at in range(BLOCK, size, BLOCK):
            apart = v[rows, at : at + BLOCK] - c[cols, at : at + BLOCK]
            work += apart.size
            sums = sums + (apart * apart).sum(axis=1)
            if place:
                alive = sums <= best[rows]
                rows, cols, sums = rows[alive], cols[alive], sums[alive]
        wins = np.ones(n, bool) if not place else (sums < best[rows]) | (cols < label[rows])
        best[rows[wins]], label[rows[wins]] = sums[wins], cols[wins]
    return label, best, work


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), DIMENSIONS)


def usable(vector: Column) -> Column:
    """Whether a vector has exactly 64 components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == DIMENSIONS) & finite, F.lit(False))


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    sign, total, place = (1 if total >= 0 else -1), abs(total), 0
    while total:
        yield place, sign * (total % _LIMB)
        total, place = total // _LIMB, place + 1


_SUMS = "cluster int, dimension int, limb int, part long"


def _summed(vectors: DataFrame, measures) -> dict[tuple[int, int], int]:
    """Exact sums by (cluster, dimension); ``measures`` yields them for one batch of integer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for key, value in measures(integers(_matrix(batch.column("vector").slice(at, SLICE)))):
                    totals[key] = totals.get(key, 0) + int(value)
        rows = [(*key, place, part) for key, total in totals.items() for place, part in _limbs(total)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "dimension", "limb", "part"])

    found: dict[tuple[int, int], int] = {}
    # As many rows as clusters times dimensions times limbs, whatever the number of vectors.
    for r in vectors.select("vector").mapInArrow(run, _SUMS).groupBy("cluster", "dimension", "limb").agg(F.sum("part").alias("part")).collect():
        key = (r["cluster"], r["dimension"])
        found[key] = found.get(key, 0) + r["part"] * _LIMB ** r["limb"]
    return found


def _held(centroids: list[list[int]]) -> np.ndarray:
    wide = any(abs(x) > WIDE for c in centroids for x in c)
    return np.array(centroids, object if wide else np.int64)


def _measures_of_round(centroids: np.ndarray, order: np.ndarray):
    def measures(v: np.ndarray):
        label, _, _ = nearest(v, centroids, order)
        for cluster in np.unique(label).tolist():
            own = v[label == cluster]
            yield (cluster, -1), len(own)
            yield from (((cluster, d), s) for d, s in enumerate(own.sum(axis=0).tolist()) if s)

    return measures


def _spread(v: np.ndarray):
    yield (-1, -1), len(v)
    wide = v.astype(object) if np.abs(v).max(initial=0) > 1 << 20 else v
    for kind, sums in enumerate((v.sum(axis=0), (wide * wide).sum(axis=0))):
        yield from (((kind, d), s) for d, s in enumerate(sums.tolist()) if s)


def fit(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[list[list[int]], np.ndarray] | None:
    """The centroids after ``rounds`` and the order of dimensions by falling variance; None without vectors."""
    place = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select("vec_id", "vector", place.alias("place")).orderBy(F.col("place").asc_nulls_last(), "vector").limit(centroids).collect()
    if not first:
        return None
    found = _summed(vectors, _spread)
    n = found[-1, -1]
    variance = [n * found.get((1, d), 0) - found.get((0, d), 0) ** 2 for d in range(DIMENSIONS)]
    order = np.array(sorted(range(DIMENSIONS), key=lambda d: (-variance[d], d)))
    now = [[int(x) for x in integers(np.array([r["vector"]], np.float64))[0]] for r in first]
    for _ in range(rounds):
        sums = _summed(vectors, _measures_of_round(_held(now), order))
        now = [[sums.get((k, d), 0) // sums[k, -1] for d in range(DIMENSIONS)] if (k, -1) in sums else c for k, c in enumerate(now)]
    return now, order


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def assign(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of each vector."""
    held = _held(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                label, best, _ = nearest(integers(_matrix(rows.column("vector"))), held, order)
                distance = [x if x < 1 << 63 else None for x in best.tolist()]
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    model = fit(vectors, centroids, rounds)
    if model is None:
        return spark.createDataFrame([], RESULT)
    now, order = model
    assigned = stage(assign(vectors, now, order), "clusters")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(whole.alias("inertia")).collect()}  # a row a centroid
    total = None if None in inertia.values() else sum(inertia.values())
    as_long = lambda x: int(x) if x is not None and x < 1 << 63 else None
    facts = [(k, as_long(inertia.get(k)), as_long(total), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(now)]
    return assigned.join(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same clustering in DuckDB's SQL, a vector's component a row."""
    steps = [f"""
        kept AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
        points AS MATERIALIZED (SELECT row_no, d, CAST(floor({SCALE} * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x FROM kept, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS d)),
        first AS (SELECT row_no, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) - 1 AS cluster FROM kept QUALIFY cluster < {centroids}),
        c0 AS MATERIALIZED (SELECT cluster, d, x FROM first JOIN points USING (row_no))"""]
    for k in range(rounds + 1):
        steps.append(f"""
        far{k} AS (SELECT row_no, cluster, sum((p.x - c.x) * (p.x - c.x)) AS distance FROM points AS p JOIN c{k} AS c USING (d) GROUP BY row_no, cluster),
        near{k} AS MATERIALIZED (SELECT row_no, cluster, distance FROM far{k} QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY distance, cluster) = 1)""")
        if k < rounds:
            steps.append(f"""
        mean{k} AS (SELECT cluster, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM near{k} JOIN points USING (row_no) GROUP BY cluster, d),
        c{k + 1} AS MATERIALIZED (SELECT cluster, d, coalesce(m.x, c.x) AS x FROM c{k} AS c LEFT JOIN mean{k} AS m USING (cluster, d))""")
    return f"""
        WITH {','.join(steps)},
        sums AS (SELECT cluster, sum(distance) AS cluster_inertia FROM near{rounds} GROUP BY cluster),
        names AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia, CAST((SELECT sum(distance) FROM near{rounds}) AS BIGINT) AS inertia, centroid_sha256
        FROM near{rounds} JOIN kept USING (row_no) JOIN sums USING (cluster) JOIN names USING (cluster)
    """
