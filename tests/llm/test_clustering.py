"""Clusters against a plain version with unbounded integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance long, part int, vector string"


def brute(rows, k=16, rounds=3):
    kept = [(i, v, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [r[2] for r in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    found = [(i, near(v)) for i, _, v in kept]
    sums = {}
    for _, (d, n) in found:
        sums[n] = sums.get(n, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    whole = lambda x, parts: fits(x) if all(fits(p) is not None for p in parts) else None
    return sorted(((i, n, fits(d), whole(sums[n], [e for _, (e, m) in found if m == n]), whole(sum(sums.values()), [e for _, (e, _) in found]), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, (d, n) in found), key=str)


def got(spark, rows, schema=SCHEMA):
    table = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], schema).repartition(3)
    return sorted((tuple(r) for r in clustering.clusters(table).collect()), key=str)


def vectors(seed, n, spread=1.0, grid=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(grid)) if grid else (lambda: rng.gauss(0, spread))
    return [[draw() for _ in range(64)] for _ in range(n)]


def test_hard_rows(spark):
    good = vectors(1, 60)
    rows = list(enumerate(good)) + [(3, good[3]), (3, good[4]), (None, good[5]), (None, good[6]), (200, None), (201, good[0][:63]), (202, good[0] + [1.0]), (203, [float("nan"), *good[0][1:]]), (204, [float("inf"), *good[0][1:]]), (205, [None, *good[0][1:]]), (206, []), (207, [-0.0] * 64)]
    assert got(spark, rows) == brute(rows)


def test_ties_copies_and_empty_clusters(spark):
    rows = list(enumerate(vectors(2, 90, grid=[0.0, 1 / 64])) ) + [(1000 + k, [0.5] * 64) for k in range(200)]
    assert got(spark, rows) == brute(rows)
    same = [(k, [0.25] * 64) for k in range(40)]
    assert got(spark, same) == brute(same)
    few = list(enumerate(vectors(3, 5)))
    assert got(spark, few) == brute(few) and got(spark, [(None, few[0][1])]) == brute([(None, few[0][1])])
    assert got(spark, []) == [] and got(spark, [(1, None)]) == []


def test_components_of_any_size(spark):
    rng = random.Random(4)
    rows = list(enumerate(vectors(4, 30))) + [(100 + k, [rng.choice([-1, 1]) * 10.0 ** rng.uniform(5, 25) for _ in range(64)]) for k in range(20)] + [(300, [1.7e308, -1.7e308] * 32)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("grid", [None, [0.0, 0.02, 0.5]])
def test_partial_distances_give_up_only_what_is_farther(grid):
    v = clustering.integers(np.array(vectors(5, 300, grid=grid)))
    c = v[:16]
    full = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    for order in (np.arange(64), np.random.default_rng(0).permutation(64)):
        label, best, work = clustering.nearest(v, c, order)
        assert (label == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
        assert work < 300 * 16 * 64


def test_given_up_early_where_clusters_are_apart():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 3, (16, 64))
    v = clustering.integers(centres[rng.integers(0, 16, 2000)] + rng.normal(0, 0.2, (2000, 64)))
    _, _, work = clustering.nearest(v, clustering.integers(centres), np.arange(64))
    assert work < 0.3 * 2000 * 16 * 64


def test_sf_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table.collect()]
    assert sorted((tuple(r) for r in clustering.clusters(table).collect()), key=str) == brute(rows)
