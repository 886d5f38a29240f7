"""Held-out accuracy of the classifier, gradients of its network, and recall of the neighbour search."""

import math

import numpy as np
import pytest

from tessera.llm import toxicity
from tessera.llm.ann import nearest
from tessera.llm.gru import Network, spell


def test_gradients_lower_the_loss():
    rng, network = np.random.default_rng(0), Network(3)
    words = ["plain", "nasty", "word", "thing", "vile"]
    ids = rng.integers(0, 5, (200, 16))
    labels = (ids == 1).any(axis=1).astype(np.float32)
    losses = [network.learn(spell(words), ids, labels, np.ones(200, np.float32), 0.01) for _ in range(120)]
    assert losses[-1] < 0.25 * losses[0]


def test_windows_cover_the_text():
    for n in (0, 1, 15, 16, 17, 40, 1000):
        starts = toxicity.window_starts(n)
        covered = {k for s in starts for k in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id", "left").toPandas()
    return docs.count(), got


def test_classifier(scored):
    n, got = scored
    assert len(got) == n and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    held = got[got["held_out"] & got["toxic"].notna()]
    right = (held["predicted"] == held["toxic"]).mean()
    toxic, clean = held[held["toxic"] == 1]["score"].to_numpy(), held[held["toxic"] == 0]["score"].to_numpy()
    area = ((toxic[:, None] > clean).mean() + 0.5 * (toxic[:, None] == clean).mean()) if len(toxic) else 1.0
    print("held out:", len(held), "accuracy", right, "area", area)
    assert right >= 0.95 and area >= 0.9


def test_classifier_on_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(4, 0, 1), (18, 1, 0), (None, 0, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(hard, labels).collect()
    assert len(got) == hard.count() and all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in got)
    assert {r["score"] for r in toxicity.classify(hard, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(empty, labels).count() == 0


def brute(rows, k=20, every=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in dict(r for r in good if r[0] % every == 0).items():
        out[q] = sorted(((i, float((w * v).sum())) for i, w in good if i != q), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_nearest(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/embeddings.parquet")
    wanted = brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    got = nearest(vectors).collect()
    assert {r["query_id"] for r in got} == set(wanted)
    near = {q: {i for i, _ in found} for q, found in wanted.items()}
    recall = sum(r["vec_id"] in near[r["query_id"]] for r in got) / sum(map(len, near.values()))
    print("recall", recall)
    assert recall >= 0.9
    for q in wanted:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)


def test_nearest_on_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (20, [0.5, -1.0]), (40, [0.0, 0.0]), (2, [3.0, 3.0]), (None, [1.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS block")).collect()
    assert {q: [(i, s) for i, s in f] for q, f in brute(rows).items()} == {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
