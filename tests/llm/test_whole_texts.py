"""Every letter of a text is read, every random run is tested, and large open lists are dealt out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join, secrets, toxicity
from tessera.llm.gru import spell


@pytest.mark.parametrize("n", [1, 14, 28, 29, 42, 43, 300])
def test_every_letter_of_a_run_is_read(n):
    run = "".join(chr(0x4E00 + k) for k in range(n))
    pieces = toxicity.tokens(f"one {run} two")
    front, back, _ = spell(pieces[1:-1])
    assert (pieces[0], pieces[-1]) == ("one", "two") and max(map(len, pieces)) <= 28
    whole, _, _ = spell(list(run))
    assert set(whole[0].tolist()) == (set(front.ravel().tolist()) | set(back.ravel().tolist())) - {0}


def test_random_letters_digits_and_values_before_an_equals_sign(spark):
    rng = random.Random(3)
    lower, mixed = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [lower, lower.upper(), mixed, "0123456789", mixed + "0123456789"]
    def noise(kind):
        return "".join(rng.choice(kinds[kind]) for _ in range(22 if kind == 3 else 40))

    rows = [(100 * kind + k, f"see {noise(kind)}{'=name' if kind == 4 else ''} end") for kind in range(5) for k in range(50)]
    rows += [(1000 + k, "read " + "ab" * (15 + k % 9) + " end") for k in range(50)] + [(2000, f"k={noise(2)}=={noise(2)} end")]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in range(5):
        assert sum("random" in got[100 * kind + k] for k in range(50)) >= 40, kind
    assert sum("random" in got[1000 + k] for k in range(50)) <= 3
    assert got[2000].count("random") <= 1


@pytest.mark.parametrize("n", [20, 24, 40])
def test_rates_of_letters_and_digits_by_length(spark, n):
    """What is found of random strings without digits, and of digits alone, at each length; written words stay."""
    rng = random.Random(n)
    lower = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * kind + k, f"see {''.join(rng.choice(letters) for _ in range(n))} end") for kind, letters in enumerate([lower, lower.upper(), lower + lower.upper(), "0123456789"]) for k in range(50)]
    words = ["people", "water", "little", "should", "because", "though", "market", "garden", "being", "never", "house", "other", "found", "still", "between", "country"]
    rows += [(1000 + k, "see " + "".join(rng.choice(words) for _ in range(rng.randint(5, 8))) + " end") for k in range(400)]
    rows += [(2000, "see 00000000000000000000 11111111112222222222333 99999999999999999999 end")]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {20: [40, 40, 33, 45], 24: [43, 43, 38, 45], 40: [46, 46, 46, 45]}[n]
    for kind in range(4):
        assert sum("random" in got[100 * kind + k] for k in range(50)) >= least[kind], kind
    assert sum("random" in got[1000 + k] for k in range(400)) <= 4 and "random" not in got[2000]


def test_an_open_list_is_dealt_over_parts_and_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_MEMBERS", 64)
    nodes = [(7, 64, k, k, bytes(ngram_join.parity_map(np.arange(64, dtype=np.uint64)))) for k in range(300)]
    lists = spark.createDataFrame(nodes, "shingle long, n long, node long, component long, map binary")
    found, met, leaders = lists, set(), 64
    parts = ngram_join._dealt(lists, leaders).groupBy("part").agg(F.count("*").alias("rows"), F.sum(F.col("leads").cast("int")).alias("heads")).collect()
    assert len(parts) == 5 and {r["heads"] for r in parts} == {60} and max(r["rows"] for r in parts) < 180
    while not found.isEmpty():
        out = ngram_join._dealt(found, leaders).mapInArrow(ngram_join._open_pairs(80), ngram_join._PAIRS).cache()
        pairs = [(r["a"], r["b"]) for r in out.where("a is not null").collect()]
        assert len(pairs) == len(set(pairs)) and not met & set(pairs)
        met |= set(pairs)
        found, leaders = out.where("shingle is not null").select("shingle", "n", "node", "component").join(lists.select("node", "map"), "node"), 16 * leaders
    assert len(met) == 300 * 299 // 2
