"""Pairs of alike texts against all pairs; what prefixes must not lose."""

import difflib
import random

import pytest


from tessera.operators import similarity as S
from tessera.operators.matching import institution_match, token_match


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def names(seed, n):
    rng = random.Random(seed)
    stems = ["BANCO", "CREDITO", "NORTE", "AAAA", "ABAB", "X", "", "INVEST"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(stems) for _ in range(rng.randint(0, 3))) + "".join(rng.choice("AB ") for _ in range(rng.randint(0, 5)))
        out.append(text)
        cut = list(text)
        for _ in range(rng.randint(0, 2)):
            if cut:
                at = rng.randrange(len(cut))
                cut[at : at + 1] = rng.choice([[], ["Z"], [cut[at]] * 2])
        out.append("".join(cut))
    return out


@pytest.mark.parametrize("limit", [0.3, 0.5, 0.7, 0.75, 0.85, 6 / 7, 0.95, 1.0])
def test_no_pair_is_lost(spark, limit):
    left, right = names(1, 60), names(2, 60)
    frames = [spark.createDataFrame([(x,) for x in [*texts, None]], "text string") for texts in (left, right)]
    got = [(r["left_text"], r["right_text"], r["likeness"]) for r in S.similar_texts(*frames, "text", limit).collect()]
    wanted = {(a, b): ratio(a, b) for a in set(left) for b in set(right) if ratio(a, b) >= limit}
    assert len(got) == len(wanted) and {(a, b): c for a, b, c in got} == pytest.approx(wanted)


def test_the_bound_on_shared_grams_holds():
    rng = random.Random(5)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ABC") for _ in range(rng.randint(1, 14))) for _ in range(2))
        own = ratio(a, b)
        for limit in (own, 0.8 * own):
            if limit > 0:
                for q in (1, 2, 3):
                    grams = [[t[k : k + q] for k in range(len(t) - q + 1)] for t in (a, b)]
                    shared = sum(min(grams[0].count(g), grams[1].count(g)) for g in set(grams[0]))
                    assert shared >= S.least_shared(len(a) + len(b), limit, q)
    assert [S.gram_size(x) for x in (0.5, 0.75, 6 / 7, 0.9)] == [1, 1, 2, 2]


def test_a_frequent_word_makes_no_pairs(spark):
    """Names that begin alike meet at what tells them apart."""
    rng = random.Random(7)
    texts = sorted({"BANCOCOMERCIAL" + "".join(rng.choice("BCDFGHJKLMNPQRSTVWXYZ") for _ in range(12)) for _ in range(1500)})
    frame = spark.createDataFrame([(x,) for x in texts], "text string")
    other = spark.createDataFrame([(x[:18] + "Q" + x[19:],) for x in texts], "text string")
    got = S.similar_texts(frame, other, "text", 0.95)
    assert {r["left_text"] for r in got.collect()} == set(texts)


def test_alike_names_without_a_shared_token(spark):
    left = spark.createDataFrame([(1, "Bradesco"), (2, "Banco do Norte"), (3, "Quite Other"), (4, None), (5, "Itaunibanco")], "l int, name string")
    right = spark.createDataFrame([(10, "Bradescos"), (20, "BCO Norte SA"), (30, "Itaunibanca"), (40, "Itau")], "r int, name string")
    assert {r["l"]: r["r"] for r in institution_match(left, right, "l", "r", "name").collect()} == {1: 10, 2: 20, 5: 30}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_tokens_meet_at_rare_ones(spark, least):
    rng = random.Random(least)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    left, right = ([(k, " ".join(["common", *rng.sample(words, rng.randint(0, 4))])) for k in range(80)] for _ in range(2))
    got = {(r["l"], r["r"], r["overlap"]) for r in token_match(spark.createDataFrame(left, "l int, name string"), spark.createDataFrame(right, "r int, name string"), "l", "r", "name", least).collect()}
    wanted = set()
    for k, a in left:
        found = sorted(((len(set(a.split()) & set(b.split())), j) for j, b in right), reverse=True)
        if found[0][0] >= least and found[0][0] != found[1][0]:
            wanted.add((k, found[0][1], found[0][0]))
    assert got == wanted and got

