"""Medians of others against plain ones, cascades of sources, and chains of receipts."""


import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import cascade, sectors, underlying


@pytest.mark.parametrize("few", [1, 7, 100_000])
def test_order_statistics(spark, few, monkeypatch):
    monkeypatch.setattr(sectors, "CELLS", 16)
    rng = random.Random(few)
    groups = {"a": [rng.gauss(0, 1) for _ in range(900)], "b": [rng.randint(0, 3) * 1.0 for _ in range(500)], "c": [5.0] * 300, "d": [1.0], "e": [2.0, 1.0], "f": [None, 3.0, 1.0, 2.0], "g": [None]}
    rows = [(k, v) for k, values in groups.items() for v in values]
    half = F.floor(F.col("n") / 2)
    got = {r["k"]: (r["n"], list(r["values"])) for r in sectors.order_statistics(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", F.array(half, half + 1, half + 2), few).collect()}
    assert set(got) == set("abcdef")
    for k, values in groups.items():
        own = sorted(v for v in values if v is not None)
        n = len(own)
        if n:
            assert got[k][0] == n
            for place, rank in enumerate((n // 2, n // 2 + 1, n // 2 + 2)):
                if 1 <= rank <= n:
                    assert got[k][1][place] == own[rank - 1]


def test_against_peers(spark):
    rng = random.Random(2)
    names = list(sectors.MULTIPLES)
    rows = [(k, rng.choice(["x", "x", "y", "z"]), *[rng.choice([None, 1.0, 2.0, 3.0, rng.uniform(0, 9)]) for _ in names]) for k in range(70)] + [(100 + k, "small", *[1.0 * k] * 7) for k in range(3)] + [(200 + k, "four", *[float(k) if k else None] * 7) for k in range(4)]
    frame = spark.createDataFrame(rows, f"k int, sector string, {', '.join(f'{n} double' for n in names)}")
    got = {(r["k"], r["multiple"]): r for r in sectors.against_peers(frame, "k", few=5).collect()}
    assert len(got) == 7 * len(rows)
    for k, sector, *values in rows:
        others = [r for r in rows if r[1] == sector and r[0] != k]
        for name, value in zip(names, values, strict=True):
            r, sample = got[k, name], [v for o in others if (v := o[2 + names.index(name)]) is not None]
            assert (r["peers"], r["sample"]) == (len(others), len(sample))
            wanted = statistics.median(sample) if len(others) >= 3 and sample else None
            assert r["median"] == (None if wanted is None else pytest.approx(wanted)), (k, name)
            assert (r["ratio"] is None) == (value is None or not wanted)


def test_multiples_and_universe(spark):
    rows = [(1, 10.0, 5.0, 100.0, 20.0, 50.0, None, 7.0), (2, 0.0, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0), (3, 10.0, 5.0, -1.0, 1.0, 1.0, 2.0, 0.0), (4, 1.0, 1.0, 1.0, -1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "k int, price double, shares double, net_income double, equity double, ebitda double, net_debt double, free_cash_flow double").withColumn("ebit", F.lit(None).cast("double"))
    base = sectors.universe(frame, spark.createDataFrame([(1, "s"), (2, "s"), (3, "s"), (4, "s"), (5, "s")], "k int, sector string"), "k")
    got = {r["k"]: r for r in sectors.multiples(base, "k", "price", "shares").collect()}
    assert set(got) == {1, 3} and got[1]["price_to_earnings"] == 0.5 and got[1]["ev_to_ebitda"] == 1.0 and got[1]["ev_to_ebit"] is None
    assert got[3]["price_to_earnings"] is None and got[3]["earnings_yield"] == -0.02 and got[3]["ev_to_ebitda"] == 52.0 and got[3]["price_to_free_cash_flow"] is None


@pytest.mark.parametrize("literal", [0, 1000])
def test_cascade_asks_for_what_is_left(spark, tmp_path, literal):
    first = [(k, k * 1.0 if k % 3 == 0 else None) for k in range(0, 40)]
    second = [(k, k * 2.0) for k in range(0, 60, 2)]
    paths = []
    for name, rows in (("first", first), ("second", second)):
        paths.append(str(tmp_path / name))
        spark.createDataFrame(rows, "k long, v double").write.parquet(paths[-1])
    a, b = (spark.read.parquet(p) for p in paths)
    wanted = spark.createDataFrame([(k,) for k in [*range(0, 30), 3, 4, None]], "k long")
    got = {r["k"]: r for r in cascade.cascade(wanted, "k", [("first", a), ("second", b)], F.col("v").isNotNull(), "no filing", literal).collect()}
    assert set(got) == set(range(30))
    for k, r in got.items():
        if k % 3 == 0:
            assert (r["source"], r["attempts"], r["answer"]["v"], r["reason"]) == ("first", ["first"], k * 1.0, None)
        elif k % 2 == 0:
            assert (r["source"], r["attempts"], r["answer"]["v"]) == ("second", ["first", "second"], k * 2.0)
        else:
            assert (r["source"], r["answer"], r["reason"]) == (None, None, "no filing; attempted sources: first, second")
    left = spark.createDataFrame([(1,), (2,)], "k long")
    plan = cascade.asked(b, left, "k", literal)._jdf.queryExecution().toString()
    assert ("PushedFilters: [In(k, [1,2])]" in plan) == (literal > 0) and ("LeftSemi" in plan) == (literal == 0)


ROWS = "ticker string, kind string, fields map<string,string>"


def test_stated_underlying(spark):
    rows = [
        ("AAPL34", "bdr", {"UnderlyingTicker": " aapl ", "UnderlyingName": " Apple "}), ("B34", "bdr", {"UnderlyingTicker": "PETR4", "ReferenceSymbol": "BRK.B"}), ("C34", "bdr", {"z_Reference_Tckr": "CC", "a_underlyingSymbol": "AA", "underlying": "NO"}),
        ("D34", "bdr", {"UnderlyingTicker": "WAY-TOO-LONG-1"}), ("E34", "bdr", None), ("F3", "stock", {"UnderlyingTicker": "X"}), ("G34", "bdr", {"UnderlyingSymbol": "1X"}), ("H34", "bdr", {}),
    ]
    aliases = spark.createDataFrame([("D34", "DD"), ("h34 ", "HH"), ("F3", "FF"), ("AAPL34", "NO")], "ticker string, alias string")
    got = {r["ticker"]: (r["underlying"], r["underlying_name"], r["underlying_source"]) for r in underlying.stated_underlying(spark.createDataFrame(rows, ROWS), aliases).collect()}
    assert got == {"AAPL34": ("AAPL", "Apple", "fields"), "B34": ("BRK.B", None, "fields"), "C34": ("AA", None, "fields"), "D34": ("DD", None, "alias"), "E34": (None, None, None), "F3": (None, None, None), "G34": (None, None, None), "H34": ("HH", None, "alias")}


def test_chains_and_cycles(spark):
    links = [("a", "b"), ("b", "c"), ("c", "END"), ("x", "y"), ("y", "z"), ("z", "x"), ("into", "y"), ("self", "self"), ("one", "END"), (None, "a"), ("null", None)] + [(f"n{k}", f"n{k + 1}") for k in range(100)]
    got = {r["ticker"]: (r["final"], r["steps"], r["cycle"]) for r in underlying.chain_ends(spark.createDataFrame(links, "ticker string, underlying string")).collect()}
    assert {k: got[k] for k in ("a", "b", "c", "one")} == {"a": ("END", 3, False), "b": ("END", 2, False), "c": ("END", 1, False), "one": ("END", 1, False)}
    assert all(got[k] == (None, None, True) for k in ("x", "y", "z", "into", "self"))
    assert all(got[f"n{k}"] == ("n100", 100 - k, False) for k in range(100)) and len(got) == 9 + 100
    assert underlying.chain_ends(spark.createDataFrame([], "ticker string, underlying string")).count() == 0


def test_companies_are_made_once_for_all_their_medians(spark):
    from pyspark.sql import functions as F

    from tessera.operators import sectors as S

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = spark.range(40).select("id", F.lit("s").alias("sector"), *((F.col("id") + n).cast("double").alias(m) for n, m in enumerate(S.MULTIPLES)))
    found = S.against_peers(made.mapInArrow(count, made.schema), "id").collect()
    assert len(found) == 40 * len(S.MULTIPLES) and seen.value == 40
