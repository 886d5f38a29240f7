"""Held-out accuracy of the language classifier, its codes and its defined cases."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import language


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8, 30])
def test_codewords_differ_and_every_bit_splits(n):
    code = language.codewords(n)
    assert len({tuple(row) for row in code.tolist()}) == n and set(np.unique(code)) == {-1, 1}
    assert (np.abs(code.astype(int).sum(axis=0)) < n).all()
    least = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
    assert least >= code.shape[1] // 4


def test_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    held = [(i, lang) for i, lang in rows if got[i]["held_out"]]
    right = sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held)
    print("held out:", len(held), "accuracy", right)
    assert right >= 0.99


def invented(lang: int, seed: int, n: int) -> str:
    rng = random.Random(1000 * lang + seed)
    own = random.Random(lang)
    words = ["".join(own.choice("abcdefghijklmnoprstuvwß"[lang % 3 :]) for _ in range(own.randint(2, 8))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n))


def test_many_languages_short_and_mixed_texts(spark):
    rows = [(1000 * k + j, invented(k, j, 3 if j % 3 else 40), f"l{k}") for k in range(9) for j in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == sorted(f"l{k}" for k in range(9)) and np.allclose(model.trust.sum(axis=1), 1)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(model.predict(t)[0] == lang for _, t, lang in held) >= 0.9 * len(held)
    # From one language to another word by word: the answer changes, and near the change it is flagged.
    first, second = invented(1, 500, 200).split(), invented(2, 500, 200).split()
    said = [model.predict(" ".join(first[:k] + second[k:])) for k in range(200, -1, -1)]
    assert said[0][0] == "l1" and said[-1][0] == "l2" and not said[0][2] and not said[-1][2]
    assert 1 <= sum(s[2] for s in said) <= 100 and {s[0] for s in said if not s[2]} <= {"l1", "l2"}
    share = model.decode(np.zeros(model.code.shape[1]))
    assert np.isclose(share.sum(), 1) and np.ptp(share) < language.CLOSE


def test_slabs_of_a_long_text_give_what_one_gives(spark, monkeypatch):
    rows = [(k, invented(k % 2, k, 30), f"l{k % 2}") for k in range(100)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = invented(0, 7, 150_000) + " " + "x" * 700_000
    assert len(long) > 3 * language.SLAB and model.predict(long)[0] == "l0"
    text = invented(1, 8, 5000)
    whole = model.margins(text)
    monkeypatch.setattr(language, "SLAB", 1000)
    assert np.allclose(whole, model.margins(text), atol=0.5)


def test_hard_rows(spark, hard, empty):
    rows = hard.collect()
    got = language.identify(hard).collect()
    assert len(got) == len(rows)
    blank = {r["doc_id"] for r in rows if r["doc_id"] is not None and not any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in got if r["doc_id"] is not None and r["lang_pred"] == "und"} == blank
    assert all((r["lang_pred"], r["score"]) in {("xx", 1.0), ("und", 0.0)} for r in got)
    assert sum(r["lang_pred"] == "und" for r in got) == sum(not any(c.isalpha() for c in r["text"] or "") for r in rows)
    assert language.identify(empty).count() == 0
    nothing = hard.selectExpr("doc_id", "text", "CAST(null AS string) AS lang", "1 AS score", "2 AS place")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(nothing).collect()} == {("und", 0.0)}
    two = hard.selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'aa' ELSE 'bb' END AS lang", "1 AS score", "2 AS place", "3 AS part")
    found = language.identify(two).collect()
    assert len(found) == len(rows) and {r["lang_pred"] for r in found} <= {"aa", "bb", "und"}
