"""Exact dedup, repeats and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import exact_dedup as E
from tessera.llm import substring_dedup
from tessera.llm.ngram_join import near_components
from tessera.llm.substring_dedup import remove_repeats

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def test_exact(docs, rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text.translate(LOWER)].append(doc)
    wanted = Counter()
    for doc, text in rows:
        own = groups[text.translate(LOWER)]
        keep = max((d for d in own if d is not None), default=None)
        wanted[doc, keep, len(own), doc == keep, hashlib.sha256(text.translate(LOWER).encode()).hexdigest()] += 1
    assert Counter(map(tuple, E.exact_dedup(docs).collect())) == wanted


def test_exact_tells_colliding_chunks_apart(hard, rows, monkeypatch):
    """With a fingerprint that says nothing, the verified digests alone decide."""
    monkeypatch.setattr(E.xxhash, "xxh3_64_intdigest", lambda chunk: 7)
    got = E.exact_dedup(hard.sparkSession.createDataFrame([(1, "same length a"), (2, "same length b"), (3, "Same length a")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in got} == {(1, 3), (2, 2), (3, 3)}


def repeats(rows, span=50):
    first: dict[bytes, int] = {}
    for doc, text in rows:
        data = text.encode()
        if doc is not None:
            for k in range(len(data) - span + 1):
                w = data[k : k + span]
                if first.get(w, doc) >= doc:
                    first[w] = doc
    out = Counter()
    for doc, text in rows:
        data, gone = text.encode(), bytearray(len(text.encode()))
        if doc is not None:
            for k in range(len(data) - span + 1):
                if first[data[k : k + span]] < doc:
                    gone[k : k + span] = b"\1" * span
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats(docs, rows):
    assert Counter(map(tuple, remove_repeats(docs).collect())) == repeats(rows)


@pytest.mark.parametrize(("hot", "deals"), [(10**9, 64), (10**9, 1), (300, 5)])
def test_repeats_of_hot_buckets(docs, rows, monkeypatch, hot, deals):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "DEALS", deals)
    assert Counter(map(tuple, remove_repeats(docs).collect())) == repeats(rows)


def test_a_passage_in_every_document_is_dealt_and_found(spark, monkeypatch):
    dice = random.Random(3)
    letters = lambda n: "".join(dice.choice("abcdefghij ") for _ in range(n))
    passage = letters(70)
    rows = [(k, letters(30) + passage + letters(30) + (passage + "z") * (k % 3) + "ab" * (40 * (k % 4 == 0))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(substring_dedup, "HOT", 50)
    found, hot = substring_dedup._hot_cells, []
    monkeypatch.setattr(substring_dedup, "_hot_cells", lambda cells: hot.append(found(cells)) or hot[-1])
    assert Counter(map(tuple, remove_repeats(docs).collect())) == repeats(rows)
    assert len(hot) == 1 and 0 < len(hot[0]) < 100  # the borders of the passage, whose surroundings differ; its inside is settled before


def staged_rows(monkeypatch):
    """Rows of the tables that op3 stages, by name, as they are counted while they last."""
    counts, stage = defaultdict(list), substring_dedup.stage

    def counted(df, name):
        out = stage(df, name)
        counts[name].append(out.where("gram is not null").count() if "gram" in out.columns else out.count())
        counts[f"all {name}"].append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "stage", counted)
    return counts


def test_rows_of_a_hot_bucket_go_with_its_pointers(spark, monkeypatch):
    """A passage in surroundings that differ: its open windows go on as a few runs a pointer, not as a row a window."""
    dice = random.Random(4)
    letters = lambda n: "".join(dice.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = letters(24)
    rows = [(k, letters(60) + passage + letters(60)) for k in range(200)] + [(300 + k, letters(30) + "common" + passage + " ending of this line") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substring_dedup, "HOT", 20)
    counts = staged_rows(monkeypatch)
    assert Counter(map(tuple, remove_repeats(docs).collect())) == repeats(rows)
    assert counts["refined"] and counts["contexts"][0] >= 100
    assert all(n <= 4 * counts["contexts"][0] for n in counts["all refined"])


def test_one_pointer_stands_for_copies_in_all_batches(spark, monkeypatch):
    """Copies in many batches, and an early border that differs: one document sends the bytes of a content, the others none."""
    dice = random.Random(6)
    letters = lambda n: "".join(dice.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    text = letters(3000)
    rows = [(k, text) for k in range(60)] + [(100, letters(20) + text[500:2500] + letters(20)), (101, text[:70])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    counts = staged_rows(monkeypatch)
    assert Counter(map(tuple, remove_repeats(docs).collect())) == repeats(rows)
    assert 0 < counts["contexts"][0] < 30


@pytest.mark.parametrize("busy", [1, 3])
def test_repeats_where_contents_are_spread(docs, rows, monkeypatch, busy):
    monkeypatch.setattr(substring_dedup, "BUSY", busy)
    assert Counter(map(tuple, remove_repeats(docs).collect())) == repeats(rows)


def shingles(text, k):
    words = [w for w in re.split("[ \t-\r]+", text.translate(LOWER)) if w]
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def components(rows, k, percent):
    sets = [(doc, shingles(text, k)) for doc, text in rows]
    holders = defaultdict(set)
    distinct = defaultdict(list)
    for doc, s in sets:
        if s and doc is not None:
            distinct[s].append(doc)
    names = list(distinct)
    for n, s in enumerate(names):
        for x in s:
            holders[x].add(n)
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, s in enumerate(names):
        shared = Counter(m for x in s for m in holders[x] if m > n)
        for m, common in shared.items():
            if 100 * common >= percent * (len(s) + len(names[m]) - common):
                parent[root(m)] = root(n)
    # Rows that repeat a doc_id are rows of their own, but a class is named by its smallest id.
    least = defaultdict(lambda: 1 << 62)
    for n, s in enumerate(names):
        least[root(n)] = min(least[root(n)], *distinct[s])
    number = {s: n for n, s in enumerate(names)}
    return Counter((doc, len(s), least[root(number[s])] if s and doc is not None else doc) for doc, s in sets)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_near(docs, rows, k, percent):
    assert Counter(map(tuple, near_components(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect())) == components(rows, k, percent)


def test_near_chain(spark):
    """Links that reach far: each text shares enough with the next, and the ends share nothing."""
    texts = [(900 - k, " ".join(f"w{k * 3 + j}" for j in range(60))) for k in range(40)]
    got = near_components(spark.createDataFrame(texts, "doc_id long, text string"), 4, 85).collect()
    assert Counter(map(tuple, got)) == components(texts, 4, 85) and len({r["component_id"] for r in got}) == 1


def test_empty(empty):
    assert E.exact_dedup(empty).count() == remove_repeats(empty).count() == near_components(empty, 4, 85).count() == 0


def test_near_repeated_ids(spark):
    """Rows of one id with different sets, each of which links elsewhere: the id joins both groups."""
    words = [f"v{k}" for k in range(200)]
    texts = [(1, " ".join(words[:60])), (1, " ".join(words[100:160])), (2, " ".join([*words[:59], "z"])), (3, " ".join([*words[100:159], "z"]))]
    got = near_components(spark.createDataFrame(texts, "doc_id long, text string"), 4, 85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_divide_skip():
    import random

    import numpy as np

    from tessera.llm.ngram_join import divide_skip, needed, overlap_needed

    rng = random.Random(5)
    for _ in range(200):
        own = rng.sample(range(400), rng.randint(1, 80))
        others = [np.sort(np.array(rng.sample(own, rng.randint(0, len(own))) + rng.sample(range(400, 900), rng.randint(1, 12)), np.uint64)) for _ in range(12)]
        size = len(own) - needed(len(own), 85) + 1
        short, long = np.sort(np.array(own[:size], np.uint64)), np.sort(np.array(own[size:], np.uint64))
        wanted = [i for i, o in enumerate(others) if len(set(own) & set(o.tolist())) >= overlap_needed(len(own), len(o), 85)]
        assert divide_skip(short, long, others, 85) == wanted
