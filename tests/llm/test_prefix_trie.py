"""Tries against a plain version, with conversations cut by ranges, hot paths and long chains."""

import hashlib
import math
import random
import zlib

import pytest

from tessera.llm import common, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, pos string, digest string, above long"


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            item = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, item), (role, text)))
    original = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(original.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    below = {}
    for path in members:
        if path:
            below.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        kids = below.get(path, [])
        leaves[path] = sum(leaves[k] for k in kids) if kids else 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in kids)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == p))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(spark, rows):
    table = spark.createDataFrame([(*r, 1, "p", "d", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in prefix_trie.trie(table).collect())


def talk(conv, texts, role="user"):
    return [(conv, k, role, t) for k, t in enumerate(texts)]


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in [*rng.sample(range(-350, 900), 260), 10**12, -(10**12)]:
        rows += talk(c, [rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 6, 9, 14]))])
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "", "user"), (1, None, "é\U0001f600", "x\U0001f600"), (None, 0, "user", "a"), (2, 1, None, "b"), (2, 1, "b", None), (2, -5, "u", "z"), (3, 2, "u", None), (300, 0, "u", "only"), (305, 0, "u", "only"), (700, 0, "u", "a")]
    rows += [(k, 0, "u", "same") for k in range(800, 960)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(None, 1, "u", "a")]) == []


def test_one_conversation_over_many_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    rng = random.Random(2)
    texts = [rng.choice(["a", "bb", "ccc"]) for _ in range(3000)]
    rows = talk(11, texts) + talk(13, texts[:1500] + ["other"] * 500) + talk(17, texts[:2000]) + talk(5, texts[:700])
    rows += [r for c in range(20, 60) for r in talk(c, texts[: c - 15])]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_chains_on_chains(spark):
    # Each conversation goes one turn beyond the one before it: a tree of chains as deep as the longest.
    rows = [r for c in range(0, 60) for r in talk(100 * c, [f"t{k}" for k in range(6 + c)])]
    assert got(spark, rows) == brute(rows)


def test_lists_of_a_node_over_several_pieces(spark):
    members = [(7, 3, k) for k in range(-40, 400)] + [(8, 0, 5), (9, 1, 6), (9, 2, 7)]
    frame = spark.createDataFrame(members, "owner long, depth long, member long").repartition(5)
    found = {(r["conv_id"], r["depth"]): r["ends_sha256"] for r in prefix_trie.ends(frame, piece=9).collect()}
    wanted = {}
    for owner, depth, member in sorted(members):
        wanted.setdefault((owner, depth), []).append(str(member))
    assert found == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in wanted.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100])
def test_every_depth_has_its_step(n):
    steps = [prefix_trie._step_of(d, n) for d in range(1, n + 1)]
    assert max(steps) < n.bit_length() and steps.count(0) == 1


def test_scratch_frees_all_but_what_is_kept(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(common, "drop", lambda *staged: gone.extend(df.staged_at for df in staged))
    with common.scratch():
        with common.scratch():
            a, b = common.stage(spark.range(3), "a"), common.keep(common.stage(spark.range(4), "b"))
        assert gone == [a.staged_at] and b.count() == 4
    assert gone == [a.staged_at, b.staged_at]


def test_sf_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert sorted(tuple(r) for r in prefix_trie.trie(table).collect()) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
