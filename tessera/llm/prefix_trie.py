"""Prefix trie of rebuilt conversations, by a search for each conversation's first owned depth.

The smallest conversation that starts with a sequence of turns owns its node. On one conversation's path owners only grow
with depth, so what it owns is a chain: all depths from a first one to its end, or none. That first depth is found by binary
search, one batched join of the probed prefixes with the owners (the smallest conversation by depth and prefix
digest) for each step. A depth can be probed in one step only, which is written beside its prefix, so all steps together read every
prefix once. Chains hang on the chain that owns the node above their first; totals over subtrees go up this tree of chains by
pointer doubling, in as many rounds as its depth has binary digits, and then down each chain in blocks of depths.

A prefix digest is a polynomial of the digests of its turns modulo 2^127 - 1. Such digests of pieces can be put together, so
turns are numbered and digested in one sorted pass over ranges that may cut a conversation anywhere, and mended by the
sums of the ranges before (a row a range).

Defined cases: a null role or text is empty; a null turn comes first; equal turn numbers are ordered by the digest of role and
text, and repeated rows are turns of their own; a null conv_id names no conversation, and its rows take no part; c % 100
keeps the sign of c, so the source of -205 is -200; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import attach_group, keep, new_folder, owned_table, scratch, stage

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F % PRIME
HEADS, SHARED = 5, 100
#: Depths of a chain that one window sums, and conversation ids that one piece of a list holds.
BLOCK, PIECE = 4096, 1 << 16


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    role_text, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    # The length keeps role and text apart.
    item = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role_text).cast("string"), F.lit(":"), role_text, said), 256), 1, 32))
    return conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), item.alias("item"), F.char_length(said).cast("long").alias("chars")).where("conv_id is not null")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and prefix digests of the turns of one sorted range, as if each conversation began there."""
    part, conv, pos, digest, seq = TaskContext.get().partitionId(), None, 0, 0, 0
    for batch in batches:
        convs, items = batch.column("conv_id").to_pylist(), batch.column("item").to_pylist()
        places, digests = [], []
        for c, item in zip(convs, items, strict=True):
            if c != conv:
                conv, pos, digest = c, 0, 0
            pos, digest = pos + 1, (digest * BASE + int.from_bytes(item, "big") + 1) % PRIME
            places.append(pos)
            digests.append(digest.to_bytes(16, "big"))
        n = len(convs)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(digests, pa.binary()), batch.column("chars")], ["part", "seq", "conv_id", "pos", "digest", "chars"])
        seq += n


def _carries(scanned: DataFrame) -> list[tuple[int, int, int, int]]:
    """For each range that goes on with a conversation: range, conversation, its turns before and their digest. A row a range is read."""
    edges = scanned.groupBy("part").agg(F.min(F.struct("seq", "conv_id")).alias("first"), F.max(F.struct("seq", "conv_id", "pos", "digest")).alias("last"))
    out, held = [], None
    for r in sorted(edges.collect(), key=lambda r: r["part"]):
        last = r["last"]
        if held and r["first"]["conv_id"] == held[0]:
            out.append((r["part"], *held))
        n, digest = last["pos"], int.from_bytes(last["digest"], "big")
        if held and last["conv_id"] == held[0] == r["first"]["conv_id"]:
            digest = (held[2] * pow(BASE, n, PRIME) + digest) % PRIME
            n += held[1]
        held = (last["conv_id"], n, digest)
    return out


def prefixes(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest of the first pos turns (16 bytes), chars of the turn, of every original turn."""
    spark = conversations.sparkSession
    turns = _turns(conversations, conv, turn, role, text)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("item")]
    scanned = stage(turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_scan, "part int, seq long, conv_id long, pos long, digest binary, chars long"), "turn-scan")
    carries = _carries(scanned)
    if not carries:
        return scanned.drop("part", "seq")
    held = {(part, conv): (n, digest) for part, conv, n, digest in carries}  # a row a range at most

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "pos", "digest")), strict=True))
            for k, (part, conv, pos, digest) in enumerate(rows):
                if found := held.get((part, conv)):
                    whole = (found[1] * pow(BASE, pos, PRIME) + int.from_bytes(digest, "big")) % PRIME
                    rows[k] = (part, conv, pos + found[0], whole.to_bytes(16, "big"))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), batch.column("chars")], ["conv_id", "pos", "digest", "chars"])

    return scanned.mapInArrow(mend, "conv_id long, pos long, digest binary, chars long")


def _step_of(depth: int, n: int) -> int:
    """The step in which a binary search over depths 1 to n + 1 probes ``depth``."""
    low, high, step = 1, n + 1, 0
    while True:
        middle = (low + high) // 2
        if middle == depth:
            return step
        low, high, step = (low, middle, step + 1) if depth < middle else (middle + 1, high, step + 1)


def _rebase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own prefixes of a conversation behind its borrowed head: depth, digest and step of each."""
    names = ("pos", "digest", "taken", "n_head", "n_turns", "head", "skipped")
    for batch in batches:
        depths, digests, steps = [], [], []
        for pos, digest, taken, n_head, n, head, skipped in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if pos > taken:  # own turn behind the head
                moved = int.from_bytes(head, "big") - int.from_bytes(skipped, "big")
                digest = ((int.from_bytes(digest, "big") + moved * pow(BASE, pos - taken, PRIME)) % PRIME).to_bytes(16, "big")
                depth = n_head + pos - taken
            else:  # a turn of the head, as it stands in its source
                depth = pos
            depths.append(depth)
            digests.append(digest)
            steps.append(_step_of(depth, n))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depths, pa.int64()), pa.array(digests, pa.binary()), batch.column("chars"), pa.array(steps, pa.int32())], ["conv_id", "depth", "digest", "chars", "step"])


def rebuilt(turns: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, n_turns) after their heads are borrowed, and every prefix of them with its step of the search.

    ``turns``: what ``prefixes`` gives, staged; ``total``: its number of rows.
    """
    zero = F.lit(bytes(16))
    at = lambda k, c: F.max(F.when(F.col("pos") == k, F.col(c)))
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own"), *(at(k, "digest").alias(f"digest{k}") for k in range(1, HEADS + 1)), *(at(k, "chars").alias(f"chars{k}") for k in range(1, HEADS + 1)))
    own = stage(own.withColumn("taken", F.crc32(F.col("conv_id").cast("string")) % (HEADS + 1)).withColumn("source_id", F.col("conv_id") - F.col("conv_id") % SHARED), "conversations")
    prefix = lambda name, n: F.coalesce(F.element_at(F.array(*(F.col(f"{name}{k}") for k in range(1, HEADS + 1))), F.when(n > 0, n.cast("int"))), zero)
    sources = own.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("source_id"), F.col("n_own").alias("n_source"), *(F.col(f"{c}{k}").alias(f"source_{c}{k}") for c in ("digest", "chars") for k in range(1, HEADS + 1)))
    # At most 199 conversations share a source, so no key is hot here.
    n_head = F.least("taken", F.coalesce("n_source", F.lit(0)))
    convs = own.join(sources, "source_id", "left").withColumn("n_head", n_head)
    convs = convs.withColumn("n_turns", F.col("n_head") + F.greatest(F.col("n_own") - F.col("taken"), F.lit(0)))
    convs = stage(convs.select("conv_id", "n_own", "taken", "n_head", "n_turns", prefix("source_digest", F.col("n_head")).alias("head"), prefix("digest", F.least("taken", "n_own")).alias("skipped"), F.array(*(F.struct(F.lit(k).cast("long").alias("pos"), F.col(f"source_digest{k}").alias("digest"), F.col(f"source_chars{k}").alias("chars")) for k in range(1, HEADS + 1))).alias("heads")), "rebuilt")
    facts = ["taken", "n_head", "n_turns", "head", "skipped"]
    heads = convs.where("n_head > 0").select("conv_id", *facts, F.inline(F.slice("heads", F.lit(1), F.col("n_head").cast("int")))).select("conv_id", "pos", "digest", "chars", *facts)
    owned = attach_group(turns, convs.where("n_own > taken").select("conv_id", "n_own", *facts), ["conv_id"], "n_own", total).where("pos > taken").select("conv_id", "pos", "digest", "chars", *facts)
    return convs.select("conv_id", "n_turns"), heads.unionByName(owned).mapInArrow(_rebase, "conv_id long, depth long, digest binary, chars long, step int")


def first_owned(convs: DataFrame, paths: DataFrame, owners: DataFrame, steps: int, total: int) -> DataFrame:
    """conv_id, n_turns, first (owned depth, n_turns + 1 if none) and above (owner of the node before it, null for the root).

    ``paths``: conv_id, depth, digest by step; ``owners``: depth, digest, owner, n_convs.
    """
    state = convs.where("n_turns > 0").select("conv_id", "n_turns", F.lit(1).cast("long").alias("low"), (F.col("n_turns") + 1).alias("high"), F.lit(None).cast("long").alias("above"))
    done = []
    for step in range(steps):
        asked = state.where("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        probed = paths.where(F.col("step") == step).select("conv_id", "depth", "digest").join(asked, ["conv_id", "depth"])
        met = attach_group(probed, owners, ["depth", "digest"], "n_convs", total)
        mine = F.col("owner") == F.col("conv_id")
        state = stage(met.select("conv_id", "n_turns", F.when(mine, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(mine, F.col("above")).otherwise(F.col("owner")).alias("above")), "search")
        done.append(state.where("low = high"))
    found = convs.where("n_turns = 0").select("conv_id", "n_turns", F.lit(1).cast("long").alias("low"), F.lit(None).cast("long").alias("above"))
    for some in done:
        found = found.unionByName(some.drop("high"))
    return found.withColumnRenamed("low", "first")


def subtree_totals(chains: DataFrame, total: int, rounds: int) -> DataFrame:
    """conv_id, saved, leaves of each chain with all chains below it; ``chains``: conv_id, above, saved, leaves.

    Round k adds to each chain the sums of the chains whose pointer has come to it, which is 2^k up the tree, and doubles the
    pointers of those. ``rounds`` bounds the binary digits of the tree's depth.
    """
    now = chains.withColumnRenamed("above", "up")
    for _ in range(rounds):
        moving = now.where("up is not null")
        sums = moving.groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.count("*").alias("n"))
        met = stage(now.join(sums, "conv_id", "left"), "chains")
        targets = met.where("n is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"), "n")
        summed = met.select("conv_id", "up", (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"))
        moved = attach_group(summed.where("up is not null"), targets, ["up"], "n", total).select("conv_id", F.col("next").alias("up"), "saved", "leaves")
        now = stage(summed.where("up is null").unionByName(moved), "chains")
        if now.where("up is not null").isEmpty():
            break
    return now.drop("up")


def _pieces(most: int):
    """The sorted conversation ids of each node as texts of ``most`` ids at most, numbered by range and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, node, ids, rows, seq = TaskContext.get().partitionId(), None, [], [], 0
        for batch in batches:
            for owner, depth, member in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "member")), strict=True):
                if ids and (node != (owner, depth) or len(ids) >= most):
                    rows.append((*node, part, seq, ",".join(map(str, ids))))
                    ids, seq = [], seq + 1
                node = (owner, depth)
                ids.append(member)
            yield _piece_rows(rows)
            rows = []
        yield _piece_rows([(*node, part, seq, ",".join(map(str, ids)))] if ids else [])

    return run


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "part", "seq", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which come in order; only the hash's state is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if node != (owner, depth):
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield _named(out)
    yield _named([(*node, state.hexdigest())] if node else [])


def _named(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "ends_sha256"])


def ends(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, depth, ends_sha256 of each node at which conversations end; ``members``: owner, depth, member.

    The list of one node is sorted over several ranges and joined to pieces there; one task reads the pieces of a node, in a stream,
    since a SHA-256 has no parts.
    """
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    order = ["owner", "depth", "member"]
    pieces = members.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pieces(piece), "conv_id long, depth long, part int, seq long, ids string")
    return pieces.repartition(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part", "seq").mapInArrow(_digested, "conv_id long, depth long, ends_sha256 string")


def _below(facts: DataFrame, total: Column, name: str) -> Column:
    """Sum of ``total`` over the same chain's rows from this depth on, given the sums of later blocks."""
    block = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (F.sum(total).over(block) + F.coalesce(F.col(f"later_{name}"), F.lit(0))).alias(name)


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with scratch():
        return _trie(conversations.sparkSession, conversations, conv, turn, role, text)


def _trie(spark, conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    turns = stage(prefixes(conversations, conv, turn, role, text), "turns")
    total = turns.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    convs, paths = rebuilt(turns, total)
    convs = stage(convs, "convs")
    counted = convs.agg(F.count("*").alias("n"), F.max("n_turns").alias("longest"), F.min("conv_id").alias("least")).first()
    # By step, so that each step of the search reads its own prefixes only.
    folder = new_folder(spark, "paths")
    paths.repartition("step", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))).write.partitionBy("step").option("compression", "zstd").parquet(folder)
    paths = owned_table(spark.read.schema("conv_id long, depth long, digest binary, chars long, step int").parquet(folder), folder)
    owners = stage(paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")), "owners")
    found = keep(stage(first_owned(convs, paths, owners.drop("chars"), counted["longest"].bit_length(), total), "first-owned"))

    root = F.lit(counted["least"])
    is_root = F.col("conv_id") == root
    first = F.when(is_root, F.lit(0)).otherwise(F.col("first")).alias("first")
    chains = found.where(is_root | (F.col("first") <= F.col("n_turns"))).select("conv_id", "n_turns", first, F.when(~is_root, F.coalesce("above", root)).alias("above"))
    hung = chains.where("above is not null").select(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth"), F.col("conv_id").alias("below"))
    bare = hung.select("conv_id", F.col("depth").alias("n_turns")).distinct().withColumn("busy", F.lit(1).cast("long"))
    kept = owners.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    chains = stage(chains.join(bare, ["conv_id", "n_turns"], "left").join(kept, "conv_id", "left").select("conv_id", "n_turns", "first", "above", F.coalesce("saved", F.lit(0)).alias("saved"), (1 - F.coalesce("busy", F.lit(0))).alias("leaves")), "chains")
    totals = subtree_totals(chains.select("conv_id", "above", "saved", "leaves"), total, counted["longest"].bit_length() + 1)

    # Every fact about a node is a row under its key (owner and depth), so that one sum by key brings them together.
    null = F.lit(None).cast("long")

    def about(rows: DataFrame, depth: Column | str, **facts: Column) -> DataFrame:
        names = ("n_convs", "parent", "children", "saved", "leaves")
        return rows.select("conv_id", (F.col(depth) if isinstance(depth, str) else depth).cast("long").alias("depth"), *(facts.get(k, null).cast("long").alias(k) for k in names))

    hanging = hung.join(totals.withColumnRenamed("conv_id", "below"), "below")
    facts = about(owners.withColumnRenamed("owner", "conv_id"), "depth", n_convs=F.col("n_convs"), saved=(F.col("n_convs") - 1) * F.col("chars"))
    facts = facts.unionByName(about(chains.where(is_root), F.lit(0), n_convs=F.lit(counted["n"])))
    facts = facts.unionByName(about(hanging, "depth", children=F.lit(1), saved=F.col("saved"), leaves=F.col("leaves")))
    facts = facts.unionByName(about(chains, "first", parent=F.col("above")))
    # The end of a chain: its own leaf, and one child less than the nodes above it.
    facts = facts.unionByName(about(chains, "n_turns", leaves=F.col("leaves"), children=F.lit(-1)))
    nodes = keep(stage(facts.groupBy("conv_id", "depth").agg(F.max("n_convs").alias("n_convs"), F.max("parent").alias("parent"), (F.coalesce(F.sum("children"), F.lit(0)) + 1).alias("n_children"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves")).withColumn("block", F.floor(F.col("depth") / BLOCK)), "nodes"))
    later = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # A chain of more than one block has a row in its second.
    long_chains = nodes.where(F.col("block") > 0).select("conv_id").distinct()
    blocks = nodes.join(long_chains, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l")).select("conv_id", "block", F.sum("s").over(later).alias("later_saved"), F.sum("l").over(later).alias("later_leaves"))
    nodes = nodes.join(blocks, ["conv_id", "block"], "left") if counted["longest"] >= BLOCK else nodes.withColumn("later_saved", null).withColumn("later_leaves", null)
    nodes = nodes.select("conv_id", "depth", F.when((F.col("depth") > 0) & F.col("parent").isNull(), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children", _below(nodes, F.col("leaves"), "leaves").alias("n_leaves"), _below(nodes, F.col("saved"), "saved").alias("saved_tokens"))
    members = found.select(F.when((F.col("n_turns") == 0), root).when(is_root | (F.col("first") <= F.col("n_turns")), F.col("conv_id")).otherwise(F.col("above")).alias("owner"), F.col("n_turns").alias("depth"), F.col("conv_id").alias("member"))
    return nodes.join(ends(members), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))).select(*(c.split()[0] for c in RESULT.split(", ")))


ORACLE = """
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS item, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
         h AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 100 AS b FROM conversations WHERE conv_id IS NOT NULL),
         bits AS (SELECT c, b, CAST(c AS VARCHAR) AS s FROM h),
         crc AS (WITH RECURSIVE r AS (SELECT c, b, s, 1 AS i, 0 AS k, xor(4294967295::BIGINT, ascii(s[1])::BIGINT) AS v FROM bits
                    UNION ALL SELECT c, b, s, CASE WHEN k = 7 THEN i + 1 ELSE i END, (k + 1) % 8,
                        CASE WHEN k = 7 AND i < length(s) THEN xor(ascii(s[i + 1])::BIGINT, xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)) ELSE xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) END
                    FROM r WHERE i <= length(s))
                 SELECT c, b, xor(v, 4294967295::BIGINT) % 6 AS taken FROM r WHERE i > length(s)),
         x AS (SELECT crc.c, pos, item, chars, 0 AS part FROM crc JOIN t ON t.c = crc.b AND pos <= taken UNION ALL SELECT t.c, pos, item, chars, 1 FROM crc JOIN t ON t.c = crc.c AND pos > taken),
         l AS (SELECT c, list(item ORDER BY part, pos) AS items, list(chars ORDER BY part, pos) AS chars FROM x GROUP BY c),
         a AS (SELECT h.c, coalesce(items, []) AS items, coalesce(chars, []) AS chars, len(coalesce(items, [])) AS n FROM h LEFT JOIN l USING (c)),
         p AS (SELECT c, n, d, array_to_string(items[1:d], '') AS path, array_to_string(items[1:d - 1], '') AS up, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, items FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM a)),
         node AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, min(up) AS up, (count(*) - 1) * min(chars) AS saved, coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends, min(items[1:d]) AS items FROM p GROUP BY path, d),
         child AS (SELECT up AS path, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
         full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (path, d)),
         upward AS (SELECT array_to_string(items[1:k], '') AS path, k AS d, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_node) GROUP BY 1, 2)
    SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
    FROM full_node AS f JOIN upward AS u ON u.path = f.path AND u.d = f.d LEFT JOIN node AS parent ON f.d > 0 AND parent.path = f.up AND parent.d = f.d - 1
"""
