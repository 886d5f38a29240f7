"""N-gram Jaccard join by T-occurrence search, and the components of its links.

A link needs an overlap of T shingles, so the inverted lists of a document's T - 1 commonest shingles are its long lists:
a partner is on at least one of its other, short lists (DivideSkip's split). Routing: the short lists are sorted by
shingle over all tasks, and name the candidates of each query; maps of bits that bound the overlap from above spare
most of them the rest. Search: a query and the sets of its candidates meet, part by part; a heap merges the candidates'
inverted lists for the short shingles and counts occurrences, the long ones are probed by binary search while T is in reach,
and what reaches the overlap its size requires is a link. Shingles are ordered by their frequency where it is high
(counted over all documents), so passages that many documents share stand on long lists.

What is asked for is components, so no group of copies is expanded into pairs. Documents with equal sets are one from the
start. On each short list a few leaders are compared with all other members, then leave the list; links join components,
and members that share a component need no comparison. Lists with members of different components stay open for
further rounds with more leaders, until none is left: no link between components is lost.

Defined cases: a null, empty or blank text has no shingles, links with nothing and is its own component; equal sets link;
a null doc_id counts as its own component (null); rows that repeat a doc_id link to each other if their sets do and carry
their own n_shingles; an empty table gives an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_documents, attach_group, drop, frugal, stage
from tessera.llm.components import connected_components
from tessera.llm.shingles import mix, shingle_sets

#: Frequencies order the shingles; a table of the commonest is enough, since any one order gives the right result.
COMMON_SHINGLES, LOCALLY_COMMON, COUNTED = 200_000, 4, 6_000_000
#: Leaders of each list in the first round, and how many times more in each further one.
LEADERS, GROWTH = 4, 16
#: A common shingle's list is split in so many parts, whose leaders meet on a list of their own.
SALTS = 32
#: Members of an open list for each part that it is dealt to in further rounds, and the most parts.
PART_MEMBERS, MOST_PARTS = 512, 1024
#: Candidates that one task searches for one query at a time.
PART_CANDIDATES = 256
#: Bits of the filter that spares most other texts a second look; fixed, so that it can be sent to every task.
FILTER_BITS = 1 << 24


def _lowered(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes().lower() for t in column]


def _locally_common(k: int):
    """Shingles that several documents of a task's next COUNTED shingles hold, with their number there."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        often = counts >= LOCALLY_COMMON
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                new = shingle_sets(_lowered(batch.column("text").slice(at, 1000)), k)
                held += new
                size += sum(map(len, new))
                if size > COUNTED:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    return run


def common_shingles(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to COMMON_SHINGLES of the most frequent shingles, sorted, and their ranks (0: least frequent)."""
    spark = texts.sparkSession
    # Small input partitions are read together, so that a task sees enough documents to tell what is frequent.
    parts = texts.rdd.getNumPartitions()
    together = texts.select("text").coalesce(max(1, min(parts, max(3 * spark.sparkContext.defaultParallelism, parts // 16))))
    counted = together.mapInArrow(frugal(_locally_common(k)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.col("n").desc(), "shingle").limit(COMMON_SHINGLES).select("shingle").toPandas()
    values = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    ranks = np.arange(len(values), 0, -1, dtype=np.int64)
    order = np.argsort(values)
    return values[order], ranks[order]


def _ranks(shingles: np.ndarray, values: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """0 for a shingle outside the table, else its rank, higher for more frequent ones."""
    if not len(values):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
    return np.where(values[at] == shingles, ranks[at], 0)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any partner."""
    return (percent * n + 99) // 100


def overlap_needed(n: int, other: int, percent: int) -> int:
    """The least overlap of sets of these sizes with 100 |x & y| >= percent |x | y|."""
    return -(-percent * (n + other) // (100 + percent))


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """A bit for each slot, on where an odd number of shingles falls; as many slots as shingles, in powers of two."""
    slots = 1 << max(6, (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little")


def folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Maps of fewer slots, which are those of the same sets."""
    while maps.shape[-1] > size:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def may_link(maps: np.ndarray, own: np.ndarray, sizes: np.ndarray, n: int, percent: int) -> np.ndarray:
    """False only where sets differ too much from one: slots of unlike parity are no more than the shingles that differ."""
    size = min(maps.shape[-1], len(own))
    unlike = np.bitwise_count(folded(maps, size) ^ folded(own, size)).sum(axis=-1, dtype=np.int64)
    return unlike <= sizes + n - 2 * overlap_needed(sizes, n, percent)


def _sifted(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = ([np.frombuffer(m.as_buffer(), np.uint8) for m in batch.column(c)] for c in ("map_a", "map_b"))
            sizes = (batch.column(c).to_pylist() for c in ("n_a", "n_b"))
            keep = [bool(may_link(x, y, n, other, percent)) for x, y, n, other in zip(*maps, *sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def sift(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity maps, a thirty-second of a set's size at most, don't rule a link out: the others' sets stay where they are."""
    maps = nodes.select("node", "n", "map")
    ends = [maps.withColumnsRenamed({"node": e, "n": f"n_{e}", "map": f"map_{e}"}) for e in "ab"]
    return pairs.join(ends[1], "b").join(ends[0], "a").select("a", "b", "map_a", "map_b", "n_a", "n_b").mapInArrow(_sifted(percent), "a long, b long")


def _profiles(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, keys, short, commons, maps = [], [], [], [], []
                for shingles in shingle_sets(_lowered(part.column("text")), k):
                    n = len(shingles)
                    sizes.append(n)
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if n else None)
                    rank = _ranks(shingles, values, ranks)
                    first = np.argsort(rank, kind="stable")[: n - needed(n, percent) + 1 if n else 0]
                    short.append(shingles[first].view(np.int64))
                    commons.append(rank[first] > 0)
                    maps.append(parity_map(shingles).tobytes() if n else None)
                lists = pa.array(short, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(commons, pa.list_(pa.bool_())), pa.array(maps, pa.binary())], ["doc_id", "n_shingles", "set_key", "short", "common", "map"])

    return run


def _list_pairs(percent: int, leaders: int):
    """Reads lists sorted by (shingle, part); yields candidate pairs and what stays open.

    A list is streamed: only its leaders are held. The members that are not leaders come out again as the open list, if
    there is more than one of them; a list that is one of several parts comes out whole, since its members have yet to
    meet those of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "shingle", "n", "node", "component"]
        key, heads, held, out = None, [], None, []

        def flush():
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for shingle, part, n, node, component in zip(*(batch.column(c).to_pylist() for c in ("shingle", "part", "n", "node", "component")), strict=True):
                if (shingle, part) != key:
                    key, heads, held = (shingle, part), [], None
                for other_n, other, other_component in heads:
                    if component != other_component and 100 * min(n, other_n) >= percent * max(n, other_n):
                        out.append((min(other, node), max(other, node), None, None, None, None))
                if len(heads) < leaders:
                    heads.append((n, node, component))
                    if part >= 0:
                        out.append((None, None, shingle, n, node, component))
                elif held is None and part < 0:
                    held = (None, None, shingle, n, node, component)  # the only one so far: nothing to compare it with
                else:
                    if held:
                        out.append(held)
                        held = ()
                    out.append((None, None, shingle, n, node, component))
            yield flush()

    return run


class _Leaders:
    """Leaders of an open list by the size of their maps, in arrays that double."""

    def __init__(self):
        self.count, self.by_size = 0, {}

    def add(self, n: int, node: int, component: int, own: np.ndarray) -> None:
        filled, maps, facts = self.by_size.get(len(own), (0, np.zeros((4, len(own)), np.uint8), np.zeros((4, 3), np.int64)))
        if filled == len(maps):
            maps, facts = np.concatenate([maps, np.zeros_like(maps)]), np.concatenate([facts, np.zeros_like(facts)])
        maps[filled], facts[filled] = own, (n, node, component)
        self.by_size[len(own)] = filled + 1, maps, facts
        self.count += 1

    def partners(self, n: int, component: int, own: np.ndarray, percent: int) -> Iterator[int]:
        for filled, maps, facts in self.by_size.values():
            sizes, nodes, components = facts[:filled].T
            some = np.flatnonzero((components != component) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
            if len(some):
                yield from nodes[some[may_link(maps[some], own, sizes[some], n, percent)]].tolist()


def _open_pairs(percent: int):
    """As _list_pairs, for the few lists that stay open: their members bring their maps, so only pairs that may link come out.

    A part of a list starts with all leaders of the list; each of them meets those before it in its own part only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, heads = ["a", "b", "shingle", "n", "node", "component"], None, _Leaders()
        for batch in batches:
            out: list[tuple] = []
            maps = [np.frombuffer(m.as_buffer(), np.uint8) for m in batch.column("map")]
            for shingle, part, own_part, leads, n, node, component, own in zip(*(batch.column(c).to_pylist() for c in ("shingle", "part", "own_part", "leads", "n", "node", "component")), maps, strict=True):
                if (shingle, part) != key:
                    key, heads = (shingle, part), _Leaders()
                if part == own_part:
                    out += [(min(other, node), max(other, node), None, None, None, None) for other in heads.partners(n, component, own, percent)]
                if leads:
                    heads.add(n, node, component, own)
                else:
                    out.append((None, None, shingle, n, node, component))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


_PAIRS = "a long, b long, shingle long, n long, node long, component long"


def _set_rows(k: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            slots = mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)
            wanted = np.flatnonzero((table[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1))
            for at in range(0, len(wanted), 500):
                part = batch.take(pa.array(wanted[at : at + 500]))
                sets = shingle_sets(_lowered(part.column("text")), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set_key", "shingles"])

    return run


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = np.unique(mix(batch.column("node").to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS))
        yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slots & np.uint64(63))).view(np.int64))], ["word", "bits"])


def _filter(nodes: DataFrame):
    """A bit per hashed node: FILTER_BITS bits on the driver and each task, whatever the number of nodes."""
    rows = nodes.mapInArrow(_slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return nodes.sparkSession.sparkContext.broadcast(table)


def probed(long: np.ndarray, other: np.ndarray, found: int, need: int) -> bool:
    """Whether ``found`` and the long lists that hold ``other`` make ``need``: binary probes, part by part while in reach."""
    left, step = len(long), max(64, len(long) // 8)
    for at in range(0, len(long), step):
        if found >= need or found + left < need:
            break
        part = long[at : at + step]
        places = np.searchsorted(other, part)
        places[places == len(other)] = 0
        found += int((other[places] == part).sum())
        left -= len(part)
    return found >= need


def divide_skip(short: np.ndarray, long: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of the sets overlap as required with the one whose shingles are ``short`` and ``long``.

    The inverted lists of the short side are merged by a heap, which counts each set's occurrences; a set that the long lists
    could still bring to its required overlap is looked up in them.
    """
    lists: list[list[int]] = [[] for _ in short]
    for i, other in enumerate(sets):
        places = np.searchsorted(other, short)
        places[places == len(other)] = 0
        for j in np.flatnonzero(other[places] == short).tolist():
            lists[j].append(i)
    out = []
    for i, same in groupby(heapq.merge(*filter(None, lists))):
        need = overlap_needed(len(short) + len(long), len(sets[i]), percent)
        count = sum(1 for _ in same)
        if count + len(long) >= need and probed(long, sets[i], count, need):
            out.append(i)
    return out


def _search(percent: int):
    """Reads rows sorted by (a, part): first the query ``a`` with its short list shingles, then its candidates ``b``.

    An id that several rows with different sets carry has as many queries; a link of any of them is one of the id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, asked = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            nodes, sets = [], []

            def search():
                hits = sorted({i for short, long in asked for i in divide_skip(short, long, sets, percent)}) if sets else []
                found.extend((query, nodes[i]) for i in hits)

            for a, b, own, first in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles"), batch.column("short"), strict=True):
                values = np.frombuffer(own.as_buffer(), np.uint64)
                if b is None:
                    if a != query or sets:
                        search()
                        query, asked, nodes, sets = a, [], [], []
                    short = np.sort(np.array(first.values.to_numpy(zero_copy_only=False)).view(np.uint64))
                    asked.append((short, np.setdiff1d(values, short, assume_unique=True)))
                else:
                    nodes.append(b)
                    sets.append(values)
            search()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that link. The candidates of a query are dealt in parts of PART_CANDIDATES; each part gets the query's set."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_CANDIDATES).cast("int").alias("parts"))
    queries = sets.join(nodes.select("node", "set_key", "short"), ["node", "set_key"]).withColumnRenamed("node", "a").join(parts, "a")
    asked = queries.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles", "short")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    found = pairs.join(sets.select(F.col("node").alias("b"), "shingles"), "b").join(parts, "a").select("a", part, "b", "shingles", F.lit(None).cast("array<bigint>").alias("short"))
    dealt = asked.unionByName(found).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", "shingles", "short").mapInArrow(frugal(_search(percent)), "a long, b long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars: each node with the smallest it reaches here. No component falls apart or gets long."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    rays = [(root(x), x) for x in list(parent)]
    for at in range(0, len(rays), 100_000):
        some = [(x, y) for x, y in rays[at : at + 100_000] if x != y]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int64()), pa.array([y for _, y in some], pa.int64())], ["a", "b"])


def joined_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """node, label after further links: only the components that they join are looked at, not the links known before."""
    if links.isEmpty():
        return labels
    if labels is None:
        return connected_components(links)
    ends = [labels.select(F.col("node").alias(e), F.col("label").alias(f"label_{e}")) for e in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    found = connected_components(between)
    moved = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return stage(moved.unionByName(found.join(labels, "node", "left_anti")), "labels")


def _first_round(lists: DataFrame, percent: int) -> DataFrame:
    part = F.when(F.col("common"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(-1)).cast("int")
    keyed = lists.withColumn("part", part).select("shingle", "part", "n", "node", "component")
    return stage(keyed.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "component", "n", "node").mapInArrow(frugal(_list_pairs(percent, LEADERS)), _PAIRS), "candidates")


def _dealt(lists: DataFrame, leaders: int) -> DataFrame:
    """Lists in parts, one for each PART_MEMBERS members up to MOST_PARTS of them; each part has the leaders of all parts first."""
    sizes = lists.groupBy("shingle").agg(F.count("*").alias("members"))
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("members") / PART_MEMBERS)).cast("int")
    salted = lists.join(sizes, "shingle").withColumn("parts", parts).withColumn("own_part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rank = F.row_number().over(Window.partitionBy("shingle", "own_part").orderBy("component", "n", "node"))
    ranked = salted.withColumn("leads", rank <= F.greatest(F.lit(1), F.floor(F.lit(leaders) / F.col("parts"))))
    places = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own_part"))
    each = ranked.select("shingle", F.explode(places).alias("part"), "own_part", "leads", "n", "node", "component", "map")
    return each.repartition("shingle", "part").sortWithinPartitions("shingle", "part", F.col("leads").desc(), "component", "n", "node")


def _further_round(lists: DataFrame, percent: int, leaders: int) -> DataFrame:
    return stage(_dealt(lists, leaders).mapInArrow(frugal(_open_pairs(percent)), _PAIRS), "candidates")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links join documents of Jaccard similarity percent / 100 or more."""
    spark = docs.sparkSession
    texts = as_documents(docs, id_col, text_col)
    common = spark.sparkContext.broadcast(common_shingles(texts, k))
    profiles = stage(texts.mapInArrow(frugal(_profiles(k, percent, common)), "doc_id long, n_shingles long, set_key binary, short array<long>, common array<boolean>, map binary"), "profiles")
    total = profiles.count()
    # Equal sets are one node, named by its smallest document.
    classes = profiles.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("members"), F.first(F.struct("n_shingles", "short", "common", "map")).alias("p"))
    nodes = stage(classes.select("set_key", "node", "members", F.col("p.n_shingles").alias("n"), F.col("p.short").alias("short"), F.col("p.common").alias("common"), F.col("p.map").alias("map")), "nodes")
    lists = nodes.select("node", "n", F.inline(F.arrays_zip("short", "common"))).select(F.col("short").alias("shingle"), "common", "n", "node", F.col("node").alias("component"))

    first = _first_round(lists, percent)
    rounds, tested, leaders = [first], None, LEADERS
    # A common shingle's list is dealt anew from here on; most members of a large one share a component by now.
    opened = first.where("shingle is not null").select("shingle", "n", "node", "component")
    pairs, labels = sift(first.where("a is not null").select("a", "b").distinct(), nodes, percent), None
    while True:
        pairs = stage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            ends = stage(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
            sets = texts.where("doc_id is not null").mapInArrow(frugal(_set_rows(k, _filter(ends))), "node long, set_key binary, shingles binary")
            sets = stage(sets.join(nodes.select("node", "set_key"), ["node", "set_key"], "left_semi").join(ends, "node", "left_semi").dropDuplicates(["node", "set_key"]), "sets")
            new = stage(verified(pairs, sets, nodes, percent).repartition("b").mapInArrow(frugal(_stars), "a long, b long"), "links")
            drop(sets, ends)
            tested = pairs if tested is None else tested.unionByName(pairs)
            labels = joined_labels(labels, new)
            drop(new)
        if labels is not None:
            opened = opened.select("shingle", "n", "node").join(labels, "node", "left").select("shingle", "n", "node", F.coalesce("label", "node").alias("component"))
        mixed = opened.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
        still = stage(opened.join(mixed, "shingle", "left_semi").join(nodes.select("node", "map"), "node"), "open-lists")
        drop(*rounds)
        if still.isEmpty():
            break
        leaders *= GROWTH
        found = _further_round(still, percent, leaders)
        rounds = [still, found]
        pairs = found.where("a is not null").select("a", "b").distinct()
        opened = found.where("shingle is not null").select("shingle", "n", "node", "component")

    known = nodes.select("set_key", "node", "members")
    known = known.join(labels, "node", "left").select("set_key", "members", F.coalesce("label", "node").alias("component_id")) if labels is not None else known.select("set_key", "members", F.col("node").alias("component_id"))
    rows = profiles.select("doc_id", "n_shingles", "set_key")
    inside = attach_group(rows.where("set_key is not null and doc_id is not null"), known, ["set_key"], "members", total).select("doc_id", "n_shingles", "component_id")
    return inside.unionByName(rows.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
