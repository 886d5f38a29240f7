"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's id stream into chunks. The store is a folder of Parquet files:

* ``chunks``: digest (SHA-256 of the bytes), ids (little-endian, of the stated width), each unique chunk once, and in how
  many places it is used;
* ``recipes``: in ascending doc_id order over its files: doc_id, place (ids before it in its part), n_tokens, the digests
  in order, and the root of the document's Merkle tree over them; ``file`` numbers the parts, each a range of doc_ids;
* ``manifest``: for each part its number of documents and tokens, the ids before it (``first``), and the root of the Merkle
  tree over its documents' roots.

A document starts at ``first`` of its part plus ``place``. ``write_store`` builds the store, ``read_store`` and
``read_facts`` read it back and verify: chunk bytes against their digests, digests against document roots, document roots
against the manifest. A mismatch raises.

Defined cases: a null or empty text has only the end id; rows with a null doc_id come first; rows that repeat a doc_id
stay rows of their own, next to each other, ordered by content; an empty table gives an empty store; other columns are
ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_documents, attach_group, drop, new_folder, stage
from tessera.llm.tokens import default_vocabulary, encoder

MIN_IDS, MAX_IDS, MASK_BITS = 64, 4096, 9
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
CHUNKS, RECIPES, MANIFEST = "digest binary, ids binary, uses long", "doc_id long, place long, n_tokens long, digests array<binary>, root binary, file int", "file int, documents long, tokens long, first long, root binary"
#: Digests a task remembers, to send the bytes of each of them once only.
SENT = 300_000


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: a hash of the last four ids hits the mask."""
    if len(ids) < 4:
        return np.zeros(0, np.int64)
    wide = ids.astype(np.uint64)
    rolled = sum((wide[k : len(ids) - 3 + k] + np.uint64(1)) * _MULTIPLIERS[k] for k in range(4))
    return np.flatnonzero((rolled * _MULTIPLIERS[0]) >> np.uint64(64 - MASK_BITS) == 0) + 4


def id_chunks(cuts: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the document at [start, end): the cut points within, MIN_IDS to MAX_IDS apart."""
    out, last = [], start
    for cut in [*cuts, end]:
        while cut - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        if cut - last >= MIN_IDS or cut == end > last:
            out.append(cut)
            last = cut
    return out


class MerkleTree:
    """Root of a binary SHA-256 tree over leaves that come one by one; only the full subtrees' roots are held.

    An odd node moves up as it is; leaves and nodes are told apart by a prefix.
    """

    def __init__(self):
        self.full: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        size, node = 1, hashlib.sha256(b"\0" + leaf).digest()
        while self.full and self.full[-1][0] == size:
            node = hashlib.sha256(b"\1" + self.full.pop()[1] + node).digest()
            size *= 2
        self.full.append((size, node))

    def root(self) -> bytes:
        if not self.full:
            return hashlib.sha256(b"").digest()
        node = self.full[-1][1]
        for _, left in self.full[-2::-1]:
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = MerkleTree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def _lists(values: list, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _tokenised(path: str, end_id: int, width: int):
    """doc_id, n_tokens, digests, root, and the bytes of the chunks that this task has not sent before (null where it has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sent = encoder(path, end_id), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [encode(t) for t in part.column("text").to_pylist()]
                totals = np.array([len(i) for i in ids], np.int64)
                ends = np.cumsum(totals)
                flat = np.concatenate(ids)
                if width == 2 and len(flat) and flat.max() > 0xFFFF:
                    raise ValueError("an id does not fit in 16 bits; write the store with width=4")
                data = memoryview(flat.astype(f"<u{width}").tobytes())
                cuts = cut_points(flat)
                low, high = np.searchsorted(cuts, ends - totals + 4).tolist(), np.searchsorted(cuts, ends).tolist()
                cuts = cuts.tolist()
                digests, pieces, counts, roots = [], [], [], []
                for a, b, x, y in zip((ends - totals).tolist(), ends.tolist(), low, high, strict=True):
                    own = id_chunks(cuts[x:y], a, b)
                    first, tree = len(digests), MerkleTree()
                    for end in own:
                        piece = data[a * width : end * width]
                        digest = hashlib.sha256(piece).digest()
                        tree.add(digest)
                        digests.append(digest)
                        if digest in sent:
                            pieces.append(None)
                        else:
                            pieces.append(piece)
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(digest)
                        a = end
                    counts.append(len(digests) - first)
                    roots.append(tree.root())
                counts = np.array(counts, np.int64)
                columns = [part.column("doc_id"), pa.array(totals), _lists(digests, counts, pa.binary()), _lists(pieces, counts, pa.binary()), pa.array(roots, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "digests", "pieces", "root"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the ids of a part: its rows come in order."""
    place = 0
    for batch in batches:
        counts = batch.column("n_tokens").to_numpy()
        places = place + np.cumsum(counts) - counts
        place += int(counts.sum())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(places), *(batch.column(c) for c in ("n_tokens", "digests", "root", "file"))], ["doc_id", "place", "n_tokens", "digests", "root", "file"])


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part present in these batches: the parts come one after another, in order."""
    part, documents, tokens, tree = None, 0, 0, MerkleTree()

    def row():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([documents], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tree.root()], pa.binary())], ["file", "documents", "tokens", "root"])

    for batch in batches:
        for file, n, root in zip(*(batch.column(c).to_pylist() for c in ("file", "n_tokens", "root")), strict=True):
            if file != part:
                if part is not None:
                    yield row()
                part, documents, tokens, tree = file, 0, 0, MerkleTree()
            documents, tokens = documents + 1, tokens + n
            tree.add(root)
    if part is not None:
        yield row()


def _manifest(recipes: DataFrame) -> DataFrame:
    """Sizes and root of each part, from 32 bytes and a count for each of its documents."""
    ordered = recipes.select("file", "place", "n_tokens", "root").repartition("file").sortWithinPartitions("file", "place", "n_tokens")
    parts = ordered.select("file", "n_tokens", "root").mapInArrow(_part_roots, "file int, documents long, tokens long, root binary")
    # As many rows as parts, whatever the number of documents.
    before = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("file", "documents", "tokens", F.coalesce(before, F.lit(0)).cast("long").alias("first"), "root")


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, width: int = 2, parts: int | None = None) -> None:
    """Encode every document and write chunks, recipes and manifest under ``folder``, on any file system Spark writes."""
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    encoded = stage(as_documents(docs).mapInArrow(_tokenised(path or default_vocabulary(), end_id, width), "doc_id long, n_tokens long, digests array<binary>, pieces array<binary>, root binary"), "token-ids")
    # Unique chunks once. Copies inside a task meet before the shuffle, so a hot chunk never gathers.
    chunks = encoded.select(F.inline(F.arrays_zip("digests", "pieces")))
    chunks.groupBy(F.col("digests").alias("digest")).agg(F.first("pieces", ignorenulls=True).alias("ids"), F.count("*").alias("uses")).write.option("compression", "zstd").parquet(f"{folder}/chunks")

    recipes = encoded.select("doc_id", "n_tokens", "digests", "root").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "root")
    ranged = recipes.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root").withColumn("file", F.spark_partition_id())
    ranged.mapInArrow(_places, RECIPES).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    drop(encoded)
    _manifest(spark.read.schema(RECIPES).parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def _verified_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = [], []
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if hashlib.sha256(data).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} does not match its digest")
                ids = np.frombuffer(data, f"<u{width}")
                sums.append(crc32(ids.astype("<u4").tobytes()))
                counts.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("uses"), pa.array(sums, pa.int64()), pa.array(counts, pa.int64())], ["digest", "uses", "crc32", "n_ids"])

    return run


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def _zero_operators() -> list[list[int]]:
    """Matrices over GF(2) that advance a CRC-32 by 1, 2, 4, ... zero bytes."""
    bit = [0xEDB88320, *(1 << k for k in range(31))]
    for _ in range(3):
        bit = [_times(bit, row) for row in bit]
    out = [bit]
    for _ in range(50):
        out.append([_times(out[-1], row) for row in out[-1]])
    return out


_ZEROS = _zero_operators()


@lru_cache(64)
def _zeros_table(k: int) -> tuple[list[int], ...]:
    """What each byte of a checksum becomes after 2^k zero bytes, by its place."""
    return tuple([_times(_ZEROS[k], byte << shift) for byte in range(256)] for shift in (0, 8, 16, 24))


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings one after the other, from the CRC-32 of each and the length of the second."""
    k = 0
    while second_bytes:
        if second_bytes & 1:
            a, b, c, d = _zeros_table(k)
            first = a[first & 255] ^ b[(first >> 8) & 255] ^ c[(first >> 16) & 255] ^ d[first >> 24]
        second_bytes >>= 1
        k += 1
    return first ^ second


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums, counts = [], []
        for found, root, n_tokens in zip(*(batch.column(c).to_pylist() for c in ("found", "root", "n_tokens")), strict=True):
            if len(found) > 1:
                found.sort(key=itemgetter("pos"))
            total = crc = 0
            for piece in found:
                if piece["crc32"] is None and piece["digest"] is not None:
                    raise ValueError(f"chunk {piece['digest'].hex()} of a document's recipe is missing")
                if piece["digest"] is not None:
                    crc = crc32_join(crc, piece["crc32"], 4 * piece["n_ids"]) if total else piece["crc32"]
                    total += piece["n_ids"]
            if total != n_tokens or merkle_root([p["digest"] for p in found if p["digest"] is not None]) != root:
                raise ValueError("a document's recipe does not match its Merkle root or its length")
            sums.append(crc)
            counts.append(total)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def verify_manifest(spark: SparkSession, folder: str) -> None:
    """Compare the recipes' Merkle roots with the manifest, part by part."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    now = _manifest(spark.read.schema(RECIPES).parquet(f"{folder}/recipes"))
    both = manifest.join(now.select(F.col("file").alias("now"), *(F.col(c).alias(f"now_{c}") for c in ("documents", "tokens", "first", "root"))), F.col("file") == F.col("now"), "full")
    if not both.where(" or ".join(f"not ({c} <=> now_{c})" for c in ("documents", "tokens", "first", "root"))).isEmpty():
        raise ValueError("the manifest does not match the recipes")


def _gathered(spark: SparkSession, folder: str, chunks: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, start, n_tokens, root and the recipe of every document, with ``fields`` of its chunks.

    A chunk that very many documents hold is broadcast (``attach_group``); the others are joined by a shuffle.
    """
    recipes, manifest = spark.read.schema(RECIPES).parquet(f"{folder}/recipes"), spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    started = recipes.join(F.broadcast(manifest.select("file", "first")), "file").withColumn("start", F.col("first") + F.col("place"))
    placed = started.select("file", "place", "doc_id", "start", "n_tokens", "root", F.posexplode_outer("digests").alias("pos", "digest"))
    uses = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks").agg(F.sum("uses")).first()[0] or 0
    joined = attach_group(placed, chunks, ["digest"], "uses", uses)
    piece = F.struct("pos", "digest", *fields)
    # A document's key is where it lies; the root tells rows of no ids apart.
    return joined.groupBy("file", "place", "doc_id", "start", "n_tokens", "root").agg(F.collect_list(piece).alias("found"))


def read_facts(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Each unique chunk is read, verified and summed where it lies; only its checksum and count travel to the documents,
    and the checksums of a document's chunks combine in order to that of all its ids.
    """
    verify_manifest(spark, folder)
    chunks = stage(spark.read.schema(CHUNKS).parquet(f"{folder}/chunks").mapInArrow(_verified_chunks(width), "digest binary, uses long, crc32 long, n_ids long"), "verified-chunks")
    found = _gathered(spark, folder, chunks, ["crc32", "n_ids"])
    return found.select("doc_id", "start", "n_tokens", "root", "found").mapInArrow(_facts, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_store(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """doc_id, start, ids (array<long>) of every document, reconstructed from its chunks."""
    verify_manifest(spark, folder)
    found = _gathered(spark, folder, spark.read.schema(CHUNKS).parquet(f"{folder}/chunks"), ["ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces, root in zip(batch.column("found").to_pylist(), batch.column("root").to_pylist(), strict=True):
                pieces = sorted((p for p in pieces if p["digest"] is not None), key=lambda x: x["pos"])
                if any(hashlib.sha256(p["ids"] or b"").digest() != p["digest"] for p in pieces) or merkle_root([p["digest"] for p in pieces]) != root:
                    raise ValueError("a document's chunks do not match its Merkle root")
                out.append(np.frombuffer(b"".join(p["ids"] for p in pieces), f"<u{width}").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return found.select("doc_id", "start", "found", "root").mapInArrow(run, "doc_id long, start long, ids array<long>")


def store_facts(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write a store of ``docs`` in the shared folder and return what its files say of each document."""
    folder = new_folder(docs.sparkSession, "token-store")
    write_store(docs, folder, path, end_id)
    return read_facts(docs.sparkSession, folder)
