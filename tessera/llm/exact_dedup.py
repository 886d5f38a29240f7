"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a hash of its last eight bytes hits a mask, so equal texts have equal cuts. A chunk gets a cheap
fingerprint (64-bit hash and length) and a verifying digest (SHA-256). Documents whose ordered fingerprint list occurs
once are unique at once; for the others the chunks are deduplicated to verified identifiers (fingerprint and a variant
number that tells apart digests that share a fingerprint) and the ordered identifier lists are compared. Texts are read
once, where they lie, and never shuffled.

Defined cases: null text counts as empty, and all empty texts are equal; a null doc_id takes part but stays only if its
whole group has none; rows that repeat a doc_id are rows of their own and share the verdict; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_documents, attach_group, stage

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 512, 16_384, 11
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLAB = 1 << 22

RECIPE = "doc_id long, signature binary, n_chunks int, fingerprints array<long>, lengths array<int>, digests array<binary>, text_sha256 string"


def _windows(data: bytes) -> np.ndarray:
    """The eight bytes from each position as a 64-bit number."""
    out = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        part = np.frombuffer(data, "<u8", count=(len(data) - k) // 8, offset=k)
        out[k::8] = part
    return out


def chunk_ends(data: bytes) -> list[int]:
    """Content-defined cut positions, ending with ``len(data)``; empty data is one empty chunk."""
    size = len(data)
    ends, last = [], 0
    if size > MIN_CHUNK:
        for at in range(0, size - 7, _SLAB):
            piece = data[at : at + _SLAB + 7]
            if len(piece) < 8:
                break
            marks = np.flatnonzero((_windows(piece) * _MULTIPLIER) >> np.uint64(64 - MASK_BITS) == 0) + (at + 8)
            for cut in marks.tolist():
                while cut - last > MAX_CHUNK:
                    last += MAX_CHUNK
                    ends.append(last)
                if cut - last >= MIN_CHUNK and cut < size:
                    ends.append(cut)
                    last = cut
    while size - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    ends.append(size)
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("signature", pa.binary()), ("n_chunks", pa.int32()), ("fingerprints", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary())), ("text_sha256", pa.string())])
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column("text"):
            data = text.as_buffer().to_pybytes().lower()  # bytes.lower changes A-Z only
            fingerprints, lengths, digests, last = [], [], [], 0
            for end in chunk_ends(data):
                chunk = data[last:end]
                fingerprints.append(xxhash.xxh3_64_intdigest(chunk) - (1 << 63))
                lengths.append(len(chunk))
                digests.append(hashlib.sha256(chunk).digest())
                last = end
            whole = digests[0].hex() if len(digests) == 1 else hashlib.sha256(data).hexdigest()
            signature = xxhash.xxh3_128_digest(np.array([fingerprints, lengths], "<i8").tobytes())
            rows.append((signature, len(lengths), fingerprints, lengths, digests, whole))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its ordered chunk fingerprints, lengths and digests, and the whole text's SHA-256."""
    return as_documents(docs, id_col, text_col).mapInArrow(_recipes, RECIPE)


def chunk_variants(recipes: DataFrame) -> DataFrame:
    """Chunks whose fingerprint is shared by several digests, numbered: fingerprint, length, digest, variant (from 1)."""
    chunks = recipes.select(F.explode(F.arrays_zip("fingerprints", "lengths", "digests")).alias("c")).select(F.col("c.fingerprints").alias("fingerprint"), F.col("c.lengths").alias("length"), F.col("c.digests").alias("digest"))
    distinct = chunks.groupBy("fingerprint", "length", "digest").agg(F.lit(1).alias("one"))
    rank = F.row_number().over(Window.partitionBy("fingerprint", "length").orderBy("digest"))
    return distinct.withColumn("variant", rank - 1).where("variant > 0").drop("one")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document; of equal texts the largest id stays."""
    recipes = stage(chunk_recipes(docs, id_col, text_col), "recipes")
    total = recipes.count()
    repeated = recipes.groupBy("signature").agg(F.count("*").alias("copies")).where("copies > 1")
    marked = attach_group(recipes, repeated, ["signature"], "copies", total)
    alone = marked.where("copies is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    shared = stage(marked.where("copies is not null").select("doc_id", "signature", "n_chunks", "fingerprints", "lengths", "digests", "text_sha256"), "shared-recipes")
    variants = chunk_variants(shared)
    if variants.isEmpty():
        identified = shared.withColumn("variants", F.lit(None).cast("array<struct<ordinal:int,variant:int>>"))
    else:
        # Fingerprints that collided: name the verified variant at each place of the recipe that has one.
        placed = shared.select("signature", F.posexplode(F.arrays_zip("fingerprints", "lengths", "digests")).alias("ordinal", "c")).select("signature", "ordinal", F.col("c.fingerprints").alias("fingerprint"), F.col("c.lengths").alias("length"), F.col("c.digests").alias("digest")).distinct()
        named = placed.join(variants, ["fingerprint", "length", "digest"]).groupBy("signature", "ordinal", "digest").agg(F.max("variant").alias("variant"))
        rows = shared.select("*", F.monotonically_increasing_id().alias("row"))
        found = rows.select("row", "signature", F.posexplode("digests").alias("ordinal", "digest")).join(named, ["signature", "ordinal", "digest"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("ordinal", "variant"))).alias("variants"))
        identified = stage(rows.join(found, "row", "left").drop("row"), "identified")
    # The identifier of the chunk at each place is its fingerprint, length and variant; the signature stands for the
    # fingerprints and lengths only as a shuffle key, the lists themselves are compared.
    key = ["signature", "fingerprints", "lengths", "variants"]
    identified = identified.withColumn("variants", F.coalesce("variants", F.array().cast("array<struct<ordinal:int,variant:int>>")))
    groups = identified.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = attach_group(identified, groups, key, "group_size", total)
    return alone.unionByName(joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
