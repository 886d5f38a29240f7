"""Packing by concatenate and cut.

Pass one encodes each document and writes its ids with the number of its part (input partition) and its place there;
the token totals of the parts, one row each, are summed to the parts' global offsets. Pass two adds the two, so every
document knows where it starts in the concatenation of all, and cuts it at the fixed window edges. A piece that ends at
an edge inside its document is a boundary record (``continues``). Every sequence but the last is full; only that one
is padded. Nothing is shuffled but the totals.

Defined cases: a null or empty text has only the end id; rows that repeat a doc_id are packed as often; a null doc_id
is packed like any other; a text longer than a window spans several; an empty table gives no pieces; other columns are
ignored. Order of concatenation: by input partition and place in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_documents, stage
from tessera.llm.tokens import default_vocabulary, encoder

WINDOW = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continues boolean"


def encoded_parts(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Pass one: doc_id, part, place (ids before it in its part), n_tokens, ids (little-endian 32-bit bytes)."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = encoder(path, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                ids = [encode(t) for t in rows.column("text").to_pylist()]
                counts = np.array([len(i) for i in ids], np.int64)
                places = place + np.cumsum(counts) - counts
                place += int(counts.sum())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(places), pa.array(counts), pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "part", "place", "n_tokens", "ids"])

    return as_documents(docs).mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids binary")


def _cut(window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            data: list[bytes] = []
            for doc, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n_tokens", "ids")), strict=True):
                done = 0
                while done < n:
                    sequence, offset = divmod(at + done, window)
                    length = min(n - done, window - offset)
                    piece = ids[4 * done : 4 * (done + length)]
                    out.append((doc, done, length, crc32(piece), n, sequence, offset, done + length < n))
                    data.append(piece)
                    done += length
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            arrays = [pa.array(c, pa.bool_() if k == 7 else pa.int64()) for k, c in enumerate(columns)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in data], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of ``window`` ids; ``with_ids`` adds the ids themselves."""
    parts = stage(encoded_parts(docs, path, end_id), "encoded-parts")
    # As many rows as input partitions, whatever the number of documents.
    totals = parts.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    offsets = totals.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = parts.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("place")).alias("at"), "n_tokens", "ids")
    return placed.mapInArrow(_cut(window, with_ids), PIECES + (", ids array<long>" if with_ids else ""))
