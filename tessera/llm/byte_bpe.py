"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself a token, with one probe
and one comparison of bytes. Tier two, for the misses: the pre-token's bytes form a linked list, a heap holds the
adjacent pairs by rank, and the lowest rank merges first, in O(n log n) for a pre-token of n bytes. That gives the ids
the rank file defines, since a token that is in the vocabulary is what its own bytes merge to (the vocabulary's
exceptions are found when the table is built and left to tier two).

Defined cases: a null or empty text has no ids; a pre-token of any length works; an empty table gives an empty result;
other columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from tessera.llm.common import as_documents
from tessera.llm.tokens import MEMO_PIECES, MEMO_WORDS, Memo, as_bytes, parts

_SPACE_AFTER_SPACE = re.compile(r"\s ")

class PerfectHash:
    """Minimal perfect hash of fixed keys: n keys, n slots, one displacement for each bucket of about two keys."""

    def __init__(self, keys: list[bytes]):
        self.n, self.n_buckets = len(keys), max(1, len(keys) // 2)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for number, key in enumerate(keys):
            buckets[xxh3_64_intdigest(key) % self.n_buckets].append(number)
        self.shift = [0] * self.n_buckets
        self.key_at = [-1] * self.n
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            members = buckets[b]
            if len(members) < 2:
                break
            for seed in itertools.count(1):
                slots = [xxh3_64_intdigest(keys[m], seed) % self.n for m in members]
                if len(set(slots)) == len(slots) and all(self.key_at[s] < 0 for s in slots):
                    break
            self.shift[b] = seed
            for slot, m in zip(slots, members, strict=True):
                self.key_at[slot] = m
        # What is alone in its bucket takes a free slot, named directly by a negative displacement.
        free = (s for s in range(self.n) if self.key_at[s] < 0)
        for b, members in enumerate(buckets):
            if len(members) == 1:
                slot = next(free)
                self.shift[b], self.key_at[slot] = -1 - slot, members[0]

    def __call__(self, key: bytes) -> int:
        """The one key number the given key can have; the caller compares bytes."""
        shift = self.shift[xxh3_64_intdigest(key) % self.n_buckets]
        return self.key_at[-1 - shift if shift < 0 else xxh3_64_intdigest(key, shift) % self.n]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: pairs of a linked list of byte runs, merged in order of rank, then of place."""
    size = len(piece)
    after, before, end = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(size - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, right, stop = heapq.heappop(heap)
        if end[left] != right or right >= size or end[right] != stop:
            continue  # one of the two has merged since
        end[left], end[right] = stop, -1
        follow = after[left] = after[right]
        if follow < size:
            before[follow] = left
            if (r := ranks.get(piece[left : end[follow]])) is not None:
                heapq.heappush(heap, (r, left, follow, end[follow]))
        if (back := before[left]) >= 0 and (r := ranks.get(piece[back:stop])) is not None:
            heapq.heappush(heap, (r, back, left, stop))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[piece[at : end[at]]])
        at = after[at]
    return ids


class ByteBpe:
    """Encodes and decodes by a rank file; every id is the rank of its bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.keys, self.ids = list(self.ranks), list(self.ranks.values())
        self.table = PerfectHash(self.keys)
        self.bytes_of = dict(zip(self.ids, self.keys, strict=True))
        self.single = [as_bytes([i]) for i in self.ids]
        self.memo, self.merged = Memo(self.word, MEMO_WORDS), Memo(lambda piece: as_bytes(merge_bytes(piece, self.ranks)), MEMO_PIECES)

    def word(self, text: str) -> bytes:
        """The ids of each match of the pattern, one after another."""
        out = []
        for match in self.pattern.findall(text):
            piece = match.encode()
            number = self.table(piece)
            out.append(self.single[number] if self.keys[number] == piece else self.merged[piece])
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Where single spaces part the words, a match never crosses the place before a space, so words are encoded by
        themselves, with that space; a text with a space after white space, or at its end, is split by the pattern as a whole."""
        found = []
        for part in parts(text):
            if _SPACE_AFTER_SPACE.search(part) or part.endswith(" "):
                found.append(b"".join(map(self.memo.__getitem__, self.pattern.findall(part))))
            else:
                first, *rest = part.split(" ")
                found.append(b"".join(map(self.memo.__getitem__, [first, *map(" ".__add__, rest)] if first else map(" ".__add__, rest))))
        return np.frombuffer(b"".join(found), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and the decoded text of every document."""
    path, pattern = path or default_ranks()[0], pattern or default_ranks()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([bpe.decode(i).decode() for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return as_documents(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without shipping the ids."""
    path, pattern = path or default_ranks()[0], pattern or default_ranks()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            rows = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()) for ids in map(bpe.encode, batch.column("text").to_pylist())]
            n, of_ids, of_text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return as_documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
