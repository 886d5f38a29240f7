"""Token store, packing and byte BPE against the libraries themselves."""

import base64
import hashlib
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tessera.llm import byte_bpe, token_store
from tessera.llm.common import new_folder
from tessera.llm.packing import pack

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [(doc, np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")) for doc, text in rows]


def test_store(spark, docs, ids):
    folder = new_folder(spark, "test-store")
    token_store.write_store(docs, folder)
    facts = token_store.read_facts(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in facts) == Counter((d, len(i), crc32(i.tobytes())) for d, i in ids)
    at = 0
    for r in sorted(facts, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(facts, key=lambda r: r["start"])]
    assert order == sorted(order)
    back = token_store.read_store(spark, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in back) == Counter((d, tuple(i.tolist())) for d, i in ids)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_detects_damage(spark, hard):
    folder, other = new_folder(spark, "test-store"), new_folder(spark, "test-store")
    token_store.write_store(hard.where("doc_id < 30"), folder)
    spark.read.parquet(f"{folder}/recipes").withColumn("root", token_store.F.lit(b"x")).write.parquet(f"{other}/recipes")
    for name in ("chunks", "manifest"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(f"{other}/{name}")
    with pytest.raises(Exception, match="manifest"):
        token_store.verify_manifest(spark, other)


def test_crc32_join():
    a, b = b"some bytes", b"and some more, of another length"
    assert token_store.crc32_join(crc32(a), crc32(b), len(b)) == crc32(a + b)


def test_pack(docs, ids):
    pieces = pack(docs).collect()
    wanted = Counter((d, len(i), crc32(i.tobytes())) for d, i in ids)
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for number, found in sequences.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == 4096 or number == max(sequences)
    assert sum(r["length"] for r in pieces) == sum(len(i) for _, i in ids)
    by_text = defaultdict(list)
    for d, i in ids:
        by_text[d, len(i)].append(i)
    for r in pieces:
        assert any(crc32(i[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for i in by_text[r["doc_id"], r["doc_tokens"]])
    starts = Counter((r["doc_id"], r["doc_tokens"], r["start"]) for r in pieces)
    assert sum(n for (_, _, start), n in starts.items() if start == 0) == sum(wanted.values())


def test_pack_with_ids(hard, ids):
    pieces = pack(hard, window=100, with_ids=True).collect()
    assert all(crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in pieces)


def test_byte_bpe(docs, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digest(x):
        return hashlib.sha256(x).hexdigest()

    wanted = Counter()
    for doc, text in rows:
        ids = np.array(library.encode_ordinary(text), "<u4")
        wanted[doc, len(ids), digest(ids.tobytes()), digest(text.encode())] += 1
    assert Counter(map(tuple, byte_bpe.digests(docs).collect())) == wanted
    assert Counter((r["doc_id"], r["decoded"]) for r in byte_bpe.encode(docs).collect()) == Counter(rows)


@pytest.mark.parametrize("text", ["a \n \nb", "\n b", "x  \n y", " lead", "trail ", "it's 'tis", "\t \t x", "1234 567", "a   b", "a 　b", "\r\n \r\n", "\x85 \xa0 \xa0"])
def test_byte_bpe_white_space(text):
    import tiktoken

    codec = byte_bpe.codec(*byte_bpe.default_ranks())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_perfect_hash_is_minimal():
    keys = [f"key{k}".encode() for k in range(3000)]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.key_at) == list(range(3000)) and all(keys[table(k)] == k for k in keys)


def test_empty(empty):
    assert token_store.store_facts(empty).count() == pack(empty).count() == byte_bpe.digests(empty).count() == 0


def test_every_code_point():
    """Each code point inside, before and after words, against the library; blocks that differ nowhere are compared at once."""
    from tessera.llm.tokens import LibraryEncoder

    encode = LibraryEncoder(P.path("word_bpe_49k.json"))
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 256):
        text = " ".join(f"a{c}b {c}1 {c}" for c in every[at : at + 256])
        assert encode(text).tolist() == encode.library.encode(text, add_special_tokens=False).ids
