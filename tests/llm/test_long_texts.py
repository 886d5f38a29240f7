"""Texts of several megabytes, texts cut in parts, and recall with shipped settings on a larger table."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_models import brute
from tests.llm.test_spans import plain_pii, plain_secrets
from tessera.llm import byte_bpe, pii, secrets, tokens
from tessera.llm.ann import nearest

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    words = ["plain", "words", "é", "x@y.zz", "10.20.30.40", "+49 30 1234567", "token=abcdef99", "0123456789abcdef" * 2, "4111 1111 1111 1111", "AKIA" + "A1" * 9, "\n", "Straße"]
    return " ".join(rng.choice(words) for _ in range(120_000))


def test_spans_of_a_long_text(spark, long_text):
    assert len(long_text) > 1_000_000
    docs = spark.createDataFrame([(1, long_text), (2, "short")], "doc_id long, text string")
    for scan, plain, kinds in ((pii.scan, plain_pii, pii.BASE), (secrets.scan, plain_secrets, secrets.KINDS[:3])):
        got = {r["doc_id"]: r for r in scan(docs).collect()}[1]
        order = {k: n for n, k in enumerate(kinds)}
        found = sorted((a, order[kind], b) for a, _, b, kind in plain(long_text))
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)
        assert got["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_byte_bpe_of_a_long_text(spark, long_text):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    ids = np.array(tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(long_text), "<u4")
    got = byte_bpe.digests(spark.createDataFrame([(1, long_text)], "doc_id long, text string")).first()
    assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(long_text.encode()).hexdigest())


def test_an_encoder_that_cuts_texts_gives_the_library_s_ids(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokens.LibraryEncoder(path)
    monkeypatch.setattr(tokens, "PART_CHARS", 40)
    rng = random.Random(4)
    bits = ["word", "It's", "42", "é", " ", "  ", "\n", "\t", "...", "<|endoftext|>", "STRASSE", "ß", "\U0001f600", "a-b", " ", "x" * 60]
    for _ in range(1500):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 60)))
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_recall_with_shipped_settings(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    rows = np.array([r["embedding"] for r in vectors.orderBy("vec_id").collect()], np.float64)
    ids = np.array([r["vec_id"] for r in vectors.orderBy("vec_id").select("vec_id").collect()])
    got = {}
    for r in nearest(vectors).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in got:
        scores = rows @ rows[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert len(got) == (ids % 20 == 0).sum()
    assert hits / (20 * len(got)) >= 0.9


def test_recall_where_few_vectors_are_verified(spark, sf_dir):
    """With a tenth of the shipped least, most of a small table stays unverified, so that recall is that of the counting."""
    vectors = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/embeddings.parquet")
    wanted = brute([(r["vec_id"], r["embedding"]) for r in vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).collect()])
    got = {}
    for r in nearest(vectors, least=150).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = sum(len(got[q] & {i for i, _ in wanted[q]}) for q in wanted)
    assert found >= 0.8 * 20 * len(wanted)
