"""Each stage against a plain version on its own input."""

import pytest

from tests.llm.test_dedup import LOWER, components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def kept(spark, documents, sf_dir):
    out, docs = {}, documents
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), name)
        out[name] = docs
    return out


def test_schema(kept, documents):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name].schema.names == documents.schema.names


def test_exact_stage(kept):
    before, after = texts(kept["toxicity"]), texts(kept["exact_dedup"])
    last = {}
    for doc, text in before:
        key = (text or "").translate(LOWER)
        last[key] = max(last.get(key, doc), doc)
    assert {d for d, _ in after} == set(last.values())


def test_near_stage(kept):
    before, after = [(d, t or "") for d, t in texts(kept["exact_dedup"])], texts(kept["ngram_join"])
    assert {d for d, _ in after} == {d for d, _, c in components(before, 5, 80) if d == c}


def test_secret_stage_keeps_rows(kept):
    before, after = dict(texts(kept["ngram_join"])), dict(texts(kept["secret_scans"]))
    assert before.keys() == after.keys()
    assert all(after[d] == t or "[SECRET]" in after[d] for d, t in before.items())


def test_packing_stage(kept):
    pieces, docs = kept["packing"].collect(), texts(kept["secret_scans"])
    assert {r["doc_id"] for r in pieces} == {d for d, _ in docs}


def test_hard_rows(spark, hard, empty, sf_dir):
    for docs in (hard, empty):
        for name, step in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(step(spark, docs, sf_dir), name)
            if name == "exact_dedup" and docs.count():
                left = {r["doc_id"] for r in docs.collect()}
                assert 249 in left and 100 not in left and 7 not in left and 8 in left
