"""A corpus pipeline over ``documents``: five stages, each on all that the one before it kept.

toxicity drops the documents that the network calls toxic; exact dedup keeps of equal texts the row with the largest
doc_id; the n-gram join keeps the smallest doc_id of each group of near copies (five words, similarity 0.8); secret
scans replace secrets in the texts; packing lays the rest out in sequences of 4096 ids.

Defined cases: a null text counts as empty and is kept unless a copy of it is; a null doc_id is no one's copy and is kept;
rows that repeat a doc_id are told apart by their text where one of them goes; extra columns travel along; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import secrets
from tessera.llm import toxicity as tox
from tessera.llm.common import drop, keep, scratch, stage, table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.ngram_join import near_components
from tessera.llm.packing import pack

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tox.keep_clean(docs, tox.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = exact_dedup(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), 256)
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (sha == gone["gone_sha"]), "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_components(docs, k=5, percent=80)
    gone = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("gone_id")).agg(F.min("component_id").alias("least"), F.max("component_id").alias("most")).where("least <> gone_id and most <> gone_id").select("gone_id")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: A trained network and iterated links have no SQL. tests/llm compares exact dedup and the n-gram join with brute force; of the
#: other stages it checks what they keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before = docs
        with scratch():  # what a stage staged on its way goes when its result is written, and so does the result before it
            docs = keep(stage(step(spark, before, sf_dir), name))
        if before is not documents:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
