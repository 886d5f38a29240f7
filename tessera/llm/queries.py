"""The contract queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import clustering, language, pii, prefix_trie, secrets, toxicity
from tessera.llm.ann import nearest
from tessera.llm.byte_bpe import digests
from tessera.llm.common import table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.ngram_join import near_components
from tessera.llm.packing import pack
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.token_store import store_facts


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_facts(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def op9_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_packing": op2_packing,
    "op3_repeats": op3_repeats,
    "op4_ngram_join": op4_ngram_join,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_collision_ann": op9_collision_ann,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_language_id": op12_language_id,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op10_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
    """,
    "op11_centroid_clusters": clustering.oracle(),
    "op13_prefix_trie": prefix_trie.ORACLE,
}
