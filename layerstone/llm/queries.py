"""The registered queries of the pipeline operators, thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from layerstone.llm import anisotropic, byte_bpe, cover_tree, html_text, language_id, mixing, pii, quality, simhash, token_count
from layerstone.llm.common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.session_key(spark), count="n_replaced")


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.search(read(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"))


def op8_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.search(read(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_html_text": op4_html_text,
    "op5_pii": op5_pii,
    "op6_cover_tree": op6_cover_tree,
    "op7_token_counts": op7_token_counts,
    "op8_anisotropic": op8_anisotropic,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_mixing": op10_mixing,
}

#: Hashes, models, tokenizers, page trees and keyed draws have no SQL; tests/llm compares those queries with plain Python.
ORACLE_SQL: dict[str, str] = {
    "op6_cover_tree": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, d.vec_id, d.r, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON d.r <> q.r AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS place FROM s) WHERE place <= 5""",
}
