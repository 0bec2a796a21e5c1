"""The corpus pipeline: stages over documents, each calling one operator of layerstone.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents; the last returns the encoded documents. Extra columns are kept,
and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerstone.llm import byte_bpe, mixing, pii, quality, simhash
from layerstone.llm.common import materialize, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: null and empty texts, and what is too perplexing. Repeated rows go or stay together; null doc_ids are judged like others."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id, null last, and of equal ones the first row. Texts without words are one group."""
    return simhash.without_near_duplicates(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced in the texts, whose length column follows; null texts stay null, repeated rows change alike. The key is the session's."""
    changed = pii.pseudonymise(docs, pii.session_key(spark))
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken never, once or twice, as the mix has it. Null and empty texts have no words; a null source is one of its own; repeated rows are documents each."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to. A null text has none; rows stay as many as they are."""
    return byte_bpe.digests(docs, with_ids=True)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("personal_data", personal_data_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: No SQL: the model, fingerprints, keyed surrogates and token ids have no SQL form; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
