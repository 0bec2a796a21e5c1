"""The parquet tables, and the versioned logs that the registered queries derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_log(rows: DataFrame, key: Column, seq: Column, deleted: Column, value: Column) -> DataFrame:
    """key, seq, op, value: a delete has no value."""
    op = F.when(deleted, 0).otherwise(1).cast("tinyint")
    return rows.select(key.alias("key"), seq.cast("bigint").alias("seq"), op.alias("op"), F.when(~deleted, value).alias("value"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return as_log(e, F.col("user_id"), F.col("event_id") + 1, F.col("event_type") == "error", F.col("value"))


def event_runs(spark: SparkSession, sf_dir: str, rows: int = 500) -> DataFrame:
    """event_log in runs of rows writes each."""
    return event_log(spark, sf_dir).withColumn("run_id", F.expr(f"(seq - 1) div {rows}"))


def overlapping_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_runs and a second copy of every third write under other runs."""
    runs = event_runs(spark, sf_dir)
    return runs.unionByName(runs.filter("seq % 3 = 0").withColumn("run_id", F.col("run_id") + 1000))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return as_log(o, F.col("o_custkey"), F.col("o_orderkey") + 1, F.col("o_orderstatus") == "F", F.col("o_totalprice"))


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return as_log(d, F.col("source"), F.col("doc_id") + 1, F.col("lang") == "fr", F.col("n_chars"))


def range_deletes(spark: SparkSession) -> DataFrame:
    """Three overlapping range deletes on the event log's keys."""
    return spark.createDataFrame([(10, 20, 9950), (15, 40, 9900), (149, 200, 9999999)], "start long, end long, seq long")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """machine, registered_ns, type, data and the tie-breaking event_id of state machine updates."""
    e = table(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select(F.col("user_id").alias("machine"), ns.alias("registered_ns"), (F.col("event_id") % 13).cast("int").alias("type"), F.encode("props", "utf-8").alias("data"), "event_id")
