"""Statistics of runs and logs, and pruning by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_stats(log: DataFrame, width: int = 16, timestamp: Column | None = None) -> DataFrame:
    """run_id, min_key, max_key, min_seq, max_seq, n_rows, n_deletes, file_size (width bytes a row) of every run; min_ts and max_ts of a timestamp drawn from each row, if given."""
    times = [] if timestamp is None else [F.min(timestamp).alias("min_ts"), F.max(timestamp).alias("max_ts")]
    return log.groupBy("run_id").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
        F.count("*").alias("n_rows"), F.count(F.when(F.col("op") == 0, 1)).alias("n_deletes"), (F.count("*") * width).alias("file_size"), *times,
    )


def may_hold_key(manifest: DataFrame, key) -> DataFrame:
    """Files whose key range holds key."""
    return manifest.filter((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))


def may_hold_range(manifest: DataFrame, low, high) -> DataFrame:
    """Files that may hold a key in [low, high)."""
    return manifest.filter((F.col("max_key") >= F.lit(low)) & (F.col("min_key") < F.lit(high)))


def may_hold_since(manifest: DataFrame, seq: int) -> DataFrame:
    """Files with a write at or after seq."""
    return manifest.filter(F.col("max_seq") >= seq)


def replay_stats(log: DataFrame) -> DataFrame:
    """records, puts, deletes, max_seq: what a recovery reports."""
    return log.agg(F.count("*").alias("records"), F.count(F.when(F.col("op") == 1, 1)).alias("puts"), F.count(F.when(F.col("op") == 0, 1)).alias("deletes"), F.max("seq").alias("max_seq"))


def tombstones(log: DataFrame) -> DataFrame:
    """key, deletes of every key that was ever deleted."""
    return log.filter("op = 0").groupBy("key").agg(F.count("*").alias("deletes"))
