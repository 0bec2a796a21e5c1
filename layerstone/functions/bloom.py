"""Bloom filters as rows: one row a set bit, so building is an aggregation and probing a join.

For pruning files, Parquet's own bloom filters serve (see writer_options). This form is for asking
which of many keys may be in which of many runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probes(bits_per_key: int) -> int:
    return min(30, max(1, int(bits_per_key * math.log(2))))


def places(key: Column, bits: Column | int, bits_per_key: int) -> Column:
    """The bits of a key, one hash each."""
    n = bits if isinstance(bits, Column) else F.lit(bits)
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), n) for i in range(probes(bits_per_key))])


def build(log: DataFrame, bits_per_key: int = 10) -> tuple[DataFrame, int]:
    """(run_id, bit) rows, and the bits of each run's filter (that of the largest run)."""
    most = log.groupBy("run_id").agg(F.count_distinct("key").alias("n")).agg(F.max("n")).first()[0] or 0
    bits = max(64, most * bits_per_key)
    return log.select("run_id", F.explode(places(F.col("key"), bits, bits_per_key)).alias("bit")).distinct(), bits


def may_contain(filters: DataFrame, bits: int, keys: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """key, run_id of every run that may hold the key: all its bits are set. Never misses."""
    asked = keys.select(F.col(keys.columns[0]).alias("key")).distinct().select("key", F.explode(F.array_distinct(places(F.col("key"), bits, bits_per_key))).alias("bit"), F.size(F.array_distinct(places(F.col("key"), bits, bits_per_key))).alias("n"))
    hits = asked.join(filters, "bit").groupBy("key", "run_id").agg(F.count("*").alias("hits"), F.first("n").alias("n"))
    return hits.filter("hits = n").select("key", "run_id")


def writer_options(column: str, expected: int) -> dict[str, str]:
    """Options for df.write.options(...).parquet: a bloom filter on column in every file."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.expected.ndv#{column}": str(expected)}
