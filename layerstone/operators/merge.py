"""Merging sorted runs, removing duplicates, numbering writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerstone.plans.ordered import neighbours, numbered


def merge(runs: list[DataFrame]) -> DataFrame:
    """All rows of the runs, whatever their order; one run is itself, none is an error of the caller."""
    if not runs:
        raise ValueError("merge needs at least one run; use an empty frame with the log's schema")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def dedup(log: DataFrame, priority: Column | None = None) -> DataFrame:
    """One row for each (key, seq): the one of lowest priority (run_id unless given). Aggregated by hash where value is a number."""
    priority = F.col("run_id") if priority is None else priority
    return log.groupBy("key", "seq").agg(F.min_by("op", priority).alias("op"), F.min_by("value", priority).alias("value"))


def allocate(writes: DataFrame, order: str, after: int = 0) -> DataFrame:
    """writes with dense seq numbers after the given one, in the order of a unique column."""
    return numbered(writes, order, "seq", after + 1)


def order_violations(rows: DataFrame, order: str, key: str) -> DataFrame:
    """violations: how often key does not ascend strictly in the order of another column."""
    before = neighbours(rows.select(order, key), order, "before", key)
    return before.agg(F.count(F.when(F.col("before") >= F.col(key), 1)).cast("bigint").alias("violations"))
