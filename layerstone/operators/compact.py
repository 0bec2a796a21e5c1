"""Compaction: what to compact, and what a policy keeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerstone.operators.merge import dedup

#: Level 0 is compacted from so many files on; level n from 1 on when over BASE * 10 ** n bytes.
FILES, BASE = 4, 10 * 1024 * 1024

#: A policy tells of which versions to drop, from the columns key, seq, op and version (1 = newest of its key).
Policy = Callable[[], Column]


def keep_all() -> Column:
    return F.lit(False)


def keep_newest_or_since(horizon: int) -> Column:
    """Drops a version that is neither the newest of its key nor as recent as horizon; newest deletes stay."""
    return (F.col("version") > 1) & (F.col("seq") < horizon)


def compact(log: DataFrame, drop: Column) -> DataFrame:
    """The merged, de-duplicated versions of log less what drop tells; the visible rows stay the same if drop spares newest versions."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return dedup(log).withColumn("version", place).filter(~drop).select("key", "seq", "op", "value")


def level_sizes(manifest: DataFrame) -> DataFrame:
    """level, files, file_size."""
    return manifest.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").cast("bigint").alias("file_size"))


def pick(manifest: DataFrame, files: int = FILES, base: int = BASE) -> DataFrame:
    """level, file_num of the files to compact next: all of level 0 if it has enough, else the lowest-key file of the first level 1 to 5 that is over its size; else no rows."""
    sizes = level_sizes(manifest)
    due = sizes.filter((F.col("level") == 0) & (F.col("files") >= files) | F.col("level").between(1, 5) & (F.col("file_size") > F.lit(base) * F.pow(F.lit(10.0), F.col("level"))))
    level = due.agg(F.min("level").alias("due"))  # one row
    place = F.row_number().over(Window.partitionBy("level").orderBy(F.col("min_key").asc_nulls_first(), "file_num"))
    chosen = manifest.join(F.broadcast(level), F.col("level") == F.col("due")).withColumn("place", place)
    return chosen.filter((F.col("level") == 0) | (F.col("place") == 1)).select("level", "file_num")
