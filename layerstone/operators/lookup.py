"""Reads of the versioned log: newest versions, snapshots, points, histories, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerstone.schema import PUT


def latest(log: DataFrame, *keep: str) -> DataFrame:
    """The newest version of every key, deletes included. Partial aggregation keeps one row a key and task before the shuffle.

    Each column is its own aggregate, so that numbers are aggregated by hash; strings and binary values
    have no place in a hash table's rows, and their tasks sort by key first.
    """
    columns = keep or ("op", "value")
    return log.groupBy("key").agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in columns])


def snapshot(log: DataFrame, at: int | None = None) -> DataFrame:
    """key, seq, value of every key that is there, as of write at (or now). A delete is final until a later put."""
    seen = log if at is None else log.filter(F.col("seq") <= at)
    return latest(seen).filter(F.col("op") == PUT).select("key", "seq", "value")


def point_get(log: DataFrame, key) -> DataFrame:
    """The newest value of one key, or no row. The filter reaches the parquet scan; for many keys use multi_get."""
    return snapshot(log.filter(F.col("key") == F.lit(key)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The newest values of the keys that are there; keys may repeat."""
    wanted = keys.select(F.col(keys.columns[0]).alias("key")).distinct()
    return snapshot(log.join(wanted, "key", "left_semi"))


def history(log: DataFrame, key) -> DataFrame:
    """All versions of a key, newest first by rank."""
    versions = log.filter(F.col("key") == F.lit(key)).select("key", "seq", "op", "value")
    return versions.orderBy(F.desc("seq"))


def version_rank(log: DataFrame) -> DataFrame:
    """key, seq, op, version (1 = newest of its key), is_newest."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))).cast("bigint")
    return log.select("key", "seq", "op", place.alias("version")).withColumn("is_newest", F.col("version") == 1)


def range_scan(log: DataFrame, low=None, high=None, at: int | None = None) -> DataFrame:
    """Live rows with low <= key < high; a missing bound is open. Both bounds reach the parquet scan."""
    if low is not None:
        log = log.filter(F.col("key") >= F.lit(low))
    if high is not None:
        log = log.filter(F.col("key") < F.lit(high))
    return snapshot(log, at)


def prefix_scan(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose string key begins with prefix."""
    return rows.filter(F.col(key).startswith(prefix))


def seek(rows: DataFrame, key: str, target, how: str) -> DataFrame:
    """The one row nearest target: "ge" first at or after, "gt" first after, "le" last at or before, "lt" last before; no row if there is none."""
    c, t = F.col(key), F.lit(target)
    test: Column = {"ge": c >= t, "gt": c > t, "le": c <= t, "lt": c < t}[how]
    return rows.filter(test).orderBy(c if how in ("ge", "gt") else c.desc()).limit(1)


def seek_live(log: DataFrame, target, how: str, tombstones: DataFrame | None = None) -> DataFrame:
    """The live key nearest target over all runs of a log, as seek(): versions and deletes are resolved first, range deletes too if given."""
    from layerstone.operators.range_delete import apply

    test = {"ge": F.col("key") >= F.lit(target), "gt": F.col("key") > F.lit(target), "le": F.col("key") <= F.lit(target), "lt": F.col("key") < F.lit(target)}[how]
    rows = log.filter(test)  # reaches the scan, and with it the statistics of files and row groups
    return seek(snapshot(rows if tombstones is None else apply(rows, tombstones)), "key", target, how)


def ordered_versions(log: DataFrame, out: str = "place") -> DataFrame:
    """Every version, deletes too, numbered by key ascending and seq descending over the whole log."""
    from layerstone.plans.ordered import numbered

    return numbered(log.select("key", "seq", "op", "value"), [F.col("key").asc(), F.col("seq").desc()], out)


def edge(rows: DataFrame, key: str, last: bool = False) -> DataFrame:
    """The first or last row in key order."""
    return rows.orderBy(F.col(key).desc() if last else F.col(key)).limit(1)
