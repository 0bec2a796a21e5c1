"""Operators over a total order without a single-task sort.

Rows are written once in ranges of the order, which Spark's range partitioner draws; rows of one key
may be dealt over several ranges, so a key that a third of all rows share is no heavier than others.
Windows run inside a range, and what crosses ranges (the last key before, the first key after, the
count before) is one small row a range.

Null keys sort first. Among equal keys any order may come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerstone.storage import materialize

RANGE, SALT = "range_", "salt_"


def ranged(df: DataFrame, *order: str | Column, n: int | None = None) -> DataFrame:
    """df with a range number that ascends with the order, written; n ranges, or as many as the data need."""
    salted = df.withColumn(SALT, F.xxhash64(F.monotonically_increasing_id()))
    by = [*order, F.col(SALT)]
    dealt = salted.repartitionByRange(n, *by) if n else salted.repartitionByRange(*by)
    return materialize(dealt.withColumn(RANGE, F.spark_partition_id()).drop(SALT), "ranged")


def _nearest(value: Column, window, following: bool, *order: str) -> Column:
    """The nearest value before a row, or after it, that is not null.

    What comes after is what comes before in the descending order: a frame that ends at the last row
    is worked out anew for every row, one that begins at the first row grows with it.
    """
    by = [F.desc(c) if following else F.asc(c) for c in order]
    return F.last(value, ignorenulls=True).over(window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))


def _carry(df: DataFrame, value: Column, pick, following: bool) -> DataFrame:
    """range_of, carried: the picked value of the nearest range before (or after) that has one. A row a range."""
    own = df.groupBy(RANGE).agg(pick(value).alias("own"))
    near = _nearest(F.col("own"), Window, following, RANGE)
    return F.broadcast(own.select(F.col(RANGE).alias("range_of"), near.alias("carried")))


def neighbours(df: DataFrame, key: str, out: str, value: str | None = None, following: bool = False, n: int | None = None) -> DataFrame:
    """df with the value (key itself unless named) of the row before, or after, in key order; null where there is none."""
    value = value or key
    cut = ranged(df, key, n=n)
    order = Window.partitionBy(RANGE).orderBy(key)
    edge = (lambda c: F.min_by(c, F.col(key))) if following else (lambda c: F.max_by(c, F.col(key)))
    place, last = F.row_number().over(order), F.lead(F.lit(1)).over(order).isNull()
    inside = cut.withColumn(out, (F.lead if following else F.lag)(value).over(order)).withColumn("edge_", last if following else place == 1)
    joined = inside.join(_carry(cut, F.col(value), edge, following), F.col(RANGE) == F.col("range_of"), "left")
    # only the first (or last) row of a range has no neighbour inside it
    return joined.withColumn(out, F.when(F.col("edge_"), F.col("carried")).otherwise(F.col(out))).drop(RANGE, "edge_", "range_of", "carried")


def seek(probes: DataFrame, keys: DataFrame, how: str, n: int | None = None) -> DataFrame:
    """probe, found for every probe: the key of keys that how asks for ("le", "lt", "ge", "gt"), or null. A null probe finds nothing, a null key is never found.

    Probes and keys (one column each) are merged in order; no probe meets more than its range's rows.
    """
    following, with_equal = how in ("ge", "gt"), how in ("le", "ge")
    # equal keys stand on the side of the probe on which they count as found
    rank = 0 if with_equal != following else 2
    known = keys.select(F.col(keys.columns[0]).alias("at"), F.lit(rank).alias("rank")).filter("at is not null")
    asked = probes.select(F.col(probes.columns[0]).cast(known.schema["at"].dataType).alias("at"), F.lit(1).alias("rank"))
    merged = ranged(known.unionByName(asked), "at", "rank", n=n)
    key = F.when(F.col("rank") != 1, F.col("at"))
    inside = _nearest(key, Window.partitionBy(RANGE), following, "at", "rank")
    carried = _carry(merged, key, F.min if following else F.max, following)
    found = merged.withColumn("inside", inside).filter("rank = 1").join(carried, F.col(RANGE) == F.col("range_of"), "left")
    return found.select(F.col("at").alias("probe"), F.when(F.col("at").isNotNull(), F.coalesce("inside", "carried")).alias("found"))


def numbered(df: DataFrame, order: str | Column | list, out: str, start: int = 1, n: int | None = None) -> DataFrame:
    """df with dense numbers from start in an order (a column or several): counts a range, then offsets."""
    by = order if isinstance(order, list) else [order]
    cut = ranged(df, *by, n=n)
    counts = cut.groupBy(RANGE).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select(F.col(RANGE).alias("range_of"), before.alias("before")))  # a row a range
    place = F.row_number().over(Window.partitionBy(RANGE).orderBy(*by))
    return cut.withColumn(out, place).join(offsets, F.col(RANGE) == F.col("range_of")).withColumn(out, (F.col(out) + F.col("before") + start - 1).cast("bigint")).drop(RANGE, "range_of", "before")
