"""Range deletes: [start, end) hides every older version of the keys within.

Overlapping tombstones are first cut into elementary segments, each with the newest seq over it, so
a row meets at most one segment. Few tombstones (their number is checked) are broadcast; more are cut
by a segment tree in equality joins, and keys find their segment by the ordered merge. Only segments
are ever broadcast, never the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerstone.plans.ordered import neighbours, numbered, seek
from layerstone.storage import materialize

#: Tombstones, or segments, that are broadcast at most: each row is compared with all of them.
BROADCAST = 32


def segments(tombstones: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """start, end, seq: disjoint segments with the newest seq of the tombstones over each; empty ranges are ignored."""
    real = tombstones.filter(F.col("start") < F.col("end")).select("start", "end", "seq")
    real = materialize(real, "tombstones")
    bounds = real.select(F.col("start").alias("at")).unionByName(real.select(F.col("end").alias("at"))).distinct()
    if real.count() > broadcast:
        return _by_tree(real, materialize(bounds, "bounds"))
    pieces = bounds.withColumn("until", F.lead("at").over(Window.orderBy("at"))).filter("until is not null")  # twice the checked number
    over = pieces.join(F.broadcast(real), (F.col("start") <= F.col("at")) & (F.col("end") >= F.col("until")))
    return over.groupBy(F.col("at").alias("s"), F.col("until").alias("e")).agg(F.max("seq").alias("newest")).select(F.col("s").alias("start"), F.col("e").alias("end"), F.col("newest").alias("seq"))


def _nodes(low: Column, high: Column, levels: int) -> Column:
    """The nodes (level, place) of a binary tree over pieces that make up the pieces low to high - 1: two a level at most."""
    node = lambda level, place: F.array(F.struct(level.alias("level"), place.alias("place")))
    none = F.array().cast("array<struct<level:int,place:bigint>>")

    def step(s: Column, level: Column) -> Column:
        open_, odd_low, odd_high = s["low"] < s["high"], s["low"] % 2 == 1, s["high"] % 2 == 1
        left = F.when(open_ & odd_low, node(level, s["low"])).otherwise(none)
        right = F.when(open_ & odd_high & (s["high"] - 1 >= s["low"] + odd_low.cast("bigint")), node(level, s["high"] - 1)).otherwise(none)
        up = lambda x: F.shiftright(x, 1)
        return F.struct(up(s["low"] + odd_low.cast("bigint")).alias("low"), up(s["high"] - odd_high.cast("bigint")).alias("high"), F.concat(s["nodes"], left, right).alias("nodes"))

    start = F.struct(low.alias("low"), high.alias("high"), none.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda s: s["nodes"])


def _by_tree(real: DataFrame, bounds: DataFrame) -> DataFrame:
    """segments() for any number of tombstones: each goes to its few tree nodes, each piece asks its node of every level."""
    levels = max(1, bounds.count().bit_length())
    placed = materialize(numbered(bounds, "at", "place", start=0), "places")
    low, high = (placed.select(F.col("at").alias(c), F.col("place").alias(f"{c}_place")) for c in ("start", "end"))
    covered = real.join(low, "start").join(high, "end").select("seq", F.explode(_nodes(F.col("start_place"), F.col("end_place"), levels)).alias("n"))
    newest = covered.groupBy(F.col("n.level").alias("level"), F.col("n.place").alias("node")).agg(F.max("seq").alias("seq"))
    pieces = neighbours(placed, "at", "until", following=True).filter("until is not null")
    asked = pieces.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", F.expr("shiftright(place, level)"))
    found = asked.join(newest, ["level", "node"]).groupBy("at", "until").agg(F.max("seq").alias("seq"))
    return found.select(F.col("at").alias("start"), F.col("until").alias("end"), "seq")


def _cut(tombstones: DataFrame, broadcast: int) -> tuple[DataFrame, bool]:
    """Segments as t_start, t_end, t_seq, and whether they are few enough to be broadcast."""
    cut = materialize(segments(tombstones, broadcast).select(F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("seq").alias("t_seq")), "segments")
    return cut, cut.count() <= broadcast


def _covered(keys: DataFrame, cut: DataFrame) -> DataFrame:
    """key_of, t_start, t_seq of the distinct keys that a segment covers, by the ordered merge."""
    starts = seek(keys.select(F.col("key").alias("probe")).distinct(), cut.select(F.col("t_start").alias("key")), "le")
    return starts.join(cut, starts["found"] == cut["t_start"]).filter(F.col("probe") < F.col("t_end")).select(F.col("probe").alias("key_of"), "t_start", "t_seq")


def apply(log: DataFrame, tombstones: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of log that no tombstone hides."""
    cut, few = _cut(tombstones, broadcast)
    if few:
        hidden = (F.col("key") >= F.col("t_start")) & (F.col("key") < F.col("t_end")) & (F.col("t_seq") > F.col("seq"))
        return log.join(F.broadcast(cut), hidden, "left_anti")
    covered = _covered(log, cut)
    return log.join(covered, (F.col("key") == F.col("key_of")) & (F.col("t_seq") > F.col("seq")), "left_anti")


def coverage(log: DataFrame, tombstones: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """start, end, seq and how many versions and keys each segment hides. Versions are added up by key before they are shuffled."""
    cut, few = _cut(tombstones, broadcast)
    rows = log.select("key", F.col("seq").alias("row_seq"))
    if few:
        hidden = rows.join(F.broadcast(cut), (F.col("key") >= F.col("t_start")) & (F.col("key") < F.col("t_end")) & (F.col("row_seq") < F.col("t_seq")))
    else:
        hidden = rows.join(_covered(log, cut), (F.col("key") == F.col("key_of")) & (F.col("row_seq") < F.col("t_seq")))
    by_key = hidden.groupBy("t_start", "key").agg(F.count("*").alias("n"))
    counts = by_key.groupBy(F.col("t_start").alias("counted")).agg(F.sum("n").alias("versions"), F.count("*").alias("keys"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return cut.join(counts, F.col("t_start") == F.col("counted"), "left").select(F.col("t_start").alias("start"), F.col("t_end").alias("end"), F.col("t_seq").alias("seq"), zero("versions"), zero("keys"))
