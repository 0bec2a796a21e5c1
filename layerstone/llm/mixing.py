"""Mixing sources to target weights by subset-sum budget fitting (operator 10).

Documents are counted by source and exact length in words. A source whose target is at least its
size takes every document once and fits what is left; any other fits its whole target. Fitting is on
length counts only: a proportional share of each length, further documents by largest remainder
until no more than REST words (or the longest document's) remain, and a bounded-knapsack dynamic
programme for that budget. Then that many documents of each
length are selected in a seeded order, so reruns agree.

The counts of a source are one row a length, never its documents. Within a source and length the
selection deals documents to hash buckets of about BUCKET rows, takes whole buckets by their running
count and orders rows only inside a bucket, so a length that a third of all rows share stays spread.

Defined results: null and empty texts have size 0 and take 0 words; a null source is a source of its
own, the last; documents equal in source, size and hash are told apart by doc_id and rows equal in
all of these are interchangeable; an empty table gives no rows; where all sizes are 0 all targets are
0; extra columns are ignored by mix() and kept by mixed_documents().
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerstone.llm.common import fresh, materialize, word_count

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 17
#: Documents to a bucket, about.
BUCKET = 128
#: Words that the dynamic programme fits, or the longest document's if that has more; it holds four bytes a word.
REST = 1 << 20


def best_sum(items: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each (length, count) to take so that the sum is nearest budget; the smaller sum on a tie.

    Sums are the bits of an integer; counts are split into powers of two, so that each step is one shift.
    Each sum remembers the step that first reached it, which is enough to walk back: memory is four
    bytes a sum, however many steps there are.
    """
    if budget <= 0 or not items:
        return {}
    limit = budget + min(length for length, _ in items)
    mask, sums = (1 << (limit + 1)) - 1, 1
    reached_by = np.full(limit + 1, -1, np.int32)
    steps: list[tuple[int, int]] = []  # length, copies
    for length, count in items:
        left, power = min(count, limit // length), 1
        while left > 0 and not sums >> budget & 1:
            copies = min(power, left)
            new = (sums << (length * copies)) & mask & ~sums
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")
                reached_by[np.flatnonzero(bits)] = len(steps)
                sums |= new
            steps.append((length, copies))
            left -= copies
            power *= 2
    below = (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = sums >> (budget + 1)
    best = below
    if above and (up := budget + (above & -above).bit_length()) - budget < budget - below:
        best = up
    taken: dict[int, int] = {}
    while best:
        length, copies = steps[reached_by[best]]
        taken[length] = taken.get(length, 0) + copies
        best -= length * copies
    return taken


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their lengths sum to about budget.

    Each length gets its proportional share, rounded down; further documents, by largest remainder and
    then the longest first, until what is left is no more than REST words or the longest document; the
    programme fits that rest.
    """
    total = sum(x * c for x, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0 or not total:
        return [0] * len(lengths)
    rest = max(REST, max(x for x, c in zip(lengths, counts) if c))
    take = [budget * c // total if x else 0 for x, c in zip(lengths, counts)]
    left = budget - sum(t * x for t, x in zip(take, lengths))
    by_remainder = sorted((i for i, x in enumerate(lengths) if x), key=lambda i: (-(budget * counts[i] % total), lengths[i]))
    for i in by_remainder:
        if left > rest and take[i] < counts[i]:
            take[i] += 1
            left -= lengths[i]
    for i in sorted(by_remainder, key=lambda i: -lengths[i]):
        if left > rest:
            more = min(counts[i] - take[i], -(-(left - rest) // lengths[i]))
            take[i] += more
            left -= more * lengths[i]
    spare = [(lengths[i], counts[i] - take[i]) for i in by_remainder if take[i] < counts[i] and lengths[i] <= 2 * left]
    at = {lengths[i]: i for i in by_remainder}
    for length, n in best_sum(spare, left).items():
        take[at[length]] += n
    return take


def _source_key(source: Column) -> Column:
    """A non-null key in code point order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, source_size, target from key, source_size (a row a source).

    Targets are min(most * size, level * weight) for the level at which they sum to the share: the
    fixed point of handing the excess of capped sources to the others by weight.
    """
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1))
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "key")
    everything = Window.partitionBy()
    before = capped.withColumns({
        "caps": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "free": F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(everything) * F.lit(share),
    })
    reached = F.col("caps") + F.col("cap") / F.col("w") * F.col("free") >= F.col("all")
    level = before.withColumn("level", F.min(F.when(reached, F.struct(F.col("cap") / F.col("w"), F.col("key"), ((F.col("all") - F.col("caps")) / F.col("free")).alias("level")))).over(everything)["level"])
    return level.select("key", "source_size", F.least("cap", F.coalesce(F.col("level"), F.col("cap") / F.col("w")) * F.col("w")).alias("target"))


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each length of one source to take, and how often each is taken anyway."""
    rows = rows.sort_values("size", ignore_index=True)
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = int(target // size) if size else 0
    take = fit(rows["size"].tolist(), rows["n"].tolist(), int(round(target)) - whole * size)
    return rows.assign(base=whole, take=take)[["key", "size", "source_size", "target", "base", "take"]]


def _annotated(docs: DataFrame, names: dict[str, str], seed: int) -> DataFrame:
    """docs with its source key, size in words and seeded hash under names that no column of docs has."""
    text = F.col("text").cast("string")
    return docs.withColumns({names["key"]: _source_key(F.col("source")), names["size"]: word_count(text), names["hash"]: F.xxhash64(F.lit(seed), F.col("doc_id"), text)})


def _decisions(light: DataFrame, seed: int, **shares) -> tuple[DataFrame, int]:
    """What each bucket of (key, size, hash) rows gives: base, take (of its size) and before (rows of its size in earlier buckets); and the number of buckets."""
    counts = materialize(light.groupBy("key", "size").agg(F.count("*").alias("n")), "lengths", light.count())
    largest = counts.agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-largest // BUCKET))
    goals = targets(counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), **shares)
    plan = counts.join(F.broadcast(goals) if goals.count() <= 100_000 else goals, "key").groupBy("key").applyInPandas(_plan, "key string, size long, source_size long, target double, base int, take long")
    plan = materialize(plan, "plan", counts.count())
    held = light.groupBy("key", "size", F.pmod("hash", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    dealt = held.join(plan, ["key", "size"]).withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return dealt.select("key", "size", "bucket", "source_size", "target", "base", "take", "before"), buckets


def _select(rows: DataFrame, names: dict[str, str], decisions: DataFrame, buckets: int) -> DataFrame:
    """rows (annotated) with copies: how often each is taken. Other columns of the decisions come along."""
    rows = rows.withColumn(names["bucket"], F.pmod(F.col(names["hash"]), F.lit(buckets)))
    own = decisions.select(*[F.col(c).alias(names[c]) if c not in ("key", "size", "bucket") else F.col(c).alias(f"{names[c]}_of") for c in decisions.columns])
    keys = ("key", "size", "bucket")
    both = rows.join(own, reduce(lambda a, b: a & b, [rows[names[k]] == own[f"{names[k]}_of"] for k in keys]))
    order = Window.partitionBy(*[names[k] for k in keys]).orderBy(names["hash"], "doc_id")
    place = F.col(names["before"]) + F.row_number().over(order)
    return both.withColumn(names["copies"], F.col(names["base"]) + (place <= F.col(names["take"])).cast("int"))


def _names(docs: DataFrame) -> dict[str, str]:
    return {n: fresh(docs, f"mix_{n}") for n in ("key", "size", "hash", "bucket", "source_size", "target", "base", "take", "before", "copies")}


def mix(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    docs = docs.select("doc_id", "source", "text")
    n = _names(docs)
    light = materialize(_annotated(docs, n, seed).select("doc_id", n["key"], n["size"], n["hash"]), "sizes")
    decisions, buckets = _decisions(light.select(F.col(n["key"]).alias("key"), F.col(n["size"]).alias("size"), F.col(n["hash"]).alias("hash")), seed, **shares)
    chosen = _select(light, n, decisions, buckets)
    return chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(n["size"]).alias("size"), F.col(n["source_size"]).alias("source_size"), F.col(n["target"]).alias("target"), (F.col(n["size"]) * F.col(n["copies"])).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    n = _names(docs)
    rows = _annotated(docs, n, seed)
    light = materialize(rows.select(F.col(n["key"]).alias("key"), F.col(n["size"]).alias("size"), F.col(n["hash"]).alias("hash")), "sizes")
    decisions, buckets = _decisions(light, seed, **shares)
    chosen = _select(rows, n, decisions, buckets).filter(F.col(n["copies"]) > 0)
    repeated = chosen.withColumn(n["bucket"], F.explode(F.array_repeat(F.lit(1), F.col(n["copies"]))))
    return repeated.select(*docs.columns)
