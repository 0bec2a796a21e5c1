"""Connected components of an edge list by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over edges, written to the shared folder, so no links
or components reach the driver and lineage stays short. Minimum is aggregated before the shuffle and
the joins are plain equality joins, so a node with very many links is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerstone.llm.common import materialize

#: Rounds needed grow with the logarithm of the longest path; this only stops an endless loop.
MAX_ROUNDS = 100


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, root (smallest node reachable) for every node of edges (a, b: BIGINT; about rows of them, if known); self-links and nulls are ignored."""
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges", rows)
    before = _mark(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        now = materialize(_small_star(_large_star(now)), "edges", rows=before[0])
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (r["n"], r["h"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.join(least, both["u"] == least["c"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    rest = edges.join(least, edges["u"] == least["c"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
