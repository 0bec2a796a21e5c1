"""Exact top-k inner products by dual-tree search over cover trees (operator 6).

Vectors become integers, floor(256 x). Rows are dealt to blocks by the nearest of a few pivots, so that
a block holds rows that lie together, and a cell of over ROWS rows to several blocks by hash. Each block
is indexed once in a cover tree, which is written: a level's centres are farther apart than its cover
radius, every point of the block lies within that radius of one of them, and a level holds the centres
of the level above. Queries are dealt and indexed likewise.

For a query within a of centre p and a row within b of centre q the inner product is at most
<p, q> + |p| b + |q| a + a b; a pair of nodes goes once that is below the worst kth score in the query
node. The same bound prunes whole blocks before rows are shuffled: every query block first meets the
few row blocks that promise most, which gives each query a kth score, and then only those row blocks
whose root may still hold better ones. Within a pair of blocks the query tree is walked down with the
row nodes that are of use to each of its nodes; a leaf of queries opens them best bound first.

How much is pruned depends on the vectors: where they cluster, most of it; where all lie about equally
far apart, as random vectors of many dimensions do, nothing can be. scored_share() tells.

Defined results: vectors that are null or hold a null or non-finite component take no part; only
vectors of one length meet; a query's own row is no candidate, another row with its vec_id is; equal
scores go to the smaller vec_id, null last; a vec_id that stands in several rows is asked for each;
fewer candidates than k are all returned; an empty table gives no rows; extra columns are ignored.
Scores are exact while they fit 53 bits (components up to 2 ** 20 at 64 dimensions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerstone.llm.common import materialize, small_batches
from layerstone.llm.vectors import lists, matrix, ranked, usable

K, EVERY, SCALE = 5, 50, 256
#: Rows and queries to a block, pivots at most (the rest of the dealing is by hash), row blocks a query block meets first, roots that are bounded at once.
ROWS, QUERIES, PIVOTS, FIRST, ROOTS = 2048, 2048, 4096, 2, 1024
#: What a level's cover radius is divided by for the next, rows and queries of a leaf, points a child must hold on average, and rows scored at once.
BASE, LEAF, GROUP, CHILD, CHUNK = 1.6, 48, 8, 4, 256
BLOCK = "dim int, block long, n long, centre array<double>, norm double, radius double, tree binary"
FOUND = "query long, query_id long, row long, vec_id long, score long"
NULL_ID = np.iinfo(np.int64).max


class Tree:
    """A cover tree as arrays, nodes from the root down: a node holds points begin to end of order, its children are nodes next to one another.

    level tells whose centres a node is of; radii are what the points below need, never more than
    the cover radii of the levels below add up to.
    """

    FIELDS = ("data", "rows", "ids", "centre", "level", "radius", "begin", "end", "child", "children")

    def __init__(self, **parts: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, parts[name])
        self.centres = self.data[self.centre]
        self.norms = np.linalg.norm(self.centres, axis=1)

    def to_bytes(self) -> bytes:
        out = pa.BufferOutputStream()
        columns = [pa.array([getattr(self, name).tobytes()], pa.binary()) for name in self.FIELDS]
        batch = pa.RecordBatch.from_arrays([*columns, pa.array([self.data.shape[1]], pa.int64())], names=[*self.FIELDS, "dim"])
        with pa.ipc.new_stream(out, batch.schema) as writer:
            writer.write_batch(batch)
        return out.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, held: bytes) -> Tree:
        row = pa.ipc.open_stream(held).read_next_batch().to_pylist()[0]
        kinds = {"data": np.float64, "radius": np.float64}
        parts = {name: np.frombuffer(row[name], kinds.get(name, np.int64)) for name in cls.FIELDS}
        return cls(**parts | {"data": parts["data"].reshape(-1, row["dim"]) if row["dim"] else np.zeros((len(parts["rows"]), 0))})


def nets(data: np.ndarray, most: int | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Level by level from the root: cover radius, its centres, and each point's nearest centre (a place among the centres).

    Centres are drawn farthest first, so those of a level are farther apart than its radius, within
    which they cover every point. Ends where a level would have over most centres, or when all points
    are centres or copies of one.
    """
    centres, owner = [0], np.zeros(len(data), np.int64)
    nearest = ((data - data[0]) ** 2).sum(1)
    radius = float(np.sqrt(nearest.max()))
    yield radius, np.array(centres), owner.copy()
    while nearest.max() > 0:
        radius /= BASE
        while nearest.max() > radius * radius:
            if most is not None and len(centres) >= most:
                return
            far = int(nearest.argmax())
            distance = ((data - data[far]) ** 2).sum(1)
            closer = distance < nearest
            owner[closer], nearest[closer] = len(centres), distance[closer]
            centres.append(far)
        yield radius, np.array(centres), owner.copy()


def build(data: np.ndarray, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of a block. Points follow the centre that is nearest on the first level on which their node is divided.

    A node is a leaf if it has few points, or if the next level would leave its children next to none:
    bounding them would cost as much as scoring their points.
    """
    levels = nets(data, max(2, len(data) // CHILD))
    _, first, _ = next(levels)
    points = [np.arange(len(data))]
    centre, level, child, children = [int(first[0])], [0], [0], [0]
    open_nodes = [0] if len(data) > leaf else []
    for depth, (_, centres, owner) in enumerate(levels, 1):
        after = []
        for node in open_nodes:
            own = owner[points[node]]
            kinds, sizes = np.unique(own, return_counts=True)
            if len(kinds) == 1:
                after.append(node)  # one centre still covers all of it
            elif len(own) >= CHILD * len(kinds):
                child[node], children[node] = len(points), len(kinds)
                for kind, size in zip(kinds, sizes):
                    points.append(points[node][own == kind])
                    centre.append(int(centres[kind]))
                    level.append(depth)
                    child.append(0)
                    children.append(0)
                    if size > leaf:
                        after.append(len(points) - 1)
        open_nodes = after
        if not open_nodes:
            break
    # points in the order of the leaves, so that every node's stand together
    begin, end, order, at = [0] * len(points), [0] * len(points), [], 0
    stack = [(0, False)]
    while stack:
        node, left = stack.pop()
        if left:
            end[node] = at
            continue
        begin[node] = at
        stack.append((node, True))
        if children[node]:
            stack += [(c, False) for c in range(child[node] + children[node] - 1, child[node] - 1, -1)]
        else:
            order.append(points[node])
            at += len(points[node])
    order_ = np.concatenate(order)
    place = np.argsort(order_)
    radius = [float(np.sqrt(((data[p] - data[c]) ** 2).sum(1).max())) for p, c in zip(points, centre)]
    whole = lambda x: np.array(x, np.int64)
    return Tree(data=np.ascontiguousarray(data[order_]), rows=whole(rows[order_]), ids=whole(ids[order_]), centre=place[whole(centre)], level=whole(level), radius=np.array(radius), begin=whole(begin), end=whole(end), child=whole(child), children=whole(children))


def dual_search(asked: Tree, held: Tree, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query places, row places and scores of each query's k best that reach its floor, and how many pairs were scored."""
    ties = np.argsort(np.lexsort((held.rows, held.ids)))  # smaller is better among equal scores
    n, m = len(asked.rows), len(held.rows)
    best, place = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
    floors = np.full(n, -np.inf) if floors is None else floors
    reach = np.abs(asked.data).max(initial=0) * np.abs(held.data).max(initial=0) * asked.data.shape[1]
    slack, scored = 1e-9 * (1 + reach), 0
    norms = np.linalg.norm(asked.data, axis=1)

    def worst(some: slice) -> np.ndarray:
        return np.maximum(best[some, -1], floors[some])

    def meet(q: np.ndarray, d: np.ndarray) -> None:
        nonlocal scored
        scored += len(q) * len(d)
        scores = asked.data[q] @ held.data[d].T
        scores[asked.rows[q][:, None] == held.rows[d][None, :]] = -np.inf
        better = (scores >= np.maximum(best[q, -1], floors[q])[:, None]).any(1)
        q, scores = q[better], scores[better]
        both = np.concatenate([best[q], scores], 1)
        at = np.concatenate([place[q], np.broadcast_to(d, (len(q), len(d)))], 1)
        later = np.where(at < 0, m, ties[at])
        if reach * 2 * (m + 2) < 2**53:  # score and tie in one number
            top = np.argpartition(later - both * (m + 2), min(k, both.shape[1] - 1), axis=1)[:, : k + 1]
            both, at, later = (np.take_along_axis(x, top, 1) for x in (both, at, later))
        top = np.lexsort((later, -both), axis=1)[:, :k]
        best[q], place[q] = np.take_along_axis(both, top, 1), np.take_along_axis(at, top, 1)

    def group_bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        return held.centres[nodes] @ asked.centres[q] + (asked.norms[q] + asked.radius[q]) * held.radius[nodes] + asked.radius[q] * held.norms[nodes] + slack

    def leaf(some: slice, nodes: np.ndarray) -> None:
        while len(nodes):
            bound = asked.data[some] @ held.centres[nodes].T + norms[some, None] * held.radius[nodes][None] + slack
            alive = bound >= worst(some)[:, None]
            use = np.flatnonzero(alive.any(0))
            if not len(use):
                return
            use = use[np.argsort(-bound[:, use].max(0), kind="stable")]  # best first
            nodes = nodes[use]
            sizes = held.end[nodes] - held.begin[nodes]
            now = max(1, int(np.searchsorted(np.cumsum(sizes), CHUNK, "right")))
            inner = held.children[nodes[:now]] > 0
            shut = nodes[:now][~inner]
            if len(shut):
                wanting = some.start + np.flatnonzero(alive[:, use[:now][~inner]].any(1))
                meet(wanting, np.concatenate([np.arange(held.begin[i], held.end[i]) for i in shut]))
            opened = [np.arange(held.child[i], held.child[i] + held.children[i]) for i in nodes[:now][inner]]
            nodes = np.concatenate([*opened, nodes[now:]])

    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        q, nodes = todo.pop()
        some = slice(int(asked.begin[q]), int(asked.end[q]))
        nodes = nodes[group_bounds(q, nodes) >= worst(some).min()]
        if not len(nodes):
            continue
        if not asked.children[q]:
            leaf(some, nodes)
            continue
        wide = (held.radius[nodes] > asked.radius[q]) & (held.children[nodes] > 0)  # both trees are walked down together
        opened = [np.arange(held.child[i], held.child[i] + held.children[i]) for i in nodes[wide]]
        nodes = np.concatenate([nodes[~wide], *opened])
        todo += [(c, nodes) for c in range(asked.child[q], asked.child[q] + asked.children[q])]
    place[best == -np.inf] = -1
    i, r = np.nonzero(place >= 0)
    return i, place[i, r], best[i, r].astype(np.int64), scored


def pivots(rows: DataFrame, per_block: int, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """By vector length, the vectors with the smallest hash, one for each block that the rows need, at most so many. They only decide which rows stand together."""
    found = {}
    for r in rows.groupBy("dim").count().collect():
        n = min(most, -(-r["count"] // per_block))
        some = rows.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("row"), "row").limit(n).select("v").toArrow()
        found[r["dim"]] = matrix(some["v"])
    return found


def blocks(rows: DataFrame, per_block: int, label: str, leaf: int = LEAF) -> DataFrame:
    """A row a block: its tree, its root's centre, norm and radius, and its number of rows. Rows meet by nearest pivot, cells of over per_block rows are dealt by hash."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots(rows, per_block))  # at most PIVOTS vectors a length

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            dims = whole.column(3).to_numpy()
            for dim in np.unique(dims):
                part = whole.filter(pa.array(dims == dim))
                centres = shared.value[int(dim)]
                for at in range(0, len(part), 1024):
                    piece = part.slice(at, 1024)
                    x = matrix(piece.column(2))
                    cell = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(cell, pa.int64())], names=["row", "vec_id", "v", "dim", "cell"])

    celled = materialize(small_batches(rows).select("row", "vec_id", "v", "dim").mapInArrow(nearest, "row long, vec_id long, v array<double>, dim int, cell long"), f"{label}-cells")
    sizes = celled.groupBy(F.col("dim").alias("dim_of"), F.col("cell").alias("cell_of")).agg(F.ceil(F.count("*") / per_block).alias("parts"))
    dealt = celled.join(F.broadcast(sizes), (F.col("dim") == F.col("dim_of")) & (F.col("cell") == F.col("cell_of")))  # at most PIVOTS rows a vector length
    dealt = dealt.withColumn("block", F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("row"), F.col("parts")))

    def tree(held: pa.Table) -> pa.Table:
        data = matrix(held["v"])
        t = build(data, held["row"].to_numpy(), held["vec_id"].fill_null(NULL_ID).to_numpy(), leaf)
        return pa.table({
            "dim": pa.array([data.shape[1]], pa.int32()), "block": held["block"].slice(0, 1), "n": pa.array([len(data)], pa.int64()), "centre": lists(t.centres[:1]),
            "norm": pa.array(t.norms[:1]), "radius": pa.array(t.radius[:1]), "tree": pa.array([t.to_bytes()], pa.binary()),
        })

    return materialize(dealt.select("row", "vec_id", "v", "dim", "block").groupBy("dim", "block").applyInArrow(tree, BLOCK), label)


def root_pairs(asked: DataFrame, held: DataFrame, best: int | None = None) -> DataFrame:
    """dim, asked, held, bound of pairs of blocks: for each block of queries the best row blocks of every group of roots, or all whose bound reaches its worst kth score (column worst).

    Only roots are shuffled, ROOTS to a group; pairs that cannot matter are never written.
    """
    fields = "dim int, asked long, held long, bound double"

    def side(df: DataFrame, mine: str, other: str, others: int) -> DataFrame:
        n = df.count()
        own = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-n // ROOTS)))).cast("int")
        columns = [c for c in ("dim", "block", "centre", "norm", "radius", "worst") if c in df.columns]
        return df.select(*columns, own.alias(mine), F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-others // ROOTS)) - 1))).alias(other))

    def run(_, a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"dim": pa.array([], pa.int32()), "asked": pa.array([], pa.int64()), "held": pa.array([], pa.int64()), "bound": pa.array([], pa.float64())})
        (p, pn, pr), (c, cn, cr) = ((matrix(t["centre"]), t["norm"].to_numpy(), t["radius"].to_numpy()) for t in (a, b))
        bound = p @ c.T + (pn + pr)[:, None] * cr[None] + pr[:, None] * cn[None]
        bound += 1e-9 * (1 + np.abs(bound).max())
        if best is None:
            i, j = np.nonzero(bound >= a["worst"].to_numpy()[:, None])
        else:
            top = np.argsort(-bound, axis=1, kind="stable")[:, :best]
            i, j = np.repeat(np.arange(len(a)), top.shape[1]), top.ravel()
        return pa.table({"dim": a["dim"].take(i), "asked": a["block"].take(i), "held": b["block"].take(j), "bound": pa.array(bound[i, j])})

    n, m = asked.count(), held.count()
    left, right = side(asked, "x", "y", m), side(held, "y", "x", n)
    return left.groupBy("dim", "x", "y").cogroup(right.groupBy("dim", "x", "y")).applyInArrow(run, fields)


def _searched(pairs: DataFrame, asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """What dual search finds in pairs of blocks, and for each pair a row without a query whose score is how many pairs of vectors were scored.

    Query trees go to the pairs' row blocks; a row block is shuffled once.
    """
    columns = ["tree", "floors"] if "floors" in asked.columns else ["tree"]
    left = asked.select(F.col("dim").alias("dim_a"), F.col("block").alias("block_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = held.select(F.col("dim").alias("dim_h"), F.col("block").alias("block_h"), F.col("tree").alias("tree_h"))
    both = pairs.join(left, (F.col("dim") == F.col("dim_a")) & (F.col("asked") == F.col("block_a"))).join(right, (F.col("dim") == F.col("dim_h")) & (F.col("held") == F.col("block_h")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                x = {name: part.column(i)[row].as_py() for i, name in enumerate(part.schema.names)}
                a, h = Tree.from_bytes(x["tree_a"]), Tree.from_bytes(x["tree_h"])
                floors = None
                if x.get("floors_a"):
                    known = {f["query"]: f["kth"] for f in x["floors_a"]}
                    floors = np.array([known.get(r, -np.inf) for r in a.rows.tolist()])
                i, j, s, scored = dual_search(a, h, k, floors)
                ids = lambda t, at: pa.array(t.ids[at], mask=t.ids[at] == NULL_ID)
                yield pa.RecordBatch.from_arrays([pa.array(a.rows[i]), ids(a, i), pa.array(h.rows[j]), ids(h, j), pa.array(s)], names=["query", "query_id", "row", "vec_id", "score"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([scored], pa.int64())], names=["query", "query_id", "row", "vec_id", "score"])

    return small_batches(both).select("tree_a", "tree_h", *[f"{c}_a" for c in columns[1:]]).mapInArrow(run, FOUND)


def _found(embeddings: DataFrame, k: int, every: int, scale: int, per_block: int, per_query_block: int, first: int) -> tuple[DataFrame, int]:
    """All that the two rounds find (see _searched), and the number of pairs of vectors there are."""
    rows = usable(embeddings, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))
    rows = materialize(rows, "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0)
    held, asked = blocks(rows, per_block, "row-blocks"), blocks(queries, per_query_block, "query-blocks", GROUP)
    promising = root_pairs(asked, held, best=first)
    place = F.row_number().over(Window.partitionBy("dim", "asked").orderBy(F.desc("bound"), "held"))
    early = materialize(promising.withColumn("place", place).filter(F.col("place") <= first).select("dim", "asked", "held"), "first-pairs")
    one = materialize(_searched(early, asked, held, k), "first-found")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row").asc()]
    kth = ranked(one.filter("query is not null"), k, *order).filter(F.col("rank") == k).select(F.col("query").alias("of"), F.col("score").cast("double").alias("kth"))
    members = _members(asked)
    floors = members.join(kth, F.col("query") == F.col("of"), "left").groupBy(F.col("dim").alias("d"), F.col("block").alias("b")).agg(
        F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("worst"), F.collect_list(F.when(F.col("kth").isNotNull(), F.struct("query", "kth"))).alias("floors")
    )  # at most a block's queries to a row
    known = materialize(asked.join(floors, (F.col("dim") == F.col("d")) & (F.col("block") == F.col("b"))).drop("d", "b"), "floors")
    left = root_pairs(known, held).join(early.select(F.col("dim").alias("d"), F.col("asked").alias("a"), F.col("held").alias("h")), (F.col("dim") == F.col("d")) & (F.col("asked") == F.col("a")) & (F.col("held") == F.col("h")), "left_anti")
    two = _searched(left, known, held, k)
    by_dim = held.groupBy("dim").agg(F.sum("n").alias("n")).join(asked.groupBy(F.col("dim").alias("d")).agg(F.sum("n").alias("m")), F.col("dim") == F.col("d"))
    return one.unionByName(two), by_dim.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def _members(asked: DataFrame) -> DataFrame:
    """dim, block, query: the rows of each block of queries."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for dim, block, tree in zip(*(c.to_pylist() for c in part.columns)):
                rows = Tree.from_bytes(tree).rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), block)), pa.array(rows)], names=["dim", "block", "query"])

    return small_batches(asked).select("dim", "block", "tree").mapInArrow(run, "dim int, block long, query long")


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, per_block: int = ROWS, per_query_block: int = QUERIES, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every row whose vec_id is divisible by every."""
    found, _ = _found(embeddings, k, every, scale, per_block, per_query_block, first)
    best = ranked(found.filter("query is not null"), k, F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row").asc())
    return best.select("query_id", "rank", "vec_id", "score")


def scored_share(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, per_block: int = ROWS, per_query_block: int = QUERIES, first: int = FIRST) -> float:
    """What share of all pairs of a query and a row is scored; the rest is pruned."""
    found, pairs = _found(embeddings, k, every, scale, per_block, per_query_block, first)
    return (found.filter("query is null").agg(F.sum("score")).first()[0] or 0) / max(1, pairs)
