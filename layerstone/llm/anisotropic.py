"""Approximate nearest neighbours by score-aware anisotropic quantisation (operator 8).

Nearest in Euclidean distance is largest in 2 <q, x> - |x|^2: a maximum inner product search whose
second term is known exactly. Vectors are quantised by pairs of dimensions with 16 centres each, four
bits a pair. The loss weighs the part of a vector's residual that is parallel to the vector PARALLEL
times as much as the rest, because that part is what changes large inner products; codes are chosen
by coordinate descent on that loss and centres are its weighted least-squares solution.

A query makes a table of its inner products with all centres; scanning a block of codes adds up one
entry a pair for every row. Only codes and norms are dealt to the blocks (40 bytes a row of 64
dimensions). Each block gives its share of a query's RERANK best rows, with room for chance, as rows
are dealt to blocks by hash; the best RERANK over all blocks are joined with their vectors once, and
their distances worked out exactly.

The centres are fitted on the SAMPLE rows with the smallest hash; every row is encoded and scanned.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part;
only vectors of one length meet; a query's own row is no candidate, another row with its vec_id is;
equal distances go to the smaller vec_id, null last; a vec_id that stands in several rows is asked
for each; fewer candidates than k are all returned; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerstone.llm.common import materialize
from layerstone.llm.vectors import matrix, ranked, usable

K, EVERY = 10, 100
SAMPLE, CENTRES, WIDTH, ROUNDS, SWEEPS = 8192, 16, 2, 6, 2
#: Threshold T of the score-aware loss: large scores are those above T times the largest possible.
THRESHOLD = 0.2
RERANK = 512
#: Rows and queries to a block.
ROWS, QUERIES = 1 << 14, 2048


def pairs_of(x: np.ndarray) -> np.ndarray:
    """Rows as (row, pair, 2), an odd last dimension filled up with zero."""
    if x.shape[1] % WIDTH:
        x = np.pad(x, ((0, 0), (0, WIDTH - x.shape[1] % WIDTH)))
    return x.reshape(len(x), -1, WIDTH)


def extra_weight(dim: int) -> float:
    """How much more the parallel part of a residual weighs than the rest."""
    t = THRESHOLD**2
    return max(0.0, (dim - 1) * t / (1 - t) - 1)


def assign(x: np.ndarray, centres: np.ndarray, extra: float, codes: np.ndarray | None = None) -> np.ndarray:
    """Codes (row, pair) by coordinate descent on |r|^2 + extra <r, u>^2, u the row's direction."""
    u = x / np.sqrt((x**2).sum((1, 2), keepdims=True))
    if codes is None:
        codes = ((x[:, :, None] - centres[None]) ** 2).sum(3).argmin(2).astype(np.uint8)
    chosen = centres[np.arange(x.shape[1])[None], codes]
    parallel = ((x - chosen) * u).sum((1, 2))
    for _ in range(SWEEPS):
        for s in range(x.shape[1]):
            residual = x[:, s, None] - centres[s][None]
            along = (residual * u[:, s, None]).sum(2)
            rest = parallel - along[np.arange(len(x)), codes[:, s]]
            codes[:, s] = ((residual**2).sum(2) + extra * (rest[:, None] + along) ** 2).argmin(1)
            parallel = rest + along[np.arange(len(x)), codes[:, s]]
    return codes


def fit(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Centres (pair, 16, 2) for the rows of x, none of them zero."""
    x = pairs_of(x)
    n, pairs, _ = x.shape
    extra = extra_weight(pairs * WIDTH)
    u = x / np.sqrt((x**2).sum((1, 2), keepdims=True))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(n, CENTRES, replace=n < CENTRES)].transpose(1, 0, 2).copy()
    codes = None
    for step in range(2 * ROUNDS):
        weight = 0.0 if step < ROUNDS else extra  # plain k-means first
        codes = ((x[:, :, None] - centres[None]) ** 2).sum(3).argmin(2).astype(np.uint8) if not weight else assign(x, centres, weight, codes)
        parallel = ((x - centres[np.arange(pairs)[None], codes]) * u).sum((1, 2))
        for s in range(pairs):
            here, us, xs = codes[:, s], u[:, s], x[:, s]
            old = centres[s][here]
            rest = parallel - ((xs - old) * us).sum(1)
            left, right = np.zeros((CENTRES, WIDTH, WIDTH)), np.zeros((CENTRES, WIDTH))
            np.add.at(left, here, np.eye(WIDTH)[None] + weight * us[:, :, None] * us[:, None, :])
            np.add.at(right, here, xs + weight * us * (rest + (xs * us).sum(1))[:, None])
            used = np.bincount(here, minlength=CENTRES) > 0
            centres[s][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            parallel = rest + ((xs - centres[s][here]) * us).sum(1)
    return centres


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpack(packed: np.ndarray, pairs: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :pairs]


def codebooks(rows: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centres by vector length, each from the sample rows with the smallest hash. Only samples reach the driver."""
    found = {}
    for r in rows.groupBy("dim").count().collect():
        some = rows.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id", "row"), "row").limit(sample).select("v").toArrow()
        found[r["dim"]] = fit(matrix(some["v"]))
    return found


def index(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """row, dim, norm (square) and code (binary, four bits a pair) of every row. One pass, no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # at most 16 * dim numbers a vector length

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            dims = whole.column(2).to_numpy()
            for dim in np.unique(dims):
                part = whole.filter(pa.array(dims == dim))
                for at in range(0, len(part), 4096):
                    piece = part.slice(at, 4096)
                    flat = matrix(piece.column(1))
                    x = pairs_of(flat)
                    packed = pack(assign(x, shared.value[int(dim)], extra_weight(x.shape[1] * WIDTH)))
                    codes = pa.array([c.tobytes() for c in packed], pa.binary())
                    yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array((flat**2).sum(1)), codes], names=["row", "dim", "norm", "code"])

    return rows.select("row", "v", "dim").mapInArrow(run, "row long, dim int, norm double, code binary")


def scan(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """2 <q, x'> - |x|^2 of every query and coded row, by adding up table entries."""
    tables = np.einsum("npw,pcw->pnc", pairs_of(queries), centres).astype(np.float32)
    total = np.tile(-0.5 * norms.astype(np.float32), (len(queries), 1))
    for s in range(codes.shape[1]):
        total += tables[s][:, codes[:, s]]
    return total


def scanned(indexed: DataFrame, queries: DataFrame, books: dict[int, np.ndarray], rerank: int, per_block: int, per_query_block: int) -> DataFrame:
    """query, row, near: from every block of codes its share of each query's rerank best rows, by the tables."""
    shared = indexed.sparkSession.sparkContext.broadcast(books)
    row_blocks, query_blocks = max(1, -(-indexed.count() // per_block)), max(1, -(-queries.count() // per_query_block))
    share = rerank if row_blocks == 1 else min(rerank, int(np.ceil(rerank / row_blocks + 6 * np.sqrt(rerank / row_blocks))) + 1)
    of = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select("row", "v", "dim").withColumn("q", of(query_blocks)).withColumn("r", each(row_blocks))
    right = indexed.withColumn("r", of(row_blocks)).withColumn("q", each(query_blocks))

    def run(_, asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(asked) and len(held):
            centres = shared.value[asked["dim"][0].as_py()]
            q, norms = matrix(asked["v"]), held["norm"].to_numpy()
            codes = unpack(np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(len(held), -1), len(centres))
            own, row = asked["row"].to_numpy(), held["row"].to_numpy()
            for a in range(0, len(q), 128):
                score = scan(q[a : a + 128], codes, norms, centres)
                score[own[a : a + 128][:, None] == row[None, :]] = -np.inf
                take = min(share, score.shape[1])
                near = np.argpartition(-score, take - 1, axis=1)[:, :take]
                i = np.repeat(np.arange(len(near)), take)
                found = score[i, near.ravel()]
                use = found > -np.inf
                for x, y in zip(out, (own[a + i[use]], row[near.ravel()[use]], found[use].astype(np.float64))):
                    x.append(y)
        return pa.table(dict(zip(("query", "row", "near"), (pa.array(np.concatenate(x)) for x in out))))

    return left.groupBy("q", "r", "dim").cogroup(right.groupBy("q", "r", "dim")).applyInArrow(run, "query long, row long, near double")


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, rerank: int = RERANK, per_block: int = ROWS, per_query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest found of every row whose vec_id is divisible by every."""
    rows = materialize(usable(embeddings, zero=False), "vectors")
    books = codebooks(rows)
    indexed = materialize(index(rows, books), "index")
    queries = rows.filter(F.col("vec_id") % every == 0)
    near = scanned(indexed, queries, books, max(rerank, k), per_block, per_query_block)
    chosen = ranked(near, max(rerank, k), F.col("near").desc(), F.col("row").asc()).select("query", F.col("row").alias("near_row"))
    asked = queries.select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    both = chosen.join(rows.select("row", "vec_id", "v"), F.col("near_row") == F.col("row")).join(asked, F.col("query") == F.col("asked"))
    squares = F.zip_with("v", "q", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    exact = both.select("query", "query_id", "row", "vec_id", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    return ranked(exact, k, F.col("score").asc(), F.col("vec_id").asc_nulls_last(), F.col("row").asc()).select("query_id", "rank", "vec_id", "score")
