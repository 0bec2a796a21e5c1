"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerstone.llm import anisotropic, cover_tree

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def embeddings(spark, data):
    return spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.1/embeddings.parquet")


def plain(embeddings):
    rows = embeddings.select("vec_id", "embedding").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def best_products(ids, x, every, k):
    """By query place: ids and scores of the k largest products of its vector with all others, ties to the smaller id."""
    for q in np.flatnonzero(ids % every == 0):
        scores, others = x @ x[q], np.flatnonzero(np.arange(len(ids)) != q)
        best = others[np.lexsort((ids[others], -scores[others]))[:k]]
        yield q, [(r, ids[b], scores[b]) for r, b in enumerate(best, 1)]


@pytest.mark.parametrize("sizes", [(2048, 2048), (150, 7)])
def test_dual_tree_equals_brute_force(embeddings, sizes):
    ids, x = plain(embeddings)
    got = found(cover_tree.search(embeddings, per_block=sizes[0], per_query_block=sizes[1]))
    want = dict(best_products(ids, np.floor(256 * x).astype(np.int64), 50, 5))
    assert got == {ids[q]: best for q, best in want.items()}


def test_clustered_vectors_are_pruned_in_blocks_and_trees(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 8
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 0.2 for c in centres] + [np.repeat(centres[:1], 200, 0)])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    whole = np.floor(256 * x).astype(np.int64)
    want = {ids[q]: best for q, best in best_products(ids, whole, 50, 5)}
    for sizes in ((2048, 2048), (120, 20)):
        assert found(cover_tree.search(df, per_block=sizes[0], per_query_block=sizes[1])) == want
        assert cover_tree.scored_share(df, per_block=sizes[0], per_query_block=sizes[1]) < 0.3


def test_dual_tree_equals_its_sql(embeddings, data):
    import duckdb

    from layerstone.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data.rsplit('/', 1)[0]}/sf0.1/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op6_cover_tree"]).fetchall())
    assert sorted(tuple(r) for r in cover_tree.search(embeddings).select("query_id", "rank", "vec_id", "score").collect()) == want


def test_dual_tree_with_many_ties():
    rng = np.random.default_rng(1)
    data = rng.integers(-3, 4, (400, 4)).astype(np.float64)
    ids, rows = rng.permutation(400) // 2, np.arange(400)
    asked, held = cover_tree.build(data[:50], rows[:50], ids[:50]), cover_tree.build(data, rows, ids)
    i, j, s, _ = cover_tree.dual_search(asked, held, 7)
    for q in range(50):
        others = np.flatnonzero(rows != q)
        scores = data @ data[q]
        best = others[np.lexsort((rows[others], ids[others], -scores[others]))[:7]]
        at = asked.rows[i] == q
        mine = sorted(zip(-s[at], held.ids[j[at]], held.rows[j[at]]))
        assert [m[2] for m in mine] == best.tolist()


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_cover_tree_covers_and_separates_by_level(kind):
    rng = np.random.default_rng(2)
    data = {"random": rng.normal(size=(600, 3)), "clustered": np.repeat(rng.normal(size=(20, 6)) * 9, 30, 0) + rng.normal(size=(600, 6)) * 0.1, "copies": np.repeat(rng.normal(size=(7, 6)), 90, 0)}[kind]
    distance = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    levels = list(cover_tree.nets(data))
    for (radius, centres, owner), (_, above, _) in zip(levels, levels[:1] + levels):
        assert set(above) <= set(centres)  # nested
        assert (distance(data, data[centres]).min(1) <= radius + 1e-9).all()  # covering
        assert len(centres) == 1 or (distance(data[centres], data[centres]) + np.eye(len(centres)) * 1e9).min() > radius  # separation
        assert (distance(data, data[centres])[np.arange(len(data)), owner] <= radius + 1e-9).all()
    tree = cover_tree.Tree.from_bytes(cover_tree.build(data, np.arange(len(data)), np.arange(len(data))).to_bytes())
    assert sorted(tree.rows) == list(range(len(data))) and len(tree.begin) > 1
    for node in range(len(tree.begin)):
        inside = tree.data[tree.begin[node] : tree.end[node]]
        assert (distance(inside, tree.centres[node : node + 1]) <= tree.radius[node] + 1e-9).all()
        c = slice(tree.child[node], tree.child[node] + tree.children[node])
        if tree.children[node]:
            assert tree.begin[c][0] == tree.begin[node] and tree.end[c][-1] == tree.end[node] and (tree.begin[c][1:] == tree.end[c][:-1]).all()
            level = levels[tree.level[c][0]]
            assert (tree.level[c] == tree.level[c][0]).all() and tree.level[c][0] > tree.level[node]
            assert {tuple(x) for x in tree.centres[c]} <= {tuple(x) for x in data[level[1]]}
            assert (tree.radius[c] <= level[0] + 1e-9).all()


@pytest.mark.parametrize("sizes", [(1 << 14, 2048), (300, 6)])
def test_anisotropic_recall_and_scores(embeddings, sizes):
    ids, x = plain(embeddings)
    got = found(anisotropic.search(embeddings, rerank=128, per_block=sizes[0], per_query_block=sizes[1]))
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        distance, others = np.sqrt(((x - x[q]) ** 2).sum(1)), np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], distance[others]))[:10]]
        mine = got[ids[q]]
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        for _, v, score in mine:
            assert score == pytest.approx(distance[ids == v][0], rel=1e-12)
        hit, total = hit + len({m[1] for m in mine} & set(ids[best])), total + 10
    assert hit >= 0.95 * total


def test_codes_pack_and_weigh_parallel_errors():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 16, (20, 7)).astype(np.uint8)
    assert (anisotropic.unpack(anisotropic.pack(codes), 7) == codes).all()
    x = rng.normal(size=(500, 8))
    centres, p = anisotropic.fit(x), anisotropic.pairs_of(x)
    u = p / np.sqrt((p**2).sum((1, 2), keepdims=True))

    def loss(extra):
        r = p - centres[np.arange(4)[None], anisotropic.assign(p, centres, extra)]
        return (r**2).sum(), ((r * u).sum((1, 2)) ** 2).sum()

    plain_loss, aware = loss(0.0), loss(20.0)
    assert aware[1] < plain_loss[1] and aware[0] >= plain_loss[0] - 1e-9


def test_vectors_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 1), (500, [0.0, 0.0], 1), (600, [3.0, 1.0, 2.0], 1), (None, [2.0, 2.0], 1), (7, [1.0, 2.0], 1), (8, [-1.0, 0.5], 1), (9, [], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("v", F.lit(2)).withColumn("block", F.lit(3))
    exact = cover_tree.search(df).collect()
    mine = [(r["rank"], r["vec_id"], r["score"]) for r in exact if r["query_id"] == 0]
    assert sorted(mine) == sorted(2 * [(1, None, 393216), (2, 0, 327680), (3, 7, 327680), (4, 8, 0), (5, 500, 0)])
    assert not [r for r in exact if r["query_id"] in (100, 200, 300, 400, 600)]
    near = anisotropic.search(df).collect()
    mine = [(r["rank"], r["vec_id"], r["score"]) for r in near if r["query_id"] == 0]
    assert sorted(mine, key=repr) == sorted(2 * [(1, 0, 0.0), (2, 7, 0.0), (3, None, 1.0), (4, 8, 2.5)], key=repr)
    for search in (cover_tree.search, anisotropic.search):
        assert search(df.limit(0)).count() == 0
