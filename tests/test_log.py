"""The versioned log against a plain Python model, and the scenarios that define it."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from layerstone.functions import bloom, codec
from layerstone.operators import compact, lookup, merge, range_delete, stats
from layerstone.plans import ordered

LOG = "key string, seq long, op int, value string"


def model(ops, at=None):
    state = {}
    for key, seq, op, value in sorted(ops, key=lambda o: o[1]):
        if at is None or seq <= at:
            state[key] = (seq, value) if op else None
    return {(k, *v) for k, v in state.items() if v}


def rows(df):
    return {tuple(r) for r in df.collect()}


def random_ops(seed, n=300, keys=40):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys):03}", s, op := int(rng.random() < 0.7), f"v{s}" if op else None) for s in range(1, n + 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_snapshot_equals_model(spark, seed):
    ops = random_ops(seed)
    shuffled = random.Random(seed).sample(ops, len(ops))
    log = spark.createDataFrame(shuffled, LOG)
    assert rows(lookup.snapshot(log)) == model(ops)
    assert rows(lookup.snapshot(log, 150)) == model(ops, 150)
    kept = compact.compact(log.withColumn("run_id", F.lit(0)), compact.keep_newest_or_since(250))
    assert rows(lookup.snapshot(kept)) == model(ops)
    newest = {k: max(s for key, s, _, _ in ops if key == k) for k, *_ in ops}
    assert {(r["key"], r["seq"]) for r in kept.collect()} == {(k, s) for k, s, _, _ in ops if s >= 250 or s == newest[k]}


def test_put_get_delete(spark):
    put, deleted = ("key1", 1, 1, "value1"), ("key1", 2, 0, None)
    assert rows(lookup.point_get(spark.createDataFrame([put], LOG), "key1")) == {("key1", 1, "value1")}
    assert rows(lookup.point_get(spark.createDataFrame([put, deleted], LOG), "key1")) == set()
    assert rows(lookup.point_get(spark.createDataFrame([], LOG), "key1")) == set()


def test_hundred_keys_in_any_arrival_order(spark):
    ops = [(f"key-{i:04}", i + 1, 1, f"val-{i:04}") for i in range(100)]
    asked = spark.createDataFrame([(k,) for k, *_ in ops] + [("key-0001",), ("missing",)], "k string")
    got = lookup.multi_get(spark.createDataFrame(ops[::-1], LOG), asked)
    assert rows(got) == {(k, s, v) for k, s, _, v in ops}


def test_empty_key_empty_value_and_high_bytes(spark):
    ops = [(b"", 1, 1, b""), (b"a", 2, 1, b"x"), (b"a\x00", 3, 1, b"y"), (b"\x7f", 4, 1, b"z"), (b"\x80", 5, 1, None)]
    log = spark.createDataFrame([(bytearray(k), s, o, None if v is None else bytearray(v)) for k, s, o, v in ops], "key binary, seq long, op int, value binary")
    got = [bytes(r["key"]) for r in lookup.snapshot(log).orderBy("key").collect()]
    assert got == [b"", b"a", b"a\x00", b"\x7f", b"\x80"]  # a null payload on a put is still there


def test_horizon_keeps_newest_and_recent(spark):
    ops = [("lamp", 91, 0, None), ("lamp", 77, 1, "lit"), ("lamp", 42, 1, "dim"), ("lamp", 8, 1, "off"), ("desk", 12, 1, "oak"), ("desk", 11, 1, "elm")]
    log = spark.createDataFrame(ops, LOG).withColumn("run_id", F.lit(0))
    kept = compact.compact(log, compact.keep_newest_or_since(60))
    assert {(r["key"], r["seq"]) for r in kept.collect()} == {("lamp", 91), ("lamp", 77), ("desk", 12)}


def test_merge_is_order_independent_and_prefers_the_first_run(spark):
    a = spark.createDataFrame([("a", 1, 1, "x", 1), ("b", 2, 1, "y", 1)], LOG + ", run_id long")
    b = spark.createDataFrame([("a", 1, 1, "other", 2), ("a", 3, 0, None, 2)], LOG + ", run_id long")
    empty = spark.createDataFrame([], LOG + ", run_id long")
    for runs in ([a, b, empty], [empty, b, a]):
        assert rows(merge.dedup(merge.merge(runs))) == {("a", 1, 1, "x"), ("b", 2, 1, "y"), ("a", 3, 0, None)}
    assert rows(merge.merge([a])) == rows(a)
    with pytest.raises(ValueError):
        merge.merge([])


def test_range_deletes(spark):
    ops = [(i, s, 1, f"{i}@{s}") for s in (5, 15) for i in range(8)]
    log = spark.createDataFrame(ops, "key long, seq long, op int, value string")
    stones = [(2, 5, 10), (4, 6, 20), (7, 7, 99), (6, 3, 99)]
    table = spark.createDataFrame(stones, "start long, end long, seq long")
    want = {o for o in ops if not any(s <= o[0] < e and q > o[1] for s, e, q in stones)}
    assert rows(range_delete.apply(log, table)) == want
    assert rows(range_delete.apply(log, table, broadcast=0)) == want
    assert rows(range_delete.segments(table)) == {(2, 4, 10), (4, 5, 20), (5, 6, 20)}
    assert rows(range_delete.apply(log, table.limit(0))) == set(ops)


@pytest.mark.parametrize("seed", range(4))
def test_many_range_deletes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    stones = [(s := rng.randrange(60), s + rng.randrange(12), rng.randrange(100)) for _ in range(40)]
    table = spark.createDataFrame(stones, "start long, end long, seq long")
    bounds = sorted({x for s, e, _ in stones if s < e for x in (s, e)})
    want = {(a, b, max(over)) for a, b in zip(bounds, bounds[1:]) if (over := [q for s, e, q in stones if s <= a and b <= e])}
    assert rows(range_delete.segments(table)) == want
    assert rows(range_delete.segments(table, broadcast=0)) == want


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_seeks_equal_bisect(spark, ranges):
    rng = random.Random(5)
    keys, probes = sorted(rng.sample(range(0, 500), 60)), [-1, *rng.sample(range(0, 500), 80), 501]
    k, p = (spark.createDataFrame([(x,) for x in xs], "x long") for xs in (keys, probes))
    at = lambda i: keys[i] if 0 <= i < len(keys) else None
    want = {
        "le": {x: at(bisect.bisect_right(keys, x) - 1) for x in probes}, "lt": {x: at(bisect.bisect_left(keys, x) - 1) for x in probes},
        "ge": {x: at(bisect.bisect_left(keys, x)) for x in probes}, "gt": {x: at(bisect.bisect_right(keys, x)) for x in probes},
    }
    for how, expected in want.items():
        assert {r["probe"]: r["found"] for r in ordered.seek(p, k, how, ranges).collect()} == expected
    following = {r["x"]: r["n"] for r in ordered.neighbours(k, "x", "n", following=True, n=ranges).collect()}
    assert following == dict(zip(keys, [*keys[1:], None]))
    numbers = {r["x"]: r["n"] for r in ordered.numbered(k, "x", "n", 5, ranges).collect()}
    assert numbers == {x: i + 5 for i, x in enumerate(keys)}
    assert ordered.seek(p, k.limit(0), "le", ranges).filter("found is not null").count() == 0


def test_word_navigation(spark):
    towns = spark.createDataFrame([("Oslo", 1), ("Lima", 2), ("Rome", 3), ("Kyiv", 4)], "key string, value long")
    get = lambda df: [r["key"] for r in df.collect()]
    assert get(lookup.seek(towns, "key", "Lima", "le")) == ["Lima"]
    assert get(lookup.seek(towns, "key", "Lima", "lt")) == ["Kyiv"]
    assert get(lookup.seek(towns, "key", "Kyiv", "lt")) == []
    assert get(lookup.seek(towns, "key", "M", "ge")) == ["Oslo"]
    assert get(lookup.edge(towns, "key")) == ["Kyiv"]
    assert get(lookup.edge(towns, "key", last=True)) == ["Rome"]


def test_seek_over_runs_passes_over_deletes(spark):
    ops = [(1, 1, 1, "a"), (3, 2, 1, "b"), (3, 5, 0, None), (4, 3, 1, "c"), (7, 4, 1, "d"), (7, 6, 1, "e")]
    log = merge.merge([spark.createDataFrame(ops[i::2], "key long, seq long, op int, value string") for i in (0, 1)])
    stones = spark.createDataFrame([(4, 5, 9)], "start long, end long, seq long")
    assert rows(lookup.seek_live(log, 2, "ge")) == {(4, 3, "c")}
    assert rows(lookup.seek_live(log, 2, "ge", stones)) == {(7, 6, "e")}
    assert rows(lookup.seek_live(log, 7, "lt", stones)) == {(1, 1, "a")}
    assert rows(lookup.seek_live(log, 7, "gt")) == set()
    assert [(r["key"], r["seq"]) for r in lookup.ordered_versions(log).orderBy("place").collect()] == [(1, 1), (3, 5), (3, 2), (4, 3), (7, 6), (7, 4)]


def test_null_probes_find_nothing_and_a_hot_key_is_dealt_over_ranges(spark):
    keys = spark.createDataFrame([(3,), (9,), (None,)], "k long")
    probes = spark.createDataFrame([(None,), (1,), (9,), (9,), (12,)], "p long")
    found = lambda how: sorted(((r["probe"], r["found"]) for r in ordered.seek(probes, keys, how, 3).collect()), key=repr)
    assert found("ge") == sorted([(None, None), (1, 3), (9, 9), (9, 9), (12, None)], key=repr)
    assert found("lt") == sorted([(None, None), (1, None), (9, 3), (9, 3), (12, 9)], key=repr)
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("k"))
    sizes = [r["count"] for r in ordered.ranged(hot, "k", n=8).groupBy(ordered.RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3000 / 4
    numbers = ordered.numbered(hot, "k", "n", n=8).collect()
    assert sorted(r["n"] for r in numbers) == list(range(1, 3001))
    assert [r["k"] for r in sorted(numbers, key=lambda r: r["n"])] == sorted(r["k"] for r in numbers)


def test_plans_hash_and_never_broadcast_the_log(spark, data):
    from layerstone import catalog

    def plan(name):
        return catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()

    for name in ("snapshot_latest", "merge_runs_dedup", "compact_horizon", "multi_get", "fsm_fold", "range_tombstone_apply_many"):
        assert "SortAggregate" not in plan(name)
    assert "NestedLoop" not in plan("range_tombstone_coverage_many") + plan("range_tombstone_apply_many")
    few = plan("range_tombstone_coverage")
    assert "BroadcastNestedLoopJoin BuildRight, Inner" in few


def test_compaction_picker_thresholds(spark):
    files = lambda rows: spark.createDataFrame(rows, "file_num long, level int, min_key long, file_size long")
    assert rows(compact.pick(files([(i, 0, i, 1) for i in range(3)]))) == set()
    assert rows(compact.pick(files([(i, 0, i, 1) for i in range(4)]))) == {(0, i) for i in range(4)}
    limit = 10 * 1024 * 1024 * 10
    assert rows(compact.pick(files([(1, 1, 5, limit)]))) == set()
    assert rows(compact.pick(files([(1, 1, 5, limit), (2, 1, 3, 1)]))) == {(1, 2)}
    assert rows(compact.pick(files([(1, 6, 5, limit * 10**9)]))) == set()
    assert rows(compact.pick(files([]))) == set()


def test_statistics(spark):
    log = spark.createDataFrame([("p", 31, 1, "a", 0), ("q", 64, 1, "b", 0), ("r", 17, 0, None, 0)], LOG + ", run_id long")
    r = stats.run_stats(log).first()
    assert (r["min_key"], r["max_key"], r["min_seq"], r["max_seq"], r["n_deletes"]) == ("p", "r", 17, 64, 1)
    keyed = spark.createDataFrame([(f"m{i}", 1, 1, "v", 0, bytearray(f"m{i}".encode() + ts.to_bytes(8, "big"))) for i, ts in enumerate((310, 77, 5000))], LOG + ", run_id long, raw binary")
    r = stats.run_stats(keyed, timestamp=codec.trailer(F.col("raw"))).first()
    assert (r["min_ts"], r["max_ts"]) == (77, 5000)


def test_codecs(spark):
    values = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for descending in (False, True):
        got = [r["v"] for r in df.orderBy(codec.sort_key_long(F.col("v"), descending)).collect()]
        assert got == sorted(values, reverse=descending)
    versions = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, s long")
    assert [tuple(r) for r in versions.orderBy(codec.newest_first_key(F.col("k"), F.col("s"))).collect()] == [("a", 5), ("a", 1), ("b", 2)]
    assert spark.range(1).select(codec.prefix_shared(F.lit("key-0001"), F.lit("key-0123"))).first()[0] == 5


def test_encryption_needs_the_right_key_and_row(spark):
    key, other = F.lit("0" * 32).cast("binary"), F.lit("1" * 32).cast("binary")
    sealed = spark.createDataFrame([("this-is-secret-data",)], "v string").select(codec.encrypt(F.col("v").cast("binary"), key, F.lit("row1").cast("binary")).alias("s"))
    assert b"secret" not in bytes(sealed.first()["s"])
    assert bytes(sealed.select(codec.decrypt(F.col("s"), key, F.lit("row1").cast("binary"))).first()[0]) == b"this-is-secret-data"
    for wrong in (codec.decrypt(F.col("s"), other, F.lit("row1").cast("binary")), codec.decrypt(F.col("s"), key, F.lit("row2").cast("binary"))):
        with pytest.raises(Exception):
            sealed.select(wrong).collect()


def test_bloom_never_misses(spark):
    log = spark.createDataFrame([(i, i % 4) for i in range(400)], "key long, run_id long")
    filters, bits = bloom.build(log)
    found = rows(bloom.may_contain(filters, bits, log.select("key")))
    assert {(i, i % 4) for i in range(400)} <= found
    assert len(found) < 400 + 60


@pytest.mark.parametrize("how", ["ge", "gt"])
def test_seeks_forward_grow_a_frame_row_by_row(spark, how):
    """A frame that ends at the last row is worked out anew for each: the square of the rows of a range."""
    keys = spark.createDataFrame([(x,) for x in (None, 3, 3, 8, 8, 20)], "k long")
    probes = spark.createDataFrame([(x,) for x in (None, 2, 3, 3, 7, 8, 8, 19, 20, 21)], "p long")
    over = {"ge": [None, 3, 3, 3, 8, 8, 8, 20, 20, None], "gt": [None, 3, 8, 8, 8, 20, 20, 20, None, None]}[how]
    for n in (None, 1, 3):
        found = ordered.seek(probes, keys, how, n)
        assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
        assert sorted(map(repr, found.collect())) == sorted(f"Row(probe={p}, found={f})" for p, f in zip((None, 2, 3, 3, 7, 8, 8, 19, 20, 21), over))
