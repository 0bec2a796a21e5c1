"""Files, manifests, framed logs and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerstone.functions import codec
from layerstone.operators import compact, lookup
from layerstone.options import Options
from layerstone.plans.manifest import Store
from layerstone.sources import framed_log
from layerstone.streaming import latest, machine

LOG = "key long, seq long, op tinyint, value double"


def rows(df):
    return {tuple(r) for r in df.collect()}


def make(spark, path):
    return Store(spark, f"file://{path}", T.LongType(), T.DoubleType())


def test_flush_prune_compact_vacuum(spark, tmp_path):
    store = make(spark, tmp_path)
    assert store.versions() == [] and store.read().count() == 0
    ops = [(k, s * 100 + k, int(s != 2 or k % 5 != 0), float(s)) for s in range(4) for k in range(50)]
    log = spark.createDataFrame([(k, s, o, v if o else None) for k, s, o, v in ops], LOG)
    for s in range(4):
        store.flush(log.filter(F.floor(F.col("seq") / 100) == s), files=3)
    want = rows(lookup.snapshot(log))
    assert rows(lookup.snapshot(store.read())) == want
    m = store.manifest()
    assert m.select("file_num").distinct().count() == m.count()
    for f in m.collect():
        part = spark.read.parquet(f["path"])
        assert part.filter((F.col("key") < f["min_key"]) | (F.col("key") > f["max_key"])).count() == 0
    assert rows(store.get(7)) == {r for r in want if r[0] == 7}
    assert rows(store.read(low=10, high=20).select("key").distinct()) == {(k,) for k in range(10, 20)}
    assert store.read(since=300).filter("seq < 300").count() == 0
    pinned = store.versions()[-1]
    assert store.compact(compact.keep_newest_or_since(300)) == pinned + 1
    assert rows(lookup.snapshot(store.read())) == want
    assert rows(lookup.snapshot(store.read(pinned))) == want  # a pinned version stays readable
    assert {r["level"] for r in store.manifest().collect()} == {1}
    assert store.compact(compact.keep_all()) is None
    assert store.vacuum()
    assert rows(lookup.snapshot(store.read())) == want


def test_range_deletes_in_the_store(spark, tmp_path):
    store = make(spark, tmp_path)
    ops = [(k, s * 100 + k, 1, float(s)) for s in range(4) for k in range(30)]
    stones = [(3, 9, 250), (5, 20, 150), (25, 26, 9999), (7, 7, 9999)]
    log, table = spark.createDataFrame(ops, LOG), spark.createDataFrame(stones, "start long, end long, seq long")
    for s in range(4):
        store.flush(log.filter(F.floor(F.col("seq") / 100) == s), files=2)
    before = store.versions()[-1]
    store.delete_ranges(table)
    assert rows(store.ranges()) == set(stones[:3]) and store.ranges(before).count() == 0
    seen = [o for o in ops if not any(a <= o[0] < b and q > o[1] for a, b, q in stones)]
    want = {k: max((o[1], o[3]) for o in seen if o[0] == k) for k in {o[0] for o in seen}}
    live = {(k, *v) for k, v in want.items()}
    assert rows(store.live()) == live and (25, 325, 3.0) in rows(store.live(before))
    assert rows(store.get(25)) == set() and rows(store.get(4)) == {(4, *want[4])}
    assert rows(store.seek(25, "ge")) == {(26, *want[26])}
    store.compact(compact.keep_all())
    assert rows(store.live()) == live
    assert rows(store.read()) == set(seen)  # hidden versions are gone from the files


def test_a_tagged_flush_is_committed_once(spark, tmp_path):
    store = make(spark, tmp_path)
    batch = spark.createDataFrame([(1, 1, 1, 1.0)], LOG)
    assert store.flush(batch, tag="s-0") == store.flush(batch, tag="s-0")
    store.write(spark.createDataFrame([(2, 2, 1, 2.0)], LOG), tag="s-1")  # written, but its commit never came
    store.flush(spark.createDataFrame([(2, 2, 1, 2.0)], LOG), tag="s-1")
    assert rows(store.live()) == {(1, 1, 1.0), (2, 2, 2.0)} and store.read().count() == 2


def test_damaged_file_fails_loudly(spark, tmp_path):
    store = make(spark, tmp_path)
    store.flush(spark.createDataFrame([(1, 1, 1, 1.0)], LOG), files=1)
    path = store.manifest().first()["path"].removeprefix("file://").removeprefix("file:")
    raw = bytearray(open(path, "rb").read())
    raw[-4:] = b"XXXX"
    open(path, "wb").write(raw)
    import os

    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(Exception):
        store.read().collect()


def test_framed_log_round_trip_and_bad_frames(spark, tmp_path):
    records = [framed_log.encode(s, s % 3 > 0, f"key-{s}".encode(), b"v" * s) for s in range(1, 6)]
    damaged = bytearray(b"".join(records))
    damaged[len(records[0]) + 12] ^= 1
    (tmp_path / "wal-1.log").write_bytes(b"".join(records) + records[0][:10])
    (tmp_path / "wal-2.log").write_bytes(damaged)
    (tmp_path / "other.txt").write_bytes(b"no log")
    blocks = framed_log.files(spark, str(tmp_path))
    assert blocks.count() == 2
    read = framed_log.read(blocks)
    assert sorted(r["rejected"] for r in read.filter("rejected is not null").collect()) == ["bad checksum", "torn payload"]
    assert sorted(r["seq"] for r in framed_log.replay(blocks).collect()) == [1, 1, 2, 3, 3, 4, 4, 5, 5]
    spark.dataSource.register(framed_log.FramedLogSource)
    again = spark.read.format("framed_log").option("path", f"file://{tmp_path}").load()
    same = lambda df: sorted(map(repr, df.collect()))
    assert same(again) == same(read)
    log = spark.createDataFrame([(1, 1, "a", "x"), (2, 0, "a", None)], "seq long, op int, key string, value string")
    assert {(r["seq"], r["op"], bytes(r["key"])) for r in framed_log.replay(framed_log.frame(log)).collect()} == {(1, 1, b"a"), (2, 0, b"a")}


def test_stream_takes_the_newest_whatever_the_order(spark, tmp_path):
    ops = [(1, 5, 1, 5.0), (1, 3, 1, 3.0), (2, 4, 0, None), (1, 5, 1, 5.0), (2, 1, 1, 1.0), (3, 2, 1, 2.0)]
    for i, batch in enumerate((ops[:2], ops[2:4], ops[4:])):
        spark.createDataFrame(batch, LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = []
    q = latest.latest_values(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend((n, *r) for r in df.collect()))
    q.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    newest = {k: (s, o) for _, k, s, o, _ in out}
    assert newest == {1: (5, 1), 2: (4, 0), 3: (2, 1)}
    assert len(out) == 3  # older and repeated writes emit nothing


def test_machine_in_batch_equals_plain_fold(spark):
    updates = [(m, t, t % 13, t) for m in range(3) for t in range(m, 40, 3)]
    df = spark.createDataFrame(updates, "machine long, registered_ns long, type int, event_id long")

    def step(state, update):
        state = state or {"n": 0, "types": []}
        return {"n": state["n"] + 1, "types": [*state["types"][-2:], update["type"]]}, [{"at": state["n"]}] * (update["type"] % 3)

    import json

    got = {r["machine"]: json.loads(r["state"]) for r in machine.fold(df.repartition(5), step).collect()}
    for m in range(3):
        state = None
        for u in sorted(x for x in updates if x[0] == m):
            state, _ = step(state, {"type": u[2]})
        assert got[m] == state
    assert machine.fold(df.limit(0), step).count() == 0
    sent = sorted((r["machine"], r["registered_ns"], json.loads(r["emitted"])["at"]) for r in machine.emitted(df, step).collect())
    assert sent == sorted((m, t, i) for m in range(3) for i, t in enumerate(range(m, 40, 3)) for _ in range(t % 13 % 3))


@pytest.mark.parametrize("wrong", [{"page_bytes": 0}, {"level0_files": -1}, {"bloom_keys": "many"}, {"codec": "rar"}, {"order": "locale"}, {"page_bytes": 2 << 30}])
def test_options_are_checked(wrong):
    assert Options().writer()["compression"] == "zstd"
    with pytest.raises(ValueError):
        Options(**wrong)


def test_checksums(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),)], "d binary").withColumn("c", codec.checksum(F.col("d")))
    assert df.filter(codec.intact(F.col("d"), F.col("c"))).count() == 1
    assert df.filter(codec.intact(F.concat("d", F.lit("x").cast("binary")), F.col("c"))).count() == 0


def test_blocks_of_frames_are_small_and_whole(spark):
    """A worker is sent up to 10,000 blocks at once, so their size, not the partition's, must bound what it holds."""
    value = F.when(F.col("id") == 778, F.repeat(F.lit("x"), 3 * framed_log.BLOCK)).otherwise(F.col("id").cast("string"))
    log = spark.range(25_000, numPartitions=1).select(F.col("id").alias("seq"), (F.col("id") % 3 > 0).cast("int").alias("op"), F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 > 0, value).alias("value"))
    blocks = framed_log.frame(log)
    sizes = sorted(r[0] for r in blocks.select(F.length("frames")).collect())
    assert sizes[-2] <= framed_log.BLOCK < sizes[-1] < 4 * framed_log.BLOCK  # one record is longer than a block
    back = framed_log.replay(blocks).selectExpr("cast(key as string) key", "seq", "cast(op as int) op", "cast(value as string) value")
    assert back.exceptAll(log.select(*back.columns)).count() == 0 and back.count() == 25_000


def test_newest_values_need_no_python_and_keep_nan(spark, tmp_path):
    nan = float("nan")
    for i, batch in enumerate(([(1, -5, 1, nan), (2, 3, 1, 3.0)], [(1, -5, 1, 7.0), (1, -6, 1, 1.0), (2, 4, 1, None), (None, 1, 0, None)])):
        spark.createDataFrame(batch, LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    out = []
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        found = latest.latest_values(stream)
        assert "Python" not in (plan := found._jdf.queryExecution().analyzed().toString()) and "Pandas" not in plan and "StateIn" not in plan
        q = found.writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend((n, *r) for r in df.collect()))
        q.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(repr, out)) == sorted(map(repr, [(0, 1, -5, 1, nan), (0, 2, 3, 1, 3.0), (1, 2, 4, 1, None), (1, None, 1, 0, None)]))


def test_a_streamed_machine_gets_packed_updates_with_their_nulls(spark, tmp_path):
    import json

    rows = [(i % 3, 1000 - i // 6, None if i % 5 == 0 else i % 13, i) for i in range(300)]
    schema = "machine long, registered_ns long, type int, event_id long"
    df = spark.createDataFrame(rows, schema).repartition(5)
    assert machine._packed(df).count() == 3  # not a row an update
    df.write.parquet(f"{tmp_path}/in")

    def step(state, update):
        return {"types": [*(state or {"types": []})["types"], update["type"]]}, [{"id": update["event_id"]}] * (update["event_id"] % 50 == 7)

    out = []
    q = machine.run_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), step).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect()))
    q.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    want = {m: json.dumps({"types": [r[2] for r in sorted((r for r in rows if r[0] == m), key=lambda r: (r[1], r[3]))]}) for m in range(3)}
    assert {r["machine"]: r["body"] for r in out if r["kind"] == machine.STATE} == want
    assert {r["machine"]: r["body"] for r in machine.snapshot(spark, f"{tmp_path}/check").withColumnRenamed("state", "body").collect()} == want
    assert sorted((r["machine"], r["registered_ns"], json.loads(r["body"])["id"]) for r in out if r["kind"] == machine.EMITTED) == sorted((r[0], r[1], r[3]) for r in rows if r[3] % 50 == 7)
