"""The registered queries over the versioned log, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerstone.functions import bloom, codec
from layerstone.operators import compact, lookup, merge, range_delete, stats
from layerstone.plans import ordered
from layerstone.plans.manifest import Store
from layerstone.schema import UPDATE_TYPES
from layerstone.sources import framed_log
from layerstone.sources import tables as src
from layerstone.storage import fresh_folder
from layerstone.streaming import latest, machine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# the derived views in SQL
LOG = "SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, CASE WHEN event_type <> 'error' THEN value END AS value FROM events"
ORDERS = "SELECT o_custkey AS key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS op, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS value FROM orders"
DOCS = "SELECT source AS key, doc_id + 1 AS seq, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS op, CASE WHEN lang <> 'fr' THEN n_chars END AS value FROM documents"
RUNS = f"SELECT *, (seq - 1) // 500 AS run_id FROM ({LOG})"
OVERLAP = f"{RUNS} UNION ALL SELECT key, seq, op, value, run_id + 1000 FROM ({RUNS}) WHERE seq % 3 = 0"
STONES = "SELECT * FROM (VALUES (10, 20, 9950), (15, 40, 9900), (149, 200, 9999999)) AS t(s, e, q)"
HIDDEN = f"SELECT * FROM ({LOG}) l WHERE NOT EXISTS (SELECT 1 FROM ({STONES}) t WHERE l.key >= t.s AND l.key < t.e AND t.q > l.seq)"
CUSTOMERS = "SELECT c_name AS key, c_custkey, c_acctbal FROM customer"
FILES = f"""SELECT run_id AS file_num, CAST(CASE WHEN run_id % 5 = 0 THEN 0 ELSE 1 + run_id % 3 END AS INTEGER) AS level, min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq,
count(*) AS n_rows, CAST(count(*) * 16 * CASE WHEN run_id % 4 = 1 THEN 20000 ELSE 1 END AS BIGINT) AS file_size FROM ({RUNS}) GROUP BY run_id"""


def snapshot_sql(log: str, where: str = "TRUE") -> str:
    return f"SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({log}) WHERE {where}) WHERE rn = 1 AND op = 1"


def query(sql: str | None = None):
    """Registers a query under its own name, with the SQL it must equal."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "customer").select(F.col("c_name").alias("key"), "c_custkey", "c_acctbal")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A manifest over the event runs: levels and sizes spread by run number."""
    s = stats.run_stats(src.event_runs(spark, d))
    level = F.when(F.col("run_id") % 5 == 0, 0).otherwise(1 + F.col("run_id") % 3).cast("int")
    size = F.col("file_size") * F.when(F.col("run_id") % 4 == 1, 20000).otherwise(1)
    return s.select(F.col("run_id").alias("file_num"), level.alias("level"), "min_key", "max_key", "min_seq", "max_seq", "n_rows", size.cast("bigint").alias("file_size"))


def _folder(spark: SparkSession) -> str:
    return fresh_folder(spark, "store")


# --- snapshots and gets


@query(snapshot_sql(LOG))
def snapshot_latest(spark, d):
    return lookup.snapshot(src.event_log(spark, d))


@query(snapshot_sql(LOG, "seq <= 5000"))
def snapshot_at_seq(spark, d):
    return lookup.snapshot(src.event_log(spark, d), 5000)


@query(snapshot_sql(ORDERS))
def snapshot_on_orders(spark, d):
    return lookup.snapshot(src.order_log(spark, d))


@query(snapshot_sql(DOCS))
def snapshot_on_documents(spark, d):
    return lookup.snapshot(src.document_log(spark, d))


@query(f"SELECT key, seq, CAST(op AS TINYINT) AS op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({LOG})) WHERE rn = 1")
def latest_versions(spark, d):
    return lookup.latest(src.event_log(spark, d)).select("key", "seq", "op", "value")


@query(snapshot_sql(LOG, "key = 7"))
def point_get(spark, d):
    return lookup.point_get(src.event_log(spark, d), 7)


@query(snapshot_sql(LOG, "key IN (SELECT n_nationkey FROM nation UNION SELECT -1 UNION SELECT 1000000)"))
def multi_get(spark, d):
    keys = src.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint")).union(spark.createDataFrame([(-1,), (1000000,)], "k bigint"))
    return lookup.multi_get(src.event_log(spark, d), keys)


@query(f"SELECT key, seq, CAST(op AS TINYINT) AS op, value FROM ({LOG}) WHERE key = 7")
def key_history(spark, d):
    return lookup.history(src.event_log(spark, d), 7)


@query(f"SELECT key, seq, CAST(op AS TINYINT) AS op, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version, row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AS is_newest FROM ({LOG})")
def version_rank(spark, d):
    return lookup.version_rank(src.event_log(spark, d))


# --- ordered navigation


@query(snapshot_sql(LOG, "key >= 20 AND key < 40"))
def range_scan(spark, d):
    return lookup.range_scan(src.event_log(spark, d), 20, 40)


@query(f"SELECT key, seq, value, row_number() OVER (ORDER BY key DESC) AS place FROM ({snapshot_sql(LOG)})")
def reverse_scan(spark, d):
    live = lookup.snapshot(src.event_log(spark, d)).withColumn("back", -F.col("key"))
    return ordered.numbered(live, "back", "place").drop("back")


@query(f"SELECT key, seq, value, row_number() OVER (ORDER BY key) AS place FROM ({snapshot_sql(LOG)})")
def forward_scan(spark, d):
    return ordered.numbered(lookup.snapshot(src.event_log(spark, d)), "key", "place")


@query(f"SELECT key, seq, CAST(op AS TINYINT) AS op, value, row_number() OVER (ORDER BY key, seq DESC) AS place FROM ({LOG})")
def version_scan(spark, d):
    """Every version in key order, newest first within a key."""
    return lookup.ordered_versions(src.event_log(spark, d))


@query(f"SELECT key, seq, row_number() OVER (ORDER BY key, seq DESC) AS place FROM (SELECT CAST(key AS VARCHAR) AS key, seq FROM ({LOG}))")
def newest_first_keys(spark, d):
    """The same order by one packed binary key: decimal keys end before any digit sorts."""
    log = src.event_log(spark, d).select(F.col("key").cast("string").alias("key"), "seq")
    packed = log.withColumn("packed", codec.newest_first_key(F.concat("key", F.lit("\0")), F.col("seq")))
    return ordered.numbered(packed, "packed", "place").drop("packed")


@query(f"SELECT count(*) AS live_keys FROM ({snapshot_sql(LOG)})")
def scan_count(spark, d):
    return lookup.snapshot(src.event_log(spark, d)).agg(F.count("*").alias("live_keys"))


@query(f"SELECT key, c_acctbal FROM ({CUSTOMERS}) WHERE key LIKE 'Customer#00000012%'")
def prefix_scan(spark, d):
    return lookup.prefix_scan(_customers(spark, d), "key", "Customer#00000012").select("key", "c_acctbal")


for _how, _test, _order in (("ge", ">=", "ASC"), ("gt", ">", "ASC"), ("le", "<=", "DESC"), ("lt", "<", "DESC")):

    def _seek(spark, d, how=_how):
        return lookup.seek(_customers(spark, d), "key", "Customer#000000100", how).select("key", "c_acctbal")

    def _batched(spark, d, how=_how):
        """Every customer's balance is looked for among all suppliers' balances."""
        return ordered.seek(src.table(spark, d, "customer").select("c_acctbal"), src.table(spark, d, "supplier").select("s_acctbal"), how)

    def _merged(spark, d, how=_how):
        return lookup.seek_live(merge.merge([src.overlapping_runs(spark, d)]), 75, how, src.range_deletes(spark))

    QUERIES[f"seek_{_how}"], QUERIES[f"batched_seek_{_how}"], QUERIES[f"merged_seek_{_how}"] = _seek, _batched, _merged
    ORACLE_SQL[f"seek_{_how}"] = f"SELECT key, c_acctbal FROM ({CUSTOMERS}) WHERE key {_test} 'Customer#000000100' ORDER BY key {_order} LIMIT 1"
    ORACLE_SQL[f"batched_seek_{_how}"] = f"SELECT c_acctbal AS probe, (SELECT {'min' if _order == 'ASC' else 'max'}(s_acctbal) FROM supplier WHERE s_acctbal {_test} c_acctbal) AS found FROM customer"
    ORACLE_SQL[f"merged_seek_{_how}"] = f"SELECT * FROM ({snapshot_sql(HIDDEN)}) WHERE key {_test} 75 ORDER BY key {_order} LIMIT 1"


@query(f"SELECT key, c_acctbal FROM ({CUSTOMERS}) ORDER BY key LIMIT 1")
def seek_first(spark, d):
    return lookup.edge(_customers(spark, d), "key").select("key", "c_acctbal")


@query(f"SELECT key, c_acctbal FROM ({CUSTOMERS}) ORDER BY key DESC LIMIT 1")
def seek_last(spark, d):
    return lookup.edge(_customers(spark, d), "key", last=True).select("key", "c_acctbal")


@query(f"SELECT key, lead(key) OVER (ORDER BY key) AS next FROM ({CUSTOMERS})")
def next_key(spark, d):
    return ordered.neighbours(_customers(spark, d).select("key"), "key", "next", following=True)


@query(f"SELECT key, lag(key) OVER (ORDER BY key) AS prev FROM ({CUSTOMERS})")
def prev_key(spark, d):
    return ordered.neighbours(_customers(spark, d).select("key"), "key", "prev")


@query(f"SELECT count(*) AS violations FROM (SELECT key, lag(key) OVER (ORDER BY c_custkey) AS p FROM ({CUSTOMERS})) WHERE p >= key")
def sortedness_check(spark, d):
    return merge.order_violations(_customers(spark, d), "c_custkey", "key")


# --- merging and numbering


@query(f"SELECT key, seq, CAST(op AS TINYINT) AS op, value FROM (SELECT *, row_number() OVER (PARTITION BY key, seq ORDER BY run_id) AS rn FROM ({OVERLAP})) WHERE rn = 1")
def merge_runs_dedup(spark, d):
    return merge.dedup(src.overlapping_runs(spark, d))


@query(snapshot_sql(OVERLAP))
def merge_runs_snapshot(spark, d):
    odd, even = (src.overlapping_runs(spark, d).filter(F.col("run_id") % 2 == k) for k in (1, 0))
    return lookup.snapshot(merge.merge([odd, even]))


@query("SELECT o_orderkey, 100 + row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders")
def sequence_allocation(spark, d):
    return merge.allocate(src.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", after=100)


# --- range deletes


@query(snapshot_sql(HIDDEN))
def range_tombstone_apply(spark, d):
    return lookup.snapshot(range_delete.apply(src.event_log(spark, d), src.range_deletes(spark)))


@query(ORACLE_SQL["range_tombstone_apply"])
def range_tombstone_apply_many(spark, d):
    """The way for lists that are too long to broadcast."""
    return lookup.snapshot(range_delete.apply(src.event_log(spark, d), src.range_deletes(spark), broadcast=0))


COVERAGE = f"""WITH stones AS ({STONES}), cuts AS (SELECT s AS a FROM stones UNION SELECT e FROM stones), pieces AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM cuts),
segs AS (SELECT a, b, max(q) AS q FROM pieces JOIN stones ON s <= a AND e >= b GROUP BY a, b)
SELECT CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", CAST(q AS BIGINT) AS seq, count(l.key) AS versions, count(DISTINCT l.key) AS keys FROM segs LEFT JOIN ({LOG}) l ON l.key >= a AND l.key < b AND l.seq < q GROUP BY a, b, q"""


@query(COVERAGE)
def range_tombstone_coverage(spark, d):
    return range_delete.coverage(src.event_log(spark, d), src.range_deletes(spark))


@query(COVERAGE)
def range_tombstone_coverage_many(spark, d):
    return range_delete.coverage(src.event_log(spark, d), src.range_deletes(spark), broadcast=0)


# --- statistics, pruning, manifest


@query(f"SELECT run_id, min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS n_rows, count(*) FILTER (WHERE op = 0) AS n_deletes, count(*) * 16 AS file_size FROM ({RUNS}) GROUP BY run_id")
def file_stats(spark, d):
    return stats.run_stats(src.event_runs(spark, d))


@query(f"SELECT file_num FROM ({FILES}) WHERE min_key <= 3 AND max_key >= 3")
def file_prune_point(spark, d):
    return stats.may_hold_key(_files(spark, d), 3).select("file_num")


@query(f"SELECT file_num FROM ({FILES}) WHERE max_key >= 147 AND min_key < 1")
def file_prune_range(spark, d):
    return stats.may_hold_range(_files(spark, d), 147, 1).select("file_num")


@query(f"SELECT file_num FROM ({FILES}) WHERE max_seq >= 9000")
def file_prune_seq(spark, d):
    return stats.may_hold_since(_files(spark, d), 9000).select("file_num")


@query(f"SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS file_size FROM ({FILES}) GROUP BY level")
def level_sizes(spark, d):
    return compact.level_sizes(_files(spark, d))


@query(f"SELECT file_num, level, min_key, max_key FROM ({FILES}) WHERE level = 0")
def level0_files(spark, d):
    return _files(spark, d).filter("level = 0").select("file_num", "level", "min_key", "max_key")


def _pick_sql(files: str, least: int) -> str:
    sizes = f"SELECT level, count(*) AS n, sum(file_size) AS size FROM ({files}) GROUP BY level"
    due = f"SELECT min(level) FROM ({sizes}) WHERE (level = 0 AND n >= {least}) OR (level BETWEEN 1 AND 5 AND size > 10485760 * pow(10.0, level))"
    return f"SELECT level, file_num FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY min_key, file_num) AS place FROM ({files}) WHERE level = ({due})) WHERE level = 0 OR place = 1"


@query(_pick_sql(FILES, 4))
def pick_compaction_l0(spark, d):
    return compact.pick(_files(spark, d))


@query(_pick_sql(f"SELECT * FROM ({FILES}) WHERE level > 0", 4))
def pick_compaction_size(spark, d):
    return compact.pick(_files(spark, d).filter("level > 0"))


@query(f"SELECT level, file_num, min_key, max_key, min_seq, max_seq FROM ({FILES}) WHERE NOT (level = 0) UNION ALL SELECT 1 AS level, file_num + 100000 AS file_num, min_key, max_key, min_seq, max_seq FROM ({FILES}) WHERE level = 0")
def version_edit_apply(spark, d):
    """A version of all files, then an edit of it: level 0 out, the same files in at level 1."""
    store = Store(spark, _folder(spark), T.LongType(), T.DoubleType())
    files = _files(spark, d).withColumns({"kind": F.lit("rows"), "path": F.col("file_num").cast("string")})
    store.commit(files)
    gone = store.manifest().filter("level = 0")
    store.commit(gone.withColumns({"level": F.lit(1), "file_num": F.col("file_num") + 100000}), gone)
    return store.manifest().select("level", "file_num", "min_key", "max_key", "min_seq", "max_seq")


@query(snapshot_sql(LOG))
def store_flush_read(spark, d):
    """Flush to sorted files, commit, read back through the manifest."""
    store = Store(spark, _folder(spark), T.LongType(), T.DoubleType())
    store.flush(src.event_log(spark, d), files=4)
    return lookup.snapshot(store.read())


@query(snapshot_sql(LOG, "key = 7"))
def store_get(spark, d):
    store = Store(spark, _folder(spark), T.LongType(), T.DoubleType())
    store.flush(src.event_log(spark, d), files=4)
    return store.get(7)


@query(snapshot_sql(LOG))
def store_compact(spark, d):
    """Four flushes, one compaction of level 0, old files dropped; what is visible stays the same."""
    store = Store(spark, _folder(spark), T.LongType(), T.DoubleType())
    log = src.event_log(spark, d)
    for k in range(4):
        store.flush(log.filter(F.col("seq") % 4 == k), files=2)
    store.compact(compact.keep_newest_or_since(9950), files=2)
    store.vacuum()
    return lookup.snapshot(store.read())


def _store_with_ranges(spark: SparkSession, d: str) -> Store:
    store = Store(spark, _folder(spark), T.LongType(), T.DoubleType())
    log = src.event_log(spark, d)
    for k in range(4):
        store.flush(log.filter(F.col("seq") % 4 == k), files=2)
    store.delete_ranges(src.range_deletes(spark))
    return store


@query(snapshot_sql(HIDDEN))
def store_range_delete(spark, d):
    """Flushes and range deletes, read back through the manifest."""
    return _store_with_ranges(spark, d).live()


@query(snapshot_sql(HIDDEN))
def store_range_delete_compact(spark, d):
    store = _store_with_ranges(spark, d)
    store.compact(compact.keep_newest_or_since(9950), files=2)
    store.vacuum()
    store.close()
    return store.live()


@query("SELECT CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", CAST(q AS BIGINT) AS seq FROM (" + STONES + ")")
def store_range_scan(spark, d):
    return _store_with_ranges(spark, d).ranges()


@query(f"SELECT * FROM ({snapshot_sql(HIDDEN)}) WHERE key >= 75 ORDER BY key LIMIT 1")
def store_seek(spark, d):
    return _store_with_ranges(spark, d).seek(75, "ge")


@query(snapshot_sql(LOG, "seq <= 5000"))
def store_pinned_version(spark, d):
    """A version that was pinned before a later flush stays as it was."""
    store = Store(spark, _folder(spark), T.LongType(), T.DoubleType())
    log = src.event_log(spark, d)
    pinned = store.flush(log.filter("seq <= 5000"), files=2)
    store.flush(log.filter("seq > 5000"), files=2)
    return store.live(pinned)


# --- compaction


@query(f"SELECT DISTINCT key, seq, CAST(op AS TINYINT) AS op, value FROM ({OVERLAP})")
def compact_keep_all(spark, d):
    return compact.compact(src.overlapping_runs(spark, d), compact.keep_all())


@query(f"SELECT key, seq, CAST(op AS TINYINT) AS op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ({LOG})) WHERE rn = 1 OR seq >= 9950")
def compact_horizon(spark, d):
    return compact.compact(src.event_runs(spark, d), compact.keep_newest_or_since(9950))


@query(snapshot_sql(LOG))
def compact_preserves_snapshot(spark, d):
    return lookup.snapshot(compact.compact(src.event_runs(spark, d), compact.keep_newest_or_since(9950)))


@query(f"SELECT key, count(*) AS deletes FROM ({LOG}) WHERE op = 0 GROUP BY key")
def tombstone_count(spark, d):
    return stats.tombstones(src.event_log(spark, d))


# --- logs and functions


@query(f"SELECT count(*) AS records, count(*) FILTER (WHERE op = 1) AS puts, count(*) FILTER (WHERE op = 0) AS deletes, max(seq) AS max_seq FROM ({LOG})")
def log_replay_stats(spark, d):
    return stats.replay_stats(src.event_log(spark, d))


@query(f"SELECT key, seq, CAST(op AS TINYINT) AS op, CAST(value AS VARCHAR) IS NOT NULL AS has_value FROM ({LOG})")
def framed_log_replay(spark, d):
    """Write the log in frames, read the frames back, replay."""
    log = src.event_log(spark, d).select("seq", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    back = framed_log.replay(framed_log.frame(log))
    return back.select(F.decode("key", "utf-8").cast("bigint").alias("key"), "seq", "op", F.col("value").isNotNull().alias("has_value"))


@query(f"SELECT hex(CAST(key AS VARCHAR)) || lpad(printf('%X', (seq << 8) | op), 16, '0') AS internal_key, key, seq, CAST(op AS TINYINT) AS op FROM ({LOG})")
def internal_key_codec(spark, d):
    inside = codec.internal_key(F.col("key").cast("string"), F.col("seq"), F.col("op"))
    packed = src.event_log(spark, d).select(inside.alias("k"))
    return packed.select(F.hex("k").alias("internal_key"), F.decode(codec.user_key(F.col("k")), "utf-8").cast("bigint").alias("key"), codec.seq_of(F.col("k")).alias("seq"), codec.op_of(F.col("k")).alias("op"))


@query("SELECT event_id FROM events WHERE event_id % 7 = 0")
def crc_filter(spark, d):
    """Rows whose stored checksum no longer fits: every seventh record is damaged."""
    u = src.updates(spark, d).withColumn("crc", codec.checksum(F.col("data")))
    read = u.withColumn("data", F.when(F.col("event_id") % 7 == 0, F.concat("data", F.lit("x").cast("binary"))).otherwise(F.col("data")))
    return read.filter(~codec.intact(F.col("data"), F.col("crc"))).select("event_id")


@query(f"SELECT key, seq, CAST(op AS TINYINT) AS op FROM ({LOG})")
def framed_log_files(spark, d):
    """Write the log to files of frames beside other files, read those that are named as logs by the engine's own data source."""
    folder = _folder(spark)
    log = src.event_log(spark, d).select("seq", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    framed_log.write_files(log, folder)
    log.limit(0).write.mode("append").json(folder)
    spark.dataSource.register(framed_log.FramedLogSource)
    back = spark.read.format("framed_log").option("path", folder).load().filter("rejected is null")
    return back.select(F.decode("key", "utf-8").cast("bigint").alias("key"), "seq", "op")


@query("SELECT event_id, epoch_us(ts) * 1000 AS ts_ns FROM events")
def key_timestamps(spark, d):
    """The timestamp that is packed into the last eight bytes of a key."""
    u = src.updates(spark, d).select("event_id", codec.internal_key(F.col("machine").cast("string"), F.shiftright("registered_ns", 8), F.lit(0)).alias("k"), "registered_ns")
    low = F.col("registered_ns").bitwiseAND(F.lit(255).cast("bigint"))
    return u.select("event_id", codec.trailer(F.col("k")).bitwiseOR(low).alias("ts_ns"))


@query(f"SELECT key, CAST(length(key) - length(ltrim_common) AS INTEGER) AS shared FROM (SELECT key, substr(key, 1 + CAST(list_max([CASE WHEN left(key, i) = left(prev, i) THEN i ELSE 0 END FOR i IN range(0, length(key) + 1)]) AS BIGINT)) AS ltrim_common FROM (SELECT key, lag(key) OVER (ORDER BY key) AS prev FROM ({CUSTOMERS})) WHERE prev IS NOT NULL)")
def prefix_lengths(spark, d):
    """How many leading characters each key shares with the one before it."""
    rows = ordered.neighbours(_customers(spark, d).select("key"), "key", "prev").filter("prev is not null")
    return rows.select("key", codec.prefix_shared(F.col("key"), F.col("prev")).alias("shared"))


@query("SELECT count(*) AS keys, count(*) AS hashes FROM customer")
def key_hashes(spark, d):
    """64-bit hashes tell all keys apart."""
    return _customers(spark, d).agg(F.count("*").alias("keys"), F.count_distinct(codec.hashed(F.col("key"))).alias("hashes"))


@query("SELECT c_custkey, c_name FROM customer")
def key_rotation(spark, d):
    """A data key a market segment, wrapped under one master key, then under another; values sealed before open after."""
    old, new = (F.lit(x * 32).cast("binary") for x in ("a", "b"))
    rows = src.table(spark, d, "customer").withColumn("k", codec.file_key(old, F.col("c_mktsegment")))
    sealed = rows.select("c_custkey", codec.wrap_key(F.col("k"), old).alias("wrapped"), codec.encrypt(F.col("c_name").cast("binary"), F.col("k")).alias("sealed"))
    turned = sealed.withColumn("wrapped", codec.rewrap_key(F.col("wrapped"), old, new))
    return turned.select("c_custkey", F.decode(codec.decrypt(F.col("sealed"), codec.unwrap_key(F.col("wrapped"), new)), "utf-8").alias("c_name"))


@query("SELECT c_custkey, c_name FROM customer")
def value_encryption(spark, d):
    """Encrypt every name under a key, bound to its row, and decrypt again."""
    key, row = F.lit("0123456789abcdef0123456789abcdef").cast("binary"), F.col("c_custkey").cast("string").cast("binary")
    sealed = src.table(spark, d, "customer").select("c_custkey", codec.encrypt(F.col("c_name").cast("binary"), key, row).alias("sealed"))
    return sealed.select("c_custkey", F.decode(codec.decrypt(F.col("sealed"), key, row), "utf-8").alias("c_name"))


@query(f"SELECT DISTINCT p.key, r.run_id FROM (SELECT CAST(n_nationkey AS BIGINT) AS key FROM nation) p JOIN ({RUNS}) r ON r.key = p.key")
def bloom_membership(spark, d):
    """Which runs hold which keys: bloom filters first, exact after."""
    runs = src.event_runs(spark, d)
    filters, bits = bloom.build(runs)
    maybe = bloom.may_contain(filters, bits, src.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint")))
    return maybe.join(runs.select("key", "run_id"), ["key", "run_id"], "left_semi")


@query(f"SELECT sort_key FROM (SELECT lpad(printf('%X', c_custkey), 15, '0') AS k, '8' || lpad(printf('%X', c_custkey), 15, '0') AS sort_key FROM customer)")
def order_preserving_key(spark, d):
    return src.table(spark, d, "customer").select(codec.sort_key_long(F.col("c_custkey")).alias("sort_key"))


# --- state machines and streams


@query("SELECT name, count(*) AS n FROM events JOIN (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(UPDATE_TYPES)) + ") AS t(type, name) ON event_id % 13 = t.type GROUP BY name")
def update_type_routing(spark, d):
    names = spark.createDataFrame(list(enumerate(UPDATE_TYPES)), "type int, name string")  # 13 rows
    return src.updates(spark, d).join(F.broadcast(names), "type").groupBy("name").agg(F.count("*").alias("n"))


FOLD = "SELECT user_id AS machine, count(*) AS steps, CAST(arg_max(event_id % 13, event_id) AS INTEGER) AS last_type, max(epoch_us(ts)) * 1000 AS last_ns FROM events GROUP BY user_id"


@query(FOLD)
def fsm_fold(spark, d):
    return machine.fold_counting(src.updates(spark, d))


def _states(frame: DataFrame) -> DataFrame:
    state = F.from_json("state", "steps long, last_type int, last_ns long")
    return frame.select("machine", state.alias("s")).select("machine", "s.steps", "s.last_type", "s.last_ns")


@query(FOLD)
def fsm_run(spark, d):
    """The same machine as a user-defined step function."""
    return _states(machine.fold(src.updates(spark, d), machine.counting))


@query("SELECT machine, registered_ns, step FROM (SELECT user_id AS machine, epoch_us(ts) * 1000 AS registered_ns, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) WHERE event_id % 13 = 5")
def fsm_emitted(spark, d):
    """What the machine's steps emit: an alert an error."""
    return _alerts(machine.emitted(src.updates(spark, d), machine.counting))


def _alerts(frame: DataFrame) -> DataFrame:
    return frame.select("machine", "registered_ns", F.from_json("emitted", "alert string, step long")["step"].alias("step"))


def _streamed(spark: SparkSession, rows: DataFrame, transform, order: str, folder: str | None = None) -> DataFrame:
    """Stream the first half of rows through transform, then the second after a restart from the checkpoint; all that was emitted, by batch.

    Stateful streams need the RocksDB state store; the session's own setting is put back after.
    """
    folder, name = folder or _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _two_starts(spark, rows, transform, order, folder)
    finally:
        spark.conf.set(name, before)


def _two_starts(spark: SparkSession, rows: DataFrame, transform, order: str, folder: str) -> DataFrame:
    middle = rows.agg(F.percentile_approx(order, 0.5)).first()[0] or 0

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    for half in (F.col(order) <= middle, F.col(order) > middle):
        rows.filter(half).write.mode("append").parquet(f"{folder}/in")
        stream = transform(latest.source(spark.readStream, rows.schema, f"{folder}/in"))
        stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(snapshot_sql(LOG))
def stream_latest_value(spark, d):
    out = _streamed(spark, src.event_log(spark, d), latest.latest_values, "seq")
    return lookup.snapshot(out)


@query(snapshot_sql(DOCS))
def stream_latest_text(spark, d):
    """The same on string keys and integer values."""
    return lookup.snapshot(_streamed(spark, src.document_log(spark, d), latest.latest_values, "seq"))


def _machine_stream(spark: SparkSession, d: str, folder: str | None = None) -> DataFrame:
    return _streamed(spark, src.updates(spark, d).drop("data"), lambda s: machine.run_stream(s, machine.counting), "event_id", folder)


@query(FOLD)
def stream_machine(spark, d):
    newest = _machine_stream(spark, d).filter(F.col("kind") == machine.STATE).groupBy("machine").agg(F.max_by("body", "batch").alias("state"))
    return _states(newest)


@query(ORACLE_SQL["fsm_emitted"])
def stream_emitted(spark, d):
    out = _machine_stream(spark, d).filter(F.col("kind") == machine.EMITTED)
    return _alerts(out.select("machine", "registered_ns", F.col("body").alias("emitted")))


@query(FOLD)
def fsm_snapshot(spark, d):
    """The machines' states as the stopped stream's checkpoint holds them."""
    folder = _folder(spark)
    _machine_stream(spark, d, folder)
    return _states(machine.snapshot(spark, f"{folder}/checkpoint"))


@query(snapshot_sql(LOG))
def stream_to_store(spark, d):
    """Micro-batches become versions of a store; a second start adds nothing."""
    folder, log = _folder(spark), src.event_log(spark, d)
    store = Store(spark, f"{folder}/store", T.LongType(), T.DoubleType())
    log.repartition(2).write.parquet(f"{folder}/in")
    for _ in range(2):
        latest.to_store(latest.source(spark.readStream, log.schema, f"{folder}/in", 1), store, f"{folder}/checkpoint").awaitTermination()
    return store.live()


@query(f"SELECT key, seq, CAST(op AS TINYINT) AS op, value FROM ({LOG})")
def stream_ingest(spark, d):
    """Ingest a stream into a log; a second start from the checkpoint adds nothing."""
    folder = _folder(spark)
    log = src.event_log(spark, d)
    log.write.parquet(f"{folder}/in")
    for _ in range(2):
        latest.ingest(latest.source(spark.readStream, log.schema, f"{folder}/in"), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{folder}/log")
