"""Fixed schemas of the versioned log and its side tables."""

from __future__ import annotations

from pyspark.sql import types as T

DELETE, PUT = 0, 1
ROWS, RANGES = "rows", "ranges"
LEVELS = 7

#: Update types by number.
UPDATE_TYPES = ["Custom", "Network", "Logger", "Timer", "Signal", "Error", "Storage", "System", "User", "Lifecycle", "Metrics", "Config", "Health"]


def kv_log(key: T.DataType = T.BinaryType(), value: T.DataType = T.BinaryType()) -> T.StructType:
    """One row a write: op 1 puts value, op 0 deletes key; seq orders versions, newest is largest."""
    return T.StructType([
        T.StructField("key", key, False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.ByteType(), False),
        T.StructField("value", value), T.StructField("run_id", T.LongType()), T.StructField("level", T.IntegerType()),
    ])


def range_tombstones(key: T.DataType = T.BinaryType()) -> T.StructType:
    """Deletes every version of keys in [start, end) that is older than seq."""
    return T.StructType([T.StructField("start", key, False), T.StructField("end", key, False), T.StructField("seq", T.LongType(), False)])


def manifest(key: T.DataType = T.BinaryType()) -> T.StructType:
    """One row a file of one version; min and max are null for an empty file. kind tells files of rows from files of range deletes."""
    return T.StructType([
        T.StructField("file_num", T.LongType(), False), T.StructField("level", T.IntegerType(), False), T.StructField("kind", T.StringType(), False), T.StructField("path", T.StringType(), False),
        T.StructField("file_size", T.LongType(), False), T.StructField("n_rows", T.LongType(), False),
        T.StructField("min_key", key), T.StructField("max_key", key), T.StructField("min_seq", T.LongType()), T.StructField("max_seq", T.LongType()),
    ])


UPDATES = T.StructType([T.StructField("registered_ns", T.LongType(), False), T.StructField("type", T.IntegerType(), False), T.StructField("data", T.BinaryType())])
