"""Redo logs in a framed byte format: a durable sink, a checked source, and replay.

A record is crc32 (4 bytes) and length (4 bytes) of its payload, little endian, then the payload:
seq (8 bytes), op (1), key length (4), key, value length (4), value. Bad frames come back as rejected
rows with the reason, never silently as the end of the log; files are written by Spark's own writers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAME, HEAD, LENGTH = struct.Struct("<II"), struct.Struct("<qBI"), struct.Struct("<I")
RECORDS = "seq long, op tinyint, key binary, value binary, rejected string"
#: Bytes of a block of frames (a longer record is a block of its own), as an Arrow batch may bring a worker 10,000 of them; records, and bytes of keys and values, that a worker holds decoded.
BLOCK, HELD_ROWS, HELD_BYTES = 4 << 10, 5_000, 1 << 20


def encode(seq: int, op: int, key: bytes, value: bytes | None) -> bytes:
    payload = HEAD.pack(seq, op, len(key)) + key + LENGTH.pack(len(value or b"")) + (value or b"")
    return FRAME.pack(zlib.crc32(payload), len(payload)) + payload


def decode(data: bytes) -> Iterator[tuple[int | None, int | None, bytes | None, bytes | None, str | None]]:
    """Records in order; a broken frame gives a rejected row and reading goes on after it where its length allows."""
    at = 0
    while at < len(data):
        if at + FRAME.size > len(data):
            yield None, None, None, None, "torn frame"
            return
        crc, n = FRAME.unpack_from(data, at)
        payload = data[at + FRAME.size : at + FRAME.size + n]
        at += FRAME.size + n
        if len(payload) < n:
            yield None, None, None, None, "torn payload"
            return
        if zlib.crc32(payload) != crc or n < HEAD.size + LENGTH.size:
            yield None, None, None, None, "bad checksum"
            continue
        seq, op, k = HEAD.unpack_from(payload)
        key = payload[HEAD.size : HEAD.size + k]
        value = payload[HEAD.size + k + LENGTH.size :]
        yield seq, op, key, value if op else None, None


def frame(log: DataFrame) -> DataFrame:
    """frames: the log's records framed in write order, a row a block of whole frames."""

    def blocks(part: pa.RecordBatch) -> Iterator[bytes]:
        block = bytearray()
        for at in range(0, part.num_rows, HELD_ROWS):
            for row in zip(*(c.to_pylist() for c in part.slice(at, HELD_ROWS).columns)):
                record = encode(*row)
                if block and len(block) + len(record) > BLOCK:
                    yield bytes(block)
                    block.clear()
                block += record
        if block:
            yield bytes(block)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(blocks(part), pa.binary())], names=["frames"])

    columns = [F.col("seq"), F.col("op").cast("int"), F.col("key").cast("binary"), F.col("value").cast("binary")]
    return log.select(*columns).sortWithinPartitions("seq").mapInArrow(run, "frames binary")


def read(blocks: DataFrame) -> DataFrame:
    """seq, op, key, value, rejected from a binary column (content of binaryFile, or frames)."""
    column = "content" if "content" in blocks.columns else "frames"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int8(), pa.binary(), pa.binary(), pa.string()))], names=["seq", "op", "key", "value", "rejected"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part in parts:
            for data in part.column(0):
                for row in decode(data.as_py() or b""):
                    rows.append(row)
                    held += len(row[2] or b"") + len(row[3] or b"")
                    if len(rows) >= HELD_ROWS or held >= HELD_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return blocks.select(column).mapInArrow(run, RECORDS)


def files(spark: SparkSession, folder: str, pattern: str = "wal-*.log") -> DataFrame:
    """The framed log files of a folder, chosen by name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def replay(blocks: DataFrame) -> DataFrame:
    """key, seq, op, value of all readable records; order does not matter, seq is in each."""
    return read(blocks).filter("rejected is null").select("key", "seq", "op", "value")


class LogFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FramedLogReader(DataSourceReader):
    """One partition a log file, read record by record: a file may be larger than memory."""

    def __init__(self, folder: str, pattern: str):
        self.folder, self.pattern = folder, pattern

    def partitions(self) -> list[LogFile]:
        import fnmatch

        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(folder))
        return [LogFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern)]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_stream(partition.path) as stream:
            yield from decode_stream(stream.read)


def decode_stream(take) -> Iterator[tuple]:
    """As decode(), from a function that gives the next n bytes."""
    while head := take(FRAME.size):
        payload = take(FRAME.unpack(head)[1]) if len(head) == FRAME.size else b""
        yield from decode(head + payload)


class FramedLogSource(DataSource):
    """spark.read.format("framed_log").option("path", uri).option("pattern", "wal-*.log"), once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "framed_log"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> FramedLogReader:
        return FramedLogReader(self.options["path"], self.options.get("pattern", "wal-*.log"))


def write_files(log: DataFrame, folder: str) -> None:
    """The log's frames as files wal-<partition>.log, each written aside and renamed into place."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        task = TaskContext.get()
        target, n = f"{path}/wal-{task.partitionId():06}.log", 0
        aside = f"{path}/.{task.taskAttemptId()}.part"
        with system.open_output_stream(aside, buffer_size=1 << 20) as out:
            for part in parts:
                for data in part.column(0):
                    n += out.write(data.as_buffer())
        system.move(aside, target)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["bytes"])

    frame(log).mapInArrow(run, "bytes long").agg(F.sum("bytes")).collect()
