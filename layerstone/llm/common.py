"""Helpers shared by the pipeline operators: table reads, hashing words, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerstone.storage import materialize, shared_dir

__all__ = ["ARROW_BYTES", "batches", "fresh", "materialize", "read", "shared_dir", "small", "small_batches", "tokenizer_file", "trimmed", "word_count"]

#: Bytes of an Arrow batch, and rows that are broadcast at most.
ARROW_BYTES, BROADCAST_ROWS = 1 << 20, 500_000

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary is; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows, marked for broadcast only if they are few; rows are materialized, so counting is cheap."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Words in a text as BIGINT; null counts 0.

    Counts the starts of words: every word but its first character is dropped, then what is
    not white space remains. Stays in the JVM and builds one string, not an array of words.
    """
    starts = F.regexp_replace(text, r"([^\x20\x09-\x0D])[^\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(F.translate(starts, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("bigint")


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session limited to ARROW_BYTES where the session leaves Spark's default.

    Python workers and the JVM each hold whole batches, the JVM in several direct buffers of up to twice
    the size that its allocators keep, so this bounds what a task needs however long texts are. Spark reads the setting when a plan is run, so it stays set for the session; a session
    that names its own size keeps it.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == f"{64 << 20}b":  # Spark's own
        conf.set(name, str(ARROW_BYTES))
    return df


def batches(batch, limit_bytes: int = 2 << 20, column: int = 1):
    """Slices of an Arrow batch of about limit_bytes of text each, so memory follows the texts and not the row count."""
    n, start, used = batch.num_rows, 0, 0
    sizes = _lengths(batch.column(column))
    for i in range(n):
        if used and used + sizes[i] > limit_bytes:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += sizes[i]
    if n > start:
        yield batch.slice(start, n - start)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, which gives back to the system what a worker holds free once its task is done.

    Workers are kept for later tasks in turn, so without it each would hold on to the most that any
    task of any operator has needed.
    """

    def whole(parts: Iterator) -> Iterator:
        yield from run(parts)
        give_back()

    return whole


def give_back() -> None:
    """Free memory that the allocators of this process hold goes back to the system, where they can do that."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _lengths(column) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()
