"""Streams of writes: newest value per key, ingestion into a log or a store, restart from checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from layerstone.plans.manifest import Store


def latest_values(writes: DataFrame) -> DataFrame:
    """The stream of newest versions (key, seq, op, value) of a stream of writes; key and value keep their types.

    A key is emitted whenever a newer write comes; older and repeated writes change nothing. Spark's own
    aggregation holds the state, and with it the time of the batch that brought the newest write, the
    first one of equal writes: what an earlier batch brought is not emitted again. Seq and time are one
    number, so that all is aggregated by hash. A batch that is run again after a failure has its time again.
    """
    now = F.unix_millis(F.current_timestamp())  # the batch's time in every row of it
    high, low = (c.cast("decimal(19,0)") for c in (F.col("seq"), F.col("at")))
    place = high * F.lit(str(1 << 63)).cast("decimal(19,0)") - low
    rows = writes.selectExpr("key", "seq", "cast(op as int) op", "value").withColumn("at", now).withColumn("place", place.cast("decimal(38,0)"))
    newest = rows.groupBy("key").agg(F.max("seq").alias("seq"), *(F.max_by(c, "place").alias(c) for c in ("op", "value", "at")))
    return newest.filter(F.col("at") == now).select("key", "seq", "op", "value")


def ingest(writes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of writes to a parquet log, each exactly once; a restart goes on from the checkpoint."""
    return writes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def to_store(writes: DataFrame, store: Store, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Flush every micro-batch of a stream of writes to a store as one version. A batch that comes again after a failure is committed once."""

    def sink(batch: DataFrame, number: int) -> None:
        store.flush(batch, tag=f"{name}-{number}")

    return writes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def source(reader: DataStreamReader, schema: T.StructType | str, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a folder of parquet files."""
    reader = reader.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
