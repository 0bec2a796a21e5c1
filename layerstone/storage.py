"""Shared storage: the folder that all executors reach, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows to a file of a table whose rows are known; otherwise estimated bytes to a file, and files a core, whichever makes more.
ROWS_PER_FILE, BYTES_PER_FILE, FILES_PER_CORE = 1_000_000, 32 << 20, 4


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, it is a temporary folder of ours in a session on one machine, and an error on a cluster."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='layerstone-')}"
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/layerstone/{label}-{uuid.uuid4().hex}"


def _fewer_files(df: DataFrame) -> DataFrame:
    """df in no more partitions than its estimated bytes or four times the cores ask for. A no-op for large tables, whose partitions are fewer than that."""
    held = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(min((1 << 31) - 1, max(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, int(held) // BYTES_PER_FILE)))


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder once and read it back: cuts lineage and survives lost executors.

    rows, about how many there are, where they are known: the result is then dealt to as many files as
    it needs, after the work on it is done. The tasks that work it out stay as many as they were.
    """
    path = fresh_folder(df.sparkSession, label)
    (_fewer_files(df) if rows is None else df.repartition(max(1, -(-rows // ROWS_PER_FILE)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
