"""A store of sorted parquet files with a versioned manifest.

Files hold rows or range deletes, which the manifest tells apart; reads of live rows apply both. Data files are immutable. A version is a folder versions/v<number> with one manifest row a file; it
is written aside and renamed into place, which is the commit. One writer at a time; readers pin a
version. All file work goes through Hadoop's FileSystem, so any scheme does that Spark can write to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerstone import schema
from layerstone.functions.bloom import writer_options
from layerstone.operators import compact as compaction
from layerstone.operators import range_delete
from layerstone.operators.lookup import seek, snapshot
from layerstone.options import Options
from layerstone.storage import materialize


class Store:
    def __init__(self, spark: SparkSession, path: str, key: T.DataType = T.BinaryType(), value: T.DataType = T.BinaryType(), options: Options = Options()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.log_schema = T.StructType([f for f in schema.kv_log(key, value) if f.name not in ("run_id", "level")])
        self.ranges_schema = schema.range_tombstones(key)
        self.manifest_schema = schema.manifest(key)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path, hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._fs(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v")) if fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> DataFrame:
        """The files of a version, the newest unless given; empty before the first commit."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.manifest_schema)
        return self.spark.read.schema(self.manifest_schema).parquet(f"{self.path}/versions/v{known[-1] if version is None else version}")

    def commit(self, added: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """A new version: the newest one less deleted (level, file_num), plus added. Renaming into place is the commit."""
        files = self.manifest()
        if deleted is not None:
            files = files.join(deleted.select("level", "file_num"), ["level", "file_num"], "left_anti")
        if added is not None:
            files = files.unionByName(added)
        number = (self.versions() or [0])[-1] + 1
        aside = f"{self.path}/pending-{uuid.uuid4().hex}"
        files.select(*self.manifest_schema.names).orderBy("level", "min_key").coalesce(1).write.parquet(aside)
        source, fs = self._fs(aside)
        target, _ = self._fs(f"{self.path}/versions/v{number}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"version {number} was committed by another writer")
        return number

    def _numbered(self, files: DataFrame, level: int, kind: str) -> DataFrame:
        """Manifest rows of written files; a row a file, so one task may number them."""
        first = self.manifest().agg(F.max("file_num")).first()[0] or 0
        place = F.row_number().over(Window.orderBy("path")).cast("bigint")
        return files.withColumns({"file_num": place + first, "level": F.lit(level), "kind": F.lit(kind)}).select(*self.manifest_schema.names)

    def write(self, log: DataFrame, level: int = 0, files: int | None = None, tag: str | None = None) -> DataFrame:
        """Sorted, range-partitioned files of log, as manifest rows that are not committed yet."""
        folder = f"{self.path}/data/{tag or uuid.uuid4().hex}"
        rows = log.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.log_schema])
        dealt = rows.repartitionByRange(files, "key") if files else rows.repartitionByRange("key")
        sorted_rows = dealt.sortWithinPartitions(F.col("key").asc(), F.col("seq").desc())
        sorted_rows.write.mode("overwrite").options(**writer_options("key", self.options.bloom_keys), **self.options.writer()).parquet(folder)
        written = self.spark.read.schema(self.log_schema).parquet(folder).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"))
        stats = written.groupBy("path", "file_size").agg(F.count("*").alias("n_rows"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
        return self._numbered(stats, level, schema.ROWS)

    def flush(self, log: DataFrame, files: int | None = None, tag: str | None = None) -> int:
        """Write log as level 0 files and commit them. A tag names the write: one that is committed already changes nothing."""
        if tag and not self.manifest().filter(F.col("path").contains(f"/data/{tag}/")).isEmpty():
            return self.versions()[-1]
        return self.commit(self.write(log, 0, files, tag))

    def delete_ranges(self, tombstones: DataFrame) -> int:
        """Commit range deletes (start, end, seq): each hides older versions of the keys in [start, end). Empty ranges are left out."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        real = tombstones.filter(F.col("start") < F.col("end")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.ranges_schema])
        real.repartitionByRange("start").sortWithinPartitions("start").write.options(**self.options.writer()).parquet(folder)
        written = self.spark.read.schema(self.ranges_schema).parquet(folder).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"))
        stats = written.groupBy("path", "file_size").agg(F.count("*").alias("n_rows"), F.min("start").alias("min_key"), F.max("end").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
        return self.commit(self._numbered(stats, 0, schema.RANGES))

    def _files(self, of: T.StructType, files: DataFrame) -> DataFrame:
        paths = [r["path"] for r in files.select("path").collect()]  # names of the files to read, as any scan's planning has them
        return self.spark.read.schema(of).parquet(*paths) if paths else self.spark.createDataFrame([], of)

    def read(self, version: int | None = None, low=None, high=None, since: int | None = None) -> DataFrame:
        """The log rows of a version. Bounds choose files by the manifest, then row groups by parquet statistics."""
        files = self.manifest(version).filter(F.col("kind") == schema.ROWS)
        if low is not None:
            files = files.filter(F.col("max_key") >= F.lit(low))
        if high is not None:
            files = files.filter(F.col("min_key") < F.lit(high))
        if since is not None:
            files = files.filter(F.col("max_seq") >= since)
        rows = self._files(self.log_schema, files)
        if low is not None:
            rows = rows.filter(F.col("key") >= F.lit(low))
        if high is not None:
            rows = rows.filter(F.col("key") < F.lit(high))
        return rows if since is None else rows.filter(F.col("seq") >= since)

    def ranges(self, version: int | None = None) -> DataFrame:
        """The range deletes (start, end, seq) of a version."""
        return self._files(self.ranges_schema, self.manifest(version).filter(F.col("kind") == schema.RANGES))

    def _visible(self, rows: DataFrame, version: int | None) -> DataFrame:
        files = self.manifest(version).filter(F.col("kind") == schema.RANGES)
        return rows if files.isEmpty() else range_delete.apply(rows, self.ranges(version))

    def live(self, version: int | None = None, low=None, high=None) -> DataFrame:
        """key, seq, value of every key that is there: newest versions less deletes and range deletes."""
        return snapshot(self._visible(self.read(version, low, high), version))

    def get(self, key, version: int | None = None) -> DataFrame:
        """The live row of one key: the files whose key range holds it, then the newest version that no range delete hides."""
        files = self.manifest(version).filter((F.col("kind") == schema.ROWS) & (F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))
        return snapshot(self._visible(self._files(self.log_schema, files).filter(F.col("key") == F.lit(key)), version))

    def seek(self, target, how: str, version: int | None = None) -> DataFrame:
        """The live row nearest target ("ge", "gt", "le", "lt") over all files."""
        bound = {"low": target} if how in ("ge", "gt") else {}
        return seek(self.live(version, **bound), "key", target, how)

    def compact(self, drop, files: int | None = None) -> int | None:
        """Compact what is due into the next level, with the overlapping files there; the new version, or None if nothing is due.

        Rows that a range delete hides go; the range deletes themselves stay for files elsewhere.
        """
        manifest = self.manifest().filter(F.col("kind") == schema.ROWS)
        due = materialize(manifest.join(compaction.pick(manifest, self.options.level0_files, self.options.level_base_bytes), ["level", "file_num"]).select(*manifest.columns), "due")
        if due.isEmpty():
            return None
        bounds = due.agg(F.min("level").alias("from_level"), F.min("min_key").alias("low"), F.max("max_key").alias("high"))  # one row
        below = manifest.join(F.broadcast(bounds), (F.col("level") == F.col("from_level") + 1) & (F.col("max_key") >= F.col("low")) & (F.col("min_key") <= F.col("high"))).select(*manifest.columns)
        inputs = materialize(due.unionByName(below), "inputs")
        level = min(bounds.first()["from_level"] + 1, schema.LEVELS - 1)
        log = self._visible(self._files(self.log_schema, inputs), None).withColumn("run_id", F.lit(0))
        return self.commit(self.write(compaction.compact(log, drop), level, files), inputs)

    def close(self) -> None:
        """Remove what unfinished commits left behind. Nothing else is held: no file, cache or lock."""
        folder, fs = self._fs(self.path)
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName().startswith("pending-"):
                fs.delete(status.getPath(), True)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop all but the newest keep versions and the files that no kept version names; returns what went."""
        known = self.versions()
        kept, gone = known[-keep:], known[:-keep]
        still = {r["path"] for v in kept for r in self.manifest(v).select("path").collect()}
        old = {r["path"] for v in gone for r in self.manifest(v).select("path").collect()} - still
        for path in [*(f"{self.path}/versions/v{v}" for v in gone), *old]:
            target, fs = self._fs(path)
            fs.delete(target, True)
        return sorted(old)
