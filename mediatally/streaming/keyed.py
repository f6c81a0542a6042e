"""S8 as a sink: a stored table with one row per key, kept up by the batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediatally.operators.items import upsert_items


class KeyedTable:
    """Latest fields per key below a folder, in `buckets` parts by a hash of the key.

    A batch reads the buckets its rows fall into as they were before the batch, merges its rows and writes these buckets anew
    below the batch's own number; other buckets are not touched. The current table is the newest finished version of each
    bucket. Nothing is changed in place: a batch that is run again, after a crash at any point, finds the same state before it
    and overwrites its own folder only, so the result is that of one run. `tidy` deletes versions that no batch needs any more.

    `keys` identify a row, `order` tells which of its rows is the latest, `first` keeps its earliest value. The number of buckets
    is fixed for the life of the table; a batch's cost is that of the buckets it touches.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, *, keys: list[str], order: list[str], first: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.keys, self.order, self.first = keys, order, first
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of the batches that were written to the end."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jpath(p, "_SUCCESS")))

    def _stored(self, versions: list[int]) -> DataFrame:
        """Rows of these versions with `batch` and `bucket`."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        paths = [f"{self.folder}/batch={v}" for v in versions]
        return self.spark.read.schema(f"{columns}, batch bigint, bucket int").option("basePath", self.folder).parquet(*paths)

    def current(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The table, or what it was before a batch; only of the `touched` buckets if given."""
        versions = [v for v in self.versions() if before is None or v < before]
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        stored = self._stored(versions)
        if touched is not None:
            stored = stored.join(touched, "bucket", "left_semi")
        newest = stored.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return stored.join(newest, ["bucket", "batch"], "left_semi").select(*self.schema.names)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Merge one batch; for `foreachBatch`."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.select(*self.schema.names)
        touched = rows.select(bucket.alias("bucket")).distinct()
        both = self.current(batch_id, touched).unionByName(rows)
        merged = upsert_items(both, keys=self.keys, order=self.order, first=self.first).select(*self.schema.names)
        dealt = merged.withColumn("bucket", bucket).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={batch_id}")

    def tidy(self, keep: int = 2) -> None:
        """Delete versions of buckets that a later finished batch replaced, the last `keep` batches left out: they may be run again."""
        settled = self.versions()[:-keep] if keep else self.versions()
        if len(settled) < 2:
            return
        fs, _ = self._fs()
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        newest: dict[str, int] = {}
        for v in reversed(settled):  # at most `buckets` folders per version
            for status in fs.listStatus(jpath(f"{self.folder}/batch={v}")):
                name = status.getPath().getName()
                if name.startswith("bucket=") and newest.setdefault(name, v) != v:
                    fs.delete(status.getPath(), True)
