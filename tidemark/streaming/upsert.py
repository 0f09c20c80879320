"""A table that a stream's batches are merged into by key, safe to replay.

Rows lie in hash buckets of their key. A batch rewrites only the buckets that it
touches, under its own number, and then writes a manifest that says which batch
holds each bucket. The manifest is the commit: a batch that failed before it left
nothing that a reader sees, and a batch that is repeated starts from the manifest
before it and writes the same again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class UpsertTable:
    """``keys`` identify a row; ``schema`` is that of all rows."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, buckets: int = 16):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self.fs_path(f"{self.path}/manifests")
        if not self.fs.exists(folder):
            return []
        return sorted(int(n.removesuffix(".json")) for n in (f.getPath().getName() for f in self.fs.listStatus(folder)) if n.endswith(".json"))

    def _holders(self, batch: int | None = None) -> dict[int, int]:
        """Bucket -> the batch that wrote it, by the last manifest (before ``batch``)."""
        known = [m for m in self._manifests() if batch is None or m < batch]
        if not known:
            return {}
        lines = self.spark.read.text(f"{self.path}/manifests/{known[-1]}.json").collect()  # a line of a number a bucket
        return {int(k): v for k, v in json.loads(lines[0].value).items()}

    def _rows(self, holders: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={b}/bucket={k}" for k, b in sorted(holders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Rows replace those of their key; of rows of one key in a batch any one stays, so a batch should have one."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = rows.select(*self.schema.names).dropDuplicates(self.keys).withColumn("bucket", bucket).persist()
        try:
            before = self._holders(batch)
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
            old = self._rows({k: b for k, b in before.items() if k in touched}).withColumn("bucket", bucket)
            same = [old[k].eqNullSafe(rows[k]) for k in self.keys]
            merged = old.join(rows, same, "left_anti").unionByName(rows)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
            self._commit(before | dict.fromkeys(touched, batch), batch)
        finally:
            rows.unpersist()

    def _commit(self, holders: dict[int, int], batch: int) -> None:
        raw = json.dumps({str(k): v for k, v in sorted(holders.items())}).encode()
        made, last = self.fs_path(f"{self.path}/manifests/{batch}.tmp"), self.fs_path(f"{self.path}/manifests/{batch}.json")
        out = self.fs.create(made, True)
        out.write(bytearray(raw))
        out.close()
        self.fs.delete(last, False)  # of an earlier run of the same batch, which said the same
        if not self.fs.rename(made, last):
            raise RuntimeError(f"batch {batch} could not be committed to {self.path}")
        kept = {b for m in self._manifests()[-2:] for b in self._holders(m + 1).values()}
        for m in self._manifests()[:-2]:
            self.fs.delete(self.fs_path(f"{self.path}/manifests/{m}.json"), False)
        for f in self.fs.listStatus(self.fs_path(f"{self.path}/data")):
            if int(f.getPath().getName().removeprefix("batch=")) not in kept | {batch}:
                self.fs.delete(f.getPath(), True)

    def read(self) -> DataFrame:
        """The rows by the last commit."""
        return self._rows(self._holders())

    def sink(self, stream: DataFrame, checkpoint: str, mode: str = "update"):
        """A writer of ``stream`` into this table."""
        return stream.writeStream.outputMode(mode).foreachBatch(lambda df, batch: self.merge(df, batch)).option("checkpointLocation", checkpoint)
