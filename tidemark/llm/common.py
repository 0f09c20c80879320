"""Helpers that several text operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, whichever comes first: long texts come a few at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let Python workers import this package."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tidemark/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or staged_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table that no later plan reads."""
    for folder in {os.path.dirname(x) for x in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)


class Staged:
    """Tables that one operator writes on its way (see ``stage``), to be deleted when nothing reads them any more."""

    def __init__(self, what: str):
        self.what, self.held = what, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = staged_path(df.sparkSession, f"{self.what}-{name}")
        out = stage(df, f"{self.what}-{name}", path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables' files; those of all others too if none is given."""
        for key in [id(x) for x in tables] or list(self.held):
            df, path = self.held.pop(key)
            delete_folder(df.sparkSession, path)

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df``, the result, and delete all tables before it."""
        out = stage(df, f"{self.what}-{name}")
        self.drop()
        return out


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], list[list]]], key: str, text: str, out: str) -> DataFrame:
    """Map (key, text) rows in Arrow batches.

    ``make()`` runs once in each task and returns ``f(keys, texts) -> columns``;
    ``out`` is the schema of those columns in DDL form.
    """
    schema = df.sparkSession.createDataFrame([], out).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                cols = f(b.column(0).to_pylist(), b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """A helper column's name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def byte_length(text: str):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
