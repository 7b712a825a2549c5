"""Results that several branches of a plan read, written once to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where none is set and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written now; it goes when the application ends, as results read from it may until then."""
    path = f"{shared_folder(df.sparkSession)}/lexmill-staged-{uuid.uuid4().hex}"
    place, files = _place(df.sparkSession, path)
    files.deleteOnExit(place)
    return _write(df, path)


class Staging:
    """Staged tables of one step, such as a micro-batch, that nothing reads once it has ended: `with Staging(spark) as keep: df = keep(df)`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/lexmill-step-{uuid.uuid4().hex}", 0

    def __enter__(self):
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return _write(df, f"{self.path}/{self.n}")

    def __exit__(self, *_) -> None:
        place, files = _place(self.spark, self.path)
        files.delete(place, True)
