"""Stored tables whose rows are replaced by key: hash buckets of the key, of which only the touched ones are written again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.sources.staged import Staging

BUCKETS = 256


@dataclass(frozen=True)
class BucketTable:
    """A parquet folder partitioned by a hash of the key; schema is that of the rows without the bucket.

    A change reads the buckets of its keys alone, writes their new rows beside the table and
    then puts them in place of the old ones. One that runs again after a failure writes the
    same rows. Rows of a null key share bucket 0.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    buckets: int = BUCKETS

    def _bucket(self) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)), F.lit(0)).cast("int")

    def _folder(self, name: str = ""):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self) -> DataFrame:
        with_bucket = StructType([*self.schema.fields]).add("bucket", "integer")
        place, files = self._folder()
        if not files.exists(place):
            return self.spark.createDataFrame([], with_bucket)
        return self.spark.read.schema(with_bucket).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def replace(self, new: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Rows of every key of `new`, and of `gone` (the key column), make room for those of `new`; returns the buckets written again."""
        with Staging(self.spark) as keep:
            return self._replaced(new, gone, keep)

    def _replaced(self, new: DataFrame, gone: DataFrame | None, keep: Staging) -> list[int]:
        fields = self.schema.fieldNames()
        rows = keep(new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).withColumn("bucket", self._bucket()))
        keys = rows.select(self.key, "bucket")
        if gone is not None:
            keys = keys.unionByName(gone.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).withColumn("bucket", self._bucket()))
        keys = keep(keys.distinct())
        touched = sorted(r[0] for r in keys.select("bucket").distinct().collect())  # at most as many as there are buckets
        if not touched:
            return touched
        old = self._stored().where(F.col("bucket").isin(touched)).alias("o")
        leaves = keys.drop("bucket").withColumnRenamed(self.key, "__key")
        stays = old.join(leaves, F.col(f"o.{self.key}").eqNullSafe(F.col("__key")), "left_anti")
        after = keep(stays.select(*fields, "bucket").unionByName(rows.select(*fields, "bucket")))
        filled = {r[0] for r in after.select("bucket").distinct().collect()}
        after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for bucket in sorted(set(touched) - filled):
            place, files = self._folder(f"bucket={bucket}")
            files.delete(place, True)
        return touched

    def remove(self, gone: DataFrame) -> list[int]:
        """Rows of these keys go."""
        return self.replace(self.spark.createDataFrame([], self.schema), gone)
