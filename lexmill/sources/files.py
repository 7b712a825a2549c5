"""Files of a folder as uploads, once or as they come, and the folder's documents kept in step with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.sources.documents import register
from lexmill.sources.tables import BucketTable

FILES = "path string, modificationTime timestamp, length long, content binary"
#: What is kept of a file beside its document: where it was, and what tells a changed file from the one that was read.
DOCUMENTS = "document_id string, name string, type string, size_bytes long, status string, engine string, text string, error string, path string, modified timestamp"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder but those without a byte, which Spark's reader leaves out. Contents are read only by plans that ask for them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of new files; a file that changes in place does not come again (`changed_files` finds it)."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)


def _name():
    return F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))


def uploads(files: DataFrame) -> DataFrame:
    """(document_id, name, mime, content, size_bytes, pasted, path, modified) of files; a path is one document for good."""
    none = F.lit(None).cast("string")
    return files.select(
        F.sha2("path", 256).alias("document_id"), _name().alias("name"), none.alias("mime"), "content", F.col("length").alias("size_bytes"), none.alias("pasted"), "path", F.col("modificationTime").alias("modified")
    )


def documents_of(files: DataFrame) -> DataFrame:
    """Documents (see DOCUMENTS) of files: every file has a row.

    Bytes that are no UTF-8 become replacement characters, which cleaning drops, and are
    named in `error`; so are types whose text has to come with their pages.
    """
    given = uploads(files)
    done = register(given).join(given.select("document_id", "path", "modified", F.is_valid_utf8(F.col("content").cast("string")).alias("valid")), "document_id")
    error = F.when(F.col("engine").isNull(), F.concat(F.lit("no text without pages: "), "type")).when(~F.col("valid"), "bytes that are no UTF-8")
    return done.withColumn("error", error).select(*StructType.fromDDL(DOCUMENTS).fieldNames())


def changed_files(spark: SparkSession, folder: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that are new or differ in time or size from the known (path, modified, size_bytes), known documents whose file is gone).

    The comparison lists the folder without reading a file.
    """
    files = list_files(spark, folder)
    now = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"))
    fresh = now.join(known.select("path", "modified", "size_bytes"), ["path", "modified", "size_bytes"], "left_anti").select("path")
    return files.join(fresh, "path", "left_semi"), known.join(now.select("path"), "path", "left_anti").select("document_id")


def documents_table(spark: SparkSession, out: str) -> BucketTable:
    return BucketTable(spark, f"{out}/documents", StructType.fromDDL(DOCUMENTS), "document_id")
