"""Incremental jobs over micro-batches: the same batch operators inside foreachBatch."""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexmill.config import Chunking, Patterns
from lexmill.functions import text
from lexmill.operators import chunking, index, lexer
from lexmill.sources import files
from lexmill.sources.staged import Staging
from lexmill.sources.tables import BucketTable


def article_units(tree: DataFrame) -> DataFrame:
    """Articles of `lexer.nodes` as the chunks' input: the lines of their full text after the first are the units."""
    return lexer.articles_with_texts(tree).select("doc_id", "idx", "title", "chapter", "section", "label", F.split("full_text", "\n").alias("units"))


def intake(stream: DataFrame, out: str, checkpoint: str, patterns: Patterns = Patterns(), cfg: Chunking = Chunking()) -> StreamingQuery:
    """Clean, lex, structure and chunk each new document (doc_id, text) once: tokens, nodes and chunks as tables below `out`.

    A document lies in one micro-batch whole, so the windows of the lexer see all its lines.
    A batch that runs again after a failure overwrites its own folders: nothing is written twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        cleaned = text.clean(df).select("doc_id", F.col("cleaned").alias("text"))
        saved = lambda rows, name: rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        read = lambda name: df.sparkSession.read.parquet(f"{out}/{name}/batch={number}")
        saved(lexer.tokens(lexer.lines(cleaned), patterns), "tokens")
        saved(lexer.nodes(read("tokens"), patterns), "nodes")
        saved(chunking.chunks(article_units(read("nodes")), cfg), "chunks")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TOKENS = "document_id string, idx int, type string, text string, position long, line_no int"
NODES = "document_id string, idx int, type string, depth int, parent_idx int, parent_type string, chapter_idx int, section_idx int, article_idx int, kept boolean, number string, label string, title string, text string, line_no int"
CHUNKS = "document_id string, idx int, part int, total_parts int, content string, token_count long, char_count long, chunk_index int"


def folder_tables(spark: SparkSession, out: str) -> dict[str, tuple[BucketTable, tuple[str, ...]]]:
    """The tables below `out` and the columns that tell their rows of one document apart: documents, tokens, nodes, chunks."""
    own = lambda name, ddl: BucketTable(spark, f"{out}/{name}", StructType.fromDDL(ddl), "document_id")
    return {"documents": (files.documents_table(spark, out), ("name",)), "tokens": (own("tokens", TOKENS), ("idx",)), "nodes": (own("nodes", NODES), ("idx",)), "chunks": (own("chunks", CHUNKS), ("chunk_index",))}


def _store(spark: SparkSession, documents: DataFrame, gone: DataFrame | None, out: str, patterns: Patterns, cfg: Chunking, keep: Staging) -> None:
    """Put documents and all that follows from their texts in place of what stands there of them, and of those that are gone.

    The documents come last: a run that fails before that finds the same files changed again.
    """
    tables = {name: t for name, (t, _) in folder_tables(spark, out).items()}
    cleaned = text.clean(documents.where("text is not null")).select(F.col("document_id").alias("doc_id"), F.col("cleaned").alias("text"))
    toks = keep(lexer.tokens(lexer.lines(cleaned), patterns))
    tree = keep(lexer.nodes(toks, patterns))
    ids = documents.select("document_id")
    ids = ids if gone is None else ids.unionByName(gone)
    for name, rows in (("tokens", toks), ("nodes", tree), ("chunks", chunking.chunks(article_units(tree), cfg))):
        tables[name].replace(rows.withColumnRenamed("doc_id", "document_id"), ids)
    tables["documents"].replace(documents, gone)


def refresh_folder(spark: SparkSession, folder: str, out: str, patterns: Patterns = Patterns(), cfg: Chunking = Chunking()) -> tuple[int, int]:
    """Bring documents, tokens, nodes and chunks below `out` in step with a folder of files; returns how many documents came and went.

    Files are told apart by path, time and size; only new and changed ones are read, and
    only the buckets of their documents, and of those whose files are gone, are written again.
    """
    with Staging(spark) as keep:
        known = keep(files.documents_table(spark, out).read().select("document_id", "path", "modified", "size_bytes"))
        changed, gone = files.changed_files(spark, folder, known)
        documents, gone = keep(files.documents_of(changed)), keep(gone)
        counts = documents.count(), gone.count()
        if any(counts):
            _store(spark, documents, gone, out, patterns, cfg, keep)
    return counts


def intake_files(spark: SparkSession, folder: str, out: str, checkpoint: str, patterns: Patterns = Patterns(), cfg: Chunking = Chunking()) -> StreamingQuery:
    """The same tables fed by a stream of a folder's new files; a batch that runs again replaces its own rows."""

    def batch(df: DataFrame, number: int) -> None:
        with Staging(df.sparkSession) as keep:
            _store(df.sparkSession, keep(files.documents_of(df)), None, out, patterns, cfg, keep)

    return files.stream_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EMBEDDINGS = "chunk_id string, vector array<double>, dimension int, duration_ms long, hash string, model string, indexed boolean, indexed_at timestamp"


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a folder that `refresh_embeddings` writes to; none before its first batch."""
    try:
        return spark.read.schema(f"{EMBEDDINGS}, version long, stream long, batch long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{EMBEDDINGS}, version long, stream long, batch long")


def _newest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "chunk_id")), "version").alias("e"))
    return last.select("chunk_id", "e.*").drop("version", "stream", "batch")


def current_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The newest embedding of every chunk."""
    return _newest(_versions(spark, path))


def refresh_embeddings(stream: DataFrame, path: str, checkpoint: str, client, model: str) -> StreamingQuery:
    """Embed those chunks (chunk_id, content) of each batch that are missing, changed or of another model.

    A batch adds only what it made, as a version of its own; what stands in the folder
    from this or an earlier stream stays, and readers take each chunk's newest version. A
    batch that runs again leaves its own former output out of account and overwrites it.
    """
    name = zlib.crc32(checkpoint.encode())

    def batch(df: DataFrame, number: int) -> None:
        others = _versions(df.sparkSession, path).where((F.col("stream") != name) | (F.col("batch") != number))
        version = (others.agg(F.max("version")).first()[0] or 0) + 1
        newest = df.groupBy("chunk_id").agg(F.max("content").alias("content"))
        todo = index.pending_embeddings(newest, _newest(others), model).where("pending").select("chunk_id", "hash")
        made = index.apply_model(newest.join(todo, "chunk_id"), client).join(todo, "chunk_id")
        made = made.withColumns({"model": F.lit(model), "indexed": F.lit(False), "indexed_at": F.lit(None).cast("timestamp"), "version": F.lit(version).cast("long")})
        made.write.mode("overwrite").parquet(f"{path}/stream={name}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
