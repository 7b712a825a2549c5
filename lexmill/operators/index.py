"""Keeping enrichment, embeddings and the index up to date."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.functions.text import with_cost
from lexmill.sources.tables import BucketTable

# Steps in order, the status each needs and the status after it.
STEPS = ("EXTRACTION", "CLEANING", "TOKENIZATION", "PARSER", "TREE", "CHUNKING", "ENRICHMENT", "EMBEDDINGS", "INDEXING")
STATUSES = ("UPLOADED", "EXTRACTED", "CLEANED", "TOKENIZED", "PARSED", "STRUCTURED", "CHUNKED", "ENRICHED", "EMBEDDED", "INDEXED")
#: Which tables go when a step is run again, by the last step that clears them.
CLEARED_UP_TO = {"tokens": "TOKENIZATION", "structure": "TREE", "chunks": "CHUNKING", "embeddings": "EMBEDDINGS"}


def pending_enrichment(chunks: DataFrame, enrichments: DataFrame, model: str) -> DataFrame:
    """Chunks without an enrichment of this model."""
    return chunks.join(enrichments.where(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")


def pending_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks (chunk_id, content) with their hash and whether they are to be embedded: missing, changed or of another model."""
    hashed = chunks.withColumn("hash", F.sha2("content", 256))
    old = embeddings.select("chunk_id", F.col("hash").alias("old_hash"), F.col("model").alias("old_model"))
    todo = ~(F.col("old_hash").eqNullSafe(F.col("hash")) & F.col("old_model").eqNullSafe(F.lit(model)))
    return hashed.join(old, "chunk_id", "left").select("chunk_id", "hash", todo.alias("pending"))


def bucketed_table(spark: SparkSession, name: str, path: str, columns: str, key: str = "chunk_id", buckets: int = 256) -> DataFrame:
    """A parquet table at `path`, known as `name` in this session, whose files are dealt and sorted by the key: two such tables of as many buckets join without an exchange."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_bucketed(rows: DataFrame, name: str, key: str = "chunk_id", buckets: int = 256) -> None:
    """Put these rows in place of a bucketed table's, a file for each bucket."""
    columns = rows.sparkSession.table(name).columns
    rows.select(*columns).repartition(buckets, key).write.mode("overwrite").insertInto(name)


def pending_stored(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """`pending_embeddings` of chunks that are stored with their hash (chunk_id, hash): on bucketed tables nothing is shuffled and no content is read."""
    old = embeddings.select("chunk_id", F.col("hash").alias("old_hash"), F.col("model").alias("old_model"))
    todo = ~(F.col("old_hash").eqNullSafe(F.col("hash")) & F.col("old_model").eqNullSafe(F.lit(model)))
    return chunks.select("chunk_id", "hash").join(old, "chunk_id", "left").select("chunk_id", "hash", todo.alias("pending"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; both have the same columns."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Embeddings by chunk_id with the new ones (chunk_id, vector, model, hash, dimension, ...) in place: these are not indexed yet."""
    fresh = new.select(*(new[c] if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns if c not in ("indexed", "indexed_at")))
    fresh = fresh.withColumns({"indexed": F.lit(False), "indexed_at": F.lit(None).cast("timestamp")})
    return upsert(old, fresh.select(*old.columns), ["chunk_id"])


EMBEDDINGS = "chunk_id string, document_id string, vector array<double>, model string, hash string, dimension int, duration_ms long, indexed boolean, indexed_at timestamp"


def embeddings_table(spark: SparkSession, path: str) -> BucketTable:
    """Stored embeddings, bucketed by chunk."""
    return BucketTable(spark, path, StructType.fromDDL(EMBEDDINGS), "chunk_id")


def store_embeddings(table: BucketTable, new: DataFrame) -> list[int]:
    """`upsert_embeddings` on a stored table: only the buckets of the new chunks are written again, a rerun writes the same; returns those buckets."""
    fresh = new.select(*(new[f.name] if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name not in ("indexed", "indexed_at")))
    return table.replace(fresh.withColumns({"indexed": F.lit(False), "indexed_at": F.lit(None).cast("timestamp")}))


def _remove_documents(table: BucketTable, gone: DataFrame) -> list[int]:
    """Rows of these documents (document_id) go from a table bucketed by them or by another key."""
    if table.key == "document_id":
        return table.remove(gone)
    return table.remove(table.read().join(gone, "document_id", "left_semi").select(table.key).distinct())


def invalidate_stored(tables: dict[str, BucketTable], rerun: DataFrame) -> dict[str, list[int]]:
    """`invalidate` on stored tables; returns the buckets of each that were written again. In order, so that a failed run is done again whole."""
    steps, touched = F.array(*map(F.lit, STEPS)), {}
    for name, table in tables.items():
        gone = rerun.where(F.array_position(steps, F.col("step")) <= STEPS.index(CLEARED_UP_TO[name]) + 1).select("document_id").distinct()
        touched[name] = _remove_documents(table, gone)
    return touched


def cascade_delete_stored(tables: dict[str, BucketTable], gone: DataFrame) -> dict[str, list[int]]:
    """`cascade_delete` on stored tables: all rows of the documents (document_id) go, the table named documents last."""
    last = sorted(tables, key=lambda name: name == "documents")
    return {name: _remove_documents(tables[name], gone.select("document_id").distinct()) for name in last}


def index_rows(embeddings: DataFrame, chunks: DataFrame, documents: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(embeddings with their retrieval metadata, marked as indexed; errors of those without a vector).

    chunks (chunk_id, document_id, chunk_index, article, chapter, section, part,
    total_parts, enrichment), documents (document_id, name).
    """
    joined = embeddings.join(chunks.join(documents.select("document_id", "name"), "document_id", "left"), "chunk_id", "left")
    meta = F.struct(
        F.col("name").alias("documento"), F.col("article").alias("artigo"), F.col("chapter").alias("capitulo"), F.col("section").alias("secao"), F.col("part").alias("parte"),
        F.col("total_parts").alias("total_partes"), "chunk_index", F.col("enrichment").alias("enriquecimento"),
    )
    good = joined.where("vector is not null").select("chunk_id", meta.alias("metadata"), F.lit(True).alias("indexed"), (F.current_timestamp() if at is None else at).alias("indexed_at"))
    return good, joined.where("vector is null").select("chunk_id", F.concat(F.lit("no vector for chunk "), F.col("chunk_id")).alias("error"))


def enrichment_totals(chunks: DataFrame) -> DataFrame:
    """(document_id, enriched, total, cost_usd, duration_ms) of chunks (document_id, enrichment, cost_usd, duration_ms)."""
    return chunks.groupBy("document_id").agg(
        F.count("enrichment").alias("enriched"), F.count("*").alias("total"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms")
    )


def eligible(status: Column, step: Column) -> Column:
    """Whether a document of this status may run the step: it has reached what the step needs."""
    order, steps = F.array(*map(F.lit, STATUSES)), F.array(*map(F.lit, STEPS))
    return F.array_position(order, status) >= F.array_position(steps, step)


def status_after(step: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), F.array_position(F.array(*map(F.lit, STEPS)), step).cast("int") + 1)


def invalidate(tables: dict[str, DataFrame], rerun: DataFrame) -> dict[str, DataFrame]:
    """Tables (by name, each with document_id) without what the steps run again (document_id, step) make stale."""
    steps = F.array(*map(F.lit, STEPS))
    out = {}
    for name, df in tables.items():
        last = STEPS.index(CLEARED_UP_TO[name]) + 1
        gone = rerun.where(F.array_position(steps, F.col("step")) <= last).select("document_id").distinct()
        out[name] = df.join(gone, "document_id", "left_anti")
    return out


def apply_model(rows: DataFrame, client: Callable[[], Callable[[list[str]], list]], batch_size: int = 64, text_col: str = "content") -> DataFrame:
    """(chunk_id, vector, dimension, duration_ms) by an injected embedder, built once a task and called in batches.

    The embedder takes texts and returns (index, vector) pairs in any order; a text without
    one gets an empty vector. A text's time is its share of its batch.
    """

    def run(batches):
        call = client()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                began = time.monotonic()
                found = dict(call(part[text_col].tolist()))
                took = round((time.monotonic() - began) * 1000 / len(part))
                vectors = [list(found.get(k, [])) for k in range(len(part))]
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "vector": vectors, "dimension": [len(v) for v in vectors], "duration_ms": took})

    kind = rows.schema["chunk_id"].dataType.simpleString()
    return rows.select("chunk_id", text_col).mapInPandas(run, f"chunk_id {kind}, vector array<double>, dimension int, duration_ms long")


def call_model(rows: DataFrame, key: str, client: Callable[[], Callable[[str], tuple[str, int, int]]], model: str) -> DataFrame:
    """(key, prompt, raw, model, tokens_in, tokens_out, duration_ms) of each (key, prompt), by an injected client built once a task.

    The client takes a prompt and returns the raw answer with the tokens it took and gave.
    Write the result before it is used twice, or calls are made twice.
    """

    def run(batches):
        call = client()
        for pdf in batches:
            out = []
            for prompt in pdf["prompt"]:
                began = time.monotonic()
                raw, tokens_in, tokens_out = call(prompt)
                out.append((raw, tokens_in, tokens_out, round((time.monotonic() - began) * 1000)))
            done = pd.DataFrame(out, columns=["raw", "tokens_in", "tokens_out", "duration_ms"])
            yield pd.DataFrame({key: pdf[key].to_numpy(), "prompt": pdf["prompt"].to_numpy(), "raw": done["raw"], "model": model, "tokens_in": done["tokens_in"], "tokens_out": done["tokens_out"], "duration_ms": done["duration_ms"]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "prompt").mapInPandas(run, f"{key} {kind}, prompt string, raw string, model string, tokens_in long, tokens_out long, duration_ms long")


def enrich(chunks: DataFrame, template: str, client, model: str, prices: DataFrame, strings: tuple[str, ...], lists: tuple[str, ...]) -> DataFrame:
    """Chunks (chunk_id, content, context) with prompt, raw answer, tokens, cost, time and the answer's fields as a struct."""
    asked = chunks.select("chunk_id", fill_prompt(F.lit(template), F.col("content"), F.nullif("context", F.lit(""))).alias("prompt"))
    return with_cost(call_model(asked, "chunk_id", client, model), prices).withColumn("enrichment", parse_enrichment(F.col("raw"), strings, lists))


def parse_enrichment(raw: Column, strings: tuple[str, ...], lists: tuple[str, ...]) -> Column:
    """Tolerant reading of a model's JSON: strings that are none become '', lists keep their strings, all else the defaults."""
    v = F.try_parse_json(raw)

    def text(name):
        part = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, f"$.{name}", "string")).otherwise("")

    def items(name):
        parts = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        own = F.filter(parts, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
        return F.transform(own, lambda x: F.try_variant_get(x, "$", "string"))

    return F.struct(*(F.coalesce(text(n), F.lit("")).alias(n) for n in strings), *(items(n).alias(n) for n in lists))


def fill_prompt(template: Column, content: Column, context: Column) -> Column:
    """The template with its text, then its context put in, literally and in that order."""
    with_text = F.replace(template, F.lit("{{TEXTO}}"), content)
    return F.replace(with_text, F.lit("{{CONTEXTO}}"), F.coalesce(context, F.lit("(sem contexto)")))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the documents that go."""
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}
