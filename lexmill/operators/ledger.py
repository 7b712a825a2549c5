"""Model calls that are made once: an append-only table of results, read before any call.

A ledger is a parquet folder of (key, model, prompt_hash, result, error, duration_ms). Calls
are made in waves, each one Spark job that adds its results when it ends: what a run that
fails has finished stays, and a task that is lost costs no more calls than it makes in a wave.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "key string, model string, prompt_hash string, result string, error string, duration_ms long"


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(F.coalesce(prompt, F.lit("")), 256)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries; none before the first call."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(path)


def finished(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(key, prompt_hash, result, duration_ms) of the calls of a model that gave a result, one each."""
    done = read(spark, path).where((F.col("model") == model) & F.col("error").isNull())
    return done.groupBy("key", "prompt_hash").agg(F.min(F.struct("result", "duration_ms")).alias("r")).select("key", "prompt_hash", "r.*")


def _answers(client: Callable[[], Callable[[list[str]], list]], model: str, batch_size: int):
    """Results of prompts, asked for in batches by a client built once a task; a call that raises is an entry with its error."""

    def run(batches):
        call = client()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                began = time.monotonic()
                try:
                    results, error = [json.dumps(r, ensure_ascii=False) for r in call(part["prompt"].tolist())], None
                    if len(results) != len(part):
                        raise ValueError(f"{len(results)} results for {len(part)} prompts")
                except Exception as e:  # the model's failure is data; the job goes on
                    results, error = [None] * len(part), f"{type(e).__name__}: {e}"
                took = round((time.monotonic() - began) * 1000 / len(part))
                yield pd.DataFrame({"key": part["key"].to_numpy(), "model": model, "prompt_hash": part["prompt_hash"].to_numpy(), "result": results, "error": error, "duration_ms": took})

    return run


def ask(prompts: DataFrame, client: Callable[[], Callable[[list[str]], list]], model: str, path: str, batch_size: int = 1, calls_per_task: int = 100) -> DataFrame:
    """(key, prompt, result as JSON, error, duration_ms) of every (key, prompt), one row for each pair.

    The client takes a list of prompts and returns a JSON value for each. Only pairs without
    a finished call of this model in the ledger at `path` are asked; a failed one is an entry
    of its own and is asked again by the next run. Null prompts count as empty.
    """
    spark = prompts.sparkSession
    asked = prompts.select(F.col("key").cast("string").alias("key"), F.coalesce("prompt", F.lit("")).alias("prompt")).distinct().withColumn("prompt_hash", prompt_hash(F.col("prompt")))
    todo = asked.join(finished(spark, path, model), ["key", "prompt_hash"], "left_anti")
    tasks = max(1, spark.sparkContext.defaultParallelism)
    waves = -(-todo.count() // (tasks * calls_per_task * batch_size))
    run, written = f"{path}/run-{uuid.uuid4().hex}", []
    for wave in range(waves):
        own = todo.where(F.pmod(F.xxhash64("key", "prompt_hash"), F.lit(waves)) == wave)
        answers = own.repartition(tasks, "key", "prompt_hash").mapInPandas(_answers(client, model, batch_size), LEDGER)
        answers.write.mode("overwrite").parquet(f"{run}/wave={wave}")
        written.append(f"{run}/wave={wave}")
    now = spark.read.schema(LEDGER).parquet(*written) if written else spark.createDataFrame([], LEDGER)
    errors = now.where("error is not null").select("key", "prompt_hash", "error")
    done = asked.join(finished(spark, path, model), ["key", "prompt_hash"], "left").join(errors, ["key", "prompt_hash"], "left")
    return done.select("key", "prompt", "result", "error", "duration_ms")
