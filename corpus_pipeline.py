"""A training corpus from documents: toxic texts go, near duplicates and repeated passages go, personal data is masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import jaccard_join, packing, pii, substring_dedup, toxicity
from lexmill.llm.store import Scratch


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage changes it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the threshold of toxicity; the model learns from the labelled rows alone."""
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.reject(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of texts whose sets of five-word shingles are linked at 0.8 or more."""
    return jaccard_join.near_duplicate_representatives(docs, width=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that start in a smaller doc_id too."""
    return _with_length(substring_dedup.cut_repeats(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, plain or disguised, replaced by its kind."""
    return _with_length(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every text in sequences of 512 to 4,096 words."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: No stage before the last can be said in SQL; tests hold the rows against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again by the next; what a stage has read goes then.

    * Stages judge what their predecessor kept; all but the last return the columns of documents.
    * A null text is kept as it is (no evidence of toxicity, no copy, no passage, no
      personal data) and is packed as a row of no length, as an empty one is.
    * Of rows that repeat a doc_id all stay or go together, but for toxicity, which judges
      each text; a row with a null doc_id is no near duplicate of any and loses no passage.
    * An empty table gives an empty result; further columns, whatever their names, go
      through to the last stage, which returns those of `packing.pack`.
    """
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage-{k}")
            scratch.drop(f"stage-{k - 1}")
    return docs
