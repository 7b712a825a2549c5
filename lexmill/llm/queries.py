"""Registered queries of this package: op1 to op13, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, conversations, html_text, jaccard_join, license_scan, neighbours, packing, pii, quality, secret_scan, sql, substring_dedup, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """Where the installed public vocabularies keep the word-ending BPE of 49k tokens."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return jaccard_join.similarity_components(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op6_html_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_table(_table(spark, sf_dir, "pages"))


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(_table(spark, sf_dir, "documents"), word_vocabulary())


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit_table(conversations.with_faults_injected(_table(spark, sf_dir, "conversations")))


def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.transform(vectors, whitening.fit(vectors))


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base patterns of op4 alone find, which SQL can say too."""
    found = pii.span_digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_nn_descent, op3_recompression_dedup, op4_pii_deobfuscation, op5_quality_divergence, op6_html_tag_paths, op7_bpe_trie, op8_best_fit_packing, op9_license_scan, op10_toxicity,
        op11_secret_scan, op12_conversation_repair, op13_qdwh_whitening, personal_data_counts,
    )
}
#: The others cannot be said in SQL: a graph search, spans of a transducer, page text, a vocabulary's merges, packing and a trained model; tests hold them against plain versions.
ORACLES = {
    "op1_ngram_jaccard_join": sql.JACCARD_COMPONENTS,
    "op3_recompression_dedup": sql.REPEATED_PASSAGES,
    "op5_quality_divergence": sql.quality_divergence(),
    "op9_license_scan": sql.license_blocks(),
    "op11_secret_scan": sql.secrets(),
    "op12_conversation_repair": sql.conversation_repair(),
    "personal_data_counts": sql.PERSONAL_DATA_COUNTS,
}
