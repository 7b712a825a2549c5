"""From questions to checked answers as one job: every stage reads what the stage before has written.

Questions are few beside the chunks, so each stage is keyed by the question and no stage
but the vector search and the match of references reads a whole table. A stage that later
ones read more than once is written; the model's calls go through the ledger, so that a run
that fails goes on behind the calls it has finished.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.config import Retrieval
from lexmill.functions.text import fold, with_cost
from lexmill.operators import answers, history, ledger, search
from lexmill.sources.staged import staged


@dataclass(frozen=True)
class Knowledge:
    """What is asked: embeddings (chunk_id, document_id, vector, indexed), chunks (chunk_id, document_id, content,
    article_id, chapter_label, section_label, enrichment), documents (document_id, document_name,
    document_created_at), articles (article_id, article_label).

    enrichment is a struct of tema, subtema, categoria, palavras_chave, assuntos, resumo, observacoes and referencias.
    """

    embeddings: DataFrame
    chunks: DataFrame
    documents: DataFrame
    articles: DataFrame


@dataclass(frozen=True)
class Templates:
    """Prompts; {{PERGUNTA}}, {{TRECHOS}} and {{CONTEXTO}} stand for the question, the numbered excerpts and the context."""

    category: str
    entities: str
    rerank: str
    answer: str


@dataclass(frozen=True)
class Answered:
    """Everything a run leaves: questions (one row each, with the answer and its checks), retrievals (all stages), evidences and traces."""

    questions: DataFrame
    retrievals: DataFrame
    evidences: DataFrame
    traces: DataFrame


def _asked(prompts: DataFrame, client, model: str, path: str, prices: DataFrame) -> DataFrame:
    """(question_id, prompt, raw, model, tokens_in, tokens_out, duration_ms, cost_usd); a call that failed has an empty answer, which every reading tolerates."""
    kind = prompts.schema["question_id"].dataType
    made = ledger.ask(prompts.select(F.col("question_id").cast("string").alias("key"), "prompt"), client, model, path)
    answer = F.from_json("result", "raw string, tokens_in long, tokens_out long")
    rows = made.withColumn("r", answer).select(
        F.col("key").cast(kind).alias("question_id"), "prompt", F.coalesce("r.raw", F.lit("")).alias("raw"), F.lit(model).alias("model"),
        *(F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c) for c in ("tokens_in", "tokens_out")), F.coalesce("duration_ms", F.lit(0)).cast("long").alias("duration_ms"),
    )
    return with_cost(rows, prices)


def _filled(template: str, **parts: Column) -> Column:
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def ask_questions(questions: DataFrame, knowledge: Knowledge, client, model: str, prices: DataFrame, templates: Templates, ledger_path: str, cfg: Retrieval = Retrieval(), rerank: bool = True) -> Answered:
    """Answer questions (question_id, text, vector): classify, find entities, search, re-rank by metadata, follow references, rerank, ask, check.

    The client, built once a task, takes a list of prompts and returns {"raw", "tokens_in",
    "tokens_out"} for each. Of questions that repeat an id one row is used, the smallest by text.
    """
    one = questions.groupBy("question_id").agg(F.min(F.struct("text", "vector")).alias("q")).select("question_id", F.coalesce("q.text", F.lit("")).alias("text"), "q.vector")
    asked = staged(one)
    call = lambda prompts, step: _asked(prompts, client, model, f"{ledger_path}/{step}", prices)
    prompt = lambda template: asked.select("question_id", _filled(template, PERGUNTA=F.col("text")).alias("prompt"))
    category = call(prompt(templates.category), "category").select("question_id", answers.parse_category(F.col("raw")).alias("c"))
    entities = call(prompt(templates.entities), "entities").select("question_id", answers.parse_entities(F.col("raw")).alias("entities"))
    known = asked.join(category, "question_id").join(entities, "question_id").withColumn("terms", answers.entity_terms(F.col("entities")))
    known = staged(known.select("question_id", "text", "vector", "c.category", "c.confidence", "entities", F.col("terms").alias("named"), F.split(fold(F.array_join("terms", "\x1f")), "\x1f").alias("terms"), fold("category").alias("folded_category")))

    vector = staged(search.vector_search(known.select("question_id", "vector"), knowledge.embeddings, knowledge.chunks, knowledge.documents, knowledge.articles, cfg.vector_k))
    hay = search.haystack(*(F.col(c) for c in ("document_name", "article_label", "chapter_label", "section_label", "enrichment")))
    met = vector.withColumn("haystack", hay).join(known.select("question_id", "terms", F.col("folded_category").alias("category"), F.col("category").alias("category_name")), "question_id")
    metadata = staged(search.metadata_rerank(met, cfg.metadata_k).drop("haystack", "terms", "category", "category_name").withColumn("ord", F.col("new_rank") - 1))

    refs = search.reference_candidates(F.col("enrichment.referencias"), F.col("content"))
    matches = staged(search.cross_references(metadata.select("question_id", "ord", "document_id", "document_name", "article_label", refs.alias("refs")), knowledge.documents))
    indexed = knowledge.embeddings.where("indexed and vector is not null")
    near = search.cross_reference_chunks(matches, known.select("question_id", "vector"), indexed, cfg.per_document)
    named = near.join(knowledge.chunks.drop("document_id"), "chunk_id").join(knowledge.documents, "document_id").join(knowledge.articles.select("article_id", "article_label"), "article_id", "left")
    reference = staged(named.withColumns({"rerank_score": F.lit(None).cast("double"), "ord": F.col("rank")}))

    candidates = metadata.withColumn("rank", F.col("ord"))
    scores = None
    if rerank:
        listed = answers.rerank_prompts(candidates.select("question_id", "rank", F.col("document_name").alias("document"), F.col("article_label").alias("article"), F.col("content").alias("text")))
        listed = listed.join(known.select("question_id", "text"), "question_id").select("question_id", _filled(templates.rerank, PERGUNTA=F.col("text"), TRECHOS=F.col("prompt")).alias("prompt"))
        scores = call(listed, "rerank").select("question_id", "raw")
    final = search.rerank(candidates.drop("rerank_score"), scores, cfg.final_k, rerank)
    final = staged(final.withColumns({"rerank_score": F.col("score"), "ord": F.col("final_rank"), "stage": F.lit("RERANK")}))

    columns = ["question_id", "ord", "chunk_id", "document_id", "document_name", "document_created_at", "article_label", "chapter_label", "section_label", "content", "enrichment", "distance", "rerank_score", "stage", "reason"]
    retrieved = final.select(*columns).unionByName(reference.select(*columns))
    contexts = answers.build_contexts(answers.context_blocks(retrieved))
    prompts = staged(answers.answer_prompts(known, contexts, templates.answer))
    made = call(prompts.where("has_evidence"), "answer").withColumn("answer", answers.parse_answer(F.col("raw")))
    generated = staged(answers.with_answers_without_evidence(made, prompts, model))

    cited = generated.select("question_id", F.posexplode("answer.artigos_utilizados").alias("cite", "a"))
    shown = F.concat_ws(" ", "a.lei", F.coalesce("a.artigo", F.lit("")))
    cited = cited.select("question_id", "cite", fold("a.lei").alias("law"), fold("a.artigo").alias("article"), shown.alias("shown"))
    place = F.col("ord") + F.when(F.col("stage") == "REFERENCE", cfg.final_k).otherwise(0)
    folded = retrieved.select("question_id", place.alias("ord"), "chunk_id", fold("document_name").alias("law"), fold("article_label").alias("article"))
    reconciled = staged(answers.reconcile(cited, folded))
    checked = answers.validate(generated.select("question_id", F.col("answer.nivel_confianca").alias("confidence"), F.col("answer.has_conflict").alias("has_conflict"), F.size("answer.conflict_details").alias("n_conflicts")), reconciled, retrieved)

    whole = known.select("question_id", "text", "category", "confidence", "entities").join(generated, "question_id").join(checked, "question_id")
    order = {"VECTOR": vector.withColumn("ord", F.col("rank")), "METADATA": metadata, "REFERENCE": reference, "RERANK": final}
    log = staged(history.retrieval_log(order, "RERANK"))
    traces = answers.traces(known.select("question_id", "text", "category", "confidence", "entities"), log, generated)
    return Answered(staged(whole), log, answers.evidences(retrieved.withColumn("ord", place)), traces)
